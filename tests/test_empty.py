"""Empty corpus: every operator gives an empty or
zero result, never an error (ANSI division by zero included)."""
from core_helpers import rows
from lexiflow.operators import dfm as M
from lexiflow.operators import kwic as K
from lexiflow.operators import search as Q
from lexiflow.operators import similarity as H
from lexiflow.operators import stats as A
from lexiflow.operators.tokens import clean_tokens


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, grp string")
    d = M.dfm(clean_tokens(docs))
    assert A.frequent_terms(d).count() == 0
    hits = Q.search(d, "a | b")
    assert rows(Q.search_total(hits)) == [(0, None)]
    assert Q.search_by_group(hits, "grp").count() == 0
    assert H.term_similarity(d, "a").count() == 0
    assert K.kwic(clean_tokens(docs), ["a"]).count() == 0
    assert rows(Q.page_bounds(Q.search_total(hits), 1, 10), "start", "end", "total") == [(0, 0, 0)]
    assert A.top_features(d, 5).count() == 0
    assert M.weight(d, "tfidf").long.count() == 0
