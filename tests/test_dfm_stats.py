import pytest
from pyspark.sql import functions as F

from core_helpers import rows
from lexiflow.operators import dfm as M
from lexiflow.operators import stats as A
from lexiflow.operators.tokens import clean_tokens


def d4(four_docs):
    return M.dfm(clean_tokens(four_docs))


def test_frequent_terms_golden(four_docs):
    ft = rows(A.frequent_terms(d4(four_docs)))
    assert ft[:4] == [("is", 4, 4, 100.0), ("this", 3, 3, 75.0), ("another", 2, 2, 50.0), ("text", 2, 2, 50.0)]
    assert [r[0] for r in ft[4:]] == ["a", "and", "house", "nice", "one", "really", "the", "yet"]
    assert all(r[1:] == (1, 1, 25.0) for r in ft[4:])
    assert sum(r[1] for r in ft) == 19


def test_denominator_counts_empty_documents(spark):
    docs = spark.createDataFrame([(1, "word"), (2, "!!!"), (3, None)], "doc_id long, text string")
    ft = rows(A.frequent_terms(M.dfm(clean_tokens(docs))))
    assert ft == [("word", 1, 1, 33.33)]


def test_long_and_wide(four_docs):
    d = d4(four_docs)
    assert d.long.count() == 19
    w = rows(M.to_wide(d, ["this", "house"]).orderBy("doc_id"))
    assert w == [(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 0, 1)]
    lw = rows(M.to_wide(M.to_long(d), ["this", "house"]).orderBy("doc_id"))
    assert lw == w


def test_totals_of_a_document_are_folded_once(four_docs):
    """Copied into the lambda, the total would be folded again for every term."""
    for scheme in ("relfreq", "relmaxfreq"):
        plan = M.weight(d4(four_docs), scheme).long._jdf.queryExecution().optimizedPlan().toString()
        assert "__tot" in plan


def test_weights(four_docs):
    d = d4(four_docs)
    rel = M.weight(d, "relfreq").long.groupBy("doc_id").agg(F.sum("n").alias("s"))
    assert all(abs(r["s"] - 1) < 1e-12 for r in rel.collect())
    rel_long = M.weight(M.to_long(d), "relfreq").long.groupBy("doc_id").agg(F.sum("n").alias("s"))
    assert all(abs(r["s"] - 1) < 1e-12 for r in rel_long.collect())
    tf = {r["term"]: r["n"] for r in M.weight(d, "tfidf").long.filter("doc_id = 1").collect()}
    assert tf["is"] == 0.0 and abs(tf["a"] - 0.6020599913279624) < 1e-12
    mx = M.weight(d, "relmaxfreq").long.agg(F.max("n")).collect()[0][0]
    assert mx == 1.0
    lg = M.weight(d, "logfreq").long.agg(F.min("n")).collect()[0][0]
    assert lg == 1.0


def test_trim_group_select(four_docs):
    d = d4(four_docs)
    assert sorted(r["term"] for r in M.trim_features(d, 2).long.select("term").distinct().collect()) == \
        ["another", "is", "text", "this"]
    g = M.group_documents(d, "grp")
    assert g.docs.count() == 2  # NULL group dropped
    assert rows(g.long.filter("term = 'is'").orderBy("grp"), "grp", "n") == [("a", 2), ("b", 1)]
    assert M.dfm_select(d, ["is"]).long.count() == 4


def test_top_features(four_docs):
    d = d4(four_docs)
    assert rows(A.top_features(d, 3)) == [(1, "is", 4), (2, "this", 3), (3, "another", 2)]
    assert rows(A.top_features(d, 0)).__len__() == 10  # fallback 10 for n <= 0
    g = set(rows(A.top_features(d, 1, groups="grp")))
    assert g == {("a", 1, "is", 2), ("b", 1, "another", 1), (None, 1, "house", 1)}


def test_wordcloud_and_comparison(four_docs):
    d = d4(four_docs)
    wc = rows(A.wordcloud_terms(d, 5))
    assert wc[0] == ("is", 4, 1.0, 1) and wc[1] == ("this", 3, 0.75, 2)
    cmp = A.comparison_terms(d, "grp", 3).collect()
    assert len(cmp) == 3 and cmp[0]["deviation"] >= cmp[-1]["deviation"]


def test_tfidf_of_a_trimmed_dfm_joins_no_second_time(spark):
    docs = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", "c", "c"]), (3, ["c"])], "doc_id long, tokens array<string>")
    trimmed = M.trim_features(M.dfm(docs), 2).materialize()
    assert trimmed.long.columns == ["doc_id", "term", "n"]
    out = M.weight(trimmed, "tfidf").long
    idf = 0.17609125905568124  # log10(3 / 2)
    got = {(r.doc_id, r.term): r.n for r in out.collect()}
    assert got == pytest.approx({(1, "a"): 2 * idf, (2, "a"): idf, (2, "c"): 2 * idf, (3, "c"): idf})
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_single_words_are_counted_without_the_counts_of_each_document(spark):
    docs = [(1, ["b", "a", "b", None, "b"]), (2, []), (3, None), (4, [None]), (5, ["a", "", ""]), (5, ["a"])]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    totals = M.term_totals(M.dfm(df))
    assert sorted((r.term, r.nb_terms, r.nb_docs) for r in totals.collect()) == [("", 2, 1), ("a", 3, 3), ("b", 3, 1)]
    assert "lambda" not in totals._jdf.queryExecution().optimizedPlan().toString()
