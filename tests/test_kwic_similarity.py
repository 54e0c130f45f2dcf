import math

from core_helpers import rows
from lexiflow.operators import dfm as M
from lexiflow.operators import kwic as K
from lexiflow.operators import similarity as H
from lexiflow.operators.tokens import clean_tokens, raw_tokens


def test_kwic_golden(four_docs):
    kw = rows(K.kwic(clean_tokens(four_docs), ["another"]).orderBy("doc_id"))
    assert kw == [(2, 3, 3, "this is", "another", "one"), (3, 5, 5, "and this is yet", "another", "text")]


def test_kwic_raw_phrase_window_and_table(spark):
    docs = spark.createDataFrame([(1, "A b c. Of the world, of THE end of the")], "doc_id long, text string")
    kw = rows(K.kwic(raw_tokens(docs), phrase="of the", window=2).orderBy("from"))
    assert kw == [(1, 5, 6, "c .", "Of the", "world ,"), (1, 9, 10, "world ,", "of THE", "end of"),
                  (1, 12, 13, "THE end", "of the", "")]
    t = rows(K.kwic_table(K.kwic(raw_tokens(docs), ["end"], window=1)))
    assert t == [(1, 11, 11, "THE <strong>end</strong> of")]


def test_positions_and_summary(spark):
    docs = spark.createDataFrame([(i, "x y z x") for i in range(1, 6)], "doc_id long, text string")
    toks = raw_tokens(docs)
    pos = K.term_positions(toks, ["x"], max_docs=3)
    assert sorted(set(r["doc_id"] for r in pos.collect())) == [1, 2, 3]
    assert sorted(r["rel_pos"] for r in pos.filter("doc_id = 1").collect()) == [0.25, 1.0]
    s = K.kwic_summary(K.kwic(toks, ["x"]), max_docs=3).collect()[0]
    assert (s["nb_docs"], s["nb_hits"], s["truncated"]) == (5, 10, True)


def test_similarity_goldens(four_docs):
    d = M.dfm(clean_tokens(four_docs))
    corr = {r["term"]: r for r in H.term_similarity(d, "this", "correlation").collect()}
    assert corr["this"]["similarity"] == 1.0 and corr["this"]["nb_docs_common"] == 3
    assert corr["text"]["similarity"] == 0.5774 and corr["another"]["simple_matching"] == 0.75
    assert corr["a"]["similarity"] == 0.3333 and corr["a"]["simple_matching"] == 0.5
    assert corr["is"]["similarity"] is None
    assert corr["house"]["similarity"] == -1.0 and corr["house"]["nb_docs_common"] == 0
    cos = {r["term"]: r["similarity"] for r in H.term_similarity(d, "this", "cosine").collect()}
    assert cos["text"] == 0.8165 and cos["a"] == 0.5774 and cos["is"] == 0.866 and cos["house"] == 0.0
    jac = {r["term"]: r["similarity"] for r in H.term_similarity(d, "this", "jaccard").collect()}
    assert jac["text"] == 0.6667 and jac["a"] == 0.3333 and jac["is"] == 0.75 and jac["house"] == 0.0
    # the long path agrees with the nested one
    lcorr = {r["term"]: r["similarity"] for r in H.term_similarity(M.to_long(d), "this").collect()}
    assert lcorr == {k: v["similarity"] for k, v in corr.items()}
    assert H.term_similarity(d, "absent").count() == 0
    assert rows(H.cooccurring_docs(d, "this").filter("term = 'is'")) == [("is", 3)]


def test_similarity_on_weighted(four_docs):
    d = M.weight(M.dfm(clean_tokens(four_docs)), "relfreq")
    cos = {r["term"]: r["similarity"] for r in H.term_similarity(d, "this", "cosine").collect()}
    assert math.isclose(cos["this"], 1.0)


def test_similarity_with_zero_weights(four_docs):
    d = M.weight(M.dfm(clean_tokens(four_docs)), "tfidf")  # 'is' is in every document: weight 0
    cos = {r["term"]: r["similarity"] for r in H.term_similarity(d, "is", "cosine").collect()}
    corr = {r["term"]: r["similarity"] for r in H.term_similarity(d, "is", "correlation").collect()}
    assert cos["is"] is None and corr["this"] is None
