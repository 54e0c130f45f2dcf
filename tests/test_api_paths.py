import datetime as dt
import os
import tempfile

from core_helpers import rows
from lexiflow.operators import dfm as M
from lexiflow.operators import search as Q
from lexiflow.operators import stats as A
from lexiflow.operators.table_view import table_filter
from lexiflow.operators.tokens import clean_tokens
from lexiflow.plans.chain import explore
from lexiflow.options import TextOptions
from lexiflow.sources.corpus import cast_docvars, corpus, raw_of, read_corpus, with_raw


def test_dfm_from_wide_and_long(spark):
    wide = spark.createDataFrame([(1, 2, 0), (2, 0, 1), (3, 0, 0)], "doc_id long, cat long, dog long")
    d = M.dfm_from_wide(wide)
    assert sorted(rows(d.long)) == [(1, "cat", 2), (2, "dog", 1)]
    assert rows(A.frequent_terms(d)) == [("cat", 2, 1, 33.33), ("dog", 1, 1, 33.33)]
    h = dict(rows(Q.search(d, "!cat").select("doc_id", "n")))
    assert h == {1: 0, 2: 1, 3: 1}
    hb = dict(rows(Q.search(d, "cat", binary=True).select("doc_id", "n")))
    assert hb == {1: 1, 2: 0, 3: 0}
    w = {r["term"]: r["n"] for r in M.weight(d, "relmaxfreq").long.collect()}
    assert w == {"cat": 1.0, "dog": 1.0}
    lg = {r["term"]: round(r["n"], 6) for r in M.weight(d, "logfreq").long.collect()}
    assert lg == {"cat": round(1 + 0.3010299956639812, 6), "dog": 1.0}


def test_readers_and_casts(spark):
    base = tempfile.mkdtemp(prefix="lexiflow-read-")
    js = os.path.join(base, "c.json")
    spark.createDataFrame([(1, "A b", "2024-01-02", "3.5"), (2, "c", "bad", "x")],
                          "id long, body string, day string, score string").write.json(js)
    c = read_corpus(spark, js, "json", id_col="id", text_col="body")
    assert sorted(c.columns) == ["day", "doc_id", "score", "text"]
    typed = cast_docvars(c, {"day": "date", "score": "double"})
    got = {r["doc_id"]: (r["day"], r["score"]) for r in typed.collect()}
    assert got == {1: (dt.date(2024, 1, 2), 3.5), 2: (None, None)}
    txt = os.path.join(base, "t.txt")
    with open(txt, "w") as fh:
        fh.write("first line\nsecond line\n")
    t = read_corpus(spark, txt, "text")
    assert sorted(r["text"] for r in t.collect()) == ["first line", "second line"]


def test_raw_corpus_joins(spark, four_docs):
    clean = corpus(four_docs.filter("doc_id <= 2"), spread_scan=False)
    raw = four_docs.selectExpr("doc_id", "upper(text) AS text")
    wr = dict(rows(with_raw(clean, raw).select("doc_id", "raw_text")))
    assert wr == {1: "THIS IS A TEXT.", 2: "THIS IS ANOTHER ONE."}
    assert sorted(r["doc_id"] for r in raw_of(clean, raw).collect()) == [1, 2]


def test_table_filter_and_chain(spark, four_docs):
    df = spark.createDataFrame([("a", 1), ("b", 5), ("ab", 9)], "t string, n long")
    assert rows(table_filter(df, filters={"n": (2, 9), "t": "b"})) == [("b", 5), ("ab", 9)]
    assert rows(table_filter(df, filters={"t": ["a"]})) == [("a", 1)]
    v = explore(four_docs, TextOptions(min_termfreq=2), filters={"grp": ["a", "NA"]})
    assert sorted(r["term"] for r in A.frequent_terms(v.dfm).collect()) == ["is", "text", "this"]
    assert v.corpus.count() == 3


def test_grouped_long_paths(four_docs):
    d = M.dfm(clean_tokens(four_docs))
    g = M.group_documents(M.to_long(d), "grp")
    assert rows(g.long.filter("term = 'is'").orderBy("grp"), "grp", "n") == [("a", 2), ("b", 1)]
    top = set(rows(A.top_features(M.to_long(d), 1, groups="grp")))
    assert top == {("a", 1, "is", 2), ("b", 1, "another", 1), (None, 1, "house", 1)}
    wide = rows(M.to_wide(M.presence(M.to_long(d)), ["is"]).orderBy("doc_id"))
    assert wide == [(1, 1), (2, 1), (3, 1), (4, 1)]
