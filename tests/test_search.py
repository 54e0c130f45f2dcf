import pytest

from core_helpers import rows
from lexiflow.functions.query import parse
from lexiflow.operators import dfm as M
from lexiflow.operators import search as Q
from lexiflow.operators.tokens import clean_tokens


@pytest.fixture(scope="module")
def d4(four_docs):
    return M.dfm(clean_tokens(four_docs))


@pytest.mark.parametrize("query,docs,nb,prop", [
    ("text | one", [1, 2, 3], 3, 75.0),
    ("this & !text", [2], 1, 25.0),
    ("!this", [4], 1, 25.0),
    ("another & (one | yet)", [2, 3], 2, 50.0),
])
def test_search_goldens(d4, query, docs, nb, prop):
    hits = Q.search(d4, query)
    assert sorted(r["doc_id"] for r in hits.filter("n > 0").collect()) == docs
    assert rows(Q.search_total(hits)) == [(nb, prop)]
    long_hits = Q.search(M.to_long(d4), query)
    assert sorted(r["doc_id"] for r in long_hits.filter("n > 0").collect()) == docs


def test_counts_and_arithmetic(d4):
    h = {r["doc_id"]: r["n"] for r in Q.search(d4, "this").collect()}
    assert h == {1: 1, 2: 1, 3: 1, 4: 0}
    h = {r["doc_id"]: r["n"] for r in Q.search(d4, "is + this * 2 > 2").collect()}
    assert h == {1: 1, 2: 1, 3: 1, 4: 0}
    h = {r["doc_id"]: r["n"] for r in Q.search(d4, "THIS").collect()}
    assert h[1] == 1  # query terms lowercased like the tokens


def test_not_and_query_partition(d4):
    a = {r["doc_id"]: r["n"] for r in Q.search(d4, "text").collect()}
    b = {r["doc_id"]: r["n"] for r in Q.search(d4, "!text").collect()}
    assert all((a[k] > 0) != (b[k] > 0) for k in a)


def test_query_errors():
    for bad in ["a &", "(a | b", "a $ b", "", "a b"]:
        with pytest.raises(ValueError):
            parse(bad)


def test_missing_terms_and_strict(d4):
    assert rows(Q.missing_terms(d4, ["this", "zzz"])) == [("zzz",)]
    with pytest.raises(ValueError, match="zzz"):
        Q.search(d4, "this | zzz", strict=True)
    h = {r["doc_id"]: r["n"] for r in Q.search(d4, "this | zzz").collect()}
    assert h[1] == 1


def test_by_group_null_group_and_binary(d4):
    hits = Q.search(d4, "is")
    tab = {r["group"]: r for r in Q.search_by_group(hits, "grp").collect()}
    assert tab["a"]["freq"] == 2 and tab["a"]["nb_docs"] == 2 and tab["a"]["prop_docs"] == 100.0
    assert tab[None]["nb_docs"] == 1
    btab = Q.search_by_group(Q.search(d4, "is", binary=True), "grp", binary=True)
    assert "freq" not in btab.columns
    assert rows(Q.matched_documents_total(Q.search_by_group(hits, "grp"))) == [(4,)]
    s = rows(Q.search_series(Q.search_by_group(Q.search(d4, "text"), "grp")), "group", "order")
    assert s == [("a", 1)]


def test_paging(d4):
    hits = Q.search(d4, "is")
    assert [r["doc_id"] for r in Q.search_documents(hits, 2, 2).collect()] == [2, 3]
    pb = Q.page_bounds(Q.search_total(hits), 3, 2).collect()[0]
    assert (pb["start"], pb["end"], pb["total"], pb["label"], pb["next_start"], pb["prev_start"]) == \
        (3, 4, 4, "3 to 4 of 4", None, 1)


def test_highlight_keeps_case_single_pass(spark):
    df = spark.createDataFrame([("This is the house",)], "text string")
    out = df.select(Q.highlight_expr("text", ["this", "is", "the_house"]).alias("h")).collect()[0]["h"]
    assert out == ("<span class='highlight'>This</span> <span class='highlight'>is</span> "
                   "<span class='highlight'>the house</span>")


def test_search_kwic_and_metadata(spark, four_docs, d4):
    toks = clean_tokens(four_docs)
    hits = Q.search(d4, "another")
    kw = {r["doc_id"]: r["kwic"] for r in Q.search_kwic(toks, "another").collect()}
    kw2 = {r["doc_id"]: r["kwic"] for r in Q.search_kwic_hits(hits, toks, ["another"]).collect()}
    assert kw2 == kw
    assert kw == {2: "...this is <strong>another</strong> one...",
                  3: "...and this is yet <strong>another</strong> text..."}
    md = {(r["doc_id"], r["name"]): r["value"] for r in Q.doc_metadata(four_docs, ["grp"]).collect()}
    assert md[4, "grp"] == "NA" and md[1, "grp"] == "a"


def test_highlight_quotes_metacharacters(spark):
    df = spark.createDataFrame([("a.b axb (c) c++ c",)], "text string")
    out = df.select(Q.highlight_expr("text", ["a.b", "(c)", "c++"]).alias("h")).collect()[0]["h"]
    assert out == ("<span class='highlight'>a.b</span> axb <span class='highlight'>(c)</span> "
                   "<span class='highlight'>c++</span> c")


def test_query_words():
    from lexiflow.functions.patterns import query_words
    assert query_words("sky & (sea | ocean) & !it's") == ["sky", "sea", "ocean", "it's"]
    assert query_words("") == [] and query_words(None) == []


def test_dictionary_keys_are_searchable(spark):
    from lexiflow.options import TextOptions
    docs = spark.createDataFrame([(1, "the nation is free"), (2, "a country"), (3, "nothing")],
                                 "doc_id long, text string")
    opts = TextOptions(dictionary=(("country", ("country", "nation")),), dictionary_type="fixed")
    d = M.dfm(clean_tokens(docs, opts))
    h = dict(rows(Q.search(d, "COUNTRY").select("doc_id", "n")))
    assert h == {1: 1, 2: 1, 3: 0}
    h = dict(rows(Q.search(d, "free | Nothing").select("doc_id", "n")))
    assert h == {1: 1, 2: 0, 3: 1}


def test_strict_with_dictionary_keys(spark):
    from lexiflow.options import TextOptions
    docs = spark.createDataFrame([(1, "the nation")], "doc_id long, text string")
    d = M.dfm(clean_tokens(docs, TextOptions(dictionary=(("country", ("nation",)),), dictionary_type="fixed")))
    assert dict(rows(Q.search(d, "COUNTRY & the", strict=True).select("doc_id", "n"))) == {1: 1}
    with pytest.raises(ValueError, match="zzz"):
        Q.search(d, "COUNTRY | zzz", strict=True)


def test_weighted_search_presence_and_division(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "a")], "doc_id long, text string")
    d = M.dfm(clean_tokens(docs))
    tfidf = M.weight(d.materialize(), "tfidf")
    n = lambda x: [r["n"] for r in x.orderBy("doc_id").collect()]
    assert n(Q.search(tfidf, "a", binary=True)) == [0, 0, 0]       # in every document: weight 0
    assert n(Q.search(tfidf, "b", binary=True)) == [1, 0, 0]
    assert [round(x, 3) for x in n(Q.search(M.weight(d, "relfreq"), "b"))] == [0.667, 0.0, 0.0]
    assert n(Q.search(d, "b / a > 1")) == [1, 0, 0]
    assert n(Q.search(d, "a / c")) == [float("inf"), 1.0, float("inf")]
    assert n(Q.search(d, "b / c")) == [float("inf"), 0.0, None]
