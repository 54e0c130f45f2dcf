import random

import pytest
from core_helpers import rows

from lexiflow.operators.dictionary_index import dictionary_lookup_indexed, dictionary_table, lookup_matches
from lexiflow.operators.tokens import dictionary_lookup

DICTIONARIES = {
    "fixed": [("one", ["abc", "Ab", "zz"]), ("two", ["a b", "a b c", "b", "abc"]), ("three", ["c c", "c"]), ("four", [" ", ""])],
    "glob": [("heads", ["ab*", "b?"]), ("tails", ["*c", "*bc"]), ("middle", ["*b*", "a*c"]), ("size", ["??", "???"]),
             ("words", ["a* b*", "b* * c", "?? a"]), ("all", ["zz*"]), ("odd", ["a.c", "(*", "a+*"])],
    "regex": [("start", ["^a"]), ("some", ["b|cc$", "^.$"]), ("words", ["^a b$", "c .c"])],
}


@pytest.fixture(scope="module")
def tokens(spark):
    rnd = random.Random(3)
    vocabulary = ["a", "b", "c", "ab", "abc", "Abc", "bc", "cc", "aXc", "a.c", "(x", "a+b", "zz", "ünï"]
    docs = [(i, "x", [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))]) for i in range(60)]
    docs += [(100, "x", []), (102, "x", ["c"] * 50), (103, "x", ["a", "b"] * 30)]
    return spark.createDataFrame(docs, "doc_id long, pos string, tokens array<string>").repartition(3)


@pytest.mark.parametrize("valuetype", ["fixed", "glob", "regex"])
def test_index_gives_the_rows_of_the_expressions(spark, tokens, valuetype):
    dictionary = DICTIONARIES[valuetype]
    want = sorted(rows(dictionary_lookup(tokens, dictionary, valuetype)), key=repr)
    assert sorted(rows(dictionary_lookup_indexed(tokens, dictionary, valuetype)), key=repr) == want
    table = dictionary_table(spark, dictionary)
    assert sorted(rows(dictionary_lookup_indexed(tokens, table, valuetype)), key=repr) == want


def test_empty_dictionary_changes_nothing(tokens):
    assert sorted(rows(dictionary_lookup_indexed(tokens, [])), key=repr) == sorted(rows(tokens), key=repr)


def test_ten_thousand_values(spark, tokens):
    """Cost does not follow the number of patterns: the same call with the
    values of a small dictionary hidden among ten thousand others."""
    small = DICTIONARIES["fixed"]
    large = [(k, [*v, *(f"filler{k}{i} x" if i % 2 else f"filler{k}{i}" for i in range(2500))]) for k, v in small]
    want = sorted(rows(dictionary_lookup(tokens, small, "fixed")), key=repr)
    assert sorted(rows(dictionary_lookup_indexed(tokens, large, "fixed")), key=repr) == want


def test_values_of_one_beginning_share_its_rows(spark):
    """200 documents of 200 times "the", and 4,000 values "the x...": 40,000
    positions; matching each with all 4,000 values made 160 million rows."""
    docs = spark.range(200).selectExpr("id AS doc_id", "array_repeat('the', 200) AS tokens")
    values = [("k", [f"the x{i}" for i in range(4000)]), ("both", ["the the"])]
    matches = lookup_matches(docs, dictionary_table(spark, values), "fixed")
    rows_made = {"n": 0}

    def count(node):
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined() and "Join" in node.nodeName():
            rows_made["n"] = max(rows_made["n"], metric.get().value())
        children = node.children()
        for i in range(children.size()):
            count(children.apply(i))
        if node.nodeName() == "AdaptiveSparkPlan":
            count(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            count(node.plan())

    assert len(matches.collect()) == 200 * 199
    count(matches._jdf.queryExecution().executedPlan())
    assert 0 < rows_made["n"] <= 40_000


def test_unknown_valuetype(tokens):
    with pytest.raises(ValueError):
        dictionary_lookup_indexed(tokens, [("a", ["b"])], "soundex")


def test_only_positions_that_may_match_are_shuffled(spark):
    """Ten matching terms among 40,000 positions. Without a broadcast, every
    position went through the shuffle of the join."""
    docs = spark.range(200).selectExpr("id AS doc_id", "transform(sequence(1, 200), i -> "
                                       "if(i = id, 'hit' || id % 10, 'word' || (i * 200 + id))) AS tokens")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    most = {"n": 0}

    def count(node):
        metric = node.metrics().get("shuffleRecordsWritten")
        if metric.isDefined():
            most["n"] = max(most["n"], metric.get().value())
        children = node.children()
        for i in range(children.size()):
            count(children.apply(i))
        if node.nodeName() == "AdaptiveSparkPlan":
            count(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            count(node.plan())
    try:
        matches = lookup_matches(docs, dictionary_table(spark, [("k", ["^hit"])]), "regex")
        assert len(matches.collect()) == 199
        count(matches._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 0 < most["n"] <= 400


def test_tokens_come_back_as_they_were(spark):
    """Tokens travel as one text; those that it could not hold stay an array."""
    docs = [(1, ["a", None, "b"]), (2, ["a\u0001b", "a"]), (3, []), (4, [""]), (5, ["", ""]), (6, None), (7, [None]),
            (8, ["a", "", "b", "x"]), (9, ["a\u0001", None, "c"])]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    out = {r.doc_id: r.tokens for r in dictionary_lookup_indexed(df, [("key", ["b", "a x"])], "fixed").collect()}
    want = {i: t and [("KEY" if w == "b" else w) for w in t] for i, t in docs}
    assert out == want
