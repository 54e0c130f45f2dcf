from core_helpers import rows
from lexiflow.operators import parsed as P
from lexiflow.sources.corpus import replace_texts
from lexiflow.sources.lexicon import (dictionary_from_lines, dictionary_from_text, dictionary_to_lines,
                                      lines_df, stopword_list)
from lexiflow.sources.parsed import parsed_tokens

import pytest


@pytest.fixture(scope="module")
def p3(parsed3):
    return parsed_tokens(parsed3, layout="udpipe", order_col="token_id")


def test_layouts(parsed3):
    with pytest.raises(ValueError):
        parsed_tokens(parsed3, layout="spacy", order_col="token_id")


def test_token_context_golden(p3):
    ctx = {(r["doc_id"], r["token_pos"]): r["context"] for r in P.token_context(p3).collect()}
    assert ctx[(1, 1)] == "  The dog is"
    assert ctx[(1, 2)] == " The dog is in"
    assert ctx[(1, 3)] == "The dog is in the"
    assert ctx[(1, 6)] == "in the kitchen . "
    assert ctx[(1, 7)] == "the kitchen .  "
    assert ctx[(2, 1)] == "  No  "
    assert ctx[(3, 5)] == "is sleeping !  "


def test_pos_counts_golden(p3):
    assert rows(P.pos_counts(p3), "pos", "n") == [("ADP", 1), ("INTJ", 1), ("VERB", 1), ("AUX", 2),
                                                 ("PUNCT", 2), ("DET", 3), ("NOUN", 3)]
    assert rows(P.pos_counts(p3), "label")[-1] == ("NOUN (n=3)",)


def test_rebuild_and_replace(spark, p3):
    keep = P.keep_pos(["INTJ", "PUNCT"])
    rb = dict(rows(P.rebuild_texts(p3, keep)))
    assert rb == {1: "The dog is in the kitchen", 2: "", 3: "The cat is sleeping"}
    lem = dict(rows(P.rebuild_texts(p3, keep, column="lemma")))
    assert lem[3] == "the cat be sleep"
    assert dict(rows(P.rebuild_texts(p3)))[2] == "No"
    corpus = spark.createDataFrame([(1, "x", "a"), (2, "y", "b"), (3, "z", "c")], "doc_id long, text string, v string")
    out = {r["doc_id"]: r["text"] for r in replace_texts(corpus, P.rebuild_texts(p3, keep)).collect()}
    assert out[2] == "" and out[1] == "The dog is in the kitchen"


def test_frequent_lemmas(p3):
    fl = {r["term"]: r for r in P.frequent_lemmas(p3, P.keep_pos(["PUNCT", "INTJ"])).collect()}
    assert fl["the"]["nb_terms"] == 3 and fl["the"]["nb_docs"] == 2 and fl["the"]["prop_docs"] == 66.67
    assert "." not in fl and "no" not in fl
    ft = {r["term"]: r for r in P.frequent_lemmas(p3, unit="token").collect()}
    assert ft["the"]["nb_docs"] == 3 and ft["the"]["prop_docs"] == round(3 / 13 * 100, 2)


def test_dictionary_text_rules(spark):
    text = "\n".join(["country = country, nation,  governement", "", "  no equals here",
                      "empty =", " = nokey", "free = free*", "eq = a = b, c", "country = land"])
    d = dictionary_from_text(spark, text)
    assert d == [("country", ["land"]), ("free", ["free*"]), ("eq", ["a = b", "c"])]
    lines = rows(dictionary_to_lines(dictionary_from_lines(lines_df(spark, text))).orderBy("line_no"), "line")
    assert lines == [("country = land",), ("free = free*",), ("eq = a = b, c",)]


def test_stopwords_text(spark):
    assert stopword_list(spark, "the, a ,an,of") == ["the", "a", "an", "of"]


def test_token_context_buckets_match_one_window(spark):
    import random
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window
    rnd = random.Random(3)
    data, pos = [], 0
    for d in range(1, 6):
        for _ in range(rnd.randint(0, 40)):
            pos += rnd.choice([1, 1, 1, 2, 9])
            data.append((d, pos, f"t{rnd.randint(0, 9)}", "x", "NOUN"))
    p = spark.createDataFrame(data, "doc_id long, token_pos long, token string, lemma string, pos string")
    w = Window.partitionBy("doc_id").orderBy("token_pos")
    ref = p.select("doc_id", "token_pos", F.concat_ws(
        " ", F.lag("token", 2, "").over(w), F.lag("token", 1, "").over(w), "token",
        F.lead("token", 1, "").over(w), F.lead("token", 2, "").over(w)).alias("context"))
    want = {(r[0], r[1]): r[2] for r in ref.collect()}
    for b in (1, 2, 3, 7, 1000):
        got = {(r["doc_id"], r["token_pos"]): r["context"] for r in P.token_context(p, bucket=b).collect()}
        assert got == want, b


def test_rebuild_texts_buckets(spark, p3):
    keep = P.keep_pos(["PUNCT"])
    want = dict(rows(P.rebuild_texts(p3, keep)))
    for b in (1, 2, 3):
        assert dict(rows(P.rebuild_texts(p3, keep, bucket=b))) == want
    assert dict(rows(P.rebuild_texts(p3, P.keep_pos(["INTJ"]), bucket=1)))[2] == ""
