import pytest
from pyspark.sql import functions as F

from lexiflow.operators.tokens import (clean_tokens, corpus_remove_words, dictionary_lookup,
                                       ngrams_expr, remove_stopwords_expr, tokenize)
from lexiflow.options import RAW, TextOptions


def toks(spark, text, opts=TextOptions()):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return tokenize(df, opts).collect()[0]["tokens"]


def test_default_cleaning(spark):
    t = toks(spark, "Hello, wörld! #tag 3.5 and 2day well-known it's https://a.b/c x @me 1,000 €")
    assert t == ["hello", "wörld", "#tag", "and", "2day", "well", "known", "it's", "x", "@me"]


def test_switches(spark):
    text = "Well-known #tag 42 https://x.org/y ok."
    assert toks(spark, text, TextOptions(remove_hyphens=False)) == ["well-known", "#tag", "ok"]
    assert toks(spark, text, TextOptions(remove_twitter=True)) == ["well", "known", "tag", "ok"]
    assert toks(spark, text, TextOptions(remove_numbers=False)) == ["well", "known", "#tag", "42", "ok"]
    assert toks(spark, text, TextOptions(remove_url=False)) == ["well", "known", "#tag", "https://x.org/y", "ok"]
    assert toks(spark, text, RAW) == ["Well-known", "#tag", "42", "https://x.org/y", "ok", "."]


def test_twitter_forced_off_without_punct_removal():
    assert TextOptions(remove_twitter=True, remove_punct=False).remove_twitter is False


def test_combining_accents_and_edges(spark):
    assert toks(spark, "café naïve") == ["café", "naïve"]
    assert toks(spark, "") == []
    assert toks(spark, None) == []
    assert toks(spark, "... !!! 123") == []


def test_ngrams_and_short_docs(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, [])], "doc_id long, tokens array<string>")
    out = df.select("doc_id", ngrams_expr("tokens", (1, 2)).alias("g")).orderBy("doc_id").collect()
    assert [r["g"] for r in out] == [["a", "b", "c", "a_b", "b_c"], ["x"], []]
    out = df.select(ngrams_expr("tokens", (3,)).alias("g")).collect()
    assert sorted(len(r["g"]) for r in out) == [0, 0, 1]


def test_fixture_bigrams(spark, four_docs):
    t = clean_tokens(four_docs, TextOptions(ngrams=(2,))).orderBy("doc_id")
    assert [r["tokens"] for r in t.collect()] == [
        ["this_is", "is_a", "a_text"], ["this_is", "is_another", "another_one"],
        ["and_this", "this_is", "is_yet", "yet_another", "another_text"],
        ["the_house", "house_is", "is_really", "really_nice"]]


def test_stopwords_remove_all_copies(spark):
    df = spark.createDataFrame([(1, ["the", "cat", "The", "the", "dog"])], "doc_id long, tokens array<string>")
    out = df.select(remove_stopwords_expr("tokens", ["the", "the", ""]).alias("t")).collect()[0]["t"]
    assert out == ["cat", "dog"]


def _lookup(spark, tokens, d, vt="glob"):
    df = spark.createDataFrame([(1, tokens)], "doc_id long, tokens array<string>")
    return dictionary_lookup(df, d, vt).collect()[0]["tokens"]


def test_dictionary_single_word(spark):
    d = {"country": ["country", "nation", "governement"], "freedom": ["free*"]}
    assert _lookup(spark, ["the", "nation", "is", "freely", "free", "Country"], d) == \
        ["the", "COUNTRY", "is", "FREEDOM", "FREEDOM", "COUNTRY"]
    # a token matched by two keys yields both, in key order
    assert _lookup(spark, ["of", "x"], [("f", ["*f"]), ("two", ["??"])]) == ["F", "TWO", "x"]
    # fixed patterns keep metacharacters literal
    assert _lookup(spark, ["a.b", "axb"], {"k": ["a.b"]}, "fixed") == ["K", "axb"]
    assert _lookup(spark, ["a.b", "axb"], {"k": ["a.b"]}, "regex") == ["K", "K"]
    assert _lookup(spark, ["a+b", "ab"], {"k": ["a+b"]}, "glob") == ["K", "ab"]


def test_dictionary_multiword_leftmost_longest(spark):
    d = [("us", ["united states", "united"]), ("st", ["states of america"])]
    out = _lookup(spark, ["the", "united", "states", "of", "america", "united"], d, "fixed")
    # US takes [2,3]; ST takes [3,5] independently; position 3 starts ST
    assert out == ["the", "US", "ST", "US"]
    d2 = [("ab", ["a b"])]
    assert _lookup(spark, ["a", "b", "b", "a", "b", "a"], d2, "fixed") == ["AB", "b", "AB", "a"]


def test_corpus_remove_words(spark):
    df = spark.createDataFrame([(1, "The cat, the other; thereof THE.")], "doc_id long, text string")
    out = corpus_remove_words(df, ["the"]).collect()[0]["text"]
    assert out == " cat,  other; thereof ."


def test_tokens_array_not_recomputed_by_filters(spark, four_docs):
    from lexiflow.operators.dfm import dfm
    d = dfm(clean_tokens(four_docs, TextOptions(ngrams=(1, 2))))
    plan = d.long.filter(F.col("n") > 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def _brute_lookup(tokens, entries):
    """Greedy leftmost-longest per key, keys replace spans at their start."""
    n = len(tokens)
    starts, covered = [set() for _ in entries], set()
    for k, (_, vals) in enumerate(entries):
        seqs = sorted((v.split() for v in vals), key=len, reverse=True)
        last = 0
        for i in range(1, n + 1):
            ln = next((len(s) for s in seqs if tokens[i - 1:i - 1 + len(s)] == s), 0)
            if ln and i > last:
                starts[k].add(i)
                covered.update(range(i, i + ln))
                last = i + ln - 1
    out = []
    for i in range(1, n + 1):
        here = [key.upper() for k, (key, _) in enumerate(entries) if i in starts[k]]
        out.extend(here if i in covered else [tokens[i - 1]])
    return out


def test_dictionary_multiword_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    entries = [("ab", ["a b", "a"]), ("bb", ["b b", "b c a"]), ("c", ["c"])]
    docs = [[rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(60)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, tokens array<string>")
    got = {r["doc_id"]: r["tokens"] for r in dictionary_lookup(df, entries, "fixed").collect()}
    for i, d in enumerate(docs):
        assert got[i] == _brute_lookup(d, entries), d


def test_folded_pattern_equals_filtered_form(spark):
    from lexiflow.operators.tokens import tokens_expr, tokens_expr_filtered
    texts = ["12 1.5 2day 12'3 7-8 x-9 9x 1. ,5 4,000.25 https://a.b 3'a 3’ 42- ٣٤ _1 1_",
             "a-1 1-a 3rd 1,000 http://x.y/z?q=1 end 12's", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for opts in (TextOptions(), TextOptions(remove_hyphens=False), TextOptions(remove_url=False),
                 TextOptions(remove_numbers=False), TextOptions(remove_twitter=True),
                 TextOptions(remove_punct=False, remove_symbols=False, lowercase=False)):
        got = df.select(tokens_expr("text", opts).alias("a"), tokens_expr_filtered("text", opts).alias("b"))
        for r in got.collect():
            assert r["a"] == r["b"], (opts, r)


@pytest.mark.parametrize("unit, opts", [
    ("a'", TextOptions()), ("1.", TextOptions(remove_numbers=False)), ("1.", TextOptions()), ("a-", RAW),
    ("_a", TextOptions()), ("1a'", RAW), ("#a", TextOptions()), ("9", TextOptions())])
def test_long_runs_do_not_overflow_the_stack(spark, unit, opts):
    """Texts of a megabyte made of one repeated part, split as short ones are."""
    many = 1_000_000 // len(unit)
    df = spark.createDataFrame([(1, unit * 20 + "z"), (2, unit * many + "z")], "doc_id long, text string")
    short, long = (r.tokens for r in tokenize(df, opts).orderBy("doc_id").collect())
    assert "".join(long) == "".join(short).replace(unit * 19, unit * (many - 1))
