import math
import random
from collections import Counter

import pytest
from core_helpers import rows

from lexiflow.operators import collocations as C
from lexiflow.operators.spans import chosen_marks, sparse_lengths
from lexiflow.operators.tokens import tokenize
from lexiflow.options import TextOptions
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def token_docs():
    rnd = random.Random(4)
    docs = [(i, [rnd.choice(["new", "york", "city", "of", "the", "a"]) for _ in range(rnd.randint(0, 30))]) for i in range(40)]
    return docs + [(100, []), (101, ["new"]), (102, ["new", "york"] * 400), (103, None)]


@pytest.fixture(scope="module")
def tokens(spark, token_docs):
    return spark.createDataFrame(token_docs, "doc_id long, tokens array<string>").repartition(3)


def brute_collocations(docs, size, min_count):
    grams, holders = Counter(), {}
    for doc, toks in docs:
        toks = toks or []
        for i in range(len(toks) - size + 1):
            g = tuple(toks[i:i + size])
            grams[g] += 1
            holders.setdefault(g, set()).add(doc)
    total = sum(grams.values())
    out = {}
    for g, n in grams.items():
        if n < min_count:
            continue
        joints = []
        for cut in range(1, size):
            left = sum(c for h, c in grams.items() if h[:cut] == g[:cut])
            right = sum(c for h, c in grams.items() if h[cut:] == g[cut:])
            table = [(n, left * right), (left - n, left * (total - right)), (right - n, (total - left) * right),
                     (total - left - right + n, (total - left) * (total - right))]
            g2 = 2 * sum(o * math.log(o * total / e) for o, e in table if o > 0)
            joints.append((math.log2(n * total / (left * right)), g2 if n * total >= left * right else -g2))
        pmi, g2 = min(joints)
        out[" ".join(g)] = (size, n, len(holders[g]), g2, pmi)
    return out


def test_collocations_equal_brute_force(tokens, token_docs):
    got = C.collocations(tokens, (2, 3), 3).collect()
    want = {**brute_collocations(token_docs, 2, 3), **brute_collocations(token_docs, 3, 3)}
    assert {r.expression for r in got} == set(want)
    for r in got:
        size, n, nb, g2, pmi = want[r.expression]
        assert (r.size, r.n, r.nb_docs) == (size, n, nb)
        assert r.g2 == pytest.approx(g2, abs=1e-3) and r.pmi == pytest.approx(pmi, abs=1e-3)


def test_proper_nouns_keep_tables_of_all(spark):
    docs = spark.createDataFrame([(1, "Marie Curie met Marie Curie in Paris."), (2, "in Paris Marie Curie")],
                                 "doc_id long, text string")
    toks = tokenize(docs, TextOptions(lowercase=False))
    got = {r.expression: r for r in C.collocations(toks, (2,), 1, proper_nouns=True).collect()}
    assert set(got) == {"Marie Curie", "Paris Marie"}
    assert got["Marie Curie"].n == 3 and got["Marie Curie"].nb_docs == 2
    # all bigrams count: 8 of them, Marie first in 3, Curie second in 3
    assert got["Marie Curie"].pmi == pytest.approx(math.log2(3 * 9 / 9), abs=0.5)


def compounded(tokens, expressions, longest):
    out, i = [], 0
    while i < len(tokens):
        for size in range(longest, 1, -1):
            if i + size <= len(tokens) and " ".join(tokens[i:i + size]) in expressions:
                out.append("_".join(tokens[i:i + size]))
                i += size
                break
        else:
            out.append(tokens[i])
            i += 1
    return out


EXPRESSIONS = ["new york", "new york city", "york city of", "of the", "the the the the", "a"]


@pytest.mark.parametrize("literal", [5_000, 0])
def test_compound_equals_brute_force(spark, monkeypatch, tokens, token_docs, literal):
    """In the row, and by the join (no expression is literal)."""
    monkeypatch.setattr(C, "LITERAL_EXPRESSIONS", literal)
    want = {d: None if t is None else compounded(t, set(EXPRESSIONS), 4) for d, t in token_docs}
    listed = C.compound_tokens(tokens, EXPRESSIONS)
    table = C.compound_tokens(tokens, spark.createDataFrame([(e,) for e in EXPRESSIONS], "expression string"))
    for out in (listed, table):
        got = {r.doc_id: r.tokens for r in out.collect()}
        assert {d: t or [] for d, t in got.items()} == {d: t or [] for d, t in want.items()}
    assert C.compound_tokens(tokens, []).columns == tokens.columns


def test_expressions_as_word_lists_and_no_match(tokens, token_docs):
    out = C.compound_tokens(tokens, [["of", "the"], ["nothing", "here"]], sep="+")
    got = {r.doc_id: r.tokens for r in out.collect()}
    for d, t in token_docs:
        assert (got[d] or []) == [w.replace("_", "+") for w in compounded(t or [], {"of the"}, 2)]


def test_marks_are_linear_on_long_arrays(spark):
    df = spark.range(1).select(F.array_repeat(F.lit("2"), 400_000).alias("l"))
    marks = df.select(chosen_marks(F.array_join("l", ""), 5).alias("m")).select(F.size("m"), F.element_at("m", 2)).first()
    assert tuple(marks) == (400_000, "_")


def test_sparse_lengths(spark):
    df = spark.createDataFrame([([(2, 2), (5, 3)], 8), ([], 3)], "m array<struct<pos:int,len:int>>, n int")
    assert rows(df.select(sparse_lengths(F.col("m"), F.col("n")).alias("s"))) == [("02003000",), ("000",)]
