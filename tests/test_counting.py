import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexiflow.operators import collocations as C
from lexiflow.operators import counting as G
from lexiflow.operators import networks as N
from lexiflow.operators.dfm import dfm, term_totals


def lists(rnd, words, docs=40, longest=14):
    return [None if rnd.random() < 0.05 else [rnd.choice(words) for _ in range(rnd.randint(0, longest))] for _ in range(docs)]


def grams(row, sizes, sep):
    # as concat_ws: a null is left out
    return [sep.join(w for w in row[i:i + k] if w is not None) if k > 1 else row[i]
            for k in sizes for i in range(len(row) - k + 1)]


def batches(docs, rows=7):
    return [pa.record_batch({"tokens": pa.array(docs[i:i + rows], pa.list_(pa.string()))}) for i in range(0, len(docs), rows)]


@pytest.mark.parametrize("words", [["a", "b", "é", "c'd"], ["a", "b", "a_b", "_", "", None]])
@pytest.mark.parametrize("sizes", [(1, 2), (1, 3, 5)])
@pytest.mark.parametrize("most", [1, 30, 10_000])
def test_grams_of_pieces(words, sizes, most):
    """Also where different words join to one text."""
    docs = lists(random.Random(5), words)
    want_n, want_docs = Counter(), Counter()
    for row in docs:
        own = Counter(g for g in grams(row or [], sizes, "_") if g is not None)
        want_n.update(own)
        want_docs.update(own.keys())
    n, nb_docs = Counter(), Counter()
    for words_, counts in G._pieces(iter(batches(docs)), most):
        for out in G._grams_of_piece(words_, counts, sizes, "_"):
            for r in out.to_pylist():
                n[r["term"]] += r["n"]
                nb_docs[r["term"]] += r["nb_docs"]
    assert n == want_n and nb_docs == want_docs


@pytest.mark.parametrize("words", [["a", "b", "c"], ["a", "b c", None, "c"]])
def test_parts_of_pieces(words):
    docs, sizes = lists(random.Random(6), words), (2, 3)
    own, left, right, held, total = Counter(), Counter(), Counter(), Counter(), Counter()
    for row in docs:
        found = Counter(g for g in grams(row or [], sizes, " ") if g.count(" ") + 1 in sizes)
        for g, n in found.items():
            parts = g.split(" ")
            own[g, len(parts)] += n
            held[g, len(parts)] += 1
            total[None, len(parts)] += n
            for cut in range(1, len(parts)):
                left[" ".join(parts[:cut]), cut, len(parts)] += n
                right[" ".join(parts[cut:]), len(parts) - cut, len(parts)] += n
    got = {c: Counter() for c in ("n", "nb_docs", "l2", "r2", "l3", "r3")}
    for words_, counts in G._pieces(iter(batches(docs)), 20):
        for out in G._parts_of_piece(words_, counts, sizes, " "):
            for r in out.to_pylist():
                for c in got:
                    got[c][r["term"], r["size"]] += r[c]
    got = {c: {k: n for k, n in v.items() if n} for c, v in got.items()}
    assert got["n"] == {**own, **total} and got["nb_docs"] == held
    for k in sizes:
        assert got[f"l{k}"] == {(t, s): n for (t, s, of), n in left.items() if of == k}
        assert got[f"r{k}"] == {(t, s): n for (t, s, of), n in right.items() if of == k}


def test_ngram_totals_need_no_counts_in_the_row(spark):
    docs = [(i, row) for i, row in enumerate(lists(random.Random(7), ["a", "b", "a_b", "c"]))]
    tokens = spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(3)
    d = dfm(tokens, ngrams=(1, 2))
    got = {r.term: (r.nb_terms, r.nb_docs) for r in term_totals(d).collect()}
    plain = d.long.collect()
    want = {t: (sum(r.n for r in plain if r.term == t), sum(r.term == t for r in plain)) for t in {r.term for r in plain}}
    assert got == want
    assert "ArraySort" not in (plan := term_totals(d)._jdf.queryExecution().toString()) and "sort_array" not in plan


def test_filter_holds_what_it_was_made_of(spark):
    known = [["of", "the"], ["the"], ["é", "ü", "ß"], ["z"] * 30]
    bits = G.filter_of(spark.createDataFrame([(k,) for k in [*known, [None]]], "words array<string>"), "words")
    for words in known:
        place = 0
        for h in G._word_hashes(pa.array(words)):
            place = (place * G.FACTOR + h) % G.FILTER_BITS
        assert G._passed(bits, G.np.array([place]))[0]
    assert G.np.unpackbits(bits).sum() == len(known)


def test_rare_terms_make_no_pairs(spark, monkeypatch):
    """Terms below min_termfreq never reach the shuffle of pairs."""
    docs = [(i, ["x", "y", f"rare{i}"]) for i in range(12)]
    tokens = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    seen = []
    monkeypatch.setattr(N, "pair_totals", lambda *a, **k: seen.append(G.pair_totals(*a, **k)) or seen[-1])
    got = N.cooccurrence_edges(tokens, 2, min_termfreq=5).collect()
    assert [(r.term_a, r.term_b, r.n) for r in got] == [("x", "y", 12)]
    assert [r.term for r in seen[0].collect()] == ["x y"]


def test_collocations_store_only_what_is_found_often(spark, monkeypatch):
    docs = [(i, ["of", "the", f"only{i}"]) for i in range(9)]
    tokens = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    stored, real = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: stored.append(real(df)) or stored[-1])
    got = C.collocations(tokens, (2,), 3).collect()
    assert [(r.expression, r.n, r.nb_docs) for r in got] == [("of the", 9, 9)]
    assert all("only" not in (r.term or "") for r in stored[0].collect())


def test_only_likely_places_are_joined(spark):
    docs = [(1, ["of", "the", "day", "x", "of"]), (2, []), (3, None), (4, ["of", "the"])]
    tokens = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    known = spark.createDataFrame([(["of", "the"],), (["the", "day", "x"],)], "words array<string>")
    got = G.expression_places(tokens, G.filter_of(known, "words"), 3).collect()
    assert {tuple(r) for r in got} == {(1, 1, 2, "of the"), (1, 2, 3, "the day x"), (4, 1, 2, "of the")}


def test_tree_computes_its_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 3.0)], "term_a string, term_b string, weight double")
    got = N.maximum_spanning_tree(edges.mapInArrow(pass_on, edges.schema)).collect()
    assert {(r.term_a, r.term_b) for r in got} == {("a", "c"), ("b", "c")}
    assert made.value == 3


@pytest.mark.parametrize("count", [
    lambda words, sizes: G._pairs_of_piece(words, sizes, 5, " "),
    lambda words, sizes: G._grams_of_piece(words, sizes, [1, 3, 5], "_"),
    lambda words, sizes: G._parts_of_piece(words, sizes, [2, 3], " ")], ids=["pairs", "grams", "parts"])
def test_a_worker_holds_little_of_a_large_task(count):
    # an executor's memory holds the JVM and two workers
    rng = np.random.default_rng(5)
    known = pa.array([f"w{i}" for i in range(30_000)])
    words, sizes = known.take(pa.array(rng.integers(0, 30_000, 1_000_000))), np.full(2000, 500)
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), words)], ["tokens"])
    most, held, largest = G.PIECE_CODES // 5, pa.total_allocated_bytes(), 0
    tracemalloc.start()
    for piece in G._pieces(iter([batch]), most):
        for out in count(*piece):
            largest = max(largest, out.num_rows)
            assert pa.total_allocated_bytes() - held < 60e6
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and 0 < largest <= 50_000
