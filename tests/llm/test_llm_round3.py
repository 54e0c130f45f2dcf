"""Operators 11 to 13 against brute-force versions."""
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from lexiflow.llm import context_tree, middle, run_index, turn_repair
from lexiflow.llm.catalog import op12_path_ranking


# ------------------------------------------------------------------ 11

def fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}",
           "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
    lengths = (None, None) if form == "plain" else (a, b - a)
    return (doc_id, n, form, *lengths, hashlib.sha256(out.encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(), out)


def same(got, want):
    key = repr
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_fill_in_middle_equals_brute_force(spark, odd, odd_rows, none):
    wide = [(1000 + i, "".join(random.Random(i).choices("aé漢😀 \n", k=i))) for i in range(60)]
    wide += [(2000, "a <P> b"), (2001, "<S>"), (2002, "<<M"), (-5, "😀"), (2003, "x" * 300_000)]
    docs = spark.createDataFrame(wide, "doc_id long, text string")
    same([tuple(r) for r in middle.fill_in_middle(docs).collect()], [fim(*r) for r in wide])
    same([tuple(r) for r in middle.fill_in_middle(odd).collect()], [fim(r[0], r[1]) for r in odd_rows])
    assert middle.fill_in_middle(none).collect() == []
    bare = middle.fill_in_middle(docs, with_text=False).collect()
    assert {r.output for r in bare} == {None}


def test_select_finds_every_unit():
    text = "aé漢😀" * 11 + "b"
    units = middle.Units(np.frombuffer(text.encode(), np.uint8))
    ends = np.cumsum([len(c.encode()) for c in text])
    assert units.select(np.arange(1, len(text) + 1)).tolist() == ends.tolist()
    assert units.rank(ends).tolist() == list(range(1, len(text) + 1))


def test_markers_spliced_by_cuts_are_restored():
    for text in (b"<P", b"S>", b"<", b">", b"P>x<S", b"<M<S<P"):
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                for form in ("psm", "spm"):
                    assert middle.restore(middle.arrange(text, a, b, form), form) == text


# ------------------------------------------------------------------ 12

FOLLOW = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}


def repaired(rows):
    """The cheapest, then ASCII-least, edits, by keeping the best of each state."""
    best = {"": (0, "", ())}

    def offer(into, state, cost, audit, out):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = (cost, audit, out)

    def insert(best):
        grown = dict(best)
        for _ in range(3):
            for state, (cost, audit, out) in list(grown.items()):
                for new in ("u", "a"):
                    if new in FOLLOW[state]:
                        offer(grown, new, cost + 5, audit + "I", (*out, NAMES[new] + ":"))
        return grown

    for role, text, fault in rows:
        best, after = insert(best), {}
        stay = 5 if fault == "truncated" else 0
        for state, (cost, audit, out) in best.items():
            offer(after, state, cost + 2, audit + "D", out)
            if fault in ("blank", "duplicate"):
                continue
            if role[:1] in FOLLOW[state] and role:
                offer(after, role[0], cost + stay, audit + "K", (*out, f"{role}:{text}"))
            for new in ("u", "a"):
                if new in FOLLOW[state]:
                    offer(after, new, cost + stay + 1, audit + "R", (*out, f"{NAMES[new]}:{text}"))
        best = after
    best = insert(best)
    return min(best[s] for s in ("", "a") if s in best)


def brute_conversations(rows, hashed):
    out = {}
    for conv, turn, role, text in rows:
        found = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        found += [(turn, role, text)] * (2 if code == 3 else 1)
    result = []
    for conv, found in out.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1:]], r[1], r[2]))
        turns = {r[0] for r in found} - {None}
        rows_, seen = [], set()
        for _, role, text in found:
            bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else \
                "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            rows_.append((role, text, fault))
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows_, rows_[1:])]
        cost, audit, done = repaired(rows_)
        kinds = [r[2] for r in rows_]
        result.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"),
                       kinds.count("duplicate"), kinds.count("truncated"),
                       sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                       hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return result


def hashes(spark, rows):
    from pyspark.sql import functions as F
    pairs = {(" " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows}
    pairs |= {(role, text) for _, t in pairs for role in ["user", *{p[0] for p in pairs}]
              for text in ("", t, re.sub("[.!?]", "", t))}
    df = spark.createDataFrame(sorted(pairs), "role string, text string")
    return {(r.role, r.text): r.h for r in df.select("role", "text", F.xxhash64("role", "text").alias("h")).collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def some_conversations(n, seed, longest=9):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "useful", None]
    texts = ["Hi.", "What now?", "Well then", "", " \t", None, "No!", "Fine. \n", "e.g", "😀."]
    rows = []
    for conv in range(n):
        for turn in range(rnd.randint(1, longest)):
            tidy = rnd.random() < 0.6
            role = ["user", "assistant"][turn % 2] if tidy else rnd.choice(roles)
            text = f"Turn {rnd.randint(0, 4)}." if rnd.random() < 0.5 else rnd.choice(texts)
            rows.append((conv if conv else None, None if rnd.random() < 0.05 else turn + rnd.choice([0, 0, 0, 3]), role, text))
    return rows


@pytest.mark.parametrize("span", [20_000, 3])
def test_repair_equals_brute_force(spark, monkeypatch, span):
    """With a span of 3, almost every conversation goes through the pieces."""
    monkeypatch.setattr(turn_repair, "SPAN", span)
    rows = some_conversations(150, 5, 14)
    rows += [(900, t, r, "Same text here.") for t in range(60) for r in ("user", "assistant")]
    rows += [(901, 1, "user", "Again.")] * 25
    rows += [(902, t, "user", f"Only users {t}.") for t in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as audit", "1 as cost", "0 as part").repartition(3)
    got = [tuple(r) for r in turn_repair.repair(docs, piece_rows=span).collect()]
    same(got, brute_conversations(rows, hashes(spark, rows)))


def test_repair_of_the_given_table_and_of_nothing(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in op12_path_ranking(spark, sf).collect()]
    hashed = hashes(spark, rows)
    same(got, brute_conversations(rows, hashed))
    assert turn_repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []


# ------------------------------------------------------------------ 13

def brute_bytes(rows, length):
    texts = [(-2**63 if d is None else d, d, (t or "").encode()) for d, t, *_ in rows]
    first = {}
    for key, _, data in texts:
        for i in range(len(data) - length + 1):
            s = data[i:i + length]
            first[s] = min(first.get(s, key), key)
    out = []
    for key, doc, data in texts:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i:i + length]] < key:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def removed(docs, **options):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept))
            for r in run_index.remove_repeats(docs, **options).collect()]


def some_texts(n, seed):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choices("abé ", k=rnd.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(passages) if rnd.random() < 0.5 else "".join(rnd.choices("abcdé", k=rnd.randint(0, 12)))
                       for _ in range(rnd.randint(0, 6)))
        rows.append((rnd.choice([None, 2**60, 2**60 + 1]) if rnd.random() < 0.1 else i // 2, text))
    return rows + [(3, None), (4, ""), (77, "a" * 500), (78, "a" * 300), (79, "ab" * 200), (80, passages[0] * 9)]


@pytest.mark.parametrize("split, options", [
    (64, dict(length=10, anchor=4)), (64, dict(length=10, anchor=4, block_bytes=300, bucket_bytes=200)),
    (0, dict(length=10, anchor=4, block_bytes=300, bucket_bytes=200)), (64, dict(length=7, anchor=7, block_bytes=500))])
def test_run_index_equals_brute_force(spark, monkeypatch, split, options):
    """With a split of 0 every anchor is split into its strings."""
    monkeypatch.setattr(run_index, "SPLIT_STRETCHES", split)
    if not split:
        monkeypatch.setattr(run_index, "SPLIT_BLOCKS", 0)
    rows = some_texts(120, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(removed(docs, **options), brute_bytes(rows, options["length"]))


def test_run_index_on_odd_rows(spark, odd, odd_rows, none):
    same(removed(odd), brute_bytes(odd_rows, 50))
    assert run_index.remove_repeats(none).collect() == []


def test_run_index_with_the_largest_ids(spark):
    """The largest id is an id like any other."""
    rnd = random.Random(4)
    rows = [(rnd.choice([2**63 - 1, 2**63 - 2, 5, -1, 1 - 2**63]), t) for _, t in some_texts(80, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    options = dict(length=10, anchor=4, block_bytes=300, bucket_bytes=200)
    same(removed(docs, **options), brute_bytes(rows, 10))


def test_matching_statistics():
    rnd = random.Random(2)
    for _ in range(200):
        text = bytes(rnd.choices(b"abc"[:rnd.randint(1, 3)], k=rnd.randint(1, 60)))
        query = bytes(rnd.choices(b"abcd", k=rnd.randint(1, 30)))
        index = run_index.RunIndex(np.frombuffer(text, np.uint8).astype(np.int64) - 96)
        got = index.statistics(np.frombuffer(query, np.uint8).astype(np.int64) - 96, np.array([0]),
                               np.array([len(query)]), 7)
        want = [max(n for n in range(8) if query[i:i + n] in text and i + n <= len(query)) for i in range(len(query))]
        assert got.tolist() == want
        runs = 1 + sum(a != b for a, b in zip(bwt(text), bwt(text)[1:]))
        assert len(index.first) == runs


def bwt(text):
    closed = text + b"\0"
    order = sorted(range(len(closed)), key=lambda i: closed[i:])
    return bytes(closed[i - 1] for i in order)


# ---------------------------------------------- packing and personal data

def test_word_ids_equal_the_tokenizer():
    """Words one by one against whole texts, with letters whose lower case is
    longer, marks, special tokens, and a cache that overflows."""
    import array

    import public_tokenizers
    from tokenizers import Tokenizer

    from lexiflow.llm.packing import word_encoder
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, encode = Tokenizer.from_file(path), word_encoder(path, cache_words=500)
    rnd = random.Random(3)
    texts = ["kitabİ.", "İ!", "ABCİ, x", "ΟΔΟΣ. Σ", "it's. don't!", "a<|endoftext|>.", "é.", "12.5%, x;",
             "ﬁ. ß! ẞ.", "", "O'Neil's.", "漢字. x"]
    texts += ["".join(rnd.choices("aAbİıéÉ́ß.,!?;:%'s tT12²Σς<|>-_ \n漢Я", k=rnd.randint(0, 14))) for _ in range(3000)]
    for text in texts:
        assert encode(text) == array.array("I", whole.encode(text, add_special_tokens=False).ids).tobytes(), text


@pytest.mark.parametrize("text", ["a@b" + ".c" * 500_000, "a" * 500_000 + "@b.c"])
def test_long_runs_of_address_like_text(spark, text):
    from lexiflow.llm.sanitize import sanitize
    docs = spark.createDataFrame([(1, text, "en", "a", 1), (2, "jo@x.example.com", "en", "a", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.base for r in sanitize(docs, with_text=False).collect()}
    want = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    assert [(s["start"], s["end"]) for s in got[1] if s["kind"] == "email"] == want
    assert len(got[2]) == 1


def test_a_block_of_the_language_model_is_small():
    """Two tasks share an executor's memory: coding a whole block takes little of it."""
    data = np.full(context_tree.BLOCK, 97, np.uint8)
    tracemalloc.start()
    context_tree.coded(data, np.array([0, len(data)]), np.ones(256, np.int32))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
