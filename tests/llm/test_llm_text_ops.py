"""Operators on words, windows and fingerprints against brute force."""
import hashlib
import itertools
import math
from collections import Counter

import xxhash
from llm_helpers import WORD, lower

from lexiflow.llm.decontaminate import leaks
from lexiflow.llm.line_quality import clean_lines
from lexiflow.llm.simhash import near_duplicates
from lexiflow.llm.substring_dedup import remove_repeats


def test_substring_dedup_equals_brute_force(odd, odd_rows, none):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in
                  remove_repeats(odd, block_bytes=4000, bucket_windows=500).collect())
    seen, want = set(), Counter()
    for doc_id, text, *_ in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k:k + 20])
            if key in seen:
                gone[k:k + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert got == want
    assert remove_repeats(none).count() == 0


def test_substring_dedup_intervals_are_maximal(spark):
    words = " ".join(f"t{i}" for i in range(50))
    docs = spark.createDataFrame([(1, words), (2, "x " + words + " y")], "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert [tuple(s) for s in got[2].removed] == [(1, 50)] and got[2].kept_text == "x y"
    assert got[1].removed == []


def fingerprint(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_equals_brute_force(odd, odd_rows, none):
    fps = [(r[0], fingerprint(r[1])) for r in odd_rows]
    group = list(range(len(fps)))
    for _ in fps:
        for i, (_, a) in enumerate(fps):
            for j, (_, b) in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for g, (doc_id, _) in zip(group, fps):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    want = Counter((d, f"{fp:016x}", least.get(g)) for g, (d, fp) in zip(group, fps))
    for groups, tile_rows in ((1, 4), (2, 1), (4, 2048), (8, 3)):
        got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in
                      near_duplicates(odd, groups=groups, tile_rows=tile_rows).collect())
        assert got == want
    assert near_duplicates(none).count() == 0


def test_simhash_links_chain_of_random_fingerprints(spark):
    """Links of distinct fingerprints against all pairs, tiles of any size."""
    import random

    from lexiflow.llm.simhash import components, links
    rng = random.Random(3)
    fps = []
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            fps.append(x)
            x ^= 1 << rng.randrange(64)
            x ^= 1 << rng.randrange(64)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components(links(nodes, 2, groups=2, tile_rows=8)).collect()}
    label = {x: x for x in signed}
    changed = True
    while changed:
        changed = False
        for x, a in zip(fps, signed):
            for y, b in zip(fps, signed):
                if (x ^ y).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert {a: roots.get(a, a) for a in signed} == label


def test_line_rules(spark, odd, none):
    body = "One sentence ends here. " * 30
    rows = [(1, body), (2, body + "\nHome | News | About | Contact | Login\nAll rights reserved.\n" + body),
            (3, "\n".join(["Menu | Shop | Cart"] * 30)), (4, None), (5, ("again " * 99 + "again.\n") * 2)]
    got = {r.doc_id: r for r in clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the same sentence over and over fails the base rule on repeats
    assert got[1].base_failed and got[1].n_removed_lines == 0
    assert got[2].n_removed_lines == 2 and "rights" not in got[2].cleaned
    assert got[3].n_dup_lines == 29 and not got[3].kept and got[3].lost_chars == got[3].word_chars
    assert got[4].n_words == 0 and got[4].base_failed and not got[4].kept
    assert got[5].n_repeat_words == 200 and got[5].n_removed_lines == 2
    assert clean_lines(odd).count() == 15 and clean_lines(none).count() == 0


def test_leaks_tolerate_substitutions(spark, odd, none):
    item = " ".join(f"q{i}" for i in range(30))
    near = " ".join("sub" if i % 7 == 3 else f"Q{i}," for i in range(30))
    far = " ".join("sub" if i % 2 else f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(7, item), (5, item), (9, "too short to tell"), (10, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c " + item + " d"), (2, "x " + near), (3, far), (4, None), (5, ""),
                                  (None, item), (6, " ".join(f"q{i}" for i in range(8)))], "doc_id long, text string")
    for broadcast_rows in (2_000_000, 0):
        got = {r.doc_id: r for r in leaks(docs, bench, broadcast_rows=broadcast_rows).collect()}
        assert set(got) == {1, 2, None} and {r.item_id for r in got.values()} == {5}
        assert (got[1].doc_start, got[1].item_start, got[1].matches, got[1].item_matches) == (3, 0, 15, 30)
        assert got[2].item_matches == 26
    assert leaks(none, bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0
    assert leaks(odd, bench).count() == 0


def test_leaks_find_every_admitted_substitution(spark):
    """All patterns of substituted tokens, of items of 1 to 15 tokens."""
    items, docs = [], []
    for n in range(1, 16):
        words = [f"n{n}k{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for gone in itertools.combinations(range(n), n - math.ceil(0.8 * n)):
            docs.append((len(docs), n, " ".join("other" if k in gone else w for k, w in enumerate(words))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(table, bench).collect()}
    assert got == {(i, n) for i, n, _ in docs}


def test_leaks_of_short_unspaced_and_unnamed_items(spark):
    han = "".join(chr(0x4E00 + 37 * k) for k in range(60))
    bench = spark.createDataFrame([(1, "How old is he?"), (None, " ".join(f"u{i}" for i in range(20))),
                                   (None, " ".join(f"v{i}" for i in range(20))), (4, han), (5, "\u0e2a\u0e27\u0e22\u0e07\u0e32\u0e21"),
                                   (6, " ... ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "He asked: how old is he"), (2, "how old was he"), (3, "x " + " ".join(f"u{i}" for i in range(20))),
                                  (4, "vorher" + han[:9] + "\u3042" + han[10:] + "nachher"), (5, han[:11] + "\u3002"),
                                  (6, "a\u0e2a\u0e27\u0e22\u0e07\u0e32\u0e21b"), (7, " ... ")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.item_tokens, r.matches) for r in leaks(docs, bench).collect())
    assert got == [(1, 1, 4, 4), (3, None, 20, 15), (4, 4, 60, 15), (6, 5, 6, 6)]
