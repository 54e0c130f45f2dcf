"""Operator 3, benchmark decontamination by spaced-seed hashing. DataFrame
functions only: no Python runs on the executors.

1. Tokens are lower-cased runs of letters and digits, and single characters of
   scripts written without spaces, kept as 64-bit hashes. Fixed masks select
   five token positions of a window and ignore the others; the selected hashes
   of every window, of benchmark items and of documents, make one hash per
   mask. With the default ``window`` and ``similarity`` the masks meet every
   pattern of substitutions that step 3 admits. Items under 8 tokens have masks
   of their own by length, made for the lengths that the benchmark holds.
2. Every window of every document is hashed in the row and joined with the
   benchmark's hashes on mask and hash: a broadcast join while they are at most
   ``broadcast_rows`` (counted first; 16 bytes each), so no window is shuffled,
   and a shuffled join beyond.
3. Each hit gives a
   diagonal (document position minus item position); on every diagonal the
   tokens are compared, and a stretch of ``window`` item tokens (the whole
   item, if shorter) of which ``similarity`` agree is a leak. Substituted
   tokens are thus tolerated; an inserted token starts another diagonal.

Items of one token sequence count as one, named by the smallest ``item_id``
(null, if none has an id), and are told apart by their tokens, so items with
no id or one id are matched each. Short items are matched like all others: up
to 4 tokens as they are, from 5 with one substitution at the default
``similarity``; ``item_tokens`` tells them.

Cases: null and empty texts, and items without a token, never hit; repeated documents are reported each;
a null ``doc_id`` is reported as null; extra columns are ignored; an empty
benchmark or document table gives an empty result."""
from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import row_key, stored

#: The selected positions of each mask.
MASKS = [(0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 1, 2, 6, 7)]
SPAN = 8
#: Meets the patterns of admitted substitutions that ``MASKS`` alone miss.
EXTRA_MASK = (0, 1, 2, 4, 5)
TOKEN = r"[\p{L}\p{N}]+"
#: Scripts without spaces: Thai, Lao, Myanmar, Khmer, Tai, Balinese, Javanese, Han, kana, Yi.
UNSPACED = (r"[\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{1950}-\x{19DF}\x{1A20}-\x{1AAF}\x{1B00}-\x{1B7F}"
            r"\x{2E80}-\x{312F}\x{31A0}-\x{31BF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{A4CF}\x{A980}-\x{A9FF}"
            r"\x{AA60}-\x{AADF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{1B000}-\x{1B16F}\x{20000}-\x{3FFFF}]")


def token_hashes(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    spaced = F.when(text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    words = F.regexp_extract_all(F.lower(spaced), F.lit(TOKEN), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def short_masks(length: int, similarity: float) -> list[tuple[int, ...]]:
    """Masks of an item of fewer than ``SPAN`` tokens: of its tokens in two
    groups more than there may be substitutions, two stay whole."""
    groups = length - math.ceil(similarity * length) + 2
    chosen = {tuple(k for k in range(length) if k * groups // length in pair) for pair in combinations(range(groups), 2)}
    return sorted({tuple(k - m[0] for k in m) for m in chosen if m})


def window_hashes(h: Column, masks: list[tuple[int, ...]]) -> Column:
    """``array<struct<pos, mask, hash>>`` of all windows under the masks."""
    def under(name: int, mask: tuple[int, ...]) -> Column:
        last = F.size(h) - (mask[-1] + 1)
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(
            i.alias("pos"), F.lit(name).alias("mask"),
            F.xxhash64(*[F.get(h, i + F.lit(k)) for k in mask]).alias("hash")))

    return F.concat(*[under(name, mask) for name, mask in enumerate(masks)])


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 15, similarity: float = 0.8, id_col: str = "doc_id",
          text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row per document and benchmark item with an overlap: the best
    stretch (``doc_start``, ``item_start``, ``length``, ``matches`` in tokens),
    and ``item_matches`` of ``item_tokens`` on its diagonal; ``row`` is the
    document's ``row_key``."""
    items = benchmark.select(F.col(item_col).alias("item_id"), token_hashes(F.col(item_text)).alias("b")) \
        .where(F.size("b") > 0).groupBy("b").agg(F.min("item_id").alias("item_id")).withColumn("item", F.xxhash64("b"))
    items = stored(items, "items")
    # at most SPAN - 1 lengths
    short = [r["n"] for r in items.where(F.size("b") < SPAN).select(F.size("b").alias("n")).distinct().orderBy("n").collect()]
    masks = list(dict.fromkeys([*MASKS, EXTRA_MASK, *(m for n in short for m in short_masks(n, similarity))]))
    # a mask of a short length would pick chance matches out of longer items
    fits = F.lit(False)
    for n in [None, *short]:
        names = [masks.index(m) for m in ([*MASKS, EXTRA_MASK] if n is None else short_masks(n, similarity))]
        size = F.size("b") >= SPAN if n is None else F.size("b") == n
        fits = fits | (size & F.col("s.mask").isin(names))
    seeds = stored(items.select("item", "b", F.explode(window_hashes(F.col("b"), masks)).alias("s")).where(fits)
                   .select("item", F.col("s.mask").alias("mask"), F.col("s.hash").alias("hash"),
                           F.col("s.pos").alias("item_pos")), "seeds")
    small = seeds.count() <= broadcast_rows
    # the same id and text give the same key, so repeated rows are found together
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .withColumn("row", row_key())
    windows = keyed.select("row", token_hashes(F.col("text")).alias("h")) \
        .select("row", F.explode(window_hashes(F.col("h"), masks)).alias("s")) \
        .select("row", F.col("s.mask").alias("mask"), F.col("s.hash").alias("hash"), F.col("s.pos").alias("pos"))
    diagonals = stored(windows.join(F.broadcast(seeds) if small else seeds, ["mask", "hash"])
                       .select("row", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct(), "hits")
    hit = stored(diagonals.select("row").distinct(), "rows")
    if hit.count() <= broadcast_rows:
        hit = F.broadcast(hit)
    rows = keyed.join(hit, "row").select("row", "doc_id", token_hashes(F.col("text")).alias("h"))
    same = F.transform("b", lambda x, j: F.when(F.get(F.col("h"), F.col("diagonal") + j) == x, 1).otherwise(0))
    length = F.least(F.size("b"), F.lit(window))
    stretch = F.transform(F.sequence(F.lit(0), F.size("same") - F.col("length")), lambda p: F.struct(
        F.aggregate(F.slice("same", p + 1, F.col("length")), F.lit(0), lambda a, x: a + x).alias("matches"),
        (-p).alias("back")))
    found = diagonals.join(rows, "row").join(items, "item") \
        .select("row", "doc_id", "item", "item_id", "diagonal", same.alias("same"), length.alias("length")) \
        .withColumn("best", F.array_max(stretch)) \
        .where(F.col("best.matches") >= F.ceil(F.lit(similarity) * F.col("length"))) \
        .select("row", "doc_id", "item", "item_id", F.struct(
            F.col("best.matches").alias("matches"),
            F.aggregate("same", F.lit(0), lambda a, x: a + x).alias("item_matches"),
            (-F.col("diagonal")).alias("before"), F.col("best.back").alias("back"), "length",
            F.size("same").alias("item_tokens")).alias("s"))
    return found.groupBy("row", "doc_id", "item", "item_id").agg(F.max("s").alias("s")) \
        .select("doc_id", "row", "item_id", (-F.col("s.before") - F.col("s.back")).cast("long").alias("doc_start"),
                (-F.col("s.back")).cast("long").alias("item_start"), F.col("s.length").cast("long").alias("length"),
                F.col("s.matches").cast("long").alias("matches"),
                F.col("s.item_matches").cast("long").alias("item_matches"),
                F.col("s.item_tokens").cast("long").alias("item_tokens"))
