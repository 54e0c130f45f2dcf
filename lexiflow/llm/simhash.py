"""Operator 10, SimHash near-dedup: tiled exact comparison.

1. A fingerprint per document: bit b is set if over half of the XXH64 hashes
   (seed 42) of its word shingles have bit b set.
2. Equal fingerprints are one node (partial aggregation; a group of a third of
   all documents is one row).
3. Nodes are dealt to tiles by the population counts of the ``groups`` equal
   parts of the fingerprint; a tile is cut further by a hash of the
   fingerprint when it holds more than ``tile_rows``. Two fingerprints at
   distance d have part counts whose differences sum to at most d, so tile
   pairs beyond the radius are skipped; the others are compared in full with
   numpy exclusive-or and bit counts.
4. A tile pair emits a spanning forest of its links (fewer rows than nodes,
   never all pairs), and components are joined by rounds of large-star and
   small-star over the links, each round written to the shared folder.

Cases: null or blank text has fingerprint zero and links like any other; a
text with fewer words than a shingle hashes its whole word sequence; repeated
rows stay separate rows of one component; a null ``doc_id`` is returned, and
counts as the smallest id only of a component that has no other; extra columns
are ignored; an empty table gives an empty result."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import row_key, stored


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row, fp)``: ``row`` names the row's id and text, ``fp`` holds
    the 64 bits as a signed long."""
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

    def of(text) -> int:
        words = text.encode().translate(lower).split() if text else []
        if not words:
            return 0
        line = b" ".join(words)
        k = min(shingle, len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = end - size
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(line[a:b], 42) for a, b in zip(start.tolist(), end[k - 1:].tolist())], np.uint64)
        bits = np.zeros(64, np.int64)
        for i in range(0, len(h), 4096):
            part = h[i:i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
            bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(bits * 2 > len(h), bitorder="little").view("<i8")[0])

    def run(batches):
        for b in batches:
            fp = [of(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["doc_id", "row", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .select("doc_id", row_key().alias("row"), "text").mapInArrow(run, "doc_id long, row long, fp long")


def part_counts(fp: Column, groups: int) -> Column:
    """The population counts of the parts, as one number in base 65."""
    width = 64 // groups
    key = F.lit(0).cast("long")
    for g in range(groups):
        part = fp if groups == 1 else F.shiftrightunsigned(fp, g * width).bitwiseAND(F.lit((1 << width) - 1))
        key = key * 65 + F.bit_count(part)
    return key


def _offsets(groups: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of part counts within the radius, one of each pair d, -d."""
    def grow(prefix, left):
        if len(prefix) == groups:
            yield prefix
            return
        for d in range(-left, left + 1):
            yield from grow((*prefix, d), left - abs(d))
    return [d for d in grow((), radius) if d >= (0,) * groups]


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links with the least node of its local component."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[:len(u)], ends[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])
        if (new == label).all() and (label[a] == label[b]).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def links(nodes: DataFrame, radius: int = 2, groups: int | None = None, tile_rows: int = 2048) -> DataFrame:
    """``(u, v)``: a spanning forest, per tile pair, of the fingerprints
    (column ``fp``, distinct) that differ in at most ``radius`` bits. The
    number of parts only sets the cost, never the result."""
    if groups is None:
        n = nodes.count()
        groups = 1 if n < 1 << 15 else 2 if n < 1 << 19 else 4 if n < 1 << 24 else 8
    keyed = nodes.select("fp", part_counts(F.col("fp"), groups).alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("cuts"))
    # at most 33**2 (2 parts) or 17**4 (4 parts) sizes: small enough to send to all
    # tasks, so that the rows of a frequent key are not gathered by the key alone
    cut_of = F.broadcast(sizes) if groups <= 4 else sizes
    tiles = keyed.join(cut_of, "key").groupBy(
        "key", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("cuts")).cast("int").alias("cut")) \
        .agg(F.collect_list("fp").alias("fps"))
    steps = F.array(*[F.lit(sum(d * 65 ** (groups - 1 - i) for i, d in enumerate(off))).cast("long")
                      for off in _offsets(groups, radius)])
    pairs = sizes.select("key", "cuts", F.explode(steps).alias("step")) \
        .select(F.col("key").alias("key_a"), F.col("cuts").alias("cuts_a"), (F.col("key") + F.col("step")).alias("key_b")) \
        .join(sizes.select(F.col("key").alias("key_b"), F.col("cuts").alias("cuts_b")), "key_b") \
        .select("key_a", "key_b", "cuts_b", F.explode(F.sequence(F.lit(0), F.col("cuts_a") - 1)).alias("cut_a")) \
        .select("key_a", "key_b", "cut_a", F.explode(F.sequence(F.lit(0), F.col("cuts_b") - 1)).alias("cut_b")) \
        .where("key_a <> key_b or cut_a <= cut_b")
    joined = pairs.join(tiles.select(F.col("key").alias("key_a"), F.col("cut").alias("cut_a"),
                                     F.col("fps").alias("left")), ["key_a", "cut_a"]) \
        .join(tiles.select(F.col("key").alias("key_b"), F.col("cut").alias("cut_b"),
                           F.col("fps").alias("right")), ["key_b", "cut_b"]) \
        .select("left", "right")

    def compare(batches):
        for batch in batches:
            us, vs = [], []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].values.to_numpy().view(np.uint64)
                b = batch.column(1)[i].values.to_numpy().view(np.uint64)
                found_u, found_v = [], []
                step = max(1, (1 << 20) // len(b))
                for lo in range(0, len(a), step):
                    near = np.bitwise_count(a[lo:lo + step, None] ^ b[None, :]) <= radius
                    x, y = np.nonzero(near)
                    u, v = a[lo + x], b[y]
                    other = u != v
                    if other.any():
                        u, v = _forest(u[other], v[other])
                        found_u.append(u)
                        found_v.append(v)
                if found_u:
                    u, v = _forest(np.concatenate(found_u), np.concatenate(found_v))
                    us.append(u)
                    vs.append(v)
            u = np.concatenate(us) if us else np.zeros(0, np.uint64)
            v = np.concatenate(vs) if vs else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return joined.mapInArrow(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with a link: the least node reachable.

    Rounds of large-star and small-star; each leaves at most as many links as
    before, and their number of rounds is logarithmic in a chain's length."""
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        edges = stored(small, "links")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text", groups: int | None = None, tile_rows: int = 2048) -> DataFrame:
    """``(doc_id, row, fingerprint, component_id, n_copies, first)``: one row per
    document.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most
    ``radius`` bits; ``n_copies`` counts the rows of equal fingerprint; ``first``
    marks the document that stands for its component (the smallest id; of equal
    ids one text; identical rows all are marked)."""
    fps = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    # a missing id comes last
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = stored(fps.groupBy("fp").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n_copies")), "nodes")
    roots = components(links(nodes, radius, groups, tile_rows))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "least", "n_copies", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("least"))
    named = rooted.drop("least").join(ids, "root").select("fp", "n_copies", "least")
    return fps.join(named, "fp").select(
        "doc_id", "row", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"), "n_copies", (F.col("least.row") == F.col("row")).alias("first"))
