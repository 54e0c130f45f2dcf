"""Operator 7, substring dedup: Rabin-Karp hashes of every fixed-length window.

1. Documents are dealt to blocks by ranges of ``doc_id`` (bounds from
   approximate quantiles, about ``block_bytes`` of text each), so the order of
   blocks is the order of documents.
2. Each block hashes every window of its documents and keeps one row per
   distinct hash; hashes are packed per bucket of the hash space. A passage
   that a third of all documents share thus costs one entry per block.
3. Per bucket Spark counts the hashes over all blocks; every block but the
   first that holds a hash is told so.
4. Each block marks its repeated windows (own repeats and those found in an
   earlier block), merges them into maximal intervals and removes the words.

Windows of equal 64-bit hashes count as equal (n windows: about n**2 / 2**65
wrong pairs expected; 5e-4 at 130 million windows).

Cases: null text has no words; a text shorter than a window keeps all;
rows with one ``doc_id`` are ordered by their text; a null id comes before all
others; extra columns are ignored; an empty table gives an empty result."""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm import arrays as A

RESULT = ("doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, "
          "removed array<struct<start:long,length:long>>")


def with_block(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int, int]:
    """``(block, doc_id, text)``, the number of blocks and of text bytes."""
    size = docs.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.octet_length(F.col(text_col))).alias("bytes")).first()
    total = size["bytes"] or 0
    n = max(1, math.ceil(total / block_bytes))
    bounds = []
    if n > 1:
        at = [i / n for i in range(1, n)]
        bounds = docs.agg(F.percentile_approx(id_col, at, max(10_000, 20 * n)).alias("q")).first()["q"] or []
        bounds = sorted(set(bounds))
    block = F.lit(0)
    if bounds:
        # binary search in the sorted bounds: the number of bounds below the id
        tree = _search(F.col(id_col), bounds, 0, len(bounds))
        block = F.coalesce(tree, F.lit(0))
    out = docs.select(block.cast("int").alias("block"), F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).cast("string").alias("text"))
    return out, len(bounds) + 1, total


def _search(key, bounds, lo, hi):
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(key > F.lit(bounds[mid]), _search(key, bounds, mid + 1, hi)).otherwise(_search(key, bounds, lo, mid))


class _Block:
    """The windows of a block: distinct hashes in bucket order, with the first
    window of each, and the marks of windows that repeat within the block."""

    def __init__(self, table: pa.Table, window: int, buckets: int):
        ids = table.column("doc_id").to_numpy(zero_copy_only=False)
        ids = np.where(np.isnan(ids), np.iinfo(np.int64).min, ids).astype(np.int64) if ids.dtype.kind == "f" else ids
        order = np.argsort(ids, kind="stable")
        same = ids[order][1:] == ids[order][:-1]
        if same.any():
            texts = table.column("text").to_pylist()
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or "")), np.int64)
        self.table = table.take(pa.array(order))
        self.data, offsets = A.utf8(self.table.column("text"))
        self.starts, self.ends, self.first = A.words(self.data, offsets)
        hashes = A.word_hashes(self.data, self.starts, self.ends)
        self.at, windows = A.window_hashes(hashes, self.first, window)
        self.marked = np.zeros(len(self.at), bool)
        order = np.argsort(windows)
        ranked = windows[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        groups = np.flatnonzero(new)
        self.unique = ranked[groups]
        self.holder = np.minimum.reduceat(order, groups) if len(groups) else groups
        self.marked[:] = True
        self.marked[self.holder] = False
        # buckets are ranges of the hash space, so they are slices here
        edges = [((b << 64) // buckets) for b in range(buckets)]
        self.edges = np.searchsorted(self.unique, np.array(edges, np.uint64))
        self.edges = np.append(self.edges, len(self.unique))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = 6 << 20, bucket_windows: int = 1 << 20,
                   with_text: bool = True) -> DataFrame:
    """One row per document: the words left, joined by one space
    (``kept_text``, if ``with_text``), its SHA-256, the counts, and the removed
    intervals in words."""
    spark_docs, blocks, total = with_block(docs, id_col, text_col, block_bytes)
    buckets = max(16, math.ceil(total / 6 / bucket_windows))

    def hashes(key, table):
        block = _Block(table, window, buckets)
        rows = [(b, block.unique[lo:hi].tobytes()) for b, (lo, hi) in
                enumerate(zip(block.edges[:-1].tolist(), block.edges[1:].tolist())) if hi > lo]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()),
                         "block": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                         "hashes": pa.array([r[1] for r in rows], pa.binary())})

    def count(key, table):
        blobs = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        sizes = np.array([len(x) for x in blobs])
        block = np.repeat(table.column("block").to_numpy(), sizes)
        rank = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
        every = np.concatenate(blobs)
        order = np.argsort(every)
        ranked = every[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        groups = np.flatnonzero(new)
        by = block[order]
        least = np.repeat(np.minimum.reduceat(by, groups), np.diff(np.append(groups, len(ranked))))
        later = by > least
        by, rank = by[later], rank[order][later]
        order = np.lexsort((rank, by))
        by, rank = by[order], rank[order]
        cut = np.flatnonzero(np.diff(by)) + 1
        parts = np.split(rank, cut) if len(by) else []
        heads = by[np.concatenate(([0], cut))] if len(by) else []
        return pa.table({"block": pa.array([int(x) for x in heads], pa.int32()),
                         "bucket": pa.array([key[0].as_py()] * len(parts), pa.int32()),
                         "ranks": pa.array([x.tobytes() for x in parts], pa.binary())})

    def remove(key, table, told):
        block = _Block(table, window, buckets)
        for bucket, ranks in zip(told.column("bucket").to_pylist(), told.column("ranks")):
            at = np.frombuffer(ranks.as_buffer(), np.uint32).astype(np.int64) + block.edges[bucket]
            block.marked[block.holder[at]] = True
        cover = np.zeros(len(block.starts) + 1, np.int64)
        hit = block.at[block.marked]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        data = block.data.tobytes()
        starts, ends, first = block.starts.tolist(), block.ends.tolist(), block.first.tolist()
        before = np.concatenate(([0], np.cumsum(gone)))
        out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": [], "removed": []}
        for lo, hi in zip(first[:-1], first[1:]):
            n_gone = int(before[hi] - before[lo])
            spans = []
            if n_gone:
                own = gone[lo:hi]
                edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
                spans = [{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]
                kept = b" ".join([data[starts[i]:ends[i]] for i in (np.flatnonzero(~own) + lo).tolist()])
            else:
                kept = b" ".join(data[starts[lo]:ends[hi - 1]].split()) if hi > lo else b""
            out["n_words"].append(hi - lo)
            out["n_removed"].append(n_gone)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(kept.decode("utf-8", "replace") if with_text else None)
            out["removed"].append(spans)
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.table({"doc_id": block.table.column("doc_id").cast(pa.int64()),
                         "n_words": pa.array(out["n_words"], pa.int64()),
                         "n_removed": pa.array(out["n_removed"], pa.int64()),
                         "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
                         "kept_text": pa.array(out["kept_text"], pa.string()),
                         "removed": pa.array(out["removed"], spans_type)})

    by_block = spark_docs.groupBy("block")
    packed = by_block.applyInArrow(hashes, "bucket int, block int, hashes binary")
    told = packed.groupBy("bucket").applyInArrow(count, "block int, bucket int, ranks binary")
    return by_block.cogroup(told.groupBy("block")).applyInArrow(remove, RESULT)
