"""Operators on parsed token tables.

A parsed table is long (one row per token); windows and groupings are by
document, so a partition holds at most one document's tokens."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def drop_pos(parsed: DataFrame, pos: Sequence[str]) -> DataFrame:
    """Remove tokens whose POS is listed (F6); a NULL POS is kept."""
    if not pos:
        return parsed
    return parsed.filter(keep_pos(pos))


CONTEXT_BUCKET = 100_000


def token_context(parsed: DataFrame, col: str = "token", bucket: int = CONTEXT_BUCKET) -> DataFrame:
    """Context of 5 tokens around each token, blanks at the edges (W1-W3):
    ``doc_id, token_pos, token, context`` with ``prev2 prev1 token next1
    next2`` joined by single blanks.

    A document may be very long (a hot key), so the window is not by
    document: tokens are cut into buckets of ``bucket`` positions and the
    neighbours are read within a (document, bucket) window. The two first
    and two last tokens of every bucket (at most four rows per bucket) give
    the neighbours across bucket edges through a second, small window over
    buckets, joined back on (document, bucket)."""
    t = F.col(col)
    keep = ["doc_id", "token_pos", col]
    # rows without a document or a position have no context
    b = (parsed.select(*keep).filter(F.col("doc_id").isNotNull() & F.col("token_pos").isNotNull())
         .withColumn("__b", F.floor(F.col("token_pos") / F.lit(bucket))))
    w = Window.partitionBy("doc_id", "__b").orderBy("token_pos")
    wc = Window.partitionBy("doc_id", "__b")
    inb = b.select("*", F.lag(t, 1).over(w).alias("__p1"), F.lag(t, 2).over(w).alias("__p2"),
                   F.lead(t, 1).over(w).alias("__n1"), F.lead(t, 2).over(w).alias("__n2"),
                   F.row_number().over(w).alias("__rn"), F.count(F.lit(1)).over(wc).alias("__cnt"))
    # edges: per bucket its first two and last two tokens (bounded rows)
    edge = (inb.filter((F.col("__rn") <= 2) | (F.col("__rn") > F.col("__cnt") - 2))
            .groupBy("doc_id", "__b")
            # the first row is kept whole: this branch then reads every column of
            # the window's input, like the main branch, so Spark reuses its exchange
            .agg(F.max_by(F.struct(*[F.col(c) for c in keep]),
                          F.when(F.col("__rn") == 1, F.col("token_pos")))[col].alias("f1"),
                 F.max(F.when(F.col("__rn") == 2, t)).alias("f2"),
                 F.max(F.when(F.col("__rn") == F.col("__cnt"), t)).alias("l1"),
                 F.max(F.when(F.col("__rn") == F.col("__cnt") - 1, t)).alias("l2"),
                 F.max("__cnt").alias("c")))
    wb = Window.partitionBy("doc_id").orderBy("__b")
    nb = edge.select(
        "doc_id", "__b",
        F.lag("l1", 1).over(wb).alias("pl1"),
        F.when(F.lag("c", 1).over(wb) >= 2, F.lag("l2", 1).over(wb))
        .otherwise(F.lag("l1", 2).over(wb)).alias("pl2"),
        F.lead("f1", 1).over(wb).alias("nf1"),
        F.when(F.lead("c", 1).over(wb) >= 2, F.lead("f2", 1).over(wb))
        .otherwise(F.lead("f1", 2).over(wb)).alias("nf2"))
    # keys are known non-null in both branches, so no filter is inferred into
    # one of them: they keep the same plan below the window and share its
    # exchange, and the join reuses the window's partitioning
    j = inb.join(nb, ["doc_id", "__b"], "left")
    rn, cnt = F.col("__rn"), F.col("__cnt")
    p1 = F.when(rn == 1, F.col("pl1")).otherwise(F.col("__p1"))
    p2 = F.when(rn == 1, F.col("pl2")).when(rn == 2, F.col("pl1")).otherwise(F.col("__p2"))
    n1 = F.when(rn == cnt, F.col("nf1")).otherwise(F.col("__n1"))
    n2 = F.when(rn == cnt, F.col("nf2")).when(rn == cnt - 1, F.col("nf1")).otherwise(F.col("__n2"))
    ctx = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (p2, p1)], t,
                      *[F.coalesce(c, F.lit("")) for c in (n1, n2)])
    return j.select(*keep, ctx.alias("context"))


def pos_counts(parsed: DataFrame) -> DataFrame:
    """``pos, n, label`` ascending by count, ties by name."""
    return (parsed.groupBy("pos").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("label", F.format_string("%s (n=%d)", F.col("pos"), F.col("n")))
            .orderBy("n", "pos"))


def rebuild_texts(parsed: DataFrame, keep: Column | None = None, column: str = "token",
                  bucket: int = CONTEXT_BUCKET) -> DataFrame:
    """Text of each document from its kept tokens in order, joined by a
    blank (A16). ``keep`` is a condition on the token rows (e.g. from
    ``keep_pos``); a document whose tokens are all dropped gets ``''`` (J3).

    Two aggregations: tokens are first joined per (document, bucket of
    ``bucket`` positions), so a very long document is spread over many
    tasks; a document then joins its bucket texts in order. The condition is
    applied inside the aggregations, so every document of the table is
    present without a completion join."""
    item = F.struct("token_pos", F.col(column).alias("t"))
    if keep is not None:
        item = F.when(keep, item)
    parts = (parsed.groupBy("doc_id", F.floor(F.col("token_pos") / F.lit(bucket)).alias("__b"))
             .agg(F.sort_array(F.collect_list(item)).alias("ts"))
             .select("doc_id", "__b", F.array_join(F.transform("ts", lambda x: x["t"]), " ").alias("part"),
                     F.size("ts").alias("k")))
    piece = F.when(F.col("k") > 0, F.struct("__b", "part"))
    return (parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(piece)).alias("ps"))
            .select("doc_id", F.array_join(F.transform("ps", lambda x: x["part"]), " ").alias("text")))


def keep_pos(pos: Sequence[str]) -> Column:
    """Row condition of ``drop_pos``: POS not listed (NULL POS kept)."""
    return ~F.coalesce(F.col("pos").isin(list(pos)), F.lit(False))


def frequent_lemmas(parsed: DataFrame, keep: Column | None = None, unit: str = "document",
                    limit: int | None = None) -> DataFrame:
    """Frequent-terms table of lowercased lemmas of the kept tokens (A17):
    ``term, nb_terms, nb_docs, prop_docs``; ``keep`` is a row condition such
    as ``keep_pos([...])``. ``unit="document"`` counts documents (D10), the
    share is of all documents of the table; ``unit="token"`` makes each token
    row its own document, as the reference did.

    One aggregation over the whole table: the condition is counted inside
    it, and the denominator comes from the same aggregate (both branches
    keep every aggregate column, so Spark reuses the exchange)."""
    lem = F.lower(F.col("lemma"))
    kept = F.count_if(keep) if keep is not None else F.count(F.lit(1))
    if unit == "token":
        agg = parsed.groupBy(lem.alias("term")).agg(kept.alias("c"), F.count(F.lit(1)).alias("rows"))
        agg = agg.filter((F.col("c") + F.col("rows")) >= 0)
        n = agg.agg(F.sum("rows"))
        t = agg.filter(F.col("c") > 0).select("term", F.col("c").alias("nb_terms"), F.col("c").alias("nb_docs"))
    else:
        per_doc = parsed.groupBy("doc_id", lem.alias("term")).agg(kept.alias("c"))
        per_doc = per_doc.filter(F.col("c") >= 0)
        n = per_doc.agg(F.count_distinct("doc_id"))
        t = (per_doc.filter(F.col("c") > 0).groupBy("term")
             .agg(F.sum("c").alias("nb_terms"), F.count(F.lit(1)).alias("nb_docs")))
    # the denominator is a scalar subquery (one value), no join
    out = t.select("term", "nb_terms", "nb_docs",
                   F.round(F.col("nb_docs") / n.scalar() * 100, 2).alias("prop_docs"))
    out = out.orderBy(F.desc("nb_terms"), F.asc("term"))
    return out.limit(limit) if limit else out
