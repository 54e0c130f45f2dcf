"""Similarity of one chosen term with every feature.

Sufficient statistics only: for each term x, Σx, Σx², df_x, and with the
chosen term y, Σxy and the number of common documents; for y, Σy, Σy², df_y
(one row); N from the document table (one row). On a nested dfm the value
of y in a document is read from the same row, so no join is needed; on a
long dfm the y column (at most one row per document) is joined on the
document id, a key without skew.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dfm import Dfm

METHODS = ("correlation", "cosine", "jaccard")


def _stats(d: Dfm, term: str) -> DataFrame:
    idc = d.id_col
    if d.rows is not None:
        yv = F.aggregate(F.filter("counts", lambda c: c["term"] == term), F.lit(None).cast(d.value_type),
                         lambda a, c: c["n"])
        long = d.rows.withColumn("__y", yv).select(idc, "__y", F.inline("counts"))
    else:
        # the condition reads ``n`` so it stays above an aggregate that made
        # the long table: both sides then share one exchange
        y = d.long_df.filter(F.when(F.col("term") == term, F.col("n")).isNotNull()) \
            .select(idc, F.col("n").alias("__y"))
        # at most one row per document: AQE broadcasts it by its measured size
        # (e.g. a grouped dfm) and splits skewed partitions otherwise
        long = d.long_df.join(y, idc, "left")
    x = F.col("n").cast("double")
    yy = F.col("__y").cast("double")
    return long.groupBy("term").agg(
        F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.count_if(x > 0).alias("dfx"),
        F.sum(F.coalesce(x * yy, F.lit(0.0))).alias("sxy"),
        F.count_if((x > 0) & (yy > 0)).alias("common"))


def cooccurring_docs(d: Dfm, term: str) -> DataFrame:
    """``term, nb_docs_common`` (H5, J7): documents shared with ``term``."""
    return _stats(d, term).select("term", F.col("common").alias("nb_docs_common"))


def _corr(n: Column, sx, sy, sxx, syy, sxy) -> Column:
    num = n * sxy - sx * sy
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), num / F.sqrt(vx * vy))


def term_similarity(d: Dfm, term: str, method: str = "correlation") -> DataFrame:
    """``term, similarity, simple_matching, nb_docs_common`` ordered by
    similarity, the term itself included (H1-H6). An absent term gives an
    empty result (H7). Correlation is NULL when a variance is 0."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    # every aggregate column stays read (no pruning) whatever is selected
    s = _stats(d, term)
    s = s.filter((F.col("sx") + F.col("sxx") + F.col("dfx") + F.col("sxy") + F.col("common")) >= 0)
    # The chosen term's own row holds Σy, Σy², df_y. The filter reads every
    # aggregate column in one condition, so Catalyst can neither push it below
    # the aggregate nor prune that aggregate: both branches keep the same
    # exchange and Spark reuses it (one pass over the texts).
    whole = F.when(F.col("term") == term, F.col("sx") + F.col("sxx") + F.col("dfx")
                   + F.col("sxy") + F.col("common"))
    # the chosen term's statistics and N are scalar subqueries (one value
    # each, no join); an absent term gives NULL and an empty result
    y = s.filter(whole.isNotNull()).select(F.struct("sx", "sxx", "dfx")).scalar()
    n = d.docs.agg(F.count(F.lit(1)).cast("double")).scalar()
    t = s.filter(y.isNotNull()).withColumns({"sy": y["sx"], "syy": y["sxx"], "dfy": y["dfx"]})
    c = F.col("common").cast("double")
    dfx, dfy = F.col("dfx").cast("double"), F.col("dfy").cast("double")
    if method == "correlation":
        sim = _corr(n, F.col("sx"), F.col("sy"), F.col("sxx"), F.col("syy"), F.col("sxy"))
    elif method == "cosine":
        # zero weights (e.g. tf-idf of a term in every document) give NULL, not an error
        sim = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    else:
        sim = F.try_divide(c, dfx + dfy - c)
    match = (c + (n - dfx - dfy + c)) / n
    return t.select("term", F.round(sim, 4).alias("similarity"),
                    F.round(match, 4).alias("simple_matching"),
                    F.col("common").alias("nb_docs_common")) \
        .orderBy(F.desc_nulls_last("similarity"), F.asc("term"))
