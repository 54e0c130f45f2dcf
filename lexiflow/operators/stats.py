"""Term statistics.

Every aggregate by term uses partial aggregation before its shuffle, so a
term present in most documents costs one row per map task. The number of
documents is a scalar subquery over the document table: one value, no
join."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dfm import Dfm, term_totals

#: Rows of the frequent-terms table (passed by its queries only).
FREQUENT_TERMS_MAX = 10000


def ndoc_scalar(d: Dfm):
    """Number of documents as a scalar subquery: computed once, used as a
    value in expressions (no join)."""
    return d.docs.agg(F.count(F.lit(1))).scalar()


def frequent_terms(d: Dfm, limit: int | None = None) -> DataFrame:
    """``term, nb_terms, nb_docs, prop_docs`` ordered by frequency (A1-A4).
    ``prop_docs`` is the share of *all* documents, 2 decimals."""
    out = term_totals(d).select("term", "nb_terms", "nb_docs",
                                F.round(F.try_divide(F.col("nb_docs"), ndoc_scalar(d)) * 100, 2)
                                .alias("prop_docs"))
    out = out.orderBy(F.desc("nb_terms"), F.asc("term"))
    return out.limit(limit) if limit else out


def _top_n(n) -> int:
    try:
        n = int(n)
    except (TypeError, ValueError):
        return 10
    return n if n > 0 else 10


def top_features(d: Dfm, n=20, scheme: str = "count", groups: str | None = None) -> DataFrame:
    """Top features (A5-A8): ``[group,] rank, term, value``; ties by term.

    ``scheme``: count (total frequency) or docfreq (documents). With
    ``groups`` the top n per docvar value is kept by a window partitioned on
    the group, after the aggregate has cut rows to one per (group, term)."""
    n = _top_n(n)
    if scheme not in ("count", "docfreq"):
        raise ValueError("scheme must be count or docfreq")
    val = F.sum("n") if scheme == "count" else F.count_if(F.col("n") > 0)
    if groups is None:
        agg = d.long.groupBy("term").agg(val.alias("value"))
        w = Window.orderBy(F.desc("value"), F.asc("term"))
        # the limit runs first (TakeOrderedAndProject), the rank on n rows
        top = agg.orderBy(F.desc("value"), F.asc("term")).limit(n)
        return top.select(F.row_number().over(w).alias("rank"), "term", "value")
    agg = d.long_with([groups]).groupBy(groups, "term").agg(val.alias("value"))
    w = Window.partitionBy(groups).orderBy(F.desc("value"), F.asc("term"))
    ranked = agg.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return ranked.select(F.col(groups).alias("group"), "rank", "term", "value")


def wordcloud_terms(d: Dfm, max_words: int = 30, min_count: int = 1) -> DataFrame:
    """Word-cloud data (A9): most frequent terms with their size relative to
    the most frequent one."""
    if int(max_words) < 1:
        raise ValueError("max_words must be 1 at least")
    top = (term_totals(d).filter(F.col("nb_terms") >= min_count)
           .orderBy(F.desc("nb_terms"), F.asc("term")).limit(int(max_words)))
    w = Window.orderBy(F.desc("nb_terms"), F.asc("term"))
    return top.select("term", F.col("nb_terms").alias("freq"),
                      F.round(F.col("nb_terms") / F.max("nb_terms").over(Window.partitionBy()), 4)
                      .alias("rel_size"),
                      F.row_number().over(w).alias("rank"))


def comparison_terms(d: Dfm, by: str, max_words: int = 30) -> DataFrame:
    """Comparison cloud data (A10): rate of each term in each group minus
    its average rate over all groups (absent = 0); each term goes to the
    group where it deviates most; the ``max_words`` largest deviations.

    Per term one aggregate gives the sum of its rates and the group of the
    highest one; since the average is the same for all groups of a term, the
    largest deviation is that of the highest rate. Group totals are one row
    per group; AQE broadcasts them by their measured size."""
    long = d.long_with([by]).filter(F.col(by).isNotNull())
    gt = long.groupBy(by, "term").agg(F.sum("n").alias("n"))
    tot = gt.groupBy(by).agg(F.sum("n").alias("__tot"))
    groups = d.docs.filter(F.col(by).isNotNull()).select(by).distinct()
    ngroups = groups.agg(F.count(F.lit(1))).scalar()
    rates = gt.join(tot, by).select("term", by, (F.col("n") / F.col("__tot")).alias("rate"))
    best = rates.groupBy("term").agg(F.max(F.struct("rate", by)).alias("b"), F.sum("rate").alias("s"))
    best = best.select("term", F.col("b")[by].alias("group"),
                       F.round(F.col("b")["rate"] - F.col("s") / ngroups, 6).alias("deviation"))
    return best.orderBy(F.desc("deviation"), F.asc("term")).limit(int(max_words))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column."""
    return df.select(col).distinct()
