"""Docvar profile and domains.

One pass over the document table: every docvar is turned into
``(name, value-as-string)`` pairs by ``stack``, made distinct by Spark, and
counted per name. Level lists are only gathered for names under 100 distinct
values, so no unbounded list is ever built.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LEVELS = 100
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, NUMERIC):
        return "numeric"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dt, T.BooleanType):
        return "logical"
    if isinstance(dt, T.StringType):
        return "character"
    return "other"


def _docvar_fields(df: DataFrame, docvars: Sequence[str] | None):
    skip = {"doc_id", "text", "tokens", "counts"}
    fields = [f for f in df.schema.fields if f.name not in skip]
    if docvars is not None:
        fields = [f for f in fields if f.name in set(docvars)]
    return [f for f in fields if _kind(f.dataType) != "other"]


def _stacked(df: DataFrame, fields) -> DataFrame:
    pairs = ", ".join(f"'{f.name}', CAST(`{f.name}` AS STRING)" for f in fields)
    return df.selectExpr(f"stack({len(fields)}, {pairs}) AS (name, value)")


def _kinds_df(df: DataFrame, fields) -> DataFrame:
    spark = df.sparkSession
    rows = [(i, f.name, _kind(f.dataType)) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "col_order int, name string, kind string")


def usable_docvars(df: DataFrame, docvars: Sequence[str] | None = None,
                   types_always: Sequence[str] = ("numeric", "date")) -> DataFrame:
    """``name, kind, n_distinct, usable`` (S15, S16): distinct values count
    NULL as one; a docvar is usable with 2-99 distinct values, or always for
    the kinds in ``types_always`` (pass ``()`` for the dfm explorer)."""
    fields = _docvar_fields(df, docvars)
    counts = (_stacked(df, fields).distinct().groupBy("name")
              .agg(F.count(F.lit(1)).alias("n_distinct")))
    kinds = _kinds_df(df, fields)
    out = kinds.join(F.broadcast(counts), "name", "left").fillna(0, ["n_distinct"])
    usable = (F.col("n_distinct") > 1) & (F.col("n_distinct") < MAX_LEVELS)
    if types_always:
        usable = usable | F.col("kind").isin(list(types_always))
    return out.select("col_order", "name", "kind", "n_distinct", usable.alias("usable"))


def docvar_domains(df: DataFrame, docvars: Sequence[str] | None = None) -> DataFrame:
    """Filter domain of each usable docvar (S17): ``min_value``/``max_value``
    for numeric and date (NULL ignored), sorted ``levels`` for character and
    logical ones with 2-99 levels (NULL shown as ``NA``)."""
    fields = _docvar_fields(df, docvars)
    ranged = [f for f in fields if _kind(f.dataType) in ("numeric", "date")]
    leveled = [f for f in fields if _kind(f.dataType) in ("character", "logical")]
    parts = []
    if ranged:
        aggs = []
        for f in ranged:
            aggs += [F.min(f.name).cast("string").alias(f"{f.name}__min"),
                     F.max(f.name).cast("string").alias(f"{f.name}__max")]
        one = df.agg(*aggs)
        pairs = ", ".join(f"'{f.name}', `{f.name}__min`, `{f.name}__max`" for f in ranged)
        parts.append(one.selectExpr(f"stack({len(ranged)}, {pairs}) AS (name, min_value, max_value)")
                     .withColumn("levels", F.lit(None).cast("array<string>")))
    if leveled:
        vals = _stacked(df, leveled).distinct()
        small = (vals.groupBy("name").agg(F.count(F.lit(1)).alias("k"))
                 .filter((F.col("k") > 1) & (F.col("k") < MAX_LEVELS)).select("name"))
        # at most 99 values per kept name: bounded lists
        lv = (vals.join(F.broadcast(small), "name", "left_semi")
              .groupBy("name").agg(F.sort_array(F.collect_list(
                  F.coalesce(F.col("value"), F.lit("NA")))).alias("levels")))
        parts.append(lv.select("name", F.lit(None).cast("string").alias("min_value"),
                               F.lit(None).cast("string").alias("max_value"), "levels"))
    if not parts:
        spark = df.sparkSession
        return spark.createDataFrame([], "name string, kind string, min_value string, "
                                         "max_value string, levels array<string>")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    kinds = _kinds_df(df, fields)
    return out.join(F.broadcast(kinds), "name").select("name", "kind", "min_value",
                                                        "max_value", "levels")
