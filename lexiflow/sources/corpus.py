"""Corpus sources (S1-S5, S8-S11) and document-level joins.

A corpus is a DataFrame ``(doc_id, text, <docvars…>)``; only reading text
lines runs a job (their ids need the rows of earlier splits). Formats are
Spark's own readers.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, spread


def corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           docvars: Sequence[str] | None = None, spread_scan: bool = True) -> DataFrame:
    """Canonical corpus from any DataFrame (S1, S2): ``doc_id``, ``text`` and
    the chosen docvars (all other columns by default)."""
    if id_col not in df.columns or text_col not in df.columns:
        raise ValueError(f"corpus needs columns {id_col!r} and {text_col!r}")
    others = [c for c in df.columns if c not in (id_col, text_col)]
    keep = others if docvars is None else list(docvars)
    missing = [c for c in keep if c not in df.columns]
    if missing:
        raise ValueError(f"unknown docvars: {missing}")
    out = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    return spread(out) if spread_scan else out


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet", id_col: str = "doc_id",
                text_col: str = "text", docvars: Sequence[str] | None = None,
                **options) -> DataFrame:
    """Load a corpus with Spark's readers (parquet, json, csv, orc, text).
    For ``text`` each file line is a document (see ``numbered_lines``)."""
    if fmt == "text":
        return corpus(numbered_lines(spark, path, id_col, text_col, **options), id_col, text_col, [])
    raw = spark.read.format(fmt).options(**options).load(path)
    return corpus(raw, id_col, text_col, docvars)


def numbered_lines(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                   **options) -> DataFrame:
    """Lines of text files, numbered from 0 by file path and place in the file;
    the numbers do not depend on how the files are split.

    Pass one stores the lines with their split's file and offset, which put
    the splits in order; pass two counts the rows of each split. The
    rows before a split (a running sum over splits, not over rows) plus a line's place in its split are its number."""
    lines = spark.read.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"),
        F.monotonically_increasing_id().alias("__row"), F.col("value").alias(text_col))
    lines = materialize(lines)
    splits = lines.groupBy("__file", "__at").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    order = Window.orderBy("__file", "__at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(order), F.lit(0)))
    numbered = lines.join(splits, ["__file", "__at"])
    return numbered.select((F.col("__before") + F.col("__row") - F.col("__first")).alias(id_col), text_col)


def corpus_from_texts(spark: SparkSession, texts: Sequence[str], start: int = 1) -> DataFrame:
    """Small corpus from a list of strings (S4), ids from ``start``."""
    rows = [(i + start, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def cast_docvars(df: DataFrame, types: Mapping[str, str], safe: bool = True) -> DataFrame:
    """Cast docvars (S8): ``{"col": "date" | "double" | …}``; ``safe`` gives
    NULL for values that do not parse."""
    def conv(c, t):
        return F.col(c).try_cast(t) if safe else F.col(c).cast(t)
    return df.withColumns({c: conv(c, t) for c, t in types.items()})


def corpus_head(df: DataFrame, n: int = 10) -> DataFrame:
    """First n documents in id order."""
    return df.orderBy("doc_id").limit(n)


def with_raw(clean: DataFrame, raw: DataFrame, raw_text_col: str = "text",
             as_col: str = "raw_text") -> DataFrame:
    """Attach the raw text of each document by id (S3); the raw corpus is
    reduced to the filtered documents by the join itself (F5, J6)."""
    r = raw.select("doc_id", F.col(raw_text_col).alias(as_col))
    return clean.join(r, "doc_id", "left")


def raw_of(clean: DataFrame, raw: DataFrame) -> DataFrame:
    """Raw documents of a filtered corpus (F5, J6): semi join on id."""
    return raw.join(clean.select("doc_id"), "doc_id", "left_semi")


def replace_texts(corpus_df: DataFrame, texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace texts by new ones keyed by id (J4); missing ones become ''."""
    t = texts.select("doc_id", F.col(text_col).alias("__new"))
    return (corpus_df.drop(text_col).join(t, "doc_id", "left")
            .withColumn(text_col, F.coalesce(F.col("__new"), F.lit(""))).drop("__new"))


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist a corpus, token table or result as parquet."""
    df.write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
