"""The corpus pipeline: five stages over ``documents``, each written as Parquet
and read again as the next stage's input.

``run(spark, sf_dir)`` returns the rows of the last stage. Each stage works on
all rows that its predecessor kept, and all but the last return the columns of
``documents``; columns of other names pass through. SQL cannot express the
stages (a trained model, XXH64 votes, a tokenizer), so ``ORACLE_SQL`` is None and
the tests compare with a brute-force version."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm import language_id
from lexiflow.llm.catalog import END_ID, TOKENIZER
from lexiflow.llm.common import row_key, stored, table
from lexiflow.llm.decontaminate import leaks
from lexiflow.llm.packing import pack
from lexiflow.llm.sanitize import sanitize
from lexiflow.llm.simhash import near_duplicates

ORACLE_SQL = None

#: A language with less than this probability is rejected.
MIN_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go."""
    model = language_id.fit(docs)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no clash with the columns added
    scored = language_id.predict(plain, model, text_col=f"c{names.index('text')}")
    sure = F.col("lang_pred") != language_id.UNKNOWN
    if model["labels"]:
        sure = sure & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return scored.where(sure).drop("lang_pred", "score").toDF(*names)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one of the smallest id
    (of identical rows one)."""
    first = near_duplicates(docs).where("first").select(F.col("row").alias("__row")).distinct()
    return docs.withColumn("__row", row_key()).join(first, "__row", "left_semi") \
        .dropDuplicates(["__row"]).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    leaked = leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("row").alias("__row")).distinct()
    return docs.withColumn("__row", row_key()).join(leaked, "__row", "left_anti").select(*docs.columns)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and words that give it away are replaced or removed; every
    document stays, and a null text stays null."""
    done = sanitize(docs, carry=docs.columns)
    text = F.when(F.col("carried.text").isNotNull(), F.col("sanitised"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return done.select(*[(new[c] if c in new else F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their token ids."""
    return pack(docs, public_tokenizers.path(TOKENIZER), end_id=END_ID)


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", privacy_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
