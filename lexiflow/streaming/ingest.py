"""Documents arriving as files → per-document term counts appended to a
table (narrow operators only, so append mode needs no state or watermark)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dfm import counted
from ..operators.tokens import clean_tokens
from ..options import TextOptions


def document_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of documents from files landing in ``path``."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def stream_counts(docs: DataFrame, opts: TextOptions = TextOptions()) -> DataFrame:
    """Long counts ``doc_id, term, n`` of each arriving document. Stop words,
    dictionary and n-grams of ``opts`` apply; stemming and trimming need the
    whole vocabulary and run on the stored table instead."""
    rows = counted(clean_tokens(docs.select("doc_id", "text"), opts), "tokens", "counts")
    return rows.select("doc_id", F.inline("counts"))


def start_counts_sink(counts: DataFrame, path: str, checkpoint: str, trigger_seconds: int | None = None):
    """Append the counts to parquet at ``path``; ``checkpoint`` must be a
    shared folder so a restarted query resumes exactly where it stopped."""
    w = counts.writeStream.format("parquet").option("path", path) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
