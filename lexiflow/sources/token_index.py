"""A stored positional index of a token table: tokenize once, then answer
searches, concordances and similarities from the parts of it they need.

Two Parquet tables under one path, readable by any later session:

* ``postings``: ``term, doc_id, positions, block``, partitioned by ``bucket``
  (a hash of the term) and sorted by term within it. A query reads the
  buckets of its terms; inside them, row groups of other terms are skipped.
* ``documents``: ``doc_id``, the docvars, ``tokens`` and ``size``, partitioned by
  ``block`` (a hash of the id). Documents that a query hits are read by a join that
  carries the block, so Spark prunes the blocks without a hit while it runs.

Both are written by a rebalancing shuffle, which splits a bucket of very
frequent terms over several files instead of one task."""
from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import fence
from ..functions.query import parse, query_terms
from ..operators import kwic as K
from ..operators import search as Q
from ..operators import similarity as H
from ..operators.dfm import Dfm, dfm, dfm_from_long

#: Least postings a bucket should hold; few buckets for a small table.
POSTINGS_PER_BUCKET = 50_000_000
DOCUMENTS_PER_BLOCK = 100_000


def _place(value: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(n)).cast("int")


def _row_postings(rows: DataFrame) -> DataFrame:
    """``doc_id, term, positions, block``: the positions of every term of a row,
    gathered inside the row, so tokens are never shuffled one by one."""
    spots = F.sort_array(F.transform("tokens", lambda t, i: F.struct(t.alias("term"), (i + 1).alias("at"))))
    out = rows.select("doc_id", "block", fence(spots).alias("spots"))
    out = out.select("doc_id", "block", fence(F.col("spots.term")).alias("terms"), fence(F.col("spots.at")).alias("places"))
    starts = F.filter(F.sequence(F.lit(1), F.size("terms")), lambda i: (i == 1) | ~F.element_at("terms", i).eqNullSafe(
        F.try_element_at("terms", F.greatest(i - 1, F.lit(1)))))
    out = out.withColumn("starts", fence(starts))

    def posting(start, i):
        after = F.coalesce(F.try_element_at("starts", i + 2), F.size("terms") + 1)
        return F.struct(F.element_at("terms", start).alias("term"), F.slice("places", start, after - start).alias("positions"))
    out = out.withColumn("postings", fence(F.transform("starts", posting)))
    return out.select("doc_id", "block", F.inline("postings")).select("doc_id", "block", "term", "positions")


def build_index(tokens_df: DataFrame, path: str, buckets: int | None = None, blocks: int | None = None,
                tokens_col: str = "tokens", id_col: str = "doc_id") -> "TokenIndex":
    """Write the index of a token table to ``path`` (which must be new) and
    open it. Without a given number, buckets and blocks follow the size."""
    docs = tokens_df.withColumnRenamed(id_col, "doc_id").withColumnRenamed(tokens_col, "tokens")
    if buckets is None or blocks is None:
        size = docs.agg(F.count(F.lit(1)).alias("d"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("t")).first()
        buckets = buckets or max(16, -(-size["t"] // POSTINGS_PER_BUCKET))
        blocks = blocks or max(16, -(-size["d"] // DOCUMENTS_PER_BLOCK))
    placed = docs.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))) \
        .withColumn("size", F.size("tokens")).withColumn("block", _place(F.col("doc_id"), blocks))
    placed.hint("rebalance", "block").write.partitionBy("block").parquet(f"{path}/documents")
    spark = tokens_df.sparkSession
    stored = spark.read.schema(placed.schema).parquet(f"{path}/documents")
    rows = stored.where(F.size("tokens") > 0).select("doc_id", "block", "tokens")
    postings = _row_postings(rows).withColumn("bucket", _place(F.col("term"), buckets))
    postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc_id") \
        .write.partitionBy("bucket").parquet(f"{path}/postings")
    layout = (int(buckets), int(blocks), placed.schema.json(), postings.schema.json())
    spark.createDataFrame([layout], "buckets int, blocks int, documents string, postings string").coalesce(1) \
        .write.parquet(f"{path}/layout")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> "TokenIndex":
    layout = spark.read.parquet(f"{path}/layout").first()
    documents, postings = (spark.read.schema(T.StructType.fromJson(json.loads(layout[name]))).parquet(f"{path}/{name}")
                           for name in ("documents", "postings"))
    return TokenIndex(documents, postings, layout["buckets"], layout["blocks"])


@dataclass
class TokenIndex:
    """An opened index. Results equal those of the operators on the tokens."""

    documents: DataFrame
    postings: DataFrame
    buckets: int
    blocks: int

    def postings_of(self, terms: Sequence[str]) -> DataFrame:
        """Postings of exactly these terms; only their buckets are read."""
        terms = sorted(set(terms))
        # literals: the bucket numbers are constants of the plan
        buckets = [_place(F.lit(t), self.buckets) for t in terms]
        return self.postings.where(F.col("bucket").isin(*buckets) & F.col("term").isin(terms)) \
            if terms else self.postings.limit(0)

    def docs(self) -> DataFrame:
        """The document table: id and docvars."""
        return self.documents.drop("tokens", "size", "block")

    def dfm_of(self, terms: Sequence[str]) -> Dfm:
        """Counts of these terms only; all documents."""
        long = self.postings_of(terms).select("doc_id", "term", F.size("positions").cast("bigint").alias("n"))
        return dfm_from_long(self.docs(), long)

    def search(self, query: str, binary: bool = False, lowercase: bool = True) -> DataFrame:
        """As ``operators.search.search``, from the postings of its terms."""
        return Q.search(self.dfm_of(query_terms(parse(query), lowercase)), query, binary, lowercase)

    def hit_documents(self, hits: DataFrame) -> DataFrame:
        """Token rows of the documents in ``hits(doc_id)``."""
        wanted = hits.select("doc_id").distinct().withColumn("block", _place(F.col("doc_id"), self.blocks))
        return self.documents.join(wanted, ["block", "doc_id"], "left_semi")

    def kwic(self, terms: Sequence[str] | None = None, phrase: Sequence[str] | str | None = None,
             window: int = K.KWIC_WINDOW) -> DataFrame:
        """As ``operators.kwic.kwic`` on the indexed tokens, for words without
        globs and tokens in lower case: documents that hold a word (all words of the phrase) are read,
        and no others."""
        words = [w.lower() for w in (phrase.split() if isinstance(phrase, str) else phrase or terms or [])]
        if any(c in w for w in words for c in "*?"):
            raise ValueError("the index finds whole words; use operators.kwic for globs")
        held = self.postings_of(words).groupBy("doc_id").agg(F.count_distinct("term").alias("n"))
        if phrase:
            held = held.where(F.col("n") == len(set(words)))
        return K.kwic(self.hit_documents(held), terms=terms, phrase=phrase, window=window)

    def cooccurring_docs(self, term: str) -> DataFrame:
        """``term, nb_docs_common`` with the terms of the documents that hold
        ``term``; only those documents are read."""
        rows = self.hit_documents(self.postings_of([term])).select("doc_id", "tokens")
        return H.cooccurring_docs(dfm(rows), term)
