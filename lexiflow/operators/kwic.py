"""Keyword in context and positions.

Hit positions are found inside the document row (``filter`` over a
``sequence`` of positions), turned into structs with their ``slice`` of
context, then ``inline``-d: only hits become rows, the token array is never
copied next to exploded rows, and nothing is shuffled.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fence
from .tokens import matches_words

KWIC_WINDOW = 7
POSITIONS_MAX_DOCS = 80


def _hit_positions(tok: Column, terms: Sequence[str] | None, phrase: Sequence[str] | None
                   ) -> tuple[Column, int]:
    n = F.size(tok)
    if phrase:
        words = [w.lower() for w in phrase]
        k = len(words)

        def pred(i):
            c = matches_words(F.element_at(tok, i), words[:1])
            for j, w in enumerate(words[1:], start=1):
                c = c & matches_words(F.element_at(tok, i + j), [w])
            return c
        last = n - k + 1
    else:
        words = sorted({t.lower() for t in terms or [] if t})
        if not words:
            raise ValueError("kwic needs terms or a phrase")
        k = 1

        def pred(i):
            return matches_words(F.element_at(tok, i), words)
        last = n
    pos = F.when(last >= 1, F.filter(F.sequence(F.lit(1), last), pred)) \
        .otherwise(F.array().cast("array<int>"))
    return pos, k


def kwic(tokens_df: DataFrame, terms: Sequence[str] | None = None,
         phrase: Sequence[str] | str | None = None, window: int = KWIC_WINDOW,
         tokens_col: str = "tokens", with_size: bool = False) -> DataFrame:
    """``doc_id, from, to, pre, keyword, post`` (K1, K2): case-insensitive
    match of single words (``terms``) or of a whole ``phrase``, both with ``*`` and ``?``
    as globs; ``from``/``to`` are 1-based token positions, ``pre``/``post`` up to ``window`` tokens."""
    if isinstance(phrase, str):
        phrase = phrase.split()
    tok = F.col(tokens_col)
    pos, k = _hit_positions(tok, terms, phrase)
    step = tokens_df.withColumn("__pos", fence(pos))

    def row(i):
        lo = F.greatest(F.lit(1), i - window)
        fields = [i.cast("bigint").alias("from"), (i + (k - 1)).cast("bigint").alias("to"),
                  F.array_join(F.slice(tok, lo, i - lo), " ").alias("pre"),
                  F.array_join(F.slice(tok, i, k), " ").alias("keyword"),
                  F.array_join(F.slice(tok, i + k, window), " ").alias("post")]
        if with_size:
            fields.append(F.size(tok).cast("bigint").alias("ntokens"))
        return F.struct(*fields)
    cols = ["doc_id", F.inline(F.transform("__pos", row))]
    return step.select(*cols)


def kwic_table(kw: DataFrame) -> DataFrame:
    """``doc_id, from, to, text`` with the keyword in ``<strong>`` (K3)."""
    return kw.select("doc_id", "from", "to", F.concat(
        F.col("pre"), F.lit(" <strong>"), F.col("keyword"), F.lit("</strong> "),
        F.col("post")).alias("text"))


def term_positions(tokens_df: DataFrame, terms: Sequence[str] | None = None,
                   phrase: Sequence[str] | str | None = None, max_docs: int | None = None,
                   tokens_col: str = "tokens") -> DataFrame:
    """Dispersion data (K5): ``doc_id, from, ntokens, rel_pos`` of all matched
    documents or of the first ``max_docs`` in id order (D12: documents, not rows).
    Hit positions stay an array in the document row, the first documents
    are a top-k over document rows, and only their hits are exploded."""
    if isinstance(phrase, str):
        phrase = phrase.split()
    tok = F.col(tokens_col)
    pos, _ = _hit_positions(tok, terms, phrase)
    docs = (tokens_df.select("doc_id", fence(pos).alias("__pos"), F.size(tok).alias("ntokens"))
            .filter(F.size("__pos") > 0))
    if max_docs is not None:
        docs = docs.orderBy("doc_id").limit(max_docs)
    return docs.select("doc_id", F.explode("__pos").alias("from"), "ntokens").select(
        "doc_id", F.col("from").cast("bigint").alias("from"), F.col("ntokens").cast("bigint").alias("ntokens"),
        F.round(F.col("from") / F.col("ntokens"), 4).alias("rel_pos"))


def kwic_summary(kw: DataFrame, max_docs: int = POSITIONS_MAX_DOCS) -> DataFrame:
    """``nb_docs, nb_hits, truncated``."""
    return kw.agg(F.count_distinct("doc_id").alias("nb_docs"),
                  F.count(F.lit(1)).alias("nb_hits")).withColumn(
        "truncated", F.col("nb_docs") > max_docs)
