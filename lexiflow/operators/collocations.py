"""Collocations and token compounding.

``collocations`` counts adjacent n-grams and compares each with what its parts
alone would give; ``compound_tokens`` joins the expressions found (or given)
into single tokens inside the token array."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fence
from ..session import materialize
from .counting import expression_places, filter_of, gram_part_totals
from .spans import chosen_marks, length_digit, merge_marked, sparse_lengths

#: Words of an expression are joined by one space; a token holds no space.
WORD_SEP = " "
#: A word that begins like a name.
NAME_WORD = r"^\p{Lu}"
#: Expressions up to this number are tested in the row; more are joined.
LITERAL_EXPRESSIONS = 5_000


def _xlogx_ratio(observed: Column, expected: Column) -> Column:
    return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(F.lit(0.0))


def collocations(tokens_df: DataFrame, sizes: Sequence[int] = (2,), min_count: int = 2,
                 proper_nouns: bool = False, tokens_col: str = "tokens", id_col: str = "doc_id") -> DataFrame:
    """``expression, size, n, nb_docs, g2, pmi`` of adjacent n-grams found
    ``min_count`` times or more.

    An n-gram of ``size`` words is cut once at every place. A cut gives a
    contingency table over all n-grams of that size: n-grams with the same left part,
    and with the same right part, against all. ``g2`` is the log-likelihood ratio and
    ``pmi`` the base-2 logarithm of observed by expected; of the cuts the one
    of the least ``pmi`` is reported, so an expression is no better than its
    weakest joint. ``g2`` is negative where the parts avoid each other.
    ``proper_nouns`` keeps n-grams whose words all begin with an upper-case
    letter (use tokens whose case is kept); the tables still count all.

    A task counts the n-grams of a piece of documents, and with them how many begin and end with
    each of their parts; one shuffle adds up both. What begins or ends an n-gram found
    ``min_count`` times is found as often, so the rare rest is dropped before anything is
    joined."""
    sizes = sorted(set(sizes))
    if not sizes or sizes[0] < 2:
        raise ValueError("n-gram sizes must be 2 or more")
    table = gram_part_totals(tokens_df, sizes, WORD_SEP, tokens_col)
    often = F.greatest("n", *[f"{side}{k}" for k in sizes for side in "lr"]) >= min_count
    table = materialize(table.where(F.col("term").isNull() | often))
    totals = {r["size"]: float(r["n"]) for r in table.where("term is null").collect()}  # a row per size
    words = F.split("term", WORD_SEP)
    parts = []
    for size in sizes:
        total = F.lit(totals.get(size, 0.0))
        kept = table.where((F.col("size") == size) & (F.col("n") >= min_count) & F.col("term").isNotNull()) \
            .select("term", words.alias("words"), "size", "n", "nb_docs")
        if proper_nouns:
            kept = kept.where(F.forall("words", lambda w: w.rlike(NAME_WORD)))
        joints = []
        for cut in range(1, size):
            left = F.array_join(F.slice("words", 1, cut), WORD_SEP)
            right = F.array_join(F.slice("words", cut + 1, size - cut), WORD_SEP)
            for side, part, length in (("left", left, cut), ("right", right, size - cut)):
                name, count = f"{side}{cut}", f"{side[0]}{size}"
                marginal = table.where((F.col("size") == length) & (F.col(count) > 0)).select(
                    F.col("term").alias(name), F.col(count).cast("double").alias(f"n_{name}"))
                kept = kept.withColumn(name, part).join(marginal, name).drop(name)
            joints.append(_joint(F.col("n").cast("double"), F.col(f"n_left{cut}"), F.col(f"n_right{cut}"), total))
        weakest = F.array_min(F.array(*joints))
        parts.append(kept.select(F.col("term").alias("expression"), "size", "n", "nb_docs",
                                 F.round(weakest["g2"], 4).alias("g2"), F.round(weakest["pmi"], 4).alias("pmi")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _joint(n: Column, left: Column, right: Column, total: Column) -> Column:
    """``STRUCT<pmi, g2>`` of one cut's contingency table."""
    both = [(n, left * right), (left - n, left * (total - right)), (right - n, (total - left) * right),
            (total - left - right + n, (total - left) * (total - right))]
    g2 = F.lit(0.0)
    for observed, product in both:
        g2 = g2 + _xlogx_ratio(observed, product / total)
    sign = F.when(n * total >= left * right, 1.0).otherwise(-1.0)
    # the first field decides the order
    return F.struct(F.log2(n * total / (left * right)).alias("pmi"), (2 * sign * g2).alias("g2"))


def _expression_list(expressions: Iterable) -> list[str]:
    found = set()
    for e in expressions:
        words = e.split() if isinstance(e, str) else list(e)
        if len(words) >= 2:
            found.add(WORD_SEP.join(words))
    return sorted(found)


def _in_row(tokens_df: DataFrame, expressions: list[str], tokens_col: str, sep: str) -> DataFrame:
    tok = F.col(tokens_col)
    n = F.size(tok)
    by_size: dict[int, list[str]] = {}
    for e in expressions:
        by_size.setdefault(e.count(WORD_SEP) + 1, []).append(e)
    longest = max(by_size)

    def digit(i):
        out = None
        for size in sorted(by_size, reverse=True):
            gram = F.array_join(F.slice(tok, i, size), WORD_SEP)  # shorter at the end: no match
            hit = gram.isin(by_size[size])
            out = F.when(hit, F.lit(size)) if out is None else out.when(hit, F.lit(size))
        return length_digit(out.otherwise(F.lit(0)))

    lengths = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), digit), "")).otherwise(F.lit(""))
    out = tokens_df.withColumn("__lengths", fence(lengths))
    out = out.withColumn("__marks", fence(chosen_marks(F.col("__lengths"), longest)))
    return out.withColumn(tokens_col, fence(merge_marked(tok, F.col("__marks"), sep))).drop("__lengths", "__marks")


def compound_tokens(tokens_df: DataFrame, expressions: DataFrame | Iterable, sep: str = "_",
                    tokens_col: str = "tokens", id_col: str = "doc_id", longest: int | None = None) -> DataFrame:
    """Join the given expressions into one token each, leftmost first and the
    longest at each place; a token belongs to one expression only. Words are
    compared as they are (case matters).

    ``expressions`` is a list (strings of words, or lists of words) or a
    DataFrame with the column ``expression``, as ``collocations`` gives. Up to
    ``LITERAL_EXPRESSIONS`` are tested by hash in the row, without a shuffle. A larger
    table is joined to the n-grams of those positions that a filter of fixed size lets pass (AQE
    broadcasts it if its measured size allows), and the matches go back to their documents; ids
    must be unique then. ``longest`` (words of the longest expression) saves
    looking it up."""
    if not isinstance(expressions, DataFrame):
        listed = _expression_list(expressions)
        if not listed:
            return tokens_df
        if len(listed) <= LITERAL_EXPRESSIONS:
            return _in_row(tokens_df, listed, tokens_col, sep)
        expressions = tokens_df.sparkSession.createDataFrame([(e,) for e in listed], "expression string")
    known = expressions.select("expression").where(F.size(F.split("expression", WORD_SEP)) >= 2).distinct()
    few = known.limit(LITERAL_EXPRESSIONS + 1).collect()  # bounded
    if len(few) <= LITERAL_EXPRESSIONS:
        listed = _expression_list(r.expression for r in few)
        return _in_row(tokens_df, listed, tokens_col, sep) if listed else tokens_df
    if longest is None:
        longest = known.agg(F.max(F.size(F.split("expression", WORD_SEP)))).first()[0]
    return _joined(tokens_df, known, longest, sep, tokens_col, id_col)


def _joined(tokens_df: DataFrame, known: DataFrame, longest: int, sep: str, tokens_col: str, id_col: str) -> DataFrame:
    tok = F.col(tokens_col)
    n = F.size(tok)
    bits = filter_of(known.select(F.split("expression", WORD_SEP).alias("words")), "words")
    hits = expression_places(tokens_df, bits, longest, WORD_SEP, tokens_col, id_col) \
        .join(known, "expression", "left_semi").groupBy("__id", "pos").agg(F.max("len").alias("len"))
    found = hits.groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("pos", "len"))).alias("__matches"))
    out = tokens_df.join(found, F.col(id_col) == F.col("__id"), "left").drop("__id")
    matches = F.coalesce(F.col("__matches"), F.array().cast("array<struct<pos:int,len:int>>"))
    out = out.withColumn("__lengths", fence(sparse_lengths(matches, n)))
    out = out.withColumn("__marks", fence(chosen_marks(F.col("__lengths"), longest)))
    return out.withColumn(tokens_col, fence(merge_marked(tok, F.col("__marks"), sep))) \
        .drop("__lengths", "__marks", "__matches")
