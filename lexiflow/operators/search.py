"""Term search and its reports.

``search`` gives one row per document (every document, matched or not) with
the query value ``n``. On a nested dfm the value is computed inside the
document row from its counts: no join and no shuffle. On a long dfm only the
rows of the queried terms are aggregated by document and joined back to the
document table.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.patterns import quote_regex
from ..functions.query import parse, query_terms, result_column, term_forms, written_terms
from .dfm import Dfm, dfm_select, presence


def search(d: Dfm, query: str, binary: bool = False, lowercase: bool = True,
           strict: bool = False) -> DataFrame:
    """Evaluate ``query`` for every document: docs columns + ``n`` (Q1-Q5, Q9).

    ``binary`` uses presence/absence (the dfm explorer, Q3). ``strict``
    raises when a queried term is absent from the dfm (one small job);
    otherwise absent terms count 0."""
    node = parse(query)
    terms = query_terms(node, lowercase)
    if strict:
        absent = {r["term"] for r in missing_terms(d, terms).collect()}
        miss = [t for t in written_terms(node) if all(f in absent for f in term_forms(t, lowercase))]
        if miss:
            raise ValueError("terms missing from the corpus: " + ", ".join(miss))
    if binary:
        d = presence(d)
    idc = d.id_col
    if d.rows is not None:
        rows = d.rows.withColumn("__hits", F.filter("counts", lambda c: c["term"].isin(terms)))
        zero = F.lit(0).cast(d.value_type)

        def term_col(t: str) -> Column:
            return F.aggregate("__hits", zero, lambda a, c: a + F.when(c["term"] == t, c["n"])
                               .otherwise(zero))
        return (rows.withColumn("n", result_column(node, term_col, lowercase))
                .drop("__hits", "counts"))
    sums = (d.long_df.filter(F.col("term").isin(terms)).groupBy(idc)
            .agg(*[F.sum(F.when(F.col("term") == t, F.col("n"))).alias(f"__t{i}")
                   for i, t in enumerate(terms)]))
    joined = d.docs.join(sums, idc, "left")
    idx = {t: i for i, t in enumerate(terms)}

    def term_col(t: str) -> Column:
        return F.coalesce(F.col(f"__t{idx[t]}"), F.lit(0))
    out = joined.withColumn("n", result_column(node, term_col, lowercase))
    return out.drop(*[f"__t{i}" for i in range(len(terms))])


def search_total(hits: DataFrame) -> DataFrame:
    """``nb_docs, prop_docs`` over all documents, 1 decimal."""
    return hits.agg(F.count_if(F.col("n") > 0).alias("nb_docs"),
                    F.count(F.lit(1)).alias("__all")).select(
        "nb_docs", F.round(F.try_divide(F.col("nb_docs"), F.col("__all")) * 100, 1).alias("prop_docs"))


def search_by_group(hits: DataFrame, by: str, binary: bool = False) -> DataFrame:
    """``group, [freq,] nb_docs, prop_docs`` per docvar value; NULL is a group
    (A12, A13). Partial aggregation: a hot group costs one row per task."""
    aggs = [F.count_if(F.col("n") > 0).alias("nb_docs"), F.count(F.lit(1)).alias("__all")]
    if not binary:
        aggs.insert(0, F.sum("n").alias("freq"))
    g = hits.groupBy(F.col(by).alias("group")).agg(*aggs)
    cols = ["group"] + ([] if binary else ["freq"]) + [
        "nb_docs", F.round(F.col("nb_docs") / F.col("__all") * 100, 1).alias("prop_docs")]
    return g.select(*cols)


def matched_documents_total(tab: DataFrame) -> DataFrame:
    """Sum of matched documents over groups."""
    return tab.agg(F.coalesce(F.sum("nb_docs"), F.lit(0)).alias("n"))


def search_series(tab: DataFrame, kind: str = "categorical", measure: str = "prop_docs") -> DataFrame:
    """Plot series of a group table (Q16, Q17): categorical groups with a
    zero share dropped and ordered by the measure, ``order`` being the
    position on the axis; numeric/date groups ordered by value, which is the
    position itself (they are as many as distinct values, so they are range
    partitioned and never numbered in one task)."""
    if measure not in ("freq", "nb_docs", "prop_docs"):
        raise ValueError("measure must be freq, nb_docs or prop_docs")
    if kind == "categorical":
        t = tab.filter(F.col("prop_docs") > 0)
        w = Window.orderBy(F.col(measure).asc(), F.col("group").asc_nulls_first())
        # one row per level of a categorical docvar
        return t.withColumn("order", F.row_number().over(w))
    return tab.orderBy(F.col("group").asc_nulls_last())


def group_table(tab: DataFrame) -> DataFrame:
    """Group table ordered by share, descending (Q18)."""
    return tab.orderBy(F.desc("prop_docs"), F.col("group").asc_nulls_first())


def search_documents(hits: DataFrame, start: int = 1, size: int = 10,
                     order_col: str = "doc_id") -> DataFrame:
    """Matched documents ``start … start+size-1`` in corpus order."""
    if int(size) < 1 or int(start) < 1:
        raise ValueError("start and size must be 1 at least")
    return hits.filter(F.col("n") > 0).orderBy(order_col).offset(int(start) - 1).limit(int(size))


def page_bounds(total: DataFrame, start: int = 1, size: int = 10) -> DataFrame:
    """Page label and steps from a one-row total (Q11): ``start, end, total,
    label, next_start (NULL when none), prev_start``."""
    s, z = int(start), int(size)
    if s < 1 or z < 1:
        raise ValueError("start and size must be 1 at least")
    tot = F.col("nb_docs")
    end = F.least(F.lit(s + z - 1), tot)
    first = F.when(tot > 0, F.lit(s)).otherwise(F.lit(0))  # no hits: "0 to 0 of 0"
    return total.select(
        first.alias("start"), end.alias("end"), tot.alias("total"),
        F.format_string("%d to %d of %d", first, end, tot).alias("label"),
        F.when(F.lit(s + z) <= tot, F.lit(s + z)).alias("next_start"),
        F.greatest(F.lit(1), F.lit(s - z)).alias("prev_start"))


def missing_terms(d: Dfm, terms: Sequence[str]) -> DataFrame:
    """Queried terms absent from the dfm (F10, Q7); only rows of the queried
    terms are read from the dfm."""
    spark = d.docs.sparkSession
    terms = list(dict.fromkeys(terms))
    q = spark.createDataFrame([(t,) for t in terms], "term string")
    present = dfm_select(d, terms).long.select("term").filter(F.col("term").isin(terms)).distinct()
    return q.join(present, "term", "left_anti")


def highlight_expr(text: Column | str, terms: Sequence[str]) -> Column:
    """Mark every case-insensitive occurrence of the terms in one pass,
    longest first, keeping the original casing (Q13, D15); ``_`` of n-gram
    terms stands for a blank (Q6)."""
    text = F.col(text) if isinstance(text, str) else text
    words = sorted({t.replace("_", " ") for t in terms if t}, key=lambda t: (-len(t), t))
    if not words:
        return text
    pat = "(?iu)(" + "|".join(quote_regex(w) for w in words) + ")"
    return F.regexp_replace(text, F.lit(pat), F.lit("<span class='highlight'>$1</span>"))


def kwic_lines_expr(tokens: Column | str, terms: Sequence[str], window: int = 7) -> Column:
    """Kwic lines of one document as one string, built inside the row:
    ``...pre <strong>kw</strong> post...`` per hit in token order, joined by
    ``<br />``. Terms are matched as phrases (n-gram parts split at ``_``)."""
    tok = F.col(tokens) if isinstance(tokens, str) else tokens
    phrases = [[w.lower() for w in t.replace("_", " ").split() if w] for t in dict.fromkeys(terms)]
    phrases = [p for p in phrases if p]
    n = F.size(tok)

    def line(i, k):
        lo = F.greatest(F.lit(1), i - window)
        return F.concat(F.lit("..."), F.array_join(F.slice(tok, lo, i - lo), " "), F.lit(" <strong>"),
                        F.array_join(F.slice(tok, i, k), " "), F.lit("</strong> "),
                        F.array_join(F.slice(tok, i + k, window), " "), F.lit("..."))

    def matches(i, words):
        c = F.lower(F.element_at(tok, i)) == words[0]
        for j, w in enumerate(words[1:], start=1):
            c = c & F.coalesce(F.lower(F.try_element_at(tok, i + j)) == w, F.lit(False))
        return c

    def at(i):
        return F.array_compact(F.array(*[F.when(matches(i, p), line(i, len(p))) for p in phrases]))
    lines = F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), at)))
    return F.array_join(F.coalesce(lines, F.array().cast("array<string>")), "<br />")


def search_kwic(tokens_df: DataFrame, query: str, window: int = 7, lowercase: bool = True,
                tokens_col: str = "tokens") -> DataFrame:
    """Kwic of the documents matched by ``query`` (Q14): ``doc_id, kwic``.
    The counts, the query value and the lines are all computed inside each
    document row, so nothing is joined or shuffled; for a dfm that is not
    the plain count of these tokens (stemmed, trimmed), use
    ``search_kwic_hits``."""
    from .dfm import counted
    node = parse(query)
    terms = query_terms(node, lowercase)
    rows = counted(tokens_df.withColumn("__c", F.col(tokens_col)), "__c", "counts")
    d = Dfm(docs=rows.drop("counts"), rows=rows)
    hits = search(d, query, lowercase=lowercase)
    return (hits.filter(F.col("n") > 0)
            .select("doc_id", kwic_lines_expr(tokens_col, terms, window).alias("kwic")))


def search_kwic_hits(hits: DataFrame, tokens_df: DataFrame, terms: Sequence[str],
                     window: int = 7, tokens_col: str = "tokens") -> DataFrame:
    """Same lines for hits of any dfm: matched ids are semi-joined to the
    token rows (a shuffle join on the document id)."""
    matched = tokens_df.join(hits.filter(F.col("n") > 0).select("doc_id"), "doc_id", "left_semi")
    return matched.select("doc_id", kwic_lines_expr(tokens_col, terms, window).alias("kwic"))


def doc_metadata(docs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Docvars of each document as name/value pairs, NULL shown as NA (Q15):
    ``doc_id, name, value``, one row per pair."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias("value"))
                      for c in cols])
    return docs.select("doc_id", F.inline(pairs))
