"""Document-feature matrix.

A ``Dfm`` is the document table plus term counts. Fresh from tokens it is
*nested*: each document row carries ``counts ARRAY<STRUCT<term, n>>``, built
inside the row by sorting its tokens (no explode, no shuffle). The long form
``(doc_id, term, n)`` is an ``inline`` of that column, so it is a narrow view
of the same partitions. Operators that need per-term totals (trim, stem,
tf-idf, grouping) produce a *long* Dfm: a document table and a long table.

Every document stays in ``docs`` even without terms, so the denominator of
all shares is the document table, never the distinct ids of the long table.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fence
from .counting import gram_totals
from .tokens import ngrams_expr

COUNT_TYPE = "array<struct<term:string,n:bigint>>"
#: Column of a trimmed long table: rows of its term, so that tf-idf needs no second join.
TERM_ROWS = "__df"


def _run_ends(srt: Column) -> Column:
    """Last position of each run of equal values in a sorted array, as
    ``ARRAY<STRUCT<term, p>>`` (``srt`` must be an attribute)."""
    nxt = F.concat(F.slice(srt, 2, F.greatest(F.size(srt) - 1, F.lit(0))),
                   F.array(F.lit(None).cast("string")))
    flagged = F.zip_with(srt, nxt, lambda a, b: F.struct(
        a.alias("term"), (b.isNull() | (a != b)).alias("last")))
    numbered = F.transform(flagged, lambda x, i: F.struct(
        x["term"].alias("term"), x["last"].alias("last"), (i + 1).alias("p")))
    return F.filter(numbered, lambda x: x["last"] & x["term"].isNotNull())


def _run_counts(ends: Column) -> Column:
    """Run lengths from run ends (``ends`` must be an attribute)."""
    prev = F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e["p"]))
    return F.filter(F.zip_with(ends, prev, lambda e, q: F.struct(
        e["term"].alias("term"), (e["p"] - q).cast("bigint").alias("n"))),
        lambda x: x["term"].isNotNull())


def counted(df: DataFrame, tokens_col: str = "tokens", out_col: str = "counts") -> DataFrame:
    """Replace a token array by its per-document counts, inside the row."""
    out = df.withColumn("__sorted", F.sort_array(F.col(tokens_col)))
    if tokens_col != out_col:
        out = out.drop(tokens_col)
    out = out.withColumn("__ends", _run_ends(F.col("__sorted"))).drop("__sorted")
    return out.withColumn(out_col, fence(_run_counts(F.col("__ends")).cast(COUNT_TYPE))).drop("__ends")


@dataclass
class Dfm:
    """Documents × features. ``docs`` has one row per document (or group);
    exactly one of ``rows`` (nested, with a ``counts`` column) or ``long_df``
    holds the counts."""

    docs: DataFrame
    rows: DataFrame | None = None
    long_df: DataFrame | None = None
    id_col: str = "doc_id"
    value_type: str = "bigint"
    #: Words, their column and the sizes of the n-grams whose counts ``rows`` holds, if known.
    words: tuple[DataFrame, str, Sequence[int]] | None = None

    @property
    def long(self) -> DataFrame:
        """Long form ``(id, term, n)``, n > 0."""
        if self.rows is not None:
            return self.rows.select(self.id_col, F.inline("counts"))
        return self.long_df.drop(TERM_ROWS)

    def long_with(self, cols: Sequence[str]) -> DataFrame:
        """Long form with document columns attached; for a nested dfm these
        come from the same row (no join)."""
        cols = [c for c in cols if c != self.id_col]
        if self.rows is not None:
            return self.rows.select(self.id_col, *cols, F.inline("counts"))
        # AQE broadcasts the documents by their measured size (a grouped dfm
        # has few), and splits a skewed partition otherwise
        return self.long.join(self.docs.select(self.id_col, *cols), self.id_col)

    @property
    def nested(self) -> bool:
        return self.rows is not None

    def materialize(self) -> "Dfm":
        """Counts computed once and stored (see ``session.materialize``):
        operators that read the dfm twice (trim, tf-idf, stem) then reread
        stored counts instead of tokenizing the texts again."""
        from ..session import materialize
        if self.rows is not None:
            rows = materialize(self.rows)
            return Dfm(docs=rows.drop("counts"), rows=rows, id_col=self.id_col,
                       value_type=self.value_type)
        return Dfm(docs=self.docs, long_df=materialize(self.long_df), id_col=self.id_col,
                   value_type=self.value_type)

    def ndoc(self) -> DataFrame:
        """One-row DataFrame ``ndoc``."""
        return self.docs.agg(F.count(F.lit(1)).alias("ndoc"))


def dfm(tokens_df: DataFrame, tokens_col: str = "tokens", id_col: str = "doc_id", ngrams: Sequence[int] = (1,)) -> Dfm:
    """Count tokens per document (M1), or their n-grams, without lowercasing again. Narrow:
    the counts are made inside each document row."""
    words = (tokens_df, tokens_col, tuple(sorted(set(ngrams))))
    if words[2] != (1,):
        tokens_df = tokens_df.withColumn(tokens_col, fence(ngrams_expr(tokens_col, ngrams)))
    rows = counted(tokens_df, tokens_col, "counts")
    if tokens_col != "counts":
        rows = rows.drop(tokens_col)
    return Dfm(docs=rows.drop("counts"), rows=rows, id_col=id_col, words=words)


def dfm_from_long(docs: DataFrame, long_df: DataFrame, id_col: str = "doc_id",
                  term_col: str = "term", n_col: str = "n") -> Dfm:
    """A ready dfm in long form (S5); documents without terms come from ``docs``."""
    long_df = long_df.select(F.col(id_col), F.col(term_col).alias("term"),
                             F.col(n_col).alias("n")).filter(F.col("n") > 0)
    vt = dict(long_df.dtypes)["n"]
    return Dfm(docs=docs, long_df=long_df, id_col=id_col, value_type=vt)


def dfm_from_wide(df: DataFrame, id_col: str = "doc_id") -> Dfm:
    """A dfm given as one column per feature: unpivot to long form."""
    feats = [c for c in df.columns if c != id_col]
    long_df = df.unpivot(id_col, feats, "term", "n").filter(F.col("n") > 0)
    return dfm_from_long(df.select(id_col), long_df, id_col)


def to_long(d: Dfm) -> Dfm:
    """Same dfm in long form."""
    if d.rows is None:
        return d
    return Dfm(docs=d.docs, long_df=d.long, id_col=d.id_col, value_type=d.value_type)


def dfm_select(d: Dfm, terms: Sequence[str]) -> Dfm:
    """Keep features named exactly as given."""
    terms = sorted(set(terms))
    if d.rows is not None:
        rows = d.rows.withColumn("counts", F.filter("counts", lambda c: c["term"].isin(terms)))
        return Dfm(docs=d.docs, rows=rows, id_col=d.id_col, value_type=d.value_type)
    return Dfm(docs=d.docs, long_df=d.long_df.filter(F.col("term").isin(terms)),
               id_col=d.id_col, value_type=d.value_type)


def term_totals(d: Dfm) -> DataFrame:
    """``(term, nb_terms, nb_docs)``: total frequency and document frequency in
    one aggregate (A1, A2; J1 needs no join). Partial aggregation before the
    shuffle keeps a hot term to one row per map task. Single words are counted from the
    tokens and their distinct ones, n-grams from the words, a piece of documents at a time:
    neither needs the counts of each document."""
    if d.words is not None:
        words, col, sizes = d.words
        if sizes == (1,):
            own = words.select(F.col(col).alias("__tokens"), fence(F.array_distinct(F.col(col))).alias("__own"))
            # the distinct terms of a document come first
            each = own.select(F.size("__own").alias("k"), F.posexplode(F.concat("__own", "__tokens")).alias("p", "term"))
            return each.where(F.col("term").isNotNull()).groupBy("term").agg(
                F.count_if(F.col("p") >= F.col("k")).alias("nb_terms"), F.count_if(F.col("p") < F.col("k")).alias("nb_docs"))
        return gram_totals(words, sizes, tokens_col=col).select("term", F.col("n").alias("nb_terms"), "nb_docs")
    return d.long.groupBy("term").agg(F.sum("n").alias("nb_terms"),
                                      F.count_if(F.col("n") > 0).alias("nb_docs"))


def trim_features(d: Dfm, min_termfreq: int | None) -> Dfm:
    """Keep features whose total frequency is ``>= min_termfreq`` (M4, M5);
    0 or None is no trim. The kept-term set grows with the vocabulary: AQE
    broadcasts it when its measured size is small, else it is joined back by
    shuffle and AQE splits a skewed term partition. Call it on a
    materialized dfm."""
    if not min_termfreq or min_termfreq <= 0:
        return d
    kept = (d.long.groupBy("term").agg(F.sum("n").alias("tot"), F.count(F.lit(1)).alias(TERM_ROWS))
            .filter(F.col("tot") >= min_termfreq).select("term", TERM_ROWS))
    # AQE measures the kept-term table at run time and broadcasts it when it
    # is small (spark.sql.adaptive.autoBroadcastJoinThreshold); a count of
    # it here would cost one more pass over the dfm
    long_df = d.long.join(kept, "term").select(d.id_col, "term", "n", TERM_ROWS)
    return Dfm(docs=d.docs, long_df=long_df, id_col=d.id_col, value_type=d.value_type)


def group_documents(d: Dfm, by: str) -> Dfm:
    """Sum counts of documents sharing a docvar value (M6). NULL groups are
    dropped; the groups become the documents (N = number of groups)."""
    long_df = (d.long_with([by]).filter(F.col(by).isNotNull())
               .groupBy(by, "term").agg(F.sum("n").alias("n")))
    docs = d.docs.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("ndocs"))
    return Dfm(docs=docs, long_df=long_df, id_col=by, value_type=d.value_type)


def weight(d: Dfm, scheme: str = "count") -> Dfm:
    """Weights (M7-M11): count | relfreq | relmaxfreq | logfreq | tfidf.

    Per-document totals are computed inside the row for a nested dfm and by
    an aggregate joined back for a long one; tf-idf joins the
    document frequency of each term (one aggregate by term)."""
    if scheme in ("count", "frequency"):
        return d
    idc = d.id_col
    if scheme in ("relfreq", "relmaxfreq", "logfreq") and d.rows is not None:
        if scheme == "logfreq":
            val = lambda c: (1 + F.log10(c["n"]))
            rows = d.rows
        else:
            agg = (F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
                   if scheme == "relfreq" else F.array_max(F.transform("counts", lambda c: c["n"])))
            # fenced: else it is copied into the lambda and folded again for every term
            rows = d.rows.withColumn("__tot", fence(agg))
            val = lambda c: c["n"] / F.col("__tot")
        rows = rows.withColumn("counts", F.transform(
            "counts", lambda c: F.struct(c["term"].alias("term"), val(c).cast("double").alias("n"))))
        rows = rows.drop("__tot")
        return Dfm(docs=d.docs, rows=rows, id_col=idc, value_type="double")
    long_df = d.long
    if scheme in ("relfreq", "relmaxfreq"):
        # one row per document from a partial aggregate; a window would bring
        # all terms of a (grouped) document into one task
        total = F.sum("n") if scheme == "relfreq" else F.max("n")
        long_df = long_df.join(long_df.groupBy(idc).agg(total.alias("__tot")), idc)
        val = F.col("n") / F.col("__tot")
    elif scheme == "logfreq":
        val = 1 + F.log10("n")
    elif scheme == "tfidf":
        ndoc = d.docs.agg(F.count(F.lit(1))).scalar()  # one value, no join
        if d.long_df is not None and TERM_ROWS in d.long_df.columns:
            long_df = d.long_df  # counted when it was trimmed
        else:
            dfreq = long_df.groupBy("term").agg(F.count(F.lit(1)).alias(TERM_ROWS))
            # broadcast chosen by AQE from the measured size of the term table
            long_df = long_df.join(dfreq, "term")
        val = F.col("n") * F.log10(ndoc / F.col(TERM_ROWS))
    else:
        raise ValueError(f"unknown weight scheme {scheme!r}")
    long_df = long_df.select(idc, "term", val.cast("double").alias("n"))
    return Dfm(docs=d.docs, long_df=long_df, id_col=idc, value_type="double")


def presence(d: Dfm) -> Dfm:
    """Counts to presence (M12): 1 where the value is above 0, else 0."""
    if d.rows is not None:
        rows = d.rows.withColumn("counts", F.transform(
            "counts", lambda c: F.struct(c["term"].alias("term"), (c["n"] > 0).cast("bigint").alias("n"))))
        return Dfm(docs=d.docs, rows=rows, id_col=d.id_col)
    return Dfm(docs=d.docs, long_df=d.long_df.withColumn("n", (F.col("n") > 0).cast("bigint")),
               id_col=d.id_col)


def _add_term(t: str, zero: Column):
    return lambda a, c: a + F.when(c["term"] == t, c["n"]).otherwise(zero)


def to_wide(d: Dfm, terms: Sequence[str]) -> DataFrame:
    """Wide frame with one column per *chosen* term, every document present,
    0 where absent (M13). Never a vocabulary-wide pivot."""
    terms = list(dict.fromkeys(terms))
    idc = d.id_col
    zero = F.lit(0).cast(d.value_type)
    if d.rows is not None:
        hits = F.filter("counts", lambda c: c["term"].isin(terms))
        rows = d.rows.withColumn("__hits", hits)
        cols = [F.aggregate("__hits", zero, _add_term(t, zero)).alias(t) for t in terms]
        return rows.select(idc, *cols)
    sums = (d.long_df.filter(F.col("term").isin(terms)).groupBy(idc)
            .agg(*[F.sum(F.when(F.col("term") == t, F.col("n"))).alias(t) for t in terms]))
    return (d.docs.select(idc).join(sums, idc, "left")
            .select(idc, *[F.coalesce(F.col(f"`{t}`"), zero).alias(t) for t in terms]))


def ndoc(d: Dfm) -> DataFrame:
    return d.ndoc()


def dfm_from_text(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Dfm:
    """dfm straight from texts with the library defaults (M2): lowercase,
    punctuation and numbers kept."""
    from ..options import RAW
    from .tokens import tokenize
    opts = RAW.__class__(**{**RAW.__dict__, "lowercase": True})
    return dfm(tokenize(docs, opts, text_col), id_col=id_col)
