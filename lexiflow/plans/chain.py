"""The corpus explorer's computation chain as one lazy plan (§3.1):
filter documents → tokens → dictionary → stop words → n-grams → dfm →
stem → trim. Nothing runs until the caller acts on a result."""
from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.dfm import Dfm, dfm, trim_features
from ..operators.filters import filter_documents
from ..operators.stem import stem_features
from ..operators.tokens import clean_tokens
from ..options import TextOptions


@dataclass
class CorpusView:
    """Results shared by the explorer's tabs: the filtered corpus, its
    cleaned tokens and its dfm. Callers may ``persist`` ``tokens`` when
    several results are drawn from it."""

    corpus: DataFrame
    tokens: DataFrame
    dfm: Dfm


def explore(corpus_df: DataFrame, opts: TextOptions = TextOptions(),
            filters: Mapping[str, object] | None = None, domains: Mapping | None = None) -> CorpusView:
    """``domains`` (from ``operators.filters.domains_of``) lets filters that
    select a docvar's whole domain be skipped, as the explorer does."""
    docs = filter_documents(corpus_df, filters or {}, domains)
    toks = clean_tokens(docs, opts)
    d = dfm(toks)
    if opts.min_termfreq and opts.min_termfreq > 0:
        # trim reads the counts twice: compute and store them once
        d = d.materialize()
    if opts.stem_language:
        d = stem_features(d, opts.stem_language)
    d = trim_features(d, opts.min_termfreq)
    return CorpusView(corpus=docs, tokens=toks, dfm=d)
