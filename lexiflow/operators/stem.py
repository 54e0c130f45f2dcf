"""Stemming of dfm features (M3): a table of terms and stems, joined to the dfm.

The mapping is a DataFrame, so any stemmer's table can be given. ``suffix_mapping``
derives one from the vocabulary with built-in expressions: the longest listed
suffix is cut when at least ``min_stem`` letters stay; parts of n-gram features
are stemmed one by one. AQE broadcasts the mapping when its measured size is
small; otherwise the join is a shuffle join whose skewed partitions AQE splits.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dfm import Dfm

# Inflectional suffixes per language.
SUFFIXES = {
    "english": ["ations", "ation", "ings", "ing", "edly", "ed", "ies", "es", "s", "ly", "ness", "ment", "ments"],
    "french": ["ations", "ation", "ements", "ement", "ments", "ment", "euses", "euse", "eaux", "eux", "es", "er", "ez", "e", "s"],
    "german": ["ungen", "ung", "heiten", "heit", "keiten", "keit", "lichen", "lich", "en", "er", "es", "em", "e", "n", "s"],
    "spanish": ["aciones", "ación", "amente", "mente", "ados", "ado", "idas", "ida", "os", "as", "es", "o", "a", "e", "s"],
}
LANGUAGES = tuple(SUFFIXES)


def suffix_pattern(suffixes: Sequence[str], min_stem: int = 3) -> str:
    """Its first group is the word without its longest listed suffix."""
    return f"^(.{{{min_stem},}}?)(?:{'|'.join(suffixes)})$"


def suffix_stem(term: Column | str, language: str = "english", min_stem: int = 3) -> Column:
    term = F.col(term) if isinstance(term, str) else term
    if language not in SUFFIXES:
        raise ValueError(f"language must be one of {LANGUAGES}")
    pattern = suffix_pattern(SUFFIXES[language], min_stem)

    def one(part: Column) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(part, pattern, 1), F.lit("")), part)
    return F.array_join(F.transform(F.split(term, "_"), one), "_")


def suffix_mapping(terms: DataFrame, language: str = "english", min_stem: int = 3) -> DataFrame:
    """``term, stem`` for a DataFrame of distinct terms."""
    return terms.select("term", suffix_stem("term", language, min_stem).alias("stem"))


def stem_features(d: Dfm, mapping: DataFrame | str = "english") -> Dfm:
    """Replace features by their stems and merge counts (M3). ``mapping`` is a
    table ``term, stem`` (terms it lacks stay) or a language of ``SUFFIXES``,
    whose stems are computed in the row without a join."""
    if isinstance(mapping, str):
        long_df = d.long.select(d.id_col, suffix_stem("term", mapping).alias("term"), "n")
    else:
        long_df = d.long.join(mapping, "term", "left") \
            .select(d.id_col, F.coalesce("stem", "term").alias("term"), "n")
    long_df = long_df.groupBy(d.id_col, "term").agg(F.sum("n").alias("n"))
    return Dfm(docs=d.docs, long_df=long_df, id_col=d.id_col, value_type=d.value_type)
