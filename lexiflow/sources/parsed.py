"""Parsed token tables from a tagger.

Tagging itself is done by external single-machine models; their output
(one row per token) is read here. The token order must be a column
(``token_pos``), never the physical row order."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYOUTS = {
    # layout: column that holds the part of speech
    "spacy": "pos",
    "udpipe": "upos",
}


def parsed_tokens(df: DataFrame, layout: str = "spacy", order_col: str = "token_pos",
                  id_col: str = "doc_id") -> DataFrame:
    """``doc_id, token_pos, token, lemma, pos`` from a spaCy- or
    udpipe-layout table; udpipe's ``upos`` becomes ``pos``."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {sorted(LAYOUTS)}")
    pos_col = LAYOUTS[layout]
    missing = [c for c in (id_col, order_col, "token", "lemma", pos_col) if c not in df.columns]
    if missing:
        raise ValueError(f"parsed table ({layout}) lacks columns {missing}")
    return df.select(F.col(id_col).alias("doc_id"), F.col(order_col).alias("token_pos"),
                     "token", "lemma", F.col(pos_col).alias("pos"))
