"""Document filters on docvars (F1-F5). Plain ``filter`` calls: Catalyst
combines them and pushes them into the scan when the docvar is a column of
the source."""
from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NA = "NA"


def filter_range(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    """Inclusive numeric range (F1); NULL values are dropped."""
    c = F.col(col)
    cond = c.isNotNull()
    if lo is not None:
        cond = cond & (c >= F.lit(lo))
    if hi is not None:
        cond = cond & (c <= F.lit(hi))
    return df.filter(cond)


def _date(v):
    if v is None or isinstance(v, _dt.date):
        return v
    return _dt.date.fromisoformat(str(v))


def filter_date_range(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    """Inclusive date range (F2), on a typed date (timestamps cast to date)."""
    c = F.col(col).cast("date")
    cond = c.isNotNull()
    if start is not None:
        cond = cond & (c >= F.lit(_date(start)))
    if end is not None:
        cond = cond & (c <= F.lit(_date(end)))
    return df.filter(cond)


def filter_in(df: DataFrame, col: str, values: Sequence | None) -> DataFrame:
    """Membership (F3); ``"NA"`` (or None) selects NULL; nothing chosen means
    no filter."""
    if not values:
        return df
    vals = [v for v in values if v is not None and v != NA]
    want_null = any(v is None or v == NA for v in values)
    c = F.col(col)
    cond = c.isin(vals) if vals else F.lit(False)
    if want_null:
        cond = cond | c.isNull()
    return df.filter(cond)


def domains_of(domains_df: DataFrame) -> dict:
    """Driver-side dict of a ``docvar_domains`` result (one row per docvar,
    so bounded by the schema width): name → (min, max) strings or levels."""
    out = {}
    for r in domains_df.collect():
        if r["levels"] is not None:
            out[r["name"]] = list(r["levels"])
        else:
            out[r["name"]] = (r["min_value"], r["max_value"])
    return out


def _is_full(v, dom) -> bool:
    """Does a filter value select the whole domain of its docvar?"""
    if dom is None:
        return False
    if isinstance(dom, tuple):
        if not (isinstance(v, tuple) and len(v) == 2):
            return False
        return all(a is not None and str(a) == str(b) or
                   (a is not None and b is not None and _num_eq(a, b)) for a, b in zip(v, dom))
    chosen = {NA if x is None else str(x) for x in v}
    return set(dom) <= chosen


def _num_eq(a, b) -> bool:
    try:
        return float(a) == float(b)
    except (TypeError, ValueError):
        return False


def filter_documents(df: DataFrame, spec: Mapping[str, object], domains: Mapping | None = None) -> DataFrame:
    """All filters, one after the other (F4). Spec values: ``(lo, hi)`` for a
    numeric or date range, a list/set of levels for membership. With
    ``domains`` (see ``domains_of``), a filter that selects a docvar's whole
    domain is not applied, as the explorer does (documents with a NULL value
    then stay)."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for col, v in spec.items():
        if col not in fields:
            raise ValueError(f"unknown docvar {col!r}")
        if domains is not None and _is_full(v, domains.get(col)):
            continue
        t = fields[col]
        if isinstance(v, tuple) and len(v) == 2 and t in ("date", "timestamp", "timestamp_ntz"):
            df = filter_date_range(df, col, *v)
        elif isinstance(v, tuple) and len(v) == 2 and t != "string":
            df = filter_range(df, col, *v)
        else:
            df = filter_in(df, col, list(v))
    return df
