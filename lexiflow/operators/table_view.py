"""Result table view: search box, column filters, sort and paging (O1, O2,
F11, F12)."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_SIZES = (10, 20, 30, 50, 100)


def table_filter(df: DataFrame, search: str | None = None,
                 filters: Mapping[str, object] | None = None) -> DataFrame:
    """Search box (any column contains the text, case-insensitive) and
    per-column filters: a string (contains), a ``(lo, hi)`` range or a list
    of values (F11)."""
    if search:
        s = search.lower()
        cond = None
        for c in df.columns:
            ci = F.coalesce(F.lower(F.col(c).cast("string")).contains(s), F.lit(False))
            cond = ci if cond is None else (cond | ci)
        df = df.filter(cond)
    for c, v in (filters or {}).items():
        if isinstance(v, str):
            df = df.filter(F.lower(F.col(c).cast("string")).contains(v.lower()))
        elif isinstance(v, tuple) and len(v) == 2:
            df = df.filter(F.col(c).between(v[0], v[1]))
        else:
            df = df.filter(F.col(c).isin(list(v)))
    return df


def table_view(df: DataFrame, order_by: str, descending: bool = True, page: int = 1,
               size: int = 20, search: str | None = None,
               filters: Mapping[str, object] | None = None,
               columns: Sequence[str] | None = None) -> DataFrame:
    """One page of a result table sorted by a column, ties broken by the
    other columns so the page is stable (O1, O2, F12)."""
    df = table_filter(df, search, filters)
    if columns:
        df = df.select(*columns)
    key = F.col(order_by).desc_nulls_last() if descending else F.col(order_by).asc_nulls_first()
    ties = [F.col(c).asc_nulls_first() for c in df.columns if c != order_by]
    size = max(1, int(size))
    return df.orderBy(key, *ties).offset((max(1, int(page)) - 1) * size).limit(size)
