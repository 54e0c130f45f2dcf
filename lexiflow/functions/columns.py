"""Column helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fence(c: Column) -> Column:
    """Keep an expensive in-row column from being re-evaluated.

    Catalyst pushes filters down through projections by substituting the
    projected expressions into the filter; over a chain of array steps
    (tokens → sorted → runs → counts) that copies every step into the filter
    and evaluates it again, growing with each level. A projection holding a
    non-deterministic expression is never crossed by a pushed filter, so the
    value is wrapped in a condition on ``spark_partition_id()`` (always
    true, evaluated once per row, no other cost). Filters on source columns
    are applied before tokenization, so scan pushdown is unaffected."""
    return F.when(F.spark_partition_id() >= 0, c)
