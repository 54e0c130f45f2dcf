"""Pages of a large sorted result (Q10, O2).

``orderBy().offset(k).limit(n)`` makes one task sort out the first ``k + n``
rows, so the millionth page costs a million pages. Here the result is stored once,
range-partitioned by its order with every row numbered inside its
partition; a page is then read from the one or two partitions that hold it."""
from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import storage_folder

#: ``monotonically_increasing_id`` keeps a row's place in its task in these bits.
_PLACE = (1 << 33) - 1


@dataclass
class PagedResult:
    """A stored result: ``rows`` by partition, and the rows before each partition."""

    rows: DataFrame
    before: list[tuple[int, int, int]]  # partition, rows before it, rows in it
    columns: list[str]

    @property
    def total(self) -> int:
        return self.before[-1][1] + self.before[-1][2] if self.before else 0

    def slice(self, start: int, size: int) -> DataFrame:
        """Rows ``start … start + size - 1`` (from 1) in order."""
        if int(start) < 1 or int(size) < 1:
            raise ValueError("start and size must be 1 at least")
        lo, hi = int(start) - 1, int(start) - 1 + int(size)
        wanted = None
        for part, first, n in self.before:
            if first < hi and first + n > lo:
                own = (F.col("__part") == part) & (F.col("__place") >= lo - first) & (F.col("__place") < hi - first)
                wanted = own if wanted is None else wanted | own
        found = self.rows.where(F.lit(False) if wanted is None else wanted)
        return found.orderBy("__part", "__place").select(*self.columns)

    def page(self, number: int, size: int = 20) -> DataFrame:
        size = max(1, int(size))
        return self.slice((max(1, int(number)) - 1) * size + 1, size)


def store_pages(df: DataFrame, *order: Column | str, partitions: int | None = None) -> PagedResult:
    """Store ``df`` in the given order (make it total: add an id) for reading
    by page. One range shuffle; the table of partitions (their number is set by
    the session or ``partitions``, not by the rows) is what the driver keeps."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys) \
        .withColumn("__id", F.monotonically_increasing_id())
    placed = placed.select(*df.columns, F.shiftright("__id", 33).cast("int").alias("__part"),
                           F.col("__id").bitwiseAND(F.lit(_PLACE)).alias("__place"))
    path = f"{storage_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    placed.write.partitionBy("__part").parquet(path)
    rows = df.sparkSession.read.schema(placed.schema).parquet(path)
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()  # one row a partition
    before, total = [], 0
    for r in counts:
        before.append((r["__part"], total, r["n"]))
        total += r["n"]
    return PagedResult(rows, before, df.columns)
