"""Ranks of rows without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import reliable

#: Rows that one task sorts.
TASK_ROWS = 500_000


def numbered(rows: DataFrame, *order: Column, name: str = "ix") -> DataFrame:
    """The rows with their rank (from 0) by `order`, which should tell them apart.

    Rows are dealt by ranges and sorted; a rank is the place in a partition and the sizes of those before it,
    a table with one row for each partition.
    """
    tasks = rows.count() // TASK_ROWS + 1
    keyed = rows.withColumns({f"_k{i}": c for i, c in enumerate(order)})
    keys = [f"_k{i}" for i in range(len(order))]
    at = F.monotonically_increasing_id()
    placed = reliable(keyed.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).select(*rows.columns, at.alias("_at")))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(within) + 1).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    offsets = F.broadcast(reliable(sizes.select("_part", before.alias("_before"))))
    return placed.join(offsets, part == offsets["_part"]).select(*rows.columns, (within + F.col("_before")).alias(name))
