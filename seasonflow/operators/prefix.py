"""Distributed prefix scans: running sums of many columns at once over one global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonflow.functions.core import written


def prefix_scan(df: DataFrame, order: list[str], sums: list[str], by: list[str] = (), parts: int | None = None) -> DataFrame:
    """df with before_<c>, the sum of c over the rows of the group that come earlier, and all_<c>, over the whole group.

    Rows are dealt into ranges of group and order (`parts`, else as many as Spark makes of them) and written with the
    number of their range, so that a task which runs again finds the same ranges. A range's totals are one row for each
    group in it; running sums of these are the offsets, and one more pass adds the running sums within the range. All
    columns share both passes. `order` has to be a key of the group, as rows that are equal in it have no order. A null
    counts as 0 in what comes after it; its own row's sums are null.
    """
    by = list(by)
    cols = [*by, *order]
    dealt = (df.repartitionByRange(parts, *cols) if parts else df.repartitionByRange(*cols)).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "scan")
    totals = dealt.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each range and group
    offsets = totals.select(
        *by, "_part", *[(F.sum(f"_t_{c}").over(group.orderBy("_part")) - F.col(f"_t_{c}")).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(group).alias(f"all_{c}") for c in sums]
    )
    inner = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.select("*", *[(F.sum(c).over(inner) - F.col(c)).alias(f"_b_{c}") for c in sums])
    here = run.join(offsets, [*by, "_part"])
    return here.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_b_{c}")).alias(f"before_{c}") for c in sums], *[f"all_{c}" for c in sums])
