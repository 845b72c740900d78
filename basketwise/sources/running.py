"""Running sums in an order, over all rows or within groups, without one task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketwise.sources.scratch import written


def running_sum(df: DataFrame, order: Sequence[str | Column], value: str | Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """df with `name`: the sum of value over the rows of the group up to and with this one, in the order given; the order
    should have no ties. Nulls add nothing.

    Rows are range-sorted and written with their partition. Sums of each (group, partition) are few; each adds those of
    the partitions before it, and a window runs inside a partition only. So a group that holds most rows is spread over
    as many tasks as it fills.
    """
    value = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))
    own = df.select("*", value.alias("_v")).orderBy(*by, *order)
    here = own.select(F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"), "*")
    here = written(here, "running")
    totals = here.groupBy("_p", *by).agg(F.sum("_v").alias("_t"))
    if by:
        before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
        starts = totals.select("_p", *by, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
        starts = starts.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], "_start")
        same = F.col("_p") == F.col("_q")
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
        joined = here.join(starts, same).drop("_q", *[f"_g{i}" for i in range(len(by))])
    else:
        rows, at, sums = [], None, sorted((r["_p"], r["_t"]) for r in totals.collect())  # one row a partition
        for p, t in sums:
            rows.append((p, at if at is not None else t - t))
            at = t if at is None else at + t
        kind = totals.schema["_t"].dataType.simpleString()
        starts = df.sparkSession.createDataFrame(rows, f"_p int, _start {kind}")
        joined = here.join(F.broadcast(starts), "_p")
    inside = F.sum("_v").over(Window.partitionBy("_p", *by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return joined.select(*df.columns, (F.col("_start") + inside).alias(name))
