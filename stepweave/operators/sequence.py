"""Features of ordered steps by window functions. A window holds one episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_episode(*order: str) -> WindowSpec:
    return Window.partitionBy("dataset", "episode_id").orderBy(*order)


def with_change_index(df: DataFrame, value: str, window: WindowSpec, name: str) -> DataFrame:
    """name: how often the value has changed so far, from -1; the value before the first is null."""
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(window))).cast("bigint")
    return df.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).drop("_changed")


def history(value: Column, window: WindowSpec, missing: str = "unknown") -> Column:
    """Array of the values before the current row, in order."""
    return F.collect_list(F.coalesce(value, F.lit(missing))).over(window.rowsBetween(Window.unboundedPreceding, -1))


def effect(value: Column, window: WindowSpec) -> Column:
    """Whether the value differs in the next row; against null in the last."""
    return ~value.eqNullSafe(F.lead(value).over(window))


def is_last(window: WindowSpec) -> Column:
    return F.lead(F.lit(1)).over(window).isNull()


def leading_true(flags: Column) -> Column:
    """Length of the run of true at the start of an array of booleans; null ends it."""
    stop = F.array_position(F.transform(flags, lambda x: F.coalesce(x, F.lit(False))), False)
    return F.when(stop == 0, F.size(flags)).otherwise(stop - 1).cast("bigint")
