"""Helpers on DataFrames: checked broadcasts, positions without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is that small; otherwise as it is, and Spark plans the join by its own estimates."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df


def with_position(df: DataFrame, key: str, name: str, width: int = 1 << 16) -> DataFrame:
    """``name``: the number of rows with a smaller ``key`` (a distinct non-negative long), without sorting all rows at once.

    Rows are counted in runs of ``width`` keys; only the run counts are ordered globally.
    """
    rows = df.withColumn("_run", F.floor(F.col(key) / width))
    runs = rows.groupBy("_run").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_run", before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_run").orderBy(key)) - 1
    return rows.withColumn("_inner", inner).join(runs, "_run").withColumn(name, F.col("_before") + F.col("_inner")).drop("_run", "_inner", "_before")


def first_by(df: DataFrame, keys: list[str], order: list[Column], name: str = "_rank", keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each group; the limit is applied before the shuffle, too."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn(name, rank).where(F.col(name) <= keep)
    return out.drop(name) if name == "_rank" else out


def running_before(df: DataFrame, first: list[str], time: str, last: list[str], value: str, name: str, width: int = 64) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before, in the order (``first``, ``time``, ``last``), without sorting all rows at once.

    ``time`` is a whole number. Values are summed in runs of ``width`` times; only the sums of runs are ordered globally.
    """
    rows = df.withColumn("_run", F.floor(F.col(time) / width))
    runs = rows.groupBy(*first, "_run").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy(*first, "_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*first, "_run", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*first, "_run").orderBy(time, *last).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(runs, [*first, "_run"])
    return rows.withColumn(name, F.col("_before") + F.col("_inner")).drop("_run", "_inner", "_before")
