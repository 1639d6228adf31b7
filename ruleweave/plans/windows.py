"""Running windows as single sorts, where a correlated count would be a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_length(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, name: str) -> DataFrame:
    """The mean of the last ``size`` values of the same keys, each row's own included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(size - 1), 0)
    return df.withColumn(name, F.avg(value).over(w))


#: Ids that one task sorts at most.
STRETCH = 1 << 18


def previous(df: DataFrame, id_column: str, value: str, out: str) -> DataFrame:
    """``out``: each row's ``value`` in the row before it by a whole id, null in the first.

    One window over all rows would sort them in one task.  So a task takes the ids
    of one stretch; what a stretch begins after comes from one row for each of them.
    """
    run = F.call_function("div", F.col(id_column), F.lit(STRETCH))
    cut = df.withColumn("_run", run)
    lasts = cut.groupBy("_run").agg(F.max_by(F.struct(F.col(value).alias("v")), id_column).alias("_last"))
    before = lasts.select(F.col("_run").alias("_at"), F.lag("_last").over(Window.orderBy("_run")).alias("_before"))
    here = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy("_run").orderBy(id_column))
    joined = cut.withColumn("_here", here).join(F.broadcast(before), F.col("_run") == F.col("_at"), "left")
    return joined.withColumn(out, F.coalesce("_here", "_before")["v"]).drop("_run", "_here", "_at", "_before")
