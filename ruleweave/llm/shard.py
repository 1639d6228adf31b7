"""Sharding by bytes: prefix sums over a global order, cut at equal targets.

Law ``bytes``: shards are contiguous ranges of the order (doc_id, then read
order) whose sizes differ from total / shards by at most one document's size.
No task sees more than one range partition, and the driver sees nothing: the
totals of the partitions, one row each, are summed by a window over them.

Null ids come first; a null text has no bytes, so its size is the constant
alone; repeated rows are rows of their own; an empty table gives no rows.
A row's shard holds the middle of its byte interval, so a document longer than
a whole shard leaves shards empty rather than moving others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, with_rid

OVERHEAD = 16


def prefix_order(df: DataFrame, key: str, size: str) -> DataFrame:
    """Adds ``_row`` (gapless from 0, in the order of key), ``_before`` (bytes of earlier rows) and ``_total``.

    ``df`` must be narrow and have ``_rid``; it is written once in range partitions.
    """
    parts = spread(df, key, "_rid")
    totals = parts.groupBy("_pid").agg(F.count("*").alias("_n"), F.sum(size).alias("_b"))
    # One row for each partition: bounded by the number of partitions, not by the rows.
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select("_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("_b0"), F.sum("_b").over(whole).alias("_total"))
    within = Window.partitionBy("_pid").orderBy(F.col(key).asc_nulls_first(), "_rid")
    here = parts.select("*", (F.row_number().over(within) - 1).alias("_i"), (F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)).alias("_s"))
    return here.join(starts, "_pid").withColumns({"_row": F.col("_n0") + F.col("_i"), "_before": F.col("_b0") + F.col("_s")}).drop("_n0", "_b0", "_i", "_s")


def shard_by_bytes(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: key, size, text_crc32, shard, slot.  The text itself never moves."""
    narrow = with_rid(df.select(F.col(key).alias("doc_id"), F.col(text).alias("_t"))).select(
        "doc_id",
        "_rid",
        (F.coalesce(F.octet_length("_t"), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(F.encode("_t", "UTF-8"), F.lit(b""))).alias("text_crc32"),
    )
    placed = prefix_order(narrow, "doc_id", "size")
    middle = F.col("_before") * 2 + F.col("size")
    at = F.expr(f"middle * {int(shards)} div (2 * _total)")
    placed = placed.withColumn("middle", middle).withColumn("shard", F.least(F.lit(shards - 1).cast("long"), at).cast("int"))
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    # At most ``shards`` rows, so a broadcast of a fixed size.
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot"))
