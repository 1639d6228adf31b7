"""Stream operators that structured streaming runs by itself, with bounded state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.memory import shared_dir


def once_each(stream: DataFrame, event_id: str, time: str, lateness: str) -> DataFrame:
    """The first event of each id; state goes as the watermark passes."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([event_id])


def in_time(df: DataFrame, time_ms: str, watermark: int, lateness_ms: int = 0, max_future_ms: int = 86_400_000) -> DataFrame:
    """Events that are neither too late nor too far ahead of a watermark."""
    t = F.col(time_ms)
    return df.where((t >= watermark - lateness_ms) & (t <= watermark + max_future_ms))


def retained(df: DataFrame, time_ms: str, watermark: int, retention_ms: int) -> DataFrame:
    return df.where(F.col(time_ms) > watermark - retention_ms)


def within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, ms: int) -> DataFrame:
    """Pairs of the same key at most ``ms`` apart; of two streams with watermarks this is an interval join."""
    span = F.expr(f"INTERVAL {ms} MILLISECONDS")
    a, b = F.col(left_time), F.col(right_time)
    return left.join(right, (F.col(f"l_{key}") == F.col(f"r_{key}")) & (b >= a - span) & (b <= a + span))


def collect_stream(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives its output as a table of the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/ruleweave-stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
