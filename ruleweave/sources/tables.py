"""Fact types over tables of a folder, read as they are: no copy, so filters and columns reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compiler import FID
from ..lang.parser import AGGREGATES, parse
from ..plans.match import Match, Planner, output

TABLES = {
    "Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"),
    "Order": ("orders", "o_orderkey"), "LineItem": ("lineitem", None), "Event": ("events", "event_id"), "Document": ("documents", "doc_id"), "Embedding": ("embeddings", "vec_id"),
    "Page": ("pages", "page_id"), "Benchmark": ("benchmark", "item_id"), "Label": ("labels", None), "Conversation": ("conversations", None),
}


def milliseconds(time: Column, nearest: bool = False) -> Column:
    """A time in whole milliseconds: those that are over, or the nearest ones (halves away from 0), as ``epoch_ms`` of the SQL has it."""
    if not nearest:
        return F.unix_millis(time)
    micros = F.unix_micros(time)
    return F.call_function("div", micros + F.when(micros < 0, -500).otherwise(500), F.lit(1000))


def table(spark: SparkSession, sf_dir: str, type_name: str, nearest: bool = False) -> DataFrame:
    """The facts of a type; events have their time in milliseconds, and their kind as the entry point."""
    name, key = TABLES[type_name]
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "events":
        df = df.withColumn("timestamp", milliseconds(F.col("ts").cast("timestamp"), nearest))
    return df.withColumn(FID, F.col(key).cast("long")) if key else df


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them."""
    batch = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(batch.schema)
    if any(f.rsplit("/", 1)[-1] == f"{name}.parquet" for f in batch.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def planner(spark: SparkSession, sf_dir: str, text: str, nearest: bool = False, **options) -> Planner:
    def facts(type_name: str, entry_point: str | None) -> DataFrame:
        df = table(spark, sf_dir, type_name, nearest)
        if entry_point is None:
            return df
        if type_name != "Event":
            raise ValueError(f"no entry point {entry_point!r} of {type_name}")
        return df.where(F.col("event_type") == entry_point)

    return Planner(spark, parse(text, (*AGGREGATES, *options.get("aggregates", ()))), facts, **options)


def ask(spark: SparkSession, sf_dir: str, text: str, query: str = "q", **options) -> Match:
    """Matches of a query over the tables; a text without ``query`` is the body of one."""
    if "query " not in text:
        text = f'query "{query}" {text} end'
    return planner(spark, sf_dir, text, **options).query(query)


def rows(spark: SparkSession, sf_dir: str, text: str, *columns: str, **options) -> DataFrame:
    """Columns of a query's matches: ``binding.field AS name`` or any expression of ``binding__field``."""
    m = ask(spark, sf_dir, text, **options)
    return m.df.selectExpr(*columns) if columns else output(m)
