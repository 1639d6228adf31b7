"""Facts from JSON, YAML, CSV, XML and binary documents, by a declared schema; and back.

Readers of files are Spark's own, so they run in parallel and read only what
a plan needs; columns of documents are parsed where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PathError(ValueError):
    pass


STEP = re.compile(r"\.([A-Za-z_]\w*)|\[(\*|-?\d+|'[^']*'|\"[^\"]*\")\]")


def steps(path: str) -> list[str | int]:
    """``$.a.b[*]`` as its steps; ``*`` is every element."""
    path = path.strip()
    at = 1 if path.startswith("$") else 0
    if not path.startswith(("$", ".", "[")):
        path = "." + path
    out: list[str | int] = []
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise PathError(f"bad path {path!r}")
        cell = m[1] or m[2].strip("'\"")
        out.append(int(cell) if re.fullmatch(r"-?\d+", cell) and not m[1] else cell)
        at = m.end()
    return out


def envelope(path: list[str | int], leaf: T.DataType) -> T.DataType:
    """The schema of a document that has ``leaf`` at the path: only this much is parsed."""
    kind = leaf
    for step in reversed(path):
        kind = T.ArrayType(kind) if step == "*" or isinstance(step, int) else T.StructType([T.StructField(step, kind)])
    return kind


def _at(df: DataFrame, path: list[str | int], column: str, keep: list[str], first: bool) -> DataFrame:
    df = df.select(*keep, F.col(column).alias("_v"))
    for step in path:
        if step == "*" and first:
            value: Column = F.try_element_at("_v", F.lit(1))
        elif step == "*":
            value = F.explode("_v")
        elif isinstance(step, int):
            value = F.try_element_at("_v", F.lit(step + 1 if step >= 0 else step))
        else:
            value = F.col("_v").getField(step)
        df = df.select(*keep, value.alias("_v"))
    return df.where(F.col("_v").isNotNull())


def json_facts(df: DataFrame, column: str, schema: T.StructType, path: str = "$", first: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Facts of a JSON column: the object itself, or all (or the first) at a path.  Documents that do not parse raise."""
    keep = keep or []
    way = steps(path)
    parsed = df.withColumn("_doc", F.from_json(column, envelope(way, schema), {"mode": "FAILFAST"}))
    return _at(parsed, way, "_doc", keep, first).select(*keep, "_v.*")


def csv_facts(spark: SparkSession, path: str, schema: T.StructType, where: str | None = None) -> DataFrame:
    """Rows of CSV files with a header; ``where`` keeps some.  Columns that the schema lacks are not read."""
    df = spark.read.csv(path, header=True)
    df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    return df.where(where) if where else df


def xml_facts(spark: SparkSession, path: str, schema: T.StructType, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def xml_column(df: DataFrame, column: str, schema: T.StructType, keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    return df.select(*keep, F.from_xml(F.col(column), schema.simpleString()).alias("_v")).select(*keep, "_v.*")


def csv_column(df: DataFrame, column: str, schema: T.StructType, keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    return df.select(*keep, F.from_csv(F.col(column), schema.simpleString()).alias("_v")).select(*keep, "_v.*")


def yaml_facts(df: DataFrame, column: str, schema: T.StructType, path: str = "$", first: bool = False, keep: list[str] | None = None) -> DataFrame:
    """As ``json_facts``; YAML is turned into JSON in Arrow batches, as Spark has no reader of it."""
    keep = keep or []

    @F.pandas_udf("string")
    def to_json(s):
        import json

        import yaml

        return s.map(lambda x: None if x is None else json.dumps(yaml.safe_load(x), default=str))

    return json_facts(df.withColumn("_json", to_json(F.col(column))), "_json", schema, path, first, keep)


def binary_facts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet in place of a binary layout that only its own library reads."""
    return spark.read.schema(schema).parquet(path)


def serialise(df: DataFrame, form: str, name: str = "document") -> DataFrame:
    """Each row as one JSON, CSV, XML or YAML text."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    if form == "json":
        return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias(name))
    if form == "csv":
        return df.select(F.to_csv(row).alias(name))
    if form == "xml":
        return df.select(F.to_xml(row).alias(name))
    if form == "yaml":  # JSON is YAML
        return serialise(df, "json", name)
    raise ValueError(f"unknown form {form!r}")


def chunks(df: DataFrame, form: str, size: int = 1 << 16) -> Iterator[bytes]:
    """The rows' texts, a line each, in pieces of ``size`` bytes; the driver holds one partition and one piece at a time."""
    held = bytearray()
    for (text,) in serialise(df, form).toLocalIterator(prefetchPartitions=True):
        held += (text or "").encode() + b"\n"
        while len(held) >= size:
            yield bytes(held[:size])
            del held[:size]
    if held:
        yield bytes(held)


def write(df: DataFrame, path: str, form: str, **options) -> None:
    writer = df.write.options(**options)
    writer.format(form).save(path)


def single(df: DataFrame):
    """The only row; anything else raises."""
    got = df.limit(2).collect()
    if len(got) != 1:
        raise ValueError(f"expected one row, found {'none' if not got else 'more'}")
    return got[0]
