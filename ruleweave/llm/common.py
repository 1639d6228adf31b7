"""What the operators share: reading tables, cutting lineage, global order without a single task."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_WRITTEN: list[str] = []
#: Else Spark keeps shuffle files until the driver's garbage collector comes by.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and there is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _OWN_DIR.setdefault("dir", "")
        if not found:
            folder = tempfile.mkdtemp(prefix="ruleweave-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            found = _OWN_DIR["dir"] = "file://" + folder
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there.

    Executors that are lost afterwards cost a reread, not a recomputation, and
    values that depend on the run (partition ids, row ids) are fixed from then on.
    What the write shuffled is deleted with it: no later plan can read that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ruleweave-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, was)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_cut(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote, once nothing reads it any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/ruleweave-" in name:
            _delete(df.sparkSession, name)


def written() -> int:
    """How many tables ``cut`` has written: a mark for ``drop_since``."""
    return len(_WRITTEN)


def drop_since(spark: SparkSession, mark: int) -> None:
    """Delete the tables written after a mark but the last one, which is the result that was made of them."""
    for name in _WRITTEN[mark:-1]:
        _delete(spark, name)
    del _WRITTEN[mark:-1]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """Of each of n partitions a number that hash partitioning sends there: n groups then fill n tasks."""
    near = spark.range(24 * n + 200).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    found = {r["p"]: r["id"] for r in near}
    return [found.get(i, i) for i in range(n)]


def stable(df: DataFrame) -> DataFrame:
    """``df`` itself if it only reads files, picks columns and filters; else its rows, written once.

    The former gives its rows in the same order each time that it is read, also by
    another executor; what a shuffle or a user's function gives may come in another.
    """
    todo = [df._jdf.queryExecution().optimizedPlan()]
    if not todo[0].deterministic():
        return cut(df)
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in ("Project", "Filter", "LogicalRelation", "LocalRelation"):
            return cut(df)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return df


def with_rid(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A row id that is the same each time the same files are read under the same settings.

    Two calls on one frame agree only if it is ``stable`` already.
    """
    return stable(df).withColumn(name, F.monotonically_increasing_id())


def fresh(columns: list[str], name: str) -> str:
    """A name like ``name`` that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def boxed(df: DataFrame, text: str, *made: str) -> DataFrame:
    """(_rid, _row, _text): the columns of ``df`` in a struct, so that no name of theirs clashes with an operator's.

    Columns named as in ``made`` give way to what the operator makes.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in made], F.lit(0).alias(fresh(df.columns, "_box")))
    return with_rid(df.select(row.alias("_row"), F.col(f"`{text}`").alias("_text")))


def unboxed(df: DataFrame, columns: list[str], **instead: Column) -> list[Column]:
    """The columns of the struct again, some replaced."""
    return [instead.pop(c) if c in instead else F.col("_row").getField(c).alias(c) for c in columns] + list(instead.values())


def spread(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """``df`` range-partitioned by ``keys`` with the partition's number in ``_pid``, cut there.

    The keys must end with a row id, so that a value which a third of the rows
    share still divides.  Range partitioning samples; cutting fixes what came out.
    """
    n = n or partitions(df.sparkSession)
    return cut(df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()))


class Bits:
    """A bit table of hashed longs; ``test`` lets through every value that was put in, and few others."""

    def __init__(self, table, log2: int):
        self.table, self.log2 = table, log2

    def test(self, values):
        at = bit_of(values, self.log2)
        return (self.table[at >> 3] >> (7 - (at & 7)).astype(self.table.dtype)) & 1 == 1


#: Bounds of a bit table: 8 MB to 64 MB.
LEAST_LOG2, MOST_LOG2 = 26, 29


def bitset(df: DataFrame, column: str) -> Bits:
    """The values of a long column as a table of 2^LEAST_LOG2 to 2^MOST_LOG2 bits, about 16 for each value.

    Its size is bounded, so it can be collected and broadcast; beyond the bound
    the table lets more through, and every use checks exactly afterwards.
    """
    import zlib

    import numpy as np

    df = cut(df.select(column))
    n = df.count()
    log2 = min(MOST_LOG2, max(LEAST_LOG2, (16 * n).bit_length()))

    def fill(batches):
        import pyarrow as pa

        bits = np.zeros(1 << (log2 - 3), np.uint8)
        for b in batches:
            if b.num_rows:
                at = bit_of(b.column(0).to_numpy(zero_copy_only=False), log2)
                np.bitwise_or.at(bits, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)])], ["bits"])

    out = np.zeros(1 << (log2 - 3), np.uint8)
    # A task for each eighth as many values as bits, four at least; one table at a time comes here.
    for row in df.repartition(max(4, n >> (log2 - 3))).mapInArrow(fill, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(bytes(row[0])), np.uint8)
    drop_cut(df)
    return Bits(out, log2)


def bit_of(values, log2: int):
    import numpy as np

    from .hashing import mix

    return (mix(values.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B)) >> np.uint64(64 - log2)).astype(np.int64)
