"""Working memory: one immutable DataFrame for each fact type.

Inserted facts are a part of their own.  A change or retraction is written alone
and joined as the type is read, while such changes are small and few; then, or if
it is large, the type is written anew.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compiler import FID
from ..plans.match import ROUTE, VERSION

SYSTEM = T.StructType([T.StructField(FID, T.LongType()), T.StructField(VERSION, T.LongType()), T.StructField(ROUTE, T.StringType())])
_own: list[str] = []
_written: list[str] = []
#: Inserts after which a type's parts are written as one table.
MERGE = 16
#: Bytes of retracted ids or changed fields that are small enough to be sent to every task, and how many such changes a type takes.
SMALL, DELTAS = 8 << 20, 6
#: Ids that an insert may span before they are given anew without gaps: a partition's rows take 2^33 of them.
SPARSE = 1 << 45


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            folder = tempfile.mkdtemp(prefix="ruleweave-wm-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own.append("file://" + folder)
        found = _own[0]
    return found.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that plans do not grow from round to round."""
    path = f"{shared_dir(df.sparkSession)}/ruleweave-wm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: Column) -> DataFrame:
    """``df`` settled in this order, with ``_turn``: each row's place in it, from 0 without gaps."""
    marked = settle(df.orderBy(order).withColumn("_turn", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_turn"), 33)
    starts, at = [], 0
    for p, k in sorted((r[0], r[1]) for r in marked.groupBy(part.alias("_p")).count().collect()):  # a row for each partition
        starts.append((p, at))
        at += k
    first = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    turn = (F.col("_start") + F.pmod(F.col("_turn"), F.lit(1 << 33))).alias("_turn")
    return settle(marked.withColumn("_p", part).join(F.broadcast(first), "_p").select(*df.columns, turn))


def sweep(spark: SparkSession) -> int:
    """Deletes every table that sessions of this driver have written; for when nothing reads their facts any more."""
    jvm = spark.sparkContext._jvm
    n = len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def measured(df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
    """``df`` settled, with aggregates over its rows from the same job."""
    seen = Observation()
    out = settle(df.observe(seen, *[c.alias(n) for n, c in aggregates.items()]))
    found = seen.get
    if not found:  # the plan turned out to be empty
        row = out.agg(*[c.alias(n) for n, c in aggregates.items()]).first()
        found = row.asDict()
    return out, found


class _Counted(dict):
    """Types by name; counts how often each may have gained facts, may have lost some, and may hold other facts under old ids."""

    def __init__(self, *args):
        super().__init__(*args)
        self.gained: dict[str, int] = {}
        self.lost: dict[str, int] = {}
        self.edited: dict[str, int] = {}

    def put(self, name: str, df: DataFrame, gained: bool = True, lost: bool = True) -> None:
        self.gained[name] = self.gained.get(name, 0) + gained
        self.lost[name] = self.lost.get(name, 0) + lost
        self.edited[name] = self.edited.get(name, 0) + (gained and lost)
        super().__setitem__(name, df)

    def __setitem__(self, name: str, df: DataFrame) -> None:
        self.put(name, df)

    def restore(self, old: dict) -> None:
        for name in {*self, *old}:
            if self.get(name) is not old.get(name):
                if name in old:
                    self[name] = old[name]
                else:
                    del self[name]


class Memory:
    """Facts by type.  Ids rise with arrival; a change raises a fact's version."""

    def __init__(self, spark: SparkSession):
        self.spark, self.types, self.next_id, self._parts = spark, _Counted(), 1, {}
        self._unread: list[DataFrame] = []
        self._empty: set[str] = set()
        self._changes: dict[str, int] = {}
        self.added = 0

    def schema_of(self, name: str) -> T.StructType | None:
        return self.types[name].schema if name in self.types else None

    def facts(self, name: str, entry_point: str | None = None) -> DataFrame:
        df = self.types[name]
        # Facts of a named entry point are seen by patterns that name it, and by them alone.
        return df.where(F.col(ROUTE) == entry_point) if entry_point else df.where(F.col(ROUTE).isNull())

    def prepared(self, df: DataFrame, want: T.StructType | None, entry_point: str | None, order: list[str] | None = None) -> DataFrame:
        """``df`` with the declared fields (missing ones null), an id for each row, version 0."""
        cols = [F.col(f"`{c}`") for c in df.columns if c not in SYSTEM.names]
        if want is not None:
            cols = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields]
        if FID in df.columns:
            fid = F.col(FID).cast("long")
        else:
            if order:
                df = df.repartitionByRange(*order).sortWithinPartitions(*order)
            self.read_ids()
            fid = F.monotonically_increasing_id() + F.lit(self.next_id)
        return df.select(*cols, fid.alias(FID), F.lit(0).cast("long").alias(VERSION), F.lit(entry_point).cast("string").alias(ROUTE))

    def register(self, name: str, facts: DataFrame) -> None:
        """Facts with ids of their own that stay where they are; the ids are looked at when new ones are given out."""
        self._unread.append(facts.select(FID))
        self._put(name, facts)
        self.types.edited[name] = self.types.edited.get(name, 0) + 1  # their ids may be below others'

    def read_ids(self) -> None:
        """Ids that are given out from now on follow those of registered facts."""
        if self._unread:
            all_ = self._unread[0]
            for df in self._unread[1:]:
                all_ = all_.unionByName(df)
            self._unread = []
            self.next_id = max(self.next_id, (all_.agg(F.max(FID)).first()[0] or 0) + 1)

    def add(self, name: str, df: DataFrame, entry_point: str | None = None, want: T.StructType | None = None, order: list[str] | None = None) -> DataFrame:
        """Inserts rows; their ids follow all earlier ones.  Gives the new facts; ``added`` says how many."""
        plan = self.prepared(df, want, entry_point, order)
        new, found = measured(plan, n=F.count(F.lit(1)), top=F.max(FID))
        return self.take(name, new, found["n"], found["top"])

    def take(self, name: str, new: DataFrame, n: int, top: int | None, *aside: str) -> DataFrame:
        """Inserts facts that are settled already: n of them, the greatest id ``top``; columns ``aside`` are not theirs."""
        self.added = n
        if not n and name in self.types:
            return new
        if top is not None and top - self.next_id >= SPARSE:
            new, top = self._dense(new, n)
        if top is not None:
            self.next_id = max(self.next_id, top + 1)
        self._put(name, new.drop(*aside))
        return new

    def _dense(self, new: DataFrame, n: int) -> tuple[DataFrame, int]:
        """Ids without the gaps between partitions: a row for each partition says where its ids begin."""
        part, base = F.shiftright(F.col(FID) - self.next_id, 33), self.next_id
        counts = sorted((r[0], r[1]) for r in new.groupBy(part.alias("_p")).count().collect())
        starts, at = [], base
        for p, k in counts:
            starts.append((p, at))
            at += k
        first = self.spark.createDataFrame(starts, "_p long, _start long")
        cells = [F.col(f"`{c}`") if c != FID else (F.col("_start") + F.pmod(F.col(FID) - base, F.lit(1 << 33))).alias(FID) for c in new.columns]
        return settle(new.withColumn("_p", part).join(F.broadcast(first), "_p").select(*cells)), base + n - 1

    def _put(self, name: str, new: DataFrame) -> None:
        if name in self.types and name in self._empty:
            self._empty.discard(name)
            both = self._like(self.types[name], new)
        elif name in self.types:
            self._parts[name] = self._parts.get(name, 0) + 1
            both = self.types[name].unionByName(new, allowMissingColumns=True)
            if self._parts[name] % MERGE == 0:
                both = settle(both)  # many small parts become one table
        else:
            both = new
        self.types.put(name, both, lost=False)

    @staticmethod
    def _like(known: DataFrame, new: DataFrame) -> DataFrame:
        """``new`` with the columns of a type that has had no facts so far."""
        more = [F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema.fields if f.name not in new.columns]
        order = [c for c in known.columns] + [c for c in new.columns if c not in known.columns]
        return new.select("*", *more).select(*[F.col(f"`{c}`") for c in order])

    def declare(self, name: str, schema: T.StructType) -> None:
        if name not in self.types:
            fields = [f for f in schema.fields if f.name not in SYSTEM.names]
            self.types[name] = self.spark.createDataFrame([], T.StructType([*fields, *SYSTEM.fields]))
            self._empty.add(name)

    def remove(self, name: str, ids: DataFrame) -> None:
        """Retracts the facts whose ids are in the one column of ``ids``."""
        gone, found = measured(ids.toDF("_gone").distinct(), n=F.count(F.lit(1)))
        if not found["n"]:
            return
        df, small = self.types[name], found["n"] * 8 <= SMALL
        left = df.join(F.broadcast(gone) if small else gone, df[FID] == F.col("_gone"), "left_anti")
        self.types.put(name, self._later(name, left, small), gained=False)

    def _later(self, name: str, df: DataFrame, small: bool) -> DataFrame:
        """A type after a change: a few small ones are joined as it is read, then it is written anew."""
        self._changes[name] = self._changes.get(name, 0) + 1
        if small and self._changes[name] < DELTAS:
            return df
        self._changes[name] = 0
        return settle(df)

    def update(self, name: str, changes: DataFrame) -> None:
        """``changes``: _fid, and for each changed field f a column f and a flag _set_f.

        Fields that keep their value change nothing: only facts with a real
        change get a new version.
        """
        df = self.types[name]
        fields = [c for c in changes.columns if c != FID and not c.startswith("_set_")]
        new, found = measured(changes.select(F.col(FID).alias("_id"), *[F.col(f).alias(f"_new_{f}") for f in fields], *[F.col(f"_set_{f}") for f in fields]), n=F.count(F.lit(1)), size=F.sum(_weight(fields)))
        if not found["n"]:
            return
        small = (found["size"] or 0) <= SMALL
        both = df.join(F.broadcast(new) if small else new, df[FID] == F.col("_id"), "left")
        moved = F.lit(False)
        cols = []
        for f in df.schema.fields:
            if f.name in fields:
                value = F.col(f"_new_{f.name}").cast(f.dataType)
                given = F.coalesce(F.col(f"_set_{f.name}"), F.lit(False))
                moved = moved | (given & ~value.eqNullSafe(F.col(f.name)))
                cols.append(F.when(given, value).otherwise(F.col(f.name)).alias(f.name))
            elif f.name != VERSION:
                cols.append(F.col(f"`{f.name}`"))
        self.types[name] = self._later(name, both.select(*cols, (F.col(VERSION) + moved.cast("long")).alias(VERSION)), small)


def _weight(fields: list[str]) -> Column:
    """About the bytes of a row of changes."""
    out = F.lit(16)
    for f in fields:
        out = out + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"_new_{f}")))), F.lit(0))
    return out
