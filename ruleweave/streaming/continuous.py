"""Continuous sessions: rules over events, by event time and a watermark that the caller moves.

A step (a push, a move of the watermark, a drain) happens as a whole or not at
all: working memory is a set of immutable DataFrames, so a step that fails leaves
the former ones in place.  With a ``recovery`` folder each committed operation is
logged there, its events as a table; ``recover`` makes the session again from the
log, after a driver is lost.  ``attach`` runs a session on a structured stream: a
micro-batch that comes again is not applied again, but its output is delivered.

Events are written once, in the job that finds the bad ones and counts them; what
is known of earlier events is those tables, filtered by time.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compiler import FID
from ..operators.memory import measured, settle
from ..operators.session import KnowledgeBase, Session
from ..plans.match import ROUTE, VERSION


@dataclass
class Config:
    """Limits and times in milliseconds; the defaults are fixed values."""

    max_active_events: int = 10_000
    max_dedup_ids: int = 20_000
    max_pending_batches: int = 128
    max_results: int = 10_000
    max_batch_size: int = 1_000
    max_replay_steps: int = 100_000
    max_rules_per_step: int = 10_000
    allowed_lateness_ms: int = 0
    event_retention_ms: int = 3_600_000
    dedup_retention_ms: int = 3_600_000
    max_future_ms: int = 86_400_000
    output_types: tuple[str, ...] = ()

    def __post_init__(self):
        free = {"allowed_lateness_ms", "max_future_ms"}
        wrong = [k for k, v in asdict(self).items() if isinstance(v, int) and v < (k not in free)]
        if wrong or any(not t for t in self.output_types):
            raise ValueError(f"limits must be positive, output types named: {', '.join(wrong) or 'output_types'}")


@dataclass
class Metrics:
    accepted: int = 0
    expired: int = 0
    duplicates: int = 0
    late: int = 0
    future: int = 0
    over_limit: int = 0
    failed_steps: int = 0
    fired: int = 0
    replay_recoveries: int = 0
    active_events: int = 0
    dedup_entries: int = 0
    pending: int = 0
    pending_results: int = 0


class StepRejected(ValueError):
    """Why a whole batch was turned away: duplicate, late, future, limit, watermark or order."""

    def __init__(self, reason: str, text: str):
        super().__init__(text)
        self.reason = reason


@dataclass
class Batch:
    id: int
    facts: dict[str, DataFrame] = field(default_factory=dict)
    drain_required: bool = False
    size: int = 0


@dataclass(frozen=True)
class Part:
    """Events of one push: (_event, _time, _kind, _id), their times, and up to where they have expired already."""

    df: DataFrame
    low: int
    high: int
    n: int
    gone: float = -math.inf


class Log:
    """Committed operations as numbered JSON files of a folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.size = spark, f"{folder.rstrip('/')}/ops", 0
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(self.folder))

    def write(self, **operation) -> None:
        """The file appears whole, under its number, or not at all."""
        text = json.dumps(operation)
        name = f"{self.folder}/{self.size:012d}.json"
        out = self.fs.create(self.path(f"{name}.new"), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(self.path(f"{name}.new"), self.path(name)):
            raise RuntimeError(f"{name} is there already: another session writes this log")
        self.size += 1

    def read(self) -> list[dict]:
        names = sorted(str(f.getPath().toString()) for f in self.fs.listStatus(self.path(self.folder)) if f.getPath().getName().endswith(".json"))
        out = []
        for name in names:  # at most max_replay_steps
            stream = self.fs.open(self.path(name))
            try:
                out.append(json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()))
            finally:
                stream.close()
        self.size = len(out)
        return out


class ContinuousSession:
    def __init__(self, kb: KnowledgeBase, spark: SparkSession, config: Config | None = None, recovery: str | None = None, **options):
        self.config, self.spark, self.metrics = config or Config(), spark, Metrics()
        self.session = Session(kb, spark, **options)
        self.session.wall = False
        self.watermark: int | None = None
        self.parts: list[Part] = []
        self.pending: list[Batch] = []
        self.next_batch, self.shown = 1, 0
        self.done: tuple[int, bool] = (-1, True)  # the stream's last micro-batch, and whether time has moved on after it
        self.log = Log(spark, recovery) if recovery else None
        if self.log is not None and self.log.read():
            raise ValueError(f"{recovery} holds a session: recover() it, or name another folder")

    @classmethod
    def recover(cls, kb: KnowledgeBase, spark: SparkSession, recovery: str, config: Config | None = None, **options) -> ContinuousSession:
        """The session whose operations a folder holds, by replaying them; the batches that wait are there again."""
        s = cls(kb, spark, config, None, **options)
        log = Log(spark, recovery)
        for op in log.read():
            if op["op"] == "push":
                stored = spark.read.parquet(op["path"])
                s.push(op["kind"], stored.drop("_event", "_time", FID), "_given_event", "_given_time", op["entry_point"], strict=False)
            elif op["op"] == "advance":
                s.advance_watermark(op["to"])
            elif op["op"] == "drain":
                s.drain()
            else:
                s.acknowledge(op["batch"])
            if op.get("stream") is not None:
                s.done = tuple(op["stream"])
        s.log = log
        s.metrics.replay_recoveries += 1
        return s

    # --- steps

    def push(self, kind: str, df: DataFrame, event_id: str = "event_id", event_time: str = "event_time_ms", entry_point: str | None = None, strict: bool = True, stream: tuple[int, bool] | None = None) -> Batch:
        """Adds a batch of events.  Strict: one bad event rejects the batch; else bad events alone are left out."""
        name = self.session.kb.resolve(kind)
        memory = self.session.memory
        memory.read_ids()
        want = self.session.kb.schemas.get(name)
        names = want.names if want is not None else df.columns
        fields = [(F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(want[n].dataType if want is not None else df.schema[n].dataType).alias(n) for n in names]
        system = [(F.monotonically_increasing_id() + F.lit(memory.next_id)).alias(FID), F.lit(0).cast("long").alias(VERSION), F.lit(entry_point).cast("string").alias(ROUTE)]
        facts = df.select(*fields, *system, F.col(event_id).cast("string").alias("_event"), F.col(event_time).cast("long").alias("_time"))
        copies = F.col("_copies")
        twice = F.when(F.col("_bad") == "duplicate", copies).otherwise(copies - 1)
        new, found = measured(self._flagged(facts), total=F.coalesce(F.sum(copies), F.lit(0)), duplicate=F.coalesce(F.sum(twice), F.lit(0)), late=F.count_if(F.col("_bad") == "late"), future=F.count_if(F.col("_bad") == "future"), low=F.min(F.when(F.col("_bad").isNull(), F.col("_time"))), high=F.max(F.when(F.col("_bad").isNull(), F.col("_time"))), top=F.max(FID))
        n = self._admitted(found, strict)
        good = new.where("_bad IS NULL").drop("_bad", "_copies")

        def change():
            memory.take(name, good.drop("_event", "_time"), n, found["top"])
            if n:
                mine = good.select("_event", "_time", F.lit(name).alias("_kind"), F.col(FID).alias("_id"))
                self.parts = [*self.parts, Part(mine, found["low"], found["high"], n)]
            return n, n, 0

        stored = None
        if self.log is not None:
            stored = settle(good.withColumns({"_given_event": F.col("_event"), "_given_time": F.col("_time")}).drop(VERSION, ROUTE))
        batch = self._step(change, lambda: {"op": "push", "kind": name, "entry_point": entry_point, "path": stored.inputFiles()[0].rsplit("/", 1)[0], "stream": stream} if n else {"op": "drain", "stream": stream})
        self.metrics.accepted += n
        return batch

    def _flagged(self, facts: DataFrame) -> DataFrame:
        """The first event of each id, with ``_copies``, how many there are, and ``_bad``: what is wrong with it, if anything is."""
        c = self.config
        # Combined before the shuffle: an id that a third of the rows have sends one row from each task.
        first = facts.groupBy("_event").agg(F.min_by(F.struct(*[F.col(f"`{x}`") for x in facts.columns]), FID).alias("_row"), F.count(F.lit(1)).alias("_copies"))
        out = first.select("_row.*", "_copies").withColumn("_bad", F.lit(None).cast("string"))
        known = self._known()
        if known is not None:
            mark = known.select(F.col("_event").alias("_seen")).distinct()
            out = out.join(mark, out["_event"] == mark["_seen"], "left").withColumn("_bad", F.when(F.col("_seen").isNotNull(), "duplicate").otherwise(F.col("_bad"))).drop("_seen")
        if self.watermark is not None:
            late = F.col("_time") < self.watermark - c.allowed_lateness_ms
            future = F.col("_time") > self.watermark + c.max_future_ms
            out = out.withColumn("_bad", F.coalesce("_bad", F.when(late, "late"), F.when(future, "future")))
        return out

    def _known(self, since: float | None = None) -> DataFrame | None:
        """The ids that are remembered."""
        bound = self._dedup_bound() if since is None else since
        found = [p.df if p.low > bound else p.df.where(F.col("_time") > int(bound)) for p in self.parts if p.high > bound]
        return self._union(found)

    def _dedup_bound(self) -> float:
        # An event that is still active is remembered too.
        if self.watermark is None:
            return -math.inf
        return self.watermark - max(self.config.dedup_retention_ms, self.config.event_retention_ms)

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame | None:
        out = None
        for df in parts:
            out = df if out is None else out.unionByName(df)
        return out

    def _admitted(self, found: dict, strict: bool) -> int:
        c, m = self.config, self.metrics
        total = found["total"]
        bad = {"duplicate": found["duplicate"], "late": found["late"], "future": found["future"]}
        m.duplicates += bad["duplicate"]
        m.late += bad["late"]
        m.future += bad["future"]
        n = total - sum(bad.values())
        asked = total if strict else n
        if strict and not 0 < total <= c.max_batch_size or m.active_events + asked > c.max_active_events or m.dedup_entries + asked > c.max_dedup_ids:
            m.over_limit += 1
            raise StepRejected("limit", f"{total} events in a batch, {m.active_events} active, {m.dedup_entries} ids known")
        first = next((r for r, k in bad.items() if k), None)
        if strict and first:
            raise StepRejected(first, f"{bad[first]} {first} of {total} events")
        return n

    def advance_watermark(self, to_ms: int, stream: tuple[int, bool] | None = None) -> Batch:
        if self.watermark is not None and to_ms < self.watermark:
            raise StepRejected("watermark", f"{to_ms} is before {self.watermark}")
        before = (self.watermark, self.session.now)

        def change():
            self.watermark = self.session.now = to_ms
            return self._expire(to_ms - self.config.event_retention_ms)

        try:
            return self._step(change, lambda: {"op": "advance", "to": to_ms, "stream": stream})
        except Exception:
            self.watermark, self.session.now = before
            raise

    def _expire(self, bound: int) -> tuple[int, int, int]:
        """Retracts events up to ``bound`` and forgets old ids; gives the changes of the gauges and the number expired."""
        forget = self._dedup_bound()
        parts, gone, known = [], [], 0
        for p in self.parts:
            if p.low <= bound and p.gone < bound:
                last = p.df.where(F.col("_time") <= bound)
                gone.append(last if p.gone == -math.inf else last.where(F.col("_time") > int(p.gone)))
                p = replace(p, gone=bound)
            if p.high > forget:
                parts.append(p)
        old = self._union(gone)
        expired = 0
        if old is not None:
            kinds = {r[0]: r[1] for r in old.groupBy("_kind").count().collect()}  # fact types
            for kind in kinds:
                self.session.memory.remove(kind, old.where(F.col("_kind") == kind).select("_id"))
            expired = sum(kinds.values())
        known = sum(p.n for p in parts)
        if any(p.low <= forget for p in parts):
            known = self._known(forget).count()
        self.parts = parts
        return -expired, known - self.metrics.dedup_entries, expired

    def drain(self) -> Batch:
        """Goes on where a step stopped at its budget."""
        return self._step(lambda: (0, 0, 0), lambda: {"op": "drain"})

    def drain_on(self) -> tuple[list[Batch], dict[str, DataFrame]]:
        """The batches of as many drains as may wait to be acknowledged, and their facts of the output types with the batch's number, ``_batch``.

        Where each drain would only fire the next matches that wait for a rule, all
        are one job; else, and with a recovery log, it is one drain.
        """
        c, s = self.config, self.session
        budget = c.max_rules_per_step
        room = min(c.max_pending_batches - len(self.pending), (c.max_results - sum(b.size for b in self.pending)) // budget)
        try:
            found = s.fire_slices(budget, room) if self.log is None and room > 1 else None
        except Exception:
            self.metrics.failed_steps += 1
            raise
        if found is None:
            b = self.drain()
            return [b], {k: df.withColumn("_batch", F.lit(b.id)) for k, df in b.facts.items()}
        kind, first, times = found
        names = {t: s.kb.resolve(t) for t in c.output_types}
        new = {t: s.memory.types[k].where(F.col(FID).between(first, first + times * budget - 1) if k == kind else F.lit(False)).drop(VERSION, ROUTE) for t, k in names.items()}
        slices = F.call_function("div", F.col(FID) - first, F.lit(budget))
        made = []
        for i in range(times):
            mine = {t: df.where(F.col(FID).between(first + i * budget, first + (i + 1) * budget - 1)).orderBy(FID) for t, df in new.items()}
            made.append(Batch(self.next_batch + i, mine, True, sum(budget for k in names.values() if k == kind)))
        facts = {t: df.withColumn("_batch", (slices + self.next_batch).cast("int")) for t, df in new.items()}
        self.metrics.fired += times * budget
        self.shown = s.memory.next_id - 1
        self.next_batch += times
        self.pending += made
        self._gauges()
        return made, facts

    def _step(self, change, logged) -> Batch:
        if len(self.pending) >= self.config.max_pending_batches:
            self._over("too many batches wait to be acknowledged")
        if self.log is not None and self.log.size >= self.config.max_replay_steps:
            self._over("the log of operations is full")
        s = self.session
        before = (dict(s.memory.types), s.memory.next_id, list(s.logical), dict(s.fired), set(s.lazy), dict(s.idle), dict(s.upto), dict(s.waiting), list(self.parts))
        try:
            active, known, expired = change()
            fired = s.fire(self.config.max_rules_per_step)
            batch = Batch(self.next_batch, {}, fired >= self.config.max_rules_per_step)
            self._collect(batch)
            operation = logged() if self.log is not None else None
            if operation:
                self.log.write(**operation)
        except Exception as e:
            s.memory.types.restore(before[0])
            s.memory.next_id, s.logical, s.fired, s.lazy, s.idle, s.upto, s.waiting, self.parts = before[1:]
            if not isinstance(e, StepRejected):
                self.metrics.failed_steps += 1
            raise
        m = self.metrics
        m.fired += fired
        m.active_events += active
        m.dedup_entries += known
        m.expired += expired
        self.shown = s.memory.next_id - 1
        self.next_batch += 1
        self.pending.append(batch)
        self._gauges()
        return batch

    def _over(self, text: str) -> None:
        self.metrics.over_limit += 1
        raise StepRejected("limit", text)

    def _collect(self, batch: Batch) -> None:
        """The step's new facts of the output types."""
        s = self.session
        for kind in self.config.output_types:
            batch.facts[kind] = s.memory.types[s.kb.resolve(kind)].where(F.col(FID) > self.shown).drop(VERSION, ROUTE).orderBy(FID)
        if batch.facts:
            counts = self._union([df.select(F.lit(1).alias("n")) for df in batch.facts.values()])
            batch.size = counts.count()
            if sum(b.size for b in self.pending) + batch.size > self.config.max_results:
                self._over("too many results wait to be acknowledged")

    def _gauges(self) -> None:
        self.metrics.pending = len(self.pending)
        self.metrics.pending_results = sum(b.size for b in self.pending)

    # --- results

    def acknowledge(self, batch_id: int) -> None:
        """In order: the oldest batch that waits."""
        if not self.pending or self.pending[0].id != batch_id:
            raise StepRejected("order", f"batch {batch_id} is not the next to be acknowledged")
        if self.log is not None:
            self.log.write(op="ack", batch=batch_id)
        self.pending.pop(0)
        self._gauges()

    def query(self, name: str, **params: DataFrame) -> DataFrame:
        return self.session.query(name, **params)

    # --- structured streams

    def attach(self, stream: DataFrame, kind: str, event_id: str, event_time: str, sink=None, entry_point: str | None = None, lateness_ms: int = 0):
        """A writer that takes each micro-batch as a step: events that are bad alone are left out, then time moves on.

        ``sink(batch id, facts)`` gets the new facts of the output types; batches are
        acknowledged after it.  If the sink or the driver fails, Spark gives the
        micro-batch again: what it had changed is not changed again, and the batches
        that were not acknowledged go to the sink once more, under the same ids.
        """

        def step(df: DataFrame, number: int) -> None:
            top = None if self.done >= (number, True) else df.agg(F.max(F.col(event_time).cast("long"))).first()[0]
            if top is not None:
                if self.done < (number, False):
                    self.push(kind, df, event_id, event_time, entry_point, strict=False, stream=(number, False))
                    self.done = (number, False)
                self.advance_watermark(max(top - lateness_ms, self.watermark or 0), stream=(number, True))
                self.done = (number, True)
            for b in list(self.pending):
                if sink is not None:
                    sink(b.id, b.facts)
                self.acknowledge(b.id)

        return stream.writeStream.foreachBatch(step)
