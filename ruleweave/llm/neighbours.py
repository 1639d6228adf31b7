"""Nearest neighbours of a stated query set against all vectors, by block matrix products.

Candidates are packed into blocks of rows, queries into blocks of their own, and
each pair of blocks is a tile.  Blocks hold int8 rows, quantised once, with each
row's scale, norm and quantisation error.  In a tile, int8 products (exact in
float32 for up to GROUP_DIMS dimensions; wider vectors add the products of
groups of dimensions) give every inner product with a bound on what quantisation
changed.  A pair survives if its upper bound reaches the k-th best lower bound of
its query, which a task carries from tile to tile.  Only survivors meet the
original vectors: they are recomputed in double precision, and heaps of size k
merge them.  The result is exact.

Vectors that are null, zero, empty, or hold null or non-finite components take
no part, nor do rows with null ids.  Vectors of different lengths are never
compared: blocks are formed by length.  Ties go to the smaller id.  Repeated ids
are candidates each.  Repeated query rows (same id, same vector) are answered
once; rows of one query id with different vectors are answered each, with ranks
of their own.  A candidate with the query's id is never its neighbour.  No
queries or no candidates give no rows.  Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

CANDIDATES = 2048
QUERIES = 512
#: Candidate blocks that one task meets with one query block.
GROUP = 8
#: 127 * 127 * 1000 stays below 2^24: float32 sums of int8 products are exact.
GROUP_DIMS = 1000


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, dim): rows that take part; single-precision vectors stay so, which doubles hold exactly."""
    kind = df.schema[vector].dataType.elementType.simpleString()
    v = F.col(vector) if kind in ("float", "double") else F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim")).where(F.col("id").isNotNull() & v.isNotNull() & good & some)


def first_of_equals(df: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 smallest ids, of each id k rows: by ties to the smaller id no other can be found.

    Both limits work before the shuffle, so a vector that a third of the rows
    hold sends k (k + 1) rows from each task.
    """
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    least = df.withColumn("_n", F.dense_rank().over(same)).where(F.col("_n") <= k + 1)
    each = Window.partitionBy(F.xxhash64("v"), "v", "id").orderBy("id")
    return least.withColumn("_n", F.row_number().over(each)).where(F.col("_n") <= k).drop("_n")


def quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(int8 rows, a row each of: scale, norm, norm of what rounding lost)."""
    scale = np.abs(m).max(1) / 127
    scale[scale == 0] = 1
    q = np.rint(m / scale[:, None])
    lost = np.sqrt(((m - q * scale[:, None]) ** 2).sum(1))
    return q.astype(np.int8), np.stack([scale, np.sqrt((m**2).sum(1)), lost], 1)


def _blocks(rows: int):
    """Rows (rid, id, v, dim) sorted by dim become blocks of at most ``rows`` quantised vectors."""

    def run(batches):
        rids, ids, vs, dim = [], [], [], None

        def out():
            q, about = quantise(np.array(vs, np.float64))
            cells = [[dim], [np.array(rids, np.int64).tobytes()], [np.array(ids, np.int64).tobytes()], [q.tobytes()], [about.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, [pa.int32(), *[pa.binary()] * 4])], ["dim", "rids", "ids", "m", "about"])

        for batch in batches:
            flat = batch.column(2)
            for i, (rid, id_, d) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 1, 3)))):
                if ids and (d != dim or len(ids) == rows):
                    yield out()
                    rids, ids, vs = [], [], []
                dim = d
                rids.append(rid)
                ids.append(id_)
                vs.append(flat[i].values.to_numpy(zero_copy_only=False))
        if ids:
            yield out()

    return run


def blocks(numbered: DataFrame, rows: int, n: int) -> DataFrame:
    """(dim, rids, ids, m, about, b): the n vectors packed into numbered int8 matrices, written once.

    Rows are dealt evenly over as many tasks as there are blocks, so neither a key
    nor the number of input files decides how large the blocks are.
    """
    packed = numbered.repartition(max(1, -(-n // rows))).sortWithinPartitions("dim", "id").mapInArrow(_blocks(rows), "dim int, rids binary, ids binary, m binary, about binary")
    return cut(packed.withColumn("b", F.monotonically_increasing_id()))


def bounds(qm: np.ndarray, qa: np.ndarray, cm: np.ndarray, ca: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of every inner product of two int8 blocks."""
    near = np.zeros((len(qm), len(cm)))
    for a in range(0, qm.shape[1], GROUP_DIMS):
        near += qm[:, a : a + GROUP_DIMS].astype(np.float32) @ cm[:, a : a + GROUP_DIMS].astype(np.float32).T
    (qs, qn, ql), (cs, cn, cl) = qa.T, ca.T
    near *= qs[:, None] * cs[None, :]
    # |q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'|, and |q'| <= |q| + |q - q'|; a little more for rounding.
    slack = (ql[:, None] * cn[None, :] + (qn + ql)[:, None] * cl[None, :]) * (1 + 1e-9) + 1e-12 * qn[:, None] * cn[None, :]
    return near - slack, near + slack


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added dimension by dimension: equal rows give equal sums."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class Running:
    """Survivors of one query block so far, and each query's k-th best lower bound."""

    def __init__(self, qrids: np.ndarray, qids: np.ndarray, k: int):
        self.qrids, self.qids, self.k = qrids, qids, k
        self.best = np.full((len(qids), k), -np.inf)
        self.at, self.rid, self.high = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def tile(self, qm, qa, crids, cids, cm, ca) -> None:
        low, high = bounds(qm, qa, cm, ca)
        own = self.qids[:, None] == cids[None, :]
        low[own] = high[own] = -np.inf
        both = np.concatenate([self.best, low], 1)
        self.best = -np.partition(-both, self.k - 1, 1)[:, : self.k]
        floor = self.best.min(1)
        new = np.nonzero((high >= floor[:, None]) & (high > -np.inf))
        at = np.concatenate([self.at, new[0]])
        rid, top = np.concatenate([self.rid, crids[new[1]]]), np.concatenate([self.high, high[new]])
        keep = top >= floor[at]
        self.at, self.rid, self.high = at[keep], rid[keep], top[keep]

    def sent(self) -> pa.RecordBatch:
        """Rows (q, c, high, low): survivors; c null: the task's k best lower bounds of a query."""
        q, j = np.nonzero(self.best > -np.inf)
        n = len(self.at)
        cols = [
            pa.array(np.concatenate([self.qrids[self.at], self.qrids[q]])),
            pa.concat_arrays([pa.array(self.rid), pa.nulls(len(q), pa.int64())]),
            pa.concat_arrays([pa.array(self.high), pa.nulls(len(q), pa.float64())]),
            pa.concat_arrays([pa.nulls(n, pa.float64()), pa.array(self.best[q, j])]),
        ]
        return pa.RecordBatch.from_arrays(cols, ["q", "c", "high", "low"])


def _tiles(k: int):
    """Tiles of one query block in a row share its running bounds."""

    def run(batches):
        at, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                qb, dim = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                qr, qi, qm, qa, cr, ci, cm, ca = (batch.column(j)[i].as_buffer() for j in range(2, 10))
                if qb != at:
                    if held is not None:
                        yield held.sent()
                    at, held = qb, Running(np.frombuffer(qr, np.int64), np.frombuffer(qi, np.int64), k)
                held.tile(*(np.frombuffer(x, t).reshape(-1, w) if w else np.frombuffer(x, t) for x, t, w in ((qm, np.int8, dim), (qa, np.float64, 3), (cr, np.int64, 0), (ci, np.int64, 0), (cm, np.int8, dim), (ca, np.float64, 3))))
        if held is not None:
            yield held.sent()

    return run


def _survivors(k: int):
    """Rows by query, bounds before survivors: those that the k-th best lower bound of all tasks leaves."""

    def run(batches):
        query, heap = None, []
        for batch in batches:
            keep = []
            for i, (q, c, high, low) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(4)))):
                if q != query:
                    query, heap = q, []
                if c is None:
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, low)
                elif len(heap) < k or high >= heap[0]:
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["q", "c"])

    return run


def _scores(batches):
    """Exact inner products of survivors."""
    for batch in batches:
        if batch.num_rows:
            width = np.diff(batch.column(3).offsets.to_numpy())
            out = np.zeros(batch.num_rows)
            for d in np.unique(width):
                at = np.flatnonzero(width == d)
                a, b = (batch.column(j).take(at).flatten().to_numpy().astype(np.float64).reshape(-1, d) for j in (3, 4))
                out[at] = exact(a, b)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out)], ["q", "query_id", "vec_id", "score"])


def _merge(k: int):
    """Rows by query: a heap of the k best, whatever number of tiles they come from."""

    def run(batches):
        query, name, heap, out = None, None, [], []

        def flush():
            best = sorted(heap, reverse=True)
            out.extend((name, i + 1, -v, s) for i, (s, v) in enumerate(best))

        for batch in batches:
            for q, n, v, s in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if q != query:
                    flush()
                    query, name, heap = q, n, []
                item = (s, -v)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            if len(out) >= 4096:
                yield _batch(out)
                out.clear()
        flush()
        if out:
            yield _batch(out)

    return run


def _batch(rows):
    q, r, v, s = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int32()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "rank", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query, its own id apart.

    Each candidate block is sent once for each block of queries of its length:
    that product is what a search of all queries against all rows is made of.
    """
    spark = vectors.sparkSession
    n_parts = partitions(spark)
    # Written once, so that rows keep their numbers whatever the inputs' plans are.
    rows = cut(first_of_equals(_usable(vectors, key, vector), k).withColumn("rid", F.monotonically_increasing_id()))
    asked = cut(_usable(queries, key, vector).dropDuplicates(["id", "v"]).withColumn("rid", F.monotonically_increasing_id()))
    order = ["rid", "id", "v", "dim"]
    cand = blocks(rows.select(*order), CANDIDATES, rows.count())
    ask = blocks(asked.select(*order), QUERIES, asked.count()).select("dim", *[F.col(c).alias("q" + c) for c in ("rids", "ids", "m", "about", "b")])
    # A task takes one query block and a group of candidate blocks of its length, so tasks grow with both.
    # One row for each length of vectors: (dim, number of groups).
    groups = cand.groupBy("dim").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("n"))
    query_blocks = ask.select("dim", "qb").join(groups, "dim")
    slots = query_blocks.select("dim", "qb", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("g"))
    grouped = cand.join(F.broadcast(groups), "dim").withColumn("g", F.pmod(F.xxhash64("b"), F.col("n")).cast("int")).drop("n", "b")
    tiles = slots.join(grouped, ["dim", "g"]).select("qb", "g", "dim", "rids", "ids", "m", "about")
    sides = slots.join(ask.drop("dim"), "qb").select("qb", "g", "qrids", "qids", "qm", "qabout")
    made = tiles.join(sides, ["qb", "g"]).select("qb", "dim", "qrids", "qids", "qm", "qabout", "rids", "ids", "m", "about").mapInArrow(_tiles(k), "q long, c long, high double, low double")
    left = made.repartition(n_parts, "q").sortWithinPartitions("q", F.col("c").isNotNull()).mapInArrow(_survivors(k), "q long, c long")
    pairs = left.join(rows.select(F.col("rid").alias("c"), F.col("id").alias("vec_id"), F.col("v").alias("cv")), "c")
    pairs = pairs.join(asked.select(F.col("rid").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("qv")), "q").select("q", "query_id", "vec_id", "qv", "cv")
    scored = pairs.mapInArrow(_scores, "q long, query_id long, vec_id long, score double")
    return scored.repartition(n_parts, "q").sortWithinPartitions("q").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
