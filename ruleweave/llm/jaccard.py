"""Exact Jaccard join of documents' shingle sets, as a join in a metric space.

Jaccard distance is a metric, and two documents link within radius R = 0.25.

*Far apart.*  Almost all pairs lie at distance 1, where no pivot tells them
apart.  So regions first come from the sets: a pair within R shares one of each
side's ``prefix`` shingles, its rarest (a quarter of the set).  Rarity is read
off a count of all shingles in a table of fixed size; any order is exact, and
rare ones first keep common passages out.  Documents joined by shared prefix
shingles form a region; most documents have a region of their own.
Prefix shingles travel packed (see ``pack_prefixes``): what is rounded there only
joins regions.

*Sketches.*  In a large corpus many rows of the count table are full of chance, and
regions join documents that have little in common.  So before any set is sent, the
parities of the shingles in a few hundred bits (a 32nd of the set or less) split the
regions: where two sketches differ, the sets differ too, and a pair whose sketches
differ in more places than a link admits is none.  What the other pairs connect are
the regions from then on.

*Near.*  Within a region pivots create Voronoi cells.  A document within R of
the pivot belongs to its cell and links to it.  By the triangle inequality only
documents within 2 R of the pivot can link to the cell, so these are the
replicas that are compared with it; what is left is split again by further
pivots, until nothing is left.  The cell's documents meet nothing else, so a
group of thousands of near copies costs a row for each pivot and replica.

*Large regions.*  Where no task can hold a region, Spark joins it recursively.
Pivots meet all its documents first; those that they connect need no more.  Each
document that is left must meet every other.  Pivots make Voronoi cells: a
document belongs to its nearest pivot, or, at distance 1 - R or more from all, to
the outer cell.  A document y can link into the cell of pivot p only if its
distance to p is below 1 and at most 2 R more than to its own nearest pivot, and
into the outer cell only if it is 1 - 2 R or more from all pivots; it is replicated
to these cells and to no others.  Each cell with its replicas is a region again,
until it fits a task or SPLITS rounds are over; then blocks of what asks meet
blocks of the cell.  All of this is exact, whatever the pivots.

Texts with equal sets are one class (128 bits of hash; shingles are 64), and every
class is compared once.  Null and empty texts have the empty set and link with
nothing; with fewer than five words the sequence is the one shingle.  Null ids
are never a component's name unless all its ids are null; repeated rows fall into
one class.  Very long texts are read whole; a task holds one at least.  An empty
table gives no rows.  Columns of any name may come with the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import bitset, boxed, cut, drop_cut, partitions, stable, unboxed, with_rid
from .components import components

WORDS = 5
SKETCH_LOG2 = 24
BLOCK = 1 << 16
#: Classes seen of late by a task; forgetting them costs repeated rows, not results.
SEEN = 1 << 18
#: Bytes of sets that one task takes at once; larger regions are split.
REGION_BYTES = 16 << 20
#: 100 * intersection >= 75 * union
NUM, DEN = 75, 100


#: Rows of prefixes that a task sorts at once, on average.
BUCKET_ROWS = 1 << 19
#: Sketches of a region that meet in one task; of larger regions all pairs of such parts meet.
SKETCHES = 1 << 15


SetsOf = Callable[[pa.Array], Iterator[np.ndarray]]


def shingles_of(column: pa.Array) -> Iterator[np.ndarray]:
    return H.shingle_sets(column, WORDS)


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return DEN * common >= NUM * (a + b - common)


def reachable(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance at most 2 R, that is, intersection at least (2 NUM - DEN) / DEN of the union."""
    return DEN * common >= (2 * NUM - DEN) * (a + b - common)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    a, b = H.mix(s * H.CHAIN[20]).sum(dtype=np.uint64), H.mix(s * H.CHAIN[21]).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def prefix(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles, one of which every linked set must share."""
    k = len(s) - (NUM * len(s) + DEN - 1) // DEN + 1
    order = np.lexsort((s, counts[(s >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64)]))
    return s[order[:k]]


def reach(n: int, places: np.ndarray) -> np.ndarray:
    """The largest size of a partner whose first shared shingle is at this place of the sorted prefix.

    From there on n - place shingles can be shared, and a linked pair of sizes n
    and m shares NUM / (NUM + DEN) of n + m.  Below n: only smaller partners.
    """
    return np.maximum((n - places) * (NUM + DEN) // NUM - n, n - 1)


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity of how many shingles fall on each of M bits, M = 2^i, between the set's size and twice that, 64 at least.

    Half as many bits are the exclusive or of the two halves.
    """
    log2 = max(6, int(len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64((1 << log2) - 1)).astype(np.int64), minlength=1 << log2) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def halved(sketches: np.ndarray) -> np.ndarray:
    half = sketches.shape[-1] // 2
    return sketches[..., :half] ^ sketches[..., half:]


def may_link(differ: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b that differ in so many shingles at least can link."""
    return ((NUM + DEN) * differ <= (DEN - NUM) * (a + b)) & (NUM * a <= DEN * b) & (NUM * b <= DEN * a)


def _profile(sets_of: SetsOf):
    """For each document its digest and sketch; for each task its shingle counts, in blocks."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_LOG2, np.uint16)
        kind = None

        def add(sets: list[np.ndarray]) -> None:
            at, n = np.unique(_slot(np.concatenate(sets)), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, 65535)

        for batch in batches:
            kind = batch.schema.field(1).type
            ds, ns, many, held, sketches = [], [], [], 0, []
            for s in sets_of(batch.column(2)):
                ds.append(digest(s))
                sketches.append(sketch(s).tobytes() if len(s) else None)
                ns.append(len(s))
                many.append(s)
                held += len(s)
                if held > 1 << 18:
                    add(many)
                    many, held = [], 0
            if many:
                add(many)
            n = len(ns)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array([d[0] for d in ds], pa.int64()), pa.array([d[1] for d in ds], pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], PROFILE)
        if kind is not None:
            blocks = range(len(counts) // BLOCK)
            none = pa.nulls(len(blocks), pa.int64())
            packed = [zlib.compress(counts[i * BLOCK : (i + 1) * BLOCK].tobytes(), 1) for i in blocks]
            yield pa.RecordBatch.from_arrays([none, pa.nulls(len(blocks), kind), none, none, none, pa.nulls(len(blocks), pa.binary()), pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], PROFILE)

    return run

PROFILE = ["_rid", "_key", "n", "d1", "d2", "sketch", "block", "counts"]


def _add(batches):
    """Sums the tasks' blocks; holds no more than the table itself."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, c in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(zlib.decompress(c.as_buffer()), np.uint16)
            if b in total:
                total[b] += x
            else:
                total[b] = x.astype(np.int64)
    for b, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([int(x.sum())]), pa.array([zlib.compress(x.tobytes(), 1)])], ["block", "n", "counts"])


def _table(spark, profile: DataFrame) -> np.ndarray:
    """The counts in one byte each: exact when few, else in eighths of the mean, so that hot ones stand out at any size."""
    n_blocks = (1 << SKETCH_LOG2) // BLOCK
    sums = cut(profile.where("block is not null").select("block", "counts").repartition(16, "block").mapInArrow(_add, "block int, n long, counts binary"))
    mean = (sums.agg(F.sum("n")).first()[0] or 0) / (1 << SKETCH_LOG2)
    table = np.zeros((n_blocks, BLOCK), np.uint8)
    for r in sums.select("block", "counts").toLocalIterator():
        x = np.frombuffer(zlib.decompress(bytes(r[1])), np.int64)
        table[r[0]] = np.minimum(x // max(1.0, mean / 8), 255)
    drop_cut(sums)
    return table.reshape(-1)


def sweep(k: np.ndarray, span: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by (k, span), span = least size << 32 | largest partner.

    Rows of a shingle whose size intervals overlap form a segment: only there can
    sizes and places admit a link.  Gives for each row whether it opens a segment,
    the place of its segment's first row, and the largest partner so far.
    """
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    run = np.cumsum(new).astype(np.int64) << 32
    top = np.maximum.accumulate(run + (span & 0xFFFFFFFF))
    opens = new.copy()
    opens[1:] |= (span[1:] >> 32) + run[1:] > top[:-1]
    first = np.maximum.accumulate(np.where(opens, np.arange(len(k)), 0))
    return opens, first, top - run


def rounded(x: np.ndarray, up: bool) -> np.ndarray:
    """Numbers in 16 bits, 11 of them digits: exact below 2,048, rounded up or down beyond."""
    e = np.maximum(np.frexp(x.astype(np.float64))[1] - 11, 0)
    m = (x + ((1 << e) - 1 if up else 0)) >> e
    over = m >> 11
    return ((e + over) << 11 | m >> over).astype(np.uint16)


def unrounded(c: np.ndarray) -> np.ndarray:
    return (c & 2047).astype(np.int64) << (c >> 11).astype(np.int64)


def pack_prefixes(k: np.ndarray, span: np.ndarray, node: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, least node, rows, packed rows): rows in the order of nodes, in columns, about 7 bytes each.

    The bucket and 32 bits stand for the shingle, which at worst joins regions; so
    do sizes, rounded down, and partners, rounded up.  However many buckets there
    are, a row takes as much: in rows of their own the columns would repeat their
    node, and the less of one node a bucket holds, the worse these pack.
    """
    u = k.view(np.uint64)
    bucket = ((u >> np.uint64(40)).astype(np.int64) * buckets) >> 24
    order = np.lexsort((node, bucket))
    u, span, node, bucket = u[order], span[order], node[order], bucket[order]
    least = rounded(span >> 32, False)
    partner = rounded((span & 0xFFFFFFFF) + 1 - unrounded(least), True)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(u))):
        steps = np.diff(node[lo:hi], prepend=node[lo]).astype(np.uint64)
        columns = (steps, least[lo:hi], partner[lo:hi])
        planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(hi - lo, -1).T).tobytes() for c in columns)
        yield int(bucket[lo]), int(node[lo]), int(hi - lo), u[lo:hi].astype(np.uint32).tobytes() + zlib.compress(planes, 1)


def unpack_prefixes(base: int, rows: int, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = np.frombuffer(packed, np.uint32, rows).astype(np.int64)
    planes = np.frombuffer(zlib.decompress(memoryview(packed)[4 * rows :]), np.uint8).reshape(-1, rows)
    steps, least, partner = (np.ascontiguousarray(planes[a:b].T).view(kind).reshape(-1) for a, b, kind in ((0, 8, np.uint64), (8, 10, np.uint16), (10, 12, np.uint16)))
    n = unrounded(least)
    return k, (n << 32) + n - 1 + unrounded(partner), base + np.cumsum(steps.astype(np.int64))


PACKED = ["bucket", "base", "rows", "packed"]


def _prefixes(counts, reps, sets_of: SetsOf, buckets: int):
    """Per batch and bucket: its prefix rows (k, span, a), one for each segment of sizes; as bucket -1 or less, edges from these to the segment's classes."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys, spans, nodes = [], [], []
            batch = batch.filter(pa.array(reps.value.test(batch.column(0).to_numpy())))
            # The first of a class in a task is its least row, and so the one that speaks for it, if that is here.
            for rid, s in zip(batch.column(0).to_pylist(), sets_of(batch.column(1))):
                if not len(s) or (d := digest(s)) in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(d)
                p = prefix(s, counts.value)
                keys.append(p)
                spans.append((len(s) << 32) + reach(len(s), np.arange(len(p))))
                nodes.append(np.full(len(p), rid, np.int64))
            if not keys:
                continue
            k, span, node = np.concatenate(keys).view(np.int64), np.concatenate(spans), np.concatenate(nodes)
            del keys, spans, nodes
            order = np.lexsort((span, k))
            k, span, node = k[order], span[order], node[order]
            opens, first, top = sweep(k, span, node)
            pairs = np.unique(np.stack([node[first], node], 1)[node[first] != node], axis=0)
            at = np.flatnonzero(opens)
            ends = np.append(at[1:], len(k)) - 1
            k, span, node = k[at], (span[at] >> 32 << 32) + top[ends], node[at]
            del order, opens, first, top, at, ends
            bucket, base, rows, packed = zip(*pack_prefixes(k, span, node, buckets))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(base, pa.int64()), pa.array(rows, pa.int32()), pa.array(packed, pa.binary())], PACKED)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array([-1 - (int(pairs[0, 0]) >> 33)], pa.int32()), pa.array([0]), pa.array([len(pairs)], pa.int32()), pa.array([zlib.compress(pairs.tobytes(), 1)], pa.binary())], PACKED)

    return run


def _stars(batches):
    """Packed rows by bucket: links each segment's classes to its first; passes edges on."""

    def batch_of(pairs):
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def done(parts):
        k, span, a = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((span, k))
        k, span, a = k[order], span[order], a[order]
        _, first, _ = sweep(k, span, a)
        return batch_of(np.unique(np.stack([a[first], a], 1)[a[first] != a], axis=0))

    at, parts = None, []
    for batch in batches:
        for bucket, base, rows, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if bucket < 0:
                yield batch_of(np.frombuffer(zlib.decompress(packed), np.int64).reshape(-1, 2))
                continue
            if bucket != at:
                if parts:
                    yield done(parts)
                at, parts = bucket, []
            parts.append(unpack_prefixes(base, rows, packed))
    if parts:
        yield done(parts)


def sketch_links(sketches: list[np.ndarray], n: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what pairs of sets whose sketches let them link connect: each set asks those that are left."""
    level = np.array([len(x) for x in sketches])
    groups = {}
    for m in np.unique(level):
        own = np.flatnonzero(level == m)
        groups[int(m)] = (own, np.stack([sketches[i] for i in own]))
    #: For each length of sketch the sets that are left, and their sketches in that length: its own and, halved, those of the next.
    left = {}
    for m in groups:
        own, rows = groups[m]
        more = groups.get(2 * m)
        left[m] = (own, rows) if more is None else (np.concatenate([own, more[0]]), np.concatenate([rows, halved(more[1])]))
    new, links = np.ones(len(n), bool), []
    stale = {m: 0 for m in left}

    def asked(x: int, m: int, mine: np.ndarray) -> np.ndarray:
        if m not in left:
            return np.zeros(0, np.int64)
        who, rows = left[m]
        if stale[m] > len(who) // 4:
            keep = new[who]
            left[m] = who, rows = who[keep], rows[keep]
            stale[m] = 0
        near = new[who] & (NUM * n[who] <= DEN * n[x]) & (NUM * n[x] <= DEN * n[who])
        if m < level[x]:
            near &= level[who] == m  # those of its own length were asked in that length
        near = np.flatnonzero(near)
        differ = np.bitwise_count(rows[near] ^ mine).sum(1, dtype=np.int64)
        return who[near[may_link(differ, n[who[near]], n[x])]]

    def take(x: int) -> None:
        new[x] = False
        for m in (int(level[x]), int(level[x]) // 2):
            if m in stale:
                stale[m] += 1

    for start in range(len(n)):
        if not new[start]:
            continue
        take(start)
        todo = [start]
        while todo:
            x = todo.pop()
            m, mine = int(level[x]), sketches[x]
            found = [asked(x, m, mine)]
            if m > 1:
                found.append(asked(x, m // 2, halved(mine)))
            for y in np.unique(np.concatenate(found)).tolist():
                take(y)
                links.append((x, y))
                todo.append(y)
    return links


def _split(batches):
    """Rows (root, _i, _j, rid, n, sketch) by the first three: the pairs that connect what sketches let link."""

    def done(rids, n, sketches):
        pairs = sketch_links(sketches, np.array(n, np.int64))
        return pa.RecordBatch.from_arrays([pa.array([rids[a] for a, _ in pairs], pa.int64()), pa.array([rids[b] for _, b in pairs], pa.int64())], ["a", "b"])

    at, rids, ns, sketches = None, [], [], []
    for batch in batches:
        for *key, rid, n, x in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if key != at:
                if len(rids) > 1:
                    yield done(rids, ns, sketches)
                at, rids, ns, sketches = key, [], [], []
            rids.append(rid)
            ns.append(n)
            sketches.append(np.frombuffer(x, np.uint64))
    if len(rids) > 1:
        yield done(rids, ns, sketches)


def split_regions(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """``members`` (root, _rep, n) in the smaller regions that sketches (_rid, sketch) leave; whoever is alone there goes."""
    parts = members.groupBy("root").agg(F.ceil(F.count("*") / SKETCHES).cast("int").alias("_parts")).where("_parts > 0")
    rows = members.join(sketches, members["_rep"] == sketches["_rid"]).drop("_rid").join(parts, "root").withColumn("_c", F.pmod(F.xxhash64("_rep"), F.col("_parts")).cast("int"))
    # A region of one part meets itself; of several, each pair of parts meets.
    other = F.filter(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: (F.col("_parts") == 1) | (j != F.col("_c")))
    rows = rows.withColumn("_o", F.explode(other)).select("root", F.least("_c", "_o").alias("_i"), F.greatest("_c", "_o").alias("_j"), "_rep", "n", "sketch")
    key = ["root", "_i", "_j"]
    pairs = rows.repartition(partitions(rows.sparkSession), *key).sortWithinPartitions(*key, "_rep").mapInArrow(_split, "a long, b long")
    found = components(pairs)
    return members.drop("root").join(found, members["_rep"] == found["node"]).select("root", "_rep", "n")


class Region:
    """The sets of a region with an index from shingles to their owners."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.n = sets, len(sets)
        self.size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every = every[order]
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), self.size)[order]
        self.starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        self.ends = np.append(self.starts[1:], len(every))
        self.values = every[self.starts]

    def common(self, s: np.ndarray) -> np.ndarray:
        """How many shingles of ``s`` each set holds; owners are read about a million at a time."""
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        at = at[self.values[at] == s]
        lo, width = self.starts[at], self.ends[at] - self.starts[at]
        total = np.cumsum(width)
        out = np.zeros(self.n, np.int64)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + (1 << 20), "right")))
            w = width[i:j]
            pick = np.repeat(lo[i:j] - (np.cumsum(w) - w), w) + np.arange(w.sum())
            out += np.bincount(self.owner[pick], minlength=self.n)
            i = j
        return out

    def links(self, s: np.ndarray) -> np.ndarray:
        return np.flatnonzero(linked(self.common(s), self.size, len(s)))


def cell_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the components of a region, by pivots, cells and replicas (see above)."""
    if len(sets) < 2:
        return []
    r = Region(sets)
    links: list[tuple[int, int]] = []
    left = np.ones(r.n, bool)
    while left.any():
        pivot = int(np.argmax(left))
        c = r.common(sets[pivot])
        cell = linked(c, r.size, r.size[pivot]) & left
        links += [(pivot, int(i)) for i in np.flatnonzero(cell) if i != pivot]
        left &= ~cell
        left[pivot] = False
        # Earlier cells met every document within their reach, so only what is left can be a replica.
        for y in np.flatnonzero(left & reachable(c, r.size, r.size[pivot])):
            links += [(int(y), int(i)) for i in r.links(sets[y]) if i != y]
            left[y] = False
    return links


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(n: int, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``links`` that join two components."""
    parent, kept = list(range(n)), []
    for a, b in links:
        x, y = _find(parent, a), _find(parent, b)
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def _regions(batches):
    """Rows (root, rid, set) by root: the links of each region, a spanning forest of them."""

    def done(rids, sets):
        kept = forest(len(sets), cell_links(sets))
        return pa.RecordBatch.from_arrays([pa.array([rids[a] for a, _ in kept], pa.int64()), pa.array([rids[b] for _, b in kept], pa.int64())], ["a", "b"])

    root, rids, sets = None, [], []
    for batch in batches:
        col = batch.column(2)
        for i, (r, rid) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if r != root:
                if len(rids) > 1:
                    yield done(rids, sets)
                root, rids, sets = r, [], []
            rids.append(rid)
            sets.append(np.frombuffer(col[i].as_py(), np.uint64))
    if len(rids) > 1:
        yield done(rids, sets)


def similarity_components(docs: DataFrame, key: str = "doc_id", text: str = "text", sets_of: SetsOf = shingles_of) -> DataFrame:
    """(doc_id, n_shingles, component_id, _rid, _stays): component_id is the least doc_id that links reach.

    ``sets_of`` gives the set of each text of a column, as sorted distinct 64-bit hashes.

    ``_stays`` marks one row of each component: its least id's first row.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = with_rid(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    kind = docs.schema["_key"].dataType.simpleString()
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    profile = cut(docs.select("_rid", "_key", "_text").mapInArrow(_profile(sets_of), f"_rid long, _key {kind}, n long, d1 long, d2 long, sketch binary, block int, counts binary"))
    counts = sc.broadcast(_table(spark, profile))  # of a fixed size: 2^SKETCH_LOG2 bytes
    # The tasks' counts are most of the profile, and done with.
    whole, profile = profile, cut(profile.where("block is null").drop("block", "counts"))
    drop_cut(whole)
    rows = profile.drop("sketch")

    # One text speaks for each class; the bit table lets few others through.
    classes = cut(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("_rid").alias("_rep"), F.min("_key").alias("_least"), F.min(F.struct(F.col("_key").isNull(), "_key", "_rid")).alias("_one"), F.first("n").alias("n")))
    reps = sc.broadcast(bitset(classes, "_rep"))
    buckets = 1 + (classes.agg(F.sum("n")).first()[0] or 0) * (DEN - NUM) // DEN // BUCKET_ROWS
    edges = docs.select("_rid", "_text").mapInArrow(_prefixes(counts, reps, sets_of, buckets), "bucket int, base long, rows int, packed binary").repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_stars, "a long, b long")
    regions = components(edges)
    members = cut(classes.join(regions, classes["_rep"] == regions.node).select("root", "_rep", "n"))
    members = cut(split_regions(members, profile.where("n > 0").select("_rid", "sketch")))
    links = region_links(docs, members, sets_of)
    roots = cut(components(links))

    # From links between representatives to components of documents.
    named = classes.join(roots, classes["_rep"] == roots.node, "left").select("d1", "d2", "_least", "_one", F.coalesce("root", "_rep").alias("_root"))
    lows = named.groupBy("_root").agg(F.min("_least").alias("component_id"), F.min("_one").alias("_one"))
    per_class = named.drop("_one").join(lows, "_root").select("d1", "d2", "component_id", F.col("_one")["_rid"].alias("_first"))
    some = rows.where("n > 0").join(per_class, ["d1", "d2"], "left").select(F.col("_key").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "_rid", (F.col("_first") == F.col("_rid")).alias("_stays"))
    # Documents without words link with nothing: they go round the join.
    none = rows.where("n = 0").select(F.col("_key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("_key").alias("component_id"), "_rid", F.lit(True).alias("_stays"))
    return some.unionByName(none)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, a table as it is read, with one document of each component; those without words all stay."""
    docs = stable(docs)  # both sides of the join then number its rows alike
    gone = cut(similarity_components(docs, key, text).where("NOT coalesce(_stays, false)").select("_rid"))
    bits = docs.sparkSession.sparkContext.broadcast(bitset(gone, "_rid"))
    maybe = F.arrow_udf(lambda rid: pa.array(bits.value.test(rid.to_numpy())), "boolean")
    # Few texts pass the bit table and are joined: all others stay where they are.
    boxes = boxed(docs, text).withColumn("_maybe", maybe("_rid"))
    out = boxes.where("NOT _maybe").unionByName(boxes.where("_maybe").join(gone, "_rid", "left_anti"))
    return out.select(*unboxed(out, docs.columns))


def _sets(bits, sets_of: SetsOf):
    def run(batches):
        for batch in batches:
            hit = bits.value.test(batch.column(0).to_numpy())
            if hit.any():
                some = batch.filter(pa.array(hit))
                sets = [s.tobytes() for s in sets_of(some.column(1))]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.binary())], ["_rid", "_set"])

    return run


def region_links(docs: DataFrame, members: DataFrame, sets_of: SetsOf = shingles_of) -> DataFrame:
    """(a, b): links between representatives that connect each component; exact for regions of any size."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(bitset(members, "_rep"))
    sets = docs.select("_rid", "_text").mapInArrow(_sets(bits, sets_of), "_rid long, _set binary")
    n_parts = partitions(spark)
    rows = sets.join(members, sets["_rid"] == members["_rep"]).select("root", "_rid", "_set", "n")
    large = members.groupBy("root").agg(F.sum("n").alias("_n")).where(F.col("_n") * 8 > REGION_BYTES)
    large = cut(large.withColumn("_chunks", F.ceil(F.col("_n") * 8 / REGION_BYTES).cast("int")).drop("_n"))
    if large.isEmpty():
        small, more = rows, None
    else:
        small = rows.join(large, "root", "left_anti")
        more = large_links(cut(rows.join(large, "root")))
    small = small.select("root", "_rid", "_set").repartition(n_parts, "root").sortWithinPartitions("root", "_rid").mapInArrow(_regions, "a long, b long")
    return small if more is None else small.unionByName(more)


#: Rounds of pivots that connect a large region, rounds of cells after them, and about how many pivots a round takes in each.
PIVOT_ROUNDS, SPLITS, PIVOTS = 3, 4, 32


def pivots_of(rows: DataFrame, turn: int) -> DataFrame:
    """About PIVOTS rows of each region, chosen by a hash."""
    share = rows.groupBy("root").agg(F.greatest(F.lit(1), (F.count("*") / PIVOTS).cast("long")).alias("_share"))
    return rows.join(share, "root").where(F.pmod(F.xxhash64("_rid", F.lit(turn)), F.col("_share")) == 0).drop("_share")


def _chunk(n):
    return F.pmod(F.xxhash64("_rid"), n).cast("int")


def probe(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """(a, b): every link between ``probes`` and ``rows`` of the same region.

    Rows lie in chunks, probes go to every chunk of their region in blocks; a task
    holds one chunk and one block.
    """
    blocks = probes.groupBy("root").agg((F.sum("n") * 8 / REGION_BYTES).cast("int").alias("_last"))
    at = rows.join(blocks, "root").select("root", _chunk(F.col("_chunks")).alias("_c"), F.explode(F.sequence(F.lit(0), "_last")).alias("_b"), F.lit(0).alias("_q"), "_rid", "_set")
    ask = probes.join(blocks, "root").select("root", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_c"), _chunk(F.col("_last") + 1).alias("_b"), F.lit(1).alias("_q"), "_rid", "_set")
    return solved(at.unionByName(ask))


def solved(rows: DataFrame) -> DataFrame:
    """Links between the asks (_q = 1) and the members of each (root, _c, _b), which one task holds."""
    key = ["root", "_c", "_b"]
    return rows.repartition(partitions(rows.sparkSession), *key).sortWithinPartitions(*key, "_q", "_rid").mapInArrow(_probe, "a long, b long")


def _probe(batches):
    key, region, rids, sets = None, None, [], []
    for batch in batches:
        col = batch.column(5)
        for i, (r, c, b, q, rid) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(5)))):
            if (r, c, b) != key:
                key, region, rids, sets = (r, c, b), None, [], []
            s = np.frombuffer(col[i].as_py(), np.uint64)
            if not q:
                rids.append(rid)
                sets.append(s)
            elif sets:
                region = region or Region(sets)
                found = [rids[j] for j in region.links(s) if rids[j] != rid]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([rid] * len(found)), pa.array(found)], ["a", "b"])


def large_links(rows: DataFrame) -> DataFrame:
    """Links of regions that no task holds whole.

    A few rounds of pivots, met by the whole region, connect most of it.  A link
    that is still missing has an end outside the region's largest component, and
    every such document then meets the cells that it can link into.
    """
    left, found = rows, None
    for turn in range(PIVOT_ROUNDS):
        links = probe(rows, pivots_of(left, turn))
        found = cut(links if found is None else found.unionByName(links))
        of = cut(components(found))
        sized = rows.select("root", "_rid").join(of.select(F.col("node").alias("_rid"), F.col("root").alias("_comp")), "_rid", "left").groupBy("root", "_comp").agg(F.count("*").alias("_n")).where("_comp is not null")
        main = sized.groupBy("root").agg(F.max_by("_comp", F.struct("_n", "_comp")).alias("_comp"))
        inside = of.join(main, of["root"] == main["_comp"], "left_semi").select(F.col("node").alias("_rid"))
        left = cut(rows.join(inside, "_rid", "left_anti"))
        if left.isEmpty():
            return found
    return found.unionByName(cell_joins(rows.drop("_chunks"), left.drop("_chunks")))


def cell_joins(members: DataFrame, asks: DataFrame) -> DataFrame:
    """(a, b): every link between ``asks`` and ``members`` (root, _rid, _set, n) of the same region, recursively by cells."""
    rows = members.withColumn("_q", F.lit(0)).unionByName(asks.withColumn("_q", F.lit(1)))
    found = None
    for turn in range(SPLITS + 1):
        size = F.sum("n") * 8
        sizes = rows.groupBy("root").agg(F.ceil(size / REGION_BYTES).cast("int").alias("_chunks"), F.max("_q").alias("_some"), F.min("_q").alias("_any"))
        # A cell that nothing asks, or with nothing to be asked about, has no links to give.
        rows = cut(rows.join(sizes.where("_some = 1 AND _any = 0").drop("_some", "_any"), "root"))
        small, large = rows.where("_chunks = 1"), rows.where("_chunks > 1")
        here = small.select("root", F.lit(0).alias("_c"), F.lit(0).alias("_b"), "_q", "_rid", "_set")
        links = solved(here)
        last = large.isEmpty()
        if not last and turn == SPLITS:
            links = links.unionByName(probe(large.where("_q = 0").drop("_q"), large.where("_q = 1").drop("_q")))
        found = links if found is None else found.unionByName(links)
        if last or turn == SPLITS:
            return found
        rows = cells(large, turn)


def cells(rows: DataFrame, turn: int) -> DataFrame:
    """(root, _rid, _set, n, _q): rows of large regions dealt to cells, members to one each, asks to all that they can link into."""
    spark = rows.sparkSession
    pivots = pivots_of(rows.where("_q = 0"), PIVOT_ROUNDS + turn)
    kind = ["root", "_c", "_q", "_rid", "_set", "n"]
    each = pivots.select("root", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_c"), F.lit(-1).alias("_q"), "_rid", "_set", "n")
    dealt = rows.select("root", _chunk(F.col("_chunks")).alias("_c"), "_q", "_rid", "_set", "n").unionByName(each)
    return dealt.select(*kind).repartition(partitions(spark), "root", "_c").sortWithinPartitions("root", "_c", "_q", "_rid").mapInArrow(_cells(turn), "root long, _rid long, _set binary, n long, _q int")


def cell_of(pivots: Region | None, s: np.ndarray) -> tuple[int, np.ndarray]:
    """(the cell that a set belongs to, the cells that it can link into); cell -1 is the outer one."""
    if pivots is None:
        return -1, np.array([-1])
    c = pivots.common(s)
    like = c / (pivots.size + len(s) - c)  # 1 - distance
    top, r, little = float(like.max()), 1 - NUM / DEN, 1e-9
    own = int(like.argmax()) if top > r else -1
    into = np.flatnonzero((like > 0) & (like >= top - 2 * r - little))
    return own, np.append(into, -1) if top <= 2 * r + little else into


def _cells(turn: int):
    def name(root: int, cells: np.ndarray) -> np.ndarray:
        """Should two cells share a name, they become one region, which loses nothing."""
        return H.mix(np.array([root]).view(np.uint64) * H.CHAIN[30] + np.asarray(cells, np.int64).view(np.uint64) * H.CHAIN[31] + np.uint64(turn + 1)).view(np.int64)

    def run(batches):
        at, region, sets = None, None, []
        for batch in batches:
            col, take, names, asks = batch.column(4), [], [], []
            for i, (root, c, q) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)))):
                if (root, c) != at:
                    at, region, sets = (root, c), None, []
                s = np.frombuffer(col[i].as_py(), np.uint64)
                if q < 0:
                    sets.append(s)
                    continue
                region = region or (Region(sets) if sets else None)
                own, into = cell_of(region, s)
                to = np.array([own]) if q == 0 else into
                take += [i] * len(to)
                names.append(name(root, to))
                asks += [q] * len(to)
            if take:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), batch.column(3).take(take), col.take(take), batch.column(5).take(take), pa.array(asks, pa.int32())], ["root", "_rid", "_set", "n", "_q"])

    return run
