"""Shortest-pack-first packing over the histogram of lengths.

A text's ids (with the end id) are cut into full pieces of the capacity and a
rest.  Only the histogram of piece lengths, at most ``capacity`` rows, is
planned, on the driver: lengths are placed longest first, each into the packs
that have the most room left, and the counts of equal packs are updated
together.  A plan's entry says: pieces of this length with these ranks go to
these sequences at this offset.  Pieces find their entry by (length, rank).

Ranks come from counts of each partition, so equal lengths, even of a
third of all rows, are numbered without one task that holds them all.

Null and empty texts are one piece with the end id alone.  Repeated rows are
packed each; null ids come first; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, with_rid

PIECE = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, _rid long"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Entries (length, first rank, count, first sequence, offset).

    ``open_packs`` holds groups of packs with equal room: (-room, first sequence, count).
    A length fills whole groups and at most one in part, so the number of entries
    is bounded by the number of lengths and groups, whatever the counts are.
    """
    entries, packs, next_seq = [], [], 0
    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while count:
            if packs and -packs[0][0] >= length:
                room, seq, n = heapq.heappop(packs)
                room = -room
                # As many of this length in one pack as keeps packs of the group level.
                used = min(n, count)
                entries.append((length, rank, used, seq, capacity - room))
                if room > length:
                    heapq.heappush(packs, (-(room - length), seq, used))
                if used < n:
                    heapq.heappush(packs, (-room, seq + used, n - used))
            else:
                used = count if 2 * length > capacity or not count else -(-count // max(1, capacity // length))
                entries.append((length, rank, used, next_seq, 0))
                if capacity > length:
                    heapq.heappush(packs, (-(capacity - length), next_seq, used))
                next_seq += used
            rank += used
            count -= used
    return entries


def pieces(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], Iterable[list[int]]]], end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece; ids stay in the task that made them, only their checksum leaves it."""

    def run(batches):
        encode = encoder()
        for batch in batches:
            out = []
            col = batch.column(2)
            for i0 in range(0, batch.num_rows, 256):
                texts = [t or "" for t in col.slice(i0, 256).to_pylist()]
                for j, ids in enumerate(encode(texts)):
                    raw = np.asarray([*ids, end_id], "<u4")
                    out += [(i0 + j, a, len(p := raw[a : a + capacity]), zlib.crc32(p.tobytes()), len(raw)) for a in range(0, len(raw), capacity)]
            if out:
                at, start, length, crc, total = (pa.array(x, pa.int64()) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), start, length, crc, total, batch.column(0).take(at)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rid"])

    docs = with_rid(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))).select("_rid", "_key", "_text")
    kind = docs.schema["_key"].dataType.simpleString()
    return docs.mapInArrow(run, PIECE.format(kind=kind))


def pack(docs: DataFrame, encoder, end_id: int, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    # Ids are made once; the partition that made a piece numbers it.
    parts = cut(pieces(docs, encoder, end_id, capacity, key, text).withColumn("_pid", F.spark_partition_id()))
    by = parts.groupBy("_pid", "length").agg(F.count("*").alias("n"))
    # At most capacity rows for each partition; the window over them is keyed by length.
    earlier = Window.partitionBy("length").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by.select("_pid", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n0"))
    histogram = {r[0]: r[1] for r in by.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    entries = plan(histogram, capacity)
    steps = {}
    for e in sorted(entries):
        steps.setdefault(e[0], []).append(e)
    table = {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in steps.items()}
    shared = spark.sparkContext.broadcast(table)

    def place(batches):
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            length, rank = cols["length"].to_numpy(), cols["_rank"].to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts):
                if len(at):
                    _, first, _, start, offset = shared.value[int(length[at[0]])]
                    k = np.searchsorted(first, rank[at], "right") - 1
                    seq[at], off[at] = start[k] + rank[at] - first[k], offset[k]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*[cols[n] for n in names], pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    within = Window.partitionBy("_pid", "length").orderBy("_rid", "start")
    ranked = parts.withColumn("_i", F.row_number().over(within) - 1).join(offsets, ["_pid", "length"]).withColumn("_rank", F.col("_n0") + F.col("_i"))
    kind = parts.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rank").mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


_CODECS: dict[tuple[str, str], tuple] = {}


def codec_for(path_json: str, pattern: str):
    """The worker's codec of a tokenizers file: its merge order as ranks; its added tokens and a pattern that cuts texts at them."""
    if (path_json, pattern) not in _CODECS:
        import json

        import tiktoken

        with open(path_json, encoding="utf-8") as f:
            given = json.load(f)
        vocab, tokens = given["model"]["vocab"], given.get("added_tokens") or []
        if odd := [t["content"] for t in tokens if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]:
            raise ValueError(f"added tokens that take in or ask for their surroundings: {odd}")
        added = {t["content"]: t["id"] for t in tokens}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in added}
        codec = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # The longest of those that begin at one place; without any a pattern that matches nowhere.
        at = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})" if added else "((?!))")
        _CODECS[path_json, pattern] = codec, added, at
    return _CODECS[path_json, pattern]


def bpe_encoder(path_json: str, pattern: str):
    def make():
        codec, added, at = codec_for(path_json, pattern)

        def encode(texts):
            parts = [at.split(t) for t in texts]  # every second part is an added token
            coded = iter(codec.encode_ordinary_batch([p for x in parts for p in x[::2]], num_threads=1))
            for x in parts:
                ids = list(next(coded))
                for token in x[1::2]:
                    ids += [added[token], *next(coded)]
                yield ids

        return encode

    return make
