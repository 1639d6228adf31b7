"""Exact removal of long repeated word sequences, by recompression.

Recompression turns each text into ever fewer symbols.  First each maximal run of
equal words becomes one symbol, named by word and length.  Then in each of ROUNDS
rounds every symbol falls into one of two classes by a bit of its name, and each
pair (left class, right class) becomes one symbol.  Names are 64-bit hashes of
what they stand for, so all tasks name equal runs and pairs alike, in every
document, with no table of names to exchange between rounds.

What a symbol depends on is known: a run on the words next to it; a pair on its
two parts; a symbol that found no partner on the neighbour that it could have
merged with.  A symbol is interior to a window if all of that lies within; equal
windows have equal interior symbols.

1. Each 35-word window chooses the least name among the symbols that begin in its
   middle and depend on no word beyond the reach that every such window has.  The
   22 words about that symbol lie in every window that chooses it; they are its
   high-level name, counted globally.  A window without such a symbol (cut from a
   long run, say) is named by all its words.
2. Windows whose name occurs twice or more are candidates.  Their word sequences
   are hashed (96 bits) and met in one shuffle, with whole documents that repeat
   as one each: this verifies them.
3. Words that a window with two or more starts covers are removed.

Nulls and texts of fewer than 35 words keep all words.  Words are runs of
characters other than space and ``\\t``-``\\r``, unchanged.  Ties, repeated rows
and null ids need no rule: windows are counted by row and place.  An empty table
gives no rows; very long texts are read whole, one at a time; columns but key and
text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import bitset, partitions, with_rid

WIDTH = 35
ROUNDS = 3
#: A window's symbols begin MARGIN to MARGIN + REACH words after its start; those about a symbol, SPAN, lie in each window that chooses it.
MARGIN, REACH = 7, 14
SPAN = WIDTH - REACH + 1
#: Words after its begin on which a symbol may depend.
AHEAD = SPAN - MARGIN
NONE = np.uint64(2**64 - 1)


def recompress(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all documents' symbols the names, the words at which they begin, and the words (from, up to) that they depend on."""
    opens = np.zeros(len(h) + 1, bool)
    opens[first] = True
    # Runs: a symbol opens where a word differs from the one before it, or a document begins.
    new = opens[:-1].copy()
    new[1:] |= h[1:] != h[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(h)))
    name = np.where(size > 1, H.mix(h[at] * H.CHAIN[33] + size.astype(np.uint64) * H.CHAIN[34]), h[at])
    lo, hi = at - 1, at + size + 1
    for level in range(rounds):
        n = len(name)
        if n < 2:
            break
        right = H.mix(name + H.CHAIN[36 + level]) >> np.uint64(63) == 1
        pair = ~right[:-1] & right[1:] & ~opens[at[1:]]
        merged = H.mix(name[:-1] * H.CHAIN[40 + level] + name[1:] * H.CHAIN[48 + level])
        name, low, high = name.copy(), lo.copy(), hi.copy()
        # Without a partner: on the neighbour before it, or after it, or, at a document's end, on a word that is not there.
        low[1:] = np.where(right[1:], np.where(opens[at[1:]], at[1:] - 1, lo[:-1]), lo[1:])
        high[:-1] = np.where(right[:-1], hi[:-1], np.where(opens[at[1:]], hi[:-1] + 1, hi[1:]))
        name[:-1][pair] = merged[pair]
        low[:-1][pair], high[:-1][pair] = lo[:-1][pair], hi[1:][pair]
        keep = np.ones(n, bool)
        keep[1:] = ~pair
        name, at, lo, hi = name[keep], at[keep], low[keep], high[keep]
    return name, at, lo, hi


def _rolling(h: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A polynomial hash of each ``width`` consecutive entries."""
    up, down = H._power(f"u{salt}", H.BASE ^ (salt << 8), len(h)), H._power(f"d{salt}", pow(H.BASE ^ (salt << 8), -1, 2**64), len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(H.mix(h + H.CHAIN[salt]) * up, out=total[1:])
    return H.mix((total[width:] - total[:-width]) * down[: len(h) - width + 1])


def _least_at(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least entry of each ``width`` consecutive ones, by doubling."""
    at = np.arange(len(x))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = x[:-step], x[step:]
        at = np.where(left <= right, at[:-step], at[step:])
        x = np.minimum(left, right)
        have += step
    return at


def window_names(h: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows, each window's name, the names once for each place that gave one)."""
    n = len(h)
    mark = np.zeros(n + 1, np.int64)
    long = np.diff(first) >= width
    np.add.at(mark, first[:-1][long], 1)
    np.add.at(mark, (first[1:] - width + 1)[long], -1)
    starts = np.flatnonzero(np.cumsum(mark[:n]) > 0)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    name, at, lo, hi = recompress(h, first)
    value = np.full(n, NONE)
    near = (lo >= at - MARGIN) & (hi <= at + AHEAD)
    value[at[near]] = name[near]
    chosen = _least_at(value[MARGIN : n - width + MARGIN + REACH], REACH)[starts]
    around = _rolling(h, SPAN, 3)  # entry i: the SPAN words from i, that is, about the symbol at i + MARGIN
    some = value[chosen + MARGIN] != NONE
    names = around[chosen]
    if some.all():
        return starts, names, around[np.unique(chosen)]
    names = np.where(some, names, _rolling(h, width, 4)[starts])
    return starts, names, np.concatenate([around[np.unique(chosen[some])], names[~some]])


def _each(column: pa.Array):
    data, offsets = H.buffers(column)
    for a, b in H.slices(offsets):
        h, first = H.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, h, first


def _digests(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document 96 bits of its word sequence."""
    place = (np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
    out = []
    for salt in (24, 25):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(H.mix(h + (place + np.uint64(1)) * H.CHAIN[salt]), out=total[1:])
        out.append(H.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)))
    return out[0], out[1] >> np.uint64(32)


def _names(batches):
    """High-level names and whole documents' digests, with their numbers in the batch."""
    for batch in batches:
        for *_, h, first in _each(batch.column(0)):
            _, _, taken = window_names(h, first)
            whole = _digests(h, first)[0][np.diff(first) >= WIDTH]
            got, n = np.unique(np.concatenate([taken, whole]), return_counts=True)
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(n)], ["name", "n"])


#: A window, or (n = 0) a found place that only passes on.  Row id -1: a window without a place to report.
ROW = "h1 long, h2 int, _rid long, at int, n int"
WHOLE = -1


def _rows(h1, h2, rid, at, n) -> pa.RecordBatch:
    cols = [h1.view(np.int64), h2.astype(np.uint32).view(np.int32), rid, at.astype(np.int32), n.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["h1", "h2", "_rid", "at", "n"])


def _windows(bits, h, first, rid, starts, name):
    """Rows of the candidate windows at ``starts``; windows that repeat in the slice are found already."""
    at = starts[bits.test(name.view(np.int64))]
    h1, h2 = _rolling(h, WIDTH, 1)[at], _rolling(h, WIDTH, 2)[at] >> np.uint64(32)
    doc = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((h2, h1))
    h1, h2, rid, at = h1[order], h2[order], rid[doc][order], (at - first[doc])[order]
    new = np.ones(len(at), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    run = np.cumsum(new) - 1
    many = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, bool)
    lead = many & new
    # What is found already goes by its row's id: a hot window then sends one row from each slice to its key.
    yield _rows(np.where(many, H.mix(rid.astype(np.int64).view(np.uint64)), h1), h2, rid, at, np.where(many, 0, 1))
    if lead.any():
        k = int(lead.sum())
        yield _rows(h1[lead], h2[lead], np.full(k, -1), np.zeros(k), np.full(k, 2))


def repeated_windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_rid, at): every start of a window whose word sequence also starts elsewhere.

    Where a whole document of 35 words or more repeats, at = WHOLE stands for all
    its windows, and one copy's windows stand for all copies'.
    """
    spark = docs.sparkSession
    names = docs.select(text).mapInArrow(_names, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1")
    bits = spark.sparkContext.broadcast(bitset(names, "name"))
    n_parts = partitions(spark)

    def split(batch):
        """(h, first, rids, which documents may be copies) of each slice."""
        rid = batch.column(0).to_numpy()
        for a, b, h, first in _each(batch.column(1)):
            d1, d2 = _digests(h, first)
            yield a, h, first, rid[a:b], d1, d2, (np.diff(first) >= WIDTH) & bits.value.test(d1.view(np.int64))

    def single(batches):
        for batch in batches:
            for _, h, first, rid, *_, copy in split(batch):
                starts, name, _ = window_names(h, first)
                mine = ~copy[np.searchsorted(first, starts, "right") - 1]
                if mine.any():
                    yield from _windows(bits.value, h, first, rid, starts[mine], name[mine])

    def copies(batches):
        """Rows of the documents that may be copies, one for each text of a slice.

        Those that a slice has twice are copies for sure (n = 0): they go by row, so
        a text that a third of the rows have sends one row of a slice to its digest.
        """
        for batch in batches:
            for a, _, _, rid, d1, d2, copy in split(batch):
                at = np.flatnonzero(copy)
                if not len(at):
                    continue
                _, lead, back, many = np.unique(np.stack([d1[at], d2[at]], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
                sure, lead = at[(many > 1)[back.reshape(-1)]], at[lead]
                key1 = np.concatenate([H.mix(rid[sure].astype(np.int64).view(np.uint64)), d1[lead]]).view(np.int64)
                key2 = np.concatenate([np.zeros(len(sure), np.uint32), d2[lead].astype(np.uint32)]).view(np.int32)
                ids = np.concatenate([rid[sure], np.where(many > 1, -1, rid[lead])])
                texts = pa.array([None] * len(sure) + [batch.column(1)[a + int(i)].as_py() for i in lead], pa.string())
                n = np.concatenate([np.zeros(len(sure)), np.minimum(many, 2)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key1), pa.array(key2), pa.array(ids), texts, pa.array(n)], ["h1", "h2", "_rid", "_text", "n"])

    def classes(batches):
        """Rows by digest: windows of each class's first text, and WHOLE for its documents."""

        def flush(n, rid, body):
            h, first = H.words(*H.buffers(pa.array([body])))
            starts, name, _ = window_names(h, first)
            for rows in _windows(bits.value, h, first, np.array([rid]), starts, name):
                if n == 1:
                    yield rows
                else:  # the class's own documents are reported as a whole
                    m = rows.num_rows
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.full(m, -1)), rows.column(3), pa.array(np.full(m, 2, np.int32))], rows.schema.names)

        def whole(rids):
            r = np.array(rids, np.int64)
            k = len(r)
            return _rows(H.mix(r.view(np.uint64)), np.zeros(k), r, np.full(k, WHOLE), np.zeros(k))

        key, n, head, body = None, 0, -1, ""
        for batch in batches:
            found = []
            texts = batch.column(3)
            for i, (h1, h2, rid, m) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 1, 2, 4)))):
                if not m:
                    found.append(rid)
                    continue
                if (h1, h2) != key:
                    if n:
                        yield from flush(n, head, body)
                    key, n, head, body = (h1, h2), m, rid, texts[i].as_py()
                    continue
                found += [r for r in (head, rid) if r >= 0]
                n, head = n + m, -1
            if found:
                yield whole(found)
        if n:
            yield from flush(n, head, body)

    pair = docs.select("_rid", F.col(text).alias("_text"))
    same = pair.mapInArrow(copies, "h1 long, h2 int, _rid long, _text string, n int").repartition(n_parts, "h1", "h2")
    same = same.sortWithinPartitions("h1", "h2", "_rid").mapInArrow(classes, ROW)
    rows = pair.mapInArrow(single, ROW).unionByName(same).repartition(n_parts, "h1", "h2")
    return rows.sortWithinPartitions("h1", "h2").mapInArrow(_runs, "_rid long, at int")


def _runs(batches):
    """Rows by (h1, h2): the places of windows that are there twice or more.

    Between batches only one row is kept: the only row of the last run so far, or
    one that says that the run repeats.
    """
    carry = None
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(5)]
        found = cols[4] == 0
        out = [(cols[2][found], cols[3][found])]
        cols = [c[~found] for c in cols]
        if carry is not None:
            cols = [np.concatenate([k, c]) for k, c in zip(carry, cols)]
        h1, h2, rid, at, n = cols
        if len(h1):
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            opens = np.flatnonzero(new)
            total = np.add.reduceat(n.astype(np.int64), opens)
            hit = (total > 1)[np.cumsum(new) - 1]
            keep = hit & (rid >= 0)
            out.append((rid[keep], at[keep]))
            last = slice(opens[-1], opens[-1] + 1)
            carry = [c[last].copy() for c in cols]
            if total[-1] > 1:
                carry[2][:], carry[4][:] = -1, 2
        r, a = (np.concatenate(x) for x in zip(*out))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(a)], ["_rid", "at"])


def _strip(batches):
    for batch in batches:
        cols = {k: batch.column(k) for k in batch.schema.names}
        ids, texts, ats = cols["_key"], cols["_text"].to_pylist(), cols["_ats"]
        n_words, n_removed, kept, sha = [], [], [], []
        for i, t in enumerate(texts):
            w = t.encode().split() if t else []
            n_words.append(len(w))
            if ats[i].is_valid:
                mark = np.zeros(len(w) + 1, np.int32)
                a = ats[i].values.to_numpy()
                if (a == WHOLE).any():
                    mark[0] = 1
                else:
                    np.add.at(mark, a, 1)
                    np.add.at(mark, a + WIDTH, -1)
                w = [x for x, c in zip(w, np.cumsum(mark[:-1])) if not c]
            n_removed.append(n_words[-1] - len(w))
            body = b" ".join(w)
            kept.append(body.decode())
            sha.append(hashlib.sha256(body).hexdigest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha), pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): each row of ``docs`` without its repeated words."""
    docs = with_rid(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    hits = repeated_windows(docs, "_text")
    # One document's windows: bounded by its own words.
    per = hits.groupBy("_rid").agg(F.collect_list("at").alias("_ats"))
    kind = docs.schema["_key"].dataType.simpleString()
    return docs.join(per, "_rid", "left").select("_key", "_text", "_ats").mapInArrow(_strip, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
