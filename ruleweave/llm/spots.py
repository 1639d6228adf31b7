"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

Words are runs of characters other than white space and ASCII punctuation, with
A-Z in lower case.  Every common word (ANCHORS) is an anchor; it and the next
CHAIN content words of the text make a signature, 32 bits of their hash.  Where GAP
words pass without a common one (tables, lists), every word is an anchor.  A
text's fingerprint is its sorted set of signatures, in base64.  A text without
any anchored chain takes chains at every word, and one of fewer than CHAIN + 1
content words its whole word sequence (a text without words, its bytes), so only
null and empty texts have the empty fingerprint.

Likeness is the Jaccard similarity of the sets; two empty ones are alike (1).

``alike_components`` compares a whole corpus.  Sets are partitioned by length, in
intervals that can reach the threshold; within them an inverted index of each
set's rarest signatures brings candidates together, and Jaccard similarity is
pruned by lengths and by what is left of the sets (the join in ``jaccard``).
``alike`` is the same test for one pair: length classes of the ratio 0.75 that are
not next to each other, or too little left of the sets, end it early.

Null ids come first in order; repeated rows are documents each; an empty table
gives no rows; a very long text is held whole with its neighbour by one task.
Columns of the input but key and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import even_keys, partitions, with_rid
from .jaccard import similarity_components

# Common words of English, French, German and Spanish.
ANCHORS = (
    "the of and to in a is that was for on with as by at from this be are or an it he you have not but had they his her she we all which there their been has will would what if can when who"
    " le la les de des du et un une est en que qui dans pour pas sur avec au ce il elle ne se plus par sont ou son aux"
    " der die das und ist von zu mit den im ein eine dem nicht als auch auf es an werden aus er hat dass sie nach bei um wie über für"
    " el los las y una del con por su para es lo como más al o pero sus se no"
).split()
CHAIN = 2
#: Words without a common one after which every word is an anchor, until the next common one: tables, lists, names.
GAP = 8
THRESHOLD = 0.75
#: Signatures that ``alike`` looks up at once.
STRIDE = 64

SPLIT = H.WHITE.copy()
SPLIT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = H.buffers(column)
    starts, ends, first = H.word_spans(data, offsets, SPLIT)
    return H.hash_spans(data, starts, ends, lower=True), first


COMMON = np.sort(_hashes(pa.array([" ".join(dict.fromkeys(ANCHORS))]))[0])


def _chains(h: np.ndarray, first: np.ndarray, anchors: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) of each anchor that has CHAIN content words after it in its document."""
    doc_end = first[np.searchsorted(first, anchors, "right")]
    at = np.searchsorted(content, anchors, "right")
    room = at + CHAIN <= len(content)
    anchors, at, doc_end = anchors[room], at[room], doc_end[room]
    good = content[at + CHAIN - 1] < doc_end if len(at) else np.zeros(0, bool)
    anchors, at = anchors[good], at[good]
    sig = h[anchors] * H.CHAIN[0]
    for j in range(CHAIN):
        sig = sig + h[content[at + j]] * H.CHAIN[j + 1]
    return np.searchsorted(first, anchors, "right") - 1, (H.mix(sig) >> np.uint64(32)).astype(np.uint32)


def signature_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct signatures of each text."""
    h, first = _hashes(pa.array(texts, pa.large_string()))
    n = len(texts)
    common = np.isin(h, COMMON)
    content = np.flatnonzero(~common)
    place = np.arange(len(h))
    opening = np.repeat(first[:-1], np.diff(first)) - 1
    since = place - np.maximum(np.maximum.accumulate(np.where(common, place, -1)) if len(h) else place, opening)
    doc, sig = _chains(h, first, np.flatnonzero(common | (since > GAP)), content)
    found = np.split(sig, np.searchsorted(doc, np.arange(1, n)))
    out = []
    for i in range(n):
        s = found[i]
        if not len(s) and texts[i]:
            here = h[first[i] : first[i + 1]]
            mine = np.flatnonzero(~common[first[i] : first[i + 1]])
            _, s = _chains(here, np.array([0, len(here)]), np.arange(len(here)), mine) if len(mine) > CHAIN else (None, s)
            if not len(s):
                s = np.frombuffer(hashlib.sha256(here.tobytes() or texts[i].encode()).digest()[:4], np.uint32)
        out.append(np.unique(s))
    return out


def text_of(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def set_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def length_class(n: int, threshold: float = THRESHOLD) -> int:
    """Partition of a set's length; sets as alike as the threshold differ by one class at most."""
    return 0 if n < 1 else 1 + int(math.log(n) / -math.log(threshold))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def alike(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the threshold; ends as soon as it cannot."""
    if abs(length_class(len(a), threshold) - length_class(len(b), threshold)) > 1:
        return False
    if not len(a) or not len(b):
        return len(a) == len(b)
    if len(a) > len(b):
        a, b = b, a
    whole = len(a) + len(b)
    need = math.ceil(threshold * whole / (1 + threshold) - 1e-9)
    common = 0
    for i in range(0, len(a), STRIDE):
        if common + len(a) - i < need:
            return False
        part = a[i : i + STRIDE]
        lo, hi = np.searchsorted(b, part[0]), np.searchsorted(b, part[-1], "right")
        common += int(np.isin(part, b[lo:hi], assume_unique=True).sum())
    return common >= threshold * (whole - common) - 1e-9


def signatures_of(column: pa.Array):
    """Each text's signatures as sorted 64-bit hashes, some texts at a time."""
    _, offsets = H.buffers(column)
    for a, b in H.slices(offsets):
        for s in signature_sets([t or "" for t in column.slice(a, b - a).to_pylist()]):
            yield np.sort(H.mix(s.astype(np.uint64)))


def alike_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_signatures, component_id): documents linked by fingerprints at THRESHOLD or more.

    component_id is the least doc_id that links reach; null and empty texts link with nothing.
    """
    found = similarity_components(docs, key, text, signatures_of)
    return found.select("doc_id", F.col("n_shingles").alias("n_signatures"), "component_id")


def _bounds(narrow: DataFrame) -> list:
    """The first row (doc_id, row id) of each range partition, in order: as many as partitions at most."""
    n = partitions(narrow.sparkSession)
    parts = narrow.repartitionByRange(n, F.col("_key").asc_nulls_first(), "_rid")
    rows = parts.groupBy(F.spark_partition_id().alias("_p")).agg(F.min(F.struct(F.col("_key").isNotNull().alias("some"), "_key", "_rid")).alias("m")).collect()
    return sorted((tuple(r["m"]) for r in rows), key=lambda m: (m[0], m[1] if m[0] else 0, m[2]))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (_bucket, _key, _rid, _tail, _text), partitioned by bucket and sorted: each row is followed by the next.

    The order is by key, nulls first, then read order.  Buckets are ranges of it;
    each ends with a copy (_tail) of the first row of the next one, the last with
    the first of all.  Texts move once, and no task needs more than two rows.
    """
    docs = with_rid(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    bounds = _bounds(docs.select("_key", "_rid"))
    kind = docs.schema["_key"].dataType
    spark = docs.sparkSession
    n = partitions(spark)
    slots = even_keys(spark, n)
    if not bounds:
        return docs.select(F.lit(0).cast("long").alias("_bucket"), "_key", "_rid", F.lit(0).alias("_tail"), "_text")
    shared = spark.sparkContext.broadcast(bounds)

    def bucket(batches):
        import bisect

        # With one bound more than partitions at most, a search for each row.
        order = [(m[0], m[1] if m[0] else 0, m[2]) for m in shared.value]
        for batch in batches:
            keys, rids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at, copies = [], []
            for i, (k, r) in enumerate(zip(keys, rids)):
                me = (k is not None, k if k is not None else 0, r)
                b = max(0, bisect.bisect_right(order, me) - 1)
                at.append(slots[b % n])
                if order[b] == me:
                    copies.append((i, slots[(b - 1) % len(order) % n]))
            rows = [*range(len(keys)), *(i for i, _ in copies)]
            cols = [pa.array(at + [b for _, b in copies], pa.int64()), batch.column(0).take(rows), batch.column(1).take(rows), pa.array([0] * len(keys) + [1] * len(copies), pa.int32()), batch.column(2).take(rows)]
            yield pa.RecordBatch.from_arrays(cols, ["_bucket", "_key", "_rid", "_tail", "_text"])

    dealt = docs.select("_key", "_rid", "_text").mapInArrow(bucket, f"_bucket long, _key {kind.simpleString()}, _rid long, _tail int, _text string")
    return dealt.repartition(n, "_bucket").sortWithinPartitions("_bucket", "_tail", F.col("_key").asc_nulls_first(), "_rid")


def _compare(batches):
    """For each row its fingerprint, its edited text's, and the likenesses."""
    rows: list[tuple] = []
    held = 0

    def flush(rows):
        texts = [r[3] for r in rows]
        sets = signature_sets(texts)
        mine = [i for i in range(len(rows) - 1) if not rows[i][2] and rows[i + 1][0] == rows[i][0]]
        if not mine:
            return
        edited = []
        for i in mine:
            t = texts[i]
            k = len(t) // 4
            edited.append(t[: len(t) - k] + texts[i + 1][:k])
        changed = signature_sets(edited)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][1] for i in mine], rows[0][4]),
                pa.array([len(texts[i]) for i in mine], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array([text_of(sets[i]) for i in mine]),
                pa.array([text_of(c) for c in changed]),
                pa.array([likeness(sets[i], c) for i, c in zip(mine, changed)], pa.float64()),
                pa.array([likeness(sets[i], sets[i + 1]) for i in mine], pa.float64()),
                pa.array([length_class(len(sets[i])) for i in mine], pa.int32()),
                pa.array([alike(sets[i], c) for i, c in zip(mine, changed)]),
                pa.array([alike(sets[i], sets[i + 1]) for i in mine]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "length_class", "alike_edited", "alike_next"],
        )

    for batch in batches:
        kind = batch.schema.field(1).type
        texts = batch.column(4)
        for i, (b, k, t) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 1, 3)))):
            body = texts[i].as_py() or ""
            rows.append((b, k, t, body, kind))
            held += len(body)
            if held > 1 << 20 and len(rows) > 1:
                yield from flush(rows)
                rows, held = rows[-1:], len(body)
    if len(rows) > 1:
        yield from flush(rows)


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited text and the next document; a lone document is its own next one."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, length_class int, alike_edited boolean, alike_next boolean"
    return with_next(docs, key, text).mapInArrow(_compare, schema)
