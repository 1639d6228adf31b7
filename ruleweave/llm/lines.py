"""Line dedup over windows of three lines, in DataFrame functions alone.

A text's lines are its pieces between line feeds.  Every three consecutive
lines of one document form a window; windows are equal if their three lines
are.  Of equal windows the first (smallest doc_id, then read order, then line)
is the original; every line that a later occurrence covers goes.  So five equal
lines in a row leave one, as the later windows overlap the first.

Texts of fewer than three lines (null and empty ones too) have no window and
stay as they are.  A null doc_id sorts before all others.  Every window counts,
one of blank lines or of rules too.  Repeated rows are rows of their own: the
second loses its lines.  An empty table gives no rows.  Very long texts need no
rule: a text's lines are one array in the task that reads it.  Columns of the
input with the names of those made here give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, unboxed

WIDTH = 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def windows(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """A row (_h1, _h2, _id, _rid, _at) for each window; the hashes are 128 bits in all."""
    lines = docs.select(F.col(key).alias("_id"), "_rid", _lines(text).alias("_l")).where(F.size("_l") >= width)
    hashed = lines.select("_id", "_rid", F.transform("_l", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))).alias("_l"))
    at = F.sequence(F.lit(1), F.size("_l") - (width - 1))

    def window(i: Column) -> Column:
        each = [F.element_at(F.col("_l"), i + j) for j in range(width)]
        return F.struct((i - 1).alias("_at"), F.xxhash64(*[x["a"] for x in each]).alias("_h1"), F.xxhash64(*[x["b"] for x in each]).alias("_h2"))

    return hashed.select("_id", "_rid", F.inline(F.transform(at, window)))


def removed_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(_rid, _gone): for each document that loses lines, the sorted places of these lines, from 0."""
    w = windows(docs, text, key, width)
    place = F.struct(F.col("_id"), F.col("_rid"), F.col("_at"))
    # Counting and taking the least are combined before the shuffle, so a window
    # that a third of the rows hold arrives as one row from each task.
    repeated = w.groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where("_n > 1").drop("_n")
    # The join's hot keys are split by adaptive execution: ``repeated`` has one row for each.
    late = w.join(repeated, ["_h1", "_h2"]).where(F.col("_first") != place)
    # One document's windows only, so bounded by its own lines.
    per = late.groupBy("_rid").agg(F.collect_list("_at").alias("_late"))
    covered = F.array_distinct(F.flatten(F.transform("_late", lambda i: F.sequence(i, i + (width - 1)))))
    return per.select("_rid", F.array_sort(covered).alias("_gone"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, made: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of ``docs``, its text without the removed lines, and the two columns ``made``: lines, and lines removed.

    A text that loses every line becomes empty, not null.
    """
    boxes = boxed(docs, text, *made)
    narrow = boxes.select("_rid", "_text", F.col("_row").getField(key).alias("_id"))
    out = boxes.join(removed_lines(narrow, "_text", "_id", width), "_rid", "left")
    lines, gone = _lines("_text"), F.coalesce(F.size("_gone"), F.lit(0))
    at = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.transform(F.array_except(at, F.col("_gone")), lambda i: F.element_at(lines, i + 1))
    new = F.when(gone > 0, F.array_join(kept, "\n")).otherwise(F.col("_text")).alias(text)
    counts = {n: c.cast("long").alias(n) for n, c in zip(made, (F.coalesce(F.size(lines), F.lit(0)), gone))}
    return out.select(*unboxed(out, [c for c in docs.columns if c not in made], **{text: new}, **counts))
