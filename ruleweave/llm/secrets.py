"""Secret scans with a trigram inverted index, in DataFrame functions alone.

Each rule's regex gives a Boolean query over trigrams that every match must
hold (``trigrams.query_of`` derives it from the parsed regex).  One scan builds the postings of those trigrams, the
postings are intersected per document into the rules that it may match, and
only these rules' regexes run on it.  A rule without mandatory trigrams (hex)
scans every text.

Positions come from Java's regex by ``split`` and ``regexp_extract_all``: the
pieces between matches and the matches alternate, so running sums of their
lengths in code points are the spans.  Letters match in either case within
ASCII only.  Null text counts as empty; repeated rows and null ids are rows of
their own; empty tables give no rows; very long texts are scanned whole.  Columns
of the input may have any name but _spans, which gives way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, fresh, unboxed
from .trigrams import Query, grams_of, query_of

# The kinds, their patterns and the least length of a match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a maximal run of 24 or more: the same as runs of 1 or more, short ones dropped


@dataclass(frozen=True)
class Rule:
    """``group`` and ``least``: matches whose group is shorter than ``least`` code points are dropped."""

    kind: str
    pattern: str
    group: int
    least: int


RULES = (Rule("assign", ASSIGN, 2, 6), Rule("access", ACCESS, 0, 20), Rule("hex", HEX, 0, 24))
#: Trigrams whose presence one long holds; matches whose places are summed at once.
WORD, BLOCK = 62, 256


def plan_trigrams(rules: tuple[Rule, ...]) -> tuple[list[str], dict[str, Query]]:
    """All trigrams of the index, and each rule's query, derived from its regex; True means a full scan."""
    queries = {r.kind: query_of(r.pattern) for r in rules}
    return sorted(set().union(*map(grams_of, queries.values()))), queries


def postings(docs: DataFrame, grams: list[str], text: str = "text") -> DataFrame:
    """The inverted index: a row (gram, _rid) for each trigram of ``grams`` that a text holds, case aside."""
    low = docs.select("_rid", F.lower(text).alias("_low"))
    found = F.filter(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]), lambda x: x.isNotNull())
    return low.select("_rid", F.explode(found).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Intersects postings: for each document the rules (as bits) whose query its trigrams satisfy."""
    grams, queries = plan_trigrams(rules)
    words = range(-(-len(grams) // WORD))
    place = {g: divmod(i, WORD) for i, g in enumerate(grams)}
    held = index.groupBy("_rid").agg(*[F.bit_or(F.expr(f"CASE WHEN gram div {WORD} = {w} THEN shiftleft(1L, CAST(gram % {WORD} AS INT)) ELSE 0L END")).alias(f"_w{w}") for w in words])

    def holds(q: Query) -> Column:
        if isinstance(q, str):
            word, bit = place[q]
            return F.col(f"_w{word}").bitwiseAND(F.lit(1 << bit)) != 0
        sides = [holds(x) for x in q[1]]
        return reduce((lambda a, b: a & b) if q[0] == "and" else (lambda a, b: a | b), sides)

    masks = F.lit(0)
    for i, r in enumerate(rules):
        if queries[r.kind] is not True:
            masks = masks + F.when(holds(queries[r.kind]), 1 << i).otherwise(0)
    return held.select("_rid", masks.alias("_rules")).where("_rules > 0")


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans_of(text: Column, order: int, rule: Rule) -> Column:
    """Array of (start, order, end) of the rule's matches that are long enough."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    lengths = F.transform(F.split(text, rule.pattern, -1), F.length)

    def step(acc: Column, z: Column) -> Column:
        begin = acc["at"] + z["p"]
        one = F.array(F.struct(begin.alias("start"), F.lit(order).alias("kind"), (begin + z["n"]).alias("end")))
        return F.struct((begin + z["n"]).alias("at"), F.concat(acc["out"], F.when(z["g"] >= rule.least, one).otherwise(_none())).alias("out"))

    zipped = F.transform(F.arrays_zip(whole.alias("m"), part.alias("g"), F.slice(lengths, 1, F.size(whole)).alias("p")), lambda z: F.struct(z["p"].alias("p"), F.length(z["m"]).alias("n"), F.length(z["g"]).alias("g")))
    # Running sums by blocks: within a block from 0, then each block from where the one before it ends.
    def sums(z: Column) -> Column:
        last = F.ceil(F.size(z) / BLOCK).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(z, b * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), _none().alias("out")), step))

    def placed(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        pairs = F.arrays_zip(blocks.alias("b"), F.slice(starts, 1, F.size(blocks)).alias("base"))
        return F.flatten(F.transform(pairs, lambda x: F.transform(x["b"]["out"], lambda s: F.struct((s["start"] + x["base"]).alias("start"), s["kind"].alias("kind"), (s["end"] + x["base"]).alias("end")))))

    return _let(zipped, lambda z: F.when(F.size(z) > 0, _let(sums(z), placed)).otherwise(_none()))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", name: str = "_spans") -> DataFrame:
    """All columns of ``docs`` with ``name``: an array of (start, kind, end) by start, then kind's place in ``rules``."""
    columns = [c for c in docs.columns if c != name]
    boxes = boxed(docs, text, name)
    grams, queries = plan_trigrams(rules)
    cand = candidates(postings(boxes.select("_rid", "_text"), grams, "_text"), rules)
    joined = boxes.join(cand, "_rid", "left")
    body = F.coalesce(F.col("_text"), F.lit(""))
    found = []
    for i, r in enumerate(rules):
        maybe = F.expr(f"coalesce(_rules, 0) & {1 << i}") != 0 if queries[r.kind] is not True else F.lit(True)
        found.append(F.when(maybe & body.rlike(r.pattern), spans_of(body, i, r)).otherwise(_none()))
    return joined.select(*unboxed(joined, columns), F.array_sort(F.concat(*found)).alias(name))


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with the found spans replaced by ``mark``; overlapping spans are replaced once; null text stays null."""
    name = fresh(docs.columns, "_spans")
    found = scan(docs, rules, text, name)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate(name, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return found.withColumn(text, F.when(F.size(name) > 0, clean).otherwise(F.col(text))).drop(name)
