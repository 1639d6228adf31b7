"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and is then timed, best of two.  Rule batches
include making the session and firing; results go to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ruleweave import catalog
from ruleweave.operators.session import KnowledgeBase, Session
from ruleweave.sources.tables import rows, table
from ruleweave.streaming.continuous import Config, ContinuousSession

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
BIG = 10**12

LINES = "declare LineItem l_orderkey: long l_quantity: double l_extendedprice: double l_discount: double end declare Hit key: long amount: double end "


def rule_batch(spark, text):
    s = Session(KnowledgeBase(LINES + text), spark)
    facts = table(spark, SF, "LineItem").select(*[F.col(f.name).cast(f.dataType) for f in s.kb.schemas["LineItem"].fields], F.monotonically_increasing_id().alias("_fid"))
    s.register("LineItem", facts)
    s.fire()
    return s.facts("Hit")


def simple_rule(spark):
    return rule_batch(spark, 'rule "r" when $l: LineItem($k: l_orderkey, $q: l_quantity, l_quantity > 49) then insert Hit { key = $k, amount = $q } end')


def arithmetic_rule(spark):
    return rule_batch(spark, 'rule "r" when $l: LineItem($k: l_orderkey, $p: l_extendedprice, l_extendedprice > (l_quantity * 1900)) then insert Hit { key = $k, amount = $p } end')


def insert_rule(spark):
    return rule_batch(spark, 'rule "r" when $l: LineItem($k: l_orderkey, $p: l_extendedprice, $d: l_discount) then insert Hit { key = $k, amount = $p * (1 - $d) } end')


def continuous(spark):
    text = "declare Event event_id: long value: double timestamp: long end declare Hit key: long amount: double end " + 'rule "r" when $e: Event(value > 90) then insert Hit { key = $e.event_id, amount = $e.value } end'
    s = ContinuousSession(KnowledgeBase(text), spark, Config(max_active_events=BIG, max_dedup_ids=BIG, max_batch_size=BIG, max_rules_per_step=BIG, event_retention_ms=BIG, max_future_ms=BIG, allowed_lateness_ms=BIG))
    s.push("Event", table(spark, SF, "Event").select("event_id", "value", "timestamp"), "event_id", "timestamp")
    s.advance_watermark(1_706_000_000_000)
    return s.session.facts("Hit")


def match(text, *columns):
    return lambda spark: rows(spark, SF, text, *columns)


def listed(name):
    from ruleweave import catalog_rules

    return lambda spark: (catalog.QUERIES | catalog_rules.QUERIES)[name](spark, SF)


QUERIES = {
    "simple_filter": match("$l: LineItem(l_quantity > 49)", "l__l_orderkey AS k"),
    "arithmetic_filter": match("$l: LineItem(l_extendedprice > (l_quantity * 1900))", "l__l_orderkey AS k"),
    "simple_rule": simple_rule,
    "arithmetic_rule": arithmetic_rule,
    "insert_rule": insert_rule,
    "continuous": continuous,
    "three_way_join": listed("J1_three_way"),
    "not": listed("J4_not"),
    "forall": listed("J6_forall"),
    "accumulate": match("$o: Order() $r: Number(doubleValue > 1000) from accumulate($l: LineItem(l_orderkey == $o.o_orderkey), sum($l.l_extendedprice * (1 - $l.l_discount)))", "o__o_orderkey AS k", "r__doubleValue AS v"),
    "running_window": listed("W4_running_time_window"),
    "scoring_fixpoint": listed("C1_C2_fixpoint_scoring"),
    "logical_facts": listed("M2_insert_logical"),
}


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, query in QUERIES.items():
        best = None
        for turn in range(3):
            begin = time.time()
            query(spark).write.format("noop").mode("overwrite").save()
            if turn:
                best = min(best or 1e9, time.time() - begin)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "sum of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rstrip("/").rsplit("/", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
