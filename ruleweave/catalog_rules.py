"""Queries that run rules and streams over the test tables, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lang.tables import to_rules
from .operators.memory import shared_dir
from .operators.session import KnowledgeBase, RuleError, Session
from .plans.windows import previous
from .sources import readers
from .sources.tables import stream, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TYPES = """
declare Order o_orderkey: long o_custkey: long o_totalprice: double o_orderstatus: String o_orderpriority: String end
declare Customer c_custkey: long c_acctbal: double c_mktsegment: String c_nationkey: long end
declare Tier key: long name: String price: double end
declare Signal key: long kind: String score: long end
declare Alert key: long total: long level: String end
declare Event event_id: long user_id: long event_type: String value: double timestamp: long end
"""


def rules(name: str, text: str, facts: tuple[str, ...], show: Callable[[Session], DataFrame], sql: str, **options) -> None:
    """Registers rules over whole tables: insert the facts, fire, show."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Session(KnowledgeBase(TYPES + text, **options.get("kb", {})), spark, options.get("functions"), now=options.get("now"))
        if "before" in options:
            options["before"](s)
        for t in facts:
            kind, _, entry_point = t.partition("@")
            want = s.kb.schemas[kind]
            df = table(spark, sf_dir, kind, options.get("nearest", False))
            s.register(kind, df.select("_fid", *[F.col(f.name).cast(f.dataType) for f in want.fields]), entry_point or None)
        s.fire(**options.get("fire", {}))
        return show(s)

    QUERIES[name] = run
    SQL[name] = sql


def shown(kind: str, *columns: str) -> Callable[[Session], DataFrame]:
    return lambda s: s.facts(kind).selectExpr(*columns)


def asked(query: str, *columns: str) -> Callable[[Session], DataFrame]:
    return lambda s: s.query(query).selectExpr(*columns)


# --- changes

rules("M1_insert", 'rule "r" when $o: Order(o_totalprice > 150000) then insert Tier { key = $o.o_orderkey, name = "big", price = $o.o_totalprice * 2 } end', ("Order",), shown("Tier", "key", "name", "round(price, 4) AS price"), "SELECT o_orderkey AS key, 'big' AS name, round(o_totalprice * 2, 4) AS price FROM orders WHERE o_totalprice > 150000")
rules("M3_update", 'rule "r" no-loop when $c: Customer(c_acctbal < 0) then update $c { c_acctbal = 0, c_mktsegment = "RESET" } end', ("Customer",), shown("Customer", "c_custkey", "c_acctbal", "c_mktsegment"), "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'RESET' ELSE c_mktsegment END AS c_mktsegment FROM customer")
rules("M4_modify", 'rule "r" when $c: Customer(c_acctbal > 9000, c_mktsegment != "TOP") then modify($c) { setC_mktsegment("TOP") } end', ("Customer",), shown("Customer", "c_custkey", "c_mktsegment"), "SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'TOP' ELSE c_mktsegment END AS c_mktsegment FROM customer")
rules("M5_retract", 'rule "r" when $o: Order(o_orderstatus == "F") then retract $o end', ("Order",), shown("Order", "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
rules("M8_if", 'rule "r" when $o: Order() then if $o.o_totalprice > 200000 { insert Tier { key = $o.o_orderkey, name = "gold", price = 1.0 } } else if $o.o_totalprice > 100000 { insert Tier { key = $o.o_orderkey, name = "silver", price = 2.0 } } else { insert Tier { key = $o.o_orderkey, name = "basic", price = 3.0 } } end', ("Order",), shown("Tier", "key", "name", "price"), "SELECT o_orderkey AS key, CASE WHEN o_totalprice > 200000 THEN 'gold' WHEN o_totalprice > 100000 THEN 'silver' ELSE 'basic' END AS name, CASE WHEN o_totalprice > 200000 THEN 1.0::DOUBLE WHEN o_totalprice > 100000 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS price FROM orders")
rules("M9_switch", 'rule "r" when $o: Order() then switch $o.o_orderstatus { case "F": insert Signal { key = $o.o_orderkey, kind = "done", score = 1 } case "O": insert Signal { key = $o.o_orderkey, kind = "open", score = 2 } default: insert Signal { key = $o.o_orderkey, kind = "other", score = 3 } } end', ("Order",), shown("Signal", "key", "kind", "score"), "SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS kind, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS BIGINT) AS score FROM orders")
rules("M10_for", 'global List steps rule "r" when $c: Customer() then for $x in $steps { if $x == 2 { continue } if $x > 4 { break } insert Signal { key = $c.c_custkey, kind = "step", score = $x } } end', ("Customer",), shown("Signal", "key", "score"), "SELECT c_custkey AS key, CAST(x AS BIGINT) AS score FROM customer, (VALUES (1), (3), (4)) v(x)", before=lambda s: s.set_global("steps", [1, 2, 3, 4, 5, 6]))
rules("M11_while", 'rule "r" no-loop when $c: Customer(c_acctbal > 100) then while $c.c_acctbal > 1000 { update $c { c_acctbal = $c.c_acctbal / 2 } } end', ("Customer",), lambda s: s.facts("Customer").selectExpr("c_custkey", "round(c_acctbal, 6) AS bal"), "WITH RECURSIVE t AS (SELECT c_custkey, c_acctbal AS b FROM customer UNION ALL SELECT c_custkey, b / 2 FROM t WHERE b > 1000) SELECT c_custkey, round(min(b), 6) AS bal FROM t GROUP BY 1")
rules("M12_call", 'rule "r" when $o: Order() then call "tax.of"($o.o_totalprice) into $t insert Tier { key = $o.o_orderkey, name = $t.band, price = $t.due } end', ("Order",), shown("Tier", "key", "name", "round(price, 4) AS price"), "SELECT o_orderkey AS key, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS name, round(o_totalprice * 0.19, 4) AS price FROM orders", functions={"tax.of": lambda p: F.struct(F.when(p > 100000, "high").otherwise("low").alias("band"), (p * 0.19).alias("due"))})
rules("M14_coercion", 'rule "r" when $o: Order() then insert Signal { key = $o.o_orderkey, kind = "c", score = floor($o.o_totalprice) } end', ("Order",), shown("Signal", "key", "score"), "SELECT o_orderkey AS key, CAST(floor(o_totalprice) AS BIGINT) AS score FROM orders")

# --- fixpoint, agenda, truth maintenance

SCORING = """
rule "large" salience 100 when $o: Order($k: o_orderkey, o_totalprice > 150000) not Signal(key == $k, kind == "LARGE") then insert Signal { key = $k, kind = "LARGE", score = 40 } end
rule "urgent" salience 95 when $o: Order($k: o_orderkey, o_orderpriority == "1-URGENT") not Signal(key == $k, kind == "URGENT") then insert Signal { key = $k, kind = "URGENT", score = 35 } end
rule "poor" salience 90 when $o: Order($k: o_orderkey, $c: o_custkey) Customer(c_custkey == $c, c_acctbal < 0) not Signal(key == $k, kind == "POOR") then insert Signal { key = $k, kind = "POOR", score = 50 } end
rule "high" salience 80 when $o: Order($k: o_orderkey) $t: Number(intValue > 75) from accumulate(Signal(key == $k, $s: score), sum($s)) not Alert(key == $k) then insert Alert { key = $k, total = $t.intValue, level = "high" } end
rule "some" salience 70 when $o: Order($k: o_orderkey) $t: Number(intValue > 0, intValue <= 75) from accumulate(Signal(key == $k, $s: score), sum($s)) not Alert(key == $k) then insert Alert { key = $k, total = $t.intValue, level = "some" } end
query "alerts" $a: Alert() end
"""
SCORED = "SELECT o_orderkey AS key, CAST((CASE WHEN o_totalprice > 150000 THEN 40 ELSE 0 END) + (CASE WHEN o_orderpriority = '1-URGENT' THEN 35 ELSE 0 END) + (CASE WHEN c_acctbal < 0 THEN 50 ELSE 0 END) AS BIGINT) AS total FROM orders LEFT JOIN customer ON c_custkey = o_custkey"
rules("C1_C2_fixpoint_scoring", SCORING, ("Order", "Customer"), asked("alerts", "a.key AS key", "a.total AS total", "a.level AS level"), f"SELECT key, total, CASE WHEN total > 75 THEN 'high' ELSE 'some' END AS level FROM ({SCORED}) WHERE total > 0")
rules("C1_chain", 'rule "a" when $o: Order(o_totalprice > 250000) then insert Signal { key = $o.o_orderkey, kind = "a", score = 1 } end rule "b" when $s: Signal(kind == "a") then insert Signal { key = $s.key, kind = "b", score = $s.score + 1 } end rule "c" when $s: Signal(kind == "b") then insert Signal { key = $s.key, kind = "c", score = $s.score + 1 } end', ("Order",), shown("Signal", "key", "kind", "score"), "SELECT o_orderkey AS key, k AS kind, CAST(s AS BIGINT) AS score FROM orders, (VALUES ('a', 1), ('b', 2), ('c', 3)) v(k, s) WHERE o_totalprice > 250000")
rules("M2_insert_logical", 'rule "flag" salience 10 when $c: Customer(c_acctbal < 0) then insertLogical Signal { key = $c.c_custkey, kind = "debt", score = 1 } end rule "pay" when $c: Customer(c_acctbal < 0, c_mktsegment == "BUILDING") then update $c { c_acctbal = 1 } end', ("Customer",), shown("Signal", "key", "kind"), "SELECT c_custkey AS key, 'debt' AS kind FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING'")
rules("C3_agenda_groups", 'rule "g" agenda-group "late" when $o: Order() then insert Signal { key = $o.o_orderkey, kind = "late", score = 0 } end rule "h" agenda-group "never" when $o: Order() then insert Signal { key = $o.o_orderkey, kind = "never", score = 0 } end', ("Order",), shown("Signal", "key", "kind"), "SELECT o_orderkey AS key, 'late' AS kind FROM orders", before=lambda s: s.set_focus("late"))
rules("C4_auto_focus", 'rule "g" agenda-group "x" auto-focus true when $o: Order() then insert Signal { key = $o.o_orderkey, kind = "x", score = 0 } end', ("Order",), shown("Signal", "key"), "SELECT o_orderkey AS key FROM orders")
rules("C5_activation_group", 'rule "a" salience 5 activation-group "one" when $c: Customer(c_custkey == 3) then insert Signal { key = 1, kind = "a", score = 0 } end rule "b" activation-group "one" when $c: Customer(c_custkey == 3) then insert Signal { key = 2, kind = "b", score = 0 } end', ("Customer",), shown("Signal", "key", "kind"), "SELECT CAST(1 AS BIGINT) AS key, 'a' AS kind FROM customer WHERE c_custkey = 3")
rules("C6_no_loop", 'rule "r" no-loop when $c: Customer(c_acctbal > 0) then update $c { c_acctbal = $c.c_acctbal * 0.9 } end', ("Customer",), lambda s: s.facts("Customer").selectExpr("c_custkey", "round(c_acctbal, 4) AS bal"), "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN c_acctbal * 0.9 ELSE c_acctbal END, 4) AS bal FROM customer")
rules("C8_refraction", 'rule "r" when $c: Customer() then insert Signal { key = $c.c_custkey, kind = "seen", score = 1 } end', ("Customer",), lambda s: (s.fire(), s.facts("Signal").selectExpr("key", "score"))[1], "SELECT c_custkey AS key, CAST(1 AS BIGINT) AS score FROM customer")
rules("C9_budget", 'rule "r" when $c: Customer() then insert Signal { key = $c.c_custkey, kind = "one", score = 1 } end', ("Customer",), shown("Signal", "key"), "SELECT c_custkey AS key FROM customer ORDER BY c_custkey DESC LIMIT 7", fire={"max_rules": 7})
rules("C12_no_condition", 'rule "r" when then insert Signal { key = 1, kind = "start", score = 5 } end', (), shown("Signal", "key", "kind", "score"), "SELECT CAST(1 AS BIGINT) AS key, 'start' AS kind, CAST(5 AS BIGINT) AS score")
rules("M6_halt", 'rule "a" salience 5 when $c: Customer(c_custkey == 1) then insert Signal { key = 1, kind = "a", score = 0 } halt end rule "b" when $c: Customer() then insert Signal { key = 2, kind = "b", score = 0 } end', ("Customer",), shown("Signal", "key", "kind"), "SELECT CAST(1 AS BIGINT) AS key, 'a' AS kind")
rules("P21_disabled", 'rule "a" enabled false when $c: Customer() then insert Signal { key = 1, kind = "a", score = 0 } end rule "b" when $c: Customer() then insert Signal { key = $c.c_custkey, kind = "b", score = 0 } end', ("Customer",), shown("Signal", "key", "kind"), "SELECT c_custkey AS key, 'b' AS kind FROM customer")
rules("M7_set_focus", 'rule "a" when $c: Customer(c_custkey == 1) then setFocus("second") end rule "b" agenda-group "second" when $c: Customer() then insert Signal { key = $c.c_custkey, kind = "second", score = 0 } end', ("Customer",), shown("Signal", "key", "kind"), "SELECT c_custkey AS key, 'second' AS kind FROM customer")
rules("C7_lock_on_active", 'rule "a" salience 9 when $c: Customer(c_acctbal > -99999) then insert Signal { key = $c.c_custkey, kind = "new", score = 0 } end rule "b" lock-on-active when $s: Signal(kind == "new") then insert Alert { key = $s.key, total = 0, level = "x" } end', ("Customer",), lambda s: s.facts("Signal").selectExpr("key").unionAll(s.facts("Alert").selectExpr("key")), "SELECT c_custkey AS key FROM customer WHERE c_acctbal > -99999")
rules("X3_custom_aggregate", 'rule "r" when $c: Customer() $n: Number() from accumulate($o: Order(o_custkey == $c.c_custkey), spread($o.o_totalprice)) then insert Tier { key = $c.c_custkey, name = "spread", price = $n.doubleValue } end', ("Order", "Customer"), shown("Tier", "key", "round(price, 4) AS price"), "SELECT c_custkey AS key, round(coalesce(max(o_totalprice) - min(o_totalprice), 0), 4) AS price FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", kb={"aggregates": {"spread": lambda c: F.max(c) - F.min(c)}})

rules("J10_or_groups", 'rule "r" when $o: Order(o_totalprice > 200000) or $o: Order(o_orderpriority == "1-URGENT") then insert Signal { key = $o.o_orderkey, kind = "either", score = 1 } end', ("Order",), shown("Signal", "key", "kind"), "SELECT o_orderkey AS key, 'either' AS kind FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'either' FROM orders WHERE o_orderpriority = '1-URGENT'")
rules("J12_extends", 'rule "base" when $c: Customer(c_acctbal > 8000) then insert Signal { key = $c.c_custkey, kind = "rich", score = 1 } end rule "r" extends "base" when $o: Order(o_custkey == $c.c_custkey) then insert Signal { key = $o.o_orderkey, kind = "order of a rich one", score = 2 } end', ("Order", "Customer"), shown("Signal", "key", "kind", "score"), "SELECT c_custkey AS key, 'rich' AS kind, CAST(1 AS BIGINT) AS score FROM customer WHERE c_acctbal > 8000 UNION ALL SELECT o_orderkey, 'order of a rich one', 2 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 8000")
rules("C13_annotations", '@role(event) @author("x") rule "r" when $c: Customer(c_acctbal < 0) then insert Signal { key = $c.c_custkey, kind = "r", score = 1 } end', ("Customer",), shown("Signal", "key"), "SELECT c_custkey AS key FROM customer WHERE c_acctbal < 0")
rules("C10_duration", 'rule "r" duration 86400000 when $e: Event(event_type == "purchase") then insert Signal { key = $e.event_id, kind = "old", score = 1 } end', ("Event",), shown("Signal", "key"), "SELECT event_id AS key FROM events WHERE event_type = 'purchase' AND epoch_us(ts) // 1000 + 86400000 <= 1705500000000", now=1705500000000)


def reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: facts, what has fired and globals go; the rules stay, and fire anew on what comes then."""
    s = Session(KnowledgeBase(TYPES + 'rule "r" when $c: Customer(c_acctbal < 0) then insert Signal { key = $c.c_custkey, kind = "debt", score = 1 } end'), spark)
    s.insert("Customer", table(spark, sf_dir, "Customer").drop("_fid"))
    s.fire()
    s.reset()
    s.insert("Customer", table(spark, sf_dir, "Customer").drop("_fid").where("c_acctbal < -500"))
    s.fire()
    return s.facts("Signal").select("key")


def rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round that fails for one match leaves nothing; what fired before stays."""
    text = 'rule "a" salience 5 when $c: Customer(c_acctbal < 0) then insert Signal { key = $c.c_custkey, kind = "debt", score = 1 } end rule "b" when $c: Customer() then insert Tier { key = $c.c_custkey, name = "x", price = 1 / ($c.c_custkey - 7) } insert Signal { key = $c.c_custkey, kind = "b", score = 2 } end'
    s = Session(KnowledgeBase(TYPES + text), spark)
    want = s.kb.schemas["Customer"]
    s.insert("Customer", table(spark, sf_dir, "Customer").select(*[F.col(f.name).cast(f.dataType) for f in want.fields]))
    try:
        s.fire()
        raise AssertionError("1 / 0 did not fail")
    except RuleError:
        return s.facts("Signal").select("key", "kind").unionByName(s.facts("Tier").select("key", F.lit("tier").alias("kind")))


def rolled_back_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13, a match at a time: the matches that fail leave nothing, the others all that they do."""
    text = 'rule "b" when $n: Nation() then insert Signal { key = $n.n_nationkey, kind = "before", score = 2 } insert Tier { key = $n.n_nationkey, name = "x", price = 60 / ($n.n_nationkey - 7) } end'
    s = Session(KnowledgeBase(TYPES + "declare Nation n_nationkey: long n_regionkey: long end " + text), spark)
    s.insert("Nation", table(spark, sf_dir, "Nation").selectExpr("CAST(n_nationkey AS BIGINT) AS n_nationkey", "CAST(n_regionkey AS BIGINT) AS n_regionkey"))
    s.fire(isolate=True)
    return s.facts("Signal").select("key", "kind").unionByName(s.facts("Tier").selectExpr("key", "CAST(CAST(price AS BIGINT) AS STRING) AS kind")).withColumn("failed", F.lit(len(s.failures)))


def inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single facts and batches of them; ids follow the order of arrival."""
    s = Session(KnowledgeBase(TYPES), spark)
    s.insert_rows("Signal", [{"key": -1, "kind": "one", "score": 5}, {"key": -2, "kind": "two"}])
    s.insert("Signal", spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS key", "o_orderstatus AS kind"), order=["key"])
    ids = s.memory.types["Signal"]
    return previous(ids, "_fid", "key", "_prev").selectExpr("key", "kind", "coalesce(score, 0) AS score", "key < 0 OR key > _prev AS in_order")


QUERIES |= {"C14_reset": reset, "M13_rollback": rolled_back, "M13_isolated": rolled_back_alone, "S10_S11_inserts": inserted}
SQL |= {
    "C14_reset": "SELECT c_custkey AS key FROM customer WHERE c_acctbal < -500",
    "M13_rollback": "SELECT c_custkey AS key, 'debt' AS kind FROM customer WHERE c_acctbal < 0",
    "M13_isolated": "SELECT CAST(n_nationkey AS BIGINT) AS key, 'before' AS kind, CAST(1 AS INTEGER) AS failed FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT n_nationkey, CAST(CAST(trunc(60 / (n_nationkey - 7)) AS BIGINT) AS VARCHAR), 1 FROM nation WHERE n_nationkey <> 7",
    "S10_S11_inserts": "SELECT o_orderkey AS key, o_orderstatus AS kind, CAST(0 AS BIGINT) AS score, true AS in_order FROM orders UNION ALL SELECT -1, 'one', 5, true UNION ALL SELECT -2, 'two', 0, true",
}

# --- decision tables

DISCOUNTS = """RULE NAME,SALIENCE,CONDITION: $o: Order(o_totalprice >= $1),CONDITION: not Tier(key == $o.o_orderkey) eval($1),"ACTION: insert Tier { key = $o.o_orderkey, name = ""$1"", price = $o.o_totalprice }"
Gold,30,200000,true,gold
Silver,20,100000,true,silver
,10,0,*,basic
"""
rules("DT1_decision_table", to_rules(DISCOUNTS).replace('$o: Order(o_totalprice >= 0)', "$o: Order(o_totalprice >= 0) not Tier(key == $o.o_orderkey)"), ("Order",), shown("Tier", "key", "name"), "SELECT o_orderkey AS key, CASE WHEN o_totalprice >= 200000 THEN 'gold' WHEN o_totalprice >= 100000 THEN 'silver' ELSE 'basic' END AS name FROM orders")

# --- events

rules("S2_routed_events", 'rule "r" when $e: Event(value > 50) from entry-point "in" then insert Signal { key = $e.event_id, kind = "in", score = 0 } end rule "d" when $e: Event() then insert Signal { key = $e.event_id, kind = "default", score = 0 } end', ("Event@in",), shown("Signal", "key", "kind"), "SELECT event_id AS key, 'in' AS kind FROM events WHERE value > 50")
rules("W2_session_window", 'rule "r" when $n: Number() from accumulate($e: Event() over window:time(24h), count()) then insert Signal { key = 1, kind = "n", score = $n.intValue } end', ("Event",), shown("Signal", "score"), "SELECT count(*) AS score FROM events WHERE epoch_ms(ts) >= 1706400000000 - 86400000", now=1706400000000, nearest=True)


def _stamped(spark: SparkSession, sf_dir: str, nearest: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "Event", nearest)
    return e.select("event_id", "user_id", "event_type", "value", "timestamp")


BIG = 10**12
#: No limit stands in the way of a whole table in one batch.
OPEN = {"max_active_events": BIG, "max_dedup_ids": BIG, "max_results": BIG, "max_batch_size": BIG, "max_rules_per_step": BIG, "event_retention_ms": BIG, "dedup_retention_ms": BIG, "max_future_ms": BIG, "allowed_lateness_ms": BIG}


def _continuous(spark: SparkSession, text: str = "", recovery: str | None = None, **limits):
    from .streaming.continuous import Config, ContinuousSession

    return ContinuousSession(KnowledgeBase(TYPES + text), spark, Config(**{**OPEN, **limits}), recovery)


def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 as a stream operator: a stream in which events come twice, each kept once."""
    from .streaming.operators import collect_stream, once_each

    twice = stream(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return collect_stream(once_each(twice, "event_id", "ts", "40 days").select("event_id"))


def dedup_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch holds events twice, the next ones again; a strict push of known ones is turned away."""
    from .streaming.continuous import StepRejected

    s, e = _continuous(spark), _stamped(spark, sf_dir)
    half = e.where("value < 20")
    s.push("Event", half.unionAll(half), "event_id", "timestamp", strict=False)
    s.push("Event", e, "event_id", "timestamp", strict=False)
    try:
        s.push("Event", half, "event_id", "timestamp")
    except StepRejected as x:
        return s.session.facts("Event").select("event_id", F.lit(x.reason).alias("again"))


def lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events too late or too far ahead are left out; what is past retention goes as time moves on."""
    s = _continuous(spark, allowed_lateness_ms=3_600_000 * 24, max_future_ms=3_600_000 * 48, event_retention_ms=3_600_000 * 12)
    s.advance_watermark(1705000000000)
    s.push("Event", _stamped(spark, sf_dir, nearest=True), "event_id", "timestamp", strict=False)
    s.advance_watermark(1705040000000)
    return s.session.facts("Event").select("event_id")


def drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step stops at its budget; drains go on until nothing waits.  The batch that each fact came in."""
    s = _continuous(spark, 'rule "r" when $e: Event(value > 60) then insert Signal { key = $e.event_id, kind = "high", score = 1 } end', max_rules_per_step=400, output_types=("Signal",))
    step = s.push("Event", _stamped(spark, sf_dir), "event_id", "timestamp")
    out = step.facts["Signal"].select("key", F.lit(step.id).alias("_batch"))
    s.acknowledge(step.id)
    while step.drain_required:
        steps, facts = s.drain_on()
        for step in steps:
            s.acknowledge(step.id)
        out = out.unionByName(facts["Signal"].select("key", "_batch"))
    return out.select("key", (F.count(F.lit(1)).over(Window.partitionBy("_batch")) <= 400).alias("within_budget"))


def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session is made again from its log, goes on, and turns away what it knew before."""
    from .streaming.continuous import Config, ContinuousSession

    text = 'rule "r" when $e: Event(event_type == "purchase") then insert Signal { key = $e.event_id, kind = "buy", score = 1 } end'
    log = f"{shared_dir(spark)}/ruleweave-log-{uuid.uuid4().hex}"
    first, e = _continuous(spark, text, log), _stamped(spark, sf_dir)
    first.push("Event", e.where("value < 30"), "event_id", "timestamp")
    first.advance_watermark(1704500000000)
    second = ContinuousSession.recover(KnowledgeBase(TYPES + text), spark, log, Config(**OPEN))
    second.push("Event", e, "event_id", "timestamp", strict=False)
    return second.session.facts("Signal").select("key", F.lit(second.metrics.replay_recoveries).alias("recoveries"))


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session counts, and a limit that turns a batch away."""
    from dataclasses import asdict

    from .streaming.continuous import StepRejected

    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    s, e = _continuous(spark, max_dedup_ids=n, event_retention_ms=3_600_000 * 24), _stamped(spark, sf_dir, nearest=True)
    s.push("Event", e, "event_id", "timestamp")
    try:
        s.push("Event", e.limit(1).withColumn("event_id", F.lit(-1).cast("long")), "event_id", "timestamp")
    except StepRejected:
        s.advance_watermark(1705000000000)
    m = asdict(s.metrics)
    return spark.createDataFrame([tuple(m[k] for k in ("accepted", "active_events", "expired", "dedup_entries", "over_limit", "pending"))], "accepted long, active long, expired long, known long, over_limit long, pending long")


def named_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caller names the columns of an event's id and time, here within a record."""
    s, e = _continuous(spark), _stamped(spark, sf_dir)
    packed = e.withColumn("head", F.struct(F.col("event_id").cast("string").alias("name"), F.col("timestamp").alias("at")))
    s.push("Event", packed, "head.name", "head.at")
    s.advance_watermark(1704500000000)
    return s.session.facts("Event").select("event_id", "timestamp")


def continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushes and watermarks; alerts of users with two errors in a day."""
    text = 'rule "r" when $a: Event(event_type == "error") $b: Event(event_type == "error", user_id == $a.user_id, timestamp after $a.timestamp, within 24h of $a) then insert Signal { key = $b.event_id, kind = "pair", score = $a.event_id } end'
    s = _continuous(spark, text, output_types=("Signal",))
    e = _stamped(spark, sf_dir, nearest=True)
    for i in range(2):
        s.push("Event", e.where(F.col("event_id") % 2 == i), "event_id", "timestamp")
        s.advance_watermark(1706000000000 + i)
    out = s.pending[0].facts["Signal"]
    for b in s.pending[1:]:
        out = out.unionByName(b.facts["Signal"])
    return out.selectExpr("key AS later", "score AS earlier")


def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 on a structured stream: a continuous session as its sink."""
    s = _continuous(spark, 'rule "r" when $e: Event(event_type == "purchase", value > 40) then insert Signal { key = $e.event_id, kind = "buy", score = 1 } end')
    events = stream(spark, sf_dir, "events").withColumn("timestamp", F.unix_millis(F.col("ts").cast("timestamp"))).drop("ts", "props")
    q = s.attach(events, "Event", "event_id", "timestamp").option("checkpointLocation", f"{shared_dir(spark)}/ruleweave-stream-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.session.facts("Signal").select("key")


QUERIES |= {"T2_dedup_session": dedup_session, "T7_drain": drained, "T9_recovery": recovered, "T10_T11_metrics_limits": gauges, "T12_named_columns": named_columns}
SQL |= {
    "T2_dedup_session": "SELECT event_id, 'duplicate' AS again FROM events",
    "T7_drain": "SELECT event_id AS key, true AS within_budget FROM events WHERE value > 60",
    "T9_recovery": "SELECT event_id AS key, CAST(1 AS INTEGER) AS recoveries FROM events WHERE event_type = 'purchase'",
    "T10_T11_metrics_limits": "SELECT count(*) AS accepted, count(*) FILTER (epoch_ms(ts) > 1705000000000 - 86400000) AS active, count(*) FILTER (epoch_ms(ts) <= 1705000000000 - 86400000) AS expired, count(*) AS known, CAST(1 AS BIGINT) AS over_limit, CAST(2 AS BIGINT) AS pending FROM events",
    "T12_named_columns": "SELECT event_id, epoch_us(ts) // 1000 AS timestamp FROM events",
}
QUERIES |= {"T2_dedup_stream": dedup_stream, "T4_T6_lateness_retention": lateness, "T1_T8_continuous": continuous, "T1_micro_batches": micro_batches}
SQL |= {
    "T2_dedup_stream": "SELECT event_id FROM events",
    "T4_T6_lateness_retention": "SELECT event_id FROM events WHERE epoch_ms(ts) BETWEEN 1705000000000 - 86400000 AND 1705000000000 + 172800000 AND epoch_ms(ts) > 1705040000000 - 43200000",
    "T1_T8_continuous": "SELECT b.event_id AS later, a.event_id AS earlier FROM events a JOIN events b ON b.user_id = a.user_id AND epoch_ms(b.ts) > epoch_ms(a.ts) AND epoch_ms(b.ts) - epoch_ms(a.ts) <= 86400000 WHERE a.event_type = 'error' AND b.event_type = 'error'",
    "T1_micro_batches": "SELECT event_id AS key FROM events WHERE event_type = 'purchase' AND value > 40",
}

# --- sources and sinks


def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a JSON object for each fact."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return readers.json_facts(e, "props", spark.createDataFrame([], "k long").schema, keep=["event_id"])


def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as JSON documents of a customer, and read back by path."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice")
    docs = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("orders")).alias("customer"))).alias("doc"))
    kind = spark.createDataFrame([], "o_orderkey long, o_totalprice double").schema
    return readers.json_facts(docs, "doc", kind, "$.customer.orders[*]", keep=["o_custkey"])


def yaml_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML documents."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("nation:\n  key: "), "n_nationkey", F.lit("\n  name: "), "n_name").alias("doc"))
    return readers.yaml_facts(n, "doc", spark.createDataFrame([], "key long, name string").schema, "$.nation")


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as CSV and XML texts, and back."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("CAST(n_nationkey AS BIGINT) AS k", "n_name AS name")
    a = readers.csv_column(readers.serialise(n, "csv", "t"), "t", n.schema).withColumn("form", F.lit("csv"))
    b = readers.xml_column(readers.serialise(n, "xml", "t"), "t", n.schema).withColumn("form", F.lit("xml"))
    return a.unionByName(b)


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document that arrives in pieces; all its facts come at once."""
    from .sources.feeds import Feed

    n = spark.read.parquet(f"{sf_dir}/region.parquet")
    doc = n.agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("kind"))).alias("all")))).first()[0]
    s = Session(KnowledgeBase(TYPES), spark)
    f = Feed(s, "Signal", "json", "$.all[*]")
    for i in range(0, len(doc), 7):
        f.feed(doc[i : i + 7])
    f.finish()
    return s.facts("Signal").select("key", "kind")


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a query's matches as another kind."""
    from .operators.results import Results
    from .plans.match import output
    from .sources.tables import ask

    return Results(output(ask(spark, sf_dir, "$l: LineItem()"))).field("l", "l_quantity", "int")


QUERIES |= {"S9_chunks": chunked, "R3_S15_typed_fields": typed}
SQL |= {"S9_chunks": "SELECT CAST(r_regionkey AS BIGINT) AS key, r_name AS kind FROM region", "R3_S15_typed_fields": "SELECT CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem"}
QUERIES |= {"S3_json": json_source, "S4_json_path": json_path, "S5_yaml": yaml_source, "S6_S7_csv_xml": text_forms}
SQL |= {
    "S3_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "S4_json_path": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders",
    "S5_yaml": "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation",
    "S6_S7_csv_xml": "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, form FROM nation, (VALUES ('csv'), ('xml')) v(form)",
}
