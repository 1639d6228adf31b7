"""Queries over the test tables, one or more for each kind of condition, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.tables import planner, rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def ask(name: str, text: str, columns: str, sql: str, **options) -> None:
    """Registers a condition in the rule language, the columns to show and the same in SQL."""
    QUERIES[name] = lambda spark, sf_dir: rows(spark, sf_dir, text, *[c.strip() for c in columns.split(";")], **options)
    SQL[name] = sql


# --- scans and projections

ask("S1_type_scan", "$r: Region()", "r__r_regionkey AS regionkey; r__r_name AS name", "SELECT r_regionkey AS regionkey, r_name AS name FROM region")
ask("S2_entry_point", '$e: Event() from entry-point "purchase"', "e__event_id AS id; e__value AS value", "SELECT event_id AS id, value FROM events WHERE event_type = 'purchase'")
ask("R1_bind_whole_fact", "$n: Nation(n_regionkey == 1)", "n__n_nationkey AS k; n__n_name AS name; n__n_regionkey AS region", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey = 1")
ask("P18_inline_binding", "$c: Customer($k: c_custkey, $bal: c_acctbal > 9000)", "c__c_custkey AS k; c__c_acctbal AS bal", "SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE c_acctbal > 9000")

# --- filters

ask("P1_numeric", "$o: Order(o_totalprice >= 200000, o_custkey != 7)", "o__o_orderkey AS k; o__o_totalprice AS price", "SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_totalprice >= 200000 AND o_custkey <> 7")
ask("P2_text", '$p: Part(p_brand >= "Brand#3", p_brand < "Brand#4")', "p__p_partkey AS k; p__p_brand AS brand", "SELECT p_partkey AS k, p_brand AS brand FROM part WHERE p_brand >= 'Brand#3' AND p_brand < 'Brand#4'")
ask("P2_time_text", '$o: Order(o_orderdate < "1995-03-01")', "o__o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01'")
ask("P3_mixed_kinds", '$o: Order(o_totalprice != "x")', "o__o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice IS NOT NULL")
ask("P4_contains", '$p: Part(p_name contains "a", p_type not contains "STEEL")', "p__p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE contains(p_name, 'a') AND NOT contains(p_type, 'STEEL')")
ask("P5_starts_ends", '$c: Customer(c_mktsegment startsWith "B", c_name endsWith "3")', "c__c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE starts_with(c_mktsegment, 'B') AND ends_with(c_name, '3')")
ask("P6_length_is", "$n: Nation(n_name lengthIs 8)", "n__n_nationkey AS k", "SELECT n_nationkey AS k FROM nation WHERE strlen(n_name) = 8")
ask("P7_matches", '$c: Customer(c_name matches "[02468]$", c_mktsegment not matches "^(A|B)")', "c__c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE regexp_matches(c_name, '[02468]$') AND NOT regexp_matches(c_mktsegment, '^(A|B)')")
ask("P8_collection_contains", "$e: Embedding(label == 3)  $f: Embedding(vec_id == $e.vec_id, embedding contains $e.embedding[0])", "e__vec_id AS k", "SELECT vec_id AS k FROM embeddings WHERE label = 3 AND list_contains(embedding, embedding[1])")
ask("P9_member_of", "$e: Embedding(label memberOf $wanted, vec_id not memberOf $known)", "e__vec_id AS k", "SELECT vec_id AS k FROM embeddings WHERE label IN (1, 3) AND vec_id NOT IN (5, 8, 13)", globals_={"wanted": [1, 3], "known": [5, 8, 13]})
ask("P11_in", '$o: Order(o_orderpriority in ("1-URGENT", "2-HIGH"))', "o__o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
ask("P11_not_in", '$c: Customer(c_mktsegment not in ("BUILDING", "MACHINERY"))', "c__c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
ask("P12_has_flag", "$p: Part(has_flag(p_size, 6))", "p__p_partkey AS k; p__p_size AS size", "SELECT p_partkey AS k, p_size AS size FROM part WHERE (p_size & 6) = 6 AND p_size >= 0")
ask("P14_nil", "$o: Order(o_orderstatus != nil) not LineItem(l_orderkey == $o.o_orderkey, l_tax == nil)", "o__o_orderkey AS k", "SELECT o_orderkey AS k FROM orders o WHERE o_orderstatus IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_tax IS NULL)")
ask("P15_arithmetic", "$l: LineItem(l_extendedprice > (l_quantity * 1900), l_tax < 0.02 + 0.01)", "l__l_orderkey AS k; l__l_partkey AS p; l__l_linenumber AS n", "SELECT l_orderkey AS k, l_partkey AS p, l_linenumber AS n FROM lineitem WHERE l_extendedprice > l_quantity * 1900 AND l_tax < 0.02::DOUBLE + 0.01::DOUBLE")
ask("P16_or_tree", '$l: LineItem((l_returnflag == "R" || l_quantity > 45), l_discount < 0.05)', "l__l_orderkey AS k; l__l_partkey AS p; l__l_linenumber AS n", "SELECT l_orderkey AS k, l_partkey AS p, l_linenumber AS n FROM lineitem WHERE (l_returnflag = 'R' OR l_quantity > 45) AND l_discount < 0.05")
ask("P19_eval", "$l: LineItem($p: l_extendedprice, $d: l_discount) eval($p * (1 - $d) > 80000 && $d > 0.0)", "l__l_orderkey AS k; l__l_partkey AS p; l__l_linenumber AS n", "SELECT l_orderkey AS k, l_partkey AS p, l_linenumber AS n FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 80000 AND l_discount > 0")
ask("F7_truthiness", "$l: LineItem() eval($l.l_discount && $l.l_returnflag)", "l__l_orderkey AS k; l__l_partkey AS p; l__l_linenumber AS n", "SELECT l_orderkey AS k, l_partkey AS p, l_linenumber AS n FROM lineitem WHERE l_discount <> 0 AND l_returnflag NOT IN ('', 'false', '0')")


def nested_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate on a field of a nested record, parsed from the events' JSON."""
    p = planner(spark, sf_dir, 'query "q" $e: Event(props.k >= 50, props!.k != 77) end')
    find = p.facts_of
    p.facts_of = lambda t, ep: find(t, ep).withColumn("props", F.from_json("props", "k long"))
    return p.query("q").df.selectExpr("e__event_id AS id", "e__props.k AS k")


def map_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: keys of a map."""
    p = planner(spark, sf_dir, 'query "q" $e: Event(props containsKey "k", props not containsKey "z", props["k"] > 90) end')
    find = p.facts_of
    p.facts_of = lambda t, ep: find(t, ep).withColumn("props", F.from_json("props", "map<string,long>"))
    return p.query("q").df.selectExpr("e__event_id AS id", 'e__props["k"] AS k')


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare boolean fields and their negation."""
    p = planner(spark, sf_dir, 'query "q" $o: Order(big, !done) end')
    find = p.facts_of
    p.facts_of = lambda t, ep: find(t, ep).withColumns({"big": F.col("o_totalprice") > 150000, "done": F.col("o_orderstatus") == "F"})
    return p.query("q").df.selectExpr("o__o_orderkey AS k")


def host_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate that the host registers, here a column expression."""
    p = planner(spark, sf_dir, 'query "q" $o: Order() eval(even($o.o_orderkey)) end', udfs={"even": lambda x: x % 2 == 0})
    return p.query("q").df.selectExpr("o__o_orderkey AS k")


QUERIES |= {"P17_nested_path": nested_path, "P10_contains_key": map_key, "P13_flags": flags, "P20_host_predicate": host_predicate}
SQL |= {
    "P17_nested_path": "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 AND CAST(json_extract_string(props, '$.k') AS BIGINT) <> 77",
    "P10_contains_key": "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_exists(props, '$.k') AND NOT json_exists(props, '$.z') AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 90",
    "P13_flags": "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 150000 AND o_orderstatus <> 'F'",
    "P20_host_predicate": "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0",
}

# --- scalar functions, shown through filters that compare each with its value


def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each operator and function of the language on each line item."""
    from .functions.compiler import Scope, mangled
    from .lang.parser import parse_expression

    m = planner(spark, sf_dir, 'query "q" $l: LineItem() end').query("q")
    scope: Scope = m.scope
    shown = {
        "whole": "$l.l_orderkey * 3 + 7 - $l.l_linenumber", "quotient": "$l.l_orderkey / 8", "minus": "-$l.l_quantity", "fl": "floor($l.l_extendedprice / 7)", "ce": "ceil($l.l_extendedprice / 7)",
        "ab": "abs(0 - $l.l_quantity)", "ro": "round($l.l_quantity / 4)", "sq": "sqrt($l.l_quantity)", "si": "sin($l.l_quantity)", "co": "cos($l.l_quantity)", "ta": "tan($l.l_discount)",
        "ac": "acos($l.l_discount)", "as_": "asin($l.l_discount)", "at": "atan($l.l_quantity)", "lo": "log($l.l_quantity)", "ex": "exp($l.l_discount)", "mi": "min($l.l_quantity, 20)",
        "ma": "max($l.l_quantity, 20)", "po": "pow($l.l_quantity, 2)", "mo": "fmod($l.l_extendedprice, 13)", "turn": "pi * 2",
    }
    cols = [F.round(scope.compile(parse_expression(text))[0], 6).alias(k) if k != "whole" else scope.compile(parse_expression(text))[0].alias(k) for k, text in shown.items()]
    key = [F.col(mangled("$l", c)).alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    return m.df.select(*key, *cols)


ask("F9_F10_haversine", "$a: Customer() $b: Supplier() eval(3959 * acos(min(max(sin($a.c_custkey * pi / 180) * sin($b.s_suppkey * pi / 180) + cos($a.c_custkey * pi / 180) * cos($b.s_suppkey * pi / 180) * cos(($a.c_nationkey - $b.s_nationkey) * pi / 180), -1), 1)) > 3000)", "a__c_custkey AS a; b__s_suppkey AS b", "SELECT c_custkey AS a, s_suppkey AS b FROM customer, supplier WHERE 3959 * acos(least(greatest(sin(c_custkey * pi() / 180) * sin(s_suppkey * pi() / 180) + cos(c_custkey * pi() / 180) * cos(s_suppkey * pi() / 180) * cos((c_nationkey - s_nationkey) * pi() / 180), -1), 1)) > 3000")
QUERIES["F1_F11_scalar_math"] = math_functions
SQL["F1_F11_scalar_math"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_orderkey * 3 + 7 - l_linenumber AS whole, round(l_orderkey / 8, 6) AS quotient,
  round(-l_quantity, 6) AS minus, round(floor(l_extendedprice / 7), 6) AS fl, round(ceil(l_extendedprice / 7), 6) AS ce, round(abs(0 - l_quantity), 6) AS ab,
  round(round(l_quantity / 4), 6) AS ro, round(sqrt(l_quantity), 6) AS sq, round(sin(l_quantity), 6) AS si, round(cos(l_quantity), 6) AS co, round(tan(l_discount), 6) AS ta,
  round(acos(l_discount), 6) AS ac, round(asin(l_discount), 6) AS as_, round(atan(l_quantity), 6) AS at, round(ln(l_quantity), 6) AS lo, round(exp(l_discount), 6) AS ex,
  round(least(l_quantity, 20), 6) AS mi, round(greatest(l_quantity, 20), 6) AS ma, round(pow(l_quantity, 2), 6) AS po, round(l_extendedprice % 13, 6) AS mo, round(pi() * 2, 6) AS turn
FROM lineitem"""

# --- joins

ask("J1_hash_join", "$c: Customer(c_acctbal > 5000) $o: Order(o_custkey == $c.c_custkey, o_totalprice > 100000)", "c__c_custkey AS c; o__o_orderkey AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_totalprice > 100000")
ask("J1_three_way", "$c: Customer(c_nationkey == 3) $o: Order(o_custkey == $c.c_custkey) $l: LineItem(l_orderkey == $o.o_orderkey, l_extendedprice > ($o.o_totalprice * 0.3))", "c__c_custkey AS c; o__o_orderkey AS o; l__l_partkey AS p; l__l_linenumber AS n", "SELECT c_custkey AS c, o_orderkey AS o, l_partkey AS p, l_linenumber AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey = 3 AND l_extendedprice > o_totalprice * 0.3")
ask("J2_theta_join", "$n: Nation() $s: Supplier(s_nationkey < $n.n_nationkey, s_acctbal > 0)", "n__n_nationkey AS n; s__s_suppkey AS s", "SELECT n_nationkey AS n, s_suppkey AS s FROM nation JOIN supplier ON s_nationkey < n_nationkey WHERE s_acctbal > 0")
ask("J2_cross_product", "$r: Region() $n: Nation(n_regionkey < 2)", "r__r_regionkey AS r; n__n_nationkey AS n", "SELECT r_regionkey AS r, n_nationkey AS n FROM region CROSS JOIN nation WHERE n_regionkey < 2")
ask("J3_self_join", "$a: Nation() $b: Nation(n_regionkey == $a.n_regionkey)", "a__n_nationkey AS a; b__n_nationkey AS b", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b USING (n_regionkey)")
ask("J4_not", "$o: Order() not LineItem(l_orderkey == $o.o_orderkey)", "o__o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
ask("J5_exists", "$o: Order() exists LineItem(l_orderkey == $o.o_orderkey, l_quantity > 49)", "o__o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
ask("J6_forall", '$o: Order() forall($l: LineItem(l_orderkey == $o.o_orderkey), LineItem(l_linestatus == "F"))', "o__o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus <> 'F')")
ask("J6_forall_several", '$o: Order() forall($l: LineItem(l_orderkey == $o.o_orderkey), LineItem(l_quantity > 10), LineItem(l_discount < 0.1))', "o__o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_quantity > 10 AND l_discount < 0.1))")
ask("J7_first_not", "not Order(o_totalprice < 0) $r: Region()", "r__r_regionkey AS k", "SELECT r_regionkey AS k FROM region WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)")
ask("J8_after_within", '$a: Event(event_type == "click") $b: Event(user_id == $a.user_id, ts after $a.ts, within 1h of $a)', "a__event_id AS a; b__event_id AS b", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON b.user_id = a.user_id AND b.ts > a.ts AND abs(epoch_ms(b.ts) - epoch_ms(a.ts)) <= 3600000 WHERE a.event_type = 'click'", nearest=True)
ask("J8_temporal", '$a: Event(event_type == "signup") $b: Event(event_type == "error", user_id == $a.user_id, timestamp before $a.timestamp) $c: Event(user_id == $b.user_id, event_type == "purchase", timestamp during $a.timestamp)', "a__event_id AS a; b__event_id AS b; c__event_id AS c", "SELECT a.event_id AS a, b.event_id AS b, c.event_id AS c FROM events a JOIN events b ON b.user_id = a.user_id AND epoch_ms(b.ts) < epoch_ms(a.ts) JOIN events c ON c.user_id = b.user_id AND epoch_ms(c.ts) >= epoch_ms(a.ts) WHERE a.event_type = 'signup' AND b.event_type = 'error' AND c.event_type = 'purchase'", nearest=True)
ask("J8_coincides", "$a: Event() $b: Event(timestamp coincides $a.timestamp)", "a__event_id AS a; b__event_id AS b", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON epoch_ms(a.ts) = epoch_ms(b.ts)", nearest=True)
ask("J13_argmin", "$p: Part() not Part(p_brand == $p.p_brand, p_retailprice < $p.p_retailprice)", "p__p_partkey AS k; p__p_brand AS brand; p__p_retailprice AS price", "SELECT p_partkey AS k, p_brand AS brand, p_retailprice AS price FROM part WHERE p_retailprice = (SELECT min(p_retailprice) FROM part q WHERE q.p_brand = part.p_brand)")
ask("J14_as_of", "$l: Label() $p: Part(p_size <= $l.doc_id) not Part(p_brand == $p.p_brand, p_size > $p.p_size, p_size <= $l.doc_id)", "l__doc_id AS d; p__p_partkey AS p", "SELECT l.doc_id AS d, p.p_partkey AS p FROM labels l JOIN part p ON p.p_size <= l.doc_id WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_size > p.p_size AND q.p_size <= l.doc_id)")
CALLS = 'query "rich"(Customer $x) $n: Nation(n_nationkey == $x.c_nationkey, n_regionkey == 2) end query "q" '
ask("J11_query_call", CALLS + '$c: Customer(c_acctbal > 0) "rich"($c) end', "c__c_custkey AS k", "SELECT c_custkey AS k FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0 AND n_regionkey = 2")
ask("J11_query_call_output", CALLS + '$c: Customer(c_acctbal > 0) "rich"($c, $out) end', "c__c_custkey AS k; out__n_name AS name", "SELECT c_custkey AS k, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0 AND n_regionkey = 2")

# --- aggregation

ORDER_LINES = "$o: Order() $r: Number() from accumulate($l: LineItem(l_orderkey == $o.o_orderkey), "


def lines_sql(value: str) -> str:
    return f"SELECT o_orderkey AS k, {value} AS v FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"


ask("A1_count", ORDER_LINES + "count())", "o__o_orderkey AS k; r__intValue AS v", lines_sql("count(l_orderkey)"))
ask("A2_sum", ORDER_LINES + "sum($l.l_quantity))", "o__o_orderkey AS k; round(r__doubleValue, 4) AS v", lines_sql("round(coalesce(sum(l_quantity), 0), 4)"))
ask("A2_sum_whole", ORDER_LINES + "sum($l.l_linenumber))", "o__o_orderkey AS k; r__result AS v", lines_sql("CAST(coalesce(sum(l_linenumber), 0) AS BIGINT)"))
ask("A3_average", ORDER_LINES + "average($l.l_extendedprice))", "o__o_orderkey AS k; round(r__value, 5) AS v", lines_sql("round(coalesce(avg(l_extendedprice), 0), 5)"))
ask("A4_min", ORDER_LINES + "min($l.l_extendedprice))", "o__o_orderkey AS k; r__result AS v", lines_sql("coalesce(min(l_extendedprice), 0)"))
ask("A4_max", ORDER_LINES + "max($l.l_extendedprice))", "o__o_orderkey AS k; r__result AS v", lines_sql("coalesce(max(l_extendedprice), 0)"))
ask("A5_collect", "$c: Customer() $r: Orders() from collect($o: Order(o_custkey == $c.c_custkey))", "c__c_custkey AS k; size(r__result) AS n; array_join(array_sort(transform(r__result, x -> x.o_orderkey)), ',') AS v", "SELECT c_custkey AS k, CAST(count(o_orderkey) AS INTEGER) AS n, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
ask("A6_collect_set", "$r: Region() $s: Nations() from accumulate($n: Nation(n_regionkey == $r.r_regionkey), collectSet($n))", "r__r_regionkey AS k; size(s__result) AS n", "SELECT r_regionkey AS k, CAST(count(n_nationkey) AS INTEGER) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
ask("A7_expression", ORDER_LINES + "sum($l.l_extendedprice * (1 - $l.l_discount)))", "o__o_orderkey AS k; round(r__doubleValue, 5) AS v", lines_sql("round(coalesce(sum(l_extendedprice * (1 - l_discount)), 0), 5)"))
ask("A7_outer_binding", ORDER_LINES + "sum($l.l_extendedprice / $o.o_totalprice))", "o__o_orderkey AS k; round(r__doubleValue, 4) AS v", lines_sql("round(coalesce(sum(l_extendedprice / o_totalprice), 0), 4)"))
ask("A8_having", "$o: Order() $r: Number(intValue >= 6 || doubleValue == 1) from accumulate(LineItem(l_orderkey == $o.o_orderkey), count(1))", "o__o_orderkey AS k; r__intValue AS v", "SELECT o_orderkey AS k, count(l_orderkey) AS v FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) >= 6 OR count(l_orderkey) = 1")
ask("A9_or_source", '$c: Customer() $r: Number() from accumulate(Order(o_custkey == $c.c_custkey, (o_totalprice > 200000 || o_orderstatus == "P")), count())', "c__c_custkey AS k; r__intValue AS v", "SELECT c_custkey AS k, count(o_orderkey) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND (o_totalprice > 200000 OR o_orderstatus = 'P') GROUP BY 1")
ask("A10_accessors", "$r: Number() from accumulate($o: Order(), average($o.o_totalprice))", "r__intValue AS i; r__longValue AS l; round(r__doubleValue, 4) AS d; round(r__floatValue, 4) AS f", "SELECT CAST(trunc(avg(o_totalprice)) AS BIGINT) AS i, CAST(trunc(avg(o_totalprice)) AS BIGINT) AS l, round(avg(o_totalprice), 4) AS d, round(avg(o_totalprice), 4) AS f FROM orders")
ask("A11_custom", "$o: Order() $x: Number() from accumulate($l: LineItem(l_orderkey == $o.o_orderkey), distinctSuppliers($l.l_suppkey))", "o__o_orderkey AS k; x__longValue AS v", "SELECT o_orderkey AS k, count(DISTINCT l_suppkey) AS v FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1", aggregates={"distinctSuppliers": lambda c: F.count_distinct(c).cast("double")})
ask("A13_global", '$r: Number() from accumulate($l: LineItem(l_returnflag == "R"), max($l.l_extendedprice)) $n: Number() from accumulate(Region(), count())', "r__result AS top; n__intValue AS n", "SELECT (SELECT max(l_extendedprice) FROM lineitem WHERE l_returnflag = 'R') AS top, (SELECT count(*) FROM region) AS n")
ask("A1_range_correlated", '$e: Event(event_type == "purchase") $n: Number(intValue >= 2) from accumulate(Event(user_id == $e.user_id, event_id != $e.event_id, timestamp > ($e.timestamp - 7200000), timestamp < $e.timestamp), count(1))', "e__event_id AS k; n__intValue AS v", "SELECT a.event_id AS k, count(b.event_id) AS v FROM events a JOIN events b ON b.user_id = a.user_id AND b.event_id <> a.event_id AND epoch_ms(b.ts) > epoch_ms(a.ts) - 7200000 AND b.ts < a.ts WHERE a.event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 2", nearest=True)

# --- windows, unnesting, nested access

ask("W1_length_window", '$r: Number() from accumulate($e: Event(event_type == "purchase") over window:length(25), sum($e.value))', "round(r__doubleValue, 4) AS v", "SELECT round(sum(value), 4) AS v FROM (SELECT value FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 25)")
ask("W1_window_before_join", '$t: Region() $r: Number() from accumulate($e: Event(event_type == "error", user_id > $t.r_regionkey) over window:length(40), count())', "t__r_regionkey AS k; r__intValue AS v", "SELECT r_regionkey AS k, count(event_id) AS v FROM region LEFT JOIN (SELECT * FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 40) ON user_id > r_regionkey GROUP BY 1")
ask("W2_time_window", "$r: Number() from accumulate($e: Event() over window:time(48h), count())", "r__intValue AS v", "SELECT count(*) AS v FROM events WHERE epoch_ms(ts) >= 1706572800000 - 172800000", now=1706572800000, nearest=True)
ask("W3_window_pattern", '$e: Event(event_type == "signup") over window:length(10) $u: Event(user_id == $e.user_id, event_type == "error")', "e__event_id AS e; u__event_id AS u", "SELECT e.event_id AS e, u.event_id AS u FROM (SELECT * FROM events WHERE event_type = 'signup' ORDER BY event_id DESC LIMIT 10) e JOIN events u ON u.user_id = e.user_id AND u.event_type = 'error'")
ask("U1_unnest", "$e: Embedding() $v: Value(value > 0.2) from unnest($e.embedding)", "e__vec_id AS k; round(v__value, 5) AS v", "SELECT vec_id AS k, round(v, 5) AS v FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) WHERE v > 0.2::FLOAT")
ask("U3_index_size", "$e: Embedding(embedding.size == 64, embedding[0] > 0, embedding[-1] < 0, embedding.isEmpty == 0)", "e__vec_id AS k", "SELECT vec_id AS k FROM embeddings WHERE len(embedding) = 64 AND embedding[1] > 0 AND embedding[-1] < 0")


ask("W4_running_time_window", "$e: Event() $n: Number() from accumulate(Event(user_id == $e.user_id, timestamp >= ($e.timestamp - 7200000), timestamp < $e.timestamp), count(1))", "e__event_id AS k; n__intValue AS n", "")
ask("W4_running_max", '$e: Event() $n: Number() from accumulate($p: Event(user_id == $e.user_id, event_type == "purchase", timestamp >= ($e.timestamp - 86400000), timestamp <= ($e.timestamp + 3600000)), max($p.value))', "e__event_id AS k; n__doubleValue AS top", "SELECT a.event_id AS k, coalesce(max(b.value), 0) AS top FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type = 'purchase' AND epoch_us(b.ts) // 1000 >= epoch_us(a.ts) // 1000 - 86400000 AND epoch_us(b.ts) // 1000 <= epoch_us(a.ts) // 1000 + 3600000 GROUP BY 1")
SQL["W4_running_time_window"] = "SELECT a.event_id AS k, count(b.event_id) AS n FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND epoch_us(b.ts) // 1000 >= epoch_us(a.ts) // 1000 - 7200000 AND epoch_us(b.ts) // 1000 < epoch_us(a.ts) // 1000 GROUP BY 1"


def running_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, running: for each event the mean of the user's last five values."""
    from .plans.windows import running_length as run

    events = planner(spark, sf_dir, "").facts_of("Event", None)
    return run(events, ["user_id"], ["timestamp", "event_id"], "value", 5, "mean").select(F.col("event_id").alias("k"), F.round("mean", 4).alias("v"))


QUERIES["W1_running_length_window"] = running_length
SQL["W1_running_length_window"] = "SELECT event_id AS k, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS v FROM events"


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: a query with a fact as its parameter."""
    p = planner(spark, sf_dir, 'query "of"(Nation $n) $c: Customer(c_nationkey == $n.n_nationkey) end')
    one = p.facts_of("Nation", None).where("n_nationkey = 5")
    return p.query("of", n=one).df.selectExpr("c__c_custkey AS k")


QUERIES["Q2_parameters"] = parameters
SQL["Q2_parameters"] = "SELECT c_custkey AS k FROM customer WHERE c_nationkey = 5"
ask("Q1_named_view", 'query "q" $s: Supplier(s_acctbal < 0) end', "s__s_suppkey AS k", "SELECT s_suppkey AS k FROM supplier WHERE s_acctbal < 0")
