"""Queries of the catalogs over small tables made to be hard for them, against their SQL."""

import duckdb
import pytest

from ruleweave import catalog, catalog_rules

ALL = {**catalog.QUERIES, **catalog_rules.QUERIES}
SQL = {**catalog.SQL, **catalog_rules.SQL}


def against_sql(spark, folder, name, **tables):
    """The rows of a query and of its SQL over tables that SELECTs make."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t, select in tables.items():
        con.execute(f"COPY ({select}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = ALL[name](spark, str(folder)), con.execute(SQL[name]).df()
    return sorted(map(tuple, got.select(*want.columns).collect())), sorted(map(tuple, want.values.tolist()))


MOMENTS = "(VALUES (1, '2024-01-01 00:00:00.000400'), (2, '2024-01-01 00:00:00.000500'), (3, '2024-01-01 00:00:00.001499'), (4, '2024-01-01 00:00:00.001500'), (5, '1960-01-01 00:00:00.000500'), (6, '1960-01-01 00:00:00.000400'), (7, '1959-12-31 23:59:59.999600'), (8, '2024-01-01 01:00:00.001400')) m(i, t)"
EVENTS = f"SELECT i::BIGINT AS event_id, t::TIMESTAMP AS ts, 1::BIGINT AS user_id, 'click' AS event_type, 1.0::DOUBLE AS value, '{{}}' AS props FROM {MOMENTS}"


@pytest.mark.parametrize("name", ["J8_coincides", "J8_after_within"])
def test_times_within_a_millisecond(spark, tmp_path, name):
    got, want = against_sql(spark, tmp_path, name, events=EVENTS)
    assert got == want and want


def test_the_row_before_is_found_without_one_window_over_all(spark, monkeypatch):
    from ruleweave.plans import windows

    monkeypatch.setattr(windows, "STRETCH", 16)
    ids = [1, 2, *range(3, 40, 3), *range(1 << 33, (1 << 33) + 50), (5 << 33) + 7]
    df = spark.createDataFrame([(i, None if i % 7 == 0 else -i) for i in ids], "id long, v long").repartition(5)
    got = {r.id: r.p for r in windows.previous(df, "id", "v", "p").collect()}
    assert got == {i: None if not n or ids[n - 1] % 7 == 0 else -ids[n - 1] for n, i in enumerate(ids)}


def test_inserted_facts_are_not_sorted_by_one_task(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT i AS o_orderkey, 'O' AS o_orderstatus FROM range(600000) r(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    df = ALL["S10_S11_inserts"](spark, str(tmp_path))
    assert df.where("in_order").count() == 600002
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(_fid" not in plan and "windowspecdefinition(_run" in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_shared_out_and_functions_of_one_fact_computed_once(spark, tmp_path, monkeypatch):
    from ruleweave.plans import match

    monkeypatch.setattr(match, "PAIRS", 1 << 16, raising=False)
    customers = "SELECT i AS c_custkey, (i % 25)::INTEGER AS c_nationkey FROM range(700) r(i)"
    suppliers = "SELECT i AS s_suppkey, (i % 7)::INTEGER AS s_nationkey FROM range(90) r(i)"
    got, want = against_sql(spark, tmp_path, "F9_F10_haversine", customer=customers, supplier=suppliers)
    assert got == want and want
    df = ALL["F9_F10_haversine"](spark, str(tmp_path))
    join = next(x for x in plan_of(df).splitlines() if "NestedLoopJoin" in x or "CartesianProduct" in x)
    assert "SIN(" not in join and "COS(" in join
    assert df.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("extra", ["", "p_type == 'A', "])
def test_the_latest_below_a_bound_needs_no_join_of_all_of_a_key(spark, tmp_path, extra):
    from ruleweave.sources.tables import rows

    labels = "SELECT CASE WHEN i % 9 = 8 THEN NULL ELSE i END::BIGINT AS doc_id, 0 AS quality, 0 AS toxic FROM range(40) r(i)"
    parts = "SELECT i AS p_partkey, CASE WHEN i % 11 = 10 THEN NULL ELSE 'B' || (i % 4) END AS p_brand, CASE WHEN i % 13 = 12 THEN NULL ELSE i * 7 % 31 END::INTEGER AS p_size, CASE WHEN i % 3 = 0 THEN 'A' ELSE 'B' END AS p_type FROM range(150) r(i)"
    got, want = against_sql(spark, tmp_path, "J14_as_of", labels=labels, part=parts)
    assert got == want and want
    plan = plan_of(ALL["J14_as_of"](spark, str(tmp_path)))
    assert "LeftAnti" not in plan and "_next" in plan
    text = f"$l: Label() $p: Part(p_size < $l.doc_id) not Part({extra}p_brand == $p.p_brand, p_size < $p.p_size, p_size >= $l.quality)".replace("'", '"')
    sql = f"SELECT l.doc_id, p.p_partkey FROM labels l JOIN part p ON p.p_size < l.doc_id WHERE NOT EXISTS (SELECT 1 FROM part q WHERE {extra.replace('==', '=').replace(', ', ' AND ')} q.p_brand = p.p_brand AND q.p_size < p.p_size AND q.p_size >= l.quality)"
    con = duckdb.connect()
    for t in ("labels", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    mine = rows(spark, str(tmp_path), text, "l__doc_id AS d", "p__p_partkey AS p")
    assert sorted(map(tuple, mine.collect())) == sorted(con.execute(sql).fetchall())


DRAINED = "declare E id: long v: long end declare S id: long end declare T id: long end"
TAKE = ' rule "r" when $e: E(v > 0) then insert S { id = $e.id } end'
AFTER = ' rule "s" salience 5 when $s: S(id < 40) then insert T { id = $s.id } end'


def drained(spark, text, rows, on, **limits):
    """(Ids of S in each batch, metrics) of a session that drains to the end, acknowledging as it goes."""
    from ruleweave.operators.session import KnowledgeBase
    from ruleweave.streaming.continuous import Config, ContinuousSession

    s = ContinuousSession(KnowledgeBase(DRAINED + text), spark, Config(output_types=("S",), **limits))
    step, out = s.push("E", spark.range(rows).selectExpr("id", "id % 5 AS v", "id AS at"), "id", "at"), []
    while True:
        batches = [step] if not out else s.drain_on()[0] if on else [s.drain()]
        for step in batches:
            out.append(sorted(r.id for r in step.facts["S"].collect()))
            assert step.size == len(out[-1])
            s.acknowledge(step.id)
        if not step.drain_required:
            return out, s


def test_drains_in_one_job_are_drains_one_by_one(spark):
    one, a = drained(spark, TAKE, 60, False, max_rules_per_step=7)
    many, b = drained(spark, TAKE, 60, True, max_rules_per_step=7)
    assert one == many and [len(x) for x in many] == [7, 7, 7, 7, 7, 7, 6]
    assert a.metrics == b.metrics and many[0] == sorted((i for i in range(60) if i % 5), reverse=True)[:7][::-1]
    fids = b.session.memory.types["S"].select("_fid").distinct().count()
    assert fids == 48


def test_a_rule_that_reads_what_is_inserted_fires_between_drains(spark):
    one, a = drained(spark, TAKE + AFTER, 25, False, max_rules_per_step=6)
    many, b = drained(spark, TAKE + AFTER, 25, True, max_rules_per_step=6)
    assert one == many and a.metrics == b.metrics and b.session.facts("T").count() == 20


def test_drains_of_more_batches_than_may_wait(spark, tmp_path):
    events = "SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ts, i % 9 AS user_id, 'x' AS event_type, 61.0::DOUBLE AS value, '{}' AS props FROM range(52500) r(i)"
    got, want = against_sql(spark, tmp_path, "T7_drain", events=events)
    assert got == want and len(want) == 52500
