"""Queries of the catalogs against their SQL, on the smallest tables; what they read, and how."""

import os

import duckdb
import pytest

from ruleweave import catalog, catalog_rules

SF = "/root/testdata/sf0.001"
ALL = {**catalog.QUERIES, **catalog_rules.QUERIES}
SQL = {**catalog.SQL, **catalog_rules.SQL}
SOME = sorted(catalog.QUERIES) + ["M1_insert", "M3_update", "M5_retract", "M8_if", "M11_while", "C1_C2_fixpoint_scoring", "M2_insert_logical", "DT1_decision_table", "T2_dedup_stream", "T1_micro_batches", "S4_json_path", "S5_yaml", "J10_or_groups", "J12_extends", "C9_budget", "C14_reset", "M13_rollback", "S10_S11_inserts", "T2_dedup_session", "T4_T6_lateness_retention", "T7_drain", "T9_recovery", "T10_T11_metrics_limits", "T12_named_columns"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def normal(df):
    cols = sorted(df.columns)
    return sorted((tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, db, name):
    got, want = ALL[name](spark, SF).toPandas(), db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_every_query_has_sql():
    assert set(ALL) == set(SQL)


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["J1_hash_join"](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(c_acctbal,5000.0)" in plan and "GreaterThan(o_totalprice,100000.0)" in plan
    assert "c_name" not in plan and "o_orderdate" not in plan
    assert "BroadcastHashJoin" in plan or "SortMergeJoin" in plan


def test_correlated_aggregates_need_no_theta_join(spark):
    plan = catalog.QUERIES["A2_sum"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
