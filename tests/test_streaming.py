import pytest

from ruleweave.operators.session import KnowledgeBase
from ruleweave.streaming.continuous import Config, ContinuousSession, StepRejected

TEXT = """
declare Event value: int timestamp: long end
declare Out value: int end
rule "r" when $e: Event(value > 5) then insert Out { value = $e.value } end
query "events" $e: Event() end
query "recent" $n: Number() from accumulate(Event() over window:time(100), count()) end
"""


def events(spark, *rows):
    return spark.createDataFrame([(str(i), t, v, t) for i, t, v in rows], "event_id string, event_time_ms long, value long, timestamp long").coalesce(1)


@pytest.fixture
def session(spark):
    return ContinuousSession(KnowledgeBase(TEXT), spark, Config(output_types=("Out",), allowed_lateness_ms=50, event_retention_ms=1000, dedup_retention_ms=1000, max_future_ms=5000))


def test_push_fires_and_outputs(spark, session):
    b = session.push("Event", events(spark, (1, 100, 9), (2, 110, 1)))
    assert [r.value for r in b.facts["Out"].collect()] == [9]
    assert session.push("Event", events(spark, (3, 120, 8))).facts["Out"].collect()[0].value == 8
    assert session.metrics.accepted == 3 and session.metrics.fired == 2


@pytest.mark.parametrize("rows, reason", [([(1, 2000, 1)], "duplicate"), ([(5, 2000, 1), (5, 2000, 1)], "duplicate"), ([(6, 900, 1)], "late"), ([(7, 9000, 1)], "future")])
def test_a_bad_event_rejects_the_batch(spark, session, rows, reason):
    session.push("Event", events(spark, (1, 1000, 9)))
    session.advance_watermark(1000)
    with pytest.raises(StepRejected) as e:
        session.push("Event", events(spark, *rows, (99, 1500, 1)))
    assert e.value.reason == reason and session.query("events").count() == 1
    session.push("Event", events(spark, *rows, (99, 1500, 1)), strict=False)
    assert session.query("events").count() >= 2


def test_lateness_is_inclusive(spark, session):
    session.advance_watermark(1000)
    session.push("Event", events(spark, (1, 950, 1)))
    assert session.query("events").count() == 1


def test_retention(spark, session):
    session.push("Event", events(spark, (1, 100, 1), (2, 200, 1)))
    session.advance_watermark(1100)
    assert session.query("events").count() == 1 and session.metrics.expired == 1
    session.advance_watermark(1300)
    session.push("Event", events(spark, (1, 1300, 1)))  # its id is forgotten by now


def test_watermark_moves_on_only(spark, session):
    session.advance_watermark(10)
    session.advance_watermark(10)
    with pytest.raises(StepRejected):
        session.advance_watermark(9)


def test_time_window_follows_the_watermark(spark, session):
    session.push("Event", events(spark, (1, 100, 1), (2, 300, 1)))
    assert session.query("recent").first().n.intValue == 2
    session.advance_watermark(350)
    assert session.query("recent").first().n.intValue == 1


def test_acknowledge_in_order(spark, session):
    a, b = session.push("Event", events(spark, (1, 100, 1))), session.advance_watermark(5)
    with pytest.raises(StepRejected):
        session.acknowledge(b.id)
    session.acknowledge(a.id)
    session.acknowledge(b.id)
    assert session.metrics.pending == 0


def test_limits(spark):
    s = ContinuousSession(KnowledgeBase(TEXT), spark, Config(max_batch_size=1))
    with pytest.raises(StepRejected):
        s.push("Event", events(spark, (1, 1, 1), (2, 2, 2)))
    assert s.metrics.over_limit == 1


def test_budget_and_drain(spark):
    s = ContinuousSession(KnowledgeBase(TEXT), spark, Config(max_rules_per_step=1, output_types=("Out",)))
    b = s.push("Event", events(spark, (1, 1, 7), (2, 2, 8)))
    assert b.drain_required and b.facts["Out"].count() == 1
    assert s.drain().facts["Out"].count() == 1


def test_failed_step_changes_nothing(spark):
    text = TEXT.replace("insert Out { value = $e.value }", "insert Out { value = 1 / ($e.value - 9) }")
    s = ContinuousSession(KnowledgeBase(text), spark)
    with pytest.raises(Exception):
        s.push("Event", events(spark, (1, 1, 9)))
    assert s.query("events").count() == 0 and s.metrics.failed_steps == 1
    s.push("Event", events(spark, (1, 1, 3)))


def test_ids_and_results_are_bounded(spark):
    s = ContinuousSession(KnowledgeBase(TEXT), spark, Config(max_dedup_ids=3, output_types=("Out",), max_results=2))
    s.push("Event", events(spark, (1, 100, 9), (2, 110, 9)))
    with pytest.raises(StepRejected, match="ids"):
        s.push("Event", events(spark, (3, 120, 1), (4, 130, 1)))
    with pytest.raises(StepRejected, match="results"):
        s.push("Event", events(spark, (5, 140, 9)))
    assert s.query("events").count() == 2 and s.metrics.over_limit == 2
    s.acknowledge(1)
    assert s.push("Event", events(spark, (5, 140, 9))).size == 1
    assert (s.metrics.active_events, s.metrics.dedup_entries, s.metrics.pending, s.metrics.pending_results) == (3, 3, 1, 1)
    with pytest.raises(StepRejected):
        s.push("Event", events(spark))
    with pytest.raises(ValueError):
        Config(max_results=0)


def test_gauges_follow_the_watermark(spark):
    s = ContinuousSession(KnowledgeBase(TEXT), spark, Config(event_retention_ms=100, dedup_retention_ms=300))
    s.push("Event", events(spark, (1, 100, 1), (2, 200, 1), (3, 300, 1)))
    s.advance_watermark(310)
    assert (s.metrics.active_events, s.metrics.expired, s.metrics.dedup_entries) == (1, 2, 3)
    s.advance_watermark(420)
    assert (s.metrics.active_events, s.metrics.expired, s.metrics.dedup_entries) == (0, 3, 2)
    with pytest.raises(StepRejected, match="late|duplicate"):
        s.push("Event", events(spark, (2, 420, 1)))
    s.push("Event", events(spark, (1, 430, 1)))
    s.advance_watermark(800)
    assert (s.metrics.active_events, s.metrics.expired, s.metrics.dedup_entries) == (0, 4, 0) and not s.parts


def test_a_lost_driver_is_replayed(spark, tmp_path):
    config = Config(output_types=("Out",), allowed_lateness_ms=50, event_retention_ms=1000, max_rules_per_step=2)
    log = f"file://{tmp_path}/log"
    a = ContinuousSession(KnowledgeBase(TEXT), spark, config, log)
    a.push("Event", events(spark, (1, 100, 9), (2, 110, 1)))
    a.acknowledge(1)
    a.push("Event", events(spark, (3, 900, 7), (4, 900, 8), (5, 900, 9)))
    with pytest.raises(StepRejected):
        a.push("Event", events(spark, (3, 900, 7)))
    a.advance_watermark(1105)
    want = {q: sorted(map(str, a.query(q).collect())) for q in ("events", "recent")}
    with pytest.raises(ValueError, match="recover"):
        ContinuousSession(KnowledgeBase(TEXT), spark, config, log)
    b = ContinuousSession.recover(KnowledgeBase(TEXT), spark, log, config)
    assert {q: sorted(map(str, b.query(q).collect())) for q in want} == want
    assert [x.id for x in b.pending] == [x.id for x in a.pending] == [2, 3]
    assert [[r.value for r in x.facts["Out"].collect()] for x in b.pending] == [[r.value for r in x.facts["Out"].collect()] for x in a.pending]
    assert b.watermark == 1105 and b.metrics.replay_recoveries == 1 and b.metrics.expired == a.metrics.expired == 1
    with pytest.raises(StepRejected, match="duplicate"):
        b.push("Event", events(spark, (3, 1200, 7)))
    assert b.push("Event", events(spark, (6, 1200, 6))).id == 4
    small = Config(max_replay_steps=1)
    c = ContinuousSession(KnowledgeBase(TEXT), spark, small, f"file://{tmp_path}/small")
    c.push("Event", events(spark, (1, 1, 1)))
    with pytest.raises(StepRejected, match="log"):
        c.push("Event", events(spark, (2, 1, 1)))


def test_a_failing_sink_loses_nothing(spark, tmp_path):
    """The sink fails at each micro-batch once; the driver is lost between the tries."""
    source = str(tmp_path / "in")
    for i in range(3):
        events(spark, (2 * i, 100 + i, 9 + i), (2 * i + 1, 100 + i, 1)).write.mode("append").parquet(source)
    config = Config(output_types=("Out",), allowed_lateness_ms=1000)
    log, got, failed = f"file://{tmp_path}/log", {}, set()

    def sink(number, facts):
        if number not in failed:
            failed.add(number)
            raise RuntimeError("the sink is away")
        got[number] = sorted(r.value for r in facts["Out"].collect())

    session = ContinuousSession(KnowledgeBase(TEXT), spark, config, log)
    for _ in range(12):
        stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = session.attach(stream, "Event", "event_id", "event_time_ms", sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
            break
        except Exception:
            session = ContinuousSession.recover(KnowledgeBase(TEXT), spark, log, config)
    assert sorted(v for x in got.values() for v in x) == [9, 10, 11]
    assert session.query("events").count() == 6 and not session.pending


def test_a_failed_step_is_made_up_for(spark):
    """What fired in a step that fails fires again, also on facts that were there before."""
    text = TEXT + 'rule "s" salience -1 when $o: Out(value == 9) then insert Out { value = 1 / ($o.value - 9) } end'
    s = ContinuousSession(KnowledgeBase(text), spark, Config(output_types=("Out",)))
    s.session.insert_rows("Event", [{"value": 6, "timestamp": 1}])
    with pytest.raises(Exception):
        s.push("Event", events(spark, (1, 1, 9)))
    b = s.push("Event", events(spark, (2, 2, 7)))
    assert sorted(r.value for r in b.facts["Out"].collect()) == [6, 7]
