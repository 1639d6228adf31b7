import json

import pytest
from pyspark.sql import functions as F

from ruleweave.operators.diagnostics import as_json, as_prometheus, explain, memory, network
from ruleweave.operators.results import Results
from ruleweave.operators.session import KnowledgeBase, Session
from ruleweave.sources import readers
from ruleweave.sources.feeds import Feed

TYPES = "declare Item id: long name: String price: double end "


@pytest.fixture
def session(spark):
    return Session(KnowledgeBase(TYPES + 'query "q" $i: Item() end'), spark)


ROWS = [(1, "é", 2.5), (2, None, None)]
DOCS = {
    "json": ('{"all": [{"id": 1, "name": "é", "price": 2.5}, {"id": 2}]}', "$.all[*]"),
    "yaml": ("all:\n- {id: 1, name: é, price: 2.5}\n- {id: 2}\n", "$.all[*]"),
    "csv": ("price,id,name\n2.5,1,é\n,2,\n", "$"),
}


@pytest.mark.parametrize("form", DOCS)
def test_feeds(session, form):
    text, path = DOCS[form]
    f = Feed(session, "Item", form, path)
    for b in text.encode():
        f.feed(bytes([b]))
    assert session.count("Item") == 0
    f.finish()
    got = sorted((r.id, r.name or None, r.price) for r in session.facts("Item").collect())
    assert got == ROWS
    with pytest.raises(ValueError):
        f.feed("x")


def test_xml_feed(session):
    Feed(session, "Item", "xml").feed("<Item><id>1</id><name>é</name>").feed("<price>2.5</price></Item>").finish()
    assert [tuple(r) for r in session.facts("Item").collect()] == ROWS[:1]


def test_a_bad_document_inserts_nothing(session):
    with pytest.raises(Exception):
        Feed(session, "Item", "json").feed('{"id": 1').finish().collect()
    assert session.count("Item") == 0


def test_paths(spark):
    df = spark.createDataFrame([(json.dumps({"a": [{"b": [{"x": 1}, {"x": 2}]}, {"b": [{"x": 3}]}]}),)], "doc string")
    kind = spark.createDataFrame([], "x long").schema
    assert sorted(r.x for r in readers.json_facts(df, "doc", kind, "$.a[*].b[*]").collect()) == [1, 2, 3]
    assert [r.x for r in readers.json_facts(df, "doc", kind, "$.a[-1].b[0]").collect()] == [3]
    assert [r.x for r in readers.json_facts(df, "doc", kind, "$.a[*].b[*]", first=True).collect()] == [1]


@pytest.mark.parametrize("form", ["csv", "parquet", "json"])
def test_files(spark, tmp_path, form):
    df = spark.createDataFrame(ROWS, "id long, name string, price double")
    readers.write(df, str(tmp_path / "out"), form, **({"header": "true"} if form == "csv" else {}))
    back = readers.csv_facts(spark, str(tmp_path / "out"), df.schema) if form == "csv" else spark.read.schema(df.schema).format(form).load(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == ROWS
    if form == "csv":
        assert readers.csv_facts(spark, str(tmp_path / "out"), df.schema, "price > 2").count() == 1


def test_results(session):
    session.insert_rows("Item", [{"id": 1, "price": 2.0}])
    r = Results(session.query("q"))
    assert len(r) == 1 and r.single().i.id == 1 and r.first().i.price == 2.0
    assert r.field("$i", "price", "int").first()[0] == 2
    session.insert_rows("Item", [{"id": 2, "price": 2.5}])
    with pytest.raises(ValueError):
        Results(session.query("q")).single()
    with pytest.raises(Exception):
        Results(session.query("q")).field("i", "price", "int").collect()


def test_files_of_rules(spark, tmp_path):
    (tmp_path / "in.schema").write_text("schema X [id(1)]; message Order { int64 id; double total; }")
    (tmp_path / "com").mkdir()
    (tmp_path / "com" / "Types.rfl").write_text('import com.Types\ndeclare Big id: long end')
    (tmp_path / "main.rfl").write_text('import schema "in.schema"\nimport com.*\nrule "r" when $o: Order(total > 5) then insert Big { id = $o.id } end')
    s = Session(KnowledgeBase.load(str(tmp_path / "main.rfl")), spark)
    s.insert_rows("Order", [{"id": 1, "total": 9.0}, {"id": 2, "total": 1.0}])
    assert s.fire() == 1 and s.facts("Big").first().id == 1


def test_diagnostics(spark):
    s = Session(KnowledgeBase(TYPES + 'declare Big id: long end rule "r" when $i: Item(price > 1) then insert Big { id = $i.id } end'), spark)
    s.insert_rows("Item", [{"id": 1, "price": 9.0}])
    s.fire()
    assert json.loads(as_json(s))["rules"][0]["fired"] == 1
    assert 'ruleweave_fired_total{rule="r"} 1' in as_prometheus(s)
    assert memory(s) == {"Item": 1, "Big": 1}
    assert "price" in explain(s, "r")
    assert '"Item" -> "r";' in network(s) and '"r" -> "Big";' in network(s)


def test_reload(spark):
    s = Session(KnowledgeBase(TYPES + 'rule "r" when $i: Item() then update $i { name = "a" } end'), spark)
    s.insert_rows("Item", [{"id": 1}])
    s.reload(KnowledgeBase(TYPES + 'rule "s" no-loop when $i: Item() then update $i { name = "b" } end'))
    s.fire()
    assert s.facts("Item").first().name == "b"


def test_tables_in_place(spark):
    s = Session(KnowledgeBase(TYPES + 'rule "r" when $i: Item(price > 1) then insert Item { id = 7, price = 0.0 } end'), spark)
    s.register("Item", spark.createDataFrame([(1, 2.0, 10)], "id long, price double, _fid long"))
    s.fire()
    assert sorted(r.id for r in s.facts("Item").collect()) == [1, 7]
    assert s.memory.types["Item"].agg(F.max("_fid")).first()[0] > 10


def test_chunks(spark):
    from ruleweave.sources.readers import chunks

    df = spark.range(500).selectExpr("id", "concat('é', id) AS name").repartition(3)
    pieces = list(chunks(df, "json", 100))
    assert all(len(p) == 100 for p in pieces[:-1]) and 0 < len(pieces[-1]) <= 100
    rows = [json.loads(line) for line in b"".join(pieces).decode().splitlines()]
    assert sorted((r["id"], r["name"]) for r in rows) == [(i, f"é{i}") for i in range(500)]
    assert list(chunks(df.limit(0), "json")) == []
