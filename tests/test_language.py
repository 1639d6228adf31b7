import pytest
from pyspark.sql import types as T

from ruleweave.lang import syntax as S
from ruleweave.lang.parser import RuleSyntaxError, parse, parse_expression
from ruleweave.lang.tables import TableError, to_rules
from ruleweave.sources.readers import PathError, steps
from ruleweave.sources.schemas import SchemaError, parse_schema


def test_statements():
    p = parse("""
    package a.time.b
    import x.y.Z
    import x.y.*
    import schema "in.schema"
    import "more.schema"
    global java.util.List results
    declare Basket tags: List<String>, grid: List<List<int>> attrs: Map<String, double> owner: Customer end
    enum Level LOW, HIGH end
    enum Code<int> A B end
    function int f(a, b) { return { a + b } }
    @role(event) @note("x y")
    rule "r" salience -5 agenda-group "g" activation-group "h" timer 10, 20 no-loop lock-on-active enabled true auto-focus false duration 7
    when $b: Basket() or Basket(tags contains "x") then halt end
    query q(Basket $x) $y: Basket(this == $x.this) end
    """)
    assert p.package == "a.time.b" and p.imports == ["x.y.Z", "x.y.*"] and p.schemas == ["in.schema", "more.schema"]
    assert p.types["Basket"]["attrs"] == "Map<String,double>" and p.enums == {"Level": ["LOW", "HIGH"], "Code": ["A", "B"]}
    r = p.rules[0]
    assert (r.salience, r.agenda_group, r.activation_group, r.timer, r.no_loop, r.lock_on_active, r.enabled, r.auto_focus, r.duration) == (-5, "g", "h", (10, 20), True, True, True, False, 7)
    assert len(r.groups) == 2 and r.notes == {"role": "event", "note": "x y"}
    assert p.queries["q"].params == [("Basket", "$x")]


def test_precedence():
    assert parse_expression("1 + 2 * 3 - 4") == S.Bin("-", S.Bin("+", S.Lit(1), S.Bin("*", S.Lit(2), S.Lit(3))), S.Lit(4))
    assert parse_expression("$a -1") == S.Bin("-", S.Ref("$a"), S.Lit(1))
    e = parse_expression("$a.x > 1 && $b || !$c")
    assert e.op == "||" and e.a.op == "&&"
    p = parse("rule \"r\" when T(a == 1 || b == 2, c == 3) then end").rules[0].groups[0][0]
    assert p.test.op == "||" and p.test.b.op == "&&"


def test_paths():
    r = parse_expression('$o.items[-1].tags["k"]!.size')
    assert r.steps == ("items", -1, "tags", ("key", "k"), "size") and r.safe


@pytest.mark.parametrize("text", ['rule "r" when T(x matches "[") then end', 'rule "r" when T(x == ) then end', "declare A x int end", 'rule "r" when not (A() B()) then end', 'rule "r" when $n: Number() from accumulate(A(), median($x)) then end', "declare A x: int end declare A y: int end", 'rule "r" when T(x == 99999999999999999999) then end'])
def test_rejected(text):
    with pytest.raises(RuleSyntaxError):
        parse(text)


def test_limits():
    with pytest.raises(RuleSyntaxError):
        parse_expression("(" * 70 + "1" + ")" * 70)
    with pytest.raises(RuleSyntaxError):
        parse_expression("+".join(["1"] * 400))


def test_decision_table():
    text = 'DECLARE: declare A x: int end\nRULE NAME,SALIENCE,AGENDA-GROUP,CONDITION: $a: A(x > $1),ACTION: insert B { y = $1 }\nfirst,5,g,1,2\n,*,,*,3\n'
    p = parse(to_rules(text))
    assert [r.name for r in p.rules] == ["first", "DecisionTable_Row_2"]
    assert p.rules[0].salience == 5 and p.rules[0].agenda_group == "g" and p.rules[1].groups == [[]]
    for bad in ("", "RULE NAME\nx\n", "CONDITION:,ACTION: halt\n1,1\n"):
        with pytest.raises(TableError):
            to_rules(bad)


def test_schema():
    got = parse_schema("schema S [id(1), version(1)]; composite P { double x; int64 ids(3); } enum E : int32 { A = 0, B = 1 } message M { P p; E e; string name; }")
    assert got["M"] == T.StructType([T.StructField("p", got["P"]), T.StructField("e", T.StringType()), T.StructField("name", T.StringType())])
    assert got["P"]["ids"].dataType == T.ArrayType(T.LongType())
    with pytest.raises(SchemaError):
        parse_schema("message M { Nope x; }")


def test_document_paths():
    assert steps("$.a.b[*].c[0]") == ["a", "b", "*", "c", 0]
    with pytest.raises(PathError):
        steps("$.a[")
