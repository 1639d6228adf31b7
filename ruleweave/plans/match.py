"""Conditions as relational plans.

A bound fact is a set of columns ``binding__field``; nothing is packed into
structs until a query's output, so unused fields are pruned down to the scan.
Constraints on one fact filter its scan; the others become join conditions, from
which the optimizer takes hash keys.

pattern              plan
-------------------  ---------------------------------------------------------
fact                 scan, filter, inner join (cross product without conditions);
                     ``within`` joins by buckets of time as well
not / exists         left anti / left semi join
forall(A, B)         left anti join with A and not B
eval                 filter
accumulate           aggregate by the correlation keys, then left join; keys and a
                     range of time: one sort and a window, in buckets of time;
                     where the correlation is of another kind, left join, then
                     aggregate
unnest               explode
query call           the query's patterns continue the plan, or a semi join
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..functions.compiler import FID, Scope, binds, conjuncts, mangled, variables
from ..lang import syntax as S

VERSION, ROUTE = "_ver", "_entry_point"
HIDDEN = (FID, VERSION, ROUTE)
AGGREGATE_NAMES = {"avg": "average", "collectList": "collect"}
NUMBER = T.StructType([T.StructField("result", T.DoubleType()), T.StructField("intValue", T.LongType()), T.StructField("longValue", T.LongType()), T.StructField("doubleValue", T.DoubleType()), T.StructField("floatValue", T.DoubleType()), T.StructField("value", T.DoubleType())])


#: Product of the bytes of two sides, as files have them, of which one task compares the pairs.
PAIRS = 1 << 28


class PlanError(ValueError):
    pass


@dataclass
class Match:
    """Rows of matches: the plan, what names mean in it, and the bindings of facts in order."""

    df: DataFrame | None
    scope: Scope
    facts: list[str] = field(default_factory=list)
    shown: list[str] = field(default_factory=list)

    def ids(self) -> list[str]:
        return [mangled(b, FID) for b in self.facts if self.df is not None and mangled(b, FID) in self.df.columns]


@dataclass
class _AsOf:
    """A ``not`` that asks whether a value of the same key lies past a fact's own (``past``) and within a bound."""

    pattern: S.Pattern
    local: object
    equal: list
    past_op: str
    past: S.Bin
    bound_op: str
    bound: S.Bin


class Planner:
    """``facts(type, entry point)`` gives the DataFrame of a type; ``now`` is the event time of time windows."""

    def __init__(self, spark: SparkSession, program: S.Program, facts: Callable[[str, str | None], DataFrame], globals_: dict | None = None, now: int | None = None, wall: bool = True, udfs: dict | None = None, aggregates: dict | None = None, concat: bool = False):
        self.spark, self.program, self.facts_of = spark, program, facts
        self.globals, self.now, self.wall = globals_ or {}, now, wall
        self.udfs, self.aggregates, self.concat = udfs or {}, aggregates or {}, concat
        self._n = 0

    def scope(self, strict: bool = False) -> Scope:
        return Scope(globals=self.globals, strict=strict, udfs=self.udfs, enums=self.program.enums, concat=self.concat)

    # --- patterns

    def match(self, patterns: list[S.Pattern], start: Match | None = None) -> Match:
        m = start or Match(None, self.scope())
        done = set()
        for i, p in enumerate(patterns):
            if i in done:
                continue
            if p.kind != "fact":
                m = getattr(self, f"_{p.kind}")(p, m)
                continue
            latest = self._as_of(p, patterns[i + 1], m) if i + 1 < len(patterns) else None
            if latest is not None:
                done.add(i + 1)
            m = self._fact(p, m, patterns[i + 1 :], latest)
        if m.df is None:
            m.df = self._one()
        return m

    def _one(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(1).alias("_one"))

    def _name(self, binding: str | None) -> str:
        self._n += 1
        return binding or f"$_{self._n}"

    def _scan(self, p: S.Pattern, scope: Scope, binding: str) -> tuple[DataFrame, list[Column]]:
        """The pattern's facts, filtered by what concerns them alone, and the conditions that are left."""
        df = self.facts_of(p.type, p.entry_point)
        scope.bindings[binding] = T.StructType([f for f in df.schema.fields if f.name not in HIDDEN])
        scope.here = binding
        df = df.select(*[F.col(f"`{c}`").alias(mangled(binding, c)) for c in df.columns if c != ROUTE])
        own, rest, mine = [], [], {binding}
        for part in conjuncts(p.test):
            mine |= {b.var for b in binds(part)}
            (own if variables(part) <= mine else rest).append(scope.condition(part))
        for c in own:
            df = df.where(c)
        if p.window:
            df = self._window(df, p.window, binding)
        scope.here = None
        return df, rest

    def _window(self, df: DataFrame, w: S.Span, binding: str) -> DataFrame:
        if w.kind == "length":
            order = mangled(binding, FID)
            if order not in df.columns:
                raise PlanError("a length window needs facts with ids: their order of arrival")
            return df.orderBy(F.desc(order)).limit(w.size)  # each task keeps its own last facts first
        now = self.now if self.now is not None else int(time.time() * 1000) if self.wall else None
        stamp = mangled(binding, "timestamp")
        if now is None or stamp not in df.columns:
            return df
        return df.where(F.coalesce(F.col(stamp), F.lit(now)) >= now - w.size)

    @staticmethod
    def _all(conditions: list[Column]) -> Column | None:
        out = None
        for c in conditions:
            out = c if out is None else out & c
        return out

    def _join(self, left: DataFrame | None, right: DataFrame, conditions: list[Column], how: str, keyed: bool = True) -> DataFrame:
        on = self._all(conditions)
        if left is None:
            if how == "inner":
                return right if on is None else right.where(on)
            left = self._one()
        elif how == "inner" and (on is None or not keyed):
            left, right = self._spread(left, right)
        if on is None:
            return left.crossJoin(right) if how == "inner" else left.join(right.limit(1), F.lit(True), how)
        return left.join(right, on, how)

    def _spread(self, left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Sides of a join that compares all pairs: it has the tasks that its larger side has, for a small file one, so that side is dealt anew by the number of pairs."""
        sizes = [int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in (left, right)]
        tasks = min(sizes[0] * sizes[1] // PAIRS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        if tasks < 2:
            return left, right
        return (left.repartition(tasks), right) if sizes[0] >= sizes[1] else (left, right.repartition(tasks))

    def _once(self, df: DataFrame, scope: Scope, binding: str, later: list[S.Pattern]) -> DataFrame:
        """Functions of this fact alone within later evals of several facts, as columns: a join would compute them for each pair."""
        for p in later:
            if p.kind == "eval" and variables(p.test) - {binding}:
                for x in _calls(p.test, {binding}):
                    if repr(x) not in scope.ready and self._harmless(x, scope):
                        self._n += 1
                        col, kind = scope.compile(x)
                        df = df.withColumn(f"_f{self._n}", col)
                        scope.ready[repr(x)] = F.col(f"_f{self._n}"), kind
        return df

    def _harmless(self, x, scope: Scope) -> bool:
        """Whether an expression has a value or none for any fact, and never raises."""
        if isinstance(x, S.Fn):
            return x.name not in self.udfs and x.name in ("pi", *scalar.UNARY, *scalar.BINARY) and all(self._harmless(a, scope) for a in x.args)
        if isinstance(x, (S.Bin, S.Un)):
            parts = (x.a, x.b) if isinstance(x, S.Bin) else (x.x,)
            return x.op in ("+", "-", "*", "/") and all(self._harmless(y, scope) for y in parts) and isinstance(scope.compile(x)[1], T.DoubleType)
        return isinstance(x, (S.Ref, S.Lit))

    def _fact(self, p: S.Pattern, m: Match, later: list[S.Pattern] = (), latest: _AsOf | None = None) -> Match:
        if isinstance(p.source, S.Accumulate):
            return self._accumulate(p, m)
        if isinstance(p.source, S.Unnest):
            return self._unnest(p, m)
        binding = self._name(p.binding)
        if binding in m.scope.bindings:
            raise PlanError(f"{binding} is bound twice")
        right, rest = self._scan(p, m.scope, binding)
        right = self._once(right, m.scope, binding, later)
        found = self._with_next(latest, m.scope, right) if latest is not None else None
        if found is not None:
            right, rest = found[0], [*rest, found[1]]
        joined = self._join_within(p, m, right, rest, binding)
        if joined is None:
            tests = [x.test if isinstance(x, S.Bind) else x for x in conjuncts(p.test)]
            keyed = any(isinstance(x, S.Bin) and x.op in ("==", "coincides") and variables(x) - {binding} for x in tests)
            joined = self._join(m.df, right, rest, "inner", keyed)
        joined = joined.drop("_next")
        out = Match(joined, m.scope, [*m.facts, binding], [*m.shown, binding] if p.binding else m.shown)
        return self._not(later[0], out) if latest is not None and found is None else out

    def _as_of(self, p: S.Pattern, then: S.Pattern, m: Match) -> _AsOf | None:
        """``$p: T(v <= x) not T(key == $p.key, v > $p.v, v <= x)``: the parts of the second pattern, if it is of this shape.

        It asks for the nearest value past $p's: one that $p has by itself, so it is
        found before the join, where after it each match would meet all of a key.
        """
        if m.df is None or p.source is not None or p.binding is None or then.kind != "not":
            return None
        inner = then.inner[0]
        if inner.kind != "fact" or inner.source is not None or inner.window is not None or p.window is not None:
            return None
        mine, local, equal, past, bound = {inner.binding}, None, [], [], []
        for part in conjuncts(inner.test):
            mine |= {b.var for b in binds(part)}
            if variables(part) <= mine:
                local = part if local is None else S.Bin("&&", local, part)
                continue
            if not (isinstance(part, S.Bin) and isinstance(part.a, S.Ref) and part.a.var is None and self._outer(part.b)) or variables(part.b) & mine:
                return None
            op = {"after": ">", "before": "<", "during": ">="}.get(part.op, part.op)
            of_p = variables(part.b) == {p.binding}
            if op == "==" and of_p:
                equal.append(part)
            elif op in ("<", "<=", ">", ">=") and (of_p or variables(part.b) <= set(m.scope.bindings)):
                (past if of_p else bound).append((op, part))
            else:
                return None
        if not equal or len(past) != 1 or len(bound) != 1 or past[0][0][0] == bound[0][0][0] or past[0][1].a != bound[0][1].a:
            return None
        return _AsOf(inner, local, equal, *past[0], *bound[0])

    def _with_next(self, x: _AsOf, scope: Scope, right: DataFrame) -> tuple[DataFrame, Column] | None:
        """``right`` with ``_next``, the nearest value past each fact's own, and the condition that it is not within the bound; None if their types differ."""
        inner, child = self._name(x.pattern.binding), scope.child()
        given, _ = self._scan(S.Pattern("fact", x.pattern.type, x.pattern.binding, x.local, None, x.pattern.entry_point), child, inner)
        child.here = inner
        (value, kind), (own, own_kind), (bound, bound_kind) = child.compile(x.past.a), child.compile(x.past.b), child.compile(x.bound.b)
        keys = [(child.compile(e.a), child.compile(e.b)) for e in x.equal]
        if not all(scalar.is_number(t) for t in (kind, own_kind, bound_kind)) or kind != own_kind or any(a[1] != b[1] for a, b in keys):
            return None
        names = [f"_n{i}" for i in range(len(keys))]
        have = given.select(*[a.alias(n) for n, ((a, _), _) in zip(names, keys)], value.alias("_v"), F.lit(True).alias("_has"))
        asks = right.select(*[b.alias(n) for n, (_, (b, _)) in zip(names, keys)], own.alias("_v"), F.lit(False).alias("_has"))
        values = have.unionByName(asks).dropna(subset=[*names, "_v"]).groupBy(*names, "_v").agg(F.max("_has").alias("_has"))
        up = x.past_op[0] == ">"
        frame = Window.partitionBy(*names).orderBy(F.desc("_v") if up else F.asc("_v")).rowsBetween(Window.unboundedPreceding, 0 if x.past_op.endswith("=") else -1)
        nexts = values.withColumn("_next", (F.min if up else F.max)(F.when(F.col("_has"), F.col("_v"))).over(frame)).drop("_has")
        on = self._all([b == F.col(n) for n, (_, (b, _)) in zip(names, keys)] + [own == F.col("_v")])
        out = right.join(nexts, on, "left").drop(*names, "_v")
        return out, ~F.coalesce(scalar.compare(x.bound_op, F.col("_next"), kind, bound, bound_kind), F.lit(False))

    def _join_within(self, p: S.Pattern, m: Match, right: DataFrame, rest: list[Column], binding: str) -> DataFrame | None:
        """A join of times at most ``ms`` apart: both sides fall into buckets of that length, the left one into three.

        So a hot key is divided by time; a right fact meets each left one in one bucket at most.
        """
        near = next((x for x in conjuncts(p.test) if isinstance(x, S.Within) and x.ms > 0), None)
        if near is None or m.df is None:
            return None
        m.scope.here = binding
        (mine, kind), (other, other_kind) = m.scope.resolve(S.Ref(None, ("timestamp",))), m.scope.resolve(S.Ref(near.var, ("timestamp",)))
        m.scope.here = None
        if not (scalar.is_whole(kind) and scalar.is_whole(other_kind)):
            return None
        here = _bucket(other, near.ms)
        left = m.df.withColumn("_span", F.explode(F.array(here - 1, here, here + 1)))
        right = right.withColumn("_in", _bucket(mine, near.ms))
        return self._join(left, right, [F.col("_span") == F.col("_in"), *rest], "inner").drop("_span", "_in")

    def _test(self, p: S.Pattern, m: Match, how: str) -> Match:
        inner = p.inner[0]
        if inner.kind != "fact" or inner.source is not None:
            raise PlanError("not and exists take one plain pattern")
        scope, binding = m.scope.child(), self._name(inner.binding)
        bound = self._extreme(inner, m, scope, binding, how)
        if bound is not None:
            return bound
        right, rest = self._scan(inner, scope, binding)
        return Match(self._join(m.df, right, rest, how), m.scope, m.facts, m.shown)

    def _extreme(self, p: S.Pattern, m: Match, scope: Scope, binding: str, how: str) -> Match | None:
        """``not T(key == $k, cost < $c)``: one inequality needs only the least (or greatest) of each key.

        So it is an aggregate and a hash join, where a join on the inequality would
        compare all pairs.  None if the pattern is of another shape.
        """
        if m.df is None or p.window is not None:
            return None
        own, equal, unequal, mine = [], [], [], {binding}
        for part in conjuncts(p.test):
            mine |= {b.var for b in binds(part)}
            plain = isinstance(part, S.Bin) and isinstance(part.a, S.Ref) and part.a.var is None and not variables(part.b) & mine
            if variables(part) <= mine:
                own.append(part)
            elif plain and part.op == "==" and self._outer(part.b):
                equal.append(part)
            elif plain and part.op in ("<", "<=", ">", ">=", "after", "before", "during") and self._outer(part.b):
                unequal.append(part)
            else:
                return None
        if len(unequal) != 1:
            return None
        local = None
        for part in own:
            local = part if local is None else S.Bin("&&", local, part)
        right, _ = self._scan(S.Pattern("fact", p.type, p.binding, local, None, p.entry_point), scope, binding)
        scope.here = binding
        part = unequal[0]
        value, kind = scope.compile(part.a)
        bound, bound_kind = scope.compile(part.b)
        if not (scalar.is_number(kind) and scalar.is_number(bound_kind)):
            return None
        keys = [(scope.compile(e.a), scope.compile(e.b)) for e in equal]
        op = {"after": ">", "before": "<", "during": ">="}.get(part.op, part.op)
        best = (F.min if op[0] == "<" else F.max)(value).alias("_best")
        named = [c.alias(f"_x{i}") for i, ((c, _), _) in enumerate(keys)]
        top = right.groupBy(*named).agg(best) if named else right.agg(best)
        on = self._all([scalar.compare("==", F.col(f"_x{i}"), k[1], *o) for i, (k, o) in enumerate(keys)])
        joined = m.df.join(top, on, "left") if on is not None else m.df.crossJoin(F.broadcast(top))
        holds = F.coalesce(scalar.compare(op, F.col("_best"), kind, bound, bound_kind), F.lit(False))
        df = joined.where(holds if how == "left_semi" else ~holds).select(*m.df.columns)
        return Match(df, m.scope, m.facts, m.shown)

    @staticmethod
    def _outer(x) -> bool:
        """Whether an expression names no field of the pattern at hand."""
        if isinstance(x, S.Ref):
            return x.var is not None
        if isinstance(x, (S.Un, S.Bin)):
            return all(Planner._outer(y) for y in ((x.x,) if isinstance(x, S.Un) else (x.a, x.b)))
        return isinstance(x, S.Lit) or isinstance(x, S.Fn) and all(map(Planner._outer, x.args))

    def _not(self, p: S.Pattern, m: Match) -> Match:
        return self._test(p, m, "left_anti")

    def _exists(self, p: S.Pattern, m: Match) -> Match:
        return self._test(p, m, "left_semi")

    def _forall(self, p: S.Pattern, m: Match) -> Match:
        """No fact of the first pattern that misses one of the others; true where there is none."""
        first, others = p.inner[0], p.inner[1:]
        if any(o.kind != "fact" or o.type != first.type for o in others):
            raise PlanError("forall takes patterns of one type")
        scope = m.scope.child()
        binding = self._name(first.binding)
        right, rest = self._scan(first, scope, binding)
        scope.here = binding
        ok = [F.coalesce(scope.condition(o.test), F.lit(False)) for o in others if o.test is not None]
        if ok:
            rest = [*rest, ~self._all(ok)]
        return Match(self._join(m.df, right, rest, "left_anti"), m.scope, m.facts, m.shown)

    def _eval(self, p: S.Pattern, m: Match) -> Match:
        df = m.df if m.df is not None else self._one()
        return Match(df.where(m.scope.condition(p.test)), m.scope, m.facts, m.shown)

    def _unnest(self, p: S.Pattern, m: Match) -> Match:
        col, kind = m.scope.resolve(p.source.ref)
        if not isinstance(kind, T.ArrayType):
            raise PlanError("unnest takes a list")
        binding = self._name(p.binding)
        element = kind.elementType
        if not isinstance(element, T.StructType):
            element = T.StructType([T.StructField("value", element)])
            col = F.transform(col, lambda e: F.struct(e.alias("value")))
        df = m.df.select("*", F.explode(col).alias("_item")).where(F.col("_item").isNotNull())
        df = df.select(*m.df.columns, *[F.col("_item").getField(n).alias(mangled(binding, n)) for n in element.names])
        m.scope.bindings[binding] = element
        m.scope.here = binding
        for part in conjuncts(p.test):
            df = df.where(m.scope.condition(part))
        m.scope.here = None
        return Match(df, m.scope, m.facts, [*m.shown, binding] if p.binding else m.shown)

    # --- aggregation

    def _accumulate(self, p: S.Pattern, m: Match) -> Match:
        acc = p.source
        binding, source = self._name(p.binding), self._name(acc.source.binding)
        outer = set(m.scope.bindings) | set(m.scope.names)
        scope = m.scope.child()
        parts, mine, equal, other = [], {source}, [], []
        for part in conjuncts(acc.source.test):
            mine |= {b.var for b in binds(part)}
            if variables(part) <= mine:
                parts.append(part)
            elif isinstance(part, S.Bin) and part.op == "==" and isinstance(part.a, S.Ref) and part.a.var is None and not variables(part.b) & mine:
                equal.append(part)
            else:
                other.append(part)
        local = None
        for part in parts:
            local = part if local is None else S.Bin("&&", local, part)
        src = S.Pattern("fact", acc.source.type, acc.source.binding, local, None, acc.source.entry_point, acc.source.window)
        right, _ = self._scan(src, scope, source)
        scope.here = source
        name = AGGREGATE_NAMES.get(acc.function, acc.function)
        argument = None if acc.argument is None or isinstance(acc.argument, S.Lit) else acc.argument
        plain = not other and not (variables(argument) & outer if argument is not None else False)
        keys = [scope.compile(part.a) for part in equal]
        tests = [scope.compile(part.b) for part in equal]
        present = F.lit(True)
        windowed = None if plain else self._windowed(m, scope, source, right, name, argument, outer, list(zip(keys, tests)), other)
        if windowed is not None:
            joined, kind = windowed
        elif plain:
            value = self._value(scope, argument, name, source, right)
            aggs, kind = self._aggregate(name, value, present, source, right)
            named = [c.alias(f"_k{i}") for i, (c, _) in enumerate(keys)]
            grouped = right.groupBy(*named).agg(aggs.alias("_agg")) if named else right.agg(aggs.alias("_agg"))
            on = self._all([scalar.compare("==", F.col(f"_k{i}"), keys[i][1], tests[i][0], tests[i][1]) for i in range(len(keys))])
            left = m.df if m.df is not None else self._one()
            # Without keys the right side is a single row.
            joined = left.join(grouped, on, "left") if on is not None else left.crossJoin(F.broadcast(grouped))
        else:
            left = (m.df if m.df is not None else self._one()).withColumn("_row", F.monotonically_increasing_id())
            right = right.withColumn("_hit", F.lit(True))
            on = self._all([scalar.compare("==", *keys[i], *tests[i]) for i in range(len(keys))] + [scope.condition(part) for part in other])
            value = self._value(scope, argument, name, source, right)
            both = left.join(right, on if on is not None else F.lit(True), "left")
            aggs, kind = self._aggregate(name, value, F.col("_hit"), source, right)
            carried = [c for c in left.columns if c != "_row"]
            joined = both.groupBy("_row").agg(aggs.alias("_agg"), *[F.first(c).alias(c) for c in carried]).drop("_row")
        declared = self.program.types.get(p.type)
        out, fields = self._result(F.col("_agg"), kind, name, declared)
        keep = m.df.columns if m.df is not None else ["_one"]
        df = joined.select(*keep, *[c.alias(mangled(binding, f)) for f, (c, _) in out.items()])
        m.scope.bindings[binding] = fields
        m.scope.here = binding
        for part in conjuncts(p.test):
            df = df.where(m.scope.condition(part))
        m.scope.here = None
        return Match(df, m.scope, m.facts, [*m.shown, binding] if p.binding else m.shown)

    def _windowed(self, m: Match, scope: Scope, source: str, right: DataFrame, name: str, argument, outer: set[str], pairs: list, other: list) -> tuple[DataFrame, T.DataType] | None:
        """Equal keys and a range of a whole number (a time) about the outer fact's: a window, where a join would compare all pairs of a key.

        Outer and inner facts stand side by side in one table, partitioned by the
        keys and by buckets as long as the range (inner facts in two of them, so that
        a hot key is divided), sorted by time.  ``field != outer value`` takes off what
        has that value.  None if the condition is of another shape.
        """
        if m.df is None or name not in ("count", "sum", "average", "min", "max") or name in self.aggregates:
            return None
        if argument is not None and variables(argument) & outer:
            return None
        low = high = base = time = apart = None
        for part in other:
            if not (isinstance(part, S.Bin) and isinstance(part.a, S.Ref) and part.a.var is None and self._outer(part.b)):
                return None
            op = {"after": ">", "before": "<", "during": ">="}.get(part.op, part.op)
            if op == "!=" and apart is None:
                apart = part
                continue
            at, shift = _shifted(part.b)
            if op not in ("<", "<=", ">", ">=") or shift is None or time not in (None, part.a) or base not in (None, at):
                return None
            time, base = part.a, at
            if op[0] == ">" and low is None:
                low = shift + (op == ">")
            elif op[0] == "<" and high is None:
                high = shift - (op == "<")
            else:
                return None
        if low is None or high is None or high < low:
            return None
        value, kind = self._value(scope, argument, name, source, right)
        aggs, agg_kind = self._aggregate(name, (None if value is None else F.col("_v"), kind), ~F.col("_asks"), source, right)
        (t, t_kind), (b, b_kind) = scope.compile(time), scope.compile(base)
        if apart is not None:
            (x, x_kind), (y, y_kind) = scope.compile(apart.a), scope.compile(apart.b)
            if type(x_kind) is not type(y_kind) or not (name == "count" or name == "sum" and scalar.is_whole(kind)):
                return None
        if not (scalar.is_whole(t_kind) and scalar.is_whole(b_kind)) or any(type(k[1]) is not type(o[1]) for k, o in pairs):
            return None
        span = high - low + 1
        keys = [f"_k{i}" for i in range(len(pairs))]
        at = F.col("_at")
        asks = m.df.select("*", *[o[0].alias(k) for k, (_, o) in zip(keys, pairs)], b.cast("long").alias("_at"), (y if apart is not None else F.lit(0)).alias("_x"), F.lit(None).cast(kind if value is not None else "int").alias("_v"), F.lit(True).alias("_asks"))
        asks = asks.withColumn("_b", _bucket(at + high, span))
        given = right.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in m.df.schema.fields], *[k[0].alias(c) for c, (k, _) in zip(keys, pairs)], t.cast("long").alias("_at"), (x if apart is not None else F.lit(0)).alias("_x"), (value if value is not None else F.lit(None).cast("int")).alias("_v"), F.lit(False).alias("_asks"))
        for c in [*keys, "_at", "_x"]:
            given = given.where(F.col(c).isNotNull())
        given = given.withColumn("_b", F.explode(F.array(_bucket(at, span), _bucket(at, span) + 1)))
        frame = Window.partitionBy(*keys, "_b").orderBy("_at").rangeBetween(low, high)
        out = aggs.over(frame)
        if apart is not None:
            out = out - F.coalesce(aggs.over(Window.partitionBy(*keys, "_b", "_x").orderBy("_at").rangeBetween(low, high)), F.lit(0))
            out = F.when(F.col("_x").isNotNull(), out)
        # A null key or time equals nothing and lies in no range.
        known = F.col("_at").isNotNull()
        for c in keys:
            known = known & F.col(c).isNotNull()
        joined = asks.unionByName(given).withColumn("_agg", F.when(known, out)).where("_asks")
        return joined.select(*m.df.columns, "_agg"), agg_kind

    def _value(self, scope: Scope, argument, name: str, source: str, right: DataFrame):
        if name in ("collect", "collectSet"):
            kind = T.StructType([T.StructField(FID, T.LongType()), *scope.bindings[source].fields])
            cols = [F.col(mangled(source, f.name)).alias(f.name) if mangled(source, f.name) in right.columns else F.lit(None).cast("long").alias(f.name) for f in kind.fields]
            return F.struct(*cols), kind
        return (None, T.NullType()) if argument is None else scope.compile(argument)

    def _aggregate(self, name: str, value, present: Column, source: str, right: DataFrame) -> tuple[Column, T.DataType]:
        col, kind = value
        if name in self.aggregates:
            return self.aggregates[name](F.when(present, col)), T.DoubleType()
        if name == "count":
            # A bare field or binding counts matches; an expression counts where it has a value.
            return (F.count(F.when(present, F.lit(1))) if col is None else F.count(F.when(present, col))), T.LongType()
        if name in ("collect", "collectSet"):
            rows = F.collect_list(F.when(present, col))
            return (F.array_sort(F.array_distinct(rows)) if name == "collectSet" else F.array_sort(rows)), T.ArrayType(kind)
        if col is None:
            raise PlanError(f"{name} takes an argument")
        if not scalar.is_number(kind):
            col, kind = F.lit(None).cast("double"), T.DoubleType()
        given = F.when(present, col)
        if name == "sum":
            return F.sum(given), T.LongType() if scalar.is_whole(kind) else kind
        if name == "average":
            return F.avg(given), T.DoubleType()
        if name in ("min", "max"):
            return (F.min if name == "min" else F.max)(given), kind
        raise PlanError(f"unknown aggregate {name!r}")

    def _result(self, agg: Column, kind: T.DataType, name: str, declared: dict[str, str] | None):
        """Fields of the result fact: never absent, 0 or an empty list where nothing matched."""
        if isinstance(kind, T.ArrayType):
            out = {"result": (F.coalesce(agg, F.array().cast(kind)), kind)}
            return out, T.StructType([T.StructField("result", kind)])
        whole = scalar.is_whole(kind)
        zero = F.lit(0).cast(kind)
        r = F.coalesce(agg, zero)
        if declared and "result" in declared:
            want = data_type(declared["result"], self.program)
            return {"result": (r.cast(want), want)}, T.StructType([T.StructField("result", want)])
        cells = {"result": (r, kind if not whole else T.LongType()), "intValue": (r.cast("long"), T.LongType()), "longValue": (r.cast("long"), T.LongType()), "doubleValue": (r.cast("double"), T.DoubleType()), "floatValue": (r.cast("double"), T.DoubleType()), "value": (r.cast("double"), T.DoubleType())}
        return cells, T.StructType([T.StructField(k, t) for k, (_, t) in cells.items()])

    # --- queries

    def _call(self, p: S.Pattern, m: Match) -> Match:
        q = self.query_of(p.name)
        given = p.args[: len(q.params)]
        if any(a not in m.scope.bindings for a in given):
            raise PlanError(f"{p.name}: parameters must be bound")
        asked = p.args[len(q.params) :]
        scope = m.scope.child()
        names = {param: arg for (_, param), arg in zip(q.params, given)}
        inner = Match(m.df, scope, list(m.facts), [])
        taken = {b.var for x in q.patterns for b in binds(x.test)} | {x.binding for x in q.patterns if x.binding}
        fresh = {b: self._name(None) for b in taken if b not in names}
        outputs = [x.binding for x in q.patterns if x.binding and x.kind == "fact"]
        fresh |= {b: a for b, a in zip(outputs, asked)}
        body = self.match([_renamed(x, names | fresh) for x in q.patterns], inner)
        if not asked:
            keys = m.ids()
            if m.df is None:
                return Match(self._one().join(body.df.limit(1), F.lit(True), "left_semi"), m.scope, m.facts, m.shown)
            if not keys:
                raise PlanError("a query call needs facts with ids")
            found = body.df.select(*[F.col(k).alias(f"_q{i}") for i, k in enumerate(keys)]).distinct()
            on = self._all([F.col(k) == F.col(f"_q{i}") for i, k in enumerate(keys)])
            return Match(m.df.join(found, on, "left_semi"), m.scope, m.facts, m.shown)
        for a in asked:
            m.scope.bindings[a] = body.scope.bindings[a]
        return Match(body.df, m.scope, body.facts, [*m.shown, *asked])

    def query_of(self, name: str) -> S.Query:
        if name not in self.program.queries:
            raise PlanError(f"Query '{name}' not found.")
        return self.program.queries[name]

    def query(self, name: str, **params: DataFrame) -> Match:
        """All matches of a query; parameters are DataFrames of facts, by name without $."""
        q = self.query_of(name)
        m = Match(None, self.scope())
        for kind, var in q.params:
            given = params[var.lstrip("$")]
            m.scope.bindings[var] = T.StructType([f for f in given.schema.fields if f.name not in HIDDEN])
            df = given.select(*[F.col(f"`{c}`").alias(mangled(var, c)) for c in given.columns if c != ROUTE])
            m = Match(df if m.df is None else m.df.crossJoin(df), m.scope, [*m.facts, var], m.shown)
        return self.match(q.patterns, m)


def _calls(x, names: set[str]) -> list[S.Fn]:
    """The largest calls within an expression that use these $names, all of them and no others."""
    if isinstance(x, S.Fn) and variables(x) == names:
        return [x]
    if isinstance(x, S.Fn):
        return [c for a in x.args for c in _calls(a, names)]
    if isinstance(x, S.Bin):
        return _calls(x.a, names) + _calls(x.b, names)
    return _calls(x.x, names) if isinstance(x, S.Un) else []


def _bucket(time: Column, size: int) -> Column:
    """The number of the interval of ``size`` that a whole number lies in."""
    return F.call_function("div", time - F.pmod(time, F.lit(size)), F.lit(size))


def _shifted(x) -> tuple:
    """(base, whole shift) of ``base``, ``base + n`` or ``base - n``; the shift is None for other expressions."""
    if isinstance(x, S.Ref):
        return x, 0
    if isinstance(x, S.Bin) and x.op in "+-" and isinstance(x.a, S.Ref) and isinstance(x.b, S.Lit) and isinstance(x.b.value, int):
        return x.a, x.b.value if x.op == "+" else -x.b.value
    return x, None


def output(m: Match, ids: bool = False) -> DataFrame:
    """A struct for each binding, and a column for each named field."""
    cols = []
    for b in m.shown:
        fields = [F.col(mangled(b, f)).alias(f) for f in m.scope.bindings[b].names]
        if ids and mangled(b, FID) in m.df.columns:
            fields.insert(0, F.col(mangled(b, FID)).alias(FID))
        cols.append(F.struct(*fields).alias(b.lstrip("$")))
    cols += [c.alias(n.lstrip("$")) for n, (c, _) in m.scope.names.items() if n.lstrip("$") not in {b.lstrip("$") for b in m.shown}]
    return m.df.select(*cols)


def _renamed(x, names: dict[str, str]):
    """A copy of a tree with other $names."""
    if isinstance(x, S.Ref):
        return S.Ref(names.get(x.var, x.var), x.steps, x.safe)
    if isinstance(x, S.Pattern):
        return S.Pattern(x.kind, x.type, names.get(x.binding, x.binding), _renamed(x.test, names), _renamed(x.source, names), x.entry_point, x.window, [_renamed(i, names) for i in x.inner], x.name, [names.get(a, a) for a in x.args])
    if isinstance(x, S.Accumulate):
        return S.Accumulate(_renamed(x.source, names), x.function, _renamed(x.argument, names))
    if isinstance(x, S.Unnest):
        return S.Unnest(_renamed(x.ref, names))
    if isinstance(x, S.Bind):
        return S.Bind(names.get(x.var, x.var), _renamed(x.ref, names), _renamed(x.test, names))
    if isinstance(x, S.Un):
        return S.Un(x.op, _renamed(x.x, names))
    if isinstance(x, S.Bin):
        return S.Bin(x.op, _renamed(x.a, names), _renamed(x.b, names))
    if isinstance(x, S.Fn):
        return S.Fn(x.name, tuple(_renamed(a, names) for a in x.args))
    if isinstance(x, S.In):
        return S.In(_renamed(x.x, names), tuple(_renamed(v, names) for v in x.values), x.negated)
    if isinstance(x, S.Within):
        return S.Within(x.ms, names.get(x.var, x.var))
    return x


SIMPLE = {
    "string": T.StringType(), "int": T.LongType(), "integer": T.LongType(), "long": T.LongType(), "int8": T.LongType(), "int16": T.LongType(), "int32": T.LongType(), "int64": T.LongType(),
    "uint8": T.LongType(), "uint16": T.LongType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "double": T.DoubleType(), "float": T.DoubleType(), "number": T.DoubleType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "bytes": T.BinaryType(), "uuid": T.StringType(), "datetime": T.TimestampType(), "timestamp": T.TimestampType(), "date": T.DateType(),
    "time": T.LongType(), "duration": T.LongType(), "decimal": T.DecimalType(38, 10), "bigint": T.DecimalType(38, 0), "any": T.StringType(), "object": T.StringType(), "char": T.StringType(),
    "money": T.StructType([T.StructField("amount", T.DecimalType(38, 10)), T.StructField("currency", T.StringType())]),
}


def data_type(name: str, program: S.Program | None = None, seen: tuple[str, ...] = ()) -> T.DataType:
    """The Spark type of a declared field type."""
    if "<" in name:
        head, inner = name[: name.index("<")], name[name.index("<") + 1 : -1]
        depth, cutat = 0, None
        for i, c in enumerate(inner):
            depth += (c == "<") - (c == ">")
            if c == "," and not depth:
                cutat = i
                break
        if head.lower() == "map":
            return T.MapType(data_type(inner[:cutat].strip(), program, seen), data_type(inner[cutat + 1 :].strip(), program, seen))
        return T.ArrayType(data_type(inner, program, seen))
    if name.lower() in SIMPLE:
        return SIMPLE[name.lower()]
    short = name.rsplit(".", 1)[-1]
    if program and short in program.enums:
        return T.StringType()
    if program and short in program.types and short not in seen:
        return struct_type(short, program, (*seen, short))
    if short in ("List", "FactList"):
        return T.ArrayType(T.StringType())
    if short == "Map":
        return T.MapType(T.StringType(), T.StringType())
    raise PlanError(f"unknown type {name!r}")


def struct_type(name: str, program: S.Program, seen: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(f, data_type(t, program, seen or (name,))) for f, t in program.types[name].items()])
