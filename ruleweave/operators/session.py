"""Sessions: rules fire over working memory until nothing is left to do.

Firing is set at a time.  A round takes the highest rule (salience, then order
of declaration) that has matches which have not fired, runs its actions on all
of them at once, and starts again from the top.  Where a round's matches would
cancel each other, a round takes only those that cannot: one match for each
value that a ``not`` of the rule tests and the rule inserts, and one for each
fact that it updates or retracts.  ``exact=True`` takes one match a round.

A match is its rule and its facts' ids and versions; it fires once until one of
its facts changes.  Logical facts live as long as a match that justifies them.
"""

from __future__ import annotations

import difflib
import inspect
import time
from collections.abc import Callable
from dataclasses import dataclass, field, is_dataclass, replace
from dataclasses import fields as fields_of

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..functions.compiler import FID, Scope, conjuncts, mangled, variables
from ..lang import syntax as S
from ..lang.parser import AGGREGATES, parse
from ..plans.match import ROUTE, VERSION, Match, Planner, PlanError, output, struct_type
from .memory import MERGE, Memory, measured, ranked, settle

WHILE_CAP = 1000
# How many functions a session takes, and arguments a call.
MAX_FUNCTIONS, MAX_ARGUMENTS = 256, 16
#: Turns of a loop of updates that one job makes.
UNROLL = 8
MAIN = "MAIN"
DEFAULT_GLOBALS = {"List": list, "Set": set, "Map": dict}


class RuleError(RuntimeError):
    pass


class KnowledgeBase:
    """Rules and queries of one or more texts; shared by sessions."""

    def __init__(self, *texts: str, types: dict[str, T.StructType] | None = None, aggregates: dict[str, Callable] | None = None, predicates: dict[str, Callable] | None = None, allow_concat: bool = False):
        self.aggregates, self.predicates, self.allow_concat = aggregates or {}, predicates or {}, allow_concat
        self.program = S.Program()
        self.schemas: dict[str, T.StructType] = dict(types or {})
        for text in texts:
            self._merge(parse(text, (*AGGREGATES, *self.aggregates)))
        self._check()

    @classmethod
    def load(cls, path: str, bases: list[str] | None = None, **options) -> KnowledgeBase:
        """A rule file with all that it imports."""
        from ..sources.schemas import load

        texts, types = load(path, bases)
        return cls(*texts, types=types, **options)

    def _merge(self, p: S.Program) -> None:
        mine = self.program
        for name in p.types:
            if name in mine.types or name in self.schemas:
                raise PlanError(f"type {name} is declared twice")
        mine.package = mine.package or p.package
        for part in ("imports", "schemas", "functions", "rules"):
            getattr(mine, part).extend(getattr(p, part))
        for part in ("globals", "types", "enums", "queries"):
            getattr(mine, part).update(getattr(p, part))

    def _check(self) -> None:
        self.by_name = {}
        for r in self.program.rules:
            if r.name in self.by_name:
                raise PlanError(f"rule {r.name!r} is there twice")
            self.by_name[r.name] = r
        for name in self.program.types:
            self.schemas[name] = struct_type(name, self.program)
        for r in self.program.rules:
            self._inherit(r, ())
        self.rules = [r for r in self.program.rules if r.enabled]
        for q in [p for r in self.program.rules for g in r.groups for p in g] + [p for q in self.program.queries.values() for p in q.patterns]:
            self._known(q)
            self._fields(q)

    def _inherit(self, r: S.Rule, seen: tuple[str, ...]) -> None:
        """Puts the parent's first group before each group of the child, once."""
        if not r.extends:
            return
        if r.name in seen:
            raise PlanError(f"rule {r.name!r} extends itself")
        parent = self.by_name.get(r.extends)
        if parent is None:
            raise PlanError(f"rule {r.name!r} extends unknown {r.extends!r}")
        self._inherit(parent, (*seen, r.name))
        r.groups = [[*parent.groups[0], *g] for g in r.groups]
        r.salience = parent.salience if r.salience is None else r.salience
        r.agenda_group = r.agenda_group or parent.agenda_group
        r.extends = None

    def _known(self, p: S.Pattern) -> None:
        for inner in p.inner:
            self._known(inner)
        if p.kind == "call" and p.name not in self.program.queries:
            raise PlanError(f"Query '{p.name}' not found.")
        if isinstance(p.source, S.Accumulate):
            self._known(p.source.source)

    def _fields(self, p: S.Pattern) -> None:
        """Fields that a pattern reads of its own fact must be declared, where its type is."""
        for inner in [*p.inner, *([p.source.source] if isinstance(p.source, S.Accumulate) else [])]:
            self._fields(inner)
        want = self.schemas.get(self.resolve(p.type)) if p.type and p.source is None else None
        if want is None:
            return
        for part in conjuncts(p.test):
            for ref in (x for x in _parts(part) if isinstance(x, S.Ref) and x.var is None and x.steps):
                name = ref.steps[0]
                if name not in want.names and name != "this" and name not in self.program.globals and not any(name in v for v in self.program.enums.values()):
                    near = difflib.get_close_matches(str(name), want.names, 1)
                    raise scalar.ExpressionError(f"{p.type} has no field {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))

    def patterns(self) -> list[str]:
        """The literal regular expressions of conditions."""
        parts = _parts([[r.groups for r in self.program.rules], [q.patterns for q in self.program.queries.values()]])
        return [x.b.value for x in parts if isinstance(x, S.Bin) and x.op.endswith("matches") and isinstance(x.b, S.Lit) and isinstance(x.b.value, str)]

    def resolve(self, name: str) -> str:
        """The type that a name stands for: itself, or the one that ends in it; more than one is an error."""
        if name in self.schemas:
            return name
        short = [k for k in self.schemas if k.rsplit(".", 1)[-1] == name.rsplit(".", 1)[-1]]
        if len(short) > 1:
            raise PlanError(f"type {name} is ambiguous: {', '.join(sorted(short))}")
        return short[0] if short else name


@dataclass(frozen=True)
class Queue:
    """Matches of a rule that wait for a budget, in their order (``_turn``): those before ``at`` of ``n`` have fired, and ``before`` them others."""

    mark: tuple
    match: Match
    df: DataFrame
    at: int
    n: int
    before: DataFrame | None

    def fired(self) -> DataFrame:
        done = self.df.where(F.col("_turn") < self.at).select("_key", "_vers", "_group")
        return done if self.before is None else self.before.unionByName(done)


@dataclass
class Stats:
    fired: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    rounds: int = 0

    def add(self, rule: str, n: int, s: float) -> None:
        self.fired[rule] = self.fired.get(rule, 0) + n
        self.seconds[rule] = self.seconds.get(rule, 0.0) + s
        self.rounds += 1


class Session:
    def __init__(self, kb: KnowledgeBase, spark: SparkSession, functions: dict[str, Callable] | None = None, validation: str = "none", now: int | None = None):
        self.kb, self.spark, self.memory = kb, spark, Memory(spark)
        self.functions, self.validation, self.now = functions or {}, validation, now
        self.globals = {n: next((make() for k, make in DEFAULT_GLOBALS.items() if t.split("<")[0].endswith(k)), None) for n, t in kb.program.globals.items()}
        self.listeners: list[Callable[[str, str, int], None]] = []
        self.hooks: dict[str, list[Callable[[str, int], None]]] = {}
        self.stats, self.fired = Stats(), {}
        self.blocked: dict[str, DataFrame] = {}
        self.checked: dict[tuple[str, int], tuple] = {}
        self.lazy: set[str] = set()  # rules whose fired matches are a plan so far
        self.parts: dict[tuple[int, str], int] = {}
        self.idle: dict[str, tuple] = {}
        self.upto: dict[str, tuple] = {}
        self.waiting: dict[str, Queue] = {}
        self.isolate, self.failures = False, []
        self.logical: list[tuple[str, str, int, DataFrame]] = []
        self.focus: list[str] = []
        self.outputs: dict[str, DataFrame] = {}
        self.wall = True
        self._check_bindings()
        for name, schema in kb.schemas.items():
            self.memory.declare(name, schema)

    def _check_bindings(self) -> None:
        """What is wrong with patterns of ``matches`` and with the host's functions is said at once, not at the first run."""
        for text in self.kb.patterns():
            try:
                self.spark._jvm.java.util.regex.Pattern.compile(text)
            except (IllegalArgumentException, Py4JJavaError) as e:
                raise PlanError(f"bad pattern {text!r}: {str(e).splitlines()[0]}") from None
        if len(self.functions) > MAX_FUNCTIONS:
            raise PlanError(f"more than {MAX_FUNCTIONS} functions")
        for r in self.kb.program.rules:
            for a in _actions(r.actions):
                if isinstance(a, S.Call) and a.name in self.functions:
                    self._check_call(r.name, a)

    def _check_call(self, rule: str, a: S.Call) -> None:
        if len(a.args) > MAX_ARGUMENTS:
            raise PlanError(f"rule {rule!r}: {a.name} has more than {MAX_ARGUMENTS} arguments")
        try:
            inspect.signature(self.functions[a.name]).bind(*a.args)
        except TypeError as e:
            raise PlanError(f"rule {rule!r}: {a.name}: {e}") from None
        except ValueError:
            pass  # a built-in without a signature

    # --- facts

    def insert(self, name: str, df: DataFrame, entry_point: str | None = None, order: list[str] | None = None) -> DataFrame:
        name = self.kb.resolve(name)
        want = self.kb.schemas.get(name)
        self._validate(name, df, want)
        return self.memory.add(name, df, entry_point, want, order)

    def register(self, name: str, df: DataFrame, entry_point: str | None = None) -> None:
        """Facts that stay where they are: a table with an id column ``_fid``, read each time by what needs it."""
        name = self.kb.resolve(name)
        want = self.kb.schemas.get(name)
        self._validate(name, df, want)
        self.memory.register(name, self.memory.prepared(df, want, entry_point))

    def insert_rows(self, name: str, rows: list[dict], entry_point: str | None = None) -> DataFrame:
        want = self.kb.schemas[self.kb.resolve(name)]
        cells = [tuple(r.get(f.name) for f in want.fields) for r in rows]
        return self.insert(name, self.spark.createDataFrame(cells, want).coalesce(1), entry_point)

    def _validate(self, name: str, df: DataFrame, want: T.StructType | None) -> None:
        if self.validation == "none":
            return
        wrong = [] if want is not None else [f"type {name} is not declared"]
        for f in df.schema.fields:
            if want is not None and f.name in want.names:
                t = want[f.name].dataType
                if type(t) is not type(f.dataType) and not (scalar.is_number(t) and scalar.is_number(f.dataType)):
                    wrong.append(f"{name}.{f.name} is {f.dataType.simpleString()}, not {t.simpleString()}")
        if wrong and self.validation == "strict":
            raise RuleError("; ".join(wrong))
        for w in wrong:
            print(f"warning: {w}")

    def set_global(self, name: str, value) -> None:
        if name not in self.kb.program.globals:
            raise RuleError(f"no global {name!r}")
        self.idle, self.checked, self.upto, self.waiting = {}, {}, {}, {}
        self.globals[name] = value

    def facts(self, name: str) -> DataFrame:
        df = self.memory.types[self.kb.resolve(name)]
        return df.drop(FID, VERSION, ROUTE)

    def count(self, name: str | None = None) -> int:
        return sum(df.count() for n, df in self.memory.types.items() if name is None or n == self.kb.resolve(name))

    def retract(self, name: str, condition: Column) -> None:
        name = self.kb.resolve(name)
        self.memory.remove(name, self.memory.types[name].where(condition).select(FID))

    def reset(self) -> None:
        self.__init__(self.kb, self.spark, self.functions, self.validation, self.now)

    # --- queries

    def planner(self) -> Planner:
        def find(name: str, entry_point: str | None) -> DataFrame:
            name = self.kb.resolve(name)
            if name not in self.memory.types:
                raise PlanError(f"unknown type {name!r}")
            return self.memory.facts(name, entry_point)

        return Planner(self.spark, self.kb.program, find, self.globals, self.now, self.wall, self.kb.predicates, self.kb.aggregates, self.kb.allow_concat)

    def query(self, name: str, ids: bool = False, **params: DataFrame) -> DataFrame:
        self._settle_logical()
        return output(self.planner().query(name, **params), ids)

    # --- firing

    def reload(self, kb: KnowledgeBase) -> None:
        """Other rules over the facts that are there; matches of rules that kept their name stay fired."""
        self.kb = kb
        self._check_bindings()
        self.idle, self.checked, self.upto, self.waiting = {}, {}, {}, {}
        for name, schema in kb.schemas.items():
            self.memory.declare(name, schema)

    def listen(self, event: str, call: Callable[[str, int], None]) -> None:
        """``call(rule, n)`` when n matches of a rule are created, before they fire, after, or when they are retracted.

        Created are those that a round finds waiting; retracted those that are
        cancelled by another of their activation group, or whose logical facts go
        because they no longer hold.
        """
        if event not in ("created", "before", "after", "retracted"):
            raise RuleError(f"no event {event!r}")
        self.hooks.setdefault(event, []).append(call)

    def _tell(self, event: str, rule: str, n: int) -> None:
        for call in self.hooks.get(event, ()):
            call(rule, n)

    def set_focus(self, group: str) -> None:
        self.focus.append(group)

    def fire(self, max_rules: int = -1, exact: bool = False, isolate: bool = False) -> int:
        """Fires to the fixpoint; gives the number of matches fired.

        A match whose actions fail undoes its round and raises; with ``isolate`` it
        alone is undone, told in ``failures`` and done with, and the others go on.
        """
        total, self.halted, self.isolate = 0, False, isolate
        self.blocked, self.locked = {}, {}
        # What a rule may do again in another call: the others are idle until something that they read changes.
        self.idle = {k: v for k, v in self.idle.items() if k in self.kb.by_name and not (self.kb.by_name[k].no_loop or self.kb.by_name[k].lock_on_active)}
        groups_now = {r.agenda_group or MAIN for r in self.kb.rules}
        self._lock(groups_now)
        while max_rules < 0 or total < max_rules:
            n = self._round(None if max_rules < 0 else max_rules - total, exact)
            total += n
            if not n or self.halted:
                break
        self.focus = []
        self._settle_logical()
        return total

    def _lock(self, groups) -> None:
        """Lock-on-active: what is pending as the cycle starts may fire, what comes later may not."""
        for r in self.kb.rules:
            if r.lock_on_active:
                m = self._pending(r)
                self.locked[r.name] = settle(m.df.select("_key")) if m is not None else None

    def _order(self) -> list[S.Rule]:
        return sorted(self.kb.rules, key=lambda r: -(r.salience or 0))

    def _round(self, budget: int | None, exact: bool) -> int:
        for r in self._order():
            if r.auto_focus and r.agenda_group and r.agenda_group not in self.focus and self._some(r):
                self.focus.append(r.agenda_group)
        group = self.focus[-1] if self.focus else MAIN
        for r in self._order():
            if (r.agenda_group or MAIN) != group:
                continue
            begin, state = time.time(), self._state(r)
            if self.idle.get(r.name) == state:
                continue  # nothing that it reads has changed since it had nothing to do
            n = self._fire_rule(r, budget, exact)
            if not n:
                self.idle[r.name] = state
            else:
                self.stats.add(r.name, n, time.time() - begin)
                for listen in self.listeners:
                    listen("fired", r.name, n)
                self._settle_logical()
                return n
        return 0

    def _state(self, r: S.Rule) -> tuple:
        """What could give a rule new matches: gains of the types that it asks for, losses of those it denies."""
        seen = set()
        for g in r.groups:
            for p in g:
                seen.update((self.kb.resolve(t), wants, denies) for t, wants, denies in self._reads(p))
        types = self.memory.types
        return (self._clock(r), *sorted((t, types.gained.get(t, 0) if wants else -1, types.lost.get(t, 0) if denies else -1) for t, wants, denies in seen))

    def _clock(self, r: S.Rule):
        """The time as far as a rule reads it: through windows of time, which without an event time follow the wall clock."""
        timed = bool(r.duration) and self.now is not None or any(isinstance(x, S.Span) and x.kind == "time" for x in _parts([r.groups, [self.kb.program.queries[p.name] for g in r.groups for p in g if p.kind == "call"]]))
        return None if not timed else self.now if self.now is not None else time.time()

    def _reads(self, p: S.Pattern, denied: bool = False):
        """(type, whether more facts of it, whether fewer may make matches)."""
        if p.kind == "call":
            for q in self.kb.program.queries[p.name].patterns:
                yield from self._reads(q)
        for inner in p.inner:
            if p.kind == "forall":
                yield inner.type, True, True
            else:
                yield from self._reads(inner, p.kind == "not")
        if isinstance(p.source, S.Accumulate):
            yield p.source.source.type, True, True
        elif p.type and p.source is None:
            windowed = p.window is not None
            yield p.type, windowed or not denied, windowed or denied

    def _some(self, r: S.Rule) -> bool:
        m = self._pending(r)
        return m is not None and not m.df.isEmpty()

    def _matches(self, r: S.Rule) -> list[Match]:
        out = []
        for g in r.groups:
            m = self.planner().match(g)
            ids = [mangled(b, FID) for b in m.facts]
            vers = [mangled(b, VERSION) for b in m.facts]
            none = F.array().cast("array<bigint>")
            key = F.array(*[F.col(c) for c in ids]) if ids else none
            ver = F.array(*[F.col(c) for c in vers]) if vers else none
            m.df = m.df.withColumns({"_key": key, "_vers": ver, "_group": F.lit(len(out))})
            out.append(m)
        return out

    def _pending(self, r: S.Rule, index: int | None = None) -> Match | None:
        """Matches that have not fired; of rules with several groups, those of the first that has any."""
        for i, m in enumerate(self._matches(r)):
            df = self._ripe(r, m, m.df.withColumn("_group", F.lit(i)))
            mark = self.upto.get(r.name)
            if mark is not None and mark[1] == self._edits(r):
                # All that earlier facts make has fired: a match of now has a later fact.
                ids = [F.col(mangled(b, FID)) for b in m.facts]
                m.df, m.index = df.where((F.greatest(*ids) if len(ids) > 1 else ids[0]) >= mark[0]), i
                return m
            if r.name in self.lazy:
                self.lazy.discard(r.name)
                self.fired[r.name] = settle(self.fired[r.name])
            done = self.fired.get(r.name)
            if done is not None:
                df = df.join(done, ["_key", "_vers", "_group"], "left_anti")
            if r.no_loop and r.name in self.blocked:
                df = df.join(self.blocked[r.name], ["_key", "_group"], "left_anti")
            if self.locked.get(r.name) is not None:
                df = df.join(self.locked[r.name], ["_key"], "left_semi")
            m.df = df
            m.index = i
            if len(r.groups) == 1 or not df.isEmpty():
                return m
        return None

    def _edits(self, r: S.Rule) -> tuple | None:
        """Of a rule whose matches only come with new facts: how often its facts were changed in place.  None for others.

        Retractions take matches away and give none.
        """
        plain = all(p.kind == "eval" or p.kind == "fact" and p.source is None and p.window is None for g in r.groups for p in g)
        if not plain or len(r.groups) != 1 or r.no_loop or r.lock_on_active or r.activation_group or r.duration:
            return None
        kinds = {self.kb.resolve(p.type) for p in r.groups[0] if p.kind == "fact"}
        return tuple((k, self.memory.types.edited.get(k, 0)) for k in sorted(kinds)) or None

    def _ripe(self, r: S.Rule, m: Match, df: DataFrame) -> DataFrame:
        """Of a rule with a duration the matches that are as old by event time: since the latest of their facts.

        Without an event time, or facts with a timestamp, nothing is delayed.
        """
        stamps = [F.col(mangled(b, "timestamp")) for b in m.facts if mangled(b, "timestamp") in df.columns]
        if not r.duration or self.now is None or not stamps:
            return df
        born = F.greatest(*stamps) if len(stamps) > 1 else stamps[0]
        return df.where(born.isNull() | (born + r.duration <= self.now))

    def _one_each(self, r: S.Rule, m: Match, df: DataFrame) -> DataFrame:
        """Of matches that would cancel each other the latest has ``_nth`` 1; without such matches no column is added."""
        latest = [F.desc("_key")]
        inserts = {a.type for a in _actions(r.actions) if isinstance(a, S.Insert)}
        groups = []
        for p in r.groups[m.index]:
            inner = p.inner[0] if p.kind == "not" else None
            if inner is not None and self.kb.resolve(inner.type) in {self.kb.resolve(t) for t in inserts}:
                keys = [x.b for x in conjuncts(inner.test) if isinstance(x, S.Bin) and x.op == "==" and variables(x.b)]
                groups.append([m.scope.compile(k)[0] for k in keys])
        for var in dict.fromkeys(a.var for a in _actions(r.actions) if isinstance(a, (S.Update, S.Retract))):
            if var in m.facts and len(m.facts) > 1:
                groups.append([F.col(mangled(var, FID))])
        for i, cols in enumerate(groups):
            if i:
                df = df.where("_nth = 1").drop("_nth")
            if cols:
                df = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*cols).orderBy(*latest)))
            else:  # any of them cancels all others: the latest alone
                df = df.orderBy(*latest).limit(1).withColumn("_nth", F.lit(1))
        return df.withColumn("_cut", F.lit(True)) if len(groups) > 1 or any(not g for g in groups) else df

    def _mark(self, r: S.Rule) -> tuple:
        """Changes with whatever could give a rule matches or take them."""
        return self._state(r), self._losses(r)

    def _next_turns(self, r: S.Rule, budget: int) -> int:
        """Fires the next of the matches that wait for a budget, which nothing has changed since they were put in order."""
        q, state = self.waiting[r.name], self._state(r)
        n = min(budget, q.n - q.at)
        taken = q.df.where(F.col("_turn").between(q.at, q.at + n - 1)).withColumn("_turn", F.col("_turn") - q.at)
        self._apply(r, q.match, taken, n)
        self._turned(r, q, n, state)
        return n

    def _turned(self, r: S.Rule, q: Queue, n: int, state: tuple) -> None:
        q = replace(q, at=q.at + n)
        self.fired[r.name] = q.fired()
        self.upto.pop(r.name, None)
        if q.at < q.n:
            self.waiting[r.name] = q
            return
        del self.waiting[r.name]
        self.fired[r.name] = settle(self.fired[r.name])
        self.idle[r.name] = state

    def fire_slices(self, budget: int, most: int) -> tuple[str, int, int] | None:
        """What ``fire(budget)`` would do up to ``most`` times, in one job: the type of the new facts, the first one's id, how many budgets.

        Only where each of those calls would fire the next ``budget`` matches that
        wait for one rule, and nothing else: the rule only inserts, no rule reads the
        type, those before it have nothing to do.  The ids of new facts follow the
        order of their matches, without gaps.  None, and nothing done, otherwise.
        """
        rules = self._order()
        r = next((x for x in rules if self.idle.get(x.name) != self._state(x)), None)
        q = self.waiting.get(r.name) if r is not None else None
        if q is None or q.mark != self._mark(r) or self.hooks or self.listeners or self.logical or self.focus:
            return None
        if any(x.no_loop or x.lock_on_active or x.auto_focus or x.agenda_group for x in rules):
            return None
        kind = self.kb.resolve(r.actions[0].type)
        if kind in {self.kb.resolve(t) for x in rules for g in x.groups for p in g for t, _, _ in self._reads(p)}:
            return None
        times, begin = min(most, (q.n - q.at) // budget), time.time()
        if times < 2:
            return None
        state = self._state(r)
        taken = q.df.where(F.col("_turn").between(q.at, q.at + times * budget - 1)).withColumn("_turn", F.col("_turn") - q.at)
        self.memory.read_ids()
        first = self.memory.next_id
        self.isolate = False
        self._apply(r, q.match, taken, times * budget)
        self._turned(r, q, times * budget, state)
        self.stats.add(r.name, times * budget, time.time() - begin)
        return kind, first, times

    def _fire_rule(self, r: S.Rule, budget: int | None, exact: bool) -> int:
        queue = self.waiting.get(r.name)
        if queue is not None:
            if budget is not None and not exact and not self.hooks and queue.mark == self._mark(r):
                return self._next_turns(r, budget)
            del self.waiting[r.name]
        edits = self._edits(r)
        if edits is not None:
            self.memory.read_ids()
        begin = self.memory.next_id, edits
        m, state = self._pending(r), self._state(r)
        if m is None:
            return 0
        df = self._one_each(r, m, m.df)
        cut = "_cut" in df.columns
        nth = F.col("_nth") == 1 if "_nth" in df.columns else F.lit(True)
        single = r.activation_group or exact or any(isinstance(a, (S.Halt, S.Focus)) for a in _actions(r.actions))
        whole = not cut and len(r.groups) == 1 and not single
        if single:
            df = df.where(nth).orderBy(F.desc("_key")).limit(1)
        if whole and df is m.df and not self.hooks and r.name not in self.fired and _plain_insert(r.actions):
            n = self._fire_insert(r, m, state, budget)
            if n is not None:
                self._all_fired(r, begin)
                return n
        taken, found = measured(df.select(*self._used(r, m, df), nth.alias("_first")), n=F.count_if("_first"), all=F.count(F.lit(1)))
        taken, n = taken.where("_first").drop("_first"), found["n"]
        if not n:
            if not single:
                self._all_fired(r, begin)
            return 0
        whole = whole and n == found["all"]  # none waits for what these do
        self._tell("created", r.name, n)
        if budget is not None and n > budget and whole and edits is not None and not self.hooks and _plain_insert(r.actions):
            # Put in order once: what waits is not found again for each budget.
            self.waiting[r.name] = Queue((state, self._losses(r)), m, ranked(taken, F.desc("_key")), 0, n, self.fired.get(r.name))
            return self._next_turns(r, budget)
        if budget is not None and n > budget:  # the latest matches; the others wait
            taken, n, whole = settle(taken.orderBy(F.desc("_key")).limit(min(budget, 2**31 - 1))), budget, False
        self._tell("before", r.name, n)
        self._apply(r, m, taken, n)
        keys = taken.select("_key", "_vers", "_group")
        self._remember(self.fired, r.name, keys)
        if whole:  # all that it could do until what it reads changes
            self.idle[r.name] = state
            self._all_fired(r, begin)
        else:
            self.upto.pop(r.name, None)
        if r.no_loop:
            self._remember(self.blocked, r.name, keys.select("_key", "_group"))
        self._tell("after", r.name, n)
        if r.activation_group:
            for other in self.kb.rules:
                if other.activation_group == r.activation_group:
                    left = self._pending(other)
                    if left is not None:  # what waits is cancelled for good
                        gone, found = measured(left.df.select("_key", "_vers", "_group"), n=F.count(F.lit(1)))
                        self._remember(self.fired, other.name, gone)
                        if found["n"]:
                            self._tell("retracted", other.name, found["n"])
        return n

    def _apply(self, r: S.Rule, m: Match, taken: DataFrame, n: int, depth: int = 0) -> None:
        """Runs the actions on n matches, all of them or, if one fails, none; to isolate that one the rest is tried by halves."""
        before = self._saved()
        try:
            Effects(self, r, replace_df(m, taken)).run(r.actions)
        except Exception as e:
            self._restore(before)  # nothing of the round stays
            if not self.isolate or isinstance(e, (PlanError, scalar.ExpressionError)):
                raise RuleError(f"rule {r.name!r}: {e}") from e
            if n == 1:
                self.failures.append((r.name, str(e).splitlines()[0]))
                return
            for side in (0, 1):
                half, found = measured(taken.where(F.pmod(F.xxhash64("_key", "_group", F.lit(depth)), F.lit(2)) == side), n=F.count(F.lit(1)))
                if found["n"]:
                    self._apply(r, m, half, found["n"], depth + 1)

    def _fire_insert(self, r: S.Rule, m: Match, state: tuple, budget: int | None) -> int | None:
        """All matches of a rule that only inserts one fact each, in one job: the matches themselves are not written.

        None, and nothing changed, if they are more than the budget.
        Which have fired is remembered as the plan that found them, over tables that
        do not change; it is written if the rule comes to be asked again.
        """
        before = self._saved()
        try:
            Effects(self, r, m).run(r.actions)
        except Exception as e:
            self._restore(before)
            if self.isolate and not isinstance(e, (PlanError, scalar.ExpressionError)):
                return None  # the way that writes the matches finds the one that fails
            raise RuleError(f"rule {r.name!r}: {e}") from e
        n = self.memory.added
        if budget is not None and n > budget:
            self._restore(before)
            return None
        if n:
            keys = m.df.select("_key", "_vers", "_group")
            self._remember(self.fired, r.name, keys)
            self.lazy.add(r.name)
            self.idle[r.name] = state
            if r.no_loop:
                self._remember(self.blocked, r.name, keys.select("_key", "_group"))
        return n

    def _all_fired(self, r: S.Rule, begin: tuple) -> None:
        """Nothing that the facts before ``begin`` make is left to fire."""
        if begin[1] is not None:
            self.upto[r.name] = begin

    def _saved(self) -> tuple:
        return dict(self.memory.types), self.memory.next_id, list(self.logical)

    def _restore(self, saved: tuple) -> None:
        self.memory.types.restore(saved[0])
        self.memory.next_id, self.logical = saved[1:]

    def _used(self, r: S.Rule, m: Match, df: DataFrame) -> list[str]:
        """The columns of matches that the actions read: the others are not written."""
        keep, whole = {"_key", "_vers", "_group"}, set()
        for x in _parts(r.actions):
            if isinstance(x, S.Ref) and x.var:
                if x.var in m.scope.origins:
                    keep.add(m.scope.origins[x.var])
                elif x.steps:
                    keep.add(mangled(x.var, x.steps[0]))
                else:
                    keep |= {mangled(x.var, FID), mangled(x.var, "result")}
            elif isinstance(x, (S.Update, S.Retract)):
                keep.add(mangled(x.var, FID))
                if isinstance(x, S.Update):
                    keep |= {mangled(x.var, f) for f in x.fields}
        return [c for c in df.columns if c in keep or c in whole]

    def _remember(self, table: dict, name: str, keys: DataFrame) -> None:
        known = table.get(name)
        if known is None:
            table[name] = keys
            return
        place = (id(table), name)
        self.parts[place] = self.parts.get(place, 1) + 1
        table[name] = known.unionByName(keys)
        if self.parts[place] % MERGE == 0:
            table[name] = settle(self._alive(name, table[name]))  # many small parts become one table

    def _alive(self, name: str, keys: DataFrame) -> DataFrame:
        """Without matches of facts that are gone for good, as far as ids tell: those below every id that is left."""
        kinds = {self.kb.resolve(p.type) for g in self.kb.by_name[name].groups for p in g if p.kind == "fact" and p.source is None}
        lows = [self.memory.types[k].agg(F.min(FID)).first()[0] for k in sorted(kinds)]  # one row for each type of the rule
        if not lows or any(x is None for x in lows):
            return keys
        return keys.where(F.coalesce(F.array_min("_key") >= min(lows), F.lit(True)))

    # --- truth maintenance

    def justify(self, r: S.Rule, kind: str, index: int, facts: DataFrame) -> None:
        """``facts``: (_fid, _key) of logical facts that a rule's matches support."""
        for i, (name, k, x, known) in enumerate(self.logical):
            if (name, k, x) == (r.name, kind, index):  # one table for each rule, type and group
                self.logical[i] = (name, k, x, known.unionByName(facts))
                return
        self.logical.append((r.name, kind, index, facts))

    def _losses(self, r: S.Rule) -> tuple:
        """What could take matches from a rule: losses of the types that it asks for, gains of those it denies."""
        types, seen = self.memory.types, set()
        for g in r.groups:
            for p in g:
                seen.update((self.kb.resolve(t), wants, denies) for t, wants, denies in self._reads(p))
        return (self._clock(r), *sorted((t, types.lost.get(t, 0) if wants else -1, types.gained.get(t, 0) if denies else -1) for t, wants, denies in seen))

    def _settle_logical(self) -> None:
        """Retracts logical facts whose match is gone, until none is left to go.

        A rule is asked again only if something that it reads has changed so that
        matches can go.
        """
        changed = True
        while changed and self.logical:
            changed, kept = False, []
            for name, kind, index, facts in self.logical:
                rule = self.kb.by_name.get(name)
                if rule is None or index >= len(rule.groups):  # reloaded without it: its facts have no reason any more
                    changed = True
                    self.memory.remove(kind, facts.select(FID))
                    continue
                state = self._losses(rule)
                if self.checked.get((name, kind, index)) == state:
                    kept.append((name, kind, index, facts))
                    continue
                holds = self._matches(rule)[index].df.select("_key").distinct()
                gone, found = measured(facts.join(holds, "_key", "left_anti").select(FID), n=F.count(F.lit(1)))
                self.checked[name, kind, index] = state
                if not found["n"]:
                    kept.append((name, kind, index, facts))
                    continue
                changed = True
                self._tell("retracted", name, found["n"])
                self.memory.remove(kind, gone)
                lost = gone.withColumnRenamed(FID, "_gone")
                kept.append((name, kind, index, settle(facts.join(lost, facts[FID] == lost["_gone"], "left_anti"))))
                if name in self.fired:  # a match that comes back fires anew
                    self.fired[name] = settle(self.fired[name].join(holds, "_key", "left_semi"))
                    self.lazy.discard(name)
            self.logical = kept


def _plain_insert(actions: list) -> bool:
    return len(actions) == 1 and isinstance(actions[0], S.Insert) and not actions[0].logical


def replace_df(m: Match, df: DataFrame) -> Match:
    out = Match(df, m.scope, m.facts, m.shown)
    out.index = m.index
    return out


def _parts(x):
    """Every node of actions and their expressions."""
    if isinstance(x, (list, tuple)):
        for y in x:
            yield from _parts(y)
    elif isinstance(x, dict):
        yield from _parts(list(x.values()))
    elif is_dataclass(x):
        yield x
        for f in fields_of(x):
            yield from _parts(getattr(x, f.name))


def _actions(body: list):
    for a in body:
        yield a
        if isinstance(a, S.If):
            for _, b in a.branches:
                yield from _actions(b)
            yield from _actions(a.otherwise)
        elif isinstance(a, S.Switch):
            for _, b in a.cases:
                yield from _actions(b)
            yield from _actions(a.default)
        elif isinstance(a, (S.For, S.While)):
            yield from _actions(a.body)


class Effects:
    """Runs a rule's actions on all rows of its matches; ``df`` carries each row's view of its facts."""

    def __init__(self, session: Session, rule: S.Rule, m: Match):
        self.s, self.rule, self.m = session, rule, m
        self.scope: Scope = m.scope.child(strict=True)
        self.types = self._types()

    def _types(self) -> dict[str, str]:
        return {p.binding: self.s.kb.resolve(p.type) for p in self.rule.groups[self.m.index] if p.binding and p.kind == "fact" and p.source is None}

    def run(self, body: list) -> None:
        self._block(body, self.m.df, self.scope)

    def _block(self, body: list, df: DataFrame, scope: Scope) -> DataFrame:
        for i, a in enumerate(body):
            if isinstance(a, S.Jump):
                return df
            jump = _guarded_jump(a)
            if jump is not None:
                raise PlanError(f"'{jump}' belongs directly in the body of a for")
            df = getattr(self, f"_{type(a).__name__.lower()}")(a, df, scope)
        return df

    # --- changes

    def _insert(self, a: S.Insert, df: DataFrame, scope: Scope) -> DataFrame:
        kind = self.s.kb.resolve(a.type)
        want = self.s.kb.schemas.get(kind)
        if want is None:
            raise PlanError(f"unknown type {a.type!r}")
        cols = []
        for f in want.fields:
            if f.name in a.fields:
                c, t = scope.compile(a.fields[f.name])
                cols.append(_coerced(c, t, f.dataType).alias(f.name))
        extra = set(a.fields) - set(want.names)
        if extra:
            raise PlanError(f"{a.type} has no field {', '.join(sorted(extra))}")
        if "_turn" in df.columns:
            self.s.memory.read_ids()
            cols.append((F.col("_turn") + self.s.memory.next_id).alias(FID))
        rows = df.select(*cols, F.col("_key").alias("_just"))
        if not a.logical:
            self.s.memory.add(kind, rows.drop("_just"), None, want)
            return df
        plan = self.s.memory.prepared(rows, T.StructType([*want.fields, T.StructField("_just", T.ArrayType(T.LongType()))]), None)
        new, found = measured(plan, n=F.count(F.lit(1)), top=F.max(FID))
        new = self.s.memory.take(kind, new, found["n"], found["top"], "_just")
        self.s.justify(self.rule, kind, self.m.index, new.select(FID, F.col("_just").alias("_key")))
        return df

    def _changes(self, a: S.Update, scope: Scope) -> dict[str, Column]:
        kind = self._type_of(a.var)
        schema, new = self.s.memory.types[kind].schema, {}
        for f, x in a.fields.items():
            if f not in schema.names:
                raise PlanError(f"{kind} has no field {f!r}")
            c, t = scope.compile(x)
            new[f] = _coerced(c, t, schema[f].dataType)
        return new

    def _write_back(self, var: str, fields: list[str], df: DataFrame) -> None:
        """Of matches that changed one fact the latest counts."""
        fid = mangled(var, FID)
        last = Window.partitionBy(fid).orderBy(F.desc("_key"))
        rows = df.withColumn("_n", F.row_number().over(last)).where("_n = 1")
        self.s.memory.update(self._type_of(var), rows.select(F.col(fid).alias(FID), *[F.col(mangled(var, f)).alias(f) for f in fields], *[F.lit(True).alias(f"_set_{f}") for f in fields]))

    def _update(self, a: S.Update, df: DataFrame, scope: Scope) -> DataFrame:
        new = self._changes(a, scope)
        df = df.withColumns({mangled(a.var, f): c for f, c in new.items()})
        self._write_back(a.var, list(new), df)
        return settle(df)

    def _retract(self, a: S.Retract, df: DataFrame, scope: Scope) -> DataFrame:
        self.s.memory.remove(self._type_of(a.var), df.select(mangled(a.var, FID)))
        return df

    def _type_of(self, var: str) -> str:
        if var not in self.types:
            raise PlanError(f"{var} is no fact of a pattern")
        return self.types[var]

    # --- control

    def _halt(self, a, df: DataFrame, scope: Scope) -> DataFrame:
        if not df.isEmpty():
            self.s.halted = True
        return df

    def _focus(self, a: S.Focus, df: DataFrame, scope: Scope) -> DataFrame:
        if not df.isEmpty():
            self.s.focus.append(a.group)
        return df

    def _branches(self, df: DataFrame, tests: list[tuple[Column, list]], otherwise: list, scope: Scope) -> DataFrame:
        """Each row runs the body of its first true test."""
        which = F.lit(len(tests))
        for i, (test, _) in reversed(list(enumerate(tests))):
            which = F.when(test, i).otherwise(which)
        df = settle(df.withColumn("_branch", which))
        parts = []
        for i, body in enumerate([b for _, b in tests] + [otherwise]):
            part = df.where(F.col("_branch") == i).drop("_branch")
            parts.append(self._block(body, part, scope) if body else part)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def _if(self, a: S.If, df: DataFrame, scope: Scope) -> DataFrame:
        return self._branches(df, [(scalar.truthy(*scope.compile(t)), body) for t, body in a.branches], a.otherwise, scope)

    def _switch(self, a: S.Switch, df: DataFrame, scope: Scope) -> DataFrame:
        x = scope.compile(a.x)
        return self._branches(df, [(F.coalesce(scalar.compare("==", *x, *scope.compile(v)), F.lit(False)), body) for v, body in a.cases], a.default, scope)

    def _for(self, a: S.For, df: DataFrame, scope: Scope) -> DataFrame:
        if isinstance(a.source, list):
            cells = [scope.compile(r) for r in a.source]
            items, kind = F.array(*[c for c, _ in cells]), cells[0][1]
        else:
            items, kind = scope.compile(a.source)
            if not isinstance(kind, T.ArrayType):
                raise PlanError("for takes a list")
            kind = kind.elementType
        inner = scope.child()
        body, keep = [], F.lit(True)
        for step in a.body:
            jump = _guarded_jump(step)
            if jump is None:
                body.append((keep, step))
                continue
            test = step.branches[0][0]
            if jump == "continue":
                body.append((test, None))
            else:
                body.append(("break", test))
        rows = df.select("*", F.posexplode(items).alias("_pos", "_item")).where(F.col("_item").isNotNull())
        if isinstance(kind, T.StructType):
            inner.bindings[a.var] = kind
            rows = rows.select(*[c for c in rows.columns if c != "_item"], *[F.col("_item").getField(n).alias(mangled(a.var, n)) for n in kind.names])
        else:
            inner.names[a.var] = (F.col(mangled(a.var, "item")), kind)
            inner.bindings[a.var] = T.StructType([T.StructField("value", kind)])
            rows = rows.withColumn(mangled(a.var, "item"), F.col("_item")).withColumn(mangled(a.var, "value"), F.col("_item")).drop("_item")
            inner.names.pop(a.var)
            inner.names[a.var] = (F.col(mangled(a.var, "item")), kind)
        for mark, step in body:
            if isinstance(mark, str):
                stop = F.min(F.when(scalar.truthy(*inner.compile(step)), F.col("_pos"))).over(Window.partitionBy("_key"))
                rows = rows.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("_pos") < F.col("_stop"))).drop("_stop")
            elif step is None:
                rows = rows.where(~scalar.truthy(*inner.compile(mark)))
            else:
                if isinstance(step, S.Jump):
                    break
                rows = self._block([step], rows, inner)
        return df

    def _while(self, a: S.While, df: DataFrame, scope: Scope) -> DataFrame:
        if a.body and all(isinstance(x, S.Update) for x in a.body):
            return self._while_updates(a, df, scope)
        done = None
        for _ in range(WHILE_CAP + 1):
            df = settle(df.withColumn("_go", scalar.truthy(*scope.compile(a.test))))
            out, df = df.where(~F.col("_go")).drop("_go"), df.where("_go").drop("_go")
            done = out if done is None else done.unionByName(out)
            if df.isEmpty():
                return done
            df = self._block(a.body, df, scope)
        raise RuleError(f"while ran more than {WHILE_CAP} times")

    def _while_updates(self, a: S.While, df: DataFrame, scope: Scope) -> DataFrame:
        """A loop of updates alone works on the matches' own columns, UNROLL turns a job; memory changes once, at its end."""
        touched: dict[str, set[str]] = {}
        turns = 0
        while True:
            for _ in range(min(UNROLL, WHILE_CAP + 1 - turns)):
                turns += 1
                df = df.withColumn("_go", scalar.truthy(*scope.compile(a.test)))
                for x in a.body:
                    new = self._changes(x, scope)
                    touched.setdefault(x.var, set()).update(new)
                    df = df.withColumns({mangled(x.var, f): F.when(F.col("_go"), c).otherwise(F.col(mangled(x.var, f))) for f, c in new.items()})
            df, found = measured(df.withColumn("_go", scalar.truthy(*scope.compile(a.test))), n=F.count_if("_go"))
            df = df.drop("_go")
            if not found["n"]:
                break
            if turns > WHILE_CAP:
                raise RuleError(f"while ran more than {WHILE_CAP} times")
        for var, fields in touched.items():
            self._write_back(var, sorted(fields), df)
        return df

    def _call(self, a: S.Call, df: DataFrame, scope: Scope) -> DataFrame:
        if a.name not in self.s.functions:
            raise PlanError(f"no function {a.name!r}")
        out = df.withColumn("_out", self.s.functions[a.name](*[scope.compile(x)[0] for x in a.args]))
        if a.into is None:
            return settle(out).drop("_out")
        kind = out.schema["_out"].dataType
        if isinstance(kind, T.StructType):
            scope.bindings[a.into] = kind
            out = out.select(*df.columns, *[F.col("_out").getField(n).alias(mangled(a.into, n)) for n in kind.names])
        else:
            out = out.withColumnRenamed("_out", mangled(a.into, "value"))
            scope.names[a.into] = (F.col(mangled(a.into, "value")), kind)
        return settle(out)


def _guarded_jump(a) -> str | None:
    """``if test { break }``: what a for does by filters."""
    if isinstance(a, S.If) and len(a.branches) == 1 and not a.otherwise and len(a.branches[0][1]) == 1 and isinstance(a.branches[0][1][0], S.Jump):
        return a.branches[0][1][0].kind
    return None


def _coerced(c: Column, t: T.DataType, want: T.DataType) -> Column:
    """Whole doubles may go to whole fields, whole numbers to doubles; other kinds raise."""
    if isinstance(t, T.NullType) or type(t) is type(want):
        return c.cast(want)
    if scalar.is_whole(want) and isinstance(t, T.DoubleType):
        return F.when(c == F.floor(c), c.cast(want)).when(c.isNotNull(), F.raise_error(F.lit("a fraction for a whole field")).cast(want))
    if scalar.is_number(t) and scalar.is_number(want):
        return c.cast(want)
    if isinstance(want, T.StringType) and isinstance(t, (T.DateType, T.TimestampType)):
        return c.cast(want)
    raise PlanError(f"{t.simpleString()} for {want.simpleString()}")
