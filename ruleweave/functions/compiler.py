"""Syntax trees of expressions to columns, by the types of what they refer to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang import syntax as S
from . import scalar

FID = "_fid"
RESULT_FIELDS = ("result", "intValue", "longValue", "doubleValue", "floatValue", "value")


def mangled(binding: str, name: str) -> str:
    """The column that holds a field of a bound fact."""
    return f"{binding.lstrip('$')}__{name}"


@dataclass
class Scope:
    """What names mean: bindings to their fields' types, $names of fields, globals, and the pattern at hand."""

    bindings: dict[str, T.StructType] = field(default_factory=dict)
    names: dict[str, tuple[Column, T.DataType]] = field(default_factory=dict)
    globals: dict[str, Any] = field(default_factory=dict)
    here: str | None = None
    strict: bool = False
    udfs: dict[str, Callable] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)
    concat: bool = False
    origins: dict[str, str] = field(default_factory=dict)
    #: Expressions that are columns already, by their text; not for children, which may be strict.
    ready: dict[str, tuple[Column, T.DataType]] = field(default_factory=dict)

    def child(self, **changes) -> Scope:
        out = Scope(dict(self.bindings), dict(self.names), self.globals, self.here, self.strict, self.udfs, self.enums, self.concat, dict(self.origins))
        for k, v in changes.items():
            setattr(out, k, v)
        return out

    # --- references

    def resolve(self, ref: S.Ref) -> tuple[Column, T.DataType]:
        steps = list(ref.steps)
        if ref.var is None:
            name = steps[0]
            if self.here is not None and (name in self.bindings[self.here].names or name == "this"):
                return self._walk(*self._field(self.here, steps[0]), steps[1:])
            if name in self.globals:
                return self._walk(*self._literal(self.globals[name]), steps[1:])
            for values in self.enums.values():
                if name in values and len(steps) == 1:
                    return F.lit(name), T.StringType()
            raise scalar.ExpressionError(f"unknown field {name!r}" + self._hint(name))
        if ref.var in self.names:
            return self._walk(*self.names[ref.var], steps)
        if ref.var in self.bindings:
            kind = self.bindings[ref.var]
            if not steps:
                if "result" in kind.names:
                    return self._field(ref.var, "result")
                return self._field(ref.var, "this")
            return self._walk(*self._field(ref.var, steps[0]), steps[1:])
        if ref.var.lstrip("$") in self.globals:
            return self._walk(*self._literal(self.globals[ref.var.lstrip("$")]), steps)
        raise scalar.ExpressionError(f"unknown name {ref.var}")

    def _hint(self, name: str) -> str:
        import difflib

        known = list(self.bindings[self.here].names) if self.here else []
        near = difflib.get_close_matches(name, known, 1)
        return f"; did you mean {near[0]!r}?" if near else ""

    def _field(self, binding: str, name: str) -> tuple[Column, T.DataType]:
        kind = self.bindings[binding]
        if name == "this":
            return F.col(mangled(binding, FID)), T.LongType()
        if name not in kind.names:
            raise scalar.ExpressionError(f"{binding} has no field {name!r}")
        return F.col(mangled(binding, name)), kind[name].dataType

    def _literal(self, value: Any) -> tuple[Column, T.DataType]:
        if isinstance(value, Column):
            raise scalar.ExpressionError("globals are values, not columns")
        if isinstance(value, bool):
            return F.lit(value), T.BooleanType()
        if isinstance(value, int):
            return F.lit(value).cast("long"), T.LongType()
        if isinstance(value, float):
            return F.lit(value), T.DoubleType()
        if value is None:
            return F.lit(None), T.NullType()
        if isinstance(value, (list, set, tuple)):
            items = sorted(value) if isinstance(value, set) else list(value)
            cells = [self._literal(v) for v in items]
            t = cells[0][1] if cells else T.StringType()
            return F.array(*[c for c, _ in cells]).cast(T.ArrayType(t)), T.ArrayType(t)
        if isinstance(value, dict):
            pairs = [(self._literal(k), self._literal(v)) for k, v in value.items()]
            t = T.MapType(pairs[0][0][1], pairs[0][1][1]) if pairs else T.MapType(T.StringType(), T.StringType())
            return F.create_map(*[x for (k, _), (v, _) in pairs for x in (k, v)]).cast(t), t
        return F.lit(str(value)), T.StringType()

    def _walk(self, col: Column, t: T.DataType, steps: list) -> tuple[Column, T.DataType]:
        for step in steps:
            if step == "size" and isinstance(t, (T.ArrayType, T.MapType)):
                col, t = F.when(col.isNotNull(), F.size(col)).cast("long"), T.LongType()
            elif step == "isEmpty" and isinstance(t, (T.ArrayType, T.MapType)):
                col, t = F.when(col.isNotNull(), (F.size(col) == 0).cast("long")), T.LongType()
            elif isinstance(t, T.StructType) and isinstance(step, str):
                if step not in t.names:
                    raise scalar.ExpressionError(f"no field {step!r}")
                col, t = col.getField(step), t[step].dataType
            elif isinstance(t, T.ArrayType) and isinstance(step, int):
                col, t = F.try_element_at(col, F.lit(step + 1 if step >= 0 else step)), t.elementType
            elif isinstance(t, T.ArrayType) and isinstance(step, tuple) and isinstance(t.elementType, T.StructType):
                key = step[1]
                col, t = F.try_element_at(F.filter(col, _has_key(key)), F.lit(1)), t.elementType
            elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType) and isinstance(step, str):
                one = F.when(F.size(col) == 1, F.try_element_at(col, F.lit(1)))
                col, t = one.getField(step), t.elementType[step].dataType
            elif isinstance(t, T.MapType):
                key = step[1] if isinstance(step, tuple) else step
                col, t = F.try_element_at(col, F.lit(key)), t.valueType
            elif isinstance(t, T.StringType) and isinstance(step, int):
                at = F.lit(step + 1) if step >= 0 else F.octet_length(col) + step + 1
                byte = F.substring(F.encode(col, "UTF-8"), at, F.lit(1))
                col, t = F.when(F.octet_length(col) > (step if step >= 0 else -step - 1), byte.cast("string")), T.StringType()
            else:
                raise scalar.ExpressionError(f"cannot take {step!r} of {t.simpleString()}")
        return col, t

    # --- expressions

    def compile(self, x) -> tuple[Column, T.DataType]:
        if isinstance(x, S.Lit):
            return self._literal(x.value)
        if isinstance(x, S.Ref):
            return self.resolve(x)
        if isinstance(x, S.Bind):
            ref = self.resolve(x.ref)
            self.names[x.var] = ref
            if self.here is not None and x.ref.var is None:
                self.origins[x.var] = mangled(self.here, FID if x.ref.steps[0] == "this" else x.ref.steps[0])
            return self.compile(x.test) if x.test is not None else (F.lit(True), T.BooleanType())
        if isinstance(x, S.Un):
            return self._unary(x)
        if isinstance(x, S.In):
            cells = [scalar.compare("==", *self.compile(x.x), *self.compile(v)) for v in x.values]
            out = cells[0]
            for c in cells[1:]:
                out = out | c
            known = self.compile(x.x)[0].isNotNull()
            return (known & ~F.coalesce(out, F.lit(False))) if x.negated else out, T.BooleanType()
        if isinstance(x, S.Within):
            here = self.resolve(S.Ref(None, ("timestamp",)))[0]
            there = self.resolve(S.Ref(x.var, ("timestamp",)))[0]
            return F.abs(here - there) <= x.ms, T.BooleanType()
        if isinstance(x, S.Fn):
            return self.ready[repr(x)] if self.ready and repr(x) in self.ready else self._call(x)
        return self._binary(x)

    def _unary(self, x: S.Un):
        c, t = self.compile(x.x)
        if x.op == "!":
            return (~c if isinstance(t, T.BooleanType) else ~scalar.truthy(c, t)), T.BooleanType()
        if not scalar.is_number(t):
            raise scalar.ExpressionError(f"'{x.op}' takes a number")
        kind = T.LongType() if scalar.is_whole(t) else T.DoubleType()
        return (-c.cast(kind) if x.op == "-" else c), kind

    def _call(self, x: S.Fn):
        if x.name == "pi":
            return F.lit(scalar.PI), T.DoubleType()
        if x.name == "has_flag":
            return scalar.has_flag(*[self.compile(a)[0] for a in x.args]), T.BooleanType()
        if x.name in self.udfs:
            return self.udfs[x.name](*[self.compile(a)[0] for a in x.args]), T.BooleanType()
        args = [self.compile(a) for a in x.args]
        for (_, t), a in zip(args, x.args):
            if not scalar.is_number(t) and not isinstance(t, T.NullType):
                raise scalar.ExpressionError(f"{x.name} takes numbers")
        if x.name in scalar.UNARY and len(args) == 1:
            return scalar.unary(x.name, args[0][0], self.strict), T.DoubleType()
        if x.name in scalar.BINARY and len(args) == 2:
            return scalar.binary(x.name, args[0][0], args[1][0], self.strict), T.DoubleType()
        raise scalar.ExpressionError(f"no function {x.name} of {len(args)} arguments")

    def _binary(self, x: S.Bin):
        if x.op in ("&&", "||"):
            a, b = self.condition(x.a), self.condition(x.b)
            return (a & b if x.op == "&&" else a | b), T.BooleanType()
        a, ta = self.compile(x.a)
        b, tb = self.compile(x.b)
        if x.op in "+-*/":
            if x.op == "+" and self.concat and (isinstance(ta, T.StringType) or isinstance(tb, T.StringType)):
                return F.concat(a.cast("string"), b.cast("string")), T.StringType()
            return scalar.arithmetic(x.op, a, ta, b, tb, self.strict)
        if x.op in ("==", "!=", "<", "<=", ">", ">="):
            return scalar.compare(x.op, a, ta, b, tb), T.BooleanType()
        if x.op in ("after", "before", "coincides", "during"):
            return {"after": a > b, "before": a < b, "coincides": a == b, "during": a >= b}[x.op], T.BooleanType()
        return scalar.word_test(x.op, a, ta, b, tb), T.BooleanType()

    def condition(self, x) -> Column:
        """``x`` as a filter: booleans keep their nulls (no match), other kinds by their truth."""
        c, t = self.compile(x)
        return c if isinstance(t, T.BooleanType) else scalar.truthy(c, t)


def _has_key(key: str):
    return lambda e: e.getField("key") == key


def conjuncts(x) -> list:
    """The parts of a conjunction."""
    if x is None:
        return []
    if isinstance(x, S.Bin) and x.op == "&&":
        return conjuncts(x.a) + conjuncts(x.b)
    return [x]


def variables(x) -> set[str]:
    """The $names that an expression uses."""
    if isinstance(x, S.Ref):
        return {x.var} if x.var else set()
    if isinstance(x, S.Bind):
        return variables(x.ref) | variables(x.test)
    if isinstance(x, S.Within):
        return {x.var}
    if isinstance(x, S.Un):
        return variables(x.x)
    if isinstance(x, S.Bin):
        return variables(x.a) | variables(x.b)
    if isinstance(x, S.Fn):
        return set().union(*map(variables, x.args)) if x.args else set()
    if isinstance(x, S.In):
        return variables(x.x).union(*map(variables, x.values))
    return set()


def binds(x) -> list[S.Bind]:
    if isinstance(x, S.Bind):
        return [x]
    if isinstance(x, S.Bin):
        return binds(x.a) + binds(x.b)
    return []
