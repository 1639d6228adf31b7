"""The scalar functions and operators of the rule language, as Spark columns.

All of them stay in generated code.  With ``strict`` (the default in rule
consequences) a result that is not finite raises, as the language asks;
otherwise it is null and so no match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNARY = {
    "floor": F.floor,
    "ceil": F.ceil,
    "abs": F.abs,
    "round": lambda x: F.round(x, 0),
    "sqrt": F.sqrt,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "acos": F.acos,
    "asin": F.asin,
    "atan": F.atan,
    "log": F.ln,
    "exp": F.exp,
}


def _least(a: Column, b: Column) -> Column:
    """The lesser number, null if either is null: nulls sort first."""
    return F.sort_array(F.array(a, b)).getItem(0)


def _greatest(a: Column, b: Column) -> Column:
    """The greater number, null if either is null; what is not a number counts as infinite."""
    top = F.lit(float("inf"))
    return -_least(-F.nanvl(a, top), -F.nanvl(b, top))


BINARY = {"min": _least, "max": _greatest, "pow": F.pow, "fmod": F.try_mod}
REMOVED = ("concat", "to_upper", "to_lower")


class ExpressionError(ValueError):
    pass


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_whole(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def finite(x: Column, strict: bool, what: str) -> Column:
    """``x``, or the fallback.  Names ``x`` once, as nested expressions would else double at each level."""
    fallback = F.raise_error(F.lit(f"{what} is not finite")).cast("double") if strict else F.lit(None).cast("double")
    return F.nanvl(x % F.lit(float("inf")), fallback)  # finite numbers stay as they are, infinite ones become NaN


def unary(name: str, x: Column, strict: bool = False) -> Column:
    """A function of one double: the result is a double, also of floor, ceil and round (halves away from zero)."""
    given = x.cast("double")
    out = UNARY[name](given).cast("double")
    if strict and name == "log":
        out = F.coalesce(out, F.when(given.isNotNull(), F.lit(float("nan"))))  # ln(0) and its like give null
    return finite(out, strict, name)


def binary(name: str, a: Column, b: Column, strict: bool = False) -> Column:
    a, b = a.cast("double"), b.cast("double")
    out = BINARY[name](a, b)
    if strict and name == "fmod":
        out = F.coalesce(out, F.when(a.isNotNull() & b.isNotNull(), F.lit(float("nan"))))
    return finite(out, strict, name)


def arithmetic(op: str, a: Column, ta: T.DataType, b: Column, tb: T.DataType, strict: bool = False) -> tuple[Column, T.DataType]:
    """Whole numbers add, subtract and multiply exactly and raise on overflow; division is of doubles."""
    if isinstance(ta, T.NullType) or isinstance(tb, T.NullType):
        return F.lit(None).cast("double"), T.DoubleType()
    if not (is_number(ta) and is_number(tb)):
        raise ExpressionError(f"'{op}' takes numbers, not {ta.simpleString()} and {tb.simpleString()}")
    if op == "/":
        a, b = a.cast("double"), b.cast("double")
        if not strict:
            return finite(F.try_divide(a, b), strict, "/"), T.DoubleType()
        zero = F.raise_error(F.lit("division by zero")).cast("double")
        return finite(F.when(b == 0, zero).otherwise(a / F.when(b != 0, b)), strict, "/"), T.DoubleType()
    whole = is_whole(ta) and is_whole(tb)
    kind = "long" if whole else "double"
    if not whole and isinstance(ta, T.DecimalType) and isinstance(tb, (T.DecimalType, T.IntegralType)):
        out = {"+": a + b, "-": a - b, "*": a * b}[op]
        return out.cast("decimal(38,10)"), T.DecimalType(38, 10)
    a, b = a.cast(kind), b.cast(kind)
    out = {"+": a + b, "-": a - b, "*": a * b}[op]
    return (out, T.LongType()) if whole else (finite(out, strict, op), T.DoubleType())


def truthy(x: Column, t: T.DataType) -> Column:
    """Booleans as they are, numbers unless 0, texts unless empty, "false" or "0"; null is false."""
    if isinstance(t, T.BooleanType):
        out = x
    elif is_number(t):
        out = x != 0
    elif isinstance(t, T.StringType):
        out = ~x.isin("", "false", "0")
    elif isinstance(t, T.NullType):
        out = F.lit(False)
    else:
        out = x.isNotNull()
    return F.coalesce(out, F.lit(False))


def compare(op: str, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Kinds that do not compare are unequal and in no order; times compare with their ISO text."""
    if isinstance(ta, T.NullType) or isinstance(tb, T.NullType):
        x = a if isinstance(tb, T.NullType) else b
        if op == "==":
            return x.isNull()
        return x.isNotNull() if op == "!=" else F.lit(False)
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(ta, times) and isinstance(tb, T.StringType):
        b = b.cast(ta)
    elif isinstance(tb, times) and isinstance(ta, T.StringType):
        a = a.cast(tb)
    elif not (is_number(ta) and is_number(tb)) and type(ta) is not type(tb) and not (isinstance(ta, times) and isinstance(tb, times)):
        both = a.isNotNull() & b.isNotNull()
        return both if op == "!=" else F.lit(False)
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def word_test(op: str, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    negated = op.startswith("not ")
    op = op.removeprefix("not ")
    if op == "contains":
        out = F.array_contains(a, b) if isinstance(ta, T.ArrayType) else F.contains(a, b)
        if isinstance(ta, T.ArrayType):
            out = F.when(a.isNotNull() & b.isNotNull(), F.coalesce(out, F.lit(False)))
    elif op == "memberOf":
        out = F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.array_contains(b, a), F.lit(False)))
    elif op == "containsKey":
        out = F.map_contains_key(a, b)
    elif op == "matches":
        out = F.regexp_like(a, b)
    elif op == "startsWith":
        out = F.startswith(a, b)
    elif op == "endsWith":
        out = F.endswith(a, b)
    elif op == "lengthIs":
        out = F.octet_length(a) == b
    else:
        raise ExpressionError(f"unknown test {op!r}")
    return ~out if negated else out


def has_flag(x: Column, mask: Column) -> Column:
    return (mask != 0) & (x >= 0) & (x.bitwiseAND(mask) == mask)


PI = math.pi
