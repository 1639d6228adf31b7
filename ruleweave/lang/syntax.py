"""Syntax trees of the rule language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# --- expressions -----------------------------------------------------------


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Ref:
    """``var`` is a $name, or None for a field of the pattern at hand; steps are names, ints or strings in brackets."""

    var: str | None
    steps: tuple[Any, ...] = ()
    safe: bool = False


@dataclass(frozen=True)
class Un:
    op: str
    x: Any


@dataclass(frozen=True)
class Bin:
    op: str
    a: Any
    b: Any


@dataclass(frozen=True)
class Fn:
    name: str
    args: tuple[Any, ...]


@dataclass(frozen=True)
class In:
    x: Any
    values: tuple[Any, ...]
    negated: bool = False


@dataclass(frozen=True)
class Within:
    ms: int
    var: str


@dataclass(frozen=True)
class Bind:
    """``$var: field``: a name for the field; true by itself, or a test if ``test`` is there."""

    var: str
    ref: Ref
    test: Any = None


# --- patterns --------------------------------------------------------------


@dataclass(frozen=True)
class Span:
    """A sliding window: the last ``size`` facts, or those of the last ``size`` milliseconds."""

    kind: str
    size: int


@dataclass
class Accumulate:
    source: Pattern
    function: str
    argument: Any = None


@dataclass
class Unnest:
    ref: Ref


@dataclass
class Pattern:
    """kind: fact, not, exists, forall, eval or call."""

    kind: str
    type: str = ""
    binding: str | None = None
    test: Any = None
    source: Accumulate | Unnest | None = None
    entry_point: str | None = None
    window: Span | None = None
    inner: list[Pattern] = field(default_factory=list)
    name: str = ""
    args: list[str] = field(default_factory=list)


# --- actions ---------------------------------------------------------------


@dataclass
class Insert:
    type: str
    fields: dict[str, Any]
    logical: bool = False


@dataclass
class Update:
    var: str
    fields: dict[str, Any]


@dataclass
class Retract:
    var: str


@dataclass
class Halt:
    pass


@dataclass
class Focus:
    group: str


@dataclass
class If:
    branches: list[tuple[Any, list]]
    otherwise: list


@dataclass
class Switch:
    x: Any
    cases: list[tuple[Any, list]]
    default: list


@dataclass
class For:
    var: str
    source: Any
    body: list


@dataclass
class While:
    test: Any
    body: list


@dataclass
class Jump:
    kind: str


@dataclass
class Call:
    name: str
    args: list
    into: str | None


# --- statements ------------------------------------------------------------


@dataclass
class Rule:
    name: str
    groups: list[list[Pattern]]
    actions: list
    salience: int | None = None
    extends: str | None = None
    agenda_group: str | None = None
    activation_group: str | None = None
    no_loop: bool = False
    lock_on_active: bool = False
    enabled: bool = True
    auto_focus: bool = False
    duration: int | None = None
    timer: tuple[int, ...] = ()
    notes: dict[str, str] = field(default_factory=dict)


@dataclass
class Query:
    name: str
    params: list[tuple[str, str]]
    patterns: list[Pattern]


@dataclass
class Program:
    package: str = ""
    imports: list[str] = field(default_factory=list)
    schemas: list[str] = field(default_factory=list)
    globals: dict[str, str] = field(default_factory=dict)
    types: dict[str, dict[str, str]] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)
    functions: list[str] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    queries: dict[str, Query] = field(default_factory=dict)
