"""Schema files of external types, as Spark types.

    schema Name [options];
    composite C { double x; int64 ids(6); }
    enum E : int32 { A = 0, B = 1 }
    message M { C model; string id; }
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import types as T

from ..plans.match import SIMPLE

TOKEN = re.compile(r"\s+|//[^\n]*|/\*.*?\*/|(\"[^\"]*\"|[A-Za-z_][\w.]*|\d+|[{}()\[\]<>;:,=?])", re.S)


class SchemaError(ValueError):
    pass


def parse_schema(text: str) -> dict[str, T.StructType]:
    """Messages and composites by name; enum fields are texts."""
    toks, i = [], 0
    while i < len(text):
        m = TOKEN.match(text, i)
        if not m:
            raise SchemaError(f"line {text.count(chr(10), 0, i) + 1}: unexpected {text[i]!r}")
        if m[1]:
            toks.append(m[1])
        i = m.end()
    toks.append("")
    types: dict[str, T.StructType] = {}
    enums: set[str] = set()
    at = 0

    def need(t: str) -> None:
        nonlocal at
        if toks[at] != t:
            raise SchemaError(f"expected {t!r}, found {toks[at]!r}")
        at += 1

    def skip(open_: str, close: str) -> None:
        nonlocal at
        depth = 0
        while True:
            depth += (toks[at] == open_) - (toks[at] == close)
            at += 1
            if not depth:
                return

    def kind() -> T.DataType:
        nonlocal at
        name = toks[at]
        at += 1
        if toks[at] == "<":
            at += 1
            first = kind()
            if toks[at] == ",":
                at += 1
                second = kind()
                need(">")
                return T.MapType(first, second)
            need(">")
            return T.ArrayType(first)
        if name.lower() in SIMPLE:
            return SIMPLE[name.lower()]
        if name in enums:
            return T.StringType()
        if name in types:
            return types[name]
        raise SchemaError(f"unknown type {name!r}")

    while toks[at]:
        word = toks[at]
        at += 1
        if word == "schema":
            at += 1
            if toks[at] == "[":
                skip("[", "]")
            need(";")
        elif word == "enum":
            enums.add(toks[at])
            while toks[at] != "{":
                at += 1
            skip("{", "}")
        elif word in ("message", "composite", "struct", "group"):
            name = toks[at]
            at += 1
            if toks[at] == "[":
                skip("[", "]")
            need("{")
            fields = []
            while toks[at] != "}":
                t = kind()
                field = toks[at]
                at += 1
                if toks[at] == "(":
                    at += 2
                    need(")")
                    t = T.ArrayType(t)
                elif toks[at] == "[":
                    listed = toks[at + 1] == "]" or toks[at + 1].isdigit()
                    skip("[", "]")
                    t = T.ArrayType(t) if listed else t
                fields.append(T.StructField(field, t))
                need(";")
            need("}")
            if toks[at] == ";":
                at += 1
            types[name] = T.StructType(fields)
        else:
            raise SchemaError(f"unexpected {word!r}")
    return types


def load(path: str, bases: list[str] | None = None, seen: set[str] | None = None) -> tuple[list[str], dict[str, T.StructType]]:
    """Rule texts of a file and all that it imports, and the types of its schema files; each file once."""
    from ..lang.parser import parse

    seen = set() if seen is None else seen
    real = str(Path(path).resolve())
    if real in seen:
        return [], {}
    seen.add(real)
    text = Path(path).read_text(encoding="utf-8")
    program = parse(text)
    texts, types = [], {}
    roots = [Path(path).parent, *map(Path, bases or [])]
    for name in program.schemas:
        found = next((r / name for r in roots if (r / name).exists()), None)
        if found is None:
            raise SchemaError(f"no schema {name!r}")
        types |= parse_schema(found.read_text(encoding="utf-8"))
    for name in program.imports:
        part = name.removesuffix(".*").replace(".", "/")
        for r in roots:
            files = sorted((r / part).glob("*.rfl")) if name.endswith(".*") else [r / f"{part}.rfl"]
            for f in files:
                if f.exists():
                    more, kinds = load(str(f), bases, seen)
                    texts += more
                    types |= kinds
    return [*texts, text], types
