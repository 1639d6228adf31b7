"""Text to syntax trees, by recursive descent."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import syntax as S

UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}
HYPHENED = ("entry-point", "agenda-group", "activation-group", "no-loop", "lock-on-active", "auto-focus")
TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|\#[^\n]*|/\*.*?\*/)
  |(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
  |(?P<dur>\d+(?:ms|s|m|h)\b)
  |(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)
  |(?P<var>\$[A-Za-z_]\w*)
  |(?P<name>(?:"""
    + "|".join(HYPHENED)
    + r""")\b|[A-Za-z_]\w*)
  |(?P<op>==|!=|<=|>=|&&|\|\||!\.|\.\*|[-+*/<>=!(){}\[\],.:;@])""",
    re.X | re.S,
)
ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}
AGGREGATES = ("count", "sum", "average", "avg", "min", "max", "collect", "collectList", "collectSet")
TEMPORAL = ("after", "before", "coincides", "during")
WORD_TESTS = ("contains", "containsKey", "matches", "startsWith", "endsWith", "lengthIs", "memberOf")
MAX_SOURCE, MAX_OPERATIONS, MAX_DEPTH = 16 * 1024, 256, 64


class RuleSyntaxError(ValueError):
    pass


@dataclass
class Token:
    kind: str
    text: str
    at: int


def tokens(text: str) -> list[Token]:
    out, i = [], 0
    while i < len(text):
        m = TOKEN.match(text, i)
        if not m:
            raise RuleSyntaxError(f"line {text.count(chr(10), 0, i) + 1}: unexpected {text[i]!r}")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], i))
        i = m.end()
    out.append(Token("end", "", len(text)))
    return out


def unquote(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)


class Parser:
    def __init__(self, text: str, aggregates=AGGREGATES):
        self.text, self.toks, self.i, self.depth, self.count = text, tokens(text), 0, 0, 0
        self.aggregates = set(aggregates)

    # --- helpers

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def fail(self, what: str):
        raise RuleSyntaxError(f"line {self.text.count(chr(10), 0, self.tok.at) + 1}: {what}, found {self.tok.text or 'the end'!r}")

    def at(self, *texts: str) -> bool:
        return self.tok.text in texts and self.tok.kind != "str"

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            self.fail(f"expected {text!r}")

    def kind(self, kind: str) -> str:
        if self.tok.kind != kind:
            self.fail(f"expected {kind}")
        self.i += 1
        return self.toks[self.i - 1].text

    def string(self) -> str:
        return unquote(self.kind("str"))

    def integer(self) -> int:
        sign = -1 if self.take("-") else 1
        return sign * int(self.kind("num"))

    def qualified(self) -> str:
        out = self.kind("name")
        while self.at(".") and self.toks[self.i + 1].kind == "name":
            self.i += 1
            out += "." + self.kind("name")
        return out

    # --- statements

    def program(self) -> S.Program:
        p, notes = S.Program(), {}
        while self.tok.kind != "end":
            if self.at("@"):
                notes |= self.note()
            elif self.take("package"):
                p.package = self.qualified()
            elif self.take("import"):
                self.import_(p)
            elif self.take("global"):
                kind = self.qualified()
                p.globals[self.kind("name")] = kind
            elif self.take("declare"):
                name, fields = self.declare()
                if name in p.types:
                    self.fail(f"type {name} is declared twice")
                p.types[name] = fields
            elif self.take("enum"):
                name = self.kind("name")
                if self.take("<"):
                    self.kind("name")
                    self.need(">")
                values = []
                while not self.take("end"):
                    values.append(self.kind("name"))
                    self.take(",")
                p.enums[name] = values
            elif self.take("function"):
                p.functions.append(self.function())
            elif self.take("query"):
                q = self.query()
                p.queries[q.name] = q
            elif self.take("rule"):
                r = self.rule()
                r.notes, notes = notes, {}
                p.rules.append(r)
            else:
                self.fail("expected a statement")
            self.take(";")
        return p

    def note(self) -> dict[str, str]:
        self.need("@")
        name, value = self.kind("name"), "true"
        if self.take("("):
            value = self.string() if self.tok.kind == "str" else self.kind("name")
            self.need(")")
        return {name: value}

    def import_(self, p: S.Program) -> None:
        if self.tok.kind == "str":
            p.schemas.append(self.string())
        elif self.at("schema") and self.toks[self.i + 1].kind == "str":
            self.i += 1
            p.schemas.append(self.string())
        else:
            name = self.qualified()
            p.imports.append(name + ".*" if self.take(".*") else name)

    def type_name(self) -> str:
        out = self.qualified()
        if self.take("<"):
            out += "<" + self.type_name()
            while self.take(","):
                out += "," + self.type_name()
            self.need(">")
            out += ">"
        return out

    def declare(self) -> tuple[str, dict[str, str]]:
        name, fields = self.kind("name"), {}
        while self.at("@"):
            self.note()
        while not self.take("end"):
            key = self.kind("name")
            self.need(":")
            fields[key] = self.type_name()
            self.take(",")
        return name, fields

    def function(self) -> str:
        name = ""
        while not self.take("("):
            name = self.kind("name")
        while not self.take(")"):
            self.i += 1
        self.need("{")
        depth = 1
        while depth:
            if self.tok.kind == "end":
                self.fail("expected '}'")
            depth += self.at("{") - self.at("}")
            self.i += 1
        return name

    def query(self) -> S.Query:
        name = self.string() if self.tok.kind == "str" else self.kind("name")
        params = []
        if self.take("("):
            while not self.take(")"):
                kind = self.qualified()
                params.append((kind, self.kind("var")))
                self.take(",")
        patterns = []
        while not self.take("end"):
            patterns.append(self.pattern())
        return S.Query(name, params, patterns)

    def rule(self) -> S.Rule:
        r = S.Rule(self.string(), [], [])
        while not self.take("when"):
            if self.take("salience"):
                r.salience = self.integer()
            elif self.take("extends"):
                r.extends = self.string()
            elif self.take("agenda-group"):
                r.agenda_group = self.string()
            elif self.take("activation-group"):
                r.activation_group = self.string()
            elif self.take("timer"):
                first = self.integer()
                r.timer = (first, self.integer()) if self.take(",") else (first,)
            elif self.take("duration"):
                r.duration = self.integer()
            elif self.take("no-loop"):
                r.no_loop = not self.at("true", "false") or self.flag()
            elif self.take("lock-on-active"):
                r.lock_on_active = not self.at("true", "false") or self.flag()
            elif self.take("enabled"):
                r.enabled = self.flag()
            elif self.take("auto-focus"):
                r.auto_focus = self.flag()
            else:
                self.fail("expected an attribute or 'when'")
        group: list[S.Pattern] = []
        while not self.take("then"):
            if self.take("or"):
                r.groups.append(group)
                group = []
            elif self.at("(") :
                self.need("(")
                while not self.take(")"):
                    group.append(self.pattern())
            else:
                group.append(self.pattern())
        r.groups.append(group)
        r.actions = self.block("end")
        return r

    def flag(self) -> bool:
        if self.take("true"):
            return True
        self.need("false")
        return False

    # --- patterns

    def pattern(self) -> S.Pattern:
        if self.tok.kind == "str":
            name, args = self.string(), []
            self.need("(")
            while not self.take(")"):
                args.append(self.kind("var"))
                self.take(",", ";")
            return S.Pattern("call", name=name, args=args)
        if self.at("eval") and self.toks[self.i + 1].text == "(":
            self.i += 2
            test = self.expression()
            self.need(")")
            return S.Pattern("eval", test=test)
        if self.at("not", "exists"):
            kind = self.tok.text
            self.i += 1
            wrapped = self.take("(")
            inner = self.pattern()
            if wrapped:
                if not self.at(")"):
                    self.fail(f"{kind} takes one pattern")
                self.need(")")
            return S.Pattern(kind, inner=[inner])
        if self.take("forall"):
            self.need("(")
            inner = [self.pattern()]
            while self.take(","):
                inner.append(self.pattern())
            self.need(")")
            return S.Pattern("forall", inner=inner)
        return self.fact()

    def fact(self, in_accumulate: bool = False) -> S.Pattern:
        binding = None
        if self.tok.kind == "var":
            binding = self.kind("var")
            self.need(":")
        p = S.Pattern("fact", type=self.qualified(), binding=binding)
        self.need("(")
        if not self.at(")"):
            p.test = self.any_of()
        self.need(")")
        while True:
            if self.take("over"):
                self.need("window")
                self.need(":")
                kind = self.kind("name")
                self.need("(")
                size = self.duration() if kind == "time" else self.integer()
                self.need(")")
                if kind not in ("time", "length"):
                    self.fail("a window is of time or length")
                p.window = S.Span(kind, size)
            elif self.at("from"):
                self.i += 1
                if self.take("entry-point"):
                    p.entry_point = self.string()
                elif not in_accumulate and self.take("accumulate"):
                    self.need("(")
                    source = self.fact(True)
                    self.need(",")
                    name = self.kind("name")
                    if name not in self.aggregates:
                        self.fail(f"unknown aggregate {name!r}")
                    self.need("(")
                    arg = None if self.at(")") else self.sum()
                    self.need(")")
                    self.need(")")
                    p.source = S.Accumulate(source, name, arg)
                elif not in_accumulate and self.take("collect"):
                    self.need("(")
                    p.source = S.Accumulate(self.fact(True), "collect")
                    self.need(")")
                elif not in_accumulate and self.take("unnest"):
                    self.need("(")
                    p.source = S.Unnest(self.ref())
                    self.need(")")
                else:
                    self.fail("unknown source")
            else:
                return p

    def duration(self) -> int:
        if self.tok.kind == "dur":
            m = re.match(r"(\d+)(\w+)", self.kind("dur"))
            return int(m[1]) * UNITS[m[2]]
        return self.integer()

    def any_of(self):
        left = self.all_of()
        while self.take("||", "or"):
            left = S.Bin("||", left, self.all_of())
        return left

    def all_of(self):
        left = self.constraint()
        while self.take("&&", ","):
            left = S.Bin("&&", left, self.constraint())
        return left

    def constraint(self):
        if self.at("("):
            self.need("(")
            inner = self.any_of()
            self.need(")")
            return inner
        if self.take("!"):
            return S.Un("!", self.ref())
        if self.at("within") and self.toks[self.i + 1].kind == "dur":
            self.i += 1
            ms = self.duration()
            self.need("of")
            return S.Within(ms, self.kind("var"))
        if self.at("has_flag"):
            self.i += 1
            self.need("(")
            ref = self.ref()
            self.need(",")
            mask = self.sum()
            self.need(")")
            return S.Fn("has_flag", (ref, mask))
        if self.tok.kind == "var" and self.toks[self.i + 1].text == ":":
            var = self.kind("var")
            self.need(":")
            ref = self.ref()
            return S.Bind(var, ref, self.test(ref))
        ref = self.ref()
        return self.test(ref) or ref

    def test(self, ref: S.Ref):
        """What follows a field, or None."""
        for op in ("==", "!=", "<=", ">=", "<", ">"):
            if self.take(op):
                return S.Bin(op, ref, self.sum())
        for op in TEMPORAL:
            if self.take(op):
                return S.Bin(op, ref, self.ref())
        negated = self.at("not") and self.toks[self.i + 1].text in ("in", *WORD_TESTS)
        if negated:
            self.i += 1
        if self.take("in"):
            self.need("(")
            values = [self.sum()]
            while self.take(","):
                values.append(self.sum())
            self.need(")")
            return S.In(ref, tuple(values), negated)
        for op in WORD_TESTS:
            if self.take(op):
                if negated and op in ("startsWith", "endsWith", "lengthIs"):
                    self.fail(f"'not {op}' is no operator")
                right = self.sum()
                if op == "matches" and isinstance(right, S.Lit):
                    try:
                        re.compile(str(right.value))
                    except re.error as e:
                        raise RuleSyntaxError(f"bad pattern {right.value!r}: {e}") from None
                return S.Bin(("not " if negated else "") + op, ref, right)
        return None

    # --- expressions

    def expression(self):
        begin = self.tok.at
        self.count = 0
        out = self.or_()
        if self.tok.at - begin > MAX_SOURCE or self.count > MAX_OPERATIONS:
            self.fail("the expression is too large")
        return out

    def or_(self):
        left = self.and_()
        while self.take("||"):
            left = self.made(S.Bin("||", left, self.and_()))
        return left

    def and_(self):
        left = self.compare()
        while self.take("&&"):
            left = self.made(S.Bin("&&", left, self.compare()))
        return left

    def compare(self):
        left = self.sum()
        for op in ("==", "!=", "<=", ">=", "<", ">"):
            if self.take(op):
                return self.made(S.Bin(op, left, self.sum()))
        return left

    def sum(self):
        left = self.product()
        while self.at("+", "-"):
            op = self.kind("op")
            left = self.made(S.Bin(op, left, self.product()))
        return left

    def product(self):
        left = self.unary()
        while self.at("*", "/"):
            op = self.kind("op")
            left = self.made(S.Bin(op, left, self.unary()))
        return left

    def unary(self):
        if self.at("-", "+", "!"):
            op = self.kind("op")
            x = self.unary()
            if op == "-" and isinstance(x, S.Lit) and isinstance(x.value, (int, float)) and not isinstance(x.value, bool):
                return S.Lit(-x.value)
            return self.made(S.Un(op, x))
        return self.primary()

    def primary(self):
        t = self.tok
        if t.kind == "num":
            self.i += 1
            value = float(t.text) if re.search(r"[.eE]", t.text) else int(t.text)
            if isinstance(value, int) and value >= 2**63:
                self.fail("an integer beyond 64 bits")
            return S.Lit(value)
        if t.kind == "str":
            return S.Lit(self.string())
        if self.take("("):
            self.depth += 1
            if self.depth > MAX_DEPTH:
                self.fail("too deeply nested")
            x = self.or_()
            self.depth -= 1
            self.need(")")
            return x
        if t.kind == "var":
            return self.ref()
        if t.kind == "name":
            for word, value in (("true", True), ("false", False), ("nil", None), ("null", None)):
                if self.take(word):
                    return S.Lit(value)
            if self.at("pi") and self.toks[self.i + 1].text not in (".", "("):
                self.i += 1
                return S.Fn("pi", ())
            if self.toks[self.i + 1].text == "(":
                name = self.kind("name")
                self.need("(")
                args = []
                while not self.take(")"):
                    args.append(self.or_())
                    self.take(",")
                return self.made(S.Fn(name, tuple(args)))
            return self.ref()
        self.fail("expected a value")

    def made(self, x):
        self.count += 1
        return x

    def ref(self) -> S.Ref:
        var, steps, safe = None, [], False
        if self.tok.kind == "var":
            var = self.kind("var")
        else:
            steps.append(self.kind("name"))
        while True:
            if self.at(".", "!."):
                safe |= self.at("!.")
                self.i += 1
                steps.append(self.kind("name"))
            elif self.take("["):
                steps.append([unquote(self.kind("str"))] if self.tok.kind == "str" else self.integer())
                if isinstance(steps[-1], list):
                    steps[-1] = ("key", steps[-1][0])
                self.need("]")
            else:
                return S.Ref(var, tuple(steps), safe)

    # --- actions

    def block(self, end: str) -> list:
        out = []
        while not self.take(end):
            out.append(self.action())
            self.take(";")
        return out

    def braces(self) -> list:
        self.need("{")
        return self.block("}")

    def fields(self) -> dict:
        self.need("{")
        out = {}
        while not self.take("}"):
            name = self.kind("name")
            if not self.take("=", ":"):
                self.fail("expected '='")
            out[name] = self.expression()
            self.take(",", ";")
        return out

    def action(self):
        if self.take("insert"):
            return S.Insert(self.qualified(), self.fields())
        if self.take("insertLogical"):
            return S.Insert(self.qualified(), self.fields(), True)
        if self.take("update"):
            return S.Update(self.kind("var"), self.fields())
        if self.take("modify"):
            self.need("(")
            var, fields = self.kind("var"), {}
            self.need(")")
            self.need("{")
            while not self.take("}"):
                name = self.kind("name")
                if name.startswith("set") and name[3:4].isupper():
                    name = name[3].lower() + name[4:]
                self.need("(")
                fields[name] = self.expression()
                self.need(")")
                self.take(",", ";")
            return S.Update(var, fields)
        if self.take("retract"):
            wrapped = self.take("(")
            var = self.kind("var")
            if wrapped:
                self.need(")")
            return S.Retract(var)
        if self.take("halt"):
            if self.take("("):
                self.need(")")
            return S.Halt()
        if self.take("setFocus"):
            self.need("(")
            name = self.string()
            self.need(")")
            return S.Focus(name)
        if self.take("if"):
            branches = [(self.expression(), self.braces())]
            while self.at("else") and self.toks[self.i + 1].text == "if":
                self.i += 2
                branches.append((self.expression(), self.braces()))
            return S.If(branches, self.braces() if self.take("else") else [])
        if self.take("switch"):
            return self.switch()
        if self.take("for"):
            var = self.kind("var")
            self.need("in")
            if self.take("("):
                source = [self.ref()]
                while self.take(","):
                    source.append(self.ref())
                self.need(")")
            else:
                source = self.ref()
            return S.For(var, source, self.braces())
        if self.take("while"):
            return S.While(self.expression(), self.braces())
        if self.at("break", "continue"):
            return S.Jump(self.kind("name"))
        if self.take("call"):
            name, args = self.string(), []
            self.need("(")
            while not self.take(")"):
                args.append(self.expression())
                self.take(",")
            return S.Call(name, args, self.kind("var") if self.take("into") else None)
        self.fail("expected an action")

    def switch(self) -> S.Switch:
        x = self.expression()
        self.need("{")
        cases, default = [], []
        while not self.take("}"):
            if self.take("case"):
                value = self.sum()
                self.take(":")
                cases.append((value, self.case()))
            else:
                self.need("default")
                self.take(":")
                default = self.case()
        return S.Switch(x, cases, default)

    def case(self) -> list:
        if self.at("{"):
            return self.braces()
        out = []
        while not self.at("case", "default", "}"):
            out.append(self.action())
            self.take(";")
        if out and isinstance(out[-1], S.Jump) and out[-1].kind == "break":
            out.pop()
        return out


def parse(text: str, aggregates=AGGREGATES) -> S.Program:
    return Parser(text, aggregates).program()


def parse_expression(text: str):
    p = Parser(text)
    out = p.expression()
    if p.tok.kind != "end":
        p.fail("expected the end")
    return out
