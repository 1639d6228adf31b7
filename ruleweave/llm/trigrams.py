"""From a regex the Boolean query over trigrams that every match satisfies, in lower case.

A query is True (nothing is known), a trigram, or ("and" | "or", queries).  The
regex is parsed; for each part we know the exact set of strings that it matches,
while these are few, or a query of its own.  Strings of parts in a row are
multiplied out, so that trigrams may cross the parts.  Case is folded on both
sides, which can only make a query weaker.  What is not understood gives True.
"""

from __future__ import annotations

from re import _constants as K
from re import _parser

Query = bool | str | tuple

#: Strings of an exact set, and their letters; beyond these only a query is kept.
STRINGS, LETTERS = 64, 40


def all_of(queries) -> Query:
    flat = []
    for q in queries:
        flat += q[1] if isinstance(q, tuple) and q[0] == "and" else [] if q is True else [q]
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def any_of(queries) -> Query:
    flat = []
    for q in queries:
        if q is True:
            return True
        flat += q[1] if isinstance(q, tuple) and q[0] == "or" else [q]
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def of_string(s: str) -> Query:
    return all_of(s[i : i + 3] for i in range(len(s) - 2))


def of_strings(strings: set[str]) -> Query:
    return any_of(of_string(s) for s in sorted(strings))


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is K.LITERAL:
            out.add(chr(value).lower())
        elif kind is K.RANGE and value[1] - value[0] < STRINGS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out


def _part(op, value) -> tuple[set[str] | None, Query]:
    """(the exact strings or None, a query that holds for every match) of one part."""
    if op is K.LITERAL:
        return {chr(value).lower()}, True
    if op is K.IN:
        strings = _class(value)
        return (strings if strings is not None and len(strings) <= STRINGS else None), True
    if op in (K.AT, K.ASSERT_NOT):
        return {""}, True
    if op is K.ASSERT:
        return {""}, True
    if op is K.SUBPATTERN:
        return _sequence(value[-1])
    if op is K.ATOMIC_GROUP:
        return _sequence(value)
    if op is K.BRANCH:
        sides = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in sides) and len(joined := set().union(*(s for s, _ in sides))) <= STRINGS:
            return joined, of_strings(joined)
        return None, any_of(of_strings(s) if s is not None else q for s, q in sides)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        least, most, body = value
        strings, query = _sequence(body)
        if least == 0:
            return (strings | {""}, True) if strings is not None and most == 1 else (None, True)
        if least == most == 1:
            return strings, query
        return None, of_strings(strings) if strings is not None else query
    return None, True


def _sequence(parts) -> tuple[set[str] | None, Query]:
    held: set[str] | None = {""}  # the strings of the parts since the last unknown one
    whole, known = True, []
    for op, value in parts:
        strings, query = _part(op, value)
        more = None if strings is None else {a + b for a in held for b in strings}
        if more is not None and len(more) <= STRINGS and max(map(len, more), default=0) <= LETTERS:
            held = more
            continue
        whole = False
        known += [of_strings(held), query if strings is None else True]
        held = {""} if strings is None else strings
    if whole:
        return held, of_strings(held)
    return None, all_of([*known, of_strings(held)])


def query_of(pattern: str, flags: int = 0) -> Query:
    """The trigram query of a regex; True where it has no mandatory trigram."""
    return _sequence(_parser.parse(pattern, flags))[1]


def grams_of(q: Query) -> set[str]:
    return {q} if isinstance(q, str) else set().union(*map(grams_of, q[1])) if isinstance(q, tuple) else set()


def holds(q: Query, grams: set[str]) -> bool:
    """Whether a text with these trigrams may match."""
    if isinstance(q, str):
        return q in grams
    return q if isinstance(q, bool) else (all if q[0] == "and" else any)(holds(x, grams) for x in q[1])
