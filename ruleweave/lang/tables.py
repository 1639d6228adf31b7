"""Decision tables: rows of a CSV become rules.

Columns: RULE NAME, SALIENCE, AGENDA-GROUP, and any number of ``CONDITION: text``
and ``ACTION: text``, where the first $1 of the text is the row's cell.  A cell
that is empty or ``*`` leaves its column out.  Rows before the header may hold
PACKAGE, IMPORT, DECLARE and QUERY texts.
"""

from __future__ import annotations

import csv
import io

PREAMBLE = ("PACKAGE", "IMPORT", "DECLARE", "QUERY", "GLOBAL", "ENUM")


class TableError(ValueError):
    pass


def _kind(cell: str) -> tuple[str, str]:
    head, _, rest = cell.partition(":")
    head = head.strip().upper()
    if head in ("CONDITION", "ACTION"):
        if not rest.strip():
            raise TableError(f"{head} needs a text")
        return head, rest.strip()
    return cell.strip().upper().replace("_", " "), ""


def rows_of(text: str) -> list[list[str]]:
    return [[c.strip() for c in row] for row in csv.reader(io.StringIO(text), skipinitialspace=True) if any(c.strip() for c in row)]


def to_rules(text: str) -> str:
    """The rule text that a table stands for."""
    rows = rows_of(text)
    out, at = [], 0
    while at < len(rows) and rows[at][0].split(":")[0].strip().upper() in PREAMBLE:
        word, _, rest = rows[at][0].partition(":")
        body = rest.strip() or " ".join(c for c in rows[at][1:] if c)
        out.append(body if body.lower().startswith(word.strip().lower()) else f"{word.strip().lower()} {body}")
        at += 1
    if at == len(rows):
        raise TableError("the table has no header")
    header = [_kind(c) for c in rows[at]]
    if not any(k == "CONDITION" for k, _ in header) and not any(k == "ACTION" for k, _ in header):
        raise TableError("the table has neither condition nor action")
    for number, row in enumerate(rows[at + 1 :], 1):
        cell = {k: row[i] for i, (k, _) in enumerate(header) if i < len(row) and row[i] not in ("", "*")}
        parts = {"CONDITION": [], "ACTION": []}
        for i, (kind, body) in enumerate(header):
            if kind in parts and i < len(row) and row[i] not in ("", "*"):
                parts[kind].append("    " + body.replace("$1", row[i], 1))
        out.append(f'rule "{cell.get("RULE NAME", f"DecisionTable_Row_{number}")}"')
        if "SALIENCE" in cell:
            out.append(f"salience {cell['SALIENCE']}")
        group = cell.get("AGENDA-GROUP") or cell.get("AGENDA GROUP")
        if group:
            out.append(f'agenda-group "{group}"')
        out += ["when", *parts["CONDITION"], "then", *parts["ACTION"], "end"]
    return "\n".join(out)
