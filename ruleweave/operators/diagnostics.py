"""What a session did and how its rules run."""

from __future__ import annotations

import json

from ..plans.match import Match
from .session import Session


def summary(s: Session) -> list[dict]:
    """For each rule that fired: how often, and the seconds it took, slowest first."""
    rows = [{"rule": r, "fired": n, "seconds": round(s.stats.seconds[r], 3)} for r, n in s.stats.fired.items()]
    return sorted(rows, key=lambda r: -r["seconds"])


def as_json(s: Session) -> str:
    return json.dumps({"rounds": s.stats.rounds, "rules": summary(s)})


def as_prometheus(s: Session) -> str:
    out = [f"ruleweave_rounds_total {s.stats.rounds}"]
    for r in summary(s):
        name = r["rule"].replace("\\", "\\\\").replace('"', '\\"')
        out += [f'ruleweave_fired_total{{rule="{name}"}} {r["fired"]}', f'ruleweave_seconds_total{{rule="{name}"}} {r["seconds"]}']
    return "\n".join(out) + "\n"


def memory(s: Session) -> dict[str, int]:
    """Facts of each type."""
    return {name: df.count() for name, df in s.memory.types.items()}


def explain(s: Session, rule: str, mode: str = "formatted") -> str:
    """The physical plans of a rule's condition, one for each of its groups."""
    spark = s.spark
    kind = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    found: list[Match] = s._matches(s.kb.by_name[rule])
    return "\n".join(m.df._jdf.queryExecution().explainString(kind) for m in found)


def network(s: Session) -> str:
    """Which types each rule reads and writes, as a graph in DOT."""
    from ..lang import syntax as S
    from .session import _actions

    out = ["digraph rules {"]
    for r in s.kb.rules:
        for t in sorted({t for g in r.groups for p in g for t, *_ in s._reads(p)}):
            out.append(f'  "{t}" -> "{r.name}";')
        for t in sorted({a.type for a in _actions(r.actions) if isinstance(a, S.Insert)}):
            out.append(f'  "{r.name}" -> "{t}";')
    return "\n".join([*out, "}"])
