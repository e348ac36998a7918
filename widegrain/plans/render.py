"""SQL text of join plans: the same plan as the DataFrame's, for reading and for other sessions."""

from __future__ import annotations

import re

from ..types import Catalog, Step
from .joinplan import Child, JoinPlan, bind_condition


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _qualify(expression: str, alias: str, catalog: Catalog, table: str) -> str:
    """Columns of a table in an expression, with its alias."""
    names = sorted(catalog.table(table).column_names, key=len, reverse=True)
    return re.sub(r"(?<![\w`.'])(" + "|".join(map(re.escape, names)) + r")(?![\w`('])", lambda m: f"{q(alias)}.{q(m[1])}", expression, flags=re.I)


def _on(child: str, parent: str, step: Step, catalog: Catalog) -> str:
    e = step.edge
    if e.condition is not None:
        return bind_condition(e.condition, lambda c: f"{q(child)}.{q(c)}", lambda c: f"{q(parent)}.{q(c)}")
    left = [_qualify(x, child, catalog, e.child) for x in e.key_exprs] or [f"{q(child)}.{q(c)}" for c in e.child_cols]
    return " AND ".join(f"{x} = {q(parent)}.{q(p)}" for x, p in zip(left, e.parent_cols, strict=True))


def _child(c: Child, catalog: Catalog) -> str:
    e = c.step.edge
    keys = [_qualify(x, "src", catalog, e.child) for x in e.key_exprs] or [f"`src`.{q(k)}" for k in e.child_cols]
    names = [q(f"on_{k}") for k in c.keys]
    picks = [f"{k} AS {n}" for k, n in zip(keys, names, strict=True)]
    picks += ["COUNT(*) AS " + q(n) if how == "count" else f"{how.upper()}(`src`.{q(col)}) AS {q(n)}" for n, how, col in c.aggregates]
    text = f"SELECT {', '.join(picks)} FROM {catalog.table(c.step.target).reference()} AS `src`"
    for alias, s in c.dimensions.items():
        text += f" INNER JOIN {catalog.table(s.target).reference()} AS {q(alias)} ON {_on('src', alias, s, catalog)}"
    if c.predicates:
        text += " WHERE " + " AND ".join("(" + p.template.format(*(f"{q(a)}.{q(col)}" for a, col in p.columns)) + ")" for p in c.predicates)
    return text + f" GROUP BY {', '.join(keys)}"


def render(plan: JoinPlan, catalog: Catalog) -> str:
    picks = [f"{q(a)}.{q(c)} AS {q(n)}" for a, c, n in plan.outputs]
    picks += [f"COUNT(DISTINCT {', '.join(f'`base`.{q(c)}' for c in columns)}) AS {q(n)}" for n, columns in plan.distinct]
    distinct = "DISTINCT " if plan.axis and not plan.distinct else ""
    lines = [f"SELECT {distinct}{', '.join(picks)}", f"FROM {catalog.table(plan.base).reference()} AS `base`"]
    for h in plan.hops:
        lines.append(f"LEFT JOIN {catalog.table(h.step.target).reference()} AS {q(h.alias)} ON {_on(h.parent, h.alias, h.step, catalog)}")
    for c in plan.children:
        on = " AND ".join(f"`base`.{q(p)} = {q(c.alias)}.{q('on_' + k)}" for p, k in zip(c.step.edge.parent_cols, c.keys, strict=True))
        lines.append(f"{'INNER' if c.predicates else 'LEFT'} JOIN ({_child(c, catalog)}) AS {q(c.alias)} ON {on}")
    for k, h in enumerate(plan.axis):
        on = _on(h.alias, "base", h.step, catalog) if not k else _on(h.parent, h.alias, h.step, catalog)
        lines.append(f"{'LEFT' if k else 'INNER'} JOIN {catalog.table(h.step.target).reference()} AS {q(h.alias)} ON {on}")
    if plan.axis and plan.distinct and plan.outputs:
        lines.append("GROUP BY " + ", ".join(f"{q(a)}.{q(c)}" for a, c, _ in plan.outputs))
    return "\n".join(lines)
