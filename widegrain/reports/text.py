"""Layers as text: for a prompt, for a person, and the characters they take."""

from __future__ import annotations

from ..types import FieldKind, Layer, LogicalField, LogicalModel

# Headings of the kinds of fields, which tell what each may be used for.
HEADINGS = {
    "base": "Columns (one value per row)",
    "joined": "Looked up (one value per row)",
    "aggregated": "Totals of child rows (already summed once per row; SUM over rows is exact, AVG of totals is not the rows' average)",
    "grouped": "Group axis through a link table (use with its count of different rows)",
    "filter": "Conditions only (WHERE, joined by AND, one field per condition)",
}
INTRO = "Each model is one wide table. Read one model per query and do not join models."
STOPS = {
    "coverage_reached": "coverage target met",
    "gain_exhausted": "nothing left clears the admission rules: raise the cost, lower the gain or raise the hops",
    "max_areas": "hit the ceiling of models before the coverage target",
    "no_candidates": "schema has no tables",
    "selector_chose": "the selector returned this set",
}


def kind_of(f: LogicalField) -> str:
    return "filter" if f.filter_only else f.source.kind.value


def field_line(f: LogicalField) -> str:
    return f"  {f.name} ({f.dtype.simpleString()})" + (f" - {f.description}" if f.description else "")


def field_cost(f: LogicalField) -> int:
    return len(field_line(f)) + 1


def model_overhead(name: str, description: str) -> int:
    return len(f"### {name}\n{description}\n\n") + sum(len(h) + 2 for h in HEADINGS.values())


def render_model(m: LogicalModel) -> str:
    lines = [f"### {m.name}", *([m.description] if m.description else [])]
    for kind, heading in HEADINGS.items():
        own = [f for f in m.fields if kind_of(f) == kind]
        if own:
            lines += [f"{heading}:", *map(field_line, own)]
    return "\n".join(lines) + "\n"


def header(layer: Layer) -> str:
    return f"=== {len(layer.models)} wide models covering {layer.covered_count} of {layer.table_count} tables ==="


def render_text(layer: Layer) -> str:
    """The layer for a prompt; equal layers give equal bytes."""
    lines = [header(layer), INTRO, "", *map(render_model, layer.models)]
    if layer.notes:
        lines += ["=== Not covered ===", *(f"  {n.removeprefix('uncovered: ')}" for n in layer.notes)]
    return "\n".join(lines)


def render_report(layer: Layer) -> str:
    lines = [f"{layer.table_count} tables -> {len(layer.models)} models ({layer.compression_ratio:.1f}:1), {layer.covered_count} covered ({100 * layer.coverage:.0f}%)"]
    if layer.selector and layer.selector != "greedy":
        lines.append(f"anchors chosen by: {layer.selector}")
    if layer.stop_reason:
        lines.append(f"stopped: {STOPS.get(layer.stop_reason, layer.stop_reason)}")
    for m in layer.models:
        counts = ", ".join(f"{k.value} {sum(f.source.kind is k for f in m.fields)}" for k in FieldKind)
        lines.append(f"  {m.name:<24} {len(m.fields):>3} fields ({counts})  absorbs {len(m.absorbed) + 1} tables")
    if layer.notes:
        lines.append(f"  {len(layer.notes)} notes")
    return "\n".join(lines)


def render_catalog(layer: Layer, is_summary=lambda m: m.base.startswith("V_")) -> str:
    """One line for each model, for choosing among them."""
    lines = []
    for m in layer.models:
        totals = [f.name for f in m.fields if f.source.kind is FieldKind.AGGREGATED and not f.filter_only]
        lines.append(f"- {m.name}: rows of {m.base}" + (f" ({m.description})" if m.description else "") + (f"; with {', '.join(m.absorbed[:8])}" if m.absorbed else "") + (f"; totals {', '.join(totals[:6])}" if totals else "") + ("; monthly sums, for trends" if is_summary(m) else ""))
    return "\n".join(lines)
