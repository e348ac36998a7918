"""Command line: fold, inspect, expand, query, tune and context, over DDL or a folder of parquet."""

from __future__ import annotations

import argparse
from pathlib import Path

from .engine import WideLayer
from .graph import SchemaGraph
from .plans.compose import ComposeOptions
from .plans.fold import fold, fold_star, recover_by_names
from .plans.select import Policy, explicit, lattice, profiles
from .plans.tune import autotune, curve, knee, render_curve
from .reports.quality import fidelity
from .reports.text import render_model, render_report, render_text
from .session import session
from .sources.catalog import from_dir
from .sources.ddl import read_ddl_file, write_ddl
from .sources.goldset import load_jsonl
from .sources.layer_file import load, to_json, to_yaml


def _catalog(a, spark=None):
    if a.schema.endswith(".sql"):
        return read_ddl_file(a.schema)
    names = sorted(p.stem for p in Path(a.schema).glob("*.parquet"))
    return recover_by_names(from_dir(spark or session(), a.schema, names))


def _fold(a, catalog):
    if a.star:
        return fold_star(catalog, prompt_budget=a.prompt_budget)
    options = ComposeOptions(max_hops=a.max_hops, field_budget=a.field_budget, prompt_budget=a.prompt_budget, expose_child_filters=a.filters)
    policy = Policy(a.coverage, a.min_gain, a.max_cost, a.max_models)
    pick = (lambda c: explicit(c, a.anchors.split(","))) if a.anchors else None
    return fold(catalog, options, policy, selector=pick)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="widegrain", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("fold", "inspect", "expand", "query", "tune", "context"):
        s = sub.add_parser(name)
        s.add_argument("schema", help="a .sql script or a folder of parquet files")
        s.add_argument("--star", action="store_true")
        s.add_argument("--anchors", default="")
        s.add_argument("--layer", help="a saved layer instead of a new one")
        s.add_argument("--max-hops", type=int, default=3)
        s.add_argument("--field-budget", type=int, default=200)
        s.add_argument("--prompt-budget", type=int)
        s.add_argument("--coverage", type=float, default=0.9)
        s.add_argument("--min-gain", type=int, default=2)
        s.add_argument("--max-cost", type=float, default=10.0)
        s.add_argument("--max-models", type=int)
        s.add_argument("--filters", action="store_true")
        s.add_argument("--format", choices=("report", "text", "json", "yaml", "ddl"), default="report")
        s.add_argument("--sql")
        s.add_argument("--model")
        s.add_argument("--goldset")
        s.add_argument("--limit", type=int, default=50)
    a = p.parse_args(argv)
    spark = session() if a.command in ("expand", "query") or a.goldset or not a.schema.endswith(".sql") else None
    catalog = _catalog(a, spark)
    if a.command == "inspect":
        graph = SchemaGraph.build(catalog)
        for x in profiles(graph):
            print(f"{x.name:<28} {x.role.value:<10} {x.score:.4f} out {x.out_degree} in {x.in_degree}")
        for c in lattice(graph, ComposeOptions(max_hops=a.max_hops)):
            print(f"{c.name:<28} reaches {len(c.reach)} tables with {c.fields} fields")
        return 0
    if a.command == "tune":
        if a.goldset:
            points = curve(catalog, load_jsonl(spark, a.goldset, catalog))
            print(render_curve(points))
            best = knee(points)
            print(f"knee: {best.budget if best else '-'}")
        else:
            t = autotune(catalog)
            print(f"{t.mode} {t.settings} scores {t.score:.1f} of {t.tried} tried")
        return 0
    made = _fold(a, catalog)
    layer = load(a.layer) if a.layer else made.layer
    if a.command == "fold":
        print({"report": render_report, "text": render_text, "json": to_json, "yaml": to_yaml}.get(a.format, lambda _: write_ddl(made.graph.catalog))(layer))
        if a.format == "report":
            f = fidelity(layer, made.graph)
            print(f"columns kept {f.column_retention:.0%}, joins absorbed {f.join_absorption:.0%}, pairs {f.pair_answerability:.0%}, groupable {f.table_groupability:.0%}")
    elif a.command == "context":
        print(render_model(layer.model(a.model)) if a.model else render_text(layer))
    else:
        if not a.sql:
            p.error("--sql is needed")
        wide = WideLayer(spark, layer, made.graph)
        if a.command == "expand":
            e = wide.expand(a.sql)
            print(e.sql)
            for w in e.warnings:
                print(f"-- warning: {w}")
        else:
            wide.query(a.sql).limit(a.limit).show(a.limit, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
