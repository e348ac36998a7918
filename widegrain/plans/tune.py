"""Choosing a budget: by the questions a layer answers, or by a score where there are none."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from ..graph import SchemaGraph
from ..reports.quality import answerable, fidelity
from ..reports.text import render_text
from ..types import Catalog
from .compose import ComposeOptions
from .fold import STAR_MODEL_FIELDS, Fold, fold, fold_star
from .select import Policy, greedy

# Fixed values.
BUDGETS = (2_000, 4_000, 6_000, 8_000, 12_000, 16_000, 24_000, 32_000)
WEIGHTS = {"coverage": 0.30, "pair": 0.25, "groupability": 0.20, "absorption": 0.15, "compactness": 0.10}
COMPACT, COVERED_LEAST = 12_000, 0.85
GRID = {"target": (0.7, 0.8, 0.9, 1.0), "field_budget": (100, 200, 300, 450), "min_gain": (1, 2, 3), "max_cost": (5.0, 10.0, 20.0)}


@dataclass(frozen=True)
class Point:
    budget: int
    characters: int
    models: int
    answered: int
    asked: int

    @property
    def rate(self) -> float:
        return self.answered / self.asked if self.asked else 0.0


def curve(catalog: Catalog, cases, budgets=BUDGETS, make=fold_star) -> list[Point]:
    """For each budget of characters, how many cases the layer answers."""
    out = []
    for b in budgets:
        made = make(catalog, field_budget=10_000, prompt_budget=b)
        verdicts = answerable(made.layer, cases, made.graph)
        out.append(Point(b, len(render_text(made.layer)), len(made.layer.models), sum(v.answerable for v in verdicts), len(verdicts)))
    return out


def knee(points: list[Point]) -> Point | None:
    """The cheapest of the best."""
    return min((p for p in points if p.answered == max(x.answered for x in points)), key=lambda p: p.budget, default=None)


def render_curve(points: list[Point]) -> str:
    best = knee(points)
    return "\n".join(f"{p.budget:>7} chars  {p.models:>3} models  {p.answered}/{p.asked}" + ("  <- knee" if p is best else "") for p in points)


def compactness(characters: int) -> float:
    """1 up to COMPACT characters, then half for each as many more."""
    return min(1.0, 0.5 ** ((characters - COMPACT) / COMPACT))


def score(made: Fold) -> float:
    """0 to 100."""
    f = fidelity(made.layer, made.graph)
    parts = {"coverage": made.layer.coverage, "pair": f.pair_answerability, "groupability": f.table_groupability, "absorption": f.join_absorption, "compactness": compactness(len(render_text(made.layer)))}
    total = 100 * sum(WEIGHTS[k] * v for k, v in parts.items())
    return total * min(1.0, made.layer.coverage / COVERED_LEAST)


@dataclass(frozen=True)
class Tuned:
    fold: Fold
    score: float
    mode: str
    settings: dict
    tried: int


def autotune_steps(catalog: Catalog, limit: int = 24):
    """(number, of, mode, settings, score, fold) for the star preset and for evenly chosen points of the grid."""
    grid = [dict(zip(GRID, v, strict=True)) for v in product(*GRID.values())]
    step = max(1, -(-len(grid) // max(1, limit - 1)))
    chosen = grid[::step]
    made = fold_star(catalog)
    yield 1, len(chosen) + 1, "star", {}, score(made), made
    for k, s in enumerate(chosen, 2):
        options = ComposeOptions(field_budget=s["field_budget"], max_model_fields=STAR_MODEL_FIELDS, expose_child_filters=True, prefix_joined_fields=False)
        policy = Policy(s["target"], s["min_gain"], s["max_cost"])
        made = fold(catalog, options, selector=lambda c, p=policy: greedy(c, p), infer_missing_keys=False)
        yield k, len(chosen) + 1, "greedy", s, score(made), made


def autotune(catalog: Catalog, limit: int = 24) -> Tuned:
    steps = list(autotune_steps(catalog, limit))
    _, n, mode, settings, best, made = max(steps, key=lambda s: s[4])
    return Tuned(made, best, mode, settings, n)


def usable(graph: SchemaGraph) -> bool:
    """Whether there is anything to tune."""
    return bool(graph.catalog.edges)
