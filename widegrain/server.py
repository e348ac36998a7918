"""The engine over HTTP: JSON in and out, progress of tuning as lines of JSON.  For demonstration, not for open networks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import SparkSession

from .engine import WideLayer
from .plans.compose import ComposeOptions
from .plans.expand import ExpansionError
from .plans.fold import Fold, fold, fold_star
from .plans.select import Policy, explicit
from .plans.tune import autotune_steps, curve, knee
from .reports.quality import compression, fidelity, lineage_graph
from .reports.text import render_report, render_text
from .sources.ddl import read_ddl, write_ddl
from .sources.layer_file import to_dict
from .t2sql.engine import GenerationError, TextToSQL, checking_executor
from .types import Catalog

#: Rows that an answer shows.
SHOWN_ROWS = 50
SAMPLE = """CREATE TABLE customers (id bigint PRIMARY KEY, name varchar(100));
CREATE TABLE orders (id bigint PRIMARY KEY, customer_id bigint REFERENCES customers (id), total numeric(12,2), placed_at timestamp);
CREATE TABLE order_items (id bigint PRIMARY KEY, order_id bigint REFERENCES orders (id), quantity integer, line_total numeric(12,2));"""


@dataclass
class App:
    """sources: catalogues by name; complete: a language model for questions, if there is one; cases: a gold set."""

    spark: SparkSession | None = None
    sources: dict[str, Catalog] = field(default_factory=dict)
    complete: Callable[[str], str] | None = None
    cases: list = field(default_factory=list)

    def _catalog(self, body: dict) -> Catalog:
        if body.get("source"):
            if body["source"] not in self.sources:
                raise ValueError(f"unknown source {body['source']}; known: {', '.join(self.sources)}")
            return self.sources[body["source"]]
        return read_ddl(body.get("ddl") or SAMPLE)

    def _fold(self, body: dict) -> Fold:
        catalog = self._catalog(body)
        mode = body.get("anchor_mode", "auto")
        if mode in ("mixed", "dim", "fact"):
            return fold_star(catalog, anchors=mode, prompt_budget=body.get("prompt_budget"))
        options = ComposeOptions(max_hops=body.get("max_hops", 3), field_budget=body.get("field_budget", 200), prompt_budget=body.get("prompt_budget"), expose_child_filters=body.get("filters", True))
        policy = Policy(body.get("coverage", 0.9), body.get("min_gain", 2), body.get("max_cost", 10.0), body.get("max_models"))
        return fold(catalog, options, policy, selector=(lambda c: explicit(c, body["anchors"])) if body.get("anchors") else None)

    def _wide(self, body: dict) -> WideLayer:
        if self.spark is None:
            raise ValueError("no session: queries can't be read")
        made = self._fold(body)
        return WideLayer(self.spark, made.layer, made.graph)

    # --- requests -------------------------------------------------------------

    def sample(self, body: dict) -> Any:
        return {"ddl": SAMPLE}

    def list_sources(self, body: dict) -> Any:
        return {"sources": [{"name": n, "tables": len(c.tables)} for n, c in self.sources.items()]}

    def fold(self, body: dict) -> Any:
        made = self._fold(body)
        f = fidelity(made.layer, made.graph)
        return {
            "layer": to_dict(made.layer),
            "report": render_report(made.layer),
            "prompt": render_text(made.layer),
            "ddl": write_ddl(made.graph.catalog),
            "profiles": [{"table": p.name, "role": p.role.value, "score": p.score} for p in made.profiles],
            "fidelity": {"columns": f.column_retention, "joins": f.join_absorption, "pairs": f.pair_answerability, "groupable": f.table_groupability},
            "compression": compression(made.layer),
            "lineage": lineage_graph(made.layer, made.graph),
        }

    def expand(self, body: dict) -> Any:
        e = self._wide(body).expand(body["sql"], body.get("dialect", "spark"))
        return {"sql": e.sql, "warnings": e.warnings, "joins_emitted": e.joins_emitted, "joins_pruned": e.joins_pruned}

    def query(self, body: dict) -> Any:
        rows = self._wide(body).query(body["sql"]).limit(SHOWN_ROWS).collect()
        return {"rows": [r.asDict() for r in rows]}

    def chat_capability(self, body: dict) -> Any:
        return {"chat": self.complete is not None, "execute": self.spark is not None and bool(self.sources)}

    def goldset(self, body: dict) -> Any:
        return {"cases": len(self.cases)}

    def curve(self, body: dict) -> Any:
        points = curve(self._catalog(body), self.cases)
        best = knee(points)
        return {"points": [p.__dict__ for p in points], "knee": best.budget if best else None}

    def autotune(self, body: dict) -> Iterator[dict]:
        best = None
        for k, n, mode, settings, score, _ in autotune_steps(self._catalog(body), body.get("limit", 24)):
            best = max(best or (score, mode, settings), (score, mode, settings), key=lambda x: x[0])
            yield {"step": k, "of": n, "mode": mode, "settings": settings, "score": score}
        yield {"best": {"score": best[0], "mode": best[1], "settings": best[2]}}

    def chat(self, body: dict) -> Any:
        if self.complete is None:
            raise ValueError("no language model is configured")
        wide = self._wide(body)
        live = bool(body.get("source"))
        try:
            out = TextToSQL(wide, self.complete, execute=checking_executor(wide) if live else None).generate(body["question"])
        except GenerationError as e:
            return {"ok": False, "error": str(e), "calls": e.result.calls}
        answer = {"ok": True, "model": out.model, "sql": out.sql, "expanded": out.expanded, "repairs": out.repairs, "warnings": out.warnings}
        return answer | ({"rows": [r.asDict() for r in wide.query(out.sql).limit(SHOWN_ROWS).collect()]} if live else {})


ROUTES = {
    ("GET", "/api/sample"): App.sample,
    ("GET", "/api/sources"): App.list_sources,
    ("GET", "/api/chat-capability"): App.chat_capability,
    ("GET", "/api/goldset"): App.goldset,
    ("POST", "/api/fold"): App.fold,
    ("POST", "/api/expand"): App.expand,
    ("POST", "/api/query"): App.query,
    ("POST", "/api/curve"): App.curve,
    ("POST", "/api/autotune"): App.autotune,
    ("POST", "/api/chat"): App.chat,
}


def respond(app: App, method: str, path: str, body: dict) -> tuple[int, Iterator[str]]:
    """(status, pieces of the reply)."""
    found = ROUTES.get((method, path.split("?")[0]))
    if found is None:
        return 404, iter([json.dumps({"error": f"no {method} {path}"})])
    try:
        out = found(app, body)
        if isinstance(out, Iterator):
            return 200, (json.dumps(x, default=str) + "\n" for x in out)
        return 200, iter([json.dumps(out, default=str)])
    except (ExpansionError, ValueError, KeyError) as e:
        return 400, iter([json.dumps({"error": str(e)})])


def serve(app: App, port: int = 8000) -> ThreadingHTTPServer:
    """A server on this machine's own address; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, pieces = respond(app, method, self.path, json.loads(self.rfile.read(size) or b"{}"))
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            for p in pieces:
                self.wfile.write(p.encode())
                self.wfile.flush()

        def do_GET(self) -> None:
            self._reply("GET")

        def do_POST(self) -> None:
            self._reply("POST")

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
