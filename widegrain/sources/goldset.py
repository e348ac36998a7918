"""Questions with their right answers, from JSON lines or from a workbook with a case on each sheet."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from ..plans.sqlscan import QueryError, scan
from ..types import Catalog


@dataclass(frozen=True)
class Case:
    case_id: str
    subject: str
    question: str
    sql: str
    references: frozenset[tuple[str, str]] = frozenset()


def references_of(spark: SparkSession, sql: str, catalog: Catalog) -> frozenset[tuple[str, str]]:
    """(table, column) that a query over physical tables names, as far as they can be told."""
    try:
        query = scan(spark, sql)
    except QueryError:
        return frozenset()
    out = set()
    for b in query.blocks:
        named = {(r.alias or r.name).lower(): catalog.table(r.name) for r in b.relations}
        for m in b.mentions:
            owners = [named.get(m.parts[-2].lower())] if len(m.parts) > 1 else named.values()
            out |= {(t.name.lower(), m.name.lower()) for t in owners if t is not None and t.column(m.name)}
    return frozenset(out)


def load_jsonl(spark: SparkSession, path: str, catalog: Catalog) -> list[Case]:
    """Lines with case_id, question, sql and, if there is one, subject."""
    rows = [json.loads(x) for x in Path(path).read_text().splitlines() if x.strip()]
    return [Case(r["case_id"], r.get("subject") or r["case_id"].split("_")[0], r["question"], r["sql"], references_of(spark, r["sql"], catalog)) for r in rows]


def load_workbook(spark: SparkSession, path: str, catalog: Catalog) -> list[Case]:
    """Sheets that look like a case: a mark in B2, a question in B3, SQL in row 5."""
    try:
        import openpyxl
    except ImportError as e:
        raise RuntimeError("workbooks need openpyxl; JSON lines do not") from e
    out = []
    for sheet in openpyxl.load_workbook(path, read_only=True, data_only=True).worksheets:
        cells = [[c.value for c in row] for row in sheet.iter_rows(min_row=1, max_row=5, max_col=12)]
        grid = lambda r, c: str(cells[r][c]).strip() if r < len(cells) and c < len(cells[r]) and cells[r][c] is not None else ""  # noqa: B023, E731
        sql = next((x for x in (grid(4, c) for c in range(12)) if re.match(r"(?is)\s*(select|with)\b", x)), "")
        if grid(1, 1) and grid(2, 1) and sql:
            out.append(Case(grid(1, 1), grid(1, 1).split("_")[0], grid(2, 1), sql, references_of(spark, sql, catalog)))
    return out
