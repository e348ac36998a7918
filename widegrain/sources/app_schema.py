"""Catalogues of schemas that applications carry with them: SQLite files and schema.rb files of Rails."""

from __future__ import annotations

import re
import sqlite3
from contextlib import closing

from ..naming import singular
from ..types import Catalog
from .jdbc import assemble

_TABLES = "FROM sqlite_master m {} WHERE m.type = 'table' AND m.name NOT LIKE 'sqlite\\_%' ESCAPE '\\'"
#: What assemble() asks for, read through SQLite's table functions.
SQLITE = {
    "columns": f"SELECT m.name, c.name, c.type, NOT c.\"notnull\", '' {_TABLES.format('JOIN pragma_table_info(m.name) c')} ORDER BY m.name, c.cid",
    "keys": f"SELECT m.name, c.name {_TABLES.format('JOIN pragma_table_info(m.name) c')} AND c.pk > 0 ORDER BY m.name, c.pk",
    "edges": f"SELECT m.name || f.id, m.name, f.\"from\", f.\"table\", f.\"to\", f.seq {_TABLES.format('JOIN pragma_foreign_key_list(m.name) f')} ORDER BY m.name, f.id, f.seq",
    "names": f"SELECT m.name {_TABLES.format('')}",
}


def read_sqlite(path: str, *, frame=None) -> Catalog:
    """Tables, keys, references and row counts of a SQLite file.

    A reference that names no columns leads to its target's primary key.  The
    catalogue alone is read; frame gives the supplier of a table's rows."""
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        found = {n: db.execute(q).fetchall() for n, q in SQLITE.items()}
        counts = [(n, db.execute('SELECT COUNT(*) FROM "{}"'.format(n.replace('"', '""'))).fetchone()[0], "") for (n,) in found["names"]]
    named = {n.lower(): n for (n,) in found["names"]}
    primary: dict[str, list[str]] = {}
    for table, column in found["keys"]:
        primary.setdefault(table, []).append(column)
    edges = []
    for name, child, column, target, to, place in found["edges"]:
        parent = named.get(target.lower(), target)
        key = primary.get(parent, [])
        if to or place < len(key):
            edges.append((name, child, column, parent, to or key[place]))
    return assemble(found["columns"], found["keys"], edges, counts, frame=frame)


_TABLE = re.compile(r'^\s*create_table\s+"([^"]+)"([^\n]*?)\s+do\s*\|t\|(.*?)^\s*end\b', re.S | re.M)
_COLUMN = re.compile(r'^\s*t\.(\w+)\s+"([^"]+)"([^\n]*)', re.M)
_REFERENCE = re.compile(r'^\s*add_foreign_key\s+"([^"]+)",\s*"([^"]+)"([^\n]*)', re.M)
# Lines of a table that declare no column.
_NO_COLUMNS = ("index", "check_constraint", "unique_constraint", "exclusion_constraint", "foreign_key")


def _option(text: str, name: str) -> str | None:
    found = re.search(rf'\b{name}:\s*(?:"([^"]*)"|:?(\w+))', text)
    return found and (found[1] or found[2])


def _declared(kind: str, options: str) -> str:
    precision = _option(options, "precision")
    return f"{kind}({precision},{_option(options, 'scale') or 0})" if kind in ("decimal", "numeric") and precision else kind


def read_rails(text: str) -> Catalog:
    """Tables, keys and references of a schema.rb file.

    A table has a key column id unless it names other key columns or says id:
    false.  A reference without a column follows the convention: the target's
    name in the singular and _id; references whose tables or column the file
    doesn't have are left out.  Types that Spark doesn't know are read as text."""
    columns, keys, edges = [], [], []
    for name, options, body in _TABLE.findall(text):
        several = re.search(r"primary_key:\s*\[([^\]]*)\]", options)
        key = re.findall(r'"([^"]+)"', several[1]) if several else [_option(options, "primary_key") or "id"]
        own = [(name, column, _declared(kind, rest), "null: false" not in rest, _option(rest, "comment") or "") for kind, column, rest in _COLUMN.findall(body) if kind not in _NO_COLUMNS]
        if _option(options, "id") != "false":
            if not several:
                kind = _option(options, "id") or "bigint"
                own.insert(0, (name, key[0], kind, False, ""))
            keys += [(name, column) for column in key]
        columns += own
    known = {(table, column) for table, column, *_ in columns}
    for k, (child, parent, options) in enumerate(_REFERENCE.findall(text)):
        column = _option(options, "column") or f"{singular(parent)}_id"
        target = _option(options, "primary_key") or "id"
        if (child, column) in known and (parent, target) in known:
            edges.append((str(k), child, column, parent, target))
    return assemble(columns, keys, edges, [])


def read_rails_file(path: str) -> Catalog:
    with open(path, encoding="utf-8") as f:
        return read_rails(f.read())
