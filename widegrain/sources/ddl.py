"""Schemas as DDL: CREATE TABLE with keys, ALTER TABLE with foreign keys; and back."""

from __future__ import annotations

import re
from pathlib import Path

from ..types import Catalog, ColumnDef, Edge, TableDef, parse_type

_TOKEN = re.compile(r"""--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"[^"]*"|`[^`]*`|\[[^\]]*\]|[A-Za-z_][\w$#]*|\d+(?:\.\d+)?|[(),.;]|\S""", re.S)
_CONSTRAINTS = {"PRIMARY", "FOREIGN", "CONSTRAINT", "UNIQUE", "CHECK", "KEY", "INDEX", "EXCLUDE"}
_AFTER_TYPE = {"PRIMARY", "NOT", "NULL", "DEFAULT", "REFERENCES", "UNIQUE", "CHECK", "CONSTRAINT", "COMMENT", "COLLATE", "GENERATED", "IDENTITY", "AUTO_INCREMENT"}


def _unquote(token: str) -> str:
    return token[1:-1] if token[:1] in "\"`[" else token


class _Reader:
    def __init__(self, text: str):
        self.tokens = [t for t in _TOKEN.findall(text) if not t.startswith(("--", "/*"))]
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def word(self, ahead: int = 0) -> str:
        return self.peek(ahead).upper()

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ""

    def skip(self, *words: str) -> bool:
        if all(self.word(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def name(self) -> tuple[str | None, str]:
        """(schema, table)."""
        parts = [_unquote(self.take())]
        while self.peek() == ".":
            self.take()
            parts.append(_unquote(self.take()))
        return (parts[-2] if len(parts) > 1 else None), parts[-1]

    def names(self) -> tuple[str, ...]:
        out = []
        if self.peek() == "(":
            self.take()
            while self.peek() and self.peek() != ")":
                t = self.take()
                if t != "," and t.upper() not in ("ASC", "DESC"):
                    out.append(_unquote(t))
            self.take()
        return tuple(out)

    def group(self) -> None:
        """Pass over a bracketed group."""
        depth = 0
        while self.peek():
            t = self.take()
            depth += (t == "(") - (t == ")")
            if depth == 0:
                return

    def to_end(self, *ends: str) -> None:
        while self.peek() and self.peek() not in ends:
            self.group() if self.peek() == "(" else self.take()


def read_ddl(text: str) -> Catalog:
    """Tables and keys of a script; other statements are passed over, keys to unknown tables dropped."""
    r = _Reader(text)
    tables: dict[str, TableDef] = {}
    keys: list[tuple[str, tuple[str, ...], str, tuple[str, ...]]] = []
    comments: dict[tuple[str, str | None], str] = {}
    while r.peek():
        if r.skip("CREATE", "TABLE"):
            r.skip("IF", "NOT", "EXISTS")
            schema, name = r.name()
            if r.peek() == "(":
                tables[name.lower()] = _create(r, schema, name, keys)
        elif r.skip("ALTER", "TABLE"):
            r.skip("ONLY")
            _, name = r.name()
            while r.peek() and r.peek() != ";":
                if r.skip("FOREIGN", "KEY"):
                    keys.append((name, r.names(), *_references(r)))
                else:
                    r.take()
        elif r.skip("COMMENT", "ON", "TABLE"):
            _, name = r.name()
            if r.skip("IS"):
                comments[name.lower(), None] = r.take()[1:-1].replace("''", "'")
        elif r.skip("COMMENT", "ON", "COLUMN"):
            table, column = r.name()
            if r.skip("IS"):
                comments[(table or "").lower(), column.lower()] = r.take()[1:-1].replace("''", "'")
        r.to_end(";")
        r.take()
    out = []
    for t in tables.values():
        columns = tuple(ColumnDef(c.name, c.dtype, c.nullable, comments.get((t.name.lower(), c.name.lower()), c.comment)) for c in t.columns)
        out.append(TableDef(t.name, columns, t.primary_key, t.schema, comments.get((t.name.lower(), None), t.comment)))
    edges = []
    for child, cols, parent, to in keys:
        target = tables.get(parent.lower())
        to = to or (target.primary_key if target else ())
        if target is not None and child.lower() in tables and len(to) == len(cols):
            edges.append(Edge(tables[child.lower()].name, cols, target.name, to))
    return Catalog(tuple(out), tuple(edges))


def read_ddl_file(path: str) -> Catalog:
    return read_ddl(Path(path).read_text())


def _references(r: _Reader) -> tuple[str, tuple[str, ...]]:
    r.skip("REFERENCES")
    _, parent = r.name()
    return parent, r.names()


def _create(r: _Reader, schema: str | None, name: str, keys: list) -> TableDef:
    r.take()
    columns, primary = [], ()
    while r.peek() and r.peek() != ")":
        if r.word() in _CONSTRAINTS and not (r.word() in ("KEY", "INDEX") and r.word(1) not in ("(",)):
            if r.skip("CONSTRAINT"):
                r.take()
            if r.skip("PRIMARY", "KEY"):
                while r.peek() not in ("(", ""):
                    r.take()
                primary = r.names()
            elif r.skip("FOREIGN", "KEY"):
                keys.append((name, r.names(), *_references(r)))
            r.to_end(",", ")")
        else:
            column = _unquote(r.take())
            declared = []
            while r.peek() and r.peek() not in (",", ")") and r.word() not in _AFTER_TYPE:
                if r.peek() == "(":
                    start = r.at
                    r.group()
                    declared.append("".join(r.tokens[start : r.at]))
                else:
                    declared.append(r.take())
            nullable, comment = True, ""
            while r.peek() and r.peek() not in (",", ")"):
                if r.skip("PRIMARY", "KEY"):
                    primary, nullable = (column,), False
                elif r.skip("NOT", "NULL"):
                    nullable = False
                elif r.skip("COMMENT"):
                    comment = r.take()[1:-1]
                elif r.word() == "REFERENCES":
                    keys.append((name, (column,), *_references(r)))
                elif r.peek() == "(":
                    r.group()
                else:
                    r.take()
            columns.append(ColumnDef(column, parse_type(" ".join(declared)), nullable, comment))
        if r.peek() == ",":
            r.take()
    r.take()
    return TableDef(name, tuple(columns), primary, schema)


def write_ddl(catalog: Catalog) -> str:
    """A script that read_ddl() reads back."""
    quote = lambda n: f'"{n}"'
    text = lambda s: "'" + s.replace("'", "''") + "'"
    out = []
    for t in catalog.tables:
        lines = [f"  {quote(c.name)} {c.dtype.simpleString()}{'' if c.nullable else ' NOT NULL'}" for c in t.columns]
        if t.primary_key:
            lines.append(f"  PRIMARY KEY ({', '.join(map(quote, t.primary_key))})")
        out.append(f"CREATE TABLE {quote(t.name)} (\n" + ",\n".join(lines) + "\n);")
        if t.comment:
            out.append(f"COMMENT ON TABLE {quote(t.name)} IS {text(t.comment)};")
        out += [f"COMMENT ON COLUMN {quote(t.name)}.{quote(c.name)} IS {text(c.comment)};" for c in t.columns if c.comment]
    for e in catalog.edges:
        if not e.condition and not e.key_exprs:
            out.append(f"ALTER TABLE {quote(e.child)} ADD FOREIGN KEY ({', '.join(map(quote, e.child_cols))}) REFERENCES {quote(e.parent)} ({', '.join(map(quote, e.parent_cols))});")
    return "\n".join(out)
