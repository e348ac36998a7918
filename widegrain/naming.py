"""How fields are named after tables and columns."""

from __future__ import annotations

# Fixed values.
UNCHANGED_PLURALS = frozenset("series species news data metadata media sales means".split())
PLURAL_ENDINGS = (("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("ses", "s"))
NOT_PLURAL = ("ss", "us", "is")
ROLE_SUFFIXES = ("_id", "_cd", "_code", "_key", "_no", "_num", "_fk")


def singular(name: str) -> str:
    word = name.lower()
    if word in UNCHANGED_PLURALS or word.split("_")[-1] in UNCHANGED_PLURALS:
        return word
    for many, one in PLURAL_ENDINGS:
        if word.endswith(many):
            return word.removesuffix(many) + one
    return word[:-1] if word.endswith("s") and not word.endswith(NOT_PLURAL) else word


def plural(name: str) -> str:
    return name.lower() if name.lower().endswith("s") else name.lower() + "s"


def aliases(name: str) -> set[str]:
    return {name.lower(), singular(name), plural(name)}


def without_suffix(column: str, suffixes=ROLE_SUFFIXES) -> str | None:
    """What is left of a key column's name, or None if it has no key suffix."""
    word = column.lower()
    return next((word[: -len(s)] for s in suffixes if word.endswith(s) and len(word) > len(s)), None)


def role_of(columns: tuple[str, ...], *tables: str) -> str | None:
    """The role that a single key column names, unless it only repeats a table's name."""
    if len(columns) != 1:
        return None
    role = without_suffix(columns[0])
    return None if role in {singular(t) for t in tables} else role


def prefixed(prefix: str, column: str) -> str:
    word = column.lower()
    return column if word == prefix or word.startswith(prefix + "_") else f"{prefix}_{column}"
