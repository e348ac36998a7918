"""Grades the rows of a written query by the rows that were wanted.

Each side is summed up by one aggregation: how many rows, the total of all
numbers, and a digest that doesn't depend on the order of rows.  Rows are never
brought to the driver."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Totals that differ by less are equal; totals within this share of the wanted one are close.
EQUAL_WITHIN, CLOSE_WITHIN = 0.1, 0.05
EXACT, CLOSE, PARTIAL, EXECUTED, FAILED = "EXACT_VALUE_MATCH", "CLOSE_VALUE_MATCH", "PARTIAL_ROW_MATCH", "EXEC_SUCCESS", "FAIL"
#: Decimals that fractions keep in the digest; sums in another order differ in later ones.
DIGITS = 4


class Figures(NamedTuple):
    n_rows: int
    total: float
    digest: str


class Grade(NamedTuple):
    verdict: str
    wanted_rows: int
    got_rows: int
    wanted_total: float
    got_total: float
    same_rows: bool
    error: str


def _number(c: Column, dtype: T.DataType) -> Column | None:
    """A column's finite numbers, also those written as text with commas; None for other kinds."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        found = c.cast("double")
    elif isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        found = F.regexp_replace(c, ",", "").try_cast("double")
    else:
        return None
    return F.when(F.abs(found) < float("inf"), found)


def figures_of(df: DataFrame) -> DataFrame:
    """One row: n_rows, total (two decimals) and digest; columns count by their place, whatever their names."""
    places = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    fields = [(F.col(f.name), f.dataType) for f in places.schema]
    numbers = [F.coalesce(x, F.lit(0.0)) for c, t in fields if (x := _number(c, t)) is not None]
    shown = [(F.round(c.cast("double"), DIGITS) + 0.0).cast("string") if isinstance(t, (T.NumericType, T.BooleanType)) else c.cast("string") for c, t in fields]
    row = F.to_json(F.array(*shown)) if shown else F.lit("")
    return places.select(sum(numbers, F.lit(0.0)).alias("numbers"), F.xxhash64(row).cast("decimal(38,0)").alias("digest")).agg(
        F.count("*").alias("n_rows"), F.round(F.coalesce(F.sum("numbers"), F.lit(0.0)), 2).alias("total"), F.coalesce(F.sum("digest"), F.lit(0)).cast("string").alias("digest")
    )


def judge(wanted: Figures, got: Figures) -> str:
    apart = abs(wanted.total - got.total)
    if wanted.n_rows == got.n_rows and (not wanted.n_rows or apart < EQUAL_WITHIN):
        return EXACT
    if min(wanted.total, got.total) > 0 and apart < CLOSE_WITHIN * max(1.0, wanted.total):
        return CLOSE
    return PARTIAL if got.n_rows else EXECUTED


def grade(wanted: DataFrame, written: Callable[[], DataFrame]) -> Grade:
    """The grade of a query's rows; a query that can't be read or run fails with the error's text.

    same_rows says whether both sides are the same rows, repeats included, which
    a match of totals alone doesn't."""
    want = Figures(*figures_of(wanted).first())
    try:
        got = Figures(*figures_of(written()).first())
    except (PySparkException, ValueError) as e:
        return Grade(FAILED, want.n_rows, 0, want.total, 0.0, False, str(e))
    return Grade(judge(want, got), want.n_rows, got.n_rows, want.total, got.total, (want.n_rows, want.digest) == (got.n_rows, got.digest), "")
