"""Bounded results: envelopes by offset, pages by key, named lists."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, MOST = 200, 1000


def clamped(limit: int | None) -> int:
    return LIMIT if limit is None else max(1, min(MOST, limit))


def envelope(df: DataFrame, limit: int | None = None, offset: int = 0) -> dict[str, Any]:
    """items, limit, offset, truncated and, if so, remaining. Rows are only counted where there are more than the page has."""
    n, offset = clamped(limit), max(0, offset)
    rows = df.offset(offset).limit(n + 1).collect()
    out: dict[str, Any] = {"items": [list(r) for r in rows[:n]], "columns": df.columns, "limit": n, "offset": offset, "truncated": len(rows) > n}
    if out["truncated"]:
        out["remaining"] = df.count() - offset - n
    return out


def keyset(df: DataFrame, key: str, limit: int | None = None, cursor: str | None = None) -> dict[str, Any]:
    """items in order of ``key`` after ``cursor``, total (of all pages), truncated and next_cursor."""
    n = clamped(limit)
    rows = (df if cursor is None else df.filter(F.col(key) > cursor)).orderBy(key).limit(n + 1).collect()
    more = len(rows) > n
    return {"items": [r.asDict(True) for r in rows[:n]], "total": df.count(), "truncated": more, "next_cursor": rows[n - 1][key] if more else None}


def page(df: DataFrame, key: str, limit: int | None = None, cursor: str | None = None) -> DataFrame:
    """The same page as a table: its rows, each with total, truncated and next_cursor."""
    n = clamped(limit)
    rest = df if cursor is None else df.filter(F.col(key) > cursor)
    held = rest.orderBy(key).limit(n + 1)
    ends = held.agg(F.count(F.lit(1)).alias("held"), F.max(key).alias("last"))
    first = held.orderBy(key).limit(n)
    facts = df.agg(F.count(F.lit(1)).alias("total")).crossJoin(ends).crossJoin(first.agg(F.max(key).alias("end")))  # one row
    facts = facts.select("total", (F.col("held") > n).alias("truncated"), F.when(F.col("held") > n, F.col("end")).alias("next_cursor"))
    return first.crossJoin(F.broadcast(facts))


def bound_list(df: DataFrame, limit: int | None = None) -> tuple[list[dict[str, Any]], bool, int]:
    """The first items, whether there are more, and how many more."""
    n = clamped(limit)
    rows = df.limit(n + 1).collect()
    more = len(rows) > n
    return [r.asDict(True) for r in rows[:n]], more, df.count() - n if more else 0
