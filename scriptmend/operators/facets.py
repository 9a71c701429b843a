"""Filtered, sorted and paged views of case tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

PAGE = 80


def search(rows: DataFrame, equal: Mapping[str, str | None], query: str = "", columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows that equal every given facet (None: any) and whose columns hold the query."""
    tests = [F.col(c) == v for c, v in equal.items() if v is not None]
    if query:
        tests.append(X.contains_all([F.col(c) for c in columns], query))
    return rows.filter(X.all_of(tests))


def page(rows: DataFrame, order: list[Column], number: int, size: int = PAGE) -> DataFrame:
    """The rows of a page, counted from 1 and clamped to those there are, with row_no. Sorts the filtered rows only."""
    total = rows.count()
    last = max(1, -(-total // size))
    number = min(max(1, number), last)
    ordered = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return ordered.withColumn("row_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + (number - 1) * size)


def facet_values(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """facet, value: distinct values over several tables."""
    out = None
    for name, (df, column) in tables.items():
        part = df.select(F.lit(name).alias("facet"), F.col(column).cast("string").alias("value")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def shown_candidates(candidates: Column, gold: Column) -> Column:
    """Candidates of over one letter and of the gold word's length."""
    return F.filter(candidates, lambda c: (F.length(c) > 1) & (F.length(c) == F.length(gold)))


def merged_candidates(constrained: Column, raw: Column, most: int = 8) -> Column:
    return F.slice(F.array_distinct(F.concat(constrained, raw)), 1, most)


#: A missing frequency is the commonest where the rarest come first, and the rarest where they come last.
LAST_RARE, LAST_COMMON = 999_999, -1


def sorted_cases(rows: DataFrame, mode: str, frequency: str, word: str, key: str) -> DataFrame:
    """Rows by frequency (rarity-asc, rarity-desc), by word (alpha), or by key; equals by key."""
    orders = {
        "rarity-asc": [F.coalesce(F.col(frequency), F.lit(LAST_RARE)).asc()],
        "rarity-desc": [F.coalesce(F.col(frequency), F.lit(LAST_COMMON)).desc()],
        "alpha": [F.collate(F.col(word), "UNICODE").asc()],
    }
    return rows.orderBy(*orders.get(mode, []), key)


def worst_first(rows: DataFrame, category: str, frequency: str, gold: str) -> DataFrame:
    """Failures by class, then the rarest first, then by word."""
    return rows.orderBy(category, F.col(frequency).asc_nulls_first(), gold)


def top_sources(rows: DataFrame, source: str, k: int = 10) -> DataFrame:
    """source, n of the ``k`` sources with most rows, equals by name."""
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), source).limit(k)
