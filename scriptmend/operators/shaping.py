"""Candidate lists as columns and arrays, snippets, and filters by length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Separates the words or candidates of one cell.
BAR = " | "


def position(values: Column, wanted: Column) -> Column:
    """0-based place of the first equal element, null if there is none."""
    at = F.array_position(values, wanted)
    return F.when(at > 0, (at - 1).cast("int"))


def candidate_lists(rows: DataFrame, case: Sequence[str], k: int, shortest: int = 1) -> DataFrame:
    """case, candidates: the first ``k`` texts of ``shortest`` letters or more by rank, each where it is first seen."""
    first = rows.filter(F.length("candidate") >= shortest).groupBy(*case, "candidate").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy(*case).orderBy("rank", "candidate"))
    kept = first.withColumn("place", place).filter(F.col("place") <= k)
    return kept.groupBy(*case).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "candidate"))), lambda x: x["candidate"]).alias("candidates"))


def wide(values: Column, k: int, prefix: str = "top") -> list[Column]:
    """Columns top1 to topK, empty where the list ends."""
    return [F.coalesce(F.get(values, i), F.lit("")).alias(f"{prefix}{i + 1}") for i in range(k)]


def narrow(columns: Sequence[str]) -> Column:
    """Those columns as an array, without empty and null ones."""
    return F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != ""))


def slot_columns(phrases: Column, slot: int, k: int = 5) -> Column:
    """Words at one place of each phrase, each where it is first seen, ``k`` at most."""
    return F.slice(F.array_distinct(F.filter(F.transform(phrases, lambda p: F.get(F.split(p, " "), F.lit(slot))), lambda w: w.isNotNull())), 1, k)


def snippet(words: Column, at: Column, around: int = 5, mark: tuple[str, str] = ("⟦", "⟧")) -> Column:
    """The word at a place between marks, with up to ``around`` words on each side."""
    begin = F.greatest(at - around, F.lit(0))
    left = F.slice(words, begin + 1, at - begin)
    right = F.slice(words, at + 2, F.lit(around))
    return F.array_join(F.concat(left, F.array(F.concat(F.lit(mark[0]), F.get(words, at), F.lit(mark[1]))), right), " ")


def cell(values: Column) -> Column:
    return F.array_join(values, BAR)


def from_cell(value: Column) -> Column:
    return F.filter(F.split(value, r" \| "), lambda x: x != "")


def item_id(*parts: Column) -> Column:
    return F.concat_ws(":", *(p.cast("string") for p in parts))


def joined_pieces(pieces: Column) -> Column:
    """Sub-word pieces as one word: continuation marks and blanks go."""
    return F.replace(F.replace(pieces, F.lit(" ")), F.lit("##"))


def first_examples(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def exact_length(candidate: Column, gold: Column) -> Column:
    return F.length(candidate) == F.length(gold)


def soft_length(candidate: Column, gold: Column) -> Column:
    return F.length(candidate) >= F.length(gold) - 1


def same_boundaries(candidate: Column, gold: Column) -> Column:
    """Whether both have words of the same lengths in the same order."""
    sizes = lambda p: F.transform(F.split(p, " "), F.length)
    return sizes(candidate) == sizes(gold)


def short_first(top: Column, gold: Column) -> Column:
    return F.length(top) + 1 < F.length(gold)


def informative(values: Column, common: Sequence[str]) -> Column:
    """Without words of the closed list ``common``."""
    return F.filter(values, lambda x: ~x.isin(list(common)))


def kept_window(words: Column, at: Column, around: int, keep) -> tuple[Column, Column]:
    """Words within ``around`` places that ``keep`` takes, the one at ``at`` always; and where that one then stands."""
    begin = F.greatest(at - around, F.lit(0))
    left = F.filter(F.slice(words, begin + 1, at - begin), keep)
    right = F.filter(F.slice(words, at + 2, F.lit(around)), keep)
    return F.concat(left, F.array(F.get(words, at)), right), F.size(left)


def enough_context(words: Column, at: Column, around: int, least: int, keep) -> Column:
    """Whether ``least`` words that ``keep`` takes stand around a place, itself left out."""
    window, _ = kept_window(words, at, around, keep)
    return F.size(window) - 1 >= least


def numbered(rows: DataFrame, group: str, order: Sequence[str | Column], keep: Column, prefix: str = "case-") -> DataFrame:
    """Rows that ``keep`` takes, with row_id, a place from 1 in their group before any was left out, so that numbers have gaps, and case_name, ``prefix`` and a number without gaps."""
    w = Window.partitionBy(group).orderBy(*order)
    kept = rows.withColumn("row_id", F.row_number().over(w)).filter(keep)
    return kept.withColumn("case_name", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(group).orderBy("row_id")).cast("string")))


def segments(words: Column, stride: int = 15) -> Column:
    """Texts of ``stride`` words each, the last shorter."""
    starts = F.sequence(F.lit(1), F.size(words), F.lit(stride))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(stride)), " "))).otherwise(F.array().cast("array<string>"))


def shown_run(left: Column, run: Column, right: Column, mark: tuple[str, str] = ("⟦", "⟧")) -> Column:
    """A run of words between marks, with its contexts; a run without any text is shown as three dots."""
    inner = F.array_join(F.filter(run, lambda w: F.coalesce(w, F.lit("")) != ""), " ")
    shown = F.concat(F.lit(mark[0]), F.when(inner == "", "...").otherwise(inner), F.lit(mark[1]))
    return F.array_join(F.concat(left, F.array(shown), right), " ")


def latest(rows: DataFrame, version: str) -> DataFrame:
    """Rows of the greatest version."""
    return rows.join(F.broadcast(rows.agg(F.max(version).alias(version))), version)
