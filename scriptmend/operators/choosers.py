"""Span choosers with tries and a budget: words are chosen by sequential draws that may be turned down, as a fold in one array expression.

A row's draws are hashes of (seed, row, try), so every engine and rerun agrees, and a row is chosen from on its own: nothing is shuffled.
The budget is ``share`` of the words, rounded half to even, one at least. A fold stops choosing when the budget is met; ``tries`` bounds it, and with it the
state, which has at most tries times ``longest`` positions.

Defined results: a row without words, or with gaps only, has no position; a null array is one without words; equal rows with equal keys choose alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking as R
from ..functions import text as X

SHARE, P, LONGEST = 0.15, 0.3, 10


def _draw(seed: str, key: str, t: Column) -> Column:
    return R.hash_unit(F.lit(seed), F.col(key).cast("string"), t.cast("string"))


def _length(seed: str, key: str, t: Column, p: float, longest: int) -> Column:
    """Geometric of parameter p, cut at ``longest``."""
    return F.least(F.lit(longest), 1 + F.floor(F.log(1 - _draw(seed + "-len", key, t)) / math.log(1 - p))).cast("int")


def _budget(n: Column, share: float) -> Column:
    return F.greatest(F.lit(1), F.bround(n * F.lit(share), 0).cast("int"))


def _fold(df: DataFrame, tries: int, merge) -> Column:
    return F.array_sort(F.aggregate(F.sequence(F.lit(1), F.lit(tries)), F.array().cast("array<int>"), merge))


def whole_spans(docs: DataFrame, key: str, share: float = SHARE, p: float = P, longest: int = LONGEST, tries: int = 50, seed: str = "spans", words_col: str = "ws") -> DataFrame:
    """``masked_at``: positions of spans that don't overlap. A span that would meet a chosen one is turned down, one that passes the budget is taken whole."""
    df = docs.withColumn("_n", F.coalesce(F.size(words_col), F.lit(0))).withColumn("_n", F.greatest("_n", F.lit(0))).withColumn("_goal", _budget(F.col("_n"), share))

    def merge(chosen: Column, t: Column) -> Column:
        size = F.least(_length(seed, key, t, p, longest), F.col("_n"))
        start = F.floor(_draw(seed, key, t) * F.greatest(F.lit(1), F.col("_n") - size + 1)).cast("int")
        span = F.sequence(start, start + size - 1)
        return F.when((F.col("_n") == 0) | (F.size(chosen) >= F.col("_goal")) | F.arrays_overlap(chosen, span), chosen).otherwise(F.concat(chosen, span))

    return df.withColumn("masked_at", _fold(df, tries, merge)).drop("_n", "_goal")


def preserved_spans(docs: DataFrame, key: str, share: float = SHARE, p: float = P, longest: int = LONGEST, tries: int = 100, seed: str = "preserved", words_col: str = "ws", gap: str = X.GAP) -> DataFrame:
    """``masked_at``: positions of spans that begin at a word, end before a gap, and stop where the budget, a share of the words that are no gaps, is met; spans may meet."""
    words = F.coalesce(F.col(words_col), F.array().cast("array<string>"))
    df = docs.withColumn("_ws", words).withColumn("_free", F.filter(F.transform("_ws", lambda w, i: F.when(w != gap, i)), lambda i: i.isNotNull())).withColumn("_goal", _budget(F.size("_free"), share))

    def merge(chosen: Column, t: Column) -> Column:
        start = F.get("_free", F.floor(_draw(seed, key, t) * F.size("_free")).cast("int"))
        wanted = F.slice("_ws", start + 1, _length(seed, key, t, p, longest))
        # up to the first gap
        until = F.coalesce(F.nullif(F.array_position(wanted, gap), F.lit(0)) - 1, F.size(wanted)).cast("int")
        new = F.array_except(F.sequence(start, start + until - 1), chosen)
        return F.when((F.size("_free") == 0) | (F.size(chosen) >= F.col("_goal")), chosen).otherwise(F.concat(chosen, F.slice(new, F.lit(1), F.greatest(F.col("_goal") - F.size(chosen), F.lit(0)))))

    return df.withColumn("masked_at", _fold(df, tries, merge)).drop("_ws", "_free", "_goal")
