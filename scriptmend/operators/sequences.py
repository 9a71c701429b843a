"""Operators over ordered words: tokens, runs, chunks, segments, spans, context windows.

Whatever fits one row's array is done there, without a shuffle; windows over rows are used where rows come
one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("ws", X.words(F.col(text_col)))


def tokens(docs: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """A row per word: keys, 0-based pos, word."""
    return with_words(docs, text_col).select(*keys, F.posexplode("ws").alias("pos", "word"))


def islands(rows: DataFrame, keys: Sequence[str], order: str, state: str, out: str = "island") -> DataFrame:
    """Number, from 0, of the run of equal ``state`` that a row is in."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(0))
    return rows.withColumn("_c", changed).withColumn(out, F.sum("_c").over(w)).drop("_c")


def runs(rows: DataFrame, keys: Sequence[str], order: str, state: str) -> DataFrame:
    """Gaps and islands: keys, run_index, state, first, last, n of each run."""
    found = islands(rows, keys, order, state).groupBy(*keys, F.col("island").alias("run_index"), state)
    return found.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def array_runs(docs: DataFrame, keys: Sequence[str], is_gap: Column | None = None, words_col: str = "ws") -> DataFrame:
    """Runs of gap words inside each row's word array, without a shuffle: keys, gap_index, first, n.

    A word is a gap if it has at most two letters, unless ``is_gap`` gives an array of flags.
    """
    flags = is_gap if is_gap is not None else F.transform(words_col, lambda w: F.length(w) <= 2)
    df = docs.withColumn("_f", flags)
    starts = F.filter(F.transform("_f", lambda f, i: F.when(f & ~F.coalesce(F.get("_f", i - 1), F.lit(False)), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform("_f", lambda f, i: F.when(f & ~F.coalesce(F.get("_f", i + 1), F.lit(False)), i)), lambda i: i.isNotNull())
    zipped = F.arrays_zip(starts.alias("first"), ends.alias("last"))
    return df.select(*keys, F.posexplode(zipped).alias("gap_index", "r")).select(*keys, "gap_index", F.col("r.first").alias("first"), (F.col("r.last") - F.col("r.first") + 1).alias("n"))


def chunks(rows: DataFrame, keys: Sequence[str], order: str, kept: Column, size: int = 128, least: int = 20) -> DataFrame:
    """Tumbling chunks of ``size`` units; those with under ``least`` kept units go, the others keep their index."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    cut = rows.withColumn("chunk_index", F.floor(at / size)).groupBy(*keys, "chunk_index")
    return cut.agg(F.count(F.lit(1)).alias("n_units"), F.count_if(kept).alias("n_kept")).filter(F.col("n_kept") >= least)


def array_chunks(docs: DataFrame, keys: Sequence[str], size: int = 128, least: int = 20, words_col: str = "ws") -> DataFrame:
    """The same over word arrays, row by row: keys, chunk_index, n_units, n_kept (words of over two letters)."""
    n = F.size(words_col)
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda k: F.slice(F.col(words_col), k * size + 1, size)))
    cut = docs.select(*keys, F.posexplode(parts).alias("chunk_index", "unit"))
    return cut.select(*keys, "chunk_index", F.size("unit").alias("n_units"), F.size(F.filter("unit", lambda w: F.length(w) > 2)).alias("n_kept")).filter(F.col("n_kept") >= least)


def spans(docs: DataFrame, keys: Sequence[str], longest: int = 3, around: int = 8, most_chars: int = 18, words_col: str = "ws") -> DataFrame:
    """All stretches of 1 to ``longest`` words with ``around`` words on each side and at most ``most_chars`` characters."""
    n, ws = F.size(words_col), F.col(words_col)
    one = lambda k: F.when(n >= 2 * around + k, F.transform(F.sequence(F.lit(around), n - around - k), lambda i: F.struct(F.lit(k).alias("n_words"), i.alias("start"), F.array_join(F.slice(ws, i + 1, F.lit(k)), " ").alias("gold"))))
    every = F.flatten(F.filter(F.array(*(one(k) for k in range(1, longest + 1))), lambda a: a.isNotNull()))
    return docs.select(*keys, F.explode(every).alias("s")).select(*keys, "s.*").filter(F.length("gold") <= most_chars)


def nearby(order: str, keys: Sequence[str], value: Column, width: int) -> Column:
    """Values within ``width`` rows on both sides, in order, clipped at the ends."""
    return F.collect_list(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-width, width))


def contiguous_context(ws: Column, at: Column, most: int = 2) -> tuple[Column, Column]:
    """Up to ``most`` words on each side of a position that no gap separates from it."""
    left, right = F.array().cast("array<string>"), F.array().cast("array<string>")
    open_l, open_r = F.lit(True), F.lit(True)
    for k in range(1, most + 1):
        word = F.get(ws, at - k)
        open_l = open_l & F.coalesce((word != X.GAP) & (word != ""), F.lit(False))
        left = F.when(open_l, F.concat(F.array(word), left)).otherwise(left)
        word = F.get(ws, at + k)
        open_r = open_r & F.coalesce((word != X.GAP) & (word != ""), F.lit(False))
        right = F.when(open_r, F.concat(right, F.array(word))).otherwise(right)
    return left, right


def context_keys(left: Column, right: Column) -> Column:
    """Every (last l words, first r words) with l + r > 0, l first."""
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.size(left)), lambda a: F.transform(F.sequence(F.lit(0), F.size(right)), lambda b: F.struct(F.slice(left, F.size(left) - a + 1, a).alias("l"), F.slice(right, F.lit(1), b).alias("r")))))
    return F.filter(pairs, lambda p: F.size(p["l"]) + F.size(p["r"]) > 0)


def ngrams(ws: Column, n: int) -> Column:
    """n-word stretches; none where there are fewer words."""
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.slice(ws, i, n))).otherwise(F.array().cast("array<array<string>>"))


def strided_spans(docs: DataFrame, keys: Sequence[str], sizes: Sequence[int] = (1, 2, 3, 4, 6), around: int = 5, step: int = 5, words_col: str = "ws") -> DataFrame:
    """keys, start, n_words, gold of a scan that looks for a span of each size at a position, moves on by ``step`` where it found any, by one where not.

    A span counts if its words have two letters or more and ``around`` words stand on each side. Where the scan
    goes next depends on what it found, so it runs in Python, row by row, in Arrow batches.
    """
    def scan(words: list[str]) -> list[tuple[int, int]]:
        out, i, n = [], around, len(words)
        while i < n - around:
            found = [(i, k) for k in sizes if i + k + around <= n and all(len(w) >= 2 for w in words[i : i + k])]
            out += found
            i += step if found else 1
        return out

    @F.pandas_udf("array<struct<start:int,n_words:int>>")
    def scanned(column: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "n_words": k} for a, k in scan(list(w))] for w in column])

    rows = docs.select(*keys, words_col, F.explode(scanned(F.col(words_col))).alias("s")).select(*keys, words_col, "s.*")
    return rows.withColumn("gold", F.array_join(F.slice(F.col(words_col), F.col("start") + 1, F.col("n_words")), " ")).drop(words_col)
