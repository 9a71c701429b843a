"""Context indexes and the lookups over them.

The case side is small and checked before it is broadcast; the index side is keyed by a 64-bit hash of the
context, reduced to keys that occur in the cases before anything is shuffled, and the words themselves are
compared after the join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

WINDOWS = (5, 4, 3, 2)
BROADCAST_ROWS = 2_000_000


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the rows are counted to be few, else the plain side of a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def context_hash(ws: Column, i: Column, width: int) -> Column:
    """Hash of ``width`` words on each side of position i."""
    return F.xxhash64(F.lit(width), *(F.get(ws, i + d) for d in range(-width, width + 1) if d))


def window_keys(docs: DataFrame, keys: Sequence[str], widths: Sequence[int] = WINDOWS, words_col: str = "ws") -> DataFrame:
    """keys, words, pos, w, key of every position with ``w`` words on both sides. Rows share their text's words: ``near_window`` before they are shuffled."""
    n = F.size(words_col)
    one = lambda w: F.when(n > 2 * w, F.transform(F.sequence(F.lit(w), n - w - 1), lambda i: F.struct(F.lit(w).alias("w"), i.alias("pos"), context_hash(F.col(words_col), i, w).alias("key"))))
    every = F.flatten(F.filter(F.array(*(one(w) for w in widths)), lambda a: a.isNotNull()))
    return docs.select(*keys, words_col, F.explode(every).alias("k")).select(*keys, words_col, "k.w", "k.pos", "k.key")


def near_window(df: DataFrame, words_col: str = "ws") -> DataFrame:
    """near: the words of a window, for all words of its text."""
    return df.withColumn("near", F.slice(F.col(words_col), F.col("pos") - F.col("w") + 1, 2 * F.col("w") + 1)).drop(words_col)


def wanted_only(rows: DataFrame, wanted: DataFrame, on: Sequence[str], near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows whose key is wanted, with their own words only. The wanted keys are broadcast if they are few; else rows part with their texts before they are shuffled."""
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return near(rows.join(F.broadcast(wanted), list(on), "left_semi"))
    return near(rows).join(wanted, list(on), "left_semi")


def _spelled(df: DataFrame) -> DataFrame:
    near, w = F.col("near"), F.col("w")
    return df.withColumn("target", F.get(near, w)).withColumn("lctx", F.array_join(F.slice(near, F.lit(1), w), " ")).withColumn("rctx", F.array_join(F.slice(near, w + 2, w), " ")).drop("near")


def parallel_index(docs: DataFrame, cases: DataFrame, group: str, words_col: str = "ws") -> DataFrame:
    """w, lctx, rctx, grp, target, n: the index, over the contexts that some case has."""
    rows = window_keys(docs, [group], words_col=words_col)
    hits = _spelled(wanted_only(rows, cases.select("w", "key").distinct(), ["w", "key"], lambda d: near_window(d, words_col)))
    return hits.groupBy("w", "lctx", "rctx", F.col(group).alias("grp"), "target").agg(F.count(F.lit(1)).alias("n"))


def lookup_cases(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cases at every width: keys, pos, w, key, gold, lctx, rctx. ``cases`` has keys and ws."""
    return _spelled(near_window(window_keys(cases, keys))).withColumnRenamed("target", "gold")


def parallel_lookup(cases: DataFrame, index: DataFrame, keys: Sequence[str], excluded: str | None = None) -> DataFrame:
    """keys, gold, w, predicted, support, n_groups: of the widest window with any hit outside the case's own group, the most frequent target."""
    met = cases.join(index, ["w", "lctx", "rctx"])
    if excluded:
        met = met.filter(F.col("grp") != F.col(excluded))
    by = met.groupBy(*keys, "gold", "w", "target").agg(F.sum("n").alias("support"), F.countDistinct("grp").alias("n_groups"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("w"), F.desc("support"), "target"))
    return by.withColumn("_r", best).filter("_r = 1").select(*keys, "gold", "w", F.col("target").alias("predicted"), "support", "n_groups")


def two_sided_pairs(docs: DataFrame, keys: Sequence[str], words_col: str = "ws", most: int = 2, bound: str | None = None) -> DataFrame:
    """keys, words, pos, a, b, key: every context key of up to ``most`` words a side of every position.

    ``bound`` is an array of booleans, whether a word is bound to the next: then only keys whose words all are.
    """
    ws = F.col(words_col)
    places = F.sequence(F.lit(0), F.size(ws) - 1)
    if bound:
        places = F.filter(places, lambda i: F.coalesce(F.get(bound, i - 1), F.lit(False)) | F.get(bound, i))

    def at(i: Column) -> Column:
        out = []
        for a in range(most + 1):
            for b in range(most + 1):
                if a + b:
                    fits = (i >= a) & (i + b < F.size(ws))
                    for d in range(-a, b) if bound else ():
                        fits = fits & F.get(bound, i + d)
                    out.append(F.when(fits, F.struct(i.alias("pos"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.xxhash64(F.lit(a * 10 + b), *(F.get(ws, i + d) for d in [*range(-a, 0), *range(1, b + 1)])).alias("key"))))
        return F.array(*out)

    every = F.filter(F.flatten(F.transform(places, at)), lambda k: k.isNotNull())
    return docs.filter(F.size(ws) > 0).select(*keys, words_col, F.explode(every).alias("k")).select(*keys, words_col, "k.*")


def near_pair(df: DataFrame, words_col: str = "ws") -> DataFrame:
    """near: the words of a context and the one between, for all words of its text."""
    return df.withColumn("near", F.slice(F.col(words_col), F.col("pos") - F.col("a") + 1, F.col("a") + F.col("b") + 1)).drop(words_col)


def spelled_pairs(df: DataFrame) -> DataFrame:
    near, a, b = F.col("near"), F.col("a"), F.col("b")
    return df.withColumn("target", F.get(near, a)).withColumn("lctx", F.array_join(F.slice(near, F.lit(1), a), " ")).withColumn("rctx", F.array_join(F.slice(near, a + 2, b), " ")).drop("near")


def two_sided_index(docs: DataFrame, wanted: DataFrame, words_col: str = "ws") -> DataFrame:
    """lctx, rctx, a, b, target, n over the context keys in ``wanted`` (column key)."""
    hits = wanted_only(two_sided_pairs(docs, [], words_col), wanted.select("key").distinct(), ["key"], lambda d: near_pair(d, words_col))
    return spelled_pairs(hits).groupBy("lctx", "rctx", "a", "b", "target").agg(F.count(F.lit(1)).alias("n"))


def commonest_contexts(docs: DataFrame, pairs: DataFrame, k: int, words_col: str = "ws", named: int = 4096) -> DataFrame:
    """lctx, rctx, target, n: the ``k`` commonest entries of the whole two-sided index, all positions and sizes.

    ``pairs`` has w1, w2 of all neighbours. No entry is commoner than the rarest pair of neighbours in it, and
    each pair is two entries by itself, so an entry with a pair rarer than the (k / 2)-th commonest is not among
    the ``k`` and need not be made. Where more than ``named`` pairs are that common, every entry is made.
    """
    half = -(-k // 2)
    best = pairs.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(named + half).collect()
    least = best[half - 1]["n"] if len(best) >= half else 0
    common = [f"{r.w1} {r.w2}" for r in best if r["n"] >= least]
    rows, bound = docs.select(words_col), None
    if len(common) <= named:
        bound = "bound"
        rows = rows.withColumn(bound, F.transform(words_col, lambda w, i: F.coalesce(F.concat(w, F.lit(" "), F.get(words_col, i + 1)).isin(common), F.lit(False))))
    index = spelled_pairs(near_pair(two_sided_pairs(rows, [], words_col, bound=bound), words_col)).groupBy("lctx", "rctx", "target").agg(F.count(F.lit(1)).alias("n"))
    return index.orderBy(F.desc("n"), "lctx", "rctx", "target").limit(k)


def retrieval_scores(case_keys: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, candidate, score = max(span + ln(1 + n)), span, hits over the matching keys."""
    met = case_keys.join(index, ["lctx", "rctx", "a", "b"])
    span = F.col("a") + F.col("b") + 1
    return met.groupBy(*keys, F.col("target").alias("candidate")).agg(F.max(span + F.log1p("n")).alias("score"), F.max(span).alias("span"), F.sum("n").alias("hits"))


def prefix_index(docs: DataFrame, wanted: DataFrame, words_col: str = "ws", sizes: Sequence[int] = (2, 3, 4, 5)) -> DataFrame:
    """prefix, size, target, n over the prefixes in ``wanted`` (column key)."""
    hits = wanted_only(prefix_keys(docs, [], words_col, sizes), wanted.select("key").distinct(), ["key"], lambda d: near_prefix(d, words_col))
    near, k = F.col("near"), F.col("size")
    spelled = hits.withColumn("target", F.get(near, k)).withColumn("prefix", F.array_join(F.slice(near, F.lit(1), k), " "))
    return spelled.groupBy("prefix", "size", "target").agg(F.count(F.lit(1)).alias("n"))


def prefix_keys(docs: DataFrame, keys: Sequence[str], words_col: str = "ws", sizes: Sequence[int] = (2, 3, 4, 5)) -> DataFrame:
    """keys, pos, size, key of the ``size`` words before every position that has them, and the words of its text."""
    ws = F.col(words_col)
    one = lambda k: F.when(F.size(ws) > k, F.transform(F.sequence(F.lit(k), F.size(ws) - 1), lambda i: F.struct(i.alias("pos"), F.lit(k).alias("size"), F.xxhash64(F.lit(k), *(F.get(ws, i - d) for d in range(k, 0, -1))).alias("key"))))
    every = F.flatten(F.filter(F.array(*(one(k) for k in sizes)), lambda a: a.isNotNull()))
    return docs.select(*keys, words_col, F.explode(every).alias("k")).select(*keys, words_col, "k.*")


def near_prefix(df: DataFrame, words_col: str = "ws") -> DataFrame:
    """near: the words of a prefix and the one after it, for all words of its text."""
    return df.withColumn("near", F.slice(F.col(words_col), F.col("pos") - F.col("size") + 1, F.col("size") + 1)).drop(words_col)


def backoff_features(cases: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, longest, top_hits, all_hits, log_hits, seen: prefixes of a case that lead to its candidate."""
    met = cases.join(index, (cases.prefix == index.prefix) & (cases.size == index.size) & (cases.candidate == index.target), "left").select(*(cases[k] for k in keys), F.when(index.n.isNotNull(), cases.size).alias("size"), index.n)
    out = met.groupBy(*keys).agg(F.coalesce(F.max("size"), F.lit(0)).alias("longest"), F.coalesce(F.max("n"), F.lit(0)).alias("top_hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_hits"))
    return out.withColumn("log_hits", F.log1p("all_hits")).withColumn("seen", F.col("all_hits") > 0)
