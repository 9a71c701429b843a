"""Near-duplicates within a case's list of candidates, and reranking for diversity.

Candidates are alike by the letter pairs of ``^word$``: shared pairs over all pairs of the two. A list is its first
``depth`` candidates, an array a case, so each step is an array expression and only lists are shuffled. Candidates or
scores that are null take no part; repeated rows count as often as they stand; cases without candidates have no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def letter_pairs(word: Column) -> Column:
    marked = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.substring(marked, i, 2)))


def likeness(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def lists(rows: DataFrame, case: Sequence[str], depth: int = 20) -> DataFrame:
    """case, list: the first ``depth`` candidates by rank, each with its letter pairs."""
    kept = rows.filter(F.col("candidate").isNotNull() & F.col("score").isNotNull() & (F.col("rank") < depth))
    told = F.array_sort(F.collect_list(F.struct("rank", "candidate", "score")))
    pairs = F.transform("list", lambda x: F.struct(x["rank"].alias("rank"), x["candidate"].alias("candidate"), x["score"].alias("score"), letter_pairs(x["candidate"]).alias("pairs")))
    return kept.groupBy(*case).agg(told.alias("list")).select(*case, pairs.alias("list"))


def diverse(told: DataFrame, case: Sequence[str], k: int = 5, weight: float = 0.7) -> DataFrame:
    """``lists`` cut to ``k`` by marginal relevance: each step takes the candidate of most ``weight`` times its share less ``1 - weight`` times its likeness to the nearest taken, ties by the old order. Scores are logarithms of shares."""
    at, item = F.sequence(F.lit(0), F.size("list") - 1), F.col("list")

    def step(taken: Column, _: Column) -> Column:
        def worth(i: Column) -> Column:
            nearest = F.coalesce(F.array_max(F.transform(taken, lambda j: likeness(item[i]["pairs"], item[j]["pairs"]))), F.lit(0.0))
            share = F.lit(weight) * F.round(F.exp(item[i]["score"]), 6)
            return F.struct((share - F.lit(round(1 - weight, 10)) * nearest).alias("v"), (-i).alias("i"))

        left = F.filter(at, lambda i: ~F.array_contains(taken, i))
        return F.concat(taken, F.array(-F.array_max(F.transform(left, worth))["i"]))

    order = F.aggregate(F.slice(at, 1, k), F.array().cast("array<int>"), step)
    return told.select(*case, F.transform(order, lambda i: item[i]).alias("list"))


def rates(told: DataFrame, by: Sequence[str], k: int = 5, near: float = 0.5) -> DataFrame:
    """by, n_lists, n_pairs, near_rate, mean_distance over pairs within the first ``k`` of each list: percent of likeness ``near`` or more, and mean of one less the likeness; null where no list has two."""
    first = told.select(*by, F.slice("list", 1, k).alias("list"))
    pairs = F.flatten(F.transform("list", lambda x, i: F.transform(F.slice("list", F.lit(1), i), lambda y: likeness(x["pairs"], y["pairs"]))))
    own = first.withColumn("s", pairs).select(*by, F.size("s").alias("n"), F.size(F.filter("s", lambda x: x >= near)).alias("m"), F.aggregate("s", F.lit(0.0), lambda a, x: a + 1 - x).alias("d"))
    n = F.sum("n")
    some = F.when(n > 0, n)
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("n_lists"), n.alias("n_pairs"), F.round(100 * F.sum("m") / some, 4).alias("near_rate"), F.round(F.sum("d") / some, 6).alias("mean_distance"))
