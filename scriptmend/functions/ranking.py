"""Scores, buckets and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CUTOFFS = (1, 5, 10, 20)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where there is none."""
    return F.coalesce(F.try_divide(100.0 * part, whole.cast("double")), F.lit(0.0))


def hit_rate(rank: Column, k: int) -> Column:
    """Share of all rows, misses among them, whose 0-based rank is under ``k``."""
    return percent(F.count_if(rank < k), F.count(F.lit(1)))


def gap_bucket(n: Column) -> Column:
    return F.when(n <= 3, n.cast("string")).when(n <= 5, "4-5").otherwise("6+")


def rarity(n: Column) -> Column:
    """A missing frequency counts as common."""
    return F.when(n == 0, "unseen").when(n <= 3, "rare").when(n <= 20, "medium").otherwise("common")


def linear_rank_score(rank: Column, n: Column) -> Column:
    return 1 - rank / F.greatest(F.lit(1), n - 1)


def reciprocal(rank: Column, k: int = 60) -> Column:
    return 1.0 / (k + rank)


def scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max; 1 where all are equal."""
    return F.when(high == low, 1.0).otherwise((value - low) / (high - low))


def smoothed_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 0.5)) + 1


def log_tf(tf: Column) -> Column:
    return 1 + F.log(tf.cast("double"))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) that any engine gives alike: the first 8 hex digits of the parts' MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson_one(u: Column) -> Column:
    """Poisson draws of mean 1 by inversion, up to 6."""
    out, total, term = F.lit(7), 0.0, 2.718281828459045**-1
    cuts = []
    for k in range(7):
        total += term
        cuts.append((k, total))
        term /= k + 1
    for k, cut in reversed(cuts):
        out = F.when(u < cut, F.lit(k)).otherwise(out)
    return out
