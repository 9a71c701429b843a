"""Leakage-controlled splits and seeded samples, by hash, so that every engine and rerun agrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, *parts: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts)))


def group_split(groups: DataFrame, key: str, seed: int = 0, heldout: float = 0.3, dev: float = 0.2) -> DataFrame:
    """key, split: at least one held-out group, then at least one of the rest for development."""
    n = groups.select(key).distinct()
    ranked = n.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(hash_order(seed, key), key)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    n_held = F.greatest(F.lit(1), F.floor(F.col("_n") * heldout))
    n_dev = F.greatest(F.lit(1), F.floor((F.col("_n") - n_held) * dev))
    return ranked.select(key, F.when(F.col("_r") < n_held, "heldout").when(F.col("_r") < n_held + n_dev, "dev").otherwise("train").alias("split"))


#: Other names of splits.
ALIASES = {"test": ("heldout",), "final": ("heldout",), "heldout": ("heldout",), "train": ("train",), "dev": ("dev",), "fit": ("train", "dev"), "train+dev": ("train", "dev"), "all": ("train", "dev", "heldout")}


def in_split(df: DataFrame, name: str, column: str = "split") -> DataFrame:
    if name not in ALIASES:
        raise ValueError(f"unknown split: {name}")
    return df.filter(F.col(column).isin(*ALIASES[name]))


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows of each stratum, or all it has; all where ``n`` is not positive."""
    if n <= 0:
        return rows
    r = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(seed, key), key))
    return rows.withColumn("_r", r).filter(F.col("_r") <= n).drop("_r")


def greedy_disjoint(spans: DataFrame, group: str, size: str, order: Sequence[str], n: int, longest: int = 3, seed: int = 0) -> DataFrame:
    """``n`` spans of each size, longest first, at most one of a group in all."""
    taken = None
    for k in range(longest, 0, -1):
        own = spans.filter(F.col(size) == k)
        if taken is not None:
            own = own.join(taken.select(group), group, "left_anti")
        own = own.withColumn("_h", hash_order(seed, group, *order))
        own = own.withColumn("_g", F.row_number().over(Window.partitionBy(group).orderBy("_h", *order))).filter("_g = 1")
        own = own.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_h", group))).filter(F.col("_r") <= n).drop("_g", "_r", "_h")
        taken = own if taken is None else taken.unionByName(own)
    return taken


def overlaps(split: DataFrame, key: str) -> DataFrame:
    """pair, n_common of the three pairs of splits: zero everywhere if they are disjoint."""
    a, b = split.select(key, F.col("split").alias("a")), split.select(key, F.col("split").alias("b"))
    pairs = split.sparkSession.createDataFrame([("dev", "heldout"), ("dev", "train"), ("heldout", "train")], "a string, b string")
    met = a.join(b, key).filter("a < b").groupBy("a", "b").agg(F.countDistinct(key).alias("n"))
    return pairs.join(met, ["a", "b"], "left").select(F.concat_ws("|", "a", "b").alias("pair"), F.coalesce("n", F.lit(0)).cast("long").alias("n_common"))
