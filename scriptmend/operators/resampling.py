"""Differences between two systems with an interval by cluster: exact multinomial resamples of clusters.

Draw j of round b is a 32-bit counter hash of (seed, b, j), so any engine draws alike. With up to ``HELD`` clusters their sums (a
few numbers each) are broadcast, rounds are dealt to tasks in blocks, and a block is one product of its draw counts (rounds by clusters) with the
sums. With more clusters, draws are rows that meet the numbered clusters in a join: the same draws, the same sums.

Defined results: a case that a system has no rank for is a miss; a cluster takes part with all its cases, in its order by name; without cases there is no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

ROUNDS, SEED, HELD, BLOCK = 2000, 42, 1_000_000, 16

_M32 = 0xFFFFFFFF


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 32-bit numbers, held as 64-bit ones."""
    x = (x ^ x >> np.uint64(16)) * np.uint64(0x7FEB352D) & np.uint64(_M32)
    x = (x ^ x >> np.uint64(15)) * np.uint64(0x846CA68B) & np.uint64(_M32)
    return x ^ x >> np.uint64(16)


def draws(b: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The clusters that rounds b draw, rounds by draws, of n (below 2^31)."""
    with np.errstate(over="ignore"):
        of_round = mixed((b.astype(np.uint64) + np.uint64(seed)) & np.uint64(_M32))
        h = mixed(of_round[:, None] + np.arange(n, dtype=np.uint64)[None] & np.uint64(_M32))
        return (h * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _mixed_column(x: Column) -> Column:
    # 32 bits times less than 2^31 fits 63 bits; the larger multiplier goes in two halves
    low = lambda c: c.bitwiseAND(F.lit(_M32))
    x = low(x.bitwiseXOR(F.shiftrightunsigned(x, 16)) * F.lit(0x7FEB352D))
    y = x.bitwiseXOR(F.shiftrightunsigned(x, 15))
    y = low(F.shiftleft(low(y * F.lit(0x846C)), 16) + y * F.lit(0xA68B))
    return y.bitwiseXOR(F.shiftrightunsigned(y, 16))


def _product(batches: Iterator[pa.RecordBatch], sums: np.ndarray, rounds: int, seed: int) -> Iterator[pa.RecordBatch]:
    n = len(sums)
    for batch in batches:
        for block in batch.column(0).to_pylist():
            b = np.arange(block * BLOCK, min(rounds, (block + 1) * BLOCK))
            counts = np.stack([np.bincount(row, minlength=n) for row in draws(b, n, seed)])
            made = counts @ sums
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(made.tolist(), pa.list_(pa.int64()))], names=["b", "s"])


def _numbered(clusters: DataFrame, key: str) -> DataFrame:
    """``clusters`` with number: ranges are counted, then rows within each, so that no task sees all."""
    ranged = written(clusters.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", before)
    return ranged.join(starts, "_p").withColumn("number", F.col("_start") + F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1).drop("_p", "_n", "_start")


def resampled(clusters: DataFrame, key: str, sums: Sequence[str], rounds: int = ROUNDS, seed: int = SEED, held: int = HELD) -> DataFrame:
    """b, s: for each round the sums (an array of longs) over the clusters drawn, as many as there are. ``clusters`` has a row a key."""
    spark, n = clusters.sparkSession, clusters.count()
    if n == 0:
        return spark.createDataFrame([], "b long, s array<long>")
    blocks = spark.range(-(-rounds // BLOCK))
    if n <= held:
        rows = clusters.select(key, *sums).toArrow().sort_by(key)
        table = spark.sparkContext.broadcast(np.stack([rows[c].to_numpy().astype(np.int64) for c in sums], 1))
        return blocks.mapInArrow(lambda it: _product(it, table.value, rounds, seed), "b long, s array<long>")
    drawn = spark.range(rounds * n).select(F.floor(F.col("id") / n).cast("long").alias("b"), (F.col("id") % n).alias("j"))
    h = _mixed_column((_mixed_column((F.col("b") + seed).bitwiseAND(F.lit(_M32))) + F.col("j")).bitwiseAND(F.lit(_M32)))
    met = drawn.select("b", F.shiftrightunsigned(h * n, 32).alias("number")).groupBy("b", "number").agg(F.count(F.lit(1)).alias("times")).join(_numbered(clusters.select(key, *sums), key), "number")
    return met.groupBy("b").agg(F.array(*(F.sum(F.col("times") * F.col(c)) for c in sums)).alias("s"))


def paired_delta(a: DataFrame, b: DataFrame, clusters: DataFrame, cutoffs: Sequence[int] = (1, 5, 10), rounds: int = ROUNDS, seed: int = SEED, held: int = HELD, rank: str = "gold_rank") -> DataFrame:
    """k, n_clusters, n, delta, low, high: points by which top-k of b passes that of a, with the interval that 95 % of resampled clusters give.

    a and b have case_id and the rank, ``clusters`` has case_id and cluster.
    """
    hit = lambda name, k: F.coalesce(F.col(name) < k, F.lit(False)).cast("long")
    met = clusters.join(a.select("case_id", F.col(rank).alias("x")), "case_id", "left").join(b.select("case_id", F.col(rank).alias("y")), "case_id", "left")
    names = [f"d{k}" for k in cutoffs]
    per = written(met.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(hit("y", k) - hit("x", k)).alias(c) for k, c in zip(cutoffs, names, strict=True))))
    sums = resampled(per, "cluster", ["n", *names], rounds, seed, held)
    each = sums.select("b", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.round(100.0 * F.get("s", F.lit(i)) / F.get("s", F.lit(0)), 6).alias("v")) for i, k in enumerate(cutoffs, 1)))).alias("e")).select("b", "e.k", "e.v")
    place = each.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("v", "b")) - 1)
    bounds = place.groupBy("k").agg(F.max(F.when(F.col("r") == int(0.025 * rounds), F.col("v"))).alias("low"), F.max(F.when(F.col("r") == int(0.975 * rounds) - 1, F.col("v"))).alias("high"))
    seen = per.agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).filter("n > 0")
    deltas = seen.select("n_clusters", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.round(100.0 * F.col(c) / F.col("n"), 6).alias("delta")) for k, c in zip(cutoffs, names, strict=True)))).alias("e")).select("e.k", "n_clusters", "n", "e.delta")
    return deltas.join(bounds, "k")
