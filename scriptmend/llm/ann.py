"""Nearest neighbours by an inverted multi-index.

A vector is cut in two halves, each quantised by a codebook of its own (k-means on a bounded sample, at most
``sample`` rows by hash order); the pair of centroids is its cell. A query walks the pairs in order of
summed distance, by a heap, until the cells it has passed hold ``visit`` of all entries and ``k`` besides the
query's own; the entries of those cells are then ranked by exact distance in double precision. A table of up to
``k`` + 1 different vectors is searched whole.

Rows of equal vectors are folded first: of each vector only the ``k`` + 1 smallest ids can appear in any
result, so that a vector that fills a third of the table costs one entry. A cell of many entries is cut into
blocks by hash, each searched by a task of its own that keeps only its ``k`` best per query. What goes to
the driver is the codebooks and the cells' counts, ``centroids`` squared at most.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part; so do
those of another length than most sampled ones; ties go to the smaller id; repeated rows count once; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

CENTROIDS, SAMPLE, VISIT, BLOCK = 32, 20_000, 0.55, 4096


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm from a seeded choice of points; an empty cluster keeps its centroid."""
    points = np.unique(x, axis=0)
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = assign(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T


def assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return distances(x, centres).argmin(1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """Pairs of centroids by growing sum of their distances (a heap over both sorted lists), until their cells hold ``wanted`` entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        n = int(counts[a[i], b[j]])
        if n:
            out.append((int(a[i]), int(b[j])))
            held += n
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(a) and v < len(b) and (u, v) not in seen:
                seen.add((u, v))
                heapq.heappush(heap, (first[a[u]] + second[b[v]], u, v))
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id long, v array<double>) of the vectors that take part; a repeated row once."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(fine)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _cells(batches: Iterator[pa.RecordBatch], books: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    half, k = books[0].shape[1], len(books[1])
    for batch in batches:
        x = _matrix(batch.column("v"))
        cell = assign(x[:, :half], books[0]) * k + assign(x[:, half:], books[1]) if len(x) else np.empty(0, int)
        yield batch.append_column("cell", pa.array(cell, pa.int32()))


def _probes(batches: Iterator[pa.RecordBatch], books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, visit: float, block: int, least: int) -> Iterator[pa.RecordBatch]:
    half, wanted = books[0].shape[1], max(visit * counts.sum(), least)
    for batch in batches:
        x = _matrix(batch.column("v"))
        rows, cells, blocks = [], [], []
        if len(x):
            first, second = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
            for r in range(len(x)):
                for i, j in walk(first[r], second[r], counts, wanted):
                    n = -(-int(counts[i, j]) // block)
                    rows += [r] * n
                    cells += [i * len(books[1]) + j] * n
                    blocks += range(n)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("v").take(at), pa.array(cells, pa.int32()), pa.array(blocks, pa.int32())], names=["query_id", "q", "cell", "block"])


def _best(queries: pa.Table, entries: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest of a block's entries for each of its queries; an entry stands for the ids that share its vector."""
    out: list[tuple[int, int, float]] = []
    if queries.num_rows and entries.num_rows:
        x = _matrix(entries.column("v").combine_chunks())
        ids = entries.column("ids").to_pylist()
        firsts = np.array([i[0] for i in ids])
        for query, q in zip(queries.column("query_id").to_pylist(), _matrix(queries.column("q").combine_chunks()), strict=True):
            d = np.sqrt(((x - q) ** 2).sum(1))
            near = np.lexsort((firsts, d))[: k + 1] if len(d) <= 4 * k else None
            if near is None:
                edge = np.partition(d, k)[k]
                near = np.flatnonzero(d <= edge)
            found = sorted((float(d[e]), i) for e in near for i in ids[e] if i != query)[:k]
            out += [(query, i, s) for s, i in found]
    cols = list(zip(*out, strict=True)) or [[], [], []]
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = CENTROIDS, sample: int = SAMPLE, visit: float = VISIT, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each query row, its own id left out."""
    spark = vectors.sparkSession
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    rows = usable(vectors, id_col, vector_col)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"]
    widths = [len(v) for v in drawn]
    width = max(sorted(set(widths)), key=widths.count) if widths else 0
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.array([v for v in drawn if len(v) == width])
    half = max(1, width // 2)
    books = (kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids) if width > half else np.zeros((1, 0)))
    fit = F.size("v") == width
    # of equal vectors the k + 1 smallest ids are enough: partial minima, salted by id, before they meet
    salted = rows.filter(fit).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    least = lambda c: F.slice(F.array_distinct(F.sort_array(c)), 1, k + 1)
    some = salted.groupBy("v", "salt").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select("v", F.slice("ids", 1, k + 1).alias("ids"))
    folded = some.groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))
    schema = T.StructType([*folded.schema.fields, T.StructField("cell", T.IntegerType())])
    entries = materialize(folded.mapInArrow(lambda it: _cells(it, books), schema), "entries")
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for cell, n in entries.groupBy("cell").count().collect():
        counts[cell // len(books[1]), cell % len(books[1])] = n
    placed = entries.join(F.broadcast(spark.createDataFrame([(int(c), int(-(-n // block))) for c, n in enumerate(counts.ravel()) if n], "cell int, blocks int")), "cell")
    placed = placed.select("ids", "v", "cell", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.col("blocks")).cast("int").alias("block"))
    asked = usable(queries, id_col, vector_col).filter(fit).dropDuplicates(["vec_id"])
    probes = asked.mapInArrow(lambda it: _probes(it, books, counts, visit, block, k + 1), "query_id long, q array<double>, cell int, block int")
    near = probes.groupBy("cell", "block").cogroup(placed.groupBy("cell", "block")).applyInArrow(lambda q, e: _best(q, e, k), out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
