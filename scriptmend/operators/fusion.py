"""Rescoring and fusing ranked candidates; weights are fitted on a grid by hit rates, earlier cutoffs breaking ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking as R

ABSENT = -0.25


def ranked(rows: DataFrame, case: Sequence[str], score: str = "score") -> DataFrame:
    """rank, 0-based, by score and then text."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*case).orderBy(F.desc(score), "candidate")) - 1)


def with_rank_score(rows: DataFrame, case: Sequence[str]) -> DataFrame:
    return rows.withColumn("rs", R.linear_rank_score(F.col("rank"), F.count(F.lit(1)).over(Window.partitionBy(*case))))


def rank_ensemble(a: DataFrame, b: DataFrame, case: str, weight: Column) -> DataFrame:
    """Full outer join on candidate of linear rank scores; who is absent from a list scores ABSENT there."""
    x = with_rank_score(a, [case]).select(case, "candidate", F.col("rs").alias("x"))
    y = with_rank_score(b, [case]).select(case, "candidate", F.col("rs").alias("y"))
    met = x.join(y, [case, "candidate"], "full_outer")
    return met.withColumn("score", F.round(weight * F.coalesce("x", F.lit(ABSENT)) + (1 - weight) * F.coalesce("y", F.lit(ABSENT)), 6))


def overlap_ensemble(a: DataFrame, b: DataFrame, case: str, top_b: int = 5, top_a: int = 1000) -> DataFrame:
    """Candidates in both lists (the first ``top_a`` of a and ``top_b`` of b) by the mean of min-max scores; b itself where none is."""
    scale = lambda d: d.withColumn("s", R.scaled(F.col("score"), F.min("score").over(Window.partitionBy(case)), F.max("score").over(Window.partitionBy(case))))
    x = scale(a.filter(F.col("rank") < top_a)).select(case, "candidate", F.col("s").alias("x"))
    y = scale(b.filter(F.col("rank") < top_b)).select(case, "candidate", F.col("s").alias("y"))
    both = x.join(y, [case, "candidate"]).select(case, "candidate", F.round((F.col("x") + F.col("y")) / 2, 6).alias("score"))
    return both.unionByName(y.join(both.select(case), case, "left_anti").select(case, "candidate", F.round("y", 6).alias("score")))


def reciprocal_rank_fusion(rows: DataFrame, case: str, k: int = 60) -> DataFrame:
    return rows.groupBy(case, "candidate").agg(F.round(F.sum(R.reciprocal(F.col("rank"), k)), 9).alias("score"))


def gold_ranks(rows: DataFrame, cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, case_id, gold_rank of every case, null where the gold word is no candidate. ``rows`` has by, case_id, candidate, rank."""
    hits = rows.join(cases.select("case_id", "gold"), "case_id").filter("candidate = gold").groupBy(*by, "case_id").agg(F.min("rank").alias("gold_rank"))
    frame = cases.select("case_id")
    if by:
        frame = frame.join(F.broadcast(rows.select(*by).distinct()))
    return frame.join(hits, [*by, "case_id"], "left")


def grid_fit(rows: DataFrame, cases: DataFrame, grid: Sequence[float], score: Column, name: str = "alpha") -> DataFrame:
    """name, top1, top5, top10 and chosen for each grid value: best by top10, top5, top1, then the smallest value.

    ``score`` may use column ``name``. Each row is scored at every grid value in place (an array exploded), the candidates are made once.
    """
    tried = rows.withColumn(name, F.explode(F.array(*(F.lit(float(g)) for g in grid)))).withColumn("score", F.round(score, 6))
    place = ranked(tried.select(name, "case_id", "candidate", "score"), [name, "case_id"])
    rates = gold_ranks(place, cases, [name]).groupBy(name).agg(*(F.round(R.hit_rate(F.col("gold_rank"), k), 4).alias(f"top{k}") for k in (1, 5, 10)))
    best = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("top10"), F.desc("top5"), F.desc("top1"), name))
    return rates.withColumn("chosen", best == 1)


def logistic_rerank(features: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """p: logistic score of fixed weights."""
    z = sum((F.col(c) * w for c, w in weights.items()), F.lit(bias))
    return features.withColumn("p", F.round(R.logistic(z), 6))


def logistic_fit(features: DataFrame, label: str, columns: Sequence[str], c: float = 1.0) -> tuple[dict[str, float], float]:
    """Weights and bias of a logistic model; both labels weigh the same in all, ``c`` is the inverse of the penalty on squared weights."""
    found = features.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("ones")).first()
    n, ones = found["n"], found["ones"] or 0
    if not 0 < ones < n:
        raise ValueError("a fit takes rows of both labels")
    y = F.col(label).cast("double")
    rows = features.select(*columns, y.alias("_y"), F.when(y == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones))).alias("_w"))
    rows = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(rows)
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1 / (c * n), standardization=False, maxIter=1000, tol=1e-10).fit(rows)
    return dict(zip(columns, (float(x) for x in model.coefficients), strict=True)), float(model.intercept)
