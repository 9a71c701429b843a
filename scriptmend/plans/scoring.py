"""Queries over scorers: the counts of Kneser-Ney bigrams, perplexity, and metrics and beams that run on either scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import fusion, metrics, scorers
from .base import BIGRAMS, CASES, DOCS, ITEMS, cases, docs, hits, items

_K, _WIDTH = 20, 3


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return C.bigrams(docs(spark, sf))


def kneser_ney_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every word: how often it has a word after it, how many different ones, and how many different ones it has before it."""
    model = scorers.KneserNey(_pairs(spark, sf))
    met = model.contexts.withColumnRenamed("w1", "word").join(model.before.withColumnRenamed("w2", "word"), "word", "full_outer")
    return met.select("word", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kinds", "before")))


def kneser_ney_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    """Mean log probability of each item's words by the words before them, and of each word by both neighbours; perplexity of the first."""
    own = cases(spark, sf).select("item", "lw", "rw", F.col("gold").alias("candidate"))
    model = scorers.KneserNey(_pairs(spark, sf))
    lp = model.probabilities(own.select(F.col("lw").alias("w1"), F.col("candidate").alias("w2")))
    rows = model.scored(own).join(lp, (F.col("lw") == F.col("w1")) & (F.col("candidate") == F.col("w2")))
    return rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lp"), 6).alias("mean_log"), F.round(F.avg("score"), 6).alias("mean_both"), F.round(F.exp(-F.avg("lp")), 3).alias("perplexity"))


def scorer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of the gold words under each scorer."""
    c, pairs = cases(spark, sf), _pairs(spark, sf)
    rows = None
    for name, scorer in (("neighbours", scorers.Neighbours(pairs)), ("kneser_ney", scorers.KneserNey(pairs))):
        part = scorer.candidates(c, _K).withColumn("scorer", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return metrics.summary(fusion.gold_ranks(rows, c, ["scorer"]), ["scorer"])


def kneser_ney_beam(spark: SparkSession, sf: str) -> DataFrame:
    """The second and third word of each item, left to right, by Kneser-Ney scores."""
    model = scorers.KneserNey(_pairs(spark, sf))
    own = items(spark, sf).filter(F.size("ws") > 2).select("item_id", F.get("ws", F.lit(0)).alias("lw"))
    first = model.model(own.select(F.col("lw").alias("w1")), 10)
    second = model.model(first.select(F.col("candidate").alias("w1")), 10)
    return C.beam(own, first.unionByName(second).distinct(), "item_id", 2, _WIDTH).select("item_id", "phrase", "score", "rank")


_KN = f"""WITH {DOCS}, {ITEMS}, {CASES}, {BIGRAMS}, bg AS (SELECT w1, w2, count(*) AS n FROM bigrams GROUP BY ALL),
cx AS (SELECT w1, sum(n)::BIGINT AS total, count(*) AS kinds FROM bg GROUP BY w1), ct AS (SELECT w2, count(*) AS before FROM bg GROUP BY w2),
k AS (SELECT CASE WHEN count(*) FILTER (n = 1) = 0 THEN 0.75::DOUBLE ELSE count(*) FILTER (n = 1) / (count(*) FILTER (n = 1) + 2 * count(*) FILTER (n = 2)) END AS d, count(*) + ((SELECT count(*) FROM ct) + 1) / 2 AS mass FROM bg)"""


def _lp(rows: str, w1: str, w2: str, name: str) -> str:
    """name: all columns of ``rows`` with lp, the logarithm of P(w2 | w1)."""
    low = "(coalesce(before, 0) + 0.5) / mass"
    return f"{name} AS (SELECT r.*, ln(coalesce(greatest(coalesce(bg.n, 0) - d, 0) / total + d * kinds / total * {low}, {low})) AS lp FROM {rows} r LEFT JOIN bg ON bg.w1 = r.{w1} AND bg.w2 = r.{w2} LEFT JOIN cx ON cx.w1 = r.{w1} LEFT JOIN ct ON ct.w2 = r.{w2}, k)"


_NEIGHBOURS = "nx AS (SELECT w1, w2 AS candidate, row_number() OVER (PARTITION BY w1 ORDER BY round(ln(n / total), 6) DESC, w2) - 1 AS rank FROM bg JOIN cx USING (w1) QUALIFY rank < 20)"
_BOTH = f"""a AS (SELECT w1, w2 AS candidate FROM bg QUALIFY row_number() OVER (PARTITION BY w1 ORDER BY n DESC, w2) <= 20), b AS (SELECT w2, w1 AS candidate FROM bg QUALIFY row_number() OVER (PARTITION BY w2 ORDER BY n DESC, w1) <= 20),
pool AS (SELECT case_id, lw, rw, candidate FROM cases JOIN a ON w1 = lw UNION SELECT case_id, lw, rw, candidate FROM cases JOIN b ON w2 = rw), {_lp("pool", "lw", "candidate", "p1")}, {_lp("(SELECT case_id, candidate, rw, lp AS x FROM p1)", "candidate", "rw", "p2")},
both_ranked AS (SELECT case_id, candidate, row_number() OVER (PARTITION BY case_id ORDER BY round(x + lp, 6) DESC, candidate) - 1 AS rank FROM p2 QUALIFY rank < 20)"""
_SUMMARY = f"count(*) AS n, {hits()}, round(100.0 * count(gold_rank) / count(*), 4) AS coverage, median(gold_rank) AS median_rank, round(avg(coalesce(1.0 / (gold_rank + 1), 0)), 6) AS mrr"

QUERIES = {
    "kneser_ney_counts": (kneser_ney_counts, f"{_KN} SELECT coalesce(w1, w2) AS word, coalesce(total, 0) AS total, coalesce(kinds, 0) AS kinds, coalesce(before, 0) AS before FROM cx FULL JOIN ct ON w1 = w2"),
    "kneser_ney_perplexity": (kneser_ney_perplexity, f"{_KN}, {_lp('cases', 'lw', 'gold', 'l1')}, {_lp('(SELECT item, gold, rw, lp AS x FROM l1)', 'gold', 'rw', 'l2')} SELECT item, count(*) AS n, round(avg(x), 6) AS mean_log, round(avg(round(x + lp, 6)), 6) AS mean_both, round(exp(-avg(x)), 3) AS perplexity FROM l2 GROUP BY item"),
    "scorer_metrics": (scorer_metrics, f"{_KN}, {_NEIGHBOURS}, {_BOTH}, u AS (SELECT 'neighbours' AS scorer, case_id, candidate, rank FROM cases JOIN nx ON w1 = lw UNION ALL SELECT 'kneser_ney', * FROM both_ranked), h AS (SELECT scorer, case_id, min(rank) AS gold_rank FROM u JOIN cases USING (case_id) WHERE candidate = gold GROUP BY ALL), z AS (SELECT scorer, case_id FROM cases, (SELECT DISTINCT scorer FROM u)) SELECT scorer, {_SUMMARY} FROM z LEFT JOIN h USING (scorer, case_id) GROUP BY scorer"),
    "kneser_ney_beam": (kneser_ney_beam, f"""{_KN}, top AS (SELECT w1, w2 FROM bg QUALIFY row_number() OVER (PARTITION BY w1 ORDER BY n DESC, w2) <= 10), {_lp("top", "w1", "w2", "tp")}, m AS (SELECT w1, w2 AS candidate, round(lp, 6) AS score FROM tp),
s AS (SELECT item_id, ws[1] AS lw FROM items WHERE len(ws) > 2),
b1 AS (SELECT item_id, candidate AS phrase, candidate AS last, score AS total FROM s JOIN m ON lw = w1 WHERE candidate <> lw QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, candidate) <= 3),
b2 AS (SELECT item_id, phrase || ' ' || candidate AS phrase, round(total + score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(total + score, 6) DESC, phrase || ' ' || candidate) - 1 AS rank FROM b1 JOIN m ON last = w1 WHERE candidate <> last QUALIFY rank < 3) SELECT * FROM b2"""),
}
