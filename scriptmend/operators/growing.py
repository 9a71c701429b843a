"""A beam over pieces whose number of slots grows while it runs.

A case has a slot for each missing word. The first open slot is filled by a piece: one that begins a word closes the slot; one that goes
on with the word before opens a further slot in its place, so that a word takes as many slots as it has pieces. A beam
is done when no slot is open. Slots left are an array of word numbers, pieces placed another, so the frontier has ``width`` rows
a case at most and is cut to that before every join; the model is cut to ``branch`` candidates of a piece before the first.

Defined results: a case without slots is done at once; a case whose last piece the model lacks has no beams; the first piece
placed begins a word, as the word before the gap is known to its end; of equal scores the smaller phrase comes first; after ``rounds``
steps beams that are open still are given as they are, with their number of open slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pieces as P
from .candidates import bigrams
from .tables import written

WIDTH, BRANCH, ROUNDS_A_SLOT = 5, 50, 5


def piece_model(rows: DataFrame, branch: int = BRANCH) -> DataFrame:
    """p1, candidate, score: the ``branch`` likeliest pieces after each, of rows with an array ``pieces``. As many rows as there are pieces, times ``branch``, at most."""
    counts = bigrams(rows, "pieces").groupBy(F.col("w1").alias("p1"), F.col("w2").alias("candidate")).agg(F.count(F.lit(1)).alias("n"))
    scored = counts.filter(f"candidate <> '{P.UNKNOWN}'").select("p1", "candidate", F.round(F.log(F.col("n") / F.sum("n").over(Window.partitionBy("p1"))), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("p1").orderBy(F.desc("score"), "candidate"))
    return scored.withColumn("_r", place).filter(F.col("_r") <= branch).drop("_r")


def _cut(beams: DataFrame, key: str, width: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "phrase")
    return beams.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < width)


def growing_beam(cases: DataFrame, model: DataFrame, key: str = "case_id", width: int = WIDTH, rounds_a_slot: int = ROUNDS_A_SLOT) -> DataFrame:
    """key, phrase, score, n_pieces, n_open, rank of the beams of cases (key, last, slots): the piece before the gap and the number of missing words."""
    most = rounds_a_slot * (cases.agg(F.max("slots")).first()[0] or 0)
    open_ = F.when(F.col("slots") > 0, F.sequence(F.lit(0), F.col("slots") - 1)).otherwise(F.array().cast("array<int>"))
    frontier = cases.select(key, "last", open_.alias("open"), F.array().cast("array<string>").alias("placed"), F.lit(0.0).alias("score"), F.lit("").alias("phrase"), F.lit(0).alias("rank"))
    model = written(model)
    for _ in range(most):
        frontier = written(frontier)
        live = frontier.filter(F.size("open") > 0)
        if live.isEmpty():
            break
        met = live.join(model.select(F.col("p1").alias("last"), "candidate", F.col("score").alias("step")), "last").withColumn("on", F.col("candidate").startswith(P.GOES_ON))
        met = met.filter(~F.col("on") | (F.size("placed") > 0))
        rest = F.slice("open", F.lit(2), F.greatest(F.size("open") - 1, F.lit(0)))
        step = met.select(key, F.col("candidate").alias("last"), F.when(F.col("on"), F.concat(F.array(F.get("open", F.lit(0))), rest)).otherwise(rest).alias("open"), F.concat("placed", F.array("candidate")).alias("placed"), F.round(F.col("score") + F.col("step"), 6).alias("score"))
        grown = step.withColumn("phrase", P.joined(F.col("placed"))).unionByName(frontier.filter(F.size("open") == 0).drop("rank"))
        frontier = _cut(grown, key, width)
    return frontier.select(key, "phrase", "score", F.size("placed").alias("n_pieces"), F.size("open").alias("n_open"), "rank")
