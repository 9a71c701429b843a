"""Beams over two missing words, as joins with the candidate relation of the word on either side.

``after`` (w1, candidate, score) has the candidates that follow a word, ``before`` (w2, candidate, score) those that
precede one. ``cases`` has case_id, lw and rw: the words before the first and after the second missing word.
Phrases are ranked by their rounded score, then by text. A beam keeps ``width`` of them a step, so that
every join makes ``width`` times the candidates of one word for a case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _best(rows: DataFrame, width: int, score: str = "score") -> DataFrame:
    order = Window.partitionBy("case_id").orderBy(F.desc(F.round(score, 6)), "phrase")
    return rows.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < width)


def _first(cases: DataFrame, model: DataFrame, word: str, given: str, width: int) -> DataFrame:
    """case_id, lw, rw, phrase, score: the best candidates of one missing word by one of its neighbours."""
    met = cases.join(model, cases[word] == model[given]).select("case_id", "lw", "rw", F.col("candidate").alias("phrase"), "score")
    return _best(met, width).drop("rank")


def _phrase(rows: DataFrame, width: int) -> DataFrame:
    return _best(rows, width).select("case_id", "phrase", F.round("score", 6).alias("score"), "rank")


def independent(cases: DataFrame, after: DataFrame, before: DataFrame, width: int = 3) -> DataFrame:
    """Both words from their own lists, whatever the other is."""
    left = _first(cases, after, "lw", "w1", width).select("case_id", F.col("phrase").alias("x"), F.col("score").alias("sx"))
    right = _first(cases, before, "rw", "w2", width).select("case_id", F.col("phrase").alias("y"), F.col("score").alias("sy"))
    met = left.join(right, "case_id").select("case_id", F.concat_ws(" ", "x", "y").alias("phrase"), (F.col("sx") + F.col("sy")).alias("score"))
    return _phrase(met, width)


def _forward(firsts: DataFrame, after: DataFrame, extra: Column | None = None) -> DataFrame:
    """The second word by the first."""
    met = firsts.join(after.select("w1", "candidate", F.col("score").alias("step")), firsts.phrase == F.col("w1"))
    return met.select("case_id", F.concat_ws(" ", "phrase", "candidate").alias("phrase"), (F.col("score") + F.col("step") + (extra if extra is not None else F.lit(0.0))).alias("score"))


def _backward(seconds: DataFrame, before: DataFrame) -> DataFrame:
    """The first word by the second."""
    met = seconds.join(before.select("w2", "candidate", F.col("score").alias("step")), seconds.phrase == F.col("w2"))
    return met.select("case_id", F.concat_ws(" ", "candidate", "phrase").alias("phrase"), (F.col("score") + F.col("step")).alias("score"))


def easy_first(cases: DataFrame, after: DataFrame, before: DataFrame, width: int = 3) -> DataFrame:
    """The word whose best candidate scores higher is filled first (of equals the first), the other by it."""
    left, right = _first(cases, after, "lw", "w1", width), _first(cases, before, "rw", "w2", width)
    top = lambda rows, name: rows.groupBy("case_id").agg(F.max("score").alias(name))
    side = top(left, "x").join(top(right, "y"), "case_id", "full_outer").select("case_id", (F.coalesce("x", F.lit(-1e9)) >= F.coalesce("y", F.lit(-1e9))).alias("forward"))
    ahead = _forward(left.join(side.filter("forward"), "case_id", "left_semi"), after)
    back = _backward(right.join(side.filter(~F.col("forward")), "case_id", "left_semi"), before)
    return _phrase(ahead.unionByName(back), width)


def with_retrieval(cases: DataFrame, after: DataFrame, triples: DataFrame, alpha: float = 0.5, width: int = 3) -> DataFrame:
    """Left to right; a step adds ``alpha`` * ln(1 + n) for the times that the corpus has the word after the two before it, predicted ones included.

    ``triples`` (w0, w1, candidate, n).
    """
    firsts = _first(cases, after, "lw", "w1", width)
    met = firsts.join(after.select("w1", "candidate", F.col("score").alias("step")), firsts.phrase == F.col("w1"))
    t = triples.select(F.col("w0").alias("lw"), "w1", "candidate", "n")
    met = met.join(t, ["lw", "w1", "candidate"], "left")
    return _phrase(met.select("case_id", F.concat_ws(" ", "phrase", "candidate").alias("phrase"), (F.col("score") + F.col("step") + alpha * F.log1p(F.coalesce("n", F.lit(0)))).alias("score")), width)


def with_pattern(cases: DataFrame, after: DataFrame, pattern: Column, width: int = 3) -> DataFrame:
    """Left to right; only candidates that ``pattern`` (over p1, p2 of the case and candidate, step) takes. ``cases`` has first and second: the known letter that each word begins with."""
    firsts = cases.join(after, cases.lw == after.w1).filter(F.left("candidate", F.lit(1)) == F.col("first"))
    firsts = _best(firsts.select("case_id", "second", F.col("candidate").alias("phrase"), "score"), width).drop("rank")
    met = firsts.join(after.select("w1", "candidate", F.col("score").alias("step")), firsts.phrase == F.col("w1")).filter(pattern)
    return _phrase(met.select("case_id", F.concat_ws(" ", "phrase", "candidate").alias("phrase"), (F.col("score") + F.col("step")).alias("score")), width)
