"""Scorers: what gives a case (case_id, lw, rw: the words before and after a missing one) its candidates with scores.

Every scorer has ``candidates(cases, k)``: case_id, candidate, score, rank (0-based, by score, then text), and ``model(words, k)``: w1,
candidate, score of words (w1), which beams over several words take. Metrics and beams don't know which scorer they run on.

``Neighbours`` sees one side: the share of a word after the word before. ``KneserNey`` sees both, by interpolated Kneser-Ney bigrams:

    P(w | u) = max(n(u, w) - D, 0) / n(u) + D * kinds(u) / n(u) * P(w)        P(w) = (before(w) + 1/2) / (types + (V + 1) / 2)

with D from the numbers of bigrams seen once and twice, kinds(u) the number of words seen after u, before(w) that of words seen before w,
types that of bigrams and V that of words with a word before them; a half goes to each word, and one to all unseen ones. Its counts are relations, made once.
``Worker`` wraps any model that lives in a Python worker.

Defined results: a word never seen before another is followed by P(w); a neighbour that is null is a word never seen; repeated cases are scored each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import candidates as C
from .context import maybe_broadcast
from .fusion import ranked
from .tables import written


class Scorer(Protocol):
    def candidates(self, cases: DataFrame, k: int) -> DataFrame: ...

    def model(self, words: DataFrame, k: int) -> DataFrame: ...


class Neighbours:
    """The share of a word among those after the word before."""

    def __init__(self, pairs: DataFrame) -> None:
        self.pairs = pairs

    def model(self, words: DataFrame, k: int) -> DataFrame:
        return C.neighbour_model(self.pairs, "w1", "w2", words, k).drop("rank")

    def candidates(self, cases: DataFrame, k: int) -> DataFrame:
        own = C.neighbour_model(self.pairs, "w1", "w2", cases.select(F.col("lw").alias("w1")), k)
        return cases.join(own, cases.lw == own.w1).select("case_id", "candidate", "score", "rank")


class KneserNey:
    """Interpolated Kneser-Ney bigrams; ``pool`` candidates of each side are scored by both."""

    def __init__(self, pairs: DataFrame, pool: int = 20) -> None:
        self.pool = pool
        self.counts = written(pairs.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")))
        self.contexts = written(self.counts.groupBy("w1").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")))
        self.before = written(self.counts.groupBy("w2").agg(F.count(F.lit(1)).alias("before")))
        once, twice, self.types = self.counts.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.count(F.lit(1))).first()
        self.discount = once / (once + 2 * twice) if once else 0.75
        self.words = self.before.count()

    def _lowest(self, before: Column) -> Column:
        return (F.coalesce(before, F.lit(0)) + 0.5) / (self.types + (self.words + 1) / 2)

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """w1, w2, lp: the logarithm of P(w2 | w1) of the distinct pairs that are asked for."""
        met = asked.select("w1", "w2").distinct().join(self.counts, ["w1", "w2"], "left").join(self.contexts, "w1", "left").join(self.before, "w2", "left")
        seen = F.greatest(F.coalesce("n", F.lit(0)) - F.lit(self.discount), F.lit(0.0)) / F.col("total") + F.lit(self.discount) * F.col("kinds") / F.col("total") * self._lowest(F.col("before"))
        return met.select("w1", "w2", F.log(F.coalesce(seen, self._lowest(F.col("before")))).alias("lp"))

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` (lw, rw, candidate, ...) with score: log P(candidate | lw) + log P(rw | candidate)."""
        asked = rows.select(F.col("lw").alias("w1"), F.col("candidate").alias("w2")).unionByName(rows.select(F.col("candidate").alias("w1"), F.col("rw").alias("w2")))
        known = written(self.probabilities(asked.filter("w1 is not null and w2 is not null")))
        left, right = known.select(F.col("w1").alias("lw"), F.col("w2").alias("candidate"), F.col("lp").alias("x")), known.select(F.col("w1").alias("candidate"), F.col("w2").alias("rw"), F.col("lp").alias("y"))
        unseen = F.log(self._lowest(F.lit(0)))
        met = rows.join(left, ["lw", "candidate"], "left").join(right, ["candidate", "rw"], "left")
        return met.select(*rows.columns, F.round(F.coalesce("x", unseen) + F.coalesce("y", unseen), 6).alias("score"))

    def _best(self, given: str, wanted: str, words: DataFrame, k: int) -> DataFrame:
        """given, candidate: the ``k`` words most often seen beside each word."""
        own = self.counts.join(maybe_broadcast(words.distinct()), given, "left_semi")
        place = F.row_number().over(Window.partitionBy(given).orderBy(F.desc("n"), wanted))
        return own.withColumn("_r", place).filter(F.col("_r") <= k).select(given, F.col(wanted).alias("candidate"))

    def model(self, words: DataFrame, k: int) -> DataFrame:
        best = self._best("w1", "w2", words, k)
        lp = self.probabilities(best.withColumnRenamed("candidate", "w2"))
        return lp.select("w1", F.col("w2").alias("candidate"), F.round("lp", 6).alias("score"))

    def candidates(self, cases: DataFrame, k: int) -> DataFrame:
        own = cases.select("case_id", "lw", "rw")
        after = self._best("w1", "w2", own.select(F.col("lw").alias("w1")), self.pool).withColumnRenamed("w1", "lw")
        before = self._best("w2", "w1", own.select(F.col("rw").alias("w2")), self.pool).withColumnRenamed("w2", "rw")
        pool = written(own.join(after, "lw").select("case_id", "lw", "rw", "candidate").unionByName(own.join(before, "rw").select("case_id", "lw", "rw", "candidate")).distinct())
        return ranked(self.scored(pool), ["case_id"]).filter(F.col("rank") < k).select("case_id", "candidate", "score", "rank")


#: Models that this Python worker has made, by name: they outlive tasks.
_MADE: dict[str, Any] = {}


class Worker:
    """A scorer whose model is a Python object: ``make()`` is called once a worker and gives an object with ``score(cases, k)``, from a pandas frame of cases to one of case_id, candidate and score. ``name`` tells models apart."""

    def __init__(self, name: str, make: Callable[[], Any], columns: tuple[str, ...] = ("lw", "rw")) -> None:
        self.name, self.make, self.columns = name, make, columns

    def candidates(self, cases: DataFrame, k: int) -> DataFrame:
        name, make = self.name, self.make

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from scriptmend.operators.scorers import _MADE

            if name not in _MADE:
                _MADE[name] = make()
            for frame in frames:
                yield _MADE[name].score(frame, k)[["case_id", "candidate", "score"]]

        said = cases.select(F.col("case_id").cast("long").alias("case_id"), *self.columns).mapInPandas(run, "case_id long, candidate string, score double")
        return ranked(said.withColumn("score", F.round("score", 6)), ["case_id"]).filter(F.col("rank") < k)

    def model(self, words: DataFrame, k: int) -> DataFrame:
        """Words as cases without a word after them, numbered by hash."""
        cases = words.distinct().select(F.xxhash64("w1").alias("case_id"), F.col("w1").alias("lw"), F.lit(None).cast("string").alias("rw"))
        return self.candidates(cases, k).join(cases.select("case_id", F.col("lw").alias("w1")), "case_id").select("w1", "candidate", "score")
