"""Candidates for a missing word, and the beams that join them into phrases.

The language model is a relation (case, candidate, score). The one here counts neighbours: a candidate's
score is the logarithm of its share among the words seen next to the case's neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking as R
from ..functions import text as X
from .context import maybe_broadcast


#: More words than a text of the longest string that there is.
MOST_WORDS = 1_000_000_000


def bigrams(docs: DataFrame, words_col: str = "ws") -> DataFrame:
    """w1, w2 of all neighbours, row by row."""
    ws = F.col(words_col)
    pairs = F.when(F.size(ws) > 1, F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.struct(F.get(ws, i).alias("w1"), F.get(ws, i + 1).alias("w2"))))
    return docs.select(F.explode(pairs).alias("p")).select("p.w1", "p.w2")


def single_cases(items: DataFrame, key: str = "item_id", words_col: str = "ws") -> DataFrame:
    """case_id, item, lw, gold, rw of every word that has a neighbour on both sides. Ids have room for ``MOST_WORDS`` words an item and 9 * 10^9 items."""
    ws = F.col(words_col)
    df = items.filter(F.size(ws) > 2).select(F.col(key).alias("item"), words_col, F.explode(F.sequence(F.lit(1), F.size(ws) - 2)).alias("pos"))
    return df.select((F.col("item").cast("long") * MOST_WORDS + F.col("pos")).alias("case_id"), "item", "pos", F.get(ws, F.col("pos") - 1).alias("lw"), F.get(ws, F.col("pos")).alias("gold"), F.get(ws, F.col("pos") + 1).alias("rw"))


def neighbour_scores(pairs: DataFrame, given: str, wanted: str, keys: DataFrame) -> DataFrame:
    """given, candidate, score: the whole list of each word in ``keys`` (one column, ``given``)."""
    counts = pairs.join(maybe_broadcast(keys.distinct()), given, "left_semi").groupBy(given, F.col(wanted).alias("candidate")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(given))
    return counts.select(given, "candidate", F.round(F.log(F.col("n") / total), 6).alias("score"))


def neighbour_model(pairs: DataFrame, given: str, wanted: str, keys: DataFrame, k: int = 20) -> DataFrame:
    """given, candidate, score, rank (0-based): the ``k`` best of each word in ``keys`` (one column, ``given``)."""
    rank = F.row_number().over(Window.partitionBy(given).orderBy(F.desc("score"), "candidate")) - 1
    return neighbour_scores(pairs, given, wanted, keys).withColumn("rank", rank).filter(F.col("rank") < k).select(given, "candidate", "score", "rank")


def two_systems(docs: DataFrame, cases: DataFrame, k: int = 20) -> DataFrame:
    """case_id, system (next, prev), candidate, score, rank: by the word before, and by the word after."""
    pairs = bigrams(docs)
    after = neighbour_model(pairs, "w1", "w2", cases.select(F.col("lw").alias("w1")), k)
    before = neighbour_model(pairs, "w2", "w1", cases.select(F.col("rw").alias("w2")), k)
    a = cases.join(after, cases.lw == after.w1).select("case_id", F.lit("next").alias("system"), "candidate", "score", "rank")
    b = cases.join(before, cases.rw == before.w2).select("case_id", F.lit("prev").alias("system"), "candidate", "score", "rank")
    return a.unionByName(b)


def best_score(rows: DataFrame, case: Sequence[str]) -> DataFrame:
    """Best score of each text of a case; of equal scores the smaller size stands."""
    return rows.groupBy(*case, "candidate").agg(F.max("score").alias("score"), F.min_by("size", F.struct(-F.col("score"), "size")).alias("size"))


def first_per_class(rows: DataFrame, case: Sequence[str], klass: Column, rank: str, k: int) -> DataFrame:
    """First candidate of each class (lemma, normal form), ranked anew, up to ``k``."""
    own = rows.withColumn("_k", klass).withColumn("_f", F.row_number().over(Window.partitionBy(*case, "_k").orderBy(rank))).filter("_f = 1")
    return own.withColumn("new_rank", F.row_number().over(Window.partitionBy(*case).orderBy(rank)) - 1).filter(F.col("new_rank") < k).drop("_k", "_f")


def beam(cases: DataFrame, model: DataFrame, key: str, slots: int, width: int = 5, repeat: bool = False, keep: Column | None = None) -> DataFrame:
    """Left-to-right beam over a next-word model (w1, candidate, score): key, phrase, score, rank.

    ``cases`` has key and lw. A step joins each beam's last word with the model and keeps the ``width`` best
    of a case; ``keep`` filters a step's rows (columns phrase, candidate) before the cut; unless ``repeat``, a word
    does not follow itself. ``slots`` is small and fixed, so the plan is unrolled.
    """
    beams = cases.select(key, F.col("lw").alias("last"), F.lit("").alias("phrase"), F.lit(0.0).alias("total"))
    for _ in range(slots):
        step = beams.join(model, beams.last == model.w1)
        if not repeat:
            step = step.filter("candidate != last")
        step = step.select(key, F.col("candidate").alias("last"), F.trim(F.concat_ws(" ", "phrase", "candidate")).alias("phrase"), F.round(F.col("total") + F.col("score"), 6).alias("total"), "candidate")
        if keep is not None:
            step = step.filter(keep)
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("total"), "phrase"))
        beams = step.withColumn("rank", rank).filter(F.col("rank") <= width).drop("candidate")
    return beams.select(key, "phrase", F.col("total").alias("score"), (F.col("rank") - 1).alias("rank"))


def unknown_length(cases: DataFrame, model: DataFrame, key: str, longest: int = 3, width: int = 5) -> DataFrame:
    """Beams of 1 to ``longest`` words together, with their size."""
    out = None
    for n in range(1, longest + 1):
        part = beam(cases, model, key, n, width).withColumn("size", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def char_model(words: DataFrame) -> DataFrame:
    """w1, candidate, score over letters: share of each letter after each letter, ^ at the start, $ at the end."""
    chars = F.concat(F.array(F.lit("^")), F.split("word", ""), F.array(F.lit("$")))
    pairs = words.select(chars.alias("ws"))
    counts = bigrams(pairs).groupBy("w1", F.col("w2").alias("candidate")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("w1", "candidate", F.round(F.log(F.col("n") / F.sum("n").over(Window.partitionBy("w1"))), 6).alias("score"))


def letter_model(counted: DataFrame, k: int = 30) -> DataFrame:
    """w1, candidate, score: the ``k`` likeliest letters or blanks after each, of words (word, n) that blanks surround."""
    chars = F.concat(F.array(F.lit(" ")), F.split("word", ""), F.array(F.lit(" ")))
    pairs = F.transform(F.sequence(F.lit(0), F.size(chars) - 2), lambda i: F.struct(F.get(chars, i).alias("w1"), F.get(chars, i + 1).alias("candidate")))
    counts = counted.filter("word <> ''").select("n", F.explode(pairs).alias("p")).groupBy("p.w1", "p.candidate").agg(F.sum("n").alias("n"))
    scored = counts.select("w1", "candidate", F.round(F.log(F.col("n") / F.sum("n").over(Window.partitionBy("w1"))), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("w1").orderBy(F.desc("score"), "candidate"))
    return scored.withColumn("_r", place).filter(F.col("_r") <= k).drop("_r")


def letter_spans(model: dict[str, list[tuple[str, float]]], first: str, longest: int, width: int) -> list[tuple[str, float, int, int]]:
    """text, score, size, rank of the beams of 2 to ``longest`` letters and blanks from a first letter; no blank ends a text or follows another."""
    order = lambda b: (-b[1], b[0])
    beams, out = [(first, 0.0)] if first else [], []
    for size in range(2, longest + 1):
        grown = sorted(((t + c, round(total + s, 6)) for t, total in beams for c, s in model.get(t[-1], ()) if not (c == " " == t[-1])), key=order)
        out += [(t, total, size, rank) for rank, (t, total) in enumerate([g for g in grown if g[0][-1] != " "][:width])]
        beams = grown[:width]
    return out


def unknown_letters(cases: DataFrame, model: DataFrame, key: str, longest: int = 18, width: int = 3) -> DataFrame:
    """key, candidate, score, size, rank: spans of unknown length from the letter ``first`` of each case; a map.

    ``model`` is a ``letter_model``: as many rows as there are letters times its ``k``, and so is handed to every task.
    """
    table: dict[str, list[tuple[str, float]]] = {}
    for r in model.collect():
        table.setdefault(r.w1, []).append((r.candidate, r.score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for k, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if first not in known:
                    known[first] = letter_spans(table, first or "", longest, width)
                for row in known[first]:
                    for col, value in zip(cols, (k, *row), strict=True):
                        col.append(value)
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[key, "candidate", "score", "size", "rank"])

    return cases.select(F.col(key).cast("string"), "first").mapInArrow(run, f"{key} string, candidate string, score double, size int, rank int")


def letter_ranks(cases: DataFrame, model: DataFrame) -> DataFrame:
    """letters, hit1, hit5: place of each letter of the gold words among the letters after the one before it."""
    place = F.row_number().over(Window.partitionBy("w1").orderBy(F.desc("score"), "candidate")) - 1
    ranks = model.filter("candidate <> '$'").select("w1", "candidate", place.alias("rank"))
    chars = F.concat(F.array(F.lit("^")), F.split("gold", ""))
    pairs = F.transform(F.sequence(F.lit(0), F.size(chars) - 2), lambda i: F.struct(F.get(chars, i).alias("w1"), F.get(chars, i + 1).alias("candidate")))
    asked = cases.filter("gold <> ''").groupBy("gold").agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(pairs).alias("p")).groupBy("p.w1", "p.candidate").agg(F.sum("n").alias("n"))
    met = asked.join(ranks, ["w1", "candidate"], "left")
    rate = lambda k: F.round(R.percent(F.sum(F.when(F.col("rank") < k, F.col("n")).otherwise(0)), F.sum("n")), 4)
    return met.agg(F.sum("n").alias("letters"), rate(1).alias("hit1"), rate(5).alias("hit5"))


def legal_rows(rows: DataFrame, slots_left: Column) -> DataFrame:
    return rows.filter(X.legal_prefix(F.col("phrase"), slots_left))
