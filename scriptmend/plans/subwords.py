"""Queries over sub-word pieces: vocabulary, alignment to words, piece counts, the length-leak check, and the beam that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import growing
from ..operators import pieces as P
from ..operators.tables import written
from .base import DOCS, ITEMS, docs, items


def _vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    counted = docs(spark, sf).select(F.explode("ws").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return P.vocabulary(counted)


def piece_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return _vocabulary(spark, sf)


def _item_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return P.split_words(items(spark, sf), _vocabulary(spark, sf), keep=["item_id", "ws"])


def piece_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every item, with the place of its word."""
    return P.alignment(_item_pieces(spark, sf), "item_id")


def piece_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each language in the documents: how many, share of unknown ones, share of those of one piece, mean pieces and letters of a word."""
    counted = docs(spark, sf).select("lang", F.explode("ws").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    split = P.pieces_of(counted, _vocabulary(spark, sf))
    n = F.sum("n")
    of = lambda what: F.round(F.sum(what * F.col("n")) / n, 6)
    unknown, size = F.array_contains("pieces", P.UNKNOWN).cast("int"), F.size("pieces")
    return split.groupBy("lang").agg(n.alias("words"), of(unknown).alias("unknown"), of((size == 1).cast("int")).alias("single"), of(size).alias("mean_pieces"), of(F.length("word")).alias("mean_letters"))


def length_leak(spark: SparkSession, sf: str) -> DataFrame:
    """What the number of masked pieces tells about a word of an item: for each number, words, least, greatest and mean letters, and words whose length no word of one piece has."""
    aligned = _item_pieces(spark, sf).select(F.explode(F.transform("ws", lambda w: w)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    split = written(P.pieces_of(aligned, _vocabulary(spark, sf)).select("word", "n", F.size("pieces").alias("n_pieces"), F.length("word").alias("letters")))
    single = split.filter("n_pieces = 1").select("letters").distinct().withColumn("hidden", F.lit(True))
    met = split.join(single, "letters", "left")
    return met.groupBy("n_pieces").agg(F.sum("n").alias("words"), F.min("letters").alias("least"), F.max("letters").alias("most"), F.round(F.sum(F.col("n") * F.col("letters")) / F.sum("n"), 6).alias("mean_letters"), F.sum(F.when(F.col("hidden").isNull(), F.col("n")).otherwise(0)).alias("given_away"))


def growing_beam(spark: SparkSession, sf: str) -> DataFrame:
    """The second and third word of each item, of as many pieces as they need, from the last piece of the first."""
    vocabulary = written(_vocabulary(spark, sf))
    model = growing.piece_model(P.split_words(docs(spark, sf), vocabulary, keep=["doc_id"]))
    own = items(spark, sf).filter(F.size("ws") >= 4).select(F.col("item_id").alias("case_id"), F.slice("ws", 1, 1).alias("ws"))
    cases = P.split_words(own, vocabulary, keep=["case_id"]).select("case_id", F.element_at("pieces", -1).alias("last"), F.lit(2).alias("slots"))
    return growing.growing_beam(cases, model)


_COUNTED = f"{DOCS}, counted AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM docs) GROUP BY word)"
_VOCABULARY = f"""{_COUNTED},
begins AS (SELECT substr(word, 1, l) AS t, sum(n)::BIGINT AS n FROM (SELECT word, n, unnest(range(1, least(length(word), {P.LONGEST}) + 1)) AS l FROM counted) GROUP BY 1),
goes_on AS (SELECT substr(word, p, l) AS t, sum(n)::BIGINT AS n FROM (SELECT word, n, p, unnest(range(1, least(length(word) - p + 1, {P.LONGEST}) + 1)) AS l FROM (SELECT word, n, unnest(range(2, length(word) + 1)) AS p FROM counted)) GROUP BY 1),
kept AS (SELECT true AS first, * FROM begins WHERE length(t) = 1 UNION ALL SELECT false, * FROM goes_on WHERE length(t) = 1
  UNION ALL SELECT true, * FROM (SELECT * FROM begins WHERE length(t) > 1 ORDER BY n * (length(t) - 1) DESC, t LIMIT {P.SIZE})
  UNION ALL SELECT false, * FROM (SELECT * FROM goes_on WHERE length(t) > 1 ORDER BY n * (length(t) - 1) DESC, t LIMIT {P.SIZE})),
voc AS (SELECT first, t, CASE WHEN first THEN t ELSE '##' || t END AS piece, n FROM kept)"""


def _split(words: str) -> str:
    """sp: word, k (from 1) and piece of the distinct words that ``words`` selects."""
    return f"""asked AS (SELECT DISTINCT word FROM ({words})),
g AS (SELECT word, 1::BIGINT AS i, 0 AS k, '' AS piece FROM asked UNION ALL
  SELECT word, i + length(t), k + 1, piece FROM (SELECT g.word, g.i, g.k, v.t, v.piece, row_number() OVER (PARTITION BY g.word ORDER BY length(v.t) DESC) AS r FROM g CROSS JOIN (SELECT unnest(range(1, {P.LONGEST} + 1)) AS l) x JOIN voc v ON v.t = substr(g.word, g.i, x.l) AND length(v.t) = x.l AND v.first = (g.i = 1) WHERE g.i <= length(g.word)) WHERE r = 1),
whole AS (SELECT word FROM g GROUP BY word HAVING max(i) > length(word)),
sp AS (SELECT word, k, piece FROM g SEMI JOIN whole USING (word) WHERE k > 0 UNION ALL SELECT word, 1, '[UNK]' FROM asked ANTI JOIN whole USING (word)),
ps AS (SELECT word, list(piece ORDER BY k) AS pieces FROM sp GROUP BY word)"""


_ITEM_WORDS = "iw AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS word_id FROM items)"
_MODEL = """seqs AS (SELECT doc_id, pos, k, piece FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM docs) JOIN sp USING (word)),
pairs AS (SELECT piece AS p1, lead(piece) OVER (PARTITION BY doc_id ORDER BY pos, k) AS candidate FROM seqs),
pm AS (SELECT p1, candidate, round(ln(n / sum(n) OVER (PARTITION BY p1)), 6) AS score FROM (SELECT p1, candidate, count(*) AS n FROM pairs WHERE candidate IS NOT NULL AND candidate <> '[UNK]' GROUP BY ALL)),
model AS (SELECT * FROM pm QUALIFY row_number() OVER (PARTITION BY p1 ORDER BY score DESC, candidate) <= 50)"""
_GROWING = """f AS (SELECT item_id AS case_id, pieces[-1] AS last, 2 AS n_open, []::VARCHAR[] AS placed, 0.0::DOUBLE AS score, '' AS phrase, 0::BIGINT AS rank, 0 AS step FROM items JOIN ps ON word = ws[1] WHERE len(ws) >= 4 UNION ALL
  SELECT case_id, last, n_open, placed, score, phrase, rank, step FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, phrase) - 1 AS rank FROM (
    SELECT case_id, coalesce(candidate, last) AS last, CASE WHEN candidate IS NULL OR starts_with(candidate, '##') THEN n_open ELSE n_open - 1 END AS n_open, CASE WHEN candidate IS NULL THEN placed ELSE list_append(placed, candidate) END AS placed, CASE WHEN candidate IS NULL THEN f.score ELSE round(f.score + m.score, 6) END AS score,
      CASE WHEN candidate IS NULL THEN phrase WHEN starts_with(candidate, '##') THEN phrase || substr(candidate, 3) ELSE trim(phrase || ' ' || candidate) END AS phrase, step + 1 AS step
    FROM f LEFT JOIN model m ON m.p1 = f.last AND f.n_open > 0 AND (NOT starts_with(m.candidate, '##') OR len(f.placed) > 0) WHERE step < 10 AND (n_open = 0 OR candidate IS NOT NULL))) WHERE rank < 5)"""

QUERIES = {
    "piece_vocabulary": (piece_vocabulary, f"WITH {_VOCABULARY} SELECT piece, n FROM voc"),
    "piece_alignment": (piece_alignment, f"WITH RECURSIVE {_VOCABULARY}, {ITEMS}, {_ITEM_WORDS}, {_split('SELECT word FROM iw')} SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY word_id, k) - 1)::INT AS k, word_id::INT AS word_id, piece FROM iw JOIN sp USING (word)"),
    "piece_rates": (piece_rates, f"WITH RECURSIVE {_VOCABULARY}, {_split('SELECT word FROM counted')}, w AS (SELECT lang, unnest(ws) AS word FROM docs) SELECT lang, count(*) AS words, round(avg((pieces[1] = '[UNK]')::INT), 6) AS unknown, round(avg((len(pieces) = 1)::INT), 6) AS single, round(avg(len(pieces)), 6) AS mean_pieces, round(avg(length(word)), 6) AS mean_letters FROM w JOIN ps USING (word) GROUP BY lang"),
    "length_leak": (length_leak, f"WITH RECURSIVE {_VOCABULARY}, {ITEMS}, {_ITEM_WORDS}, {_split('SELECT word FROM iw')}, z AS (SELECT len(pieces) AS n_pieces, length(word) AS letters FROM iw JOIN ps USING (word)) SELECT n_pieces::INT AS n_pieces, count(*) AS words, min(letters)::INT AS least, max(letters)::INT AS most, round(avg(letters), 6) AS mean_letters, count(*) FILTER (letters NOT IN (SELECT letters FROM z WHERE n_pieces = 1)) AS given_away FROM z GROUP BY n_pieces"),
    "growing_beam": (growing_beam, f"WITH RECURSIVE {_VOCABULARY}, {ITEMS}, {_ITEM_WORDS}, {_split('SELECT word FROM iw UNION ALL SELECT word FROM counted')}, {_MODEL}, {_GROWING}, e AS (SELECT * FROM f QUALIFY step = max(step) OVER ()) SELECT case_id, phrase, score, len(placed)::INT AS n_pieces, n_open, rank FROM e"),
}
