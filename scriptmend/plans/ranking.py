"""Queries over candidates: fusion, constraints, classes and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranking as R
from ..functions import text as X
from ..operators import candidates as C
from ..operators import classify, constraints, fusion, metrics
from ..operators.context import maybe_broadcast
from .base import BIGRAMS, CASES, DOCS, ITEMS, RANKING, cases, docs, hits, one_system, systems

GRID_ALPHA, GRID_PENALTY, GRID_WEIGHT = (0.0, 0.25, 0.5, 1.0, 2.0), (-0.5, -0.25, 0.0, 0.25, 0.5), (0.0, 0.25, 0.5, 0.75, 1.0)
WEIGHTS, BIAS = {"score": 0.9, "back": 0.6, "same_length": 0.4}, -0.5


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = systems(spark, sf)
    return cases(spark, sf), one_system(rows, "next"), one_system(rows, "prev")


def topk_metrics(spark: SparkSession, sf: str) -> DataFrame:
    ranks = fusion.gold_ranks(systems(spark, sf), cases(spark, sf), ["system"])
    return metrics.summary(ranks, ["system"])


def single_vs_multi_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Hits by length class and length bucket, with totals."""
    c, a, _ = _both(spark, sf)
    ranks = fusion.gold_ranks(a, c).join(c.select("case_id", "gold"), "case_id")
    n = F.length("gold")
    ranks = ranks.withColumn("bucket", R.gap_bucket(n)).withColumn("klass", F.when(n <= 3, "short").otherwise("long"))
    out = ranks.rollup("klass", "bucket").agg(F.count(F.lit(1)).alias("n"), *metrics.hit_columns())
    return out.withColumn("klass", F.coalesce("klass", F.lit("all"))).withColumn("bucket", F.coalesce("bucket", F.lit("all")))


def reciprocal_rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    c, _, _ = _both(spark, sf)
    fused = fusion.ranked(fusion.reciprocal_rank_fusion(systems(spark, sf), "case_id"), ["case_id"])
    return metrics.summary(fusion.gold_ranks(fused, c).withColumn("system", F.lit("rrf")), ["system"])


def rank_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    _, a, b = _both(spark, sf)
    return fusion.ranked(fusion.rank_ensemble(a, b, "case_id", F.lit(0.5)), ["case_id"]).filter("rank < 3").select("case_id", "candidate", "score", "rank")


def overlap_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    _, a, b = _both(spark, sf)
    return fusion.ranked(fusion.overlap_ensemble(a, b, "case_id"), ["case_id"]).select("case_id", "candidate", "score", "rank")


def ensemble_weight_fit(spark: SparkSession, sf: str) -> DataFrame:
    c, a, b = _both(spark, sf)
    x = fusion.with_rank_score(a, ["case_id"]).select("case_id", "candidate", F.col("rs").alias("x"))
    y = fusion.with_rank_score(b, ["case_id"]).select("case_id", "candidate", F.col("rs").alias("y"))
    met = x.join(y, ["case_id", "candidate"], "full_outer")
    score = F.col("weight") * F.coalesce("x", F.lit(fusion.ABSENT)) + (1 - F.col("weight")) * F.coalesce("y", F.lit(fusion.ABSENT))
    return fusion.grid_fit(met, c, GRID_WEIGHT, score, "weight")


def alpha_grid_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Model score plus alpha times the score by the word after, for what that list has."""
    c, a, b = _both(spark, sf)
    rows = a.select("case_id", "candidate", "score").join(b.select("case_id", "candidate", F.col("score").alias("back")), ["case_id", "candidate"], "left")
    return fusion.grid_fit(rows.withColumnRenamed("score", "model"), c, GRID_ALPHA, F.col("model") + F.col("alpha") * F.coalesce(F.col("back") + 10, F.lit(0.0)))


def length_penalty_fit(spark: SparkSession, sf: str) -> DataFrame:
    c, a, _ = _both(spark, sf)
    return fusion.grid_fit(a.withColumnRenamed("score", "model"), c, GRID_PENALTY, F.col("model") + F.col("penalty") * F.length("candidate"), "penalty")


def logistic_rerank_apply(spark: SparkSession, sf: str) -> DataFrame:
    c, a, b = _both(spark, sf)
    rows = a.select("case_id", "candidate", "score").join(b.select("case_id", "candidate", F.col("score").alias("back")), ["case_id", "candidate"], "left").join(c.select("case_id", "gold"), "case_id")
    rows = rows.withColumn("back", F.coalesce("back", F.lit(-10.0))).withColumn("same_length", (F.length("candidate") == F.length("gold")).cast("double"))
    scored = fusion.logistic_rerank(rows, WEIGHTS, BIAS).drop("gold")
    return metrics.summary(fusion.gold_ranks(fusion.ranked(scored, ["case_id"], "p"), c).withColumn("system", F.lit("logistic")), ["system"])


def _fitting(spark: SparkSession, sf: str, tolerance: int) -> DataFrame:
    """case_id, gold, candidate, score, off: of the model's whole list those with the first and last letter of the gold word whose length is off by ``tolerance`` at most."""
    c = cases(spark, sf)
    ends = lambda w: (F.left(w, F.lit(1)).alias("head"), F.right(w, F.lit(1)).alias("tail"))
    near = F.sequence(F.length("gold") - tolerance, F.length("gold") + tolerance)
    asked = c.select("case_id", "gold", F.col("lw").alias("w1"), *ends("gold"), F.explode(near).alias("len"))
    known = C.neighbour_scores(C.bigrams(docs(spark, sf)), "w1", "w2", c.select(F.col("lw").alias("w1")))
    known = known.select("w1", "candidate", "score", *ends("candidate"), F.length("candidate").alias("len"))
    return asked.join(known, ["w1", "head", "tail", "len"]).select("case_id", "gold", "candidate", "score", F.abs(F.col("len") - F.length("gold")).alias("off"))


def physical_constraint_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of the gold word among the candidates that fit."""
    c = cases(spark, sf)
    fits = fusion.ranked(_fitting(spark, sf, 1), ["case_id"])
    found = fits.groupBy("case_id").agg(F.min(F.when(F.col("candidate") == F.col("gold"), F.col("rank"))).alias("gold_rank"), F.count(F.lit(1)).alias("n_fit"))
    return c.select("case_id").join(found, "case_id", "left").select("case_id", "gold_rank", F.coalesce("n_fit", F.lit(0)).alias("n_fit"))


def tolerance_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """Summary at each tolerance; a candidate counts at every tolerance it is within."""
    fits = _fitting(spark, sf, 2).withColumn("tolerance", F.explode(F.sequence("off", F.lit(2))))
    found = fusion.ranked(fits, ["tolerance", "case_id"]).filter("candidate = gold").groupBy("tolerance", "case_id").agg(F.min("rank").alias("gold_rank"))
    frame = cases(spark, sf).select("case_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("tolerance"))
    return metrics.summary(frame.join(found, ["tolerance", "case_id"], "left"), ["tolerance"])


def vocabulary_constraint_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the corpus against every case's known letters and length: words that fit, and whether the gold word is one."""
    words = docs(spark, sf).select(F.explode("ws").alias("word")).distinct()
    c = cases(spark, sf)
    targets = c.filter("length(gold) > 1").select(F.col("case_id").alias("target"), F.array(F.left("gold", F.lit(1)), F.right("gold", F.lit(1))).alias("segments"), F.lit(True).alias("anchored_left"), F.lit(True).alias("anchored_right"), F.length("gold").alias("estimate"))
    met = constraints.constrained_pairs(words, targets).join(c.select(F.col("case_id").alias("target"), "gold"), "target")
    return met.groupBy("target").agg(F.count(F.lit(1)).alias("n_fit"), F.max((F.col("candidate") == F.col("gold")).cast("int")).alias("has_gold"))


def wildcard_match_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Item texts with every third character masked, matched against the item texts of the same length class."""
    own = spark.read.parquet(f"{sf}/benchmark.parquet").withColumn("text", F.replace(F.col("text"), F.lit("?"), F.lit(".")))
    own = own.withColumn("book", F.col("item_id") % 4)
    masked = own.withColumn("pattern", F.array_join(F.transform(F.split("text", ""), lambda ch, i: F.when(i % 3 == 1, "?").otherwise(ch)), ""))
    return constraints.unique_wildcard(masked.select("item_id", "book", "pattern"), own.select("book", "text"), "item_id", "book")


def exclusion_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Cases by the first reason that excludes them."""
    c = cases(spark, sf)
    reason = F.when(F.length("gold") < 2, "too_short").when(F.col("gold") == F.col("lw"), "repeats_left").when(F.col("gold") == F.col("rw"), "repeats_right").when(F.length("gold") > 12, "too_long").otherwise("eligible")
    return c.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("n_items"))


def any_of_target_min_rank(spark: SparkSession, sf: str) -> DataFrame:
    """A case succeeds by either system."""
    ranks = fusion.gold_ranks(systems(spark, sf), cases(spark, sf), ["system"]).groupBy("case_id").agg(F.min("gold_rank").alias("gold_rank"))
    return metrics.summary(ranks.withColumn("system", F.lit("either")), ["system"])


def by_source(spark: SparkSession, sf: str) -> DataFrame:
    c, a, _ = _both(spark, sf)
    return metrics.summary(fusion.gold_ranks(a, c).join(c.select("case_id", "item"), "case_id"), ["item"])


def micro_macro(spark: SparkSession, sf: str) -> DataFrame:
    c, a, _ = _both(spark, sf)
    ranks = fusion.gold_ranks(a, c).join(c.select("case_id", "gold"), "case_id").withColumn("bucket", R.gap_bucket(F.length("gold")))
    return metrics.micro_macro(ranks, "bucket")


def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Resamples items, the clusters of cases."""
    c, a, _ = _both(spark, sf)
    return metrics.bootstrap(fusion.gold_ranks(a, c).join(c.select("case_id", "item"), "case_id"), "item")


def paired_sign_test(spark: SparkSession, sf: str) -> DataFrame:
    c, a, b = _both(spark, sf)
    return metrics.paired_sign_test(fusion.gold_ranks(a, c), fusion.gold_ranks(b, c), "case_id")


def cer_boundary_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Two-word phrases (gold and the next word) against the greedy phrase of the model."""
    c, a, _ = _both(spark, sf)
    top = a.filter("rank = 0").select("case_id", "candidate")
    rows = c.join(top, "case_id", "left").select("case_id", F.concat_ws(" ", "gold", "rw").alias("gold"), F.coalesce(F.concat_ws(" ", "candidate", "rw"), F.lit("")).alias("said"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(X.error_rate(F.col("said"), F.col("gold"))), 6).alias("cer"), F.round(F.avg(X.boundary_f1(F.col("said"), F.col("gold"))), 6).alias("f1"), F.count_if(F.col("said") == F.col("gold")).alias("exact"))


def miss_classifier(spark: SparkSession, sf: str) -> DataFrame:
    c, a, _ = _both(spark, sf)
    freq = docs(spark, sf).select(F.explode("ws").alias("gold")).join(maybe_broadcast(c.select("gold").distinct()), "gold", "left_semi").groupBy("gold").agg(F.count(F.lit(1)).alias("freq"))
    lists = a.filter("rank < 5").groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "candidate"))), lambda x: x["candidate"]).alias("cands"))
    rows = c.join(lists, "case_id", "left").withColumn("cands", F.coalesce("cands", F.array().cast("array<string>"))).join(freq, "gold", "left")
    klass = classify.miss_class(F.col("gold"), F.col("cands"), F.col("freq"))
    return rows.groupBy(klass.alias("category")).agg(F.count(F.lit(1)).alias("n")).withColumn("issue", classify.issue(F.col("category")))


def span_status(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses of all two-slot spans (a case and the one after it)."""
    c, a, _ = _both(spark, sf)
    ranks = fusion.gold_ranks(a, c).withColumn("t1", F.coalesce(F.col("gold_rank") < 1, F.lit(False))).withColumn("t5", F.coalesce(F.col("gold_rank") < 5, F.lit(False)))
    after = ranks.select((F.col("case_id") - 1).alias("case_id"), F.col("t1").alias("u1"), F.col("t5").alias("u5"))
    return ranks.join(after, "case_id").groupBy(classify.span_status(F.array("t1", "u1"), F.array("t5", "u5")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def left_to_right_beam(spark: SparkSession, sf: str) -> DataFrame:
    """Two-slot beams of width 3 from each item's first word, over the ten likeliest next words."""
    d = docs(spark, sf)
    starts = cases(spark, sf).filter("pos = 1").select(F.col("item").alias("item_id"), "lw")
    pairs = C.bigrams(d)
    first = C.neighbour_model(pairs, "w1", "w2", starts.select(F.col("lw").alias("w1")), 10)
    second = C.neighbour_model(pairs, "w1", "w2", first.select(F.col("candidate").alias("w1")), 10)
    model = first.unionByName(second).select("w1", "candidate", "score").distinct()
    return C.beam(starts, model, "item_id", 2, 3)


def char_beam(spark: SparkSession, sf: str) -> DataFrame:
    """Likeliest four-letter strings from each first letter, by letter pairs of the corpus's distinct words."""
    words = docs(spark, sf).select(F.explode("ws").alias("word")).distinct()
    model = C.char_model(words).filter("candidate != '$'")
    starts = model.filter("w1 = '^'").select(F.col("candidate").alias("letter"), F.col("candidate").alias("lw"))
    return C.beam(starts, model, "letter", 3, 3, repeat=True)


def pseudo_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    """Mean log probability and perplexity of each item under add-one bigrams of the corpus."""
    pairs = C.bigrams(docs(spark, sf))
    own = cases(spark, sf).select("item", F.col("lw").alias("w1"), F.col("gold").alias("w2"))
    some = pairs.join(maybe_broadcast(own.select("w1").distinct()), "w1", "left_semi")
    joint, single = some.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")), some.groupBy("w1").agg(F.count(F.lit(1)).alias("m"))
    v = pairs.select("w1").distinct().count()
    rows = own.join(joint, ["w1", "w2"], "left").join(single, "w1", "left")
    lp = F.log((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("m", F.lit(0)) + v))
    return rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(lp), 6).alias("mean_log"), F.round(F.exp(-F.avg(lp)), 3).alias("perplexity"))


def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Reliability of the top candidate's probability."""
    c, a, _ = _both(spark, sf)
    rows = a.filter("rank = 0").join(c.select("case_id", "gold"), "case_id").withColumn("p", F.round(F.exp("score"), 6))
    return metrics.calibration(rows, "p", F.col("candidate") == F.col("gold"))


def _ranks(sql: str, extra: str = "") -> str:
    """gr: gold rank of every case among the rows (case_id, candidate, rank) of ``sql``."""
    return f"r0 AS ({sql}), gr AS (SELECT c.case_id, c.item, c.gold, (SELECT min(rank) FROM r0 WHERE r0.case_id = c.case_id AND r0.candidate = c.gold) AS gold_rank{extra} FROM cases c)"


_SUMMARY = f"count(*) AS n, {hits()}, round(100.0 * count(gold_rank) / count(*), 4) AS coverage, median(gold_rank) AS median_rank, round(avg(coalesce(1.0 / (gold_rank + 1), 0)), 6) AS mrr"
_RS = "sa AS (SELECT case_id, candidate, 1 - rank / greatest(1, count(*) OVER (PARTITION BY case_id) - 1) AS x FROM a), sb AS (SELECT case_id, candidate, 1 - rank / greatest(1, count(*) OVER (PARTITION BY case_id) - 1) AS y FROM b), e AS (SELECT case_id, candidate, coalesce(x, -0.25) AS x, coalesce(y, -0.25) AS y FROM sa FULL JOIN sb USING (case_id, candidate))"
_BUCKET = "CASE WHEN length(gold) <= 3 THEN length(gold)::VARCHAR WHEN length(gold) <= 5 THEN '4-5' ELSE '6+' END"


def _grid(values: tuple[float, ...], source: str, score: str, name: str) -> str:
    return f"""g AS (SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in values)}]) AS {name}), t AS (SELECT {name}, case_id, candidate, round({score}, 6) AS score FROM ({source}), g),
k AS (SELECT *, row_number() OVER (PARTITION BY {name}, case_id ORDER BY score DESC, candidate) - 1 AS rank FROM t), h AS (SELECT {name}, case_id, min(rank) AS gold_rank FROM k JOIN cases USING (case_id) WHERE candidate = gold GROUP BY ALL),
q AS (SELECT {name}, round(100.0 * count(*) FILTER (gold_rank < 1) / count(*), 4) AS top1, round(100.0 * count(*) FILTER (gold_rank < 5) / count(*), 4) AS top5, round(100.0 * count(*) FILTER (gold_rank < 10) / count(*), 4) AS top10 FROM (SELECT {name}, case_id FROM g, cases) LEFT JOIN h USING ({name}, case_id) GROUP BY {name})
SELECT *, row_number() OVER (ORDER BY top10 DESC, top5 DESC, top1 DESC, {name}) = 1 AS chosen FROM q"""


#: f: what fits of the model's whole list, for each tolerance.
_FITS = f"""WITH {DOCS}, {ITEMS}, {CASES}, {BIGRAMS}, n0 AS (SELECT w1, w2 AS candidate, count(*) AS n FROM bigrams WHERE w1 IN (SELECT lw FROM cases) GROUP BY ALL),
n1 AS (SELECT w1, candidate, round(ln(n / sum(n) OVER (PARTITION BY w1)), 6) AS score FROM n0),
f AS (SELECT t AS tolerance, case_id, candidate, gold, row_number() OVER (PARTITION BY t, case_id ORDER BY score DESC, candidate) - 1 AS rank FROM cases JOIN n1 ON lw = w1, (SELECT unnest([0, 1, 2]) AS t)
WHERE left(candidate, 1) = left(gold, 1) AND right(candidate, 1) = right(gold, 1) AND abs(length(candidate) - length(gold)) <= t)"""


_POISSON_SUM = 0.0
_CUTS = []
_TERM = 2.718281828459045**-1
for _k in range(7):
    _POISSON_SUM += _TERM
    _CUTS.append(f"WHEN u < {_POISSON_SUM!r} THEN {_k}")
    _TERM /= _k + 1
_U = "('0x' || substr(md5(concat('42:', b, ':', {})), 1, 8))::BIGINT / 4294967296.0"

#: Lower-case words with a byte a letter, as DuckDB's distance counts bytes: accented letters of the tables as capitals.
_ONE_BYTE = "translate({}, 'ßàáâäæçèéêëíìîïñóòôöøúùûüœ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"

QUERIES = {
    "topk_metrics": (topk_metrics, f"{RANKING}, u AS (SELECT 'next' AS system, case_id, candidate, rank FROM a UNION ALL SELECT 'prev', case_id, candidate, rank FROM b), h AS (SELECT system, case_id, min(rank) AS gold_rank FROM u JOIN cases USING (case_id) WHERE candidate = gold GROUP BY ALL), f AS (SELECT system, case_id FROM (SELECT DISTINCT system FROM u), cases) SELECT system, {_SUMMARY} FROM f LEFT JOIN h USING (system, case_id) GROUP BY system"),
    "single_vs_multi_rollup": (single_vs_multi_rollup, f"{RANKING}, {_ranks('SELECT * FROM a')}, k AS (SELECT *, {_BUCKET} AS bucket, CASE WHEN length(gold) <= 3 THEN 'short' ELSE 'long' END AS klass FROM gr) SELECT coalesce(klass, 'all') AS klass, coalesce(bucket, 'all') AS bucket, count(*) AS n, {hits()} FROM k GROUP BY ROLLUP (klass, bucket)"),
    "reciprocal_rank_fusion": (reciprocal_rank_fusion, f"{RANKING}, f AS (SELECT case_id, candidate, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL), {_ranks('SELECT case_id, candidate, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, candidate) - 1 AS rank FROM f')} SELECT 'rrf' AS system, {_SUMMARY} FROM gr"),
    "rank_ensemble": (rank_ensemble, f"{RANKING}, {_RS}, s AS (SELECT case_id, candidate, round(0.5 * x + 0.5 * y, 6) AS score FROM e) SELECT case_id, candidate, score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, candidate) - 1 AS rank FROM s QUALIFY rank < 3"),
    "overlap_ensemble": (overlap_ensemble, f"{RANKING}, oa AS (SELECT case_id, candidate, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM a WINDOW w AS (PARTITION BY case_id)), ob AS (SELECT case_id, candidate, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS y FROM b WHERE rank < 5 WINDOW w AS (PARTITION BY case_id)), o AS (SELECT case_id, candidate, round((x + y) / 2, 6) AS score FROM oa JOIN ob USING (case_id, candidate)), s AS (SELECT * FROM o UNION ALL SELECT case_id, candidate, round(y, 6) FROM ob WHERE case_id NOT IN (SELECT case_id FROM o)) SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, candidate) - 1 AS rank FROM s"),
    "ensemble_weight_fit": (ensemble_weight_fit, f"{RANKING}, {_RS}, {_grid(GRID_WEIGHT, 'SELECT * FROM e', 'weight * x + (1 - weight) * y', 'weight')}"),
    "alpha_grid_fit": (alpha_grid_fit, f"{RANKING}, {_grid(GRID_ALPHA, 'SELECT a.case_id, a.candidate, a.score AS model, b.score AS back FROM a LEFT JOIN b USING (case_id, candidate)', 'model + alpha * coalesce(back + 10, 0)', 'alpha')}"),
    "length_penalty_fit": (length_penalty_fit, f"{RANKING}, {_grid(GRID_PENALTY, 'SELECT case_id, candidate, score AS model FROM a', 'model + penalty * length(candidate)', 'penalty')}"),
    "logistic_rerank_apply": (logistic_rerank_apply, f"{RANKING}, z AS (SELECT case_id, candidate, round(1 / (1 + exp(-(-0.5 + 0.9 * a.score + 0.6 * coalesce(b.score, -10) + 0.4 * (length(candidate) = length(gold))::INT))), 6) AS p FROM a LEFT JOIN b USING (case_id, candidate) JOIN cases USING (case_id)), {_ranks('SELECT case_id, candidate, row_number() OVER (PARTITION BY case_id ORDER BY p DESC, candidate) - 1 AS rank FROM z')} SELECT 'logistic' AS system, {_SUMMARY} FROM gr"),
    "physical_constraint_filter": (physical_constraint_filter, f"{_FITS}, g AS (SELECT case_id, min(rank) FILTER (candidate = gold) AS gold_rank, count(*) AS n FROM f WHERE tolerance = 1 GROUP BY case_id) SELECT case_id, gold_rank, coalesce(n, 0) AS n_fit FROM cases LEFT JOIN g USING (case_id)"),
    "tolerance_sensitivity": (tolerance_sensitivity, f"{_FITS}, h AS (SELECT tolerance, case_id, rank AS gold_rank FROM f WHERE candidate = gold), z AS (SELECT tolerance, case_id FROM (SELECT unnest([0, 1, 2]) AS tolerance), cases) SELECT tolerance, {_SUMMARY} FROM z LEFT JOIN h USING (tolerance, case_id) GROUP BY tolerance"),
    "vocabulary_constraint_join": (vocabulary_constraint_join, f"WITH {DOCS}, {ITEMS}, {CASES}, v AS (SELECT DISTINCT unnest(ws) AS word FROM docs) SELECT case_id AS target, count(*) AS n_fit, max((word = gold)::INT) AS has_gold FROM cases JOIN v ON left(word, 1) = left(gold, 1) AND right(word, 1) = right(gold, 1) AND length(word) >= 2 AND abs(length(word) - length(gold)) <= 1 WHERE length(gold) > 1 GROUP BY case_id"),
    "wildcard_match_unique": (wildcard_match_unique, "WITH o AS (SELECT item_id, item_id % 4 AS book, replace(text, '?', '.') AS text FROM benchmark), p AS (SELECT item_id, book, array_to_string(list_transform(string_split(text, ''), lambda c, i: CASE WHEN (i - 1) % 3 = 1 THEN '?' ELSE c END), '') AS pattern FROM o), m AS (SELECT item_id, v.text AS verse FROM p JOIN (SELECT DISTINCT book, text FROM o) v ON v.book = p.book AND length(v.text) = length(pattern) AND v.text LIKE replace(replace(replace(pattern, '_', '\\_'), '%', '\\%'), '?', '_') ESCAPE '\\') SELECT item_id, verse FROM m QUALIFY count(*) OVER (PARTITION BY item_id) = 1"),
    "exclusion_reasons": (exclusion_reasons, f"WITH {ITEMS}, {CASES} SELECT CASE WHEN length(gold) < 2 THEN 'too_short' WHEN gold = lw THEN 'repeats_left' WHEN gold = rw THEN 'repeats_right' WHEN length(gold) > 12 THEN 'too_long' ELSE 'eligible' END AS reason, count(*) AS n, count(DISTINCT item) AS n_items FROM cases GROUP BY 1"),
    "any_of_target_min_rank": (any_of_target_min_rank, f"{RANKING}, {_ranks('SELECT * FROM a UNION ALL SELECT * FROM b')} SELECT 'either' AS system, {_SUMMARY} FROM gr"),
    "by_source": (by_source, f"{RANKING}, {_ranks('SELECT * FROM a')} SELECT item, {_SUMMARY} FROM gr GROUP BY item"),
    "micro_macro": (micro_macro, f"{RANKING}, {_ranks('SELECT * FROM a')}, p AS (SELECT {_BUCKET} AS bucket, count(*) FILTER (gold_rank < 10) AS h, count(*) AS n FROM gr GROUP BY 1) SELECT round(100.0 * sum(h) / sum(n), 4) AS micro, round(avg(100.0 * h / n), 4) AS macro, count(*) AS buckets FROM p"),
    "bootstrap_ci": (bootstrap_ci, f"{RANKING}, {_ranks('SELECT * FROM a')}, p AS (SELECT item, count(*) FILTER (gold_rank < 10) AS hits, count(*) AS cases FROM gr GROUP BY item), d AS (SELECT b, hits, cases, {_U.format('item')} AS u FROM p, (SELECT unnest(range(200)) AS b)), t AS (SELECT b, hits, cases, CASE {' '.join(_CUTS)} ELSE 7 END AS times FROM d), r AS (SELECT b, round(coalesce(100.0 * sum(hits * times) / nullif(sum(cases * times), 0), 0), 6) AS rate FROM t GROUP BY b), o AS (SELECT rate, row_number() OVER (ORDER BY rate, b) - 1 AS r FROM r) SELECT max(rate) FILTER (r = 5) AS low, max(rate) FILTER (r = 194) AS high, count(*) AS rounds FROM o"),
    "paired_sign_test": (paired_sign_test, f"{RANKING}, x AS (SELECT case_id, coalesce((SELECT min(rank) FROM a WHERE a.case_id = c.case_id AND candidate = gold) < 10, false)::INT AS x, coalesce((SELECT min(rank) FROM b WHERE b.case_id = c.case_id AND candidate = gold) < 10, false)::INT AS y FROM cases c), d AS (SELECT case_id, y - x AS d FROM x WHERE x <> y), s AS (SELECT b, sum(d * CASE WHEN {_U.format('case_id')} < 0.5 THEN -1 ELSE 1 END) AS t, sum(d) AS seen FROM d, (SELECT unnest(range(200)) AS b) GROUP BY b) SELECT round(100.0 * max(seen) / (SELECT count(*) FROM cases), 4) AS delta, round(count(*) FILTER (abs(t) >= abs(seen)) / 200, 4) AS p FROM s"),
    "cer_boundary_f1": (cer_boundary_f1, f"{RANKING}, r AS (SELECT c.case_id, gold || ' ' || rw AS gold, coalesce(candidate || ' ' || rw, rw) AS said FROM cases c LEFT JOIN (SELECT case_id, candidate FROM a WHERE rank = 0) t USING (case_id)), f AS (SELECT *, list_filter(range(length(said)), lambda i: said[i + 1] = ' ') AS p, list_filter(range(length(gold)), lambda i: gold[i + 1] = ' ') AS g FROM r) SELECT count(*) AS n, round(avg(levenshtein({_ONE_BYTE.format('said')}, {_ONE_BYTE.format('gold')}) / greatest(1, length(gold))), 6) AS cer, round(avg(CASE WHEN len(p) + len(g) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(p, g)) / (len(p) + len(g)) END), 6) AS f1, count(*) FILTER (said = gold) AS exact FROM f"),
    "miss_classifier": (miss_classifier, f"{RANKING}, fr AS (SELECT word, count(*) AS freq FROM (SELECT unnest(ws) AS word FROM docs) GROUP BY word), l AS (SELECT case_id, list(candidate ORDER BY rank) AS cands FROM a WHERE rank < 5 GROUP BY case_id), k AS (SELECT CASE WHEN cands[1] = gold THEN 'hit' WHEN length(gold) <= 2 THEN 'particle_or_too_short' WHEN coalesce(freq, 0) <= 3 THEN 'rare_or_unseen' WHEN len(list_filter(coalesce(cands, []), lambda c: length(c) = length(gold))) > 0 THEN 'same_length_semantic' ELSE 'other' END AS category FROM cases LEFT JOIN l USING (case_id) LEFT JOIN fr ON word = gold) SELECT category, count(*) AS n, CASE category WHEN 'particle_or_too_short' THEN 'short function word' WHEN 'rare_or_unseen' THEN 'rare or unseen word' WHEN 'same_length_semantic' THEN 'plausible word of the same length' ELSE 'other' END AS issue FROM k GROUP BY category"),
    "span_status": (span_status, f"{RANKING}, {_ranks('SELECT * FROM a')}, z AS (SELECT case_id, coalesce(gold_rank < 1, false) AS t1, coalesce(gold_rank < 5, false) AS t5 FROM gr) SELECT CASE WHEN x.t1 AND y.t1 THEN 'all_top1' WHEN x.t5 AND y.t5 THEN 'all_top5' WHEN x.t5 OR y.t5 THEN 'partial' ELSE 'none' END AS status, count(*) AS n FROM z x JOIN z y ON y.case_id = x.case_id + 1 GROUP BY 1"),
    "left_to_right_beam": (left_to_right_beam, f"""WITH {DOCS}, {ITEMS}, {CASES}, {BIGRAMS}, s AS (SELECT item AS item_id, lw FROM cases WHERE pos = 1), c AS (SELECT w1, w2 AS candidate, count(*) AS n FROM bigrams GROUP BY ALL), p AS (SELECT w1, candidate, round(ln(n / sum(n) OVER (PARTITION BY w1)), 6) AS score FROM c), m AS (SELECT w1, candidate, score FROM p QUALIFY row_number() OVER (PARTITION BY w1 ORDER BY score DESC, candidate) <= 10),
b1 AS (SELECT item_id, candidate AS phrase, candidate AS last, score AS total FROM s JOIN m ON lw = w1 WHERE candidate <> lw QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, candidate) <= 3),
b2 AS (SELECT item_id, phrase || ' ' || candidate AS phrase, round(total + score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(total + score, 6) DESC, phrase || ' ' || candidate) - 1 AS rank FROM b1 JOIN m ON last = w1 WHERE candidate <> last QUALIFY rank < 3) SELECT * FROM b2"""),
    "pseudo_perplexity": (pseudo_perplexity, f"WITH {DOCS}, {ITEMS}, {CASES}, {BIGRAMS}, j AS (SELECT w1, w2, count(*) AS n FROM bigrams GROUP BY ALL), s AS (SELECT w1, count(*) AS m FROM bigrams GROUP BY w1), v AS (SELECT count(*) AS v FROM s), l AS (SELECT item, ln((coalesce(n, 0) + 1) / (coalesce(m, 0) + v)) AS lp FROM cases LEFT JOIN j ON j.w1 = lw AND j.w2 = gold LEFT JOIN s ON s.w1 = lw, v) SELECT item, count(*) AS n, round(avg(lp), 6) AS mean_log, round(exp(-avg(lp)), 3) AS perplexity FROM l GROUP BY item"),
    "calibration": (calibration, f"{RANKING}, r AS (SELECT round(exp(score), 6) AS p, (candidate = gold)::INT AS ok FROM a JOIN cases USING (case_id) WHERE rank = 0) SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(ok), 6) AS accuracy FROM r GROUP BY 1"),
}
