"""Queries of error analysis, beams over two missing words, and shapes of candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranking as R
from ..operators import beams, context, shaping
from ..operators import candidates as C
from .base import BIGRAMS, CASES, DOCS, ITEMS, RANKING, cases, docs, items, one_system, systems
from .lookup import _windows

_WIDTH = 3


def _models(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Whole candidate lists of every word by the word before (w1) and after (w2), uncut."""
    pairs = C.bigrams(docs(spark, sf))
    out = []
    for given, wanted in (("w1", "w2"), ("w2", "w1")):
        counts = pairs.groupBy(given, F.col(wanted).alias("candidate")).agg(F.count(F.lit(1)).alias("n"))
        totals = pairs.groupBy(given).agg(F.count(F.lit(1)).alias("m"))
        out.append(counts.join(totals, given).select(given, "candidate", F.round(F.log(F.col("n") / F.col("m")), 6).alias("score")))
    return out[0], out[1]


def _two_missing(spark: SparkSession, sf: str) -> DataFrame:
    """One case an item with four words or more: its second and third word are missing."""
    ws = F.col("ws")
    return items(spark, sf).filter(F.size(ws) >= 4).select(F.col("item_id").alias("case_id"), F.get(ws, 0).alias("lw"), F.get(ws, 3).alias("rw"), F.left(F.get(ws, 1), F.lit(1)).alias("first"), F.left(F.get(ws, 2), F.lit(1)).alias("second"))


def independent_beam(spark: SparkSession, sf: str) -> DataFrame:
    after, before = _models(spark, sf)
    return beams.independent(_two_missing(spark, sf), after, before, _WIDTH)


def easy_first_beam(spark: SparkSession, sf: str) -> DataFrame:
    after, before = _models(spark, sf)
    return beams.easy_first(_two_missing(spark, sf), after, before, _WIDTH)


def retrieval_beam(spark: SparkSession, sf: str) -> DataFrame:
    after, _ = _models(spark, sf)
    ws = F.col("ws")
    triples = docs(spark, sf).filter(F.size(ws) > 2).select(F.explode(F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.struct(F.get(ws, i).alias("w0"), F.get(ws, i + 1).alias("w1"), F.get(ws, i + 2).alias("candidate")))).alias("t")).select("t.*")
    own = _two_missing(spark, sf)
    counts = triples.join(context.maybe_broadcast(own.select(F.col("lw").alias("w0")).distinct()), "w0", "left_semi").groupBy("w0", "w1", "candidate").agg(F.count(F.lit(1)).alias("n"))
    return beams.with_retrieval(own, after, counts, 0.5, _WIDTH)


def pattern_beam(spark: SparkSession, sf: str) -> DataFrame:
    after, _ = _models(spark, sf)
    return beams.with_pattern(_two_missing(spark, sf), after, F.left("candidate", F.lit(1)) == F.col("second"), _WIDTH)


def conjecture_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Conjectures for each case, the gold word and the model's five best, by the sum of their log shares after the word before and before the word after (-12 where never seen)."""
    c, pairs = cases(spark, sf), C.bigrams(docs(spark, sf))
    after = C.neighbour_scores(pairs, "w1", "w2", c.select(F.col("lw").alias("w1")))
    before = C.neighbour_scores(pairs, "w2", "w1", c.select(F.col("rw").alias("w2")))
    said = one_system(systems(spark, sf), "next").filter("rank < 5").select("case_id", "candidate").unionByName(c.select("case_id", F.col("gold").alias("candidate"))).distinct()
    met = said.join(c, "case_id").join(after.select(F.col("w1").alias("lw"), "candidate", F.col("score").alias("x")), ["lw", "candidate"], "left").join(before.select(F.col("w2").alias("rw"), "candidate", F.col("score").alias("y")), ["rw", "candidate"], "left")
    scored = met.withColumn("score", F.round(F.coalesce("x", F.lit(-12.0)) + F.coalesce("y", F.lit(-12.0)), 6))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "candidate")) - 1
    return scored.withColumn("place", place).filter("candidate = gold").select("case_id", "gold", "score", "place")


def relaxed_parallel(spark: SparkSession, sf: str) -> DataFrame:
    """Cases with a parallel at each width, over all contexts and over those whose words all have three letters or more, and how often its commonest target is the gold word."""
    asked = context.lookup_cases(items(spark, sf), ["item_id"])
    index = context.parallel_index(docs(spark, sf), asked, "source")
    kept = ~F.exists(F.split(F.concat_ws(" ", "lctx", "rctx"), " "), lambda w: F.length(w) < 3)
    met = asked.join(index.withColumn("strict", kept), ["w", "lctx", "rctx"])
    modes = F.when(F.col("strict"), F.array(F.lit("relaxed"), F.lit("strict"))).otherwise(F.array(F.lit("relaxed")))
    by = met.withColumn("mode", F.explode(modes)).groupBy("mode", "w", "item_id", "pos", "gold", "target").agg(F.sum("n").alias("support"))
    best = F.row_number().over(Window.partitionBy("mode", "w", "item_id", "pos").orderBy(F.desc("support"), "target"))
    return by.withColumn("r", best).filter("r = 1").groupBy("mode", "w").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("gold") == F.col("target")).alias("correct"))


def graded_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised discounted gain and recall at 10 and 20 of each system; every case has one gold word."""
    c = cases(spark, sf)
    hits = systems(spark, sf).join(c.select("case_id", "gold"), "case_id").filter("candidate = gold").groupBy("system", "case_id").agg(F.min("rank").alias("r"))
    n = c.count()
    at = lambda k: [F.round(F.sum(F.when(F.col("r") < k, 1 / F.log2(F.col("r") + 2)).otherwise(0.0)) / n, 6).alias(f"ndcg{k}"), F.round(F.count_if(F.col("r") < k) / n, 6).alias(f"recall{k}")]
    return hits.groupBy("system").agg(*at(10), *at(20))


def selective_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Cases answered, share abstained from and accuracy, if only first candidates of at least a share of the model's mass count."""
    c = cases(spark, sf)
    top = one_system(systems(spark, sf), "next").filter("rank = 0").join(c.select("case_id", "gold"), "case_id").withColumn("p", F.round(F.exp("score"), 6))
    n = c.count()
    cut = top.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in (0.0, 0.1, 0.25, 0.5))))).filter(F.col("p") >= F.col("threshold"))
    return cut.groupBy("threshold").agg(F.count(F.lit(1)).alias("answered"), F.round(1 - F.count(F.lit(1)) / n, 6).alias("abstained"), F.round(F.count_if(F.col("candidate") == F.col("gold")) / F.count(F.lit(1)), 6).alias("accuracy"))


def length_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of each case that the length filters leave."""
    met = one_system(systems(spark, sf), "next").join(cases(spark, sf).select("case_id", "gold", "rw"), "case_id")
    phrase, gold = F.concat_ws(" ", "candidate", "rw"), F.concat_ws(" ", "gold", "rw")
    return met.groupBy("case_id").agg(F.count_if(shaping.exact_length(F.col("candidate"), F.col("gold"))).alias("n_exact"), F.count_if(shaping.soft_length(F.col("candidate"), F.col("gold"))).alias("n_soft"), F.count_if(shaping.same_boundaries(phrase, gold)).alias("n_same_boundaries"), F.count_if(shaping.short_first(F.col("candidate"), F.col("gold")) & (F.col("rank") == 0)).alias("n_short_first"))


def wide_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The five first candidates of three letters or more as columns, as a cell, and how many there are."""
    lists = shaping.candidate_lists(one_system(systems(spark, sf), "next"), ["case_id"], 5, 3)
    wide = lists.select("case_id", *shaping.wide(F.col("candidates"), 5))
    names = [f"top{k}" for k in range(1, 6)]
    return wide.withColumn("cell", shaping.cell(shaping.narrow(names))).withColumn("n_candidates", F.size(shaping.narrow(names)))


def error_bins(spark: SparkSession, sf: str) -> DataFrame:
    """First candidates that are wrong by their length against the gold word, and the first three of each bin with a snippet."""
    c = cases(spark, sf)
    top = one_system(systems(spark, sf), "next").filter("rank = 0").join(c, "case_id").filter("candidate <> gold")
    size, gold = F.length("candidate"), F.length("gold")
    binned = top.withColumn("bin", F.when(size + 1 < gold, "short").when(size == gold, "same_length").otherwise("other"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    met = shaping.first_examples(binned, ["bin"], ["case_id"], 3).join(items(spark, sf).select(F.col("item_id").alias("item"), "ws"), "item")
    return met.join(counts, "bin").select("bin", "n", "case_id", shaping.snippet(F.col("ws"), F.col("pos"), 3).alias("snippet"))


def frequency_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Words and stems (the first four letters) with their counts, in one pass: the commonest 50 of each."""
    words = docs(spark, sf).select(F.explode("ws").alias("word")).withColumn("stem", F.left("word", F.lit(4)))
    counts = words.groupingSets([["word"], ["stem"]], "word", "stem").agg(F.count(F.lit(1)).alias("n"), F.grouping("stem").alias("of_word"))
    rows = counts.select(F.when(F.col("of_word") == 1, "word").otherwise("stem").alias("kind"), F.coalesce("word", "stem").alias("value"), "n")
    return shaping.first_examples(rows, ["kind"], [F.desc("n"), "value"], 50)


def merged_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of each case, one a row, with the systems that give it and the best rank."""
    rows = systems(spark, sf).filter("rank < 5")
    return rows.groupBy("case_id", F.col("candidate").alias("reading")).agg(F.array_join(F.sort_array(F.collect_set("system")), ",").alias("sources"), F.min("rank").alias("best"), F.count(F.lit(1)).alias("n"))


def witness_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Languages with documents of two sources or more: sources, documents, and their words of two letters or more."""
    return docs(spark, sf).groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("documents"), F.sum(F.size(F.filter("ws", lambda w: F.length(w) >= 2))).alias("words")).filter("sources >= 2")


def corpus_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Of item words: share unknown to the documents, share of two letters or more, mean letters."""
    known = docs(spark, sf).select(F.explode("ws").alias("word")).distinct().withColumn("known", F.lit(True))
    words = items(spark, sf).select(F.explode("ws").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(known, "word", "left")
    share = lambda what: F.round(F.sum(F.when(what, F.col("n")).otherwise(0)) / F.sum("n"), 6)
    return words.agg(share(F.col("known").isNull()).alias("unknown"), share(F.length("word") >= 2).alias("eligible"), F.round(F.sum(F.col("n") * F.length("word")) / F.sum("n"), 6).alias("mean_letters"))


def kept_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Cases with six words of three letters or more within eight places: the window of those, and where the case's word then stands."""
    rows = cases(spark, sf).join(items(spark, sf).select(F.col("item_id").alias("item"), "ws"), "item")
    keep = lambda w: F.length(w) >= 3
    window, at = shaping.kept_window(F.col("ws"), F.col("pos"), 8, keep)
    return rows.filter(shaping.enough_context(F.col("ws"), F.col("pos"), 8, 6, keep)).select(shaping.item_id(F.col("item"), F.col("pos")).alias("id"), F.array_join(window, " ").alias("window"), at.alias("target"))


def phrase_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Two-word phrases of the independent beam against the gold words: share of cases without any, words hit at 1 and 3 (per gold word), mean error of the letters' number."""
    ws = F.col("ws")
    gold = items(spark, sf).filter(F.size(ws) >= 4).select(F.col("item_id").alias("case_id"), F.get(ws, 1).alias("g1"), F.get(ws, 2).alias("g2"))
    said = independent_beam(spark, sf).withColumn("p", F.split("phrase", " "))
    met = gold.join(said, "case_id", "left")
    hit = lambda k, g, i: F.max(((F.col("rank") < k) & (F.get("p", F.lit(i)) == F.col(g))).cast("int"))
    per = met.groupBy("case_id").agg(*(F.coalesce(hit(k, g, i), F.lit(0)).alias(f"h{k}{i}") for k in (1, 3) for i, g in enumerate(("g1", "g2"))), F.max(F.when(F.col("rank") == 0, F.abs(F.length("phrase") - F.length("g1") - F.length("g2") - 1))).alias("off"))
    n = F.count(F.lit(1))
    return per.agg(n.alias("n"), F.round(R.percent(F.count_if(F.col("off").isNull()), n), 4).alias("failed"), *(F.round(R.percent(F.sum(F.col(f"h{k}0") + F.col(f"h{k}1")), 2 * n), 4).alias(f"word_hit{k}") for k in (1, 3)), F.round(F.avg("off"), 6).alias("mean_error"))


_AFTER = "c1 AS (SELECT w1, w2 AS candidate, count(*) AS n FROM bigrams GROUP BY ALL), after AS (SELECT w1, candidate, round(ln(n / sum(n) OVER (PARTITION BY w1)), 6) AS score FROM c1)"
_BEFORE = "c2 AS (SELECT w2, w1 AS candidate, count(*) AS n FROM bigrams GROUP BY ALL), before AS (SELECT w2, candidate, round(ln(n / sum(n) OVER (PARTITION BY w2)), 6) AS score FROM c2)"
_TWO = "two AS (SELECT item_id AS case_id, ws[1] AS lw, ws[4] AS rw, left(ws[2], 1) AS first, left(ws[3], 1) AS second, ws[2] AS g1, ws[3] AS g2 FROM items WHERE len(ws) >= 4)"
_BEAM = f"WITH {DOCS}, {ITEMS}, {BIGRAMS}, {_AFTER}, {_BEFORE}, {_TWO}"
_LEFT = "l AS (SELECT case_id, lw, candidate AS x, score AS sx FROM two JOIN after ON lw = w1 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY round(score, 6) DESC, candidate) <= 3)"
_RIGHT = "r AS (SELECT case_id, candidate AS y, score AS sy FROM two JOIN before ON rw = w2 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY round(score, 6) DESC, candidate) <= 3)"


def _phrases(sql: str) -> str:
    return f"z AS (SELECT case_id, phrase, round(score, 6) AS score, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 6) DESC, phrase) - 1 AS rank FROM ({sql}) QUALIFY rank < 3)"


_INDEPENDENT = f"{_BEAM}, {_LEFT}, {_RIGHT}, {_phrases(chr(39).join(['SELECT case_id, x || ', ' ', ' || y AS phrase, sx + sy AS score FROM l JOIN r USING (case_id)']))}"
_SNIPPET = "array_to_string(list_concat(list_concat(ws[greatest(pos - 3, 0) + 1:pos], ['⟦' || ws[pos + 1] || '⟧']), ws[pos + 2:pos + 4]), ' ')"

QUERIES = {
    "independent_beam": (independent_beam, f"{_INDEPENDENT} SELECT * FROM z"),
    "easy_first_beam": (easy_first_beam, f"{_BEAM}, {_LEFT}, {_RIGHT}, s AS (SELECT case_id, coalesce(mx, -1e9) >= coalesce(my, -1e9) AS fwd FROM (SELECT case_id, max(sx) AS mx FROM l GROUP BY 1) FULL JOIN (SELECT case_id, max(sy) AS my FROM r GROUP BY 1) USING (case_id)), "
     + _phrases("SELECT case_id, x || ' ' || candidate AS phrase, sx + score AS score FROM l JOIN s USING (case_id) JOIN after ON x = w1 WHERE fwd UNION ALL SELECT case_id, candidate || ' ' || y, sy + score FROM r JOIN s USING (case_id) JOIN before ON y = w2 WHERE NOT fwd") + " SELECT * FROM z"),
    "retrieval_beam": (retrieval_beam, f"{_BEAM}, {_LEFT}, t AS (SELECT w0, w1, candidate, count(*) AS n FROM (SELECT ws[i] AS w0, ws[i + 1] AS w1, ws[i + 2] AS candidate FROM (SELECT ws, unnest(range(1, len(ws) - 1)) AS i FROM docs WHERE len(ws) > 2)) GROUP BY ALL), "
     + _phrases("SELECT case_id, x || ' ' || after.candidate AS phrase, sx + after.score + 0.5 * ln(1 + coalesce(n, 0)) AS score FROM l JOIN after ON x = after.w1 LEFT JOIN t ON t.w0 = lw AND t.w1 = x AND t.candidate = after.candidate") + " SELECT * FROM z"),
    "pattern_beam": (pattern_beam, f"{_BEAM}, l AS (SELECT case_id, second, candidate AS x, score AS sx FROM two JOIN after ON lw = w1 WHERE left(candidate, 1) = first QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY round(score, 6) DESC, candidate) <= 3), "
     + _phrases("SELECT case_id, x || ' ' || candidate AS phrase, sx + score AS score FROM l JOIN after ON x = w1 WHERE left(candidate, 1) = second") + " SELECT * FROM z"),
    "conjecture_ranking": (conjecture_ranking, f"{RANKING}, {_AFTER}, {_BEFORE}, s AS (SELECT case_id, candidate FROM a WHERE rank < 5 UNION SELECT case_id, gold FROM cases), m AS (SELECT case_id, gold, s.candidate, round(coalesce(x.score, -12.0) + coalesce(y.score, -12.0), 6) AS score FROM s JOIN cases USING (case_id) LEFT JOIN after x ON x.w1 = lw AND x.candidate = s.candidate LEFT JOIN before y ON y.w2 = rw AND y.candidate = s.candidate), p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, candidate) - 1 AS place FROM m) SELECT case_id, gold, score, place FROM p WHERE candidate = gold"),
    "relaxed_parallel": (relaxed_parallel, f"WITH {DOCS}, {ITEMS}, {_windows('q', 'items', 'item_id')}, {_windows('k', 'docs', 'source')}, m AS (SELECT q.w, item_id, q.i, q.target AS gold, k.target, len(list_filter(string_split(k.lctx || ' ' || k.rctx, ' '), lambda x: length(x) < 3)) = 0 AS strict FROM q JOIN k ON q.w = k.w AND q.lctx = k.lctx AND q.rctx = k.rctx), o AS (SELECT 'relaxed' AS mode, * FROM m UNION ALL SELECT 'strict', * FROM m WHERE strict), g AS (SELECT mode, w, item_id, i, gold, target, count(*) AS n FROM o GROUP BY ALL), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY mode, w, item_id, i ORDER BY n DESC, target) = 1) SELECT mode, w, count(*) AS matched, count(*) FILTER (gold = target) AS correct FROM b GROUP BY ALL"),
    "graded_metrics": (graded_metrics, f"{RANKING}, u AS (SELECT 'next' AS system, * FROM a UNION ALL SELECT 'prev', * FROM b), h AS (SELECT system, case_id, min(rank) AS r FROM u JOIN cases USING (case_id) WHERE candidate = gold GROUP BY ALL), n AS (SELECT count(*) AS n FROM cases) SELECT system, " + ", ".join(f"round(sum(CASE WHEN r < {k} THEN 1 / log2(r + 2) ELSE 0 END) / any_value(n), 6) AS ndcg{k}, round(count(*) FILTER (r < {k}) / any_value(n), 6) AS recall{k}" for k in (10, 20)) + " FROM h, n GROUP BY system"),
    "selective_accuracy": (selective_accuracy, f"{RANKING}, t AS (SELECT round(exp(score), 6) AS p, candidate = gold AS ok FROM a JOIN cases USING (case_id) WHERE rank = 0), n AS (SELECT count(*) AS n FROM cases) SELECT threshold, count(*) AS answered, round(1 - count(*) / any_value(n), 6) AS abstained, round(count(*) FILTER (ok) / count(*), 6) AS accuracy FROM t, n, (SELECT unnest([0.0, 0.1, 0.25, 0.5]::DOUBLE[]) AS threshold) WHERE p >= threshold GROUP BY threshold"),
    "length_filters": (length_filters, f"{RANKING} SELECT case_id, count(*) FILTER (length(candidate) = length(gold)) AS n_exact, count(*) FILTER (length(candidate) >= length(gold) - 1) AS n_soft, count(*) FILTER (length(candidate) = length(gold)) AS n_same_boundaries, count(*) FILTER (length(candidate) + 1 < length(gold) AND rank = 0) AS n_short_first FROM a JOIN cases USING (case_id) GROUP BY case_id"),
    "wide_candidates": (wide_candidates, f"{RANKING}, l AS (SELECT case_id, list(candidate ORDER BY rank)[1:5] AS c FROM a WHERE length(candidate) >= 3 GROUP BY case_id) SELECT case_id, " + ", ".join(f"coalesce(c[{k}], '') AS top{k}" for k in range(1, 6)) + ", array_to_string(c, ' | ') AS cell, len(c) AS n_candidates FROM l"),
    "error_bins": (error_bins, f"{RANKING}, e AS (SELECT case_id, item, pos, CASE WHEN length(candidate) + 1 < length(gold) THEN 'short' WHEN length(candidate) = length(gold) THEN 'same_length' ELSE 'other' END AS bin FROM a JOIN cases USING (case_id) WHERE rank = 0 AND candidate <> gold), k AS (SELECT *, count(*) OVER (PARTITION BY bin) AS n FROM e QUALIFY row_number() OVER (PARTITION BY bin ORDER BY case_id) <= 3) SELECT bin, n, case_id, {_SNIPPET} AS snippet FROM k JOIN items ON item = item_id"),
    "frequency_sets": (frequency_sets, f"WITH {DOCS}, t AS (SELECT unnest(ws) AS word FROM docs), f AS (SELECT 'word' AS kind, word AS value, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'stem', left(word, 4), count(*) FROM t GROUP BY ALL) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) <= 50"),
    "merged_readings": (merged_readings, f"{RANKING}, u AS (SELECT 'next' AS system, * FROM a UNION ALL SELECT 'prev', * FROM b) SELECT case_id, candidate AS reading, string_agg(system, ',' ORDER BY system) AS sources, min(rank) AS best, count(*) AS n FROM u WHERE rank < 5 GROUP BY ALL"),
    "witness_counts": (witness_counts, f"WITH {DOCS} SELECT lang, count(DISTINCT source) AS sources, count(*) AS documents, sum(len(list_filter(ws, lambda w: length(w) >= 2)))::BIGINT AS words FROM docs GROUP BY lang HAVING count(DISTINCT source) >= 2"),
    "corpus_shares": (corpus_shares, f"WITH {DOCS}, {ITEMS}, v AS (SELECT DISTINCT unnest(ws) AS word FROM docs), w AS (SELECT unnest(ws) AS word FROM items) SELECT round(count(*) FILTER (word NOT IN (SELECT word FROM v)) / count(*), 6) AS unknown, round(count(*) FILTER (length(word) >= 2) / count(*), 6) AS eligible, round(sum(length(word)) / count(*), 6) AS mean_letters FROM w"),
    "kept_windows": (kept_windows, f"WITH {ITEMS}, {CASES}, k AS (SELECT item, pos, list_filter(ws[greatest(pos - 8, 0) + 1:pos], lambda w: length(w) >= 3) AS l, ws[pos + 1] AS g, list_filter(ws[pos + 2:pos + 9], lambda w: length(w) >= 3) AS r FROM cases JOIN items ON item = item_id) SELECT item || ':' || pos AS id, array_to_string(list_concat(list_concat(l, [g]), r), ' ') AS \"window\", len(l) AS target FROM k WHERE len(l) + len(r) >= 6"),
    "phrase_metrics": (phrase_metrics, f"{_INDEPENDENT}, m AS (SELECT case_id, g1, g2, phrase, rank FROM two LEFT JOIN z USING (case_id)), p AS (SELECT case_id, " + ", ".join(f"coalesce(max((rank < {k} AND split_part(phrase, ' ', {i + 1}) = {g})::INT), 0) AS h{k}{i}" for k in (1, 3) for i, g in enumerate(("g1", "g2"))) + ", max(abs(length(phrase) - length(g1) - length(g2) - 1)) FILTER (rank = 0) AS off FROM m GROUP BY case_id) SELECT count(*) AS n, round(100.0 * count(*) FILTER (off IS NULL) / count(*), 4) AS failed, round(100.0 * sum(h10 + h11) / (2 * count(*)), 4) AS word_hit1, round(100.0 * sum(h30 + h31) / (2 * count(*)), 4) AS word_hit3, round(avg(off), 6) AS mean_error FROM p"),
}
