"""Queries over word sequences, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranking as R
from ..functions import text as X
from ..operators import augment, facets, sequences, splits, validation
from ..operators.context import maybe_broadcast
from .base import DOCS, ITEMS, TOKENS, docs, items, table


def token_scan(spark: SparkSession, sf: str) -> DataFrame:
    ws = F.col("ws")
    return docs(spark, sf).select("doc_id", F.size(ws).alias("n_words"), F.size(F.array_distinct(ws)).alias("n_distinct"), F.size(F.filter(ws, lambda w: F.length(w) > 1)).alias("n_long"), (F.size(ws) >= 20).alias("long_enough"))


def word_frequency(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    n = d.count()
    per = d.select("doc_id", F.explode("ws").alias("word")).groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    out = per.groupBy("word").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("df"))
    return out.withColumn("idf", F.round(R.smoothed_idf(F.lit(n), F.col("df")), 6)).orderBy(F.desc("n"), "word").limit(100)


def rarity_bucket_rollup(spark: SparkSession, sf: str) -> DataFrame:
    freq = docs(spark, sf).select(F.explode("ws").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    own = items(spark, sf).select("item_id", F.explode("ws").alias("word"))
    met = own.join(freq, "word", "left").withColumn("bucket", R.rarity(F.coalesce("n", F.lit(0))))
    return met.rollup("bucket").agg(F.count(F.lit(1)).alias("n_words"), F.count_distinct("word").alias("n_distinct"), F.round(F.avg(F.coalesce("n", F.lit(0))), 4).alias("mean_frequency")).withColumn("bucket", F.coalesce("bucket", F.lit("all")))


def chunk_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.array_chunks(docs(spark, sf), ["doc_id"])


def gap_runs(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.array_runs(docs(spark, sf), ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n_gaps"), F.max("n").alias("longest"), F.min("first").alias("first"))


def role_runs(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.runs(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


def event_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = sequences.runs(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")
    return found.groupBy("event_type", "n").agg(F.count(F.lit(1)).alias("n_runs"))


def gap_length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    found = sequences.array_runs(docs(spark, sf), ["doc_id", "lang"]).withColumn("bucket", R.gap_bucket(F.col("n")))
    out = found.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n_words"))
    return out.withColumn("share", F.round(R.percent(F.col("n_runs"), F.sum("n_runs").over(Window.partitionBy("lang"))), 4))


def preserved_segments(spark: SparkSession, sf: str) -> DataFrame:
    kept = F.transform("ws", lambda w: F.length(w) > 2)
    return sequences.array_runs(docs(spark, sf), ["doc_id"], kept).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_segments"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean_length"))


def span_enumeration(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.spans(items(spark, sf), ["item_id"])


def group_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.group_split(table(spark, sf, "documents"), "source")


def split_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    return splits.overlaps(group_split(spark, sf), "source")


def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return d.join(maybe_broadcast(group_split(spark, sf)), "source").groupBy("split").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.count_distinct("source").alias("n_sources"))


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 25)


def greedy_disjoint_sample(spark: SparkSession, sf: str) -> DataFrame:
    found = sequences.spans(items(spark, sf), ["item_id"])
    return splits.greedy_disjoint(found, "item_id", "n_words", ["start"], 8).select("item_id", "n_words", "start", "gold")


def sample_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return validation.fingerprint(table(spark, sf, "benchmark"), "item_id", "text")


def contamination_ngram(spark: SparkSession, sf: str) -> DataFrame:
    return validation.contamination(docs(spark, sf), items(spark, sf), "doc_id", "item_id")


def noise_injection(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for p in (0.1, 0.25, 0.4):
        part = augment.noise(items(spark, sf), "item_id", p).select("item_id", F.lit(p).alias("level"), F.size(F.filter("noisy", lambda w: w == X.GAP)).alias("n_gaps"), F.sha2(F.array_join("noisy", " "), 256).alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


def word_dropout(spark: SparkSession, sf: str) -> DataFrame:
    return augment.word_dropout(docs(spark, sf), "doc_id").select("doc_id", F.size("augmented").alias("n_left"), F.sha2(F.array_join("augmented", " "), 256).alias("digest")).filter("digest is not null")


def window_shift(spark: SparkSession, sf: str) -> DataFrame:
    return augment.window_shift(docs(spark, sf)).filter("augmented is not null").select("doc_id", F.size("augmented").alias("n_left"), F.sha2(F.array_join("augmented", " "), 256).alias("digest"))


def clitic_join(spark: SparkSession, sf: str) -> DataFrame:
    """The joiner over lower-case texts, with the one-letter words of these languages as prefixes."""
    text = F.array_join("ws", " ")
    pattern = r"(?<!\S)([aeoyéè]) (?=\p{L}{3,}(?!\S))"
    return docs(spark, sf).select("doc_id", F.regexp_count(text, F.lit(pattern)).cast("long").alias("n_joined"), F.sha2(F.regexp_replace(text, pattern, "$1"), 256).alias("digest"))


def restore_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Masks characters of each benchmark text by hash, then restores them from the map."""
    chars = F.split("text", "")
    hidden = lambda i: R.hash_unit(F.lit("hide"), F.col("item_id").cast("string"), i.cast("string")) < 0.2
    df = table(spark, sf, "benchmark").withColumn("text", F.replace(F.col("text"), F.lit("?"), F.lit(".")))
    df = df.withColumn("masked", F.array_join(F.transform(chars, lambda c, i: F.when(hidden(i), "?").otherwise(c)), ""))
    entries = F.filter(F.transform(chars, lambda c, i: F.when(hidden(i), F.struct(i.cast("string").alias("key"), c.alias("value")))), lambda e: e.isNotNull())
    df = df.withColumn("missing", F.map_from_entries(entries))
    return df.select("item_id", F.size("missing").alias("n_masked"), F.sha2("masked", 256).alias("masked_digest"), F.sha2(X.restored(F.col("masked"), F.col("missing")), 256).alias("restored_digest"))


def facet_search_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = facets.search(table(spark, sf, "documents"), {"lang": "en", "source": None}, "the", ("source", "text"))
    return facets.page(rows.select("doc_id", "source", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 2).select("row_no", "doc_id", "source", "n_chars")


def facet_value_union(spark: SparkSession, sf: str) -> DataFrame:
    return facets.facet_values({"lang": (table(spark, sf, "documents"), "lang"), "role": (table(spark, sf, "conversations"), "role"), "event_type": (table(spark, sf, "events"), "event_type")})


ISLANDS = "flag AS (SELECT *, {state} AS f FROM tok), isl AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, f ORDER BY pos) AS g FROM flag), runs AS (SELECT doc_id, lang, g, min(pos) AS first, count(*) AS n FROM isl WHERE f GROUP BY doc_id, lang, g)"
_GAPS = ISLANDS.format(state="length(word) <= 2")
_KEPT = ISLANDS.format(state="length(word) > 2")
_UNIT = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0)"
_SPANS = "spans AS (SELECT item_id, n_words, start, array_to_string(ws[start + 1:start + n_words], ' ') AS gold FROM (SELECT item_id, ws, k AS n_words, unnest(range(8, len(ws) - 8 - k + 1)) AS start FROM items, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= 16 + k) WHERE length(gold) <= 18)"
_SPLIT = "g AS (SELECT source, row_number() OVER (ORDER BY md5('0:' || source), source) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)), h AS (SELECT *, greatest(1, floor(n * 0.3)) AS nh FROM g), s AS (SELECT source, CASE WHEN r < nh THEN 'heldout' WHEN r < nh + greatest(1, floor((n - nh) * 0.2)) THEN 'dev' ELSE 'train' END AS split FROM h)"


def _greedy(k: int, taken: str) -> str:
    return f"h{k} AS (SELECT *, md5('0:' || item_id || ':' || start) AS h FROM spans WHERE n_words = {k} {taken}), p{k} AS (SELECT * FROM h{k} QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY h, start) = 1), t{k} AS (SELECT item_id, n_words, start, gold FROM p{k} QUALIFY row_number() OVER (ORDER BY h, item_id) <= 8)"


QUERIES = {
    "token_scan": (token_scan, f"WITH {DOCS} SELECT doc_id, len(ws) AS n_words, len(list_distinct(ws)) AS n_distinct, len(list_filter(ws, lambda w: length(w) > 1)) AS n_long, len(ws) >= 20 AS long_enough FROM docs"),
    "word_frequency": (word_frequency, f"WITH {DOCS}, {TOKENS}, n AS (SELECT count(*) AS n_docs FROM docs) SELECT word, count(*) AS n, count(DISTINCT doc_id) AS df, round(ln((any_value(n_docs) + 1) / (count(DISTINCT doc_id) + 0.5)) + 1, 6) AS idf FROM tok, n GROUP BY word ORDER BY n DESC, word LIMIT 100"),
    "rarity_bucket_rollup": (rarity_bucket_rollup, f"WITH {DOCS}, {ITEMS}, {TOKENS}, f AS (SELECT word, count(*) AS n FROM tok GROUP BY word), o AS (SELECT item_id, unnest(ws) AS word FROM items), m AS (SELECT word, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'unseen' WHEN n <= 3 THEN 'rare' WHEN n <= 20 THEN 'medium' ELSE 'common' END AS bucket FROM o LEFT JOIN f USING (word)) SELECT coalesce(bucket, 'all') AS bucket, count(*) AS n_words, count(DISTINCT word) AS n_distinct, round(avg(n), 4) AS mean_frequency FROM m GROUP BY GROUPING SETS ((bucket), ())"),
    "chunk_tumbling": (chunk_tumbling, f"WITH {DOCS}, {TOKENS} SELECT doc_id, pos // 128 AS chunk_index, count(*) AS n_units, count(*) FILTER (length(word) > 2) AS n_kept FROM tok GROUP BY ALL HAVING count(*) FILTER (length(word) > 2) >= 20"),
    "gap_runs": (gap_runs, f"WITH {DOCS}, {TOKENS}, {_GAPS} SELECT doc_id, count(*) AS n_runs, sum(n)::BIGINT AS n_gaps, max(n) AS longest, min(first) AS first FROM runs GROUP BY doc_id"),
    "role_runs": (role_runs, "WITH c AS (SELECT conv_id, turn, role, coalesce((role <> lag(role) OVER w)::INT, 0) AS ch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run_index FROM c) SELECT conv_id, run_index, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM i GROUP BY conv_id, run_index, role"),
    "event_runs": (event_runs, "WITH c AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events), r AS (SELECT user_id, event_type, g, count(*) AS n FROM c GROUP BY ALL) SELECT event_type, n, count(*) AS n_runs FROM r GROUP BY ALL"),
    "gap_length_buckets": (gap_length_buckets, f"WITH {DOCS}, {TOKENS}, {_GAPS}, b AS (SELECT lang, CASE WHEN n <= 3 THEN n::VARCHAR WHEN n <= 5 THEN '4-5' ELSE '6+' END AS bucket, count(*) AS n_runs, sum(n)::BIGINT AS n_words FROM runs GROUP BY ALL) SELECT *, round(100.0 * n_runs / sum(n_runs) OVER (PARTITION BY lang), 4) AS share FROM b"),
    "preserved_segments": (preserved_segments, f"WITH {DOCS}, {TOKENS}, {_KEPT} SELECT doc_id, count(*) AS n_segments, max(n) AS longest, round(avg(n), 6) AS mean_length FROM runs GROUP BY doc_id"),
    "span_enumeration": (span_enumeration, f"WITH {ITEMS}, {_SPANS} SELECT * FROM spans"),
    "group_split": (group_split, f"WITH {_SPLIT} SELECT * FROM s"),
    "split_disjoint": (split_disjoint, f"WITH {_SPLIT}, p AS (SELECT * FROM (VALUES ('dev', 'heldout'), ('dev', 'train'), ('heldout', 'train')) t(a, b)) SELECT a || '|' || b AS pair, (SELECT count(*) FROM (SELECT source FROM s WHERE split = a INTERSECT SELECT source FROM s WHERE split = b)) AS n_common FROM p"),
    "split_sizes": (split_sizes, f"WITH {_SPLIT} SELECT split, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, count(DISTINCT source) AS n_sources FROM documents JOIN s USING (source) GROUP BY split"),
    "stratified_sample": (stratified_sample, "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) <= 25"),
    "greedy_disjoint_sample": (greedy_disjoint_sample, f"WITH {ITEMS}, {_SPANS}, {_greedy(3, '')}, {_greedy(2, 'AND item_id NOT IN (SELECT item_id FROM t3)')}, {_greedy(1, 'AND item_id NOT IN (SELECT item_id FROM t3 UNION ALL SELECT item_id FROM t2)')} SELECT * FROM t3 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t1"),
    "sample_fingerprint": (sample_fingerprint, "SELECT count(*) AS n, sha256(string_agg(item_id || chr(9) || text, chr(10) ORDER BY item_id || chr(9) || text)) AS sha256 FROM benchmark"),
    "contamination_ngram": (contamination_ngram, f"WITH {DOCS}, {ITEMS}, q AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 12], ' ') AS gram FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM items WHERE len(ws) >= 13)), k AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 12], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM docs WHERE len(ws) >= 13)), t AS (SELECT item_id, count(*) AS n_grams FROM q GROUP BY item_id), f AS (SELECT item_id, count(DISTINCT gram) AS n_found, count(DISTINCT doc_id) AS n_docs FROM q JOIN k USING (gram) GROUP BY item_id) SELECT item_id, n_grams, coalesce(n_found, 0) AS n_found, coalesce(n_docs, 0) AS n_docs FROM t LEFT JOIN f USING (item_id)"),
    "noise_injection": (noise_injection, f"WITH {ITEMS}, l AS (SELECT unnest([0.1, 0.25, 0.4])::DOUBLE AS level), n AS (SELECT item_id, level, list_transform(ws, lambda w, i: CASE WHEN {_UNIT.format('''concat('noise', level, ':', item_id, ':', i - 1)''')} < level THEN '<GAP>' ELSE w END) AS x FROM items, l) SELECT item_id, level, len(list_filter(x, lambda w: w = '<GAP>')) AS n_gaps, sha256(array_to_string(x, ' ')) AS digest FROM n"),
    "word_dropout": (word_dropout, f"WITH {DOCS}, {TOKENS}, k AS (SELECT doc_id, list(word ORDER BY pos) FILTER ({_UNIT.format('''concat('drop:', doc_id, ':', pos)''')} >= 0.1) AS x, count(*) AS n FROM tok GROUP BY doc_id) SELECT doc_id, len(x) AS n_left, sha256(array_to_string(x, ' ')) AS digest FROM k WHERE len(x) < n AND len(x) >= 5"),
    "window_shift": (window_shift, f"WITH {DOCS} SELECT doc_id, len(ws) - 3 AS n_left, sha256(array_to_string(ws[4:], ' ')) AS digest FROM docs WHERE len(ws) - 3 >= 5"),
    "clitic_join": (clitic_join, f"WITH {DOCS}, {TOKENS}, j AS (SELECT doc_id, pos, word, word IN ('a', 'e', 'o', 'y', 'é', 'è') AND length(coalesce(lead(word) OVER w, '')) >= 3 AS joined FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), n AS (SELECT doc_id, count(*) FILTER (joined) AS n_joined, rtrim(string_agg(CASE WHEN joined THEN word ELSE word || ' ' END, '' ORDER BY pos), ' ') AS t FROM j GROUP BY doc_id) SELECT d.doc_id, coalesce(n_joined, 0) AS n_joined, sha256(coalesce(t, '')) AS digest FROM docs d LEFT JOIN n ON d.doc_id = n.doc_id"),
    "restore_masked": (restore_masked, f"WITH t AS (SELECT item_id, replace(text, '?', '.') AS text FROM benchmark), c AS (SELECT item_id, text, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM t), m AS (SELECT item_id, any_value(text) AS text, count(*) FILTER ({_UNIT.format('''concat('hide:', item_id, ':', i)''')} < 0.2) AS n_masked, string_agg(CASE WHEN {_UNIT.format('''concat('hide:', item_id, ':', i)''')} < 0.2 THEN '?' ELSE c END, '' ORDER BY i) AS masked FROM c GROUP BY item_id) SELECT item_id, n_masked, sha256(masked) AS masked_digest, sha256(text) AS restored_digest FROM m"),
    "facet_search_page": (facet_search_page, "WITH f AS (SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND contains(lower(source || ' ' || text), 'the')), r AS (SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS row_no, * FROM f), p AS (SELECT least(2, greatest(1, ceil(count(*) / 80)))::BIGINT AS page FROM f) SELECT row_no, doc_id, source, n_chars FROM r, p WHERE row_no > (page - 1) * 80 AND row_no <= page * 80"),
    "facet_value_union": (facet_value_union, "SELECT 'lang' AS facet, lang AS value FROM documents UNION SELECT 'role', role FROM conversations UNION SELECT 'event_type', event_type FROM events"),
}
