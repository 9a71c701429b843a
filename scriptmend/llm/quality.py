"""Quality rules by document and by host, in DataFrame operations only.

A document fails by itself when it has under ``min_words`` words or repeats too much of itself. Failures
are then aggregated by host; each host's failure rate is shrunk towards a beta prior fitted to all hosts by
moments, and a host whose shrunk rate exceeds ``host_limit`` takes its other documents with it.

Hosts are aggregated with partial sums before the shuffle. Rejected hosts, names only, are broadcast, up to
``BROADCAST_HOSTS`` at a time, so that documents are judged where they were read; beyond ``LOTS`` such lots they
are joined, with hosts split by adaptive execution where they are hot.

Defined results: a null text has no words and fails; documents of a null host form a host of their own;
repeated rows count each; an empty table gives an empty result; extra columns are not read. Five-word
windows are compared by 64-bit hashes within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, materialize

BLANK, WINDOW = r"[\x20\x09-\x0D]+", 5
BROADCAST_HOSTS, LOTS = 100_000, 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def _by_hash(hashes: Column) -> Column:
    """(h, i) of each window, sorted, so that windows with one hash are neighbours."""
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def with_metrics(docs: DataFrame, text: Column, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Adds __sm_n_words, __sm_word_chars, __sm_n_symbols, __sm_n_dup_lines, __sm_n_repeat_words and __sm_base_failed."""
    c = lambda n: F.col(OWN + n)
    df = docs.withColumn(OWN + "t", F.coalesce(text, F.lit(""))).withColumn(OWN + "w", words_of(c("t"))).withColumn(OWN + "n_words", F.size(c("w")).cast("long"))
    df = df.withColumn(OWN + "word_chars", F.length(F.translate(c("t"), " \t\n\x0b\f\r", "")).cast("long"))
    df = df.withColumn(OWN + "n_symbols", (F.length(c("t")) - F.length(F.translate(c("t"), "#*$%&|<>", ""))).cast("long"))
    df = df.withColumn(OWN + "lines", F.filter(F.split(c("t"), "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != ""))
    df = df.withColumn(OWN + "n_dup_lines", (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"))
    df = df.withColumn(OWN + "each", F.transform(c("w"), lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(0), F.size(c("each")) - WINDOW), lambda i: F.xxhash64(*(F.get(c("each"), i + k) for k in range(WINDOW))))
    df = df.withColumn(OWN + "hashes", F.when(c("n_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(OWN + "sorted", F.when(F.size(F.array_distinct(c("hashes"))) < F.size(c("hashes")), _by_hash(c("hashes"))))
    twin = lambda j: F.get(c("sorted"), j)["h"]
    found = F.transform(F.sequence(F.lit(0), F.size(c("sorted")) - 1), lambda j: F.when((twin(j) == twin(j - 1)) | (twin(j) == twin(j + 1)), F.get(c("sorted"), j)["i"]))
    df = df.withColumn(OWN + "at", F.when(c("sorted").isNotNull(), F.sort_array(F.filter(found, lambda i: i.isNotNull()))))
    gaps = F.transform(F.sequence(F.lit(1), F.size(c("at")) - 1), lambda j: F.least(F.lit(WINDOW), F.get(c("at"), j) - F.get(c("at"), j - 1)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda a, g: a + g)
    df = df.withColumn(OWN + "n_repeat_words", F.coalesce(F.when(F.size(c("at")) > 1, covered), F.lit(0)).cast("long"))
    df = df.withColumn(OWN + "base_failed", (c("n_words") < min_words) | (100 * c("n_repeat_words") > max_repeat_percent * c("n_words")))
    return df.drop(*(OWN + n for n in ("t", "w", "lines", "each", "hashes", "sorted", "at")))


def rejected_hosts(judged: DataFrame, host_limit: float = 0.5, most_weight: float = 1000.0) -> DataFrame:
    """Hosts whose failure rate, shrunk to the beta prior of all hosts, exceeds ``host_limit``; ``judged`` has __sm_host and __sm_base_failed."""
    hosts = judged.groupBy(OWN + "host").agg(F.count(F.lit(1)).alias(OWN + "n"), F.count_if(OWN + "base_failed").alias(OWN + "failed"))
    rate = F.col(OWN + "failed") / F.col(OWN + "n")
    total = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var")).first()
    mean, var = total["mean"] or 0.0, total["var"] or 0.0
    weight = min(most_weight, max(1.0, mean * (1 - mean) / var - 1)) if var > 0 else most_weight
    shrunk = (F.col(OWN + "failed") + mean * weight) / (F.col(OWN + "n") + weight)
    return hosts.filter(shrunk > host_limit).select(F.col(OWN + "host").alias(OWN + "bad"))


def _kept(judged: DataFrame, host_limit: float) -> DataFrame:
    bad = materialize(rejected_hosts(judged, host_limit), "bad-hosts")
    lots = -(-bad.count() // BROADCAST_HOSTS)
    judged = judged.withColumn(OWN + "kept", ~F.col(OWN + "base_failed"))
    for k in range(lots if lots <= LOTS else 1):
        part = F.broadcast(bad.filter(F.pmod(F.xxhash64(OWN + "bad"), F.lit(lots)) == k)) if lots <= LOTS else bad
        judged = judged.join(part, F.col(OWN + "host") == F.col(OWN + "bad"), "left").withColumn(OWN + "kept", F.col(OWN + "kept") & F.col(OWN + "bad").isNull()).drop(OWN + "bad")
    return judged


def _host(host: Column) -> Column:
    """A key that is never null: a null host is one of its own."""
    return F.coalesce(F.concat(F.lit("="), host), F.lit("null"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 10, max_repeat_percent: int = 20, host_limit: float = 0.5) -> DataFrame:
    """One row per document: its metrics, ``base_failed`` and ``kept``."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), _host(F.col(host_col).cast("string")).alias(OWN + "host"), F.col(text_col).alias(OWN + "text"))
    judged = materialize(with_metrics(own, F.col(OWN + "text"), min_words, max_repeat_percent).drop(OWN + "text"), "quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return _kept(judged, host_limit).select("doc_id", *(F.col(OWN + n).alias(n) for n in names))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_words: int = 10, max_repeat_percent: int = 20, host_limit: float = 0.5) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns."""
    measured = with_metrics(docs.withColumn(OWN + "host", _host(F.col(host_col).cast("string"))), F.col(text_col), min_words, max_repeat_percent)
    judged = materialize(measured.select(*docs.columns, OWN + "host", OWN + "base_failed"), "quality")
    return _kept(judged, host_limit).filter(OWN + "kept").select(*docs.columns)


#: DuckDB SQL for ``judge`` with default parameters.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, row_number() OVER () AS rid FROM documents),
g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, sum(least(5, coalesce(nx - i, 5)))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM d) GROUP BY rid),
m AS (SELECT doc_id, coalesce('=' || source, 'null') AS host, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY host),
p AS (SELECT avg(f / n) AS mu, var_pop(f / n) AS v FROM h),
q AS (SELECT mu, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, mu * (1 - mu) / v - 1)) ELSE 1000.0 END AS k FROM p),
x AS (SELECT host FROM h, q WHERE (f + mu * k) / (n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host NOT IN (SELECT host FROM x) AS kept FROM b
"""
