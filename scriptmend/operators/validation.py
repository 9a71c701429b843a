"""Checks that data and splits are what they claim; each returns rows that break the rule, or counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .sequences import ngrams


def bad_tokens(chunks: DataFrame) -> DataFrame:
    """Chunks with a token that is neither Hebrew letters nor a gap."""
    return chunks.filter(~F.forall(X.split_words(F.col("text")), lambda t: (t == X.GAP) | X.is_token(t)))


def wrong_counters(chunks: DataFrame) -> DataFrame:
    """Chunks whose counters differ from their text."""
    ws = X.split_words(F.col("text"))
    gaps = F.size(F.filter(ws, lambda w: w == X.GAP))
    return chunks.filter((F.size(ws) != F.col("n_units")) | (gaps != F.col("n_gap_slots")) | (F.size(ws) - gaps != F.col("n_preserved_words")))


def ragged_lacunae(lacunae: DataFrame) -> DataFrame:
    n = F.col("gap_word_count_estimate")
    return lacunae.filter((F.size("visible_patterns") != n) | (F.size("source_word_nodes") != n))


def not_rederived(lacunae: DataFrame, events: DataFrame) -> DataFrame:
    """Nodes of lacunae that are no gap of that pattern in the events derived anew, or whose pattern has other than letters and ``?``."""
    told = lacunae.select(F.explode(F.arrays_zip(F.col("source_word_nodes").alias("word_node"), F.col("visible_patterns").alias("pattern"))).alias("p")).select("p.*")
    gaps = events.filter("kind = 'gap'").select("word_node", "pattern")
    legal = F.coalesce(F.col("pattern").rlike(f"^[{X.LETTERS}?]*$"), F.lit(False))
    return told.filter(legal).join(gaps, ["word_node", "pattern"], "left_anti").unionByName(told.filter(~legal))


def checked_labels(metadata: dict, required: dict) -> dict:
    """The metadata, or an error if a label that is required is absent or differs."""
    wrong = sorted(k for k, v in required.items() if metadata.get(k) != v)
    if wrong:
        raise ValueError(f"labels differ: {', '.join(wrong)}")
    return metadata


def outside_split(chunks: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Chunks whose group is not in the split they name."""
    return chunks.join(splits, [key, "split"], "left_anti")


def visible_gold(cases: DataFrame, context: str = "context", gold: str = "gold") -> DataFrame:
    """Cases whose masked context still shows the gold word."""
    return cases.filter(F.array_contains(context, F.col(gold)))


def contamination(docs: DataFrame, items: DataFrame, key: str, item: str, n: int = 13) -> DataFrame:
    """item, n_grams, n_found, n_docs: distinct n-word strings of each item that some document has.

    Grams are joined by hash and then compared. The hashes of the items' grams are broadcast if they are few; else a
    document's grams are spelled out before they are shuffled.
    """
    text = lambda g: F.array_join(g, " ")
    asked = items.select(item, F.explode(F.array_distinct(F.transform(ngrams(F.col("ws"), n), text))).alias("gram"))
    known = docs.select(key, "ws", F.posexplode(F.transform(ngrams(F.col("ws"), n), lambda g: F.xxhash64(text(g)))).alias("pos", "h"))
    spelled = lambda df: df.withColumn("held", text(F.slice("ws", F.col("pos") + 1, F.lit(n)))).drop("ws", "pos")
    hashes = asked.select(F.xxhash64("gram").alias("h"), "gram", item)
    few = hashes.limit(500_001).count() <= 500_000
    met = (spelled(known.join(F.broadcast(hashes), "h")) if few else spelled(known).join(hashes, "h")).filter("held = gram")
    found = met.groupBy(item).agg(F.countDistinct("gram").alias("n_found"), F.countDistinct(key).alias("n_docs"))
    total = asked.groupBy(item).agg(F.count(F.lit(1)).alias("n_grams"))
    return total.join(found, item, "left").fillna(0, ["n_found", "n_docs"])


def fingerprint(rows: DataFrame, key: str, value: str) -> DataFrame:
    """n, sha256 of the sorted lines key, tab, value: the same for any order of the rows. For samples, which are small by design."""
    line = F.concat(F.col(key).cast("string"), F.lit("\t"), F.col(value))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("sha256"))
