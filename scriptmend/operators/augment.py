"""Training examples: span masks, corruption, and augmenters. All draws are hashes of (seed, row, position)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking as R
from ..functions import text as X

MASK, IGNORED = "[MASK]", -100
MOST_DRAWN = 1000


def _unit(seed: str, key: str, i: Column) -> Column:
    return R.hash_unit(F.lit(seed), F.col(key).cast("string"), i.cast("string"))


def word_dropout(docs: DataFrame, key: str, p: float = 0.1, seed: str = "drop", least: int = 5, words_col: str = "ws") -> DataFrame:
    """Words left after each is dropped with probability p; null if nothing changed or under ``least`` are left."""
    kept = F.filter(words_col, lambda w, i: _unit(seed, key, i) >= p)
    return docs.withColumn("augmented", F.when((F.size(kept) < F.size(words_col)) & (F.size(kept) >= least), kept))


def window_shift(docs: DataFrame, by: int = 3, least: int = 5, words_col: str = "ws") -> DataFrame:
    """The words from position ``by`` on; null if under ``least`` are left."""
    n = F.size(words_col)
    return docs.withColumn("augmented", F.when(n - by >= least, F.slice(F.col(words_col), F.lit(by + 1), F.greatest(n - by, F.lit(0)))))


def substitution(docs: DataFrame, key: str, table: dict[str, str], p: float = 0.15, seed: str = "sub", words_col: str = "ws") -> DataFrame:
    """Words of the table are exchanged with probability p; null if nothing changed."""
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    out = F.transform(words_col, lambda w, i: F.when(_unit(seed, key, i) < p, F.coalesce(F.try_element_at(m, w), w)).otherwise(w))
    return docs.withColumn("augmented", F.when(out != F.col(words_col), out))


def noise(docs: DataFrame, key: str, p: float, seed: str = "noise", words_col: str = "ws") -> DataFrame:
    """Each context word becomes a gap with probability p."""
    return docs.withColumn("noisy", F.transform(words_col, lambda w, i: F.when(_unit(f"{seed}{p}", key, i) < p, X.GAP).otherwise(w)))


def scatter_mask(docs: DataFrame, key: str, vocabulary: Sequence[str], share: float = 0.15, seed: str = "mask", shortest: int = 1, words_col: str = "ws") -> DataFrame:
    """masked, labels: words of ``shortest`` letters or more masked with probability ``share``; of those 80 % become the mask, 10 % a word drawn from the vocabulary, 10 % stay. A word that is not masked has no label.

    The vocabulary goes into the plan, and holds ``MOST_DRAWN`` words at most.
    """
    if not 0 < len(vocabulary) <= MOST_DRAWN:
        raise ValueError(f"a vocabulary to draw from has 1 to {MOST_DRAWN} words")
    drawn = F.array(*(F.lit(w) for w in vocabulary))
    chosen = lambda w, i: (_unit(seed, key, i) < share) & (F.length(w) >= shortest)
    how = lambda i: _unit(seed + "-how", key, i)
    which = lambda i: F.floor(_unit(seed + "-which", key, i) * len(vocabulary)).cast("int")
    df = docs.withColumn("_v", drawn)
    masked = F.transform(words_col, lambda w, i: F.when(~chosen(w, i), w).when(how(i) < 0.8, F.lit(MASK)).when(how(i) < 0.9, F.get("_v", which(i))).otherwise(w))
    return df.withColumn("masked", masked).withColumn("labels", F.transform(words_col, lambda w, i: F.when(chosen(w, i), w))).drop("_v")


def label_ids(labels: Column, ids: Column) -> Column:
    """Ids of labels by a map from word to id; ``IGNORED`` where there is no label or it has no id."""
    return F.transform(labels, lambda w: F.coalesce(F.when(w.isNotNull(), F.try_element_at(ids, w)), F.lit(IGNORED)))


def span_mask(docs: DataFrame, key: str, share: float = 0.15, p: float = 0.3, longest: int = 10, seed: str = "span", words_col: str = "ws") -> DataFrame:
    """masked_at: positions in spans of geometric length (parameter p, at most ``longest``); a span starts where its hash says, and never covers a gap.

    The expected share of covered words is ``share``; spans that overlap merge.
    """
    mean = sum(min(k, longest) * p * (1 - p) ** (k - 1) for k in range(1, 200))
    start = share / mean
    length = lambda i: F.least(F.lit(longest), 1 + F.floor(F.log(1 - _unit(seed + "-len", key, i)) / math.log(1 - p)))
    begun = F.filter(F.transform(words_col, lambda w, i: F.when(_unit(seed, key, i) < start, F.struct(i.alias("a"), (i + length(i)).alias("b")))), lambda s: s.isNotNull())
    df = docs.withColumn("_b", begun)
    covered = F.filter(F.transform(words_col, lambda w, i: F.when((w != X.GAP) & F.exists("_b", lambda s: (s["a"] <= i) & (i < s["b"])), i)), lambda i: i.isNotNull())
    return df.withColumn("masked_at", covered).drop("_b")


def target_weight(word: Column) -> Column:
    return F.when(F.length(word) <= 1, 0.25).otherwise(1.0)


def batches(docs: DataFrame, key: str, epoch: int, size: int = 16) -> DataFrame:
    """epoch, batch: an order by hash for each epoch, cut by hash into batches of about ``size``; no row is moved to one task."""
    n = docs.count()
    parts = max(1, -(-n // size))
    return docs.withColumn("epoch", F.lit(epoch)).withColumn("batch", F.floor(R.hash_unit(F.lit(f"epoch{epoch}"), F.col(key).cast("string")) * parts).cast("int"))
