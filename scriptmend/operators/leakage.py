"""Control of near-duplicates between splits: what of a document the splits before its own have seen.

Splits come in the order train, dev, heldout. Shingles are ``SHINGLE`` words one after another; a text of fewer words
is one shingle, one of none has none. A document's shingles are matched against all texts of a split at once, not
against one text after another, so the work follows the number of shingles however many texts share them, and a
document pieced together from several is caught as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import ngrams

SHINGLE, SIMILARITY_PERCENT = 5, 80
#: Each split's bit; a document is held against the splits of smaller bits.
BITS = {"train": 1, "dev": 2, "heldout": 4}


def shingles(ws: Column, n: int = SHINGLE) -> Column:
    """The 64-bit hash of the shingle at each position."""
    told = F.when(F.size(ws) >= n, ngrams(ws, n)).when(F.size(ws) > 0, F.array(ws)).otherwise(F.array().cast("array<array<string>>"))
    return F.transform(told, lambda g: F.xxhash64(F.array_join(g, " ")))


def seen_before(docs: DataFrame, key: str, split: str = "split", words_col: str = "ws", n: int = SHINGLE, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """key, split, n_positions, n_seen, n_shingles, n_shared, near_duplicate of every document of dev and heldout.

    ``n_positions`` counts the positions that a shingle centres on (starts at, for texts under ``n`` words), ``n_seen``
    those whose shingle an earlier split has; ``n_shingles`` and ``n_shared`` count different shingles. A near-duplicate
    shares ``percent`` of its shingles or more. Keys are expected to be unique; documents of null or another split take no
    part; null words are none, and a text without words is no near-duplicate; columns beside these are not read. Two
    shingles of equal 64-bit hash are taken for one.

    A shingle's splits, and its places in a document, are folded before they are shuffled, so one that many texts hold is
    one row a text in the join, which can be split where it is skewed, as what follows it is summed by document.
    """
    bit = F.create_map(*(F.lit(x) for pair in BITS.items() for x in pair))[F.col(split)]
    own = docs.select(F.col(key).alias("k"), F.col(split).alias("split"), bit.alias("bit"), F.col(words_col).alias("w")).filter("bit is not null")
    each = own.filter(F.size("w") > 0).select("k", "bit", F.explode(shingles(F.col("w"), n)).alias("h"))
    splits = each.groupBy("h").agg(F.bit_or("bit").alias("bits"))
    asked = each.filter(F.col("bit") > 1).groupBy("k", "bit", "h").agg(F.count(F.lit(1)).alias("n"))
    seen = F.col("bits").bitwiseAND(F.col("bit") - 1) != 0
    counts = asked.join(splits, "h").groupBy("k").agg(F.sum("n").alias("n_positions"), F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("n_seen"), F.count(F.lit(1)).alias("n_shingles"), F.count_if(seen).alias("n_shared"))
    out = own.filter(F.col("bit") > 1).select("k", "split").join(counts, "k", "left").fillna(0, ["n_positions", "n_seen", "n_shingles", "n_shared"])
    near = (F.col("n_shingles") > 0) & (100 * F.col("n_shared") >= percent * F.col("n_shingles"))
    return out.select(F.col("k").alias(key), "split", "n_positions", "n_seen", "n_shingles", "n_shared", near.alias("near_duplicate"))
