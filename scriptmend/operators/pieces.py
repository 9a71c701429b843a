"""Sub-word pieces: a vocabulary counted from words, longest-match splitting through a trie, and the map from pieces to words.

A piece that begins a word is written as it is, one that continues a word with ``##`` before it. The vocabulary has every letter
in both forms, and of longer strings of at most ``longest`` letters the ``size`` of each form that save most letters
(times seen, times letters past the first). It has a bounded number of rows and is broadcast. A word is split from the left, the
longest piece first; one with a letter that the vocabulary lacks is the piece ``[UNK]``.

Defined results: null and empty word arrays have no pieces; ties go to the smaller string; words may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE, LONGEST, UNKNOWN, GOES_ON = 2000, 8, "[UNK]", "##"
#: Characters of words and pieces that a worker's memo holds at most.
MEMO_CHARS = 8_000_000


def vocabulary(counted: DataFrame, size: int = SIZE, longest: int = LONGEST) -> DataFrame:
    """piece, n of words (word, n): how often words begin, or go on, with it."""
    lengths = lambda left: F.explode(F.sequence(F.lit(1), F.least(left, F.lit(longest))))
    own = counted.filter("word <> ''").select("word", "n", F.length("word").alias("letters"))
    begins = own.select("word", "n", lengths(F.col("letters")).alias("l")).select(F.expr("substring(word, 1, l)").alias("text"), "n")
    inner = own.filter("letters > 1").select("word", "n", "letters", F.explode(F.sequence(F.lit(2), F.col("letters"))).alias("at"))
    goes_on = inner.select("word", "n", "at", lengths(F.col("letters") - F.col("at") + 1).alias("l")).select(F.expr("substring(word, at, l)").alias("text"), "n")
    parts = None
    for prefix, rows in (("", begins), (GOES_ON, goes_on)):
        sums = rows.groupBy("text").agg(F.sum("n").alias("n"))
        long = sums.filter(F.length("text") > 1).orderBy(F.desc(F.col("n") * (F.length("text") - 1)), "text").limit(size)
        part = sums.filter(F.length("text") == 1).unionByName(long).select(F.concat(F.lit(prefix), "text").alias("piece"), "n")
        parts = part if parts is None else parts.unionByName(part)
    return parts


class Trie:
    """Strings by letter; two roots, for pieces that begin and that go on with a word."""

    def __init__(self, pieces: list[str]) -> None:
        self.roots: tuple[dict, dict] = {}, {}
        for piece in pieces:
            inner = piece.startswith(GOES_ON) and len(piece) > len(GOES_ON)
            node = self.roots[inner]
            for letter in piece[len(GOES_ON) * inner :]:
                node = node.setdefault(letter, {})
            node[None] = piece

    def split(self, word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            node, found, end, k = self.roots[at > 0], None, at, at
            while k < len(word) and (node := node.get(word[k])) is not None:
                k += 1
                if None in node:
                    found, end = node[None], k
            if found is None:
                return [UNKNOWN]
            out.append(found)
            at = end
        return out


class Splitter:
    """A trie with a memo of words, bounded by characters and emptied when full."""

    def __init__(self, pieces: list[str], memo_chars: int = MEMO_CHARS) -> None:
        self.trie, self.memo, self.chars, self.most = Trie(pieces), {}, 0, memo_chars

    def __call__(self, word: str) -> list[str]:
        if word not in self.memo:
            if self.chars > self.most:
                self.memo, self.chars = {}, 0
            self.memo[word] = self.trie.split(word)
            # a word, its pieces, and what a list and its strings take
            self.chars += 4 * len(word) + 200
        return self.memo[word]


def _split(batches: Iterator[pa.RecordBatch], pieces: list[str], words_col: str, kept: list[str]) -> Iterator[pa.RecordBatch]:
    splitter = Splitter(pieces)
    for batch in batches:
        made, places = [], []
        for words in batch.column(words_col).to_pylist():
            of_word = [splitter(w) for w in words or ()]
            made.append([p for own in of_word for p in own])
            places.append([k for k, own in enumerate(of_word) for _ in own])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))], names=[*kept, "pieces", "word_ids"])


def split_words(rows: DataFrame, pieces: DataFrame, words_col: str = "ws", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None), then ``pieces`` of the word array and ``word_ids``: for each piece the place of its word."""
    kept = [c for c in (rows.columns if keep is None else keep) if c not in ("pieces", "word_ids")]
    sent = rows.sparkSession.sparkContext.broadcast(sorted(r[0] for r in pieces.select("piece").collect()))
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("word_ids", T.ArrayType(T.IntegerType()))])
    return rows.select(*dict.fromkeys([*kept, words_col])).mapInArrow(lambda it: _split(it, sent.value, words_col, kept), schema)


def pieces_of(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """``words`` (word, ...) with the array ``pieces`` of each."""
    return split_words(words.withColumn("_ws", F.array("word")), pieces, "_ws", words.columns).drop("word_ids")


def alignment(rows: DataFrame, key: str) -> DataFrame:
    """key, k, word_id, piece: each piece of rows that ``split_words`` made, in order."""
    return rows.select(key, F.posexplode(F.arrays_zip("pieces", "word_ids")).alias("k", "p")).select(key, "k", F.col("p.word_ids").alias("word_id"), F.col("p.pieces").alias("piece"))


def joined(pieces: Column) -> Column:
    """The words that pieces make, with blanks between."""
    return F.trim(F.array_join(F.transform(pieces, lambda p: F.when(p.startswith(GOES_ON), F.substr(p, F.lit(len(GOES_ON) + 1))).otherwise(F.concat(F.lit(" "), p))), ""))
