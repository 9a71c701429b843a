"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table (pre-token -> number of tokens) of the most frequent pre-tokens of all
documents, broadcast; its size is bounded by ``frequent`` entries of at most ``longest`` characters. It
comes from a pass in which each task keeps a bounded counter of its own pre-tokens and hands over one row,
its heaviest few; only these bounded summaries meet, the pre-tokens of the texts are never shuffled. Tier two is the cache of a worker, bounded by
``cache_words``: what the table misses is encoded there once. The table only saves work: counts don't
depend on it.

Defined results: a null text is an empty one with 0 bytes and 0 tokens; repeated rows give repeated rows;
extra columns are not read; texts of any length are counted whole.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import lots
from .bpe_engine import engine
from .common import texts

FREQUENT, LONGEST, CACHE_WORDS = 20_000, 24, 400_000


class HeavyHitters:
    """Misra-Gries summary in blocks: exact up to ``room`` words, then all counts fall by the median one and those at zero go."""

    def __init__(self, room: int) -> None:
        self.room, self.counts = room, Counter()

    def add(self, words: list[str]) -> None:
        self.counts.update(words)
        while len(self.counts) > 2 * self.room:
            cut = sorted(self.counts.values())[len(self.counts) // 2]
            self.counts = Counter({w: c - cut for w, c in self.counts.items() if c > cut})

    def heaviest(self, n: int) -> list[tuple[str, int]]:
        return sorted(self.counts.items(), key=lambda x: (-x[1], x[0]))[:n]


def _summaries(batches: Iterator[pa.RecordBatch], path: str, frequent: int, longest: int) -> Iterator[pa.RecordBatch]:
    eng, seen = engine(path), HeavyHitters(8 * frequent)
    for batch in batches:
        for text in batch.column(1):
            seen.add([p for p in eng.pieces(text.as_py()) if isinstance(p, str)])
    top = [x for x in seen.heaviest(frequent) if len(x[0]) <= longest]
    yield pa.RecordBatch.from_arrays([pa.array([[w for w, _ in top]], pa.list_(pa.string())), pa.array([[c for _, c in top]], pa.list_(pa.int64()))], names=["words", "counts"])


def frequent_table(docs: DataFrame, path: str, frequent: int = FREQUENT, longest: int = LONGEST) -> dict[str, int]:
    """Token counts of the (about) ``frequent`` commonest pre-tokens of all documents."""
    each = max(64, frequent // 8)
    rows = docs.mapInArrow(lambda it: _summaries(it, path, each, longest), "words array<string>, counts array<long>")
    top = rows.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("w.words").agg(F.sum("w.counts").alias("n")).orderBy(F.desc("n"), "words").limit(frequent)
    words = [r[0] for r in top.collect()]
    return dict(zip(words, map(len, engine(path).ids_of(words)), strict=True))


_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


@functools.lru_cache(maxsize=2)
def _worker_cache(path: str) -> dict[str | int, int]:
    """What this worker has encoded under a vocabulary: it outlives tasks."""
    return {}


def _count(batches: Iterator[pa.RecordBatch], path: str, table: dict[str, int], cache_words: int) -> Iterator[pa.RecordBatch]:
    """Counts of lots of texts: all words of a lot that the table and the cache miss are encoded together."""
    eng, known = engine(path), _worker_cache(path)
    for batch in batches:
        texts_ = batch.column(1).to_pylist()
        counts: list[int] = []
        for part in lots(texts_):
            pieces = [eng.pieces(t) for t in part]
            new = {p for p in set(chain.from_iterable(pieces)) if p not in known and p not in table}
            if len(known) + len(new) > cache_words:
                known.clear()
                new = {p for p in set(chain.from_iterable(pieces)) if p not in table}
            words = [p for p in new if isinstance(p, str)]
            known.update(zip(words, map(len, eng.ids_of(words)), strict=True))
            known.update((p, 1) for p in new if isinstance(p, int))
            for own in pieces:
                counts.append(sum([table[p] if p in table else known[p] for p in own]))
        sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts_]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=_OUT.names)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, frequent: int = FREQUENT, longest: int = LONGEST, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document under the vocabulary file at ``path``."""
    own = texts(docs)
    table = own.sparkSession.sparkContext.broadcast(frequent_table(own, path, frequent, longest))
    return own.mapInArrow(lambda it: _count(it, path, table.value, cache_words), _OUT).withColumn("over_limit", F.col("n_tokens") > limit)
