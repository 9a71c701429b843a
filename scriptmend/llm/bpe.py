"""BPE encoding and decoding of whole texts (see ``bpe_engine`` for the merging).

Words seen before are looked up in a cache of their worker, bounded by ``cache_words`` and ``CACHE_BYTES`` and
emptied when full; the others of a lot of texts are merged together. The operators are maps over the scan.

Defined results: a null text is encoded as an empty one, to no ids; null ids decode to an empty text;
strings of special tokens inside a text become those tokens, as the library does by default; repeated rows
give repeated rows; an empty table gives an empty result; a text of any length is encoded whole, in a lot of its own if it
is long; ties between merges go to the leftmost; other columns are kept as they are, and an output column replaces one of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_engine import Engine, engine

CACHE_WORDS, CACHE_BYTES = 400_000, 48 << 20


class Encoder:
    """An engine with the bounded cache of its worker: word -> code; the ids of all codes lie in one array."""

    def __init__(self, eng: Engine, cache_words: int = CACHE_WORDS, cache_bytes: int = CACHE_BYTES) -> None:
        self.eng, self.most, self.most_bytes = eng, cache_words, cache_bytes
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str | int, int] = {}
        self.ids = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)
        self.size = 0

    def encode(self, text: str) -> list[int]:
        pieces = self.eng.pieces(text)
        self.learn(set(pieces))
        return self.row(pieces).tolist()

    def row(self, pieces: list[str | int]) -> np.ndarray:
        """The ids of known pieces, in order."""
        codes = np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces))
        starts = self.ends[codes]
        sizes = self.ends[codes + 1] - starts
        before = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]

    def learn(self, pieces: set[str | int]) -> None:
        """Merges the pieces that are not known yet; a full cache is emptied first."""
        new = [p for p in pieces if p not in self.codes]
        if new and (len(self.codes) + len(new) > self.most or self.size > self.most_bytes):
            self._clear()
            new = list(pieces)
        words = [p for p in new if isinstance(p, str)]
        specials = [p for p in new if isinstance(p, int)]
        made = [*self.eng.ids_of(words), *(np.array([p]) for p in specials)]
        if made:
            for k, p in enumerate([*words, *specials], len(self.codes)):
                self.codes[p] = k
            self.ids = np.concatenate([self.ids, *made]).astype(np.int32)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(m) for m in made])])
            # a key with its place in the table, and what its ids take
            self.size += sum(map(len, words)) + 180 * len(new) + 4 * sum(map(len, made))


def lots(texts: list[str], chars: int = 500_000) -> Iterator[list[str]]:
    """Neighbouring texts of about so many characters together."""
    part: list[str] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encoded(texts: list[str], coder: Encoder) -> Iterator[np.ndarray]:
    """The ids of each text; words that are new to a lot of texts are merged together."""
    for part in lots(texts):
        pieces = [coder.eng.pieces(t) for t in part]
        coder.learn(set(chain.from_iterable(pieces)))
        for own in pieces:
            yield coder.row(own)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, text_col: str, ids_col: str, cache_words: int) -> Iterator[pa.RecordBatch]:
    coder = Encoder(engine(path), cache_words)
    for batch in batches:
        rows = list(encoded([x or "" for x in batch.column(text_col).to_pylist()], coder))
        values = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32())
        column = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)
        names = [n for n in batch.schema.names if n != ids_col]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], names=[*names, ids_col])


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", cache_words: int = CACHE_WORDS) -> DataFrame:
    """Add ``ids_col`` (array<int>): the text's token ids under the vocabulary file at ``path``."""
    kept = df.drop(ids_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return kept.mapInArrow(lambda it: encode_batches(it, path, text_col, ids_col, cache_words), schema)


def decode_batches(batches: Iterator[pa.RecordBatch], path: str, ids_col: str, out_col: str) -> Iterator[pa.RecordBatch]:
    tokens = np.array(engine(path).tokens, object)
    for batch in batches:
        ids = batch.column(ids_col)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.nan_to_num(np.array(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False), float))).astype(np.int64)
        out, at = [], 0
        for end in ends.tolist():
            out.append(" ".join(tokens[flat[at:end]]))
            at = end
        names = [n for n in batch.schema.names if n != out_col]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.string())], names=[*names, out_col])


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``: the tokens of ``ids_col`` joined by one space, special ones included."""
    kept = df.drop(out_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.StringType())])
    return kept.mapInArrow(lambda it: decode_batches(it, path, ids_col, out_col), schema)


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest_batches(batches: Iterator[pa.RecordBatch], path: str, cache_words: int) -> Iterator[pa.RecordBatch]:
    eng = engine(path)
    coder = Encoder(eng, cache_words)
    digits = np.array([str(i) for i in range(len(eng.tokens))], object)
    tokens = np.array(eng.tokens, object)
    digest = lambda parts: hashlib.sha256(" ".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        counts, ids, decoded = [], [], []
        for row in encoded([x or "" for x in batch.column(1).to_pylist()], coder):
            counts.append(len(row))
            ids.append(digest(digits[row]))
            decoded.append(digest(tokens[row]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded and decoded in one map, of which the ids don't come back."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(lambda it: _digest_batches(it, path, cache_words), _DIGESTS)
