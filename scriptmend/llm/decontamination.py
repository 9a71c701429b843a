"""Benchmark decontamination: a broadcast hash set of normalised n-grams of test items, scanned over training texts.

A window is ``n`` consecutive words of an item (an item of fewer, but not none, is one window); a word of a
document inside an occurrence of a window is hit. Items are cut into blocks of at most ``block_words`` words (a longer
item into pieces that share n - 1 words), and one block is broadcast: its distinct words, the hashes of its windows and
which items hold each window. Tasks look words up in the block's vocabulary, hash windows of word numbers by array
operations, look hashes up, and compare the word numbers of every hit: a result never rests on a hash. Documents aren't
shuffled. A benchmark of more blocks is gone through block by block, each adding to the spans and items found before.

Defined results: a null text has no words; a null item id is ''; items of one id are one item; a text of any length is
scanned whole; repeated rows are repeated in the result, and windows that items share count for each of them; an
empty benchmark hits nothing, empty documents give an empty table; other columns are kept by ``find`` and ``remove``, those
of their own begin with ``__sm_``. ``remove`` leaves texts without a hit, and null ones, as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, materialize
from .words import ALPHANUMERIC, lots, words_of

N, BLOCK_WORDS = 10, 1_000_000

_FOUND = [T.StructField(OWN + "words", T.LongType()), T.StructField(OWN + "hits", T.LongType()), T.StructField(OWN + "starts", T.ArrayType(T.LongType())), T.StructField(OWN + "ends", T.ArrayType(T.LongType())), T.StructField(OWN + "items", T.ArrayType(T.StringType()))]
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hashes(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of n word numbers that begins at one of the places."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out ^ ids[at + k].astype(np.uint64)) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


class Block:
    """Windows of some items: vocabulary, hashes by window length, and the items of each distinct window."""

    def __init__(self, rows: list[tuple[str, list[str]]], n: int) -> None:
        said = pa.array([w for _, ws in rows for w in ws], pa.string())
        coded = said.dictionary_encode()
        self.vocabulary, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int32)
        self.names = sorted({name for name, _ in rows})
        number = {name: k for k, name in enumerate(self.names)}
        by_length: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        at = 0
        for name, ws in rows:
            size = min(n, len(ws))
            if size:
                windows = np.lib.stride_tricks.sliding_window_view(ids[at : at + len(ws)], size)
                of = by_length.setdefault(size, ([], []))
                of[0].append(windows)
                of[1].append(np.full(len(windows), number[name]))
            at += len(ws)
        #: window length -> (sorted hashes, the first window of each, windows sorted by hash, where each one's items begin, items)
        self.lengths = {size: self._distinct(np.concatenate(ws), np.concatenate(items)) for size, (ws, items) in by_length.items()}

    @staticmethod
    def _distinct(windows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size = windows.shape[1]
        windows, which = np.unique(windows, axis=0, return_inverse=True)
        hashes = _hashes(windows.reshape(-1), np.arange(len(windows)) * size, size)
        order = np.argsort(hashes, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        held = np.unique(np.stack([place[which.reshape(-1)], items], 1), axis=0)
        begins = np.searchsorted(held[:, 0], np.arange(len(order) + 1))
        return hashes[order], windows[order], begins, held[:, 1].astype(np.int64)

    def hits(self, words: pa.StringArray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
        """For each length: (first words of the hit windows, the window each one is, length, where windows' items begin, items)."""
        ids = pc.index_in(words, value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        out = np.concatenate([[0], np.cumsum(ids < 0)])
        for size, (hashes, windows, begins, items) in self.lengths.items():
            if len(ids) < size:
                continue
            ends = len(ids) - size + 1
            at = np.flatnonzero((out[size:] == out[:ends]) & (text[size - 1 :] == text[:ends]))
            if not len(at):
                continue
            own = _hashes(ids, at, size)
            low = np.searchsorted(hashes, own)
            met = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == own))
            at, low, own = at[met], low[met], own[met]
            found_at, found = [], []
            while len(at):  # a step for each of the windows that share a hash
                same = (windows[low] == ids[at[:, None] + np.arange(size)]).all(1)
                found_at.append(at[same])
                found.append(low[same])
                more = ~same & (low + 1 < len(hashes)) & (hashes[np.minimum(low + 1, len(hashes) - 1)] == own)
                at, low, own = at[more], low[more] + 1, own[more]
            if found_at:
                yield np.concatenate(found_at), np.concatenate(found), size, begins, items


def _spans(covered: np.ndarray, words, n_texts: int) -> tuple[list, list]:
    """Per text: byte places, within it, of the maximal runs of hit words."""
    at = np.flatnonzero(covered)
    starts: list[list[int]] = [[] for _ in range(n_texts)]
    ends: list[list[int]] = [[] for _ in range(n_texts)]
    if len(at):
        new = np.concatenate([[True], (np.diff(at) > 1) | (words.text[at[1:]] != words.text[at[:-1]])])
        first, last = at[new], at[np.concatenate([new[1:], [True]])]
        for k, a, b in zip(words.text[first].tolist(), (words.start[first] - words.begins[words.text[first]]).tolist(), (words.end[last] - words.begins[words.text[first]]).tolist(), strict=True):
            starts[k].append(a)
            ends[k].append(b)
    return starts, ends


def _scan(batches: Iterator[pa.RecordBatch], block: Block, text_col: str, kept: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        texts = pc.fill_null(whole.column(text_col), "").cast(pa.string())
        for at, part in lots(texts):
            batch = whole.slice(at, len(part))
            words = words_of(part, ALPHANUMERIC)
            steps = np.zeros(len(words.text) + 1, np.int64)
            pairs = [np.empty((0, 2), np.int64)]
            for first, which, size, begins, items in block.hits(words.words, words.text):
                np.add.at(steps, first, 1)
                np.add.at(steps, first + size, -1)
                seen = np.unique(np.stack([words.text[first], which], 1), axis=0)
                sizes = begins[seen[:, 1] + 1] - begins[seen[:, 1]]
                places = np.repeat(begins[seen[:, 1]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                pairs.append(np.stack([np.repeat(seen[:, 0], sizes), items[places]], 1))
            covered = np.cumsum(steps)[:-1] > 0
            names: list[set[str]] = [set() for _ in range(len(part))]
            starts, ends = _spans(covered, words, len(part))
            for k, item in np.unique(np.concatenate(pairs), axis=0).tolist():
                names[k].add(block.names[item])
            before = [batch.column(OWN + c).to_pylist() for c in ("starts", "ends", "items")]
            n_hit = np.bincount(words.text[covered], minlength=len(part))
            for k in range(len(part)):
                if before[2][k]:
                    text = part[k].as_py().encode()
                    starts[k], ends[k] = _united(text, zip(before[0][k] + starts[k], before[1][k] + ends[k], strict=True))
                    n_hit[k] = len(words_of(pa.array([text[a:b].decode() for a, b in zip(starts[k], ends[k], strict=True)], pa.string()), ALPHANUMERIC).words)
                    names[k].update(before[2][k])
            made = [pa.array(np.bincount(words.text, minlength=len(part)), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, *(f.name for f in _FOUND)])


def _united(data: bytes, spans) -> tuple[list[int], list[int]]:
    """Spans of several blocks as maximal runs: those that overlap, or have no word between them, are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and (a <= out[-1][1] or not ALPHANUMERIC[np.frombuffer(data[out[-1][1] : a], np.uint8)].any()):
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [a for a, _ in out], [b for _, b in out]


def _pieces(rows: Iterator[pa.RecordBatch], n: int, most: int) -> Iterator[pa.RecordBatch]:
    """(item, words) of items; one of more than ``most`` words in pieces that share n - 1 words."""
    for batch in rows:
        words = words_of(pc.fill_null(batch.column(1), "").cast(pa.string()), ALPHANUMERIC)
        ends = np.searchsorted(words.text, np.arange(batch.num_rows + 1))
        names, made = [], []
        for name, a, b in zip(pc.fill_null(batch.column(0), "").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            own = words.words.slice(a, b - a).to_pylist()
            for at in range(0, max(1, len(own) - n + 1), most):
                names.append(name)
                made.append(own[at : at + most + n - 1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(made, pa.list_(pa.string()))], names=["item", "words"])


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, n: int, block_words: int) -> Iterator[tuple[Block, bool]]:
    """(block of at most ``block_words`` words, whether it is the last): all windows of the benchmark; one empty block where there are none."""
    most = max(1, block_words // 16 - n)
    cut = benchmark.select(F.col(item_id).cast("string"), F.col(item_text)).mapInArrow(lambda it: _pieces(it, n, most), "item string, words array<string>")
    pieces = materialize(cut.filter(F.size("words") > 0).distinct(), "pieces")
    blocks, size = 1, lambda k: F.pmod(F.xxhash64("item", "words"), F.lit(k))
    # distinct pieces are dealt by hash: no order over all of them is needed, and more blocks always part them
    while (pieces.groupBy(size(blocks).alias("k")).agg(F.sum(F.size("words")).alias("s")).agg(F.max("s")).first()[0] or 0) > block_words:
        blocks *= 2
    for k in range(blocks):
        yield Block([(r[0], r[1]) for r in pieces.filter(size(blocks) == k).collect()], n), k + 1 == blocks


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all, if None), __sm_words and __sm_hits (numbers of words and of hit words), __sm_starts and __sm_ends (byte places of the runs of hit words, from the first word's start to the last one's end), and __sm_items (ids of the items hit, sorted)."""
    hit = docs.select(*docs.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in _FOUND))
    for block, last in _blocks(benchmark, item_id, item_text, n, block_words):
        kept = keep if last and keep is not None else docs.columns
        held = docs.sparkSession.sparkContext.broadcast(block)
        schema = T.StructType([*(docs.schema[c] for c in kept), *_FOUND])
        hit = hit.mapInArrow(lambda it, held=held, kept=kept: _scan(it, held.value, text_col, kept), schema)
        hit = hit if last else materialize(hit, "hit")
    return hit


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hit = find(own, benchmark, n=n, block_words=block_words, keep=["doc_id"])
    return hit.select("doc_id", F.col(OWN + "words").alias("n_words"), F.col(OWN + "hits").alias("n_hit"), F.size(OWN + "items").cast("long").alias("n_items"), F.sha2(F.array_join(OWN + "items", ","), 256).alias("items_sha256"), (F.col(OWN + "hits") > 0).alias("contaminated"))


def _without(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(text_col).to_pylist()
        for k, (starts, ends) in enumerate(zip(batch.column(OWN + "starts").to_pylist(), batch.column(OWN + "ends").to_pylist(), strict=True)):
            if starts:
                data = texts[k].encode()
                texts[k] = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)], strict=True)).decode()
        kept = [c for c in batch.schema.names if not c.startswith(OWN)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in kept], names=kept)


def remove(docs: DataFrame, benchmark: DataFrame, whole: bool = False, text_col: str = "text", n: int = N, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the runs of hit words, or, if ``whole``, without the documents that have any."""
    hit = find(docs, benchmark, text_col, n=n, block_words=block_words)
    if whole:
        return hit.filter(F.size(OWN + "starts") == 0).select(*docs.columns)
    return hit.mapInArrow(lambda it: _without(it, text_col), docs.schema)


ORACLE_SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS k FROM low, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.k, p.n, x.item FROM (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM places) p JOIN windows x ON p.n = x.n AND p.g = x.g),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(k, CAST(k + n AS BIGINT))) AS i FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT low.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
