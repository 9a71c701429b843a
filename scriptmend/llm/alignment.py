"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a piece model (B) cover the same bytes.

Both tokenizers end a token wherever a blank follows something that is no white space, so a text is cut there into chunks
that are encoded on their own; what a worker has aligned it keeps in a cache bounded by chunks and bytes. ``can_cut`` checks a
piece model for this; under one that fails texts are encoded whole.

For chunks not seen before, the B tokens' ends are a static interval index; two bisections stab it with each A token and give
the range of B tokens that it overlaps. Every A token covers the gaps inside its range; running sums of where ranges begin
and end say which gaps between B tokens are covered by none, and those are the group boundaries. Links are the ranges
spelled out: a chunk has as many as its tokens less its groups.

How many documents hold an id pair linked is counted over written lists of each document's distinct pairs. The commonest
pairs (at most ``FREQUENT``, by a count threshold read from a histogram of 64 * 8 count classes) are broadcast as sorted arrays
and looked up by bisection; what a document has of rarer pairs is joined by pair, no one of which is frequent, and
added by row. So neither a pair that most documents hold nor the number of pairs matters.

Defined results: null and empty texts, and those whose joined token bytes of either side aren't a blank and the text,
have zeros and a ``groups_sha256`` of ''; strings of special tokens are plain text; texts of any length are aligned whole;
repeated rows count as documents and are repeated in the result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import lots
from .common import forget, materialize

FREQUENT, CACHE_CHUNKS, CACHE_BYTES = 1_000_000, 300_000, 96 << 20

_CHUNK = re.compile(r"(?<=\S)(?= )")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_BLANK = "▁"
#: Bits of an id pair as one number; what is left numbers the texts of a lot.
_PAIR_BITS = 42


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """The two tokenizers of a worker, with the bytes of all their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        chars = _byte_of_char()
        entries = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.a_bytes = [bytes(chars[c] for c in e) if all(c in chars for c in e) else e.encode() for e in entries]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) and self.b.is_byte(k) else p.replace(_BLANK, " ").encode() for k, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id(_BLANK)
        self.cut = can_cut(pieces) and self.b_bytes[self.blank] == b" " and self._same()

    def _same(self) -> bool:
        """Whether cutting changes nothing on a text with every kind of white space (a model may rewrite texts first)."""
        text = "ab  c\td \n e\r\n f  g　 'll  . ,,  é -  1 2  <s> x "
        return self.b.encode(text) == [t for ids in self.encode_b(_CHUNK.split(" " + text)) for t in ids]

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks, whose first blank is the one that the model puts before a text."""
        return [ids if len(c) > 1 else [self.blank] for c, ids in zip(chunks, self.b.encode([c[1:] for c in chunks], num_threads=1), strict=True)]

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.split(" " + text) if self.cut else [" " + text]


def can_cut(pieces: list[str]) -> bool:
    """Whether no piece goes on past a blank that follows something else."""
    return not any(re.search(f"[^{_BLANK}]{_BLANK}", p) for p in pieces)


@functools.lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens that cover the same bytes from 0 on, given by their ends: the first B token that each A token overlaps, the one past the last, and for each B token whether a group ends with it."""
    a_starts, b_starts = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
    first, past = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")
    covered = np.zeros(len(b_ends) + 1, np.int64)
    np.add.at(covered, first, 1)
    np.add.at(covered, past - 1, -1)
    return first, past, np.cumsum(covered)[:-1] == 0


class Aligner:
    """Aligned chunks: a number each, by which counts, groups and links are kept."""

    def __init__(self, pair: Pair, most: int = CACHE_CHUNKS, most_bytes: int = CACHE_BYTES) -> None:
        self.pair, self.most, self.most_bytes = pair, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.groups: list[str] = []
        #: chunk -> tokens of A and of B, groups, links, whether both give its bytes
        self.counts = np.empty((0, 5), np.int64)
        self.links, self.ends, self.size = np.empty(0, np.int64), np.zeros(1, np.int64), 0

    def learn(self, chunks: set[str]) -> None:
        """Aligns the chunks that are not known; a full cache is emptied first."""
        new = [c for c in chunks if c not in self.codes]
        if new and (len(self.codes) + len(new) > self.most or self.size > self.most_bytes):
            self.clear()
            new = list(chunks)
        if not new:
            return
        pair = self.pair
        a = [e.ids for e in pair.a.encode_batch_fast(new, add_special_tokens=False)]
        b = pair.encode_b(new)
        good = [b"".join([pair.a_bytes[t] for t in x]) == (raw := c.encode()) and b"".join([pair.b_bytes[t] for t in y]) == raw for c, x, y in zip(new, a, b, strict=True)]
        a, b = ([x if g else [] for x, g in zip(side, good, strict=True)] for side in (a, b))
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        flat_a, flat_b = (np.array([t for x in side for t in x], np.int64) for side in (a, b))
        first, past, last = overlaps(np.cumsum(pair.a_sizes[flat_a]), np.cumsum(pair.b_sizes[flat_b])) if len(flat_a) else (flat_a, flat_a, np.empty(0, bool))
        spans = past - first
        of_a = np.repeat(np.arange(len(flat_a)), spans)
        partner = first[of_a] + np.arange(len(of_a)) - np.repeat(np.cumsum(spans) - spans, spans)
        links = flat_a[of_a] * len(pair.b_sizes) + flat_b[partner]
        chunk_a, chunk_b = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        n_links = np.bincount(chunk_a[of_a], minlength=len(new))
        n_groups = np.bincount(chunk_b[last], minlength=len(new))
        # a group's number is that of the B groups ended before
        group_b = np.cumsum(last) - last
        group_a = group_b[first]
        by_group = [self._written(flat_a, group_a), self._written(flat_b, group_b)]
        made = [f"{x}|{y}" for x, y in zip(*by_group, strict=True)]
        ends = np.cumsum(n_groups).tolist()
        at = 0
        for k, c in enumerate(new, len(self.groups)):
            self.codes[c] = k
        for end in ends:
            self.groups.append(";".join(made[at:end]))
            at = end
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links, np.array(good, np.int64)], 1)])
        self.links = np.concatenate([self.links, links])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n_links)])
        # keys and strings with their places in dict and list, counts, links
        self.size += 2 * sum(map(len, new)) + sum(map(len, self.groups[-len(new) :])) + 260 * len(new) + 8 * len(links)

    @staticmethod
    def _written(ids: np.ndarray, group: np.ndarray) -> list[str]:
        said = list(map(str, ids.tolist()))
        ends = np.flatnonzero(np.concatenate([group[1:] != group[:-1], [True]])).tolist() if len(group) else []
        out, at = [], 0
        for end in ends:
            out.append(said[at] if end == at else ",".join(said[at : end + 1]))
            at = end + 1
        return out

    def aligned(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For texts: counts (tokens of A and B, groups, links), digests, then number of the text, pair and how often it is linked there, by text and pair."""
        chunks = [self.pair.chunks(t) if t else [] for t in texts]
        self.learn({c for x in chunks for c in x})
        sizes = np.array([len(x) for x in chunks], np.int64)
        codes = np.array([self.codes[c] for x in chunks for c in x], np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        bad = np.zeros(len(texts), bool)
        bad[text[self.counts[codes, 4] == 0]] = True
        bad |= sizes == 0
        ends = np.cumsum(sizes)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.counts[codes, :4], axis=0)])
        counts = sums[ends] - sums[ends - sizes]
        counts[bad] = 0
        listed = codes.tolist()
        digests = ["" if out else hashlib.sha256(";".join([self.groups[c] for c in listed[end - size : end]]).encode()).hexdigest() for out, size, end in zip(bad.tolist(), sizes.tolist(), ends.tolist(), strict=True)]
        codes, text = codes[~bad[text]], text[~bad[text]]
        n = self.ends[codes + 1] - self.ends[codes]
        places = np.repeat(self.ends[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        held = np.sort(np.repeat(text, n) << _PAIR_BITS | self.links[places])
        first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.empty(0, np.int64)
        times = np.diff(np.concatenate([first, [len(held)]]))
        return counts, digests, held[first] >> _PAIR_BITS, held[first] & (1 << _PAIR_BITS) - 1, times


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


@functools.lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of a worker: it outlives tasks."""
    return Aligner(_pair(a_path, b_path))


def _align(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """Rows are numbered by task and place in it; they are written before a number is used."""
    aligner = _aligner(a_path, b_path)
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        at = 0
        for part in lots([x or "" for x in batch.column(1).to_pylist()]):
            counts, digests, text, pairs, times = aligner.aligned(part)
            offsets = pa.array(np.searchsorted(text, np.arange(len(part) + 1)), pa.int32())
            columns = [pa.array(np.arange(row, row + len(part))), batch.column(0).slice(at, len(part)), *(pa.array(counts[:, k]) for k in range(4)), pa.array(digests, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
            at, row = at + len(part), row + len(part)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of documents: row (a number of its own), doc_id, token, group and link counts, digest, and the distinct linked id pairs (A id * size of B + B id) with how often each occurs."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(own.mapInArrow(lambda it: _align(it, a_path, b_path), _ALIGNED), "aligned")


def pair_counts(table: DataFrame, n_b: int) -> DataFrame:
    """pair, n (documents that hold it) and best (whether no pair of its A id has more), a written table."""
    counts = materialize(table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    a = F.floor(F.col("pair") / F.lit(n_b)).cast("long")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    made = materialize(counts.join(most, a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    forget(counts)
    return made


def _looked_up(batches: Iterator[pa.RecordBatch], pairs: np.ndarray, n: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
        flat, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.minimum(np.searchsorted(pairs, flat), max(0, len(pairs) - 1))
        known = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
        sums, rest = [], ~known
        for amount in (best, n):
            upto = np.concatenate([[0], np.cumsum(times * known * amount[at])]) if len(amount) else np.zeros(len(flat) + 1, np.int64)
            sums.append(pa.array(upto[ends] - upto[ends - sizes]))
        offsets = pa.array(np.concatenate([[0], np.cumsum(rest)])[np.concatenate([[0], ends])], pa.int32())
        kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        made = [*sums, pa.ListArray.from_arrays(offsets, pa.array(flat[rest])), pa.ListArray.from_arrays(offsets, pa.array(times[rest]))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, "n_best", "count_sum", "rest", "rest_times"])


def report(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    context = docs.sparkSession.sparkContext
    table = aligned(docs, a_path, b_path, id_col, text_col)
    counts = pair_counts(table, len(_pair(a_path, b_path).b_sizes))
    # the least class of counts from which on all pairs fit the broadcast
    classes = counts.groupBy(F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("c")).collect()
    held, least = 0, None
    for r in classes:
        if held + r["pairs"] > frequent:
            break
        held, least = held + r["pairs"], r["least"]
    common = counts.filter(F.col("n") >= F.lit(least)).toArrow() if least is not None else counts.limit(0).toArrow()
    order = np.argsort(common["pair"].to_numpy())
    sent = context.broadcast(tuple(common[c].to_numpy()[order] for c in ("pair", "n", "best")))
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    looked = table.mapInArrow(lambda it: _looked_up(it, *sent.value), "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<long>, rest_times array<long>")
    if held == sum(r["pairs"] for r in classes):
        return looked.select(out)
    looked = materialize(looked, "looked-up")
    forget(table)
    rest = looked.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("r")).select("row", F.col("r.rest").alias("pair"), F.col("r.rest_times").alias("times"))
    rare = counts.filter(F.col("n") < F.lit(least)) if least is not None else counts
    more = rest.join(rare, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    full = looked.drop("rest", "rest_times").join(more, "row", "left")
    return full.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).select(out)
