"""Near-duplicate classes by consistent weighted sampling.

A document is its five-word shingles, each weighted by TF-IDF: tf * (1 + idf), with idf = log((n + 1) / (df + 1))
to the base n + 1. The base scales idf to [0, 1], so that a similarity means the same whatever the number of
documents, and the one added (the usual smoothing) leaves weight to shingles that all documents hold.
Document frequencies of all documents go into a counting
sketch of ``SLOTS`` counters, fixed in size: it tells apart what occurs in more than a ten-thousandth or so of
the documents, whatever their number, and holds the rest for equally rare.

1. Exact copies fold into their smallest document by SHA-256.
2. Improved consistent weighted sampling gives ``BANDS * ROWS`` samples; each band of samples is a bucket.
3. Pairs in a bucket are found by leaders, in rounds that make a row for each member (see ``linked``). Pairs of
   which a share under ``AGREE`` of the 100 samples agree are passed over: a pair of similarity 0.8 has 0.8 on
   average with a deviation of 0.04, and so few with probability 0.0001.
4. Links with weighted Jaccard ``SIMILARITY`` or more, computed from the texts, are joined into components by
   spreading least labels.

Banding (20 bands of 5) misses a pair of similarity 0.8 with probability 0.0004.

Defined results: a null text is empty; a text of under five words has no shingle and only exact copies;
ties go to the smaller id; repeated rows share a class; rows of a null id have a null class; different texts
under one id are classed each; an empty table gives an empty result; extra columns are not read; whole texts are shingled.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, forget, materialize, texts

WORDS, SIMILARITY, BANDS, ROWS, SLOTS = 5, 0.8, 20, 5, 1 << 20
AGREE, MOST_LEADERS = 0.64, 64
MANY, DEEP, TABLES, EQUAL_BITS = 512, 20, 400, 436
BROADCAST_BYTES, DEEP_TEXTS = 8 << 20, 5_000
FEW, SLACK = 8, 1e-6
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_LOT = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 2 * _LOT)
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            p = np.full(size, b, _U)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each maximal run of bytes that are not blank."""
    solid = ~_BLANK[text]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    up, down = _powers(len(text) + 1)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[text] * up[: len(text)], dtype=_U)])
    return _mix((total[end] - total[begin]) * down[begin]), begin


def shingles(values: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index, distinct shingle hashes in order, times) of each text; lots of texts are hashed together."""
    at = 0
    while at < len(values):
        lot, size, first = [], 0, at
        while at < len(values) and (not lot or size < _LOT):
            raw = (values[at] or "").encode("utf-8", "surrogatepass") + b"\n"
            lot.append(raw)
            size += len(raw)
            at += 1
        with np.errstate(over="ignore"):
            words, begin = word_hashes(np.frombuffer(b"".join(lot), np.uint8))
            n = max(0, len(words) - WORDS + 1)
            grams = np.zeros(n, _U)
            for k in range(WORDS):
                grams = _mix(grams * _BASE + words[k : k + n])
        edges = np.searchsorted(begin, np.cumsum([0, *map(len, lot)]))
        for i in range(len(lot)):
            own = grams[edges[i] : max(edges[i], edges[i + 1] - WORDS + 1)]
            yield first + i, *np.unique(own, return_counts=True)


# --- document frequencies -----------------------------------------------------------------------------

_PARTS = 64


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counters that are not 0, by part, and its documents."""
    counts, n = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for _, grams, _ in shingles(batch.column(1).to_pylist()):
            np.add.at(counts, (grams >> _U(44)).astype(np.int64), 1)
            n += 1
    if n:
        at = np.flatnonzero(counts)
        edges = np.searchsorted(at, np.arange(_PARTS + 1) * (SLOTS // _PARTS))
        cut = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([n] + [0] * (_PARTS - 1), pa.int64()), pa.array([at[c].astype(np.int32).tobytes() for c in cut], pa.binary()), pa.array([counts[at[c]].astype(np.int32).tobytes() for c in cut], pa.binary())], names=["part", "n", "at", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    docs: dict[int, int] = {}
    size = SLOTS // _PARTS
    for batch in batches:
        for part, n, at, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = sums.setdefault(part, np.zeros(size, np.int64))
            own[np.frombuffer(at, np.int32) - part * size] += np.frombuffer(counts, np.int32)
            docs[part] = docs.get(part, 0) + n
    keys = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([docs[k] for k in keys], pa.int64()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["part", "n", "counts"])


def document_frequencies(own: DataFrame) -> tuple[np.ndarray, int]:
    """Counters of all documents' shingles by hash, and the number of documents. A task sends its counters once; they are added part by part, and ``SLOTS`` sums reach the driver."""
    tallied = own.mapInArrow(_tally, "part int, n long, at binary, counts binary")
    rows = tallied.repartition(_PARTS, "part").mapInArrow(_added, "part int, n long, counts binary").collect()
    counts, n = np.zeros((_PARTS, SLOTS // _PARTS), np.int64), 0
    for part, docs, raw in rows:
        counts[part] += np.frombuffer(raw, np.int64)
        n += docs
    return counts.ravel(), n


class Weights:
    """Weight of a shingle: tf * (1 + idf) with idf scaled to [0, 1]; ``rarity`` orders shingles, rare ones first."""

    def __init__(self, counts: np.ndarray, n: int) -> None:
        self.rarity = np.minimum(counts, n).astype(np.int64)
        idf = np.log((n + 1) / (self.rarity + 1)) / np.log(n + 1) if n else np.zeros(len(counts))
        self.table = (1 + np.clip(idf, 0, 1)).astype(np.float32)

    def of(self, grams: np.ndarray, times: np.ndarray) -> np.ndarray:
        return self.table[(grams >> _U(44)).astype(np.int64)] * times.astype(np.float32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (hashes in order, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    inner = float(np.minimum(a[1][i], b[1][j]).sum(dtype=float))
    whole = float(a[1].sum(dtype=float) + b[1].sum(dtype=float)) - inner
    return inner / whole if whole > 0 else 0.0


# --- sampling -----------------------------------------------------------------------------------------

_BITS = 16


class Sampler:
    """Improved consistent weighted sampling; a shingle's gamma and uniform variates are drawn from tables by its hash."""

    def __init__(self, n: int = BANDS * ROWS, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        size = 1 << _BITS
        self.r = rng.gamma(2, 1, size).astype(np.float32)
        self.lc = np.log(rng.gamma(2, 1, size)).astype(np.float32)
        self.beta = rng.random(size).astype(np.float32)
        self.turn = rng.integers(1, 1 << 63, n, dtype=np.uint64) | _U(1)

    def samples(self, grams: np.ndarray, weights: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """A row of samples (64-bit) for each non-empty stretch of ``grams`` between ``edges``."""
        starts, sizes = edges[:-1], np.diff(edges)
        lw = np.log(weights)
        out = np.empty((len(starts), len(self.turn)), _U)
        with np.errstate(over="ignore"):
            for k, turn in enumerate(self.turn):
                at = ((grams * turn) >> _U(64 - _BITS)).astype(np.int64)
                r, beta = self.r[at], self.beta[at]
                t = np.floor(lw / r + beta)
                a = self.lc[at] - r * (t - beta) - r
                hits = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), sizes))
                first = hits[np.searchsorted(hits, starts)]
                out[:, k] = _mix(grams[first] ^ (t[first].astype(np.int64).astype(_U) * _BASE) ^ turn)
        return out


def bands(samples: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros((len(samples), BANDS), _U)
        for k in range(ROWS):
            out = _mix(out * _BASE + samples[:, k::ROWS][:, :BANDS])
        return _mix(out + np.arange(BANDS, dtype=_U) * _BASE)


_SIGNED = "doc_id long, digest binary, bands array<long>, sig binary"


def sampled(values: list[str], weights: Weights, sampler: Sampler) -> Iterator[tuple[list[int], np.ndarray]]:
    """(indexes, rows of samples) of the texts that have shingles, a lot at a time."""
    lot: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def done() -> tuple[list[int], np.ndarray]:
        edges = np.cumsum([0, *(len(g) for _, g, _ in lot)])
        return [i for i, _, _ in lot], sampler.samples(np.concatenate([g for _, g, _ in lot]), np.concatenate([w for _, _, w in lot]), edges)

    for i, grams, times in shingles(values):
        if len(grams):
            lot.append((i, grams, weights.of(grams, times)))
            size += len(grams)
            if size >= 100_000:
                yield done()
                lot, size = [], 0
    if lot:
        yield done()


def low_bytes(samples: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in (samples & _U(255)).astype(np.uint8)]


def _sign(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    sampler = Sampler()
    for batch in batches:
        values = batch.column(1).to_pylist()
        found: list = [[]] * len(values)
        short: list = [b""] * len(values)
        for at, made in sampled(values, weights, sampler):
            for i, row, low in zip(at, bands(made).view(np.int64), low_bytes(made), strict=True):
                found[i], short[i] = row, low
        digests = [hashlib.sha256((v or "").encode("utf-8", "surrogatepass")).digest() for v in values]
        lists = pa.array([list(x) for x in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), lists, pa.array(short, pa.binary())], names=["doc_id", "digest", "bands", "sig"])


# --- links --------------------------------------------------------------------------------------------


def _agreeing(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of which at least such a share of samples agree, by their lowest bytes."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for n in ("a_sig", "b_sig"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array((x == y).mean(1) >= least))


def _measure(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    seen: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def vector(i: int, text: str) -> tuple[np.ndarray, np.ndarray]:
        if i not in seen:
            _, grams, times = next(shingles([text]))
            seen[i] = (grams, weights.of(grams, times))
            if len(seen) > 256:
                seen.popitem(last=False)
        return seen[i]

    for batch in batches:
        out = [similarity(vector(a, s), vector(b, t)) for a, s, b, t in zip(*(batch.column(n).to_pylist() for n in ("a", "a_text", "b", "b_text")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "s"])


_LONGS = MANY // 64
_DEEP = f"doc_id long, keys array<long>, bits struct<{', '.join(f'b{k}: bigint' for k in range(_LONGS))}>"


def _deeper(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    """Of ``MANY`` samples of each text a key for each table, the hash of ``DEEP`` of the samples, and a bit each."""
    sampler = Sampler(MANY, seed=11)
    rng = np.random.default_rng(5)
    picks = np.array([np.sort(rng.choice(MANY, DEEP, replace=False)) for _ in range(TABLES)])
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for at, made in sampled(batch.column("text").to_pylist(), weights, sampler):
            keys = np.tile(np.arange(1, TABLES + 1, dtype=_U), (len(at), 1))
            with np.errstate(over="ignore"):
                for pick in picks.T:
                    keys = _mix(keys * _BASE + made[:, pick])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * TABLES, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            longs = np.packbits((made & _U(1)).astype(np.uint8), axis=1).view(np.int64)
            bits = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in longs.T], names=[f"b{k}" for k in range(_LONGS)])
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), lists, bits], names=["doc_id", "keys", "bits"])


def _weighed(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each text: its hash and weight."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for i, grams, times in shingles(batch.column("text").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), ids[i])), pa.array(grams.view(np.int64)), pa.array(weights.of(grams, times))], names=["doc_id", "gram", "w"])


def rare_and_common(texts: DataFrame, held: Broadcast, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of texts (doc_id, text): the pairs (a, b) that share a rare shingle, one that ``FEW`` of them hold at most, and
    (doc_id, total, common), weights of all and of the other shingles, of texts that can have a link without.

    Texts that share no rare shingle share ``min(common)`` at most, and have a similarity of at most that by the rest of both
    totals. So a text whose common shingles weigh under ``threshold`` of it has links of the first kind alone. Each
    set of holders is taken once, however many shingles they share: at most ``(FEW - 1) / 2`` pairs a shingle.
    """
    grams = materialize(texts.mapInArrow(lambda it: _weighed(it, held.value), "doc_id long, gram long, w float"), "grams")
    often = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FEW).select("gram", F.lit(True).alias("often")), "often")
    marked = grams.join(_side(often, 16), "gram", "left")
    shares = marked.groupBy("doc_id").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("often"), F.col("w")).otherwise(0)).alias("common"))
    shares = materialize(shares.filter(F.col("common") >= (threshold - SLACK) * F.col("total")), "shares")
    holders = marked.filter("often is null").groupBy("gram").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).filter("size(ids) > 1").select("ids").distinct()
    pairs = holders.select(F.explode(F.flatten(F.transform("ids", lambda a, k: F.transform(F.slice("ids", k + 2, FEW), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    pairs = materialize(pairs.select("p.a", "p.b").distinct(), "pairs")
    forget(grams)
    forget(often)
    return pairs, shares


def _equal_bits(a: Column, b: Column) -> Column:
    return MANY - sum((F.bit_count(a[f"b{k}"].bitwiseXOR(b[f"b{k}"])) for k in range(_LONGS)), F.lit(0))


def _side(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table as a broadcast side if its rows, of ``row_bytes`` at most, take ``BROADCAST_BYTES`` at most, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


class _Pairs:
    """Pairs that were measured, and the texts they are made from."""

    def __init__(self, text: DataFrame, weights: Weights, threshold: float) -> None:
        self.text, self.threshold = text, threshold
        self.held = text.sparkSession.sparkContext.broadcast(weights)
        self.known = Table(text.sparkSession, "a long, b long, s double")

    def links(self, close: DataFrame) -> DataFrame | None:
        """Of different (a, b) those not measured before that are links; None if there is no new pair."""
        if self.known.parts:
            close = close.join(self.known.read().select("a", "b"), ["a", "b"], "left_anti")
        close = materialize(close, "close")
        if close.count() == 0:
            return None
        few = materialize(self.text.join(close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "doc_id", "left_semi"), "few")
        text = lambda c: few.select(F.col("doc_id").alias(c), F.col("text").alias(f"{c}_text"))
        held, of = self.held, self.known.schema
        met = close.join(text("a"), "a").join(text("b"), "b").select("a", "a_text", "b", "b_text")
        new = self.known.add(materialize(met.mapInArrow(lambda it: _measure(it, held.value), of), "measured"))
        forget(close)
        forget(few)
        return new.filter(F.col("s") >= self.threshold).select("a", "b")


def linked(own: DataFrame, alone: DataFrame, weights: Weights, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Labels (doc_id, label) of every text linked to another, and the links (a, b, s) that were measured.

    ``alone`` has doc_id, bands and sig of each different text. Every step makes a row for each member of a
    bucket and leader:

    1. All members of a band's bucket meet the least of them.
    2. Of members of a bucket that still lie in several components, pairs that share a rare shingle meet (see
       ``rare_and_common``). What each changed in a common text is rare, so that texts that have much, but not enough, in
       common make no pair, however many they are.
    3. Those that can have links without a rare shingle are sampled ``MANY`` times and go to finer
       buckets: ``TABLES`` tables of ``DEEP`` samples each. A pair of similarity 0.8 misses all of them with
       probability 0.01, one of 0.82 with 0.0005, while one of 0.6 shares 0.015 of them on average, so that texts
       that have much, but not enough, in common part.
    4. In each finer bucket, members of the smallest components meet those of other components and leave,
       until one component is left; 1, 4, 16 and then ``MOST_LEADERS`` a round. Two members of one component need not meet.
       Pairs whose common shingles weigh too little for a link are passed over: they lose none.
       Pairs of which fewer than ``EQUAL_BITS`` of the samples' low bits agree are passed over: a pair of similarity 0.8 has 461 of
       512 on average with a deviation of 7, and so few with probability 0.0001.
    """
    in_band = alone.select("doc_id", F.explode(F.array_distinct("bands")).alias("band"))
    led = materialize(in_band.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z").select("band", "a"), "led")
    met = materialize(in_band.join(led, "band").select("band", "a", F.col("doc_id").alias("b")), "met")
    ids = _side(materialize(met.select(F.col("b").alias("doc_id")).distinct(), "ids"), 16)
    text = materialize(own.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "candidates")
    sigs = materialize(alone.select("doc_id", "sig").join(ids, "doc_id", "left_semi"), "sigs")
    side = _side(sigs, 32 + BANDS * ROWS)
    sig = lambda c: side.select(F.col("doc_id").alias(c), F.col("sig").alias(f"{c}_sig"))
    agreeing = lambda these: these.join(sig("a"), "a").join(sig("b"), "b").mapInArrow(lambda it: _agreeing(it, AGREE), "a long, b long")
    pairs = _Pairs(text, weights, threshold)
    found = pairs.links(agreeing(met.filter("a != b").select("a", "b").distinct()))
    if found is None:
        return met.select("b", "b").toDF("doc_id", "label").limit(0), pairs.known.read()
    labels = components(found)

    named = met.filter("a != b").join(_side(labels, 16), F.col("b") == F.col("doc_id"), "left").select("band", "b", F.coalesce("label", "b").alias("label"))
    left = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band")
    left = _side(materialize(left, "left"), 8)
    within = materialize(met.filter("a != b").join(left, "band").select(F.col("b").alias("doc_id")).distinct(), "within")
    held, parts = pairs.held, max(own.sparkSession.sparkContext.defaultParallelism, within.count() // DEEP_TEXTS)
    deep = text.join(_side(within, 8), "doc_id", "left_semi").repartition(parts, "doc_id")
    sharing, shares = rare_and_common(deep, held, threshold)
    new = pairs.links(agreeing(_across(labels, sharing)))
    labels = labels if new is None else joined(labels, new)
    shares = _side(shares, 24)
    deep = materialize(deep.join(shares, "doc_id", "left_semi").mapInArrow(lambda it: _deeper(it, held.value), _DEEP), "deep")
    bits = _side(materialize(deep.select("doc_id", "bits").join(shares, "doc_id"), "bits"), 32 + MANY // 8)
    rows = deep.select(F.explode("keys").alias("key"), "doc_id")
    step = 0
    while True:
        n_leaders = min(4**step, MOST_LEADERS)
        sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        of = _side(materialize(labels.join(sizes, "label").select("doc_id", "label", "size"), "sized"), 24)
        now = rows.join(bits, "doc_id").join(of, "doc_id", "left").select("key", "bits", "total", "common", "doc_id", F.coalesce("label", "doc_id").alias("label"), F.coalesce("size", F.lit(1)).alias("size"))
        chosen = F.array(*(F.min(F.struct("size", F.xxhash64("doc_id", F.lit(100 * step + k)).alias("draw"), F.col("doc_id").alias("id"), "label", "bits", "total", "common")) for k in range(n_leaders)))
        several = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), chosen.alias("led")).filter("low < high")
        led = materialize(several.select("key", F.array_distinct(F.transform("led", lambda x: F.struct(*(x[c].alias(c) for c in ("id", "label", "bits", "total", "common"))))).alias("led")), "led")
        if led.count() == 0:
            break
        met = materialize(now.join(_side(led, 32 + (40 + MANY // 8) * n_leaders), "key"), "met")
        enough = lambda x: (1 + threshold) * F.least(x["common"], "common") >= (threshold - SLACK) * (x["total"] + F.col("total"))
        near = F.filter("led", lambda x: (x["label"] != F.col("label")) & enough(x) & (_equal_bits(x["bits"], F.col("bits")) >= EQUAL_BITS))
        against = met.select("doc_id", F.explode(F.transform(near, lambda x: x["id"])).alias("id"))
        new = pairs.links(against.select(F.least("doc_id", "id").alias("a"), F.greatest("doc_id", "id").alias("b")).distinct())
        labels = labels if new is None else joined(labels, new)
        rows = met.filter(~F.exists("led", lambda x: x["id"] == F.col("doc_id"))).select("key", "doc_id")
        step += 1
    return labels, pairs.known.read().filter(F.col("s") >= threshold)


def components(found: DataFrame) -> DataFrame:
    """(doc_id, label): the least id of each linked row's component, a written table. Labels spread along links and jump to their labels' labels until none changes."""
    edges = materialize(found.select("a", "b").union(found.select("b", "a")), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("b")).select("doc_id", F.least("doc_id", "b").alias("label")), "labels")
    while True:
        side = _side(labels, 16)
        heard = edges.join(side.select(F.col("doc_id").alias("b"), "label"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("label").alias("heard"))
        told = labels.join(heard, "doc_id").select("doc_id", "label", F.least("label", "heard").alias("new"))
        # written first where it is large, so that adaptive execution can split the members of a large component
        told = told if side is not labels else materialize(told, "told")
        roots = side.select(F.col("doc_id").alias("new"), F.col("label").alias("top"))
        after = materialize(told.join(roots, "new", "left").select("doc_id", F.col("label").alias("old"), F.least("new", F.coalesce("top", "new")).alias("label")), "labels")
        if after.filter("old != label").limit(1).count() == 0:
            forget(edges)
            return after.select("doc_id", "label")
        labels = after.select("doc_id", "label")


def _across(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b) those of two components."""
    side = _side(labels, 16)
    of = lambda c: side.select(F.col("doc_id").alias(c), F.col("label").alias(f"l{c}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: components of components, then a new label for the members of those that grew."""
    side = _side(labels, 16)
    of = lambda c: side.select(F.col("doc_id").alias(c), F.col("label").alias(f"l{c}"))
    across = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    across = materialize(across.filter("a != b").distinct(), "across")
    if across.count() == 0:
        return labels
    moved = _side(components(across).select(F.col("doc_id").alias("was"), F.col("label").alias("to")), 16)
    # a text without a link so far is its own component
    every = labels.unionByName(moved.join(labels, F.col("was") == F.col("doc_id"), "left_anti").select(F.col("was").alias("doc_id"), F.col("was").alias("label")))
    return materialize(every.join(moved, F.col("label") == F.col("was"), "left").select("doc_id", F.coalesce("to", "label").alias("label")), "labels")


def _classes(own: DataFrame, threshold: float) -> DataFrame:
    """doc_id, class_id, rep_id and n_links of texts whose ids are no null and stand for one text each."""
    weights = Weights(*document_frequencies(own))
    held = own.sparkSession.sparkContext.broadcast(weights)
    signed = materialize(own.mapInArrow(lambda it: _sign(it, held.value), _SIGNED), "signed")
    reps = materialize(signed.groupBy("digest").agg(F.min("doc_id").alias("rep")), "reps")
    of_text = reps.select("digest", F.col("rep").alias("doc_id"))
    alone = materialize(signed.join(of_text, ["digest", "doc_id"], "left_semi").groupBy("doc_id").agg(F.min(F.struct("digest", "bands", "sig")).alias("s")).filter(F.size("s.bands") > 0).select("doc_id", "s.bands", "s.sig"), "alone")
    labels, found = linked(own, alone, weights, threshold)
    counts = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    named = reps.join(labels, reps.rep == labels.doc_id, "left").join(counts, F.col("rep") == F.col("id"), "left")
    named = materialize(named.select("digest", "rep", F.coalesce("label", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    return signed.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id", F.col("rep").alias("rep_id"), "n_links")


def _ids_clash(rows: DataFrame) -> bool:
    """Whether an id stands for unlike texts."""
    same = rows.filter("doc_id is not null").groupBy("doc_id").agg((F.min(F.md5("text")) != F.max(F.md5("text"))).alias("clash"))
    return not same.filter("clash").isEmpty()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, unique: bool | None = None) -> DataFrame:
    """doc_id, class_id (the smallest id of its class), rep_id (the smallest id of its very text) and n_links (links that its text was found to have with other texts; these join a class, not all its pairs are measured) of every document.

    Where an id stands for unlike texts, each row has a class of its text: rows are numbered, and the numbers classed. Two classes
    whose smallest id is the same one then show it as class_id both. ``unique`` says that no id does, and saves the look.
    """
    whole = texts(docs, id_col, text_col)
    own = whole.filter("doc_id is not null")
    if not unique and _ids_clash(whole):
        keyed = materialize(own.withColumn("key", F.monotonically_increasing_id()), "keyed")
        found = materialize(_classes(keyed.select(F.col("key").alias("doc_id"), "text"), threshold), "found")
        ids = keyed.select("key", F.col("doc_id").alias("id"))
        met = materialize(found.join(ids, F.col("doc_id") == F.col("key")).select("id", F.col("class_id").alias("c"), F.col("rep_id").alias("r"), "n_links"), "met")
        least = lambda by, name: met.groupBy(by).agg(F.min("id").alias(name))
        known = met.join(least("c", "class_id"), "c").join(least("r", "rep_id"), "r").select(F.col("id").alias("doc_id"), "class_id", "rep_id", "n_links")
    else:
        known = _classes(own, threshold)
    nothing = F.lit(None).cast("long")
    return known.unionByName(whole.filter("doc_id is null").select("doc_id", nothing.alias("class_id"), nothing.alias("rep_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One document of each class, with all its columns: the one whose id is the class; of repeated rows of it, one, the first by a hash of the row. Unlike texts under one id are documents of their own. Rows of a null id stay."""
    null = docs.filter(F.col(id_col).isNull())
    if _ids_clash(texts(docs, id_col, text_col)):
        keyed = materialize(docs.filter(F.col(id_col).isNotNull()).withColumn("__sm_key", F.monotonically_increasing_id()), "keyed")
        found = classes(keyed, "__sm_key", text_col, threshold, True).select(F.col("doc_id").alias("__sm_key"), F.col("class_id").alias("__sm_class"))
        order = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(*docs.columns).alias("hash"), F.col("__sm_key").alias("key"))
        first = keyed.select("__sm_key", order.alias("__sm_order")).join(found, "__sm_key").groupBy("__sm_class").agg(F.min("__sm_order").alias("o")).select(F.col("o.key").alias("__sm_key"))
        return keyed.join(_side(materialize(first, "keep"), 8), "__sm_key", "left_semi").select(*docs.columns).unionByName(null)
    keep = materialize(classes(docs, id_col, text_col, threshold, True).filter("doc_id = class_id").groupBy(F.col("class_id").alias("__sm_keep")).agg((F.count(F.lit(1)) > 1).alias("__sm_more")), "keep")
    met = docs.join(_side(keep, 16), F.col(id_col).cast("long") == F.col("__sm_keep"))
    once = met.filter(~F.col("__sm_more")).select(*docs.columns)
    # a few rows, all of one text and id: the first by a hash of the whole row, so that reruns agree
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(*docs.columns))
    repeated = met.filter("__sm_more").withColumn("__sm_first", F.row_number().over(first)).filter("__sm_first = 1").select(*docs.columns)
    return once.unionByName(repeated).unionByName(null)
