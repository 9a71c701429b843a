"""Removal of repeated byte strings by suffix sorting.

Every byte goes that a 50-byte string covers which also starts in a document of smaller id; strings are
judged on the input. Windows of 50 bytes are dealt by their minimiser, the least hash among their 16-byte
strings: equal windows have equal minimisers, and neighbouring windows mostly share one, so that a run of
windows travels as one fragment. Then

1. documents hand over the minimisers of their runs, and learn which of them another document has too;
2. fragments of those runs only meet by minimiser, where their windows are sorted as suffixes (see
   ``suffixes``) and each run of equal windows gives its smallest document;
3. covered stretches return to their documents.

Before each exchange a batch folds what it holds alike: a minimiser of many documents of a batch is sent
once, equal fragments are sent once, for the smallest of their documents, and settle the others on the spot.
So a passage that a third of all documents share costs a row a batch, not a row a document. The number of
buckets follows the input's bytes. Nothing is collected or broadcast but that number.

Defined results: a null text is empty; texts under 50 bytes keep all; rows of one id don't remove from each
other, each is judged on its own text, be the texts equal or not; rows of a null id keep all; extra columns are
not read; long texts are cut into overlapping pieces, so that memory doesn't grow with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import suffixes as SX
from .common import OWN, materialize

LENGTH, GRAM, LONGEST_RUN, PIECE, BUCKET_BYTES = 50, 16, 64, 1 << 20, 1 << 21
#: Places in the n-th of the unlike texts of one id are told from n << PLACE_BITS on.
PLACE_BITS = 40
_U = np.uint64


def _table() -> np.ndarray:
    return np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


_BYTE, _BASE = _table(), _U(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def minimisers(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The least hash among the GRAM-byte strings of each window of ``length`` bytes."""
    h, power, n = _BYTE[text], _BASE, 1
    while n < GRAM:
        h = h[:-n] * power + h[n:]
        power, n = power * power, 2 * n
    h = _spread(h)
    span, n = length - GRAM + 1, 1
    while 2 * n <= span:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (span - n)], h[span - n :]) if span > n else h


def runs(text: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser in pieces laid end to end (``ends``): minimiser, first window, number of windows, piece."""
    none = np.empty(0, np.int64)
    if len(text) < length:
        return np.empty(0, _U), none, none, none
    with np.errstate(over="ignore"):
        least = minimisers(text, length)
    sizes = np.diff(np.append(0, ends))
    good = np.zeros(len(text) + 1, np.int8)
    fit = sizes >= length
    np.add.at(good, (ends - sizes)[fit], 1)
    np.add.at(good, (ends - length + 1)[fit], -1)
    good = np.cumsum(good)[: len(least)].astype(bool)
    new = good.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~good[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return np.empty(0, _U), none, none, none
    piece = np.searchsorted(ends, first, side="right")
    stop = np.minimum(np.append(first[1:], len(least)), ends[piece] - length + 1)
    count = stop - first
    if count.max() > LONGEST_RUN:
        parts = -(-count // LONGEST_RUN)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, piece, stop = np.repeat(first, parts) + k * LONGEST_RUN, np.repeat(piece, parts), np.repeat(stop, parts)
        count = np.minimum(LONGEST_RUN, stop - first)
    return least[first], first, count, piece


def _bytes(column: pa.Array) -> Iterator[bytes]:
    """The texts of a column in UTF-8, one at a time: a batch may hold hundreds of megabytes."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def pieces(values: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in lots of about PIECE bytes: bytes, ends of pieces, the text of each and where in it the piece begins; long texts overlap by LENGTH - 1."""
    lot: list[bytes] = []
    owner: list[int] = []
    begin: list[int] = []
    size = 0
    for i, value in enumerate(values):
        for at in range(0, max(1, len(value) - LENGTH + 1), PIECE):
            part = value[at : at + PIECE + LENGTH - 1]
            lot.append(part)
            owner.append(i)
            begin.append(at)
            size += len(part)
            if size >= PIECE:
                yield np.frombuffer(b"".join(lot), np.uint8), np.cumsum([len(x) for x in lot]), np.array(owner), np.array(begin)
                lot, owner, begin, size = [], [], [], 0
    if lot:
        yield np.frombuffer(b"".join(lot), np.uint8), np.cumsum([len(x) for x in lot]), np.array(owner), np.array(begin)


def packed(numbers: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers from 0 as compressed byte planes, of their differences if they ascend; most planes are empty."""
    x = numbers.astype(np.uint64)
    if ascending and len(x):
        x = np.append(x[:1], np.diff(x))
    return zstandard.ZstdCompressor(1).compress(x.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(blob: bytes, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
    return np.cumsum(x, dtype=np.uint64) if ascending else x


def _stretches(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each bucket of a sorted column that has rows, and where they are."""
    found, begin = np.unique(bucket, return_index=True)
    for b, start, end in zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(bucket)], strict=True):
        yield b, slice(start, end)


def _blobs(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Rows dealt by bucket, the first column ascending in each: the columns packed."""
    _, order = SX.dense(bucket, columns[0])
    columns = tuple(c[order] for c in columns)
    for b, own in _stretches(bucket[order]):
        yield b, [packed(c[own], k == 0) for k, c in enumerate(columns)]


# --- step 1: which minimisers are shared --------------------------------------------------------------

#: Bits of a minimiser that are sent: two that agree in them by chance only cost work, about one in thirty at 100 TB.
SENT_BITS = 48
_SENT = "bucket int, base long, least binary, doc binary, state binary"
_ALONE, _SETTLED, _TOLD = 0, 1, 2


def _offer(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row per bucket and batch. Of each minimiser the smallest document is sent; with others in the batch it is settled, and all of them are told."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        least, doc = [], []
        for text, ends, owner, _ in pieces(_bytes(batch.column(1))):
            m, _, _, piece = runs(text, ends)
            least.append(m >> _U(64 - SENT_BITS))
            doc.append(ids[owner[piece]])
        m, d = np.concatenate([np.empty(0, _U), *least]), np.concatenate([np.empty(0, np.int64), *doc])
        _, order = SX.dense(m, d)
        m, d = m[order], d[order]
        same = np.append(False, (m[1:] == m[:-1]) & (d[1:] == d[:-1]))
        m, d = m[~same], d[~same]
        first = np.append(True, m[1:] != m[:-1])[: len(m)]
        group = np.cumsum(first) - 1
        many = np.bincount(group, minlength=0)[group] > 1 if len(m) else first
        state = np.where(many, _SETTLED, _ALONE)[first].astype(np.int8)
        told = np.where(many)[0]
        m_all, d_all = np.concatenate([m[first], m[told]]), np.concatenate([d[first], d[told]])
        s_all = np.concatenate([state, np.full(len(told), _TOLD, np.int8)])
        with np.errstate(over="ignore"):
            bucket = np.where(s_all == _TOLD, _spread(d_all.astype(_U) * _BASE), _spread(m_all * _BASE)) % _U(buckets)
        base = int(ids.min()) if len(ids) else 0
        rows = list(_blobs(bucket.astype(np.int64), m_all, d_all - base, s_all))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([base] * len(rows), pa.int64()), *(pa.array([x[k] for _, x in rows], pa.binary()) for k in range(3))], names=["bucket", "base", "least", "doc", "state"])


def _joined(table: pa.Table, name: str, ascending: bool = False) -> np.ndarray:
    return np.concatenate([np.empty(0, _U), *(unpacked(x, ascending) for x in table.column(name).to_pylist())])


def _shared(table: pa.Table) -> pa.Table:
    """(doc_id, least) of every run that another document has too."""
    m, s = _joined(table, "least", True), _joined(table, "state")
    d = np.concatenate([np.empty(0, np.int64), *(unpacked(x).view(np.int64) + b for x, b in zip(table.column("doc").to_pylist(), table.column("base").to_pylist(), strict=True))])
    told, open_ = s == _TOLD, np.flatnonzero(s != _TOLD)
    order = open_[SX.dense(m[open_], d[open_])[1]]
    mo, do = m[order], d[order]
    edge = np.flatnonzero(np.append(True, mo[1:] != mo[:-1]))[: len(mo)]
    size = np.diff(np.append(edge, len(mo)))
    lo, hi = np.minimum.reduceat(do, edge) if len(edge) else do, np.maximum.reduceat(do, edge) if len(edge) else do
    wanted = np.repeat(lo != hi, size) & (s[order] == _ALONE)
    return pa.table([pa.array(np.concatenate([d[told], do[wanted]])), pa.array(np.concatenate([m[told], mo[wanted]]).view(np.int64))], names=["doc_id", "least"])


# --- step 2: fragments and their suffixes -------------------------------------------------------------

_FRAGMENTS = "bucket int, bytes binary, size binary, doc binary, start binary"


def _send(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Fragments of the shared runs. Equal ones of a batch go once, for their smallest document; for the others an empty fragment tells that all of it is covered."""
    for batch in batches:
        ids = batch.column(0).to_numpy().astype(np.int64)
        shared = batch.column(2)
        shift = batch.column(3).to_numpy().astype(np.int64) << PLACE_BITS
        known: dict[bytes, int] = {}
        entries: list[tuple[int, int, int]] = []  # fragment, document, start
        for text, ends, owner, begin in pieces(_bytes(batch.column(1))):
            m, first, count, piece = runs(text, ends)
            base = np.append(0, ends)
            edges = np.searchsorted(piece, np.arange(len(ends) + 1))
            raw = text.tobytes()
            for p in range(len(ends)):
                own = slice(edges[p], edges[p + 1])
                if edges[p] == edges[p + 1]:
                    continue
                hit = np.isin(m[own] >> _U(64 - SENT_BITS), shared[int(owner[p])].values.to_numpy().view(_U))
                doc, move = int(ids[owner[p]]), int(begin[p] - base[p] + shift[owner[p]])
                for a, n in zip(first[own][hit].tolist(), count[own][hit].tolist(), strict=True):
                    fragment = raw[a : a + n + LENGTH - 1]
                    entries.append((known.setdefault(fragment, len(known)), doc, a + move))
        if not entries:
            continue
        fragments = list(known)
        e = np.array(entries, np.int64)
        e = e[np.lexsort((e[:, 2], e[:, 1], e[:, 0]))]
        new = np.append(True, e[1:, 0] != e[:-1, 0])
        smallest = e[new, 1][np.cumsum(new) - 1]
        sent = e[:, 1] == smallest
        sizes = np.array([len(f) for f in fragments], np.int64)
        least = np.empty(len(fragments), _U)
        for k in range(0, len(fragments), 20_000):
            part = fragments[k : k + 20_000]
            joined = np.frombuffer(b"".join(part), np.uint8)
            with np.errstate(over="ignore"):
                least[k : k + len(part)] = minimisers(joined)[np.cumsum([0, *map(len, part[:-1])])]
        with np.errstate(over="ignore"):
            bucket = _spread(least[e[:, 0]] * _BASE) % _U(buckets)
        whole = _merged_rows(e[~sent, 1], e[~sent, 2], e[~sent, 2] + sizes[e[~sent, 0]])
        with np.errstate(over="ignore"):
            bucket = np.concatenate([bucket[sent], _spread(whole[:, 0].astype(_U) * _BASE) % _U(buckets)]).astype(np.int64)
        size = np.concatenate([sizes[e[sent, 0]], whole[:, 1] - whole[:, 2]])
        e = np.concatenate([e[sent], np.column_stack([np.zeros(len(whole), np.int64), whole[:, :2]])])
        # equal minimisers side by side, so that fragments alike are compressed together
        order = np.lexsort((np.append(least[e[: int(sent.sum()), 0]], np.zeros(len(whole), _U)), size < 0, bucket))
        e, bucket, size = e[order], bucket[order], size[order]
        sent = size > 0
        rows: list[list] = [[] for _ in range(5)]
        for b, own in _stretches(bucket):
            raw = zstandard.ZstdCompressor(3).compress(b"".join(fragments[i] for i in e[own, 0][sent[own]].tolist()))
            for row, value in zip(rows, (b, raw, size[own].astype(np.int64).tobytes(), e[own, 1].tobytes(), e[own, 2].tobytes()), strict=True):
                row.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["bucket", "bytes", "size", "doc", "start"])


def _merged_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(document, start, end) of the unions of stretches that touch."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return np.empty((0, 3), np.int64)
    # ends grow with starts once each document is shifted past the one before
    shift = np.cumsum(np.append(0, doc[1:] != doc[:-1])) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.append(True, start[1:] + shift[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
    return np.column_stack([doc[new], start[new], reach[last] - shift[last]])


def covered(fragments: list[bytes], docs: np.ndarray) -> list[list[tuple[int, int]]]:
    """For distinct fragments, each with its smallest document: the stretches covered by windows that a smaller document's fragment has too."""
    sizes = np.array([len(f) for f in fragments], np.int64)
    text = np.frombuffer(b"".join([*fragments, bytes(SX.DEPTH + 2 * SX.PERIOD)]), np.uint8)
    starts = np.cumsum(sizes) - sizes
    n = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(fragments)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = starts[owner] + offset
    index = np.full(len(text), -1, np.int64)
    index[at] = np.arange(len(at))
    hit = np.zeros(len(at), bool)
    cover = SX.Cover(text)
    for block in cover.sorted_blocks(at):
        if len(block):
            window = index[block]
            doc = docs[owner[window]]
            run = SX.equal_runs(cover.words, block, LENGTH)
            edge = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            hit[window] = doc > np.minimum.reduceat(doc, edge)[run]
    out: list[list[tuple[int, int]]] = [[] for _ in fragments]
    marks = np.flatnonzero(hit)
    if len(marks):
        fresh = np.append(True, (marks[1:] != marks[:-1] + 1) | (owner[marks[1:]] != owner[marks[:-1]]))
        first, last = marks[fresh], marks[np.append(np.flatnonzero(fresh)[1:] - 1, len(marks) - 1)]
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            out[owner[a]].append((int(offset[a]), int(offset[b]) + LENGTH))
    return out


def _suffix_bucket(table: pa.Table) -> pa.Table:
    """(doc_id, start, end): stretches of the bucket's documents that are covered."""
    rows: list[tuple[int, int, int]] = []
    known: dict[bytes, list[tuple[int, int]]] = {}
    for raw, size, doc, start in zip(*(table.column(n).to_pylist() for n in ("bytes", "size", "doc", "start")), strict=True):
        at, raw = 0, zstandard.ZstdDecompressor().decompress(raw)
        for n, d, s in zip(np.frombuffer(size, np.int64).tolist(), np.frombuffer(doc, np.int64).tolist(), np.frombuffer(start, np.int64).tolist(), strict=True):
            if n < 0:
                rows.append((d, s, s - n))
            else:
                known.setdefault(raw[at : at + n], []).append((d, s))
                at += n
    if known:
        least = np.array([min(d for d, _ in places) for places in known.values()], np.int64)
        stretches = covered(list(known), least)
        for (fragment, places), smallest, spans in zip(known.items(), least.tolist(), stretches, strict=True):
            for d, s in places:
                rows += [(d, s, s + len(fragment))] if d > smallest else [(d, s + a, s + b) for a, b in spans]
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "end"])


# --- step 3: what is left -----------------------------------------------------------------------------

_OUT = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType())))])


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[tuple[int, int]] = []
    order = np.argsort(starts, kind="stable")
    for a, b in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in range(5)]
        for text, number, starts, ends in zip(*(batch.column(k) for k in (1, 2, 3, 4)), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            spans = []
            if starts.is_valid:
                first, last = starts.values.to_numpy(), ends.values.to_numpy()
                own, move = first >> PLACE_BITS == number.as_py(), number.as_py() << PLACE_BITS
                spans = merged(first[own] - move, last[own] - move)
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            for row, value in zip(rows, (len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [list(s) for s in spans]), strict=True):
                row.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.int64()) for r in rows[:3]), pa.array(rows[3], pa.string()), pa.array(rows[4], pa.list_(pa.list_(pa.int64())))], names=_OUT.names)


def _own(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(__sm_id, __sm_text, __sm_number) and the number of buckets for its bytes. The number tells unlike texts of one id apart, and is 0 where there is one.

    Texts are told apart by 64-bit hashes. Only the ids that have several are numbered, in a table of their own.
    """
    number, mark = OWN + "number", OWN + "hash"
    own = docs.select(F.col(id_col).cast("long").alias(OWN + "id"), F.coalesce(F.col(text_col), F.lit("")).alias(OWN + "text"))
    hashed = own.filter(F.col(OWN + "id").isNotNull()).select(OWN + "id", F.xxhash64(OWN + "text").alias(mark), F.octet_length(OWN + "text").cast("long").alias("size"))
    ids = hashed.groupBy(OWN + "id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi"), F.sum("size").alias("size"))
    total, several = ids.agg(F.sum("size"), F.count_if(F.col("lo") != F.col("hi"))).first()
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // BUCKET_BYTES))
    if not several:
        return own.withColumn(number, F.lit(0).cast("long")), buckets
    order = F.row_number().over(Window.partitionBy(OWN + "id").orderBy(mark)) - 1
    told_apart = hashed.join(ids.filter("lo <> hi"), OWN + "id", "left_semi").select(OWN + "id", mark).distinct()
    numbers = materialize(told_apart.withColumn(number, order.cast("long")), "numbers")
    met = own.withColumn(mark, F.xxhash64(OWN + "text")).join(numbers, [OWN + "id", mark], "left")
    return met.select(OWN + "id", OWN + "text", F.coalesce(number, F.lit(0)).alias(number)), buckets


def _found(own: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, start, end): stretches, in bytes, that go; they may overlap. Those of a text of number n lie from n << PLACE_BITS on."""
    own = own.filter(F.col(OWN + "id").isNotNull())
    offered = own.mapInArrow(lambda it: _offer(it, buckets), _SENT)
    shared = offered.groupBy("bucket").applyInArrow(_shared, "doc_id long, least long")
    told = shared.groupBy(F.col("doc_id").alias(OWN + "id")).agg(F.collect_list("least").alias("least"))
    sent = own.join(told, OWN + "id").select(OWN + "id", OWN + "text", "least", OWN + "number").mapInArrow(lambda it: _send(it, buckets), _FRAGMENTS)
    return sent.groupBy("bucket").applyInArrow(_suffix_bucket, "doc_id long, start long, end long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (array of [start, end)) of every document.

    The documents are dealt by id once: both joins read the same exchange.
    """
    own, buckets = _own(docs, id_col, text_col)
    spans = _found(own, buckets).groupBy(F.col("doc_id").alias(OWN + "id")).agg(F.collect_list(F.struct("start", "end")).alias("s")).select(OWN + "id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    read = (OWN + "id", OWN + "text", OWN + "number", "start", "end")
    joined = own.filter(F.col(OWN + "id").isNotNull()).join(spans, OWN + "id", "left").select(*read)
    alone = own.filter(F.col(OWN + "id").isNull()).select(*read[:3], *(F.lit(None).cast("array<bigint>").alias(n) for n in ("start", "end")))
    return joined.unionByName(alone).mapInArrow(_finish, _OUT)
