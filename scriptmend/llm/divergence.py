"""Source divergence audit: how far the word use of each source of a language lies from every other source's, and which terms stand out.

Terms are runs of letters and characters past ASCII, A-Z lower-cased; a language keeps those in at least ``least`` of its
documents. With counts of kept terms smoothed to p = 1 + floor(10^9 (count + 1) / (N + V)), two sources differ by the sum
over kept terms of floor((p - q)^2 / q), and a term stands out in a source by that figure against its whole language.

1. Each task counts its terms in radix tries (``tries``), a trie a language, leaves having a counter for each source; a
   trie of ``LEAVES`` terms is written out in byte order and emptied, so memory is bounded.
2. The written tries are dealt by ranges of (language, term), as many ranges as their rows need, and a task merges
   those of its range into one trie. Terms of too few documents go.
3. Sums by source and language (N, V) are aggregated. Tasks traverse the kept terms in order, in blocks; pairs of sources get
   exact partial sums, and each source keeps its ``top`` best terms, ties to the smaller. Sums are made from terms that
   both sources have (a term's sources squared, which the pairs need), from each source's counts against the smoothed
   zero of the others, and from a closed form for terms that neither has; no table of terms by pairs is ever made.
4. Partial sums are added and candidates ranked.

The table of sources (a row of numbers each) is broadcast in blocks of ``SOURCES`` rows, dealt by hash; beyond one block, pairs of
blocks are gone through in turn. Numbers are 64-bit, products past that are never formed: exact up to 9 * 10^15 words a source.

Defined results: null text, lang and source are ''; every row is a document, repeated ones too; texts of any length are counted
whole; a source without terms takes part with counts of 0; ties rank by UTF-8 order of the item; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tries import CountedTrie
from .words import LETTERS, lots, words_of

LEAST, TOP, LEAVES, SOURCES, SCALE, STEPS = 3, 200, 250_000, 50_000, 1000, 3

_COUNTED = "lang string, term string, docs long, sources array<string>, counts array<long>"


class _Tries:
    """The tries of a task, by language, and the numbers it has given to sources."""

    def __init__(self, least: int = 0) -> None:
        self.least, self.sources, self.tries = least, {}, {}

    def of(self, lang: str) -> CountedTrie:
        if lang not in self.tries:
            self.tries[lang] = CountedTrie()
        return self.tries[lang]

    def number(self, sources: list[str]) -> np.ndarray:
        return np.array([self.sources.setdefault(s, len(self.sources)) for s in sources], np.int64)

    def size(self) -> int:
        return sum(t.trie.size + len(t.by_source.keys) // 8 for t in self.tries.values())

    def written(self) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(self.sources), pa.string())
        for lang in sorted(self.tries):
            terms, docs, begins, sources, amounts = self.tries[lang].rows()
            keep = np.flatnonzero(docs >= self.least)
            for part in np.array_split(keep, max(1, -(-len(keep) // 20_000))):
                sizes = begins[part + 1] - begins[part]
                ends = np.cumsum(sizes)
                at = np.repeat(begins[part] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                columns = [pa.array([lang] * len(part), pa.string()), pa.array([terms[k].decode() for k in part.tolist()], pa.string()), pa.array(docs[part]), pa.ListArray.from_arrays(offsets, names.take(pa.array(sources[at]))), pa.ListArray.from_arrays(offsets, pa.array(amounts[at]))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "docs", "sources", "counts"])
        self.tries, self.sources = {}, {}


def _grouped(key: np.ndarray, amount: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each occurs or the sum of its amounts."""
    if amount is None:
        return np.unique(key, return_counts=True)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(amount[order], first) if len(first) else amount


def _count(batches: Iterator[pa.RecordBatch], leaves: int) -> Iterator[pa.RecordBatch]:
    """Terms of the task's documents; a group's row with the empty term says that the group occurs."""
    tries = _Tries()
    groups: set[tuple[str, str]] = set()
    for whole in batches:
        langs, sources = (pc.fill_null(whole.column(k), "").dictionary_encode() for k in (1, 2))
        for at, part in lots(pc.fill_null(whole.column(0), "").cast(pa.string())):
            words = words_of(part, LETTERS)
            lang, source = (c.indices.to_numpy()[at : at + len(part)].astype(np.int64) for c in (langs, sources))
            groups.update((langs.dictionary[a].as_py(), sources.dictionary[b].as_py()) for a, b in {*zip(lang.tolist(), source.tolist(), strict=True)})
            coded = words.words.dictionary_encode()
            terms, codes = np.array(coded.dictionary.cast(pa.binary()).to_pylist(), object), coded.indices.to_numpy().astype(np.int64)
            number = tries.number(sources.dictionary.to_pylist())
            for k in np.unique(lang).tolist():
                trie, own = tries.of(langs.dictionary[k].as_py()), lang[words.text] == k
                code, text = codes[own], words.text[own]
                used, code = np.unique(code, return_inverse=True)
                leaf = trie.leaves_of(terms[used])
                pair, n = _grouped(code * len(number) + source[text])
                trie.by_source.add(leaf[pair // len(number)], number[pair % len(number)], n)
                held, n = np.unique(np.unique(code * len(part) + text) // len(part), return_counts=True)
                trie.docs.add(leaf[held], np.zeros(len(held), np.int64), n)
            if tries.size() >= leaves:
                yield from tries.written()
    yield from tries.written()
    rows = sorted(groups)
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.string()), pa.array([""] * len(rows), pa.string()), pa.array([0] * len(rows), pa.int64()), pa.array([[b] for _, b in rows], pa.list_(pa.string())), pa.array([[0]] * len(rows), pa.list_(pa.int64()))], names=["lang", "term", "docs", "sources", "counts"])


def _merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The tries of one range as one."""
    tries = _Tries(least)
    for batch in batches:
        lang, terms = batch.column(0).dictionary_encode(), np.array(batch.column(1).cast(pa.binary()).to_pylist(), object)
        codes, docs, lists = lang.indices.to_numpy(), batch.column(2).to_numpy(), batch.column(3)
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        sources = lists.flatten().dictionary_encode()
        source, counts = tries.number(sources.dictionary.to_pylist())[sources.indices.to_numpy()], batch.column(4).flatten().to_numpy()
        for k, name in enumerate(lang.dictionary.to_pylist()):
            trie, own = tries.of(name), codes == k
            leaf = np.zeros(batch.num_rows, np.int64)
            leaf[own] = trie.leaves_of(terms[own])
            inner = own[row]
            trie.by_source.add(leaf[row[inner]], source[inner], counts[inner])
            trie.docs.add(leaf[own], np.zeros(int(own.sum()), np.int64), docs[own])
    yield from tries.written()


def smoothed(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total) by long division; total is N + V, at least count + 1."""
    rest, out = count + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(STEPS):
        out = out * SCALE + rest * SCALE // total
        rest = rest * SCALE % total
    return 1 + out


def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _top(group: np.ndarray, value: np.ndarray, order_of: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` largest values of each group, ties to the smaller order."""
    order = np.lexsort((order_of, -value, group))
    group = group[order]
    return order[np.arange(len(group)) - np.searchsorted(group, group) < top]


class _Best:
    """The ``top`` best terms of each group met so far; terms are bytes, so their order is that of UTF-8."""

    def __init__(self, top: int) -> None:
        self.top, self.group, self.value, self.term = top, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, object)

    def add(self, group: np.ndarray, value: np.ndarray, row: np.ndarray, terms: np.ndarray) -> None:
        """Values of rows, whose terms ``terms`` has in order."""
        some = _top(group, value, row, self.top)
        self.group, self.value, self.term = (np.concatenate(x) for x in ((self.group, group[some]), (self.value, value[some]), (self.term, terms[row[some]])))
        place = np.empty(len(self.term), np.int64)
        place[np.argsort(self.term, kind="stable")] = np.arange(len(self.term))
        kept = _top(self.group, self.value, place, self.top)
        self.group, self.value, self.term = self.group[kept], self.value[kept], self.term[kept]


class _Sums:
    """Exact sums by pair of groups, whose numbers are below 2^31; kept in memory up to ``most`` pairs or so, then handed over."""

    def __init__(self, most: int = 1 << 20) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.sums, self.waiting, self.n = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def add(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> None:
        self.waiting.append(_grouped(left << 31 | right, value))
        self.n += len(self.waiting[-1][0])
        if self.n > max(self.most, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        self.keys, self.sums = _grouped(np.concatenate([self.keys, *(k for k, _ in self.waiting)]), np.concatenate([self.sums, *(v for _, v in self.waiting)]))
        self.waiting, self.n = [], 0


class _Stats:
    """What a block of groups is broadcast as: of each its name, N + V, its language's N + V, and p of a count of 0."""

    def __init__(self, rows: list[tuple[str, str, int, int, int]]) -> None:
        self.names = [(r[0], r[1]) for r in rows]
        self.number = {name: k for k, name in enumerate(self.names)}
        self.total, self.whole = np.array([max(1, r[2] + r[3]) for r in rows], np.int64), np.array([max(1, r[4] + r[3]) for r in rows], np.int64)
        self.zero = smoothed(np.zeros(len(rows), np.int64), self.total)
        names = sorted({lang for lang, _ in self.names})
        self.lang = {name: k for k, name in enumerate(names)}
        self.of_lang = [np.array([k for k, (lang, _) in enumerate(self.names) if lang == name], np.int64) for name in names]


def _expanded(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entry, number within it) for each of an entry's ``size`` partners, in lots of about ``most``."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        entry = np.repeat(np.arange(at, to), sizes[at:to])
        yield entry, np.arange(done, int(ends[to - 1])) - (ends[entry] - sizes[entry])
        at = to


class _Times:
    """How many terms of each group have each count."""

    def __init__(self) -> None:
        self.rows = np.empty((0, 3), np.int64)

    def add(self, group: np.ndarray, count: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.column_stack([group, count, np.ones(len(group), np.int64)])])
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])) if len(rows) else np.empty(0, np.int64)
        self.rows = np.column_stack([rows[first, :2], np.add.reduceat(rows[:, 2], first)]) if len(first) else rows


def _against_zero(times: _Times, own: _Stats, other: _Stats, flipped: bool, sums: _Sums) -> None:
    """Adds what each group's terms make against groups of its language that lack them, less what two zeros make; ``flipped`` if ``own`` is the right side."""
    group, count, n = times.rows.T
    # groups of a language lie together in ``flat``
    flat, sizes = np.concatenate([np.empty(0, np.int64), *other.of_lang]), np.array([0, *map(len, other.of_lang)], np.int64)
    lang = np.array([other.lang.get(x, -1) for x, _ in own.names], np.int64)[group] + 1
    first = (np.cumsum(sizes) - sizes)[lang]
    p = smoothed(count, own.total[group])
    for entry, at in _expanded(sizes[lang]):
        g, h = group[entry], flat[first[entry] + at]
        if flipped:
            sums.add(h, g, n[entry] * (far(other.zero[h], p[entry]) - far(other.zero[h], own.zero[g])))
        else:
            sums.add(g, h, n[entry] * (far(p[entry], other.zero[h]) - far(own.zero[g], other.zero[h])))


_FIGURES = "lang string, source string, part string, item string, value long"


def _rows(part: str, own: list[tuple[str, str]], items: list[str], values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.string()), pa.array([x for _, x in own], pa.string()), pa.array([part] * len(own), pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "part", "item", "value"])


def _partials(sums: _Sums, left: _Stats, right: _Stats) -> Iterator[pa.RecordBatch]:
    sums.settle()
    for at in range(0, len(sums.keys), 50_000):
        keys = sums.keys[at : at + 50_000]
        yield _rows("pair", [left.names[k] for k in (keys >> 31).tolist()], [right.names[k][1] for k in (keys & (1 << 31) - 1).tolist()], sums.sums[at : at + 50_000])
    sums.clear()


def _traverse(batches: Iterator[pa.RecordBatch], left: _Stats, right: _Stats, top: int) -> Iterator[pa.RecordBatch]:
    """Partial sums of pairs (left group, right group), less what both would have without a count, and the left groups' best terms (none if top is 0)."""
    best, sums, times_l, times_r = _Best(top), _Sums(), _Times(), _Times()
    for batch in batches:
        langs, lists = batch.column(0).dictionary_encode(), batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        sources, count = lists.flatten().dictionary_encode(), batch.column(3).flatten().to_numpy()
        lang, code, named = langs.indices.to_numpy()[row], sources.indices.to_numpy(), sources.dictionary.to_pylist()
        sides = []
        for stats in (left, right):
            number = np.array([[stats.number.get((x, y), -1) for y in named] for x in langs.dictionary.to_pylist()], np.int64).reshape(-1, len(named))
            group = number[lang, code]
            own = np.flatnonzero(group >= 0)
            sides.append((row[own], group[own], count[own]))
        (row_l, g, c), (row_r, h, d) = sides
        p, q = smoothed(c, left.total[g]), smoothed(d, right.total[h])
        times_l.add(g, c)
        times_r.add(h, d)
        if top:
            terms = np.array(batch.column(1).cast(pa.binary()).to_pylist(), object)
            order = np.argsort(terms, kind="stable")
            place = np.empty(len(terms), np.int64)
            place[order] = np.arange(len(terms))
            whole = np.zeros(batch.num_rows, np.int64)
            np.add.at(whole, row, count)
            of_lang = smoothed(whole[row_l], left.whole[g])
            more = p > of_lang
            best.add(g[more], far(p[more], of_lang[more]), place[row_l[more]], terms[order])
        # terms that both have
        n_right = np.bincount(row_r, minlength=batch.num_rows)
        begins = np.cumsum(n_right) - n_right
        for i, at in _expanded(n_right[row_l]):
            j = begins[row_l[i]] + at
            zero_l, zero_r = left.zero[g[i]], right.zero[h[j]]
            sums.add(g[i], h[j], far(p[i], q[j]) - far(p[i], zero_r) - far(zero_l, q[j]) + far(zero_l, zero_r))
        if len(sums.keys) > 2 * sums.most:
            yield from _partials(sums, left, right)
    for times, own, other in ((times_l, left, right), (times_r, right, left)):
        _against_zero(times, own, other, times is times_r, sums)
    yield from _partials(sums, left, right)
    yield _rows("term", [left.names[k] for k in best.group.tolist()], [t.decode() for t in best.term.tolist()], best.value)


def kept_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, leaves: int = LEAVES) -> tuple[DataFrame, DataFrame]:
    """Written tables: the kept terms (lang, term, docs, sources, counts) in ranges of byte order, and the groups (lang, source) that occur."""
    own = docs.select(text_col, lang_col, source_col)
    counted = materialize(own.mapInArrow(lambda it: _count(it, leaves), _COUNTED), "counted")
    terms = counted.filter("term != ''")
    ranges = max(-(-terms.count() // leaves), min(64, docs.sparkSession.sparkContext.defaultParallelism))
    merged = terms.repartitionByRange(ranges, "lang", "term").mapInArrow(lambda it: _merge(it, least), _COUNTED)
    groups = counted.filter("term = ''").select("lang", F.explode("sources").alias("source")).distinct()
    return materialize(merged, "terms"), materialize(groups, "groups")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, top: int = TOP, leaves: int = LEAVES, sources: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value and rank: part ``pair`` has every other source of the language, part ``term`` the ``top`` terms that stand out."""
    context = docs.sparkSession.sparkContext
    terms, groups = kept_terms(docs, lang_col, source_col, text_col, least, leaves)
    entries = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", F.col("e.sources").alias("source"), F.col("e.counts").alias("n"))
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    stats = groups.join(own, ["lang", "source"], "left").join(kept, "lang", "left").withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang")))
    stats = materialize(stats.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "lang_n"))), "stats")
    blocks, block = 1, lambda k: F.pmod(F.xxhash64("lang", "source"), F.lit(k))
    while (stats.groupBy(block(blocks)).count().agg(F.max("count")).first()[0] or 0) > sources:
        blocks *= 2
    figures = None
    for i in range(blocks):
        left = context.broadcast(_Stats(stats.filter(block(blocks) == i).collect()))
        for j in range(blocks):
            right = left if i == j else context.broadcast(_Stats(stats.filter(block(blocks) == j).collect()))
            part = terms.select("lang", "term", "sources", "counts").mapInArrow(lambda it, left=left, right=right, top=top * (i == j): _traverse(it, left.value, right.value, top), _FIGURES)
            part = materialize(part, "figures")
            figures = part if figures is None else figures.unionByName(part)
    # what two sources make of a term that neither has, as often as there are terms
    one = stats.select("lang", "source", "v", F.expr("if(v = 0, 1, 1 + 1000000000 div (n + v))").alias("p"))
    pairs = one.join(one.select("lang", F.col("source").alias("item"), F.col("p").alias("q")), "lang").filter("source != item")
    sums = figures.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("s"))
    value = F.coalesce("s", F.lit(0)).cast("decimal(38,0)") + (F.col("v") * F.expr("((p - q) * (p - q)) div q")).cast("decimal(20,0)")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = figures.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
words AS (SELECT d, lang, source, translate(unnest(ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_c FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
grp AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v, sum(lang_c) AS lang_n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
own AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source),
every AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000 * (CAST(coalesce(c, 0) AS HUGEINT) + 1) // (coalesce(n, 0) + v) AS p, 1 + 1000000000 * (CAST(lang_c AS HUGEINT) + 1) // (lang_n + v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source != b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM every WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 200
"""
