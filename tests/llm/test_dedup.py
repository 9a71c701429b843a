"""Substring and near-duplicate removal against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from pyspark.sql import functions as F

from scriptmend.llm import near_dup as nd
from scriptmend.llm import substring_dedup as sd
from scriptmend.llm import suffixes as sx

from ..conftest import SMALL


def brute_repeats(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_blocks_sort_suffixes():
    rng = random.Random(3)
    raw = bytes(rng.choice(b"ab") for _ in range(3000)) + b"ab" * 200
    text = np.frombuffer(raw + bytes(sx.DEPTH + 2 * sx.PERIOD), np.uint8)
    at = np.arange(len(raw) - 60)
    order = np.concatenate(list(sx.Cover(text).sorted_blocks(at, block=400)))
    keys = [bytes(text[p : p + sx.DEPTH]) for p in order]
    assert sorted(order.tolist()) == at.tolist() and keys == sorted(keys)
    runs = sx.equal_runs(sx.words(text), order, 50)
    assert all((runs[k] == runs[k - 1]) == (keys[k][:50] == keys[k - 1][:50]) for k in range(1, len(keys)))


def test_remove_repeats(spark):
    rng = random.Random(2)
    parts = ["ab", "cé", "da", "e", "fu", " ", "x"]
    base = ["".join(rng.choice(parts) for _ in range(200)) for _ in range(6)]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            a = rng.randint(0, len(b) - 1)
            text += b[a : a + rng.randint(20, 200)] + "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        rows.append((i * 3 % 121, text))
    rows += [(500, "a" * 300), (501, "a" * 120), (502, "ab" * 90), (503, "ab" * 90), (504, ""), (505, None), (506, "a" * 50), (507, "q" * 49)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, start int").repartition(5)
    assert {r.doc_id: tuple(r)[1:5] for r in sd.remove_repeats(df).collect()} == brute_repeats(rows)
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = "z" * 10 + "some words that are long enough to be fifty bytes or more"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in sd.remove_repeats(df).collect())
    assert got == [(-1, 0), (1, 0), (1, 0), (2, len(text))]


def test_unlike_texts_of_one_id_are_judged_each(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c = word(400), word(156), word(300)
    rows = [(1, a), (2, "zz" + a), (2, b), (2, b), (3, b + c), (3, c), (4, None), (4, a[100:260] + c), (None, a), (5, "short"), (5, a[:49])]
    want = []
    for n, (i, t) in enumerate(rows):
        before = [r for r in rows if i is not None and r[0] is not None and r[0] < i]
        want.append((i, *brute_repeats([*before, (i, t)])[i]) if i is not None else (None, len(t), 0, 0, hashlib.sha256(t.encode()).hexdigest()))
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").withColumn("__sm_number", F.lit(7)).repartition(5)
        got = [tuple(r)[:5] for r in sd.remove_repeats(df).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    removed = {(r[0], r[1]): r[2] for r in want}
    assert removed[2, 402] == 400 and removed[2, 156] == 0 and removed[3, 456] == 156 and removed[3, 300] == 0


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(700))) for i in range(4)]
    rows.append((9, rows[1][1][100:400] + rows[0][1]))
    monkeypatch.setattr(sd, "PIECE", 128)
    values = [t.encode() for _, t in rows]
    seen = set()
    for text, ends, owner, begin in sd.pieces(values):
        m, first, count, piece = sd.runs(text, ends)
        base = np.append(0, ends)
        for a, n, p in zip(first, count, piece, strict=True):
            for k in range(n):
                at = int(a + k - base[p] + begin[p])
                seen.add((int(owner[p]), at))
                assert bytes(text[a + k : a + k + 50]) == values[owner[p]][at : at + 50]
    assert seen == {(i, k) for i, v in enumerate(values) for k in range(len(v) - 49)}


def brute_classes(rows, weights, threshold=0.8):
    vectors = {rows[i][0]: (g, weights.of(g, t)) for i, g, t in nd.shingles([t for _, t in rows])}
    top = {i: i for i, _ in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = [i for i, _ in rows]
    text = dict(rows)
    for a in ids:
        for b in ids:
            if a < b and ((text[a] or "") == (text[b] or "") or nd.similarity(vectors[a], vectors[b]) >= threshold):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_classes(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for g in range(12):
        ws = [word() for _ in range(120)]
        for c in range(rng.randint(1, 6)):
            own = list(ws)
            for _ in range(c % 3):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows) * 7 % 997, " ".join(own)))
    rows += [(5001, ""), (5002, None), (5003, "one two three"), (5004, "one two three"), (5005, " ".join(["at"] * 200)), (5006, " ".join(["at"] * 201))]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, band string").repartition(4)
    counts, n = nd.document_frequencies(nd.texts(df))
    assert n == len(rows)
    got = {r.doc_id: r.class_id for r in nd.classes(df).collect()}
    assert got == brute_classes(rows, nd.Weights(counts, n))
    # repeated rows count in the document frequencies
    more = spark.createDataFrame([*df.collect(), *df.limit(3).collect()], df.schema)
    again = {r.doc_id: r.class_id for r in nd.classes(more).collect()}
    counts, n = nd.document_frequencies(nd.texts(more))
    assert n == len(rows) + 3 and again == brute_classes(rows, nd.Weights(counts, n))
    assert sorted(r.doc_id for r in nd.keep_one(more).collect()) == sorted(set(again.values()))
    assert nd.classes(df.limit(0)).count() == 0


def test_hot_line_and_large_group(spark):
    """A line that most texts repeat, a large group of near copies with texts that hang by one link, and exact copies."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = " ".join(word() for _ in range(12))
    base = [word() for _ in range(80)]
    rows = [(i, f"{line}\n" * (i % 9 + 1) + " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(220)]
    for i in range(180):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = word()
        rows.append((1000 + i, " ".join(own)))
    rows += [(3000 + i, " ".join(base)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    counts, n = nd.document_frequencies(nd.texts(df))
    want = brute_classes(rows, nd.Weights(counts, n))
    found = nd.classes(df).collect()
    assert {r.doc_id: r.class_id for r in found} == want
    assert all(r.rep_id == 1000 + min(i for i in range(180) if rows[220 + i][1] == rows[-1][1]) if r.doc_id >= 3000 and any(x[1] == rows[-1][1] for x in rows[220:400]) else True for r in found)
    assert all((r.n_links > 0) == (sum(w == want[r.doc_id] for i, w in want.items() if dict(rows)[i] != dict(rows)[r.doc_id]) > 0) for r in found)


def test_texts_that_have_not_enough_in_common(spark, monkeypatch):
    """Texts that each changed more of a common one than a link allows don't meet all that changed little, and no link is lost."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = [(i, " ".join([*base, word()])) for i in range(100)]
    for i in range(100, 180):
        own = list(base)
        for k in range(3):
            own[10 + 45 * k + rng.randrange(20)] = word()
        rows.append((i, " ".join(own)))
    rows += [(200 + k, rows[100 + k][1] + " and more") for k in range(0, 60, 6)]
    held = []
    kept = nd._Pairs.links
    monkeypatch.setattr(nd._Pairs, "links", lambda self, close: (held.append(self), kept(self, close))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counts, n = nd.document_frequencies(nd.texts(df))
    want = brute_classes(rows, nd.Weights(counts, n))
    assert {r.doc_id: r.class_id for r in nd.classes(df).collect()} == want
    assert len(set(want.values())) == 81 and all(want[200 + k] == 100 + k for k in range(0, 60, 6))
    assert held[-1].known.read().count() < 6 * len(rows)


def test_rare_and_common(spark):
    """Every link shares a rare shingle, or lies between texts whose common shingles suffice for it."""
    rng = random.Random(13)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(60)] = f"x{rng.randrange(12)}"
        rows.append((i, " ".join(own + own[: rng.choice((0, 0, 9))])))
    rows += [(90, ""), (91, "one two"), (92, "l m n o p q r"), (93, "l m n o p q s")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    weights = nd.Weights(*nd.document_frequencies(df))
    vectors = {rows[i][0]: (g, weights.of(g, t)) for i, g, t in nd.shingles([t for _, t in rows])}
    for threshold in (0.3, 0.8):
        pairs, shares = nd.rare_and_common(df, spark.sparkContext.broadcast(weights), threshold)
        pairs, shares = {tuple(r) for r in pairs.collect()}, {r.doc_id: r for r in shares.collect()}
        holders = {}
        for i, (g, _) in vectors.items():
            for x in g.tolist():
                holders.setdefault(x, []).append(i)
        assert pairs == {(a, b) for h in holders.values() if len(h) <= nd.FEW for a in h for b in h if a < b}
        for a in vectors:
            for b in vectors:
                if a < b and (a, b) not in pairs and (s := nd.similarity(vectors[a], vectors[b])) >= threshold:
                    m = min(shares[a].common, shares[b].common)
                    assert m / (shares[a].total + shares[b].total - m) >= s - 1e-6


def test_long_text_and_clashing_ids(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(70_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:60_000], "new", *words[60_000:]])), (3, "a b c d e f g"), (3, "h i j k l m n"), (4, "h i j k l m n"), (None, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id) for r in nd.classes(df).collect())
    assert got == [(0, None), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3)]
    # both texts of id 3 stay: one was lost before
    assert nd.keep_one(df).count() == 4


def test_unlike_texts_under_one_id(spark):
    say = lambda seed, n=40: " ".join(f"w{seed}x{k}" for k in range(n))
    a, b, c = say(1), say(2), say(3)
    rows = [(1, a, "A"), (1, b, "B"), (2, c, "C"), (3, b + " end", "B2"), (4, a, "A2"), (1, a, "A"), (5, None, "N"), (None, a, "Z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(3)
    for table in (df, df.orderBy(F.desc("class_id"))):
        kept = sorted((tuple(r) for r in nd.keep_one(table).collect()), key=repr)
        # B and its near copy 3 are one class, of which the smaller id stays; A and its copies another
        assert kept == sorted([(1, a, "A"), (1, b, "B"), (2, c, "C"), (5, None, "N"), (None, a, "Z")], key=repr)
    got = sorted(((r.doc_id, r.class_id, r.rep_id, r.n_links) for r in nd.classes(df).collect()), key=repr)
    assert got == sorted([(1, 1, 1, 0), (1, 1, 1, 1), (2, 2, 2, 0), (3, 1, 3, 1), (4, 1, 1, 0), (1, 1, 1, 0), (5, 5, 5, 0), (None, None, None, 0)], key=repr)


def test_repeated_rows_that_differ_elsewhere(spark):
    df = spark.createDataFrame([(1, "a b c d e f", x) for x in "pqrst"] + [(2, "other words of some length here", "u")], "doc_id long, text string, more string")
    first = sorted(tuple(r) for r in nd.keep_one(df.repartition(3)).collect())
    assert len(first) == 2 and first == sorted(tuple(r) for r in nd.keep_one(df.orderBy("more").coalesce(1)).collect())


def test_recall_on_documents(spark):
    """Links of all pairs of the 0.01 table that classes join: at least 0.9, by inverted lists of all shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    counts, n = nd.document_frequencies(nd.texts(docs))
    weights = nd.Weights(counts, n)
    ids = sorted(rows)
    vectors = [(g, weights.of(g, t)) for _, g, t in nd.shingles([rows[i] for i in ids])]
    posts: dict[int, list[int]] = {}
    for k, (g, _) in enumerate(vectors):
        for x in g.tolist():
            posts.setdefault(x, []).append(k)
    pairs = {(a, b) for p in posts.values() for j, b in enumerate(p) for a in p[:j]}
    links = [(ids[a], ids[b]) for a, b in pairs if rows[ids[a]] != rows[ids[b]] and nd.similarity(vectors[a], vectors[b]) >= nd.SIMILARITY]
    cls = {r.doc_id: r.class_id for r in nd.classes(docs).collect()}
    recall = sum(cls[a] == cls[b] for a, b in links) / len(links)
    print("links", len(links), "recall", recall)
    assert links and recall >= 0.9


def test_small_documents_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts, n = nd.document_frequencies(nd.texts(docs))
    assert {r.doc_id: r.class_id for r in nd.classes(docs).collect()} == brute_classes(rows, nd.Weights(counts, n))
    assert {r.doc_id: tuple(r)[1:5] for r in sd.remove_repeats(docs).collect()} == brute_repeats(rows)


def test_samples_estimate_similarity():
    rng = np.random.default_rng(1)
    grams = np.sort(rng.integers(1, 1 << 63, 600, dtype=np.uint64))
    a, b = (grams[:500], np.ones(500)), (grams[100:], np.ones(500))
    sampler = nd.Sampler(2000)
    x, y = (sampler.samples(g, w, np.array([0, len(g)]))[0] for g, w in (a, b))
    assert abs((x == y).mean() - nd.similarity(a, b)) < 0.05


def test_dense_ranks():
    rng = np.random.default_rng(9)
    for n, top in ((0, 1), (1, 1), (2, 1), (500, 3), (500, 40), (5000, 1 << 62)):
        high, low = rng.integers(0, top, n).astype(np.uint64) * np.uint64(3), rng.integers(-top, top, n)
        ranks, order = sx.dense(high, low)
        pairs = list(zip(high.tolist(), low.tolist(), strict=True))
        place = {pair: k + 1 for k, pair in enumerate(sorted(set(pairs)))}
        assert ranks.tolist() == [place[pair] for pair in pairs]
        assert sorted(order.tolist()) == list(range(n)) and [pairs[k] for k in order] == sorted(pairs)
