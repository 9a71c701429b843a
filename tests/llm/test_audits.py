"""Divergence, decontamination and alignment against plain Python, on drawn and odd tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptmend.llm import alignment, decontamination, divergence, tries, words

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL_LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, key=repr):
    return sorted((tuple(r) for r in df.collect()), key=key)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbZ09 .é漢\n"), max_size=12), max_size=6), st.integers(1, 12))
def test_words(texts, lot):
    array = pa.array(["x", *texts], pa.string()).slice(1)
    for wanted, pattern in ((words.LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), (words.ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        got = []
        for at, part in words.lots(array, lot):
            found = words.words_of(part, wanted)
            raw = [x.encode() for x in part.to_pylist()]
            for w, k, a, b in zip(found.words.to_pylist(), found.text, found.start, found.end, strict=True):
                got.append((at + k, w))
                assert raw[k][a - found.begins[k] : b - found.begins[k]].decode().translate(SMALL_LETTERS) == w
        assert got == [(k, w.translate(SMALL_LETTERS)) for k, t in enumerate(texts) for w in re.findall(pattern, t)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=5)))
def test_trie(keys):
    trie = tries.Trie()
    given_numbers = {k: trie.leaf(k) for k in keys}
    assert all(trie.leaf(k) == n for k, n in given_numbers.items())
    assert list(trie.leaves()) == sorted(given_numbers.items())


def test_smoothed_is_exact():
    rng = random.Random(5)
    for _ in range(300):
        total = rng.randrange(1, 9 * 10**15)
        count = rng.randrange(0, total)
        assert divergence.smoothed(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total


def brute_audit(rows, least, top):
    docs = [(x or "", y or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(SMALL_LETTERS))) for t, x, y in rows]
    df, groups, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, ws in docs:
        df[lang].update(set(ws))
        groups[lang, source].update(ws)
    for lang in {x for x, _ in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}
        own = {s: share(c) for (x, s), c in groups.items() if x == lang}
        whole = share(sum((c for (x, _), c in groups.items() if x == lang), Counter()))
        for s, p in own.items():
            pairs = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o) for o, q in own.items() if o != s]
            terms = [((p[t] - whole[t]) ** 2 // whole[t], t) for t in kept if groups[lang, s][t] and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(ranked, 1)]
    return sorted(out, key=repr)


def audit_rows(n, seed):
    rng = random.Random(seed)
    vocabulary = [*"abcdefgh", "é", "Zeta", "zeta", "ab", "abc", "漢字", "ééa"]
    return [(rng.choice([None, "", " ".join(rng.choices(vocabulary, k=rng.randrange(40)))]) if rng.random() < 0.2 else " ".join(rng.choices(vocabulary, k=rng.randrange(40))), rng.choice(["x", "y", None]), rng.choice(["s1", "s2", "s3", "", None])) for _ in range(n)] + [("lone", "z", "only"), (None, "w", "nothing"), ("1 2", "w", "digits")]


@pytest.mark.parametrize(("leaves", "sources", "least", "top"), [(divergence.LEAVES, divergence.SOURCES, 3, 200), (40, 9, 2, 3)])
def test_audit(spark, leaves, sources, least, top):
    rows = audit_rows(150, top)
    # columns of other use, with names of results
    docs = spark.createDataFrame([(*r, 7, "v", k) for k, r in enumerate([*rows, *rows[:20]])], "text string, lang string, source string, rank int, value string, term int").repartition(3)
    got = divergence.audit(docs, least=least, top=top, leaves=leaves, sources=sources)
    assert rows_of(got.select("lang", "source", "part", "item", "value", "rank")) == brute_audit([*rows, *rows[:20]], least, top)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_audit_of_a_long_text(spark):
    rows = [("word " * 400_000 + "wordé", "x", "a"), ("word", "x", "b"), ("word wordé", "x", "b"), ("other", "x", "b")]
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert rows_of(got.select("lang", "source", "part", "item", "value", "rank")) == brute_audit(rows, 3, 200)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL_LETTERS))


def brute_hits(docs, items, n=10):
    windows = defaultdict(set)
    for name, text in items:
        ws = plain_words(text)
        for k in range(max(1, len(ws) - n + 1) if ws else 0):
            windows[tuple(ws[k : k + n])].add(name or "")
    out = []
    for doc_id, text in docs:
        ws, hit, named = plain_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(ws) - size + 1):
                if found := windows.get(tuple(ws[k : k + size])):
                    hit.update(range(k, k + size))
                    named |= found
        out.append((doc_id, len(ws), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def drawn_items(seed):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(["to", "be", "Or", "not", "é9", "x-y"]) for _ in range(k))
    items = [(str(k) if k % 7 else None, say(rng.choice([0, 1, 3, 9, 10, 11, 30]))) for k in range(25)] + [("4", say(12)), (None, None), ("11", "漢字 " * 12), ("12", "漢字 " * 14)]
    docs = [(k, " ".join([say(rng.randrange(30)), rng.choice(items)[1] or "", say(rng.randrange(5))])) for k in range(60)]
    return items, [*docs, *docs[:5], (None, "to be or"), (90, None), (91, ""), (92, "...!"), (93, "漢字, " * 30_000 + "TO BE")]


@pytest.mark.parametrize("block_words", [decontamination.BLOCK_WORDS, 200])
def test_decontamination(spark, block_words):
    items, docs = drawn_items(block_words)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    table = spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id long, text string, n_hit int, item string").repartition(3)
    assert rows_of(decontamination.report(table, benchmark, block_words=block_words)) == brute_hits(docs, items)


def test_spans_and_documents_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before. {item.upper()}! After {item}", "a"), (2, "clean, with one two three", "b"), (3, None, None)], "doc_id long, text string, lang string")
    benchmark = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert rows_of(decontamination.remove(docs, benchmark)) == [(1, "Before. ! After ", "a"), (2, "clean, with one two three", "b"), (3, None, None)]
    assert rows_of(decontamination.remove(docs, benchmark, whole=True)) == [(2, "clean, with one two three", "b"), (3, None, None)]
    assert rows_of(decontamination.remove(docs, benchmark.limit(0))) == rows_of(docs)
    assert decontamination.report(docs.limit(0), benchmark).collect() == []


def brute_alignment(rows):
    """Token by token, from the libraries' results on whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    a_bytes, b_bytes = (lambda p: (p.a_bytes, p.b_bytes))(alignment.Pair(A, B))
    made, held = [], Counter()
    for doc_id, text in rows:
        a, b = (tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        ends = [np.cumsum([len(t[x]) for x in ids]).tolist() for ids, t in ((a, a_bytes), (b, b_bytes))]
        if not text or any(b"".join(t[x] for x in ids) != (" " + text).encode() for ids, t in ((a, a_bytes), (b, b_bytes))):
            made.append((doc_id, None))
            continue
        links, k = [], 0
        for i, x in enumerate(a):
            start = ends[0][i - 1] if i else 0
            while ends[1][k] <= start:
                k += 1
            links += [(x, b[m]) for m in range(k, min(len(b), k + 400)) if m == k or ends[1][m - 1] < ends[0][i]]
        groups, at, bt = [], 0, 0
        for end in sorted({*ends[0]} & {*ends[1]}):
            to, bto = ends[0].index(end, at) + 1, ends[1].index(end, bt) + 1
            groups.append(",".join(map(str, a[at:to])) + "|" + ",".join(map(str, b[bt:bto])))
            at, bt = to, bto
        held.update(set(links))
        made.append((doc_id, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted(((i, 0, 0, 0, 0, 0, 0, "") if m is None else (i, *m[:3], len(m[3]), sum(held[x] == best[x[0]] for x in m[3]), sum(held[x] for x in m[3]), m[4]) for i, m in made), key=repr)


ODD = [None, "", " ", "  ", "a", " a ", "\n", "a\n b", "a \n b", "a\r\n\r\n  b", "<s> </s> <unk>", "<|endoftext|>", "<0x41>", "▁", "a ▁b", "x  y", "　  a", "\x00 a\x1c b", "it's we'll  don't", "1 2\t3  \t 4 ", "漢字 かな é é", "🙂 👩‍👩‍👧", "a" * 5000, "ab,cd." * 2000, " " * 3000 + "x", "x " * 3000]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 50, 0])
def test_alignment(spark, frequent):
    rng = random.Random(3)
    drawn = ["".join(rng.choice([" ", " ", "a", "b", "the", "é", "\n", ".", "\t", "9", "字", "'s"]) for _ in range(rng.randrange(120))) for _ in range(80)]
    rows = [*enumerate([*ODD, *drawn, *drawn[:10]]), (None, "the end"), (5, "the end"), (5, "the end")]
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, row int, pairs string").repartition(3)
    assert rows_of(alignment.report(docs, A, B, frequent=frequent)) == brute_alignment(rows)


def test_alignment_of_nothing(spark):
    assert alignment.report(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_a_full_cache_changes_nothing():
    pair = alignment.Pair(A, B)
    assert pair.cut and not alignment.can_cut(["a▁b"])
    texts = [f"some word{k} and {'more ' * (k % 5)}" for k in range(60)]
    one = alignment.Aligner(pair).aligned(texts)
    small = alignment.Aligner(pair, most=20)
    for k, t in enumerate(texts):
        counts, digests, _, pairs, times = small.aligned([t])
        own = one[2] == k
        assert (counts[0] == one[0][k]).all() and digests[0] == one[1][k] and (pairs == one[3][own]).all() and (times == one[4][own]).all()


def test_repeated_runs_agree(spark):
    docs = spark.createDataFrame([(k, f"alpha beta {k % 3} gamma", "x", f"s{k % 4}") for k in range(40)], "doc_id long, text string, lang string, source string")
    assert rows_of(divergence.audit(docs.repartition(5))) == rows_of(divergence.audit(docs.orderBy(F.desc("doc_id"))))
