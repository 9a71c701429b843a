"""Quality, chat and mixing against SQL and plain Python; vectors against brute force; the pipeline."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptmend.llm import ann, chat, mixing, pii, quality
from scriptmend.llm import queries as Q

from ..conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        path = Path(SMALL, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, duck, name):
    df = Q.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    cursor = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(cols).collect()), key=repr) == want


def brute_quality(text):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    times = Counter(grams)
    twice = {i for i, g in enumerate(grams) if times[g] > 1}
    covered = {i + k for i in twice for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_edges(spark):
    texts = [None, "", " \t\n", "a b c d e", "a b c d e f a b c d e", "x " * 50, "l\nl\n \n\nl\nm", "é 漢 #| $ b", "w " * 30_000, "a b c d e a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2]
    df = spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(texts)] + [(3, texts[3], None, "clash")], "doc_id long, text string, source string, kept string")
    for r in quality.judge(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r.doc_id])
    assert quality.judge(df.limit(0)).count() == 0
    assert quality.keep_good(df).columns == df.columns


def test_bad_hosts_take_their_documents(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "short"
    rows = [(i, bad if i % 4 else good, "farm") for i in range(400)] + [(1000 + i, good if i % 20 else bad, f"h{i % 10}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.judge(df).filter("kept").collect()}
    assert kept == {i for i, t, s in rows if t == good and s != "farm"}


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <|end|>\n good"), (1, 1, "user", "\\l[INST]\\\n<|turn|>x\n"), (1, 2, "assistant", "a " * 700), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "assistant", "b < [c] \\n"), (2, 0, None, None), (3, 1, "user", "q"), (3, 1, "user", "q"), (4, None, "assistant", "漢字 🙂")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    windows = chat.format_windows(df, budget=64)
    assert windows.filter("conv_id = 1").count() > 1
    assert windows.filter(F.col("formatted").contains("[INST]")).count() == 0
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learnt = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def brute_windows(own, budget, history):
    """(own positions, repeated positions) of each window of a conversation's (role, tokens)."""
    first = next((k for k, (role, _) in enumerate(own) if role == "system"), None)
    kept = first if first is not None and own[first][1] <= budget // 2 else None
    room = budget - (own[kept][1] if kept is not None else 0)
    cost = [0 if k == kept else n for k, (_, n) in enumerate(own)]
    most = min(max(cost), room // 2)
    windows, begin, last = [], 0, None
    for k, n in enumerate(cost):
        at = (begin // (room - most), n > most)
        if at != last:
            windows.append(([], []))
        windows[-1][0].append(k)
        begin, last = begin + n, at
    for mine, again in windows:
        left = room - sum(cost[k] for k in mine)
        for k in range(mine[0] - 1, max(-1, mine[0] - 1 - history), -1):
            left -= cost[k]
            if left < 0:
                break
            if k != kept:
                again.append(k)
        if kept is not None and kept < mine[0]:
            again.append(kept)
    return windows


@pytest.mark.parametrize("budget", [24, 64, 512])
def test_windows_hold_the_budget(spark, budget):
    import random

    rng = random.Random(budget)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 25)):
            role = "system" if turn == conv % 4 else rng.choice(["user", "assistant"])
            rows.append((conv, turn, role, " ".join(["w"] * rng.choice([0, 3, 10, 30, 200, budget // 2, budget, 3 * budget]))))
    rows.append((100, 0, "user", "w " * 200_000))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = {}
    for r in chat.format_windows(df, budget=budget).collect():
        assert (r.n_tokens <= budget) or r.formatted.count(chat.TURN) == 1
        windows.setdefault(r.conv_id, []).append((r.window, r.formatted.count(chat.TURN), r.formatted.count(chat.AGAIN), r.n_tokens))
    for conv in {r[0] for r in rows}:
        own = [(role, len(text.split()) + 4) for c, _, role, text in rows if c == conv]
        want = brute_windows(own, budget, 2)
        assert [x[1:] for x in sorted(windows[conv])] == [(len(m), len(a), sum(own[k][1] for k in m + a)) for m, a in want]
    assert {r.n_over for r in chat.read_back(chat.format_windows(df, budget=budget), budget).collect()} == {0}


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    want, capped = share * sum(sizes.values()), {}
    while True:
        rest = want - sum(capped.values())
        free = [s for s in names if s not in capped]
        target = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return capped | target
        capped |= {s: most * sizes[s] for s in over}


def brute_taken(rows, targets, seed=17):
    """Words taken of each (doc_id, text, source): whole epochs, then documents of smallest key until they fill the rest."""
    by = {}
    for i, text, source in rows:
        words = len((text or "").split())
        far = abs(len(text or "") / max(words, 1) - 6.5)
        level = 4 if far <= 1.5 else 3 if far <= 3 else 2 if far <= 6 else 1
        u = (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by.setdefault(source, []).append((-math.log(u) / (level / 4), i, hashlib.md5((text or "").encode()).hexdigest(), words))
    out = []
    for source, own in by.items():
        size = sum(w for *_, w in own)
        epochs = targets[source] // size if size else 0
        rest, run = targets[source] - epochs * size, 0
        for _, i, tie, w in sorted(own):
            run += w
            out.append((i, tie, int(epochs * w + (w if w and run - w / 2 <= rest else 0))))
    return out


def test_drawn_documents(spark):
    rows = [(i, " ".join(["w" * (1 + i % 12)] * (1 + i % 23)), ["a", "b", None, "c"][i % 4]) for i in range(600)]
    rows += [(7, " ".join(["v"] * k), "a") for k in range(1, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_taken(rows, brute_targets(sizes))
    for parts in (1, 5):
        got = [(r.doc_id, r["size"], r.taken) for r in mixing.mix(df.repartition(parts)).collect()]
        words = {hashlib.md5(t.encode()).hexdigest(): len(t.split()) for _, t, _ in rows}
        assert sorted(got) == sorted((i, words[tie], n) for i, tie, n in want)
        mixed = {}
        for r in mixing.mixed(df.repartition(parts)).collect():
            key = (r.doc_id, hashlib.md5(r.text.encode()).hexdigest())
            mixed[key] = mixed.get(key, 0) + len(r.text.split())
        assert mixed == {(i, tie): n for i, tie, n in want if n}


def test_repeated_rows_in_the_mix(spark):
    rows = [(i // 3, "w " * (5 + i // 3 % 4), "s", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    assert mixing.mixed(df).count() == sum(r.taken // r["size"] for r in mixing.mix(df).collect())


@pytest.mark.parametrize("small", [True, False])
def test_mix(spark, small):
    if small:
        rows = [(i, " ".join(["w"] * (i % 7)), [None, "a", "b", "ß", "c"][i % 5], 1) for i in range(400)]
        rows += [rows[8]] * 2 + [(900, None, "empty", 1)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    else:
        df = spark.read.parquet(f"{SMALL}/documents.parquet")
    source = {r.doc_id: r.source for r in df.select("doc_id", "source").collect()}
    got = mixing.mix(df).collect()
    assert len(got) == df.count()
    sizes, taken, targets, largest = {}, {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        assert r.taken <= 2 * r["size"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        targets[s] = r.target
        largest[s] = max(largest.get(s, 0), r["size"])
    for s, t in brute_targets(sizes).items():
        assert math.isclose(t, targets[s], abs_tol=1e-6) and abs(taken[s] - t) <= largest[s] / 2 + 1e-6
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mixed(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(5000 + i, x[7].tolist(), "c") for i in range(40)] + [(9000, None, "c"), (9001, [0.0] * 16, "c"), (9002, [1.0, float("nan")] + [0.0] * 14, "c"), (9003, [None] + [1.0] * 15, "c"), (9004, [float("inf")] + [1.0] * 15, "c"), (8, x[8].tolist(), "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")
    asked = df.filter("vec_id % 50 = 0 or vec_id = 7")
    got = {}
    for r in ann.search(df, asked, visit=0.6, block=256).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.array([i for i in range(1500)] + [5000 + i for i in range(40)])
    all_x = np.concatenate([x, np.repeat(x[7:8], 40, 0)])
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        d = np.sqrt(((all_x - all_x[ids == q][0]) ** 2).sum(1))
        best = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        hits += len(set(best) & {v for _, v, _ in found})
        total += 10
        assert all(math.isclose(s, d[ids == v][0], abs_tol=1e-12) for _, v, s in found)
    assert hits / total >= 0.9
    assert [v for _, v, _ in sorted(got[7])] == [5000 + i for i in range(10)]
    assert ann.search(df.limit(0), asked).count() == 0


def test_recall_on_embeddings(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    found = {(r.query_id, r.vec_id) for r in Q.op7_inverted_multi_index(spark, SMALL).collect()}
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    hits = total = 0
    for k in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[k]) ** 2).sum(1))
        best = [int(ids[j]) for j in np.lexsort((ids, d)) if j != k][:10]
        hits, total = hits + sum((int(ids[k]), b) in found for b in best), total + 10
    assert hits / total >= 0.9


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stage = docs
    for name, f in P.STAGES[:-1]:
        before, stage = stage, f(spark, stage, SMALL)
        assert stage.columns == docs.columns, name
        if name == "quality rules":
            good = {r.doc_id for r in quality.judge(before).filter("kept").collect()}
            assert {r.doc_id for r in stage.collect()} == good
        if name == "personal data":
            assert pii.find_pii(stage).filter("n_email + n_card + n_phone > 0").count() == 0
        if name == "mixing":
            assert stage.count() == sum(r.taken // r["size"] for r in mixing.mix(before).filter("size > 0").collect())
    assert P.run(spark, SMALL).count() == stage.count()
