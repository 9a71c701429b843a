"""Kneser-Ney against a plain loop, the worker contract, and the index of constraints against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scriptmend.operators import candidates as C
from scriptmend.operators import constraints, fusion, metrics, scorers


def drawn_pairs(seed=1, n=400):
    rng = random.Random(seed)
    words = ["the", "of", "a", "cat", "dog", "é", "sat", "ran", "on", "mat"]
    return [(rng.choice(words[: rng.randrange(1, 10)]), rng.choice(words[rng.randrange(0, 9) :])) for _ in range(n)]


def plain_kneser_ney(pairs):
    n = Counter(pairs)
    once, twice = (sum(v == k for v in n.values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once else 0.75
    total, kinds, before = Counter(), Counter(), Counter()
    for (u, w), k in n.items():
        total[u] += k
        kinds[u] += 1
        before[w] += 1

    def p(u, w):
        low = (before[w] + 0.5) / (len(n) + (len(before) + 1) / 2)
        return low if not total[u] else max(n[u, w] - d, 0) / total[u] + d * kinds[u] / total[u] * low

    return p, n, before


def test_kneser_ney_is_a_plain_loop(spark):
    pairs = drawn_pairs()
    p, n, before = plain_kneser_ney(pairs)
    model = scorers.KneserNey(spark.createDataFrame(pairs, "w1 string, w2 string"), pool=3)
    words = sorted({w for x in pairs for w in x}) + ["never", "seen"]
    asked = spark.createDataFrame([(u, w) for u in words for w in words], "w1 string, w2 string")
    got = {(r.w1, r.w2): r.lp for r in model.probabilities(asked.union(asked)).collect()}
    assert len(got) == len(words) ** 2
    assert all(math.isclose(lp, math.log(p(u, w)), rel_tol=1e-12) for (u, w), lp in got.items())
    # a distribution: what words with a word before them get, and one unseen word
    for u in ("the", "never"):
        assert math.isclose(sum(p(u, w) for w in before) + p(u, "unseen"), 1.0, rel_tol=1e-9)


def test_two_sided_candidates(spark):
    pairs = drawn_pairs(2)
    p, n, _ = plain_kneser_ney(pairs)
    cases = [(1, "the", "sat"), (2, "never", "mat"), (3, "the", None), (4, "never", "seen"), (5, "the", "sat")]
    table = spark.createDataFrame(cases, "case_id long, lw string, rw string")
    model = scorers.KneserNey(spark.createDataFrame(pairs, "w1 string, w2 string"), pool=3)
    want = []
    for case, lw, rw in cases:
        pool = {w for w, _ in sorted(((w, k) for (u, w), k in n.items() if u == lw), key=lambda x: (-x[1], x[0]))[:3]}
        pool |= {u for u, _ in sorted(((u, k) for (u, w), k in n.items() if w == rw), key=lambda x: (-x[1], x[0]))[:3]}
        unseen = math.log(p("never", "unseen"))
        scored = [(round(math.log(p(lw, c)) + (math.log(p(c, rw)) if rw else unseen), 6), c) for c in pool]
        want += [(case, c, s, k) for k, (s, c) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:4])]
    assert sorted(tuple(r) for r in model.candidates(table, 4).collect()) == sorted(want)


class Fixed:
    """A model that says who it is."""

    def __init__(self):
        import uuid

        self.me = uuid.uuid4().hex

    def score(self, frame, k):
        import os

        import pandas as pd

        return pd.DataFrame([(c, x, s) for c, lw in zip(frame.case_id, frame.lw, strict=True) for x, s in ((f"{os.getpid()}:{self.me}", -1.0), (lw, -0.5))], columns=["case_id", "candidate", "score"])


def test_a_worker_makes_its_model_once(spark):
    cases = spark.range(200).select(F.col("id").alias("case_id"), F.lit("x").alias("lw"), F.lit("y").alias("rw")).repartition(12)
    scorer = scorers.Worker("fixed-test", lambda: __import__("tests.test_scorers", fromlist=["Fixed"]).Fixed())
    rows = scorer.candidates(cases, 2).collect()
    made = defaultdict(set)
    for r in rows:
        if ":" in r.candidate:
            pid, me = r.candidate.split(":")
            made[pid].add(me)
    assert len(rows) == 400 and all(len(m) == 1 for m in made.values())
    assert {(r.candidate, r["rank"]) for r in rows if ":" not in r.candidate} == {("x", 0)}


@pytest.mark.parametrize("kind", ["neighbours", "kneser_ney", "worker"])
def test_metrics_and_beams_run_on_any_scorer(spark, kind):
    pairs = spark.createDataFrame(drawn_pairs(3), "w1 string, w2 string")
    scorer = {"neighbours": lambda: scorers.Neighbours(pairs), "kneser_ney": lambda: scorers.KneserNey(pairs), "worker": lambda: scorers.Worker("fixed-any", lambda: __import__("tests.test_scorers", fromlist=["Fixed"]).Fixed())}[kind]()
    cases = spark.createDataFrame([(1, "the", "sat", "cat"), (2, "of", "mat", "zebra")], "case_id long, lw string, rw string, gold string")
    found = metrics.summary(fusion.gold_ranks(scorer.candidates(cases, 5), cases), []).collect()
    assert found[0].n == 2 and found[0].top20 <= 50
    beams = C.beam(cases, scorer.model(cases.select(F.col("lw").alias("w1")), 5), "case_id", 1, 2, repeat=True).collect()
    assert {r.case_id for r in beams} == {1, 2} and all(r.score <= 0 for r in beams)


def brute_fit(word, segments, left, right, estimate, tolerance):
    if abs(len(word) - estimate) > tolerance or not segments and (left or right):
        return False
    return (not left or word.startswith(segments[0])) and (not right or word.endswith(segments[-1])) and bool(re.search(".*".join(segments), word))


@pytest.mark.parametrize("tolerance", [0, 1, 2])
def test_constraint_index(spark, tolerance):
    rng = random.Random(tolerance)
    words = sorted({"".join(rng.choices("abé", k=rng.randrange(1, 7))) for _ in range(150)}) + ["b" * 5000]
    targets = [(k, ["".join(rng.choices("abéx", weights=[5, 5, 5, 1], k=rng.randrange(1, 4))) for _ in range(rng.randrange(0, 3))], rng.random() < 0.5, rng.random() < 0.5, rng.randrange(0, 7)) for k in range(120)]
    targets += [(900, *targets[3][1:]), (901, ["b"], True, True, 5000)]
    got = constraints.constrained_pairs(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(targets, "target int, segments array<string>, anchored_left boolean, anchored_right boolean, estimate int"), tolerance)
    assert sorted(tuple(r) for r in got.collect()) == sorted((t, w) for t, *c in targets for w in words if brute_fit(w, *c, tolerance))


def test_rare_letters_choose_the_posting(spark):
    # many words share length, first and last letter, one has the letters asked for
    words = [f"a{'bcdefgh'[k % 7]}{'bcdefgh'[k // 7 % 7]}{'bcdefgh'[k // 49 % 7]}z" for k in range(343)] + ["aqbbz"]
    target = spark.createDataFrame([(1, ["aq", "z"], True, True, 5)], "target int, segments array<string>, anchored_left boolean, anchored_right boolean, estimate int")
    got = constraints.constrained_pairs(spark.createDataFrame([(w,) for w in words], "word string"), target, 0)
    assert [tuple(r) for r in got.collect()] == [(1, "aqbbz")]


def test_reasons(spark):
    rows = spark.createDataFrame([(False, False, ["a"], 3), (True, True, ["a"], 3), (True, False, [], 3), (True, False, ["a"], 1), (True, False, ["a"], 3)], "gap boolean, markup boolean, visible array<string>, estimate int")
    got = [r[0] for r in rows.select(constraints.constraint_reason(F.col("gap"), F.col("markup"), F.col("visible"), F.col("estimate"))).collect()]
    assert got == ["not_a_lacuna", "unsupported_target_markup", "no_visible_hebrew", "target_too_short", "eligible"]
    readings = spark.createDataFrame([("אב גד", True), ("א/ב", True), ("א○ב", True), ("א", True), ("אבג", False), ("אבג", True)], "r string, fits boolean")
    said = [r[0] for r in readings.select(constraints.reading_reason(F.col("r"), F.col("fits"))).collect()]
    assert said == ["multiword_reading", "correction_or_alternative_markup", "incomplete_reading", "reading_too_short", "contradicts_physical_constraint", "eligible"]
