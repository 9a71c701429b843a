"""Fits, letters, tests of many hypotheses, masks, and what the site shows, by hand-made cases."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptmend.operators import augment, candidates, constraints, facets, fusion, metrics, shaping
from scriptmend.sources import files


def test_logistic_fit_minimises(spark):
    rng = random.Random(3)
    rows = [(x := rng.gauss(0, 1), z := rng.gauss(0, 2), rng.random() < 1 / (1 + math.exp(-(2 * x - z - 1)))) for _ in range(400)]
    weights, bias = fusion.logistic_fit(spark.createDataFrame(rows, "x double, z double, y boolean"), "y", ["x", "z"])
    a, y = np.array([[x, z, 1.0] for x, z, _ in rows]), np.array([float(r[2]) for r in rows])
    share = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, penalty = np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (share * p * (1 - p))[:, None]) + penalty, a.T @ (share * (p - y)) + penalty @ w)
    assert np.allclose([weights["x"], weights["z"], bias], w, atol=1e-4)
    with pytest.raises(ValueError, match="both labels"):
        fusion.logistic_fit(spark.createDataFrame([(1.0, True)], "x double, y boolean"), "y", ["x"])


def test_letter_spans_against_all_texts(spark):
    rng = random.Random(5)
    letters = "ab "
    model = {x: sorted(((y, round(-rng.random(), 6)) for y in letters), key=lambda p: -p[1]) for x in letters}
    scored = dict(((x, y), s) for x in letters for y, s in model[x])
    got = candidates.letter_spans(model, "a", 6, 10**6)
    for size in range(2, 7):
        texts = ["a" + "".join(t) for t in itertools.product(letters, repeat=size - 1)]
        texts = [t for t in texts if t[-1] != " " and "  " not in t]
        want = {t: sum(scored[p] for p in itertools.pairwise(t)) for t in texts}
        own = [(t, s) for t, s, n, _ in got if n == size]
        assert {t for t, _ in own} == set(want) and all(abs(want[t] - s) < 1e-4 for t, s in own)
        assert own == sorted(own, key=lambda b: (-b[1], b[0]))
    table = spark.createDataFrame([(x, y, s) for x in letters for y, s in model[x]], "w1 string, candidate string, score double")
    rows = candidates.unknown_letters(spark.createDataFrame([("k", "a"), ("n", None), ("e", ""), ("u", "ж")], "k string, first string"), table, "k", 6, 2).collect()
    assert [(r.candidate, r.score, r["size"], r["rank"]) for r in sorted(rows, key=lambda r: (r["size"], r["rank"]))] == candidates.letter_spans(model, "a", 6, 2) and {r.k for r in rows} == {"k"}


def test_letter_model_and_ranks(spark):
    counted = spark.createDataFrame([("ab", 3), ("b", 1), ("", 9)], "word string, n long")
    model = {(r.w1, r.candidate): r.score for r in candidates.letter_model(counted).collect()}
    assert set(model) == {(" ", "a"), (" ", "b"), ("a", "b"), ("b", " ")} and model[(" ", "a")] == round(math.log(0.75), 6) and model[("b", " ")] == 0.0
    golds = spark.createDataFrame([("ab",), ("ab",), ("ba",)], "gold string")
    row = candidates.letter_ranks(golds, candidates.char_model(counted.filter("word <> ''"))).first()
    # a or b after the start (one word each, equals by letter), b after a; a never follows b
    assert (row.letters, row.hit1, row.hit5) == (6, round(400 / 6, 4), round(500 / 6, 4))


def test_sign_tests_and_correction(spark):
    a = spark.createDataFrame([(i, 0 if i % 9 == 0 else None) for i in range(40)], "u int, gold_rank int")
    b = spark.createDataFrame([(i, 0) for i in range(40)], "u int, gold_rank int")
    units = spark.createDataFrame([(i, "even" if i % 2 == 0 else "odd") for i in range(39)] + [(39, "same")], "u int, k string")
    got = {r.k: r for r in metrics.sign_tests(a, b.withColumn("gold_rank", F.when(F.col("u") < 39, F.col("gold_rank"))), units, "u", "k").collect()}
    assert set(got) == {"even", "odd"} and got["even"].n == got["even"].gained == 17 and got["even"].p < 0.05
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "k string, p double")
    rows = {r.k: (r.holm, r.fdr) for r in metrics.corrected(tests, "k").collect()}
    assert rows == {"a": (0.04, 0.04), "c": (0.09, 0.053333), "b": (0.09, 0.053333), "d": (0.9, 0.9)}


def test_signal(spark):
    rows = [(True, True, 0, 0, True), (True, True, 3, 0, False), (True, False, 0, 1, False), (False, False, None, None, False), (True, True, None, None, False)]
    row = metrics.signal(spark.createDataFrame(rows, "has_passages boolean, gold_present boolean, before int, after int, supported boolean")).first()
    assert (row.cases, row.cases_with_passages, row.misses, row.gold_present_all, row.gold_present_miss) == (5, 4, 2, 3, 1)
    assert (row.baseline_top1, row.reranked_top1, row.improved_top1, row.hurt_top1, row.delta_cases, row.delta_pts) == (2, 2, 1, 1, 0, 0.0)
    assert (row.supported_top1, row.rerank_ceiling_top1, row.gold_present_miss_pct, row.baseline_top5_pct) == (1, 2, 50.0, 60.0)


def test_scatter_mask(spark):
    docs = spark.createDataFrame([(i, ["word", "x"] * 50) for i in range(40)], "k int, ws array<string>")
    out = augment.scatter_mask(docs, "k", ["one", "two"], 0.5, shortest=2).withColumn("ids", augment.label_ids(F.col("labels"), F.create_map(F.lit("word"), F.lit(7)))).collect()
    masked = [m for r in out for m, l in zip(r.masked, r.labels, strict=True) if l is not None]
    assert 900 < len(masked) < 1100 and set(masked) == {augment.MASK, "one", "two", "word"}
    assert 0.75 < masked.count(augment.MASK) / len(masked) < 0.85 and all(l is None and m == "x" for r in out for m, l, w in zip(r.masked, r.labels, r.ws, strict=True) if w == "x")
    assert all(i == (7 if l else augment.IGNORED) for r in out for i, l in zip(r.ids, r.labels, strict=True))
    with pytest.raises(ValueError, match="vocabulary"):
        augment.scatter_mask(docs, "k", [])


def test_orders(spark):
    rows = spark.createDataFrame([(1, "ב", 5), (2, "א", None), (3, "ג", 1), (4, "ג", 5)], "k int, w string, n int")
    order = lambda mode: [r.k for r in facets.sorted_cases(rows, mode, "n", "w", "k").collect()]
    assert order("rarity-asc") == [3, 1, 4, 2] and order("rarity-desc") == [1, 4, 3, 2] and order("alpha") == [2, 1, 3, 4] and order("") == [1, 2, 3, 4]
    assert [tuple(r) for r in facets.top_sources(rows, "w", 2).collect()] == [("ג", 2), ("א", 1)]
    assert [r.k for r in facets.worst_first(rows.withColumn("c", F.lit("x")), "c", "n", "w").collect()] == [2, 3, 1, 4]


def test_shapes(spark):
    rows = spark.createDataFrame([(1, "g", "a b c d"), (2, "g", ""), (3, "g", "e")], "k int, g string, t string").withColumn("ws", F.filter(F.split("t", " "), lambda w: w != ""))
    got = shaping.numbered(rows, "g", ["k"], F.col("t") != "").select("row_id", "case_name", shaping.segments(F.col("ws"), 3).alias("s")).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [(1, "case-1", ["a b c", "d"]), (3, "case-2", ["e"])]
    assert rows.filter("k = 2").select(shaping.segments(F.col("ws")).alias("s")).first().s == []
    shown = rows.filter("k < 3").select(shaping.shown_run(F.array(F.lit("l")), F.col("ws"), F.array(F.lit("r"))).alias("s")).collect()
    assert sorted(r.s for r in shown) == ["l ⟦...⟧ r", "l ⟦a b c d⟧ r"]
    assert [r.k for r in shaping.latest(rows, "k").collect()] == [3]
    assert rows.limit(1).select(shaping.position(F.array(F.lit("x"), F.lit("y"), F.lit("y")), F.lit("y")).alias("p")).first().p == 1


def test_site(spark, tmp_path):
    rows = spark.createDataFrame([(1, "א"), (2, None)], "k int, w string")
    files.write_site({"cases": rows, "spans": rows.limit(0)}, str(tmp_path))
    back = files.read_site(spark, str(tmp_path), {"cases": "k INT, w STRING", "spans": "k INT, w STRING"})
    assert sorted(map(tuple, spark.sql("SELECT * FROM cases").collect())) == [(1, "א"), (2, None)] and back["spans"].count() == 0
    text = files.report("T", {"one": rows.orderBy("k"), "none": rows.limit(0)}, {"one": "note"})
    assert text == "# T\n\n## one\n\nnote\n\n| k | w |\n| --- | --- |\n| 1 | א |\n| 2 |  |\n\n## none\n\n| k | w |\n| --- | --- |\n"
    (tmp_path / "guide.md").write_text("# a\nb\n")
    assert files.read_text(spark, str(tmp_path / "guide.md")).first().text == "# a\nb\n"
    (tmp_path / "manifest.json").write_text('{"seed": 0,\n "scroll_splits": {"dev": ["b"],\n "train": ["a", "c"]}}')
    assert sorted(map(tuple, files.split_manifest(spark, str(tmp_path / "manifest.json")).collect())) == [("a", "train"), ("b", "dev"), ("c", "train")]
    (tmp_path / "metrics.txt").write_text("sect:\n  all  1=2.5 2=3\nnonbib:\n  one  1=4\n")
    assert sorted(map(tuple, files.sectioned_metrics(spark, str(tmp_path / "metrics.txt")).collect())) == [("nonbib", "one", "1", 4.0), ("sect", "all", "1", 2.5), ("sect", "all", "2", 3.0)]
    got = rows.orderBy("k").select(files.link("https://x.org/", F.lit("a b"), F.col("k"), q=F.lit("c&d")).alias("u"), files.link("https://x.org", F.col("w")).alias("v")).collect()
    assert got[0].u == "https://x.org/a%20b/1?q=c%26d" and got[1].v is None


def test_regimes(spark):
    rows = [("ab c", ["U0", "U1", "P0", "P1"]), ("a bc", ["U0", "P0", "O1"]), ("abcd efgh", ["U0"]), ("abcd", ["U0", "P0"])]
    df = spark.createDataFrame(rows, "phrase string, want array<string>")
    got = df.filter(constraints.open_regimes(F.col("phrase"), F.lit("x yz"), F.lit("xy z")) != F.col("want"))
    assert got.count() == 0
