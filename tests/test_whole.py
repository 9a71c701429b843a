"""Whole results of queries that once cut their input first."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np

from scriptmend.operators import candidates, context, retrieval
from scriptmend.plans import catalog
from scriptmend.plans.base import BIGRAMS, CASES, DOCS, ITEMS, RANKING, hits

from .conftest import SMALL
from .test_catalog import plain


def same_as(spark, name, sql):
    """Asserts that a query's rows are those of ``sql``; returns them."""
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = catalog.queries()[name](spark, SMALL)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(names).collect()), key=repr) == want
    return [dict(zip(names, r, strict=True)) for r in want]


def brute_top(ids, x, asked, k=5):
    u = x / np.sqrt((x * x).sum(1))[:, None]
    out = set()
    for q in asked:
        score = np.round(u @ u[q], 6)
        near = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        out |= {(int(ids[q]), r + 1, int(ids[j]), round(float(score[j]), 5)) for r, j in enumerate(near)}
    return out


def test_every_vector_is_a_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 5)) for r in catalog.queries()["embedding_topk"](spark, SMALL).collect()}
    assert got == brute_top(ids, x, range(len(ids)))


def test_cosine_blocks_and_ties(spark):
    x = np.random.default_rng(1).normal(size=(90, 6))
    x[40:60] = x[3]
    ids = np.arange(90) * 7 % 97
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(500, [0.0] * 6), (501, None)], "vec_id long, embedding array<double>")
    want = brute_top(ids, x, range(90))
    for block in (16, 1000):
        got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 5)) for r in retrieval.cosine_top(df, df, block=block).collect()}
        assert got == want
    few = df.filter("vec_id < 3")
    assert retrieval.cosine_top(few, few).count() == few.count() * (few.count() - 1)
    assert retrieval.cosine_top(df.limit(0), df).count() == 0


# the model's whole list of each word, where RANKING keeps the 20 best
FITS = f"""WITH {DOCS}, {ITEMS}, {CASES}, {BIGRAMS}, n0 AS (SELECT w1, w2 AS candidate, count(*) AS n FROM bigrams WHERE w1 IN (SELECT lw FROM cases) GROUP BY ALL),
n1 AS (SELECT w1, candidate, round(ln(n / sum(n) OVER (PARTITION BY w1)), 6) AS score FROM n0),
f AS (SELECT t AS tolerance, case_id, candidate, gold, row_number() OVER (PARTITION BY t, case_id ORDER BY score DESC, candidate) - 1 AS rank FROM cases JOIN n1 ON lw = w1, (SELECT unnest([0, 1, 2]) AS t)
WHERE left(candidate, 1) = left(gold, 1) AND right(candidate, 1) = right(gold, 1) AND abs(length(candidate) - length(gold)) <= t)"""


def test_constraint_sees_the_whole_list(spark):
    rows = same_as(spark, "physical_constraint_filter", f"{FITS}, g AS (SELECT case_id, min(rank) FILTER (candidate = gold) AS gold_rank, count(*) AS n FROM f WHERE tolerance = 1 GROUP BY case_id) SELECT case_id, gold_rank, coalesce(n, 0) AS n_fit FROM cases LEFT JOIN g USING (case_id)")
    # a word beyond the 20 best of the model counts too
    cut = f"{RANKING}, r AS (SELECT case_id, min(rank) AS gold_rank FROM a JOIN cases USING (case_id) WHERE candidate = gold GROUP BY case_id) SELECT count(*) FROM r"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert sum(r["gold_rank"] is not None for r in rows) > con.execute(cut).fetchone()[0]


def test_tolerances_see_the_whole_list(spark):
    same_as(spark, "tolerance_sensitivity", f"{FITS}, h AS (SELECT tolerance, case_id, rank AS gold_rank FROM f WHERE candidate = gold), z AS (SELECT tolerance, case_id FROM (SELECT unnest([0, 1, 2]) AS tolerance), cases) SELECT tolerance, count(*) AS n, {hits()}, round(100.0 * count(gold_rank) / count(*), 4) AS coverage, median(gold_rank) AS median_rank, round(avg(coalesce(1.0 / (gold_rank + 1), 0)), 6) AS mrr FROM z LEFT JOIN h USING (tolerance, case_id) GROUP BY tolerance")


def test_context_index_is_whole(spark):
    sides = " UNION ALL ".join(f"SELECT array_to_string(ws[i + 1 - {a}:i], ' ') AS lctx, array_to_string(ws[i + 2:i + 1 + {b}], ' ') AS rctx, ws[i + 1] AS target FROM (SELECT ws, unnest(range({a}, len(ws) - {b})) AS i FROM docs WHERE len(ws) > {a + b})" for a in range(3) for b in range(3) if a + b)
    same_as(spark, "context_index_two_sided", f"WITH {DOCS}, k AS ({sides}) SELECT lctx, rctx, target, count(*) AS n FROM k GROUP BY ALL ORDER BY n DESC, lctx, rctx, target LIMIT 200")


def test_commonest_contexts(spark):
    words = np.random.default_rng(2).choice(list("abcdef"), size=(40, 30), p=[0.4, 0.3, 0.1, 0.1, 0.05, 0.05]).tolist()
    words += [["x", "y", "z", "x", "y"]] * 60 + [[], ["a"], ["q", "r"]]
    df = spark.createDataFrame([(w,) for w in words], "ws array<string>")
    n = Counter((" ".join(w[i - a : i]), " ".join(w[i + 1 : i + 1 + b]), w[i]) for w in words for i in range(len(w)) for a in range(3) for b in range(3) if a + b and i >= a and i + b < len(w))
    want = sorted(n.items(), key=lambda e: (-e[1], e[0]))
    assert any(len(" ".join(e).split()) > 3 for e, _ in want[:40])
    for k, named in ((40, 4096), (40, 3), (5, 4096), (100_000, 4096)):
        got = [((r.lctx, r.rctx, r.target), r.n) for r in context.commonest_contexts(df, candidates.bigrams(df), k, named=named).collect()]
        assert got == want[:k]
