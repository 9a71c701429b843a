"""Queries that control near-duplicates: between splits, and within lists of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diversity, leakage
from .base import DOCS, RANKING, docs, systems
from .corpus import _SPLIT, group_split


def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Every document of dev and heldout, with what of it the splits before its own have seen."""
    told = docs(spark, sf).join(F.broadcast(group_split(spark, sf)) if _few(spark, sf) else group_split(spark, sf), "source")
    return leakage.seen_before(told, "doc_id")


def _few(spark: SparkSession, sf: str) -> bool:
    """Whether sources are few enough to be sent to every executor."""
    return group_split(spark, sf).limit(100_001).count() <= 100_000


_LEAKAGE = f"""WITH {DOCS}, {_SPLIT}, o AS (SELECT doc_id, split, ws FROM docs JOIN s USING (source)),
p AS (SELECT doc_id, split, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM o),
b AS (SELECT gram, bool_or(split = 'train') AS train, bool_or(split <> 'heldout') AS fit FROM p GROUP BY gram),
c AS (SELECT doc_id, split, gram, count(*) AS n FROM p WHERE split <> 'train' GROUP BY ALL),
t AS (SELECT doc_id, sum(n)::BIGINT AS n_positions, count(*) AS n_shingles, coalesce(sum(n) FILTER (seen), 0)::BIGINT AS n_seen, count(*) FILTER (seen) AS n_shared FROM (SELECT doc_id, n, CASE split WHEN 'dev' THEN train ELSE fit END AS seen FROM c JOIN b USING (gram)) GROUP BY doc_id)
SELECT doc_id, split, coalesce(n_positions, 0) AS n_positions, coalesce(n_seen, 0) AS n_seen, coalesce(n_shingles, 0) AS n_shingles, coalesce(n_shared, 0) AS n_shared, coalesce(100 * n_shared >= 80 * n_shingles, false) AS near_duplicate FROM o LEFT JOIN t USING (doc_id) WHERE split <> 'train'"""


def list_diversity(spark: SparkSession, sf: str) -> DataFrame:
    """How alike the first five candidates are in either system's lists, as they are and reranked for diversity."""
    by = ["system", "ranking"]
    told = diversity.lists(systems(spark, sf), ["system", "case_id"])
    both = told.withColumn("ranking", F.lit("score")).unionByName(diversity.diverse(told, ["system", "case_id"]).withColumn("ranking", F.lit("diverse")))
    return diversity.rates(both, by)


def _likeness(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))))"


def _step(k: int) -> str:
    return f"""m{k} AS (SELECT l.system, l.case_id, l.rank, l.pairs, l.share, max({_likeness('l.pairs', 's.pairs')}) AS nearest FROM l JOIN s{k - 1} s USING (system, case_id) GROUP BY ALL HAVING NOT bool_or(l.rank = s.rank)),
s{k} AS (SELECT * FROM s{k - 1} UNION ALL (SELECT system, case_id, rank, pairs, share, {k} AS place FROM m{k} QUALIFY row_number() OVER (PARTITION BY system, case_id ORDER BY share - 0.3::DOUBLE * nearest DESC, rank) = 1))"""


_DIVERSITY = f"""{RANKING}, y AS (SELECT 'next' AS system, * FROM a UNION ALL SELECT 'prev', * FROM b),
l AS (SELECT system, case_id, rank, list_distinct(list_transform(range(1, length(w)), lambda i: substr(w, i, 2))) AS pairs, 0.7::DOUBLE * round(exp(score), 6) AS share FROM (SELECT *, '^' || candidate || '$' AS w FROM y)),
s1 AS (SELECT system, case_id, rank, pairs, share, 1 AS place FROM l QUALIFY row_number() OVER (PARTITION BY system, case_id ORDER BY share DESC, rank) = 1),
""" + ",\n".join(map(_step, range(2, 6))) + f""",
t AS (SELECT system, 'score' AS ranking, case_id, rank AS place, pairs FROM l WHERE rank < 5 UNION ALL SELECT system, 'diverse', case_id, place, pairs FROM s5),
q AS (SELECT system, ranking, count(DISTINCT case_id) AS n_lists FROM t GROUP BY ALL),
v AS (SELECT x.system, x.ranking, {_likeness('x.pairs', 'z.pairs')} AS s FROM t x JOIN t z ON x.system = z.system AND x.ranking = z.ranking AND x.case_id = z.case_id AND x.place < z.place)
SELECT system, ranking, any_value(n_lists) AS n_lists, count(s) AS n_pairs, round(100.0 * count(*) FILTER (s >= 0.5) / nullif(count(s), 0), 4) AS near_rate, round(sum(1 - s) / nullif(count(s), 0), 6) AS mean_distance FROM q LEFT JOIN v USING (system, ranking) GROUP BY system, ranking"""

QUERIES = {
    "split_leakage": (split_leakage, _LEAKAGE),
    "list_diversity": (list_diversity, _DIVERSITY),
}
