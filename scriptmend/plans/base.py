"""Tables, and the SQL that the oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import sequences as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_words(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "ws")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_words(table(spark, sf_dir, "benchmark")).select("item_id", "text", "ws")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.single_cases(items(spark, sf_dir))


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.two_systems(docs(spark, sf_dir), cases(spark, sf_dir)).cache()


def one_system(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("system") == name).drop("system")


DOCS = r"docs AS (SELECT doc_id, source, lang, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents)"
ITEMS = r"items AS (SELECT item_id, text, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM benchmark)"
TOKENS = "tok AS (SELECT doc_id, source, lang, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM docs)"
CASES = "cases AS (SELECT item_id * 1000000000 + i AS case_id, item_id AS item, i AS pos, ws[i] AS lw, ws[i + 1] AS gold, ws[i + 2] AS rw FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM items WHERE len(ws) > 2))"
BIGRAMS = "bigrams AS (SELECT ws[i] AS w1, ws[i + 1] AS w2 FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM docs WHERE len(ws) > 1))"
NEXT = """nx0 AS (SELECT w1, w2 AS candidate, count(*) AS n FROM bigrams WHERE w1 IN (SELECT lw FROM cases) GROUP BY ALL),
nx1 AS (SELECT w1, candidate, round(ln(n / sum(n) OVER (PARTITION BY w1)), 6) AS score FROM nx0),
nx AS (SELECT w1, candidate, score, row_number() OVER (PARTITION BY w1 ORDER BY score DESC, candidate) - 1 AS rank FROM nx1 QUALIFY rank < 20)"""
PREV = """pv0 AS (SELECT w2, w1 AS candidate, count(*) AS n FROM bigrams WHERE w2 IN (SELECT rw FROM cases) GROUP BY ALL),
pv1 AS (SELECT w2, candidate, round(ln(n / sum(n) OVER (PARTITION BY w2)), 6) AS score FROM pv0),
pv AS (SELECT w2, candidate, score, row_number() OVER (PARTITION BY w2 ORDER BY score DESC, candidate) - 1 AS rank FROM pv1 QUALIFY rank < 20)"""
SYSTEMS = "a AS (SELECT case_id, candidate, score, rank FROM cases JOIN nx ON lw = w1), b AS (SELECT case_id, candidate, score, rank FROM cases JOIN pv ON rw = w2)"
RANKING = "WITH " + ", ".join([DOCS, ITEMS, CASES, BIGRAMS, NEXT, PREV, SYSTEMS])


def hits(rank: str = "gold_rank") -> str:
    return ", ".join(f"round(100.0 * count(*) FILTER ({rank} < {k}) / count(*), 4) AS top{k}" for k in (1, 5, 10, 20))
