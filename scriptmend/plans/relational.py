"""The same relational shapes on the star schema, and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import html
from .base import table


def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with and without orders, by segment."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    has, none = c.join(o, "c_custkey", "left_semi"), c.join(o, "c_custkey", "left_anti")
    both = has.select("c_mktsegment", F.lit("with").alias("kind")).unionByName(none.select("c_mktsegment", F.lit("without").alias("kind")))
    return both.groupBy("c_mktsegment", "kind").agg(F.count(F.lit(1)).alias("n"))


def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of union, intersection and difference of the nations of customers and suppliers."""
    a, b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"union_all": a.unionAll(b), "union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = None
    for name, df in parts.items():
        part = df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def weighted_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of a value weighted by another, by group; a group without weight is null."""
    o = table(spark, sf, "lineitem")
    return o.groupBy("l_returnflag").agg(F.round(F.try_divide(F.sum(F.col("l_discount") * F.col("l_quantity")), F.sum("l_quantity")), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def first_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """First and last order of each customer, by order key."""
    o = table(spark, sf, "orders")
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    last = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))
    return o.withColumn("f", first).withColumn("l", last).filter("f = 1 or l = 1").groupBy("o_custkey").agg(F.max(F.when(F.col("f") == 1, F.col("o_orderkey"))).alias("first_key"), F.max(F.when(F.col("l") == 1, F.col("o_orderkey"))).alias("last_key"))


def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    """List entries and paragraphs of each page, by its parser."""
    rows = html.parse_pages(table(spark, sf, "pages"), "page_id", "html")
    return rows.groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


def html_links(spark: SparkSession, sf: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r'<li><a href="/([^"]*)">'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.size(links).alias("n_links"), F.array_join(links, "|").alias("targets"))


def host_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "semi_anti": (semi_anti, "SELECT c_mktsegment, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'with' ELSE 'without' END AS kind, count(*) AS n FROM customer GROUP BY 1, 2"),
    "set_operations": (set_operations, "WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier) SELECT 'union_all' AS op, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"),
    "weighted_loss": (weighted_loss, "SELECT l_returnflag, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 6) AS mean, count(*) AS n FROM lineitem GROUP BY 1"),
    "first_last_wins": (first_last_wins, "SELECT o_custkey, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1"),
    "html_extract": (html_extract, None),
    "html_links": (html_links, "SELECT page_id, len(x) AS n_links, array_to_string(x, '|') AS targets FROM (SELECT page_id, regexp_extract_all(html, '<li><a href=\"/([^\"]*)\">', 1) AS x FROM pages)"),
    "host_counts": (host_counts, "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1"),
}
