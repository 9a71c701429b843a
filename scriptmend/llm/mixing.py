"""Mixing sources to target weights, in DataFrame operations only.

Each source gets a share of the wanted words by its weight, at most ``most`` times its size, the excess
going to the others. A source first gives all its documents as often as whole epochs fit; the rest of its
target is drawn without replacement by Efraimidis and Spirakis: each document has the key -ln(u) / w, with u
from the MD5 of a seed and its id and w its quality weight, and those of smallest key are taken until their words fill it.

The running sum over a source is not one task's work: keys pass through their known distribution function
into about sqrt(n) even slices of the source, slices are summed first, and each slice continues from the sum
before it. The table of sources, a row of a few numbers each, is sorted in one task, and broadcast only if it has at
most ``BROADCAST_ROWS`` rows.

Defined results: a null text has size 0; a null source is a source, ordered last; documents of size 0 take
0; a source of size 0 has target 0; ties in key go by id, then by the MD5 of the text, so that different texts of one
id have one order; of repeated rows, which nothing tells apart, each is drawn on its own; texts may have any length;
an empty table gives an empty result; extra columns are kept by ``mixed`` and not read by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, materialize, word_count

BROADCAST_ROWS, LEVELS = 20_000, 4


def quality_level(text: Column, size: Column) -> Column:
    """1 to 4: by how near the mean word length, with its blank, is to that of prose."""
    mean = F.length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1))
    far = F.abs(mean - 6.5)
    return F.when(far <= 1.5, 4).when(far <= 3, 3).when(far <= 6, 2).otherwise(1)


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row per __sm_src: source size, target, whole epochs, words left to draw, number of slices, share of each quality level.

    With sources sorted by cap / weight, one is capped if raising all from it on to its ratio still leaves words over.
    """
    s = lambda n: F.col(OWN + n)
    by = sized.groupBy(OWN + "src").agg(F.sum("size").alias(OWN + "source_size"), F.count(F.lit(1)).alias(OWN + "n"), *(F.count_if(F.col(OWN + "level") == k).alias(f"{OWN}l{k}") for k in range(1, LEVELS + 1)))
    whole, named = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(OWN + "src")
    by = by.withColumn(OWN + "w", F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(named) - 1) % len(weights)))
    by = by.withColumn(OWN + "cap", most * s("source_size")).withColumn(OWN + "want", share * F.sum(OWN + "source_size").over(whole))
    before = Window.partitionBy(F.lit(0)).orderBy(s("cap") / s("w"), OWN + "src").rowsBetween(Window.unboundedPreceding, -1)
    caps, used = F.coalesce(F.sum(OWN + "cap").over(before), F.lit(0.0)), F.coalesce(F.sum(OWN + "w").over(before), F.lit(0.0))
    by = by.withColumn(OWN + "full", s("cap") / s("w") * (F.sum(OWN + "w").over(whole) - used) + caps < s("want"))
    left = s("want") - F.coalesce(F.sum(F.when(s("full"), s("cap"))).over(whole), F.lit(0.0))
    open_w = F.sum(F.when(~s("full"), s("w"))).over(whole)
    by = by.withColumn(OWN + "target", F.when(s("full"), s("cap")).otherwise(F.least(s("cap"), left * s("w") / open_w)))
    by = by.withColumn(OWN + "epochs", F.coalesce(F.floor(F.try_divide(s("target"), s("source_size"))), F.lit(0)))
    by = by.withColumn(OWN + "rest", s("target") - s("epochs") * s("source_size")).withColumn(OWN + "slices", F.ceil(F.sqrt(s("n").cast("double"))))
    return by.select(OWN + "src", OWN + "source_size", OWN + "target", OWN + "epochs", OWN + "rest", OWN + "slices", *((F.col(f"{OWN}l{k}") / s("n")).alias(f"{OWN}p{k}") for k in range(1, LEVELS + 1)))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(doc_id, __sm_src, size, __sm_level, __sm_key) of each row; __sm_src sorts by code point, null last."""
    src = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), src.alias(OWN + "src"), t.alias(OWN + "t"), word_count(F.col(text_col)).alias("size"))
    df = df.select("doc_id", OWN + "src", "size", F.md5(OWN + "t").alias(OWN + "tie"), quality_level(F.col(OWN + "t"), F.col("size")).alias(OWN + "level"))
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    return df.withColumn(OWN + "key", -F.log(u) / (F.col(OWN + "level") / LEVELS))


def _taken(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """The sized rows with source_size, target and taken."""
    c = lambda n: F.col(OWN + n)
    sources = materialize(source_targets(sized, weights, share, most), "sources")
    few = sources.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = sized.join(F.broadcast(sources) if few else sources, OWN + "src")
    below = sum((c(f"p{k}") * (1 - F.exp(-c("key") * (k / LEVELS))) for k in range(1, LEVELS + 1)), F.lit(0.0))
    rows = rows.withColumn(OWN + "slice", F.least(F.floor(below * c("slices")), c("slices") - 1))
    sums = rows.groupBy(OWN + "src", OWN + "slice").agg(F.sum("size").alias(OWN + "sum"))
    ahead = Window.partitionBy(OWN + "src").orderBy(OWN + "slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(OWN + "src", OWN + "slice", F.coalesce(F.sum(OWN + "sum").over(ahead), F.lit(0)).alias(OWN + "before"))
    inside = Window.partitionBy(OWN + "src", OWN + "slice").orderBy(OWN + "key", "doc_id", OWN + "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(OWN + "run", F.sum("size").over(inside)).join(sums, [OWN + "src", OWN + "slice"])
    drawn = (c("before") + c("run") - F.col("size") / 2 <= c("rest")) & (F.col("size") > 0)
    taken = (c("epochs") * F.col("size") + F.when(drawn, F.col("size")).otherwise(0)).cast("long")
    return rows.withColumn("source_size", c("source_size")).withColumn("target", c("target")).withColumn("taken", taken)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every document."""
    sized = materialize(_sized(docs, id_col, text_col, source_col, seed), "sized")
    return _taken(sized, weights, share, most).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns.

    Only ids and text hashes, not texts, go through the mixing; how often they are taken then joins the
    documents. Of repeated rows as many as were drawn get the larger number.
    """
    sized = materialize(_sized(docs, id_col, text_col, source_col, seed), "sized")
    taken = _taken(sized, weights, share, most).filter("size > 0")
    names = {n: F.col(n).alias(OWN + m) for n, m in (("doc_id", "id"), (OWN + "src", "from"), (OWN + "tie", "hash"))}
    each = (F.col("taken") / F.col("size")).cast("int")
    times = taken.groupBy(*names.values()).agg(F.min(each).alias(OWN + "least"), F.sum(each).alias(OWN + "all"), F.count(F.lit(1)).alias(OWN + "rows"))
    times = times.filter(F.col(OWN + "all") > 0)
    src = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    key = [F.col(OWN + "id"), F.col(OWN + "from"), F.col(OWN + "hash")]
    met = docs.join(times, F.col(id_col).cast("long").eqNullSafe(key[0]) & (src == key[1]) & (text == key[2]))
    more = F.col(OWN + "all") - F.col(OWN + "least") * F.col(OWN + "rows")
    alike = met.filter(more == 0).withColumn(OWN + "times", F.col(OWN + "least"))
    unlike = met.filter(more > 0).withColumn(OWN + "times", F.col(OWN + "least") + (F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))) <= more).cast("int"))
    return _repeated(alike.unionByName(unlike), docs.columns)


def _repeated(rows: DataFrame, columns: list[str]) -> DataFrame:
    copies = F.when(F.col(OWN + "times") > 0, F.sequence(F.lit(1), F.col(OWN + "times"))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn(OWN + "copy", F.explode(copies)).select(*columns)


#: DuckDB SQL for ``mix`` with default parameters.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce('0' || source, '1') AS src, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
d AS (SELECT doc_id, src, size, md5(t) AS tie, abs(length(t) / greatest(size, 1) - 6.5) AS far, (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM t),
k AS (SELECT *, -ln(u) / (CASE WHEN far <= 1.5 THEN 4 WHEN far <= 3 THEN 3 WHEN far <= 6 THEN 2 ELSE 1 END / 4::DOUBLE) AS key FROM d),
b AS (SELECT src, sum(size)::BIGINT AS s FROM k GROUP BY src),
w AS (SELECT src, s, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * s AS cap, 1.5::DOUBLE * sum(s) OVER () AS want FROM b),
f AS (SELECT *, cap / w * (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) + coalesce(sum(cap) OVER o, 0) < want AS full_ FROM w WINDOW o AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, want - coalesce(sum(cap) FILTER (full_) OVER (), 0) AS rest, sum(w) FILTER (NOT full_) OVER () AS open_w FROM f),
r AS (SELECT src, s, CASE WHEN full_ THEN cap ELSE least(cap, rest * w / open_w) END AS target FROM g),
e AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS epochs FROM r),
n AS (SELECT k.doc_id, k.size, e.s AS source_size, e.target, e.epochs, e.target - e.epochs * e.s AS rest, sum(k.size) OVER (PARTITION BY k.src ORDER BY k.key, k.doc_id NULLS FIRST, k.tie ROWS UNBOUNDED PRECEDING) AS run FROM k JOIN e USING (src))
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN size > 0 AND run - size / 2 <= rest THEN size ELSE 0 END)::BIGINT AS taken FROM n
"""
