"""Words with attributed readings: targets in their columns, their variants, and readings merged by target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

TARGET = "<TARGET>"


def targets(words: DataFrame, column: list[str], around: int = 40) -> DataFrame:
    """column, line, word_id, raw, context_words, target_index of the words with alternatives.

    ``words`` has column, line, word_ord, word_id, raw and is_target (``sources.html.parse_columns``). The context is
    redacted, up to ``around`` words of the column on each side.
    """
    w = Window.partitionBy(*column).orderBy("word_ord")
    shown = words.withColumn("_w", X.redacted(F.col("raw")))
    shown = shown.withColumn("_l", F.collect_list("_w").over(w.rowsBetween(-around, -1))).withColumn("_r", F.collect_list("_w").over(w.rowsBetween(1, around)))
    return shown.filter("is_target").select(*column, "line", "word_id", "raw", F.concat("_l", F.array(F.lit(TARGET)), "_r").alias("context_words"), F.size("_l").alias("target_index"))


def enough_visible(context_words: str = "context_words", least: int = 10):
    """Whether ``least`` words of a context are neither gaps nor the target."""
    return F.size(F.filter(context_words, lambda w: ~w.isin(X.GAP, TARGET))) >= least


def explicit_variants(variants: DataFrame) -> DataFrame:
    """Variants that are stated, not assumed, have a source, and letters; reading_letters beside the reading."""
    plain = X.letters(F.col("reading"))
    fits = ~F.coalesce("assumed", F.lit(False)) & (F.col("kind") == "variant") & F.col("source_id").isNotNull() & (plain != "")
    return variants.withColumn("reading_letters", plain).filter(fits)


def with_variants(found: DataFrame, variants: DataFrame) -> DataFrame:
    """A row for each explicit variant of each target, by word id."""
    return found.join(explicit_variants(variants), "word_id")


def merged(rows: DataFrame, target: list[str], reading: str = "reading_letters") -> DataFrame:
    """target, reading, sources (id to name), raw_readings, n_rows: one row a target and reading.

    Of a source that is named differently the greatest name stands, whatever the order of the rows.
    """
    named = rows.groupBy(*target, F.col(reading).alias("merged_reading"), "source_id").agg(F.max("source_name").alias("name"), F.collect_set("reading").alias("raws"), F.count(F.lit(1)).alias("n"))
    out = named.groupBy(*target, "merged_reading").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("source_id").cast("string").alias("key"), F.col("name").alias("value"))))).alias("sources"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("raws")))).alias("raw_readings"), F.sum("n").alias("n_rows"))
    return out.withColumnRenamed("merged_reading", "reading")


def by_target(rows: DataFrame, target: list[str]) -> DataFrame:
    """target, n_rows, n_readings, n_sources."""
    return rows.groupBy(*target).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("reading_letters").alias("n_readings"), F.countDistinct("source_id").alias("n_sources"))
