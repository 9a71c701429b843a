"""Text-graph operators: signs to words, words to events, events to chunks and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

SIGNS = "modern-reconstruction-signs"
MARKER = "modern-removal-or-unknown-marker"

# Scrolls in Aramaic, which can be left out.
ARAMAIC = (
    "1Q20 11Q10 4Q196 4Q197 4Q198 4Q199 4Q200 4Q201 4Q202 4Q203 4Q204 4Q205 4Q206 4Q207 4Q208 4Q209 "
    "4Q210 4Q211 4Q212 4Q213 4Q214 4Q243 4Q244 4Q245 4Q246 4Q550 4Q551 4Q552 4Q553 4Q554 4Q555 4Q556"
).split()
EVERY_BOOK, HEBREW_ONLY = ("", "all", "none", "off"), ("no-aram", "exclude_aramaic", "exclude-aramaic", "hebrew-only")


def word_status(words: DataFrame, signs: DataFrame) -> DataFrame:
    """glyph, fully_reconstructed and preserved of each word; a word that is mixed or without signs is neither."""
    per = signs.groupBy("word_node").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sign_pos", "glyph"))), lambda s: F.coalesce(s["glyph"], F.lit(""))), "").alias("glyph"), F.bool_and(F.col("rec").eqNullSafe(1)).alias("rec_all"), F.bool_and(~F.col("rec").eqNullSafe(1)).alias("rec_none"))
    return words.join(per, "word_node", "left").select("word_node", F.coalesce("glyph", F.lit("")).alias("glyph"), F.coalesce("rec_all", F.lit(False)).alias("fully_reconstructed"), F.coalesce("rec_none", F.lit(False)).alias("preserved"))


def word_events(words: DataFrame, signs: DataFrame) -> DataFrame:
    """kind (word, gap, separator), token, pattern, missing_chars_estimate and basis of each word.

    A word is a gap if a sign is reconstructed or removed or ``full`` has ``#``. Its pattern has the letters,
    ``?`` for each reconstructed letter and each ``#``, or ``?`` alone; an estimate of none is null.
    """
    ordered = F.sort_array(F.collect_list(F.struct("sign_pos", "glyph", "rec", "rem")))
    per = signs.groupBy("word_node").agg(ordered.alias("signs"))
    df = words.select("word_node", "scroll_id", "word_pos", F.coalesce("full", F.lit("")).alias("full")).join(per, "word_node", "left").withColumn("signs", F.coalesce("signs", F.array().cast("array<struct<sign_pos:int,glyph:string,rec:int,rem:int>>")))
    shown = F.array_join(F.transform("signs", lambda s: F.when(s["rec"].eqNullSafe(1), F.regexp_replace(X.letters(s["glyph"]), ".", "?")).otherwise(X.letters(s["glyph"]))), "")
    lost = F.aggregate("signs", F.lit(0), lambda a, s: a + F.when(s["rec"].eqNullSafe(1), F.length(X.letters(s["glyph"]))).otherwise(0))
    hashes = F.length("full") - F.length(F.replace(F.col("full"), F.lit("#"), F.lit("")))
    rec, rem = F.exists("signs", lambda s: s["rec"].eqNullSafe(1)), F.exists("signs", lambda s: s["rem"].eqNullSafe(1))
    plain = F.array_join(F.transform("signs", lambda s: X.letters(s["glyph"])), "")
    df = df.withColumn("_gap", rec | rem | (hashes > 0)).withColumn("_plain", plain)
    pattern = F.concat(shown, F.repeat(F.lit("?"), hashes))
    return df.select(
        "word_node",
        "scroll_id",
        "word_pos",
        F.when(F.col("_gap"), "gap").when(F.col("_plain") != "", "word").otherwise("separator").alias("kind"),
        F.when(~F.col("_gap") & (F.col("_plain") != ""), F.col("_plain")).alias("token"),
        F.when(F.col("_gap"), F.when(pattern == "", "?").otherwise(pattern)).alias("pattern"),
        F.when(F.col("_gap"), F.nullif(lost + hashes, F.lit(0))).alias("missing_chars_estimate"),
        F.when(F.col("_gap"), F.when(rec, SIGNS).otherwise(MARKER)).alias("basis"),
    )


def lacunae(events: DataFrame, context: int = 20) -> DataFrame:
    """Runs of gaps; separators don't break one. Contexts are the words among the ``context`` events on each side."""
    w = Window.partitionBy("scroll_id").orderBy("word_pos")
    df = events.filter("kind != 'separator'").withColumn("at", F.row_number().over(w))
    df = df.withColumn("island", F.col("at") - F.row_number().over(Window.partitionBy("scroll_id", "kind").orderBy("word_pos")))
    token = F.when(F.col("kind") == "word", F.struct("at", "token"))
    df = df.withColumn("before", F.collect_list(token).over(w.rowsBetween(-context, -1))).withColumn("after", F.collect_list(token).over(w.rowsBetween(1, context)))
    gaps = df.filter("kind = 'gap'").groupBy("scroll_id", "island").agg(
        F.min("at").alias("first"),
        F.count(F.lit(1)).alias("gap_word_count_estimate"),
        F.sum("missing_chars_estimate").alias("missing_char_count_estimate"),
        F.transform(F.sort_array(F.collect_list(F.struct("at", "pattern"))), lambda s: s["pattern"]).alias("visible_patterns"),
        F.transform(F.min_by("before", "at"), lambda s: s["token"]).alias("left_context"),
        F.transform(F.max_by("after", "at"), lambda s: s["token"]).alias("right_context"),
        F.transform(F.sort_array(F.collect_list(F.struct("at", "word_node"))), lambda s: s["word_node"]).alias("source_word_nodes"),
        F.sort_array(F.collect_set("basis")).alias("estimate_sources"),
    )
    number = F.row_number().over(Window.partitionBy("scroll_id").orderBy("first")) - 1
    return gaps.withColumn("gap_index", number).drop("island", "first")


def event_chunks(events: DataFrame, size: int = 128, least: int = 20) -> DataFrame:
    """scroll_id, chunk_index, text, n_units, n_preserved_words, n_gap_slots; chunks of too few words go, the others keep their index."""
    w = Window.partitionBy("scroll_id").orderBy("word_pos")
    unit = F.when(F.col("kind") == "word", F.col("token")).otherwise(X.GAP)
    df = events.filter("kind != 'separator'").withColumn("at", F.row_number().over(w) - 1).withColumn("chunk_index", F.floor(F.col("at") / size).cast("int"))
    out = df.groupBy("scroll_id", "chunk_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", unit.alias("u")))), lambda s: s["u"]), " ").alias("text"), F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("kind") == "word").alias("n_preserved_words"), F.count_if(F.col("kind") == "gap").alias("n_gap_slots"))
    return out.filter(F.col("n_preserved_words") >= least)


def composition_groups(chunks: DataFrame, first: bool = True) -> DataFrame:
    """book -> group: the composition of its first (or last) row, or BOOK::<book> where it is blank. Needs a row_id."""
    order = F.col("row_id").asc() if first else F.col("row_id").desc()
    ranked = chunks.withColumn("_r", F.row_number().over(Window.partitionBy("book").orderBy(order))).filter("_r = 1")
    name = F.nullif(F.trim(F.coalesce("composition", F.lit(""))), F.lit(""))
    return ranked.select("book", F.coalesce(name, F.concat(F.lit("BOOK::"), "book")).alias("grp"))


def marker_flags(vac: Column, rem: Column, unc: Column, glyph: Column, full: Column) -> Column:
    """Flags of a gap marker, in fixed order."""
    g, f = F.coalesce(glyph, F.lit("")), F.coalesce(full, F.lit(""))
    flags = F.array(
        F.when(vac.eqNullSafe(1), "vacat"),
        F.when(rem.eqNullSafe(1), "removed"),
        F.when(F.coalesce(unc, F.lit(0)) >= 3, F.concat(F.lit("uncertain-"), unc.cast("string"))),
        F.when(g == "", "empty-glyph"),
        F.when(f.contains("#"), "hash-loss"),
    )
    return F.filter(flags, lambda x: x.isNotNull())


def run_category(flags: Column) -> Column:
    """Category of a run by the first flag, in order of priority, that any of its words has."""
    return F.when(F.array_contains(flags, "vacat"), "vacat").when(F.array_contains(flags, "removed"), "removed").when(F.exists(flags, lambda f: f.startswith("uncertain")), "uncertain").when(F.array_contains(flags, "hash-loss"), "hash_loss").when(F.array_contains(flags, "empty-glyph"), "empty_glyph").otherwise("other")


def non_biblical(words: DataFrame, inverse: bool = False) -> DataFrame:
    """Words without the feature ``biblical``, or, inversely, those with it; empty and 0 are without."""
    has = ~F.coalesce(F.col("biblical").cast("string"), F.lit("")).isin("", "0")
    return words.filter(has if inverse else ~has)


def without_books(rows: DataFrame, mode: str, book: str = "scroll") -> DataFrame:
    """All rows, or those of scrolls that are not in Aramaic; a null scroll stays."""
    name = mode.strip().lower()
    if name in EVERY_BOOK:
        return rows
    if name not in HEBREW_ONLY:
        raise ValueError(f"unknown choice of books: {mode}")
    return rows.filter(~F.coalesce(F.col(book).isin(ARAMAIC), F.lit(False)))


def reconstructed_shares(status: DataFrame) -> DataFrame:
    """words, reconstructed, share of words that are wholly reconstructed (of ``word_status``)."""
    return status.agg(F.count(F.lit(1)).alias("words"), F.count_if("fully_reconstructed").alias("reconstructed"), F.coalesce(F.try_divide(F.count_if("fully_reconstructed").cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0)).alias("share"))
