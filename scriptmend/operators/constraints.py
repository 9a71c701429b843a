"""What the visible letters and the length of a gap allow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

SEGMENTS = T.StructType([T.StructField("segments", T.ArrayType(T.StringType())), T.StructField("anchored_left", T.BooleanType()), T.StructField("anchored_right", T.BooleanType())])


def read_segments(display: str | None) -> tuple[list[str], bool, bool]:
    """Visible letter runs of an edited reading, and whether the word's start and end are visible.

    Brackets hide what is between them; a reading that closes a bracket it never opened starts hidden. The
    start is visible unless a bracket or circle stands before the first visible letter, the end likewise.
    """
    value = display or ""
    opened, closed = value.find("["), value.find("]")
    hidden = closed >= 0 and (opened < 0 or closed < opened)
    segments: list[str] = []
    run, before, after = "", not hidden, True
    for c in value:
        if c == "[":
            hidden = True
        elif c == "]":
            hidden = False
        elif "א" <= c <= "ת" and not hidden:
            run += c
            after = True
            continue
        if run:
            segments.append(run)
        run = ""
        if c in "[○" or "א" <= c <= "ת":
            after = False
        if not segments and c in "[]○":
            before = False
    if run:
        segments.append(run)
    if value.endswith("[") and segments and value[-2:-1] and "א" <= value[-2] <= "ת":
        after = False
    return segments, bool(segments) and before, bool(segments) and after


@F.pandas_udf(SEGMENTS)
def visible_segments(display: pd.Series) -> pd.DataFrame:
    """``read_segments`` over a column."""
    rows = [read_segments(d) for d in display]
    return pd.DataFrame({"segments": [r[0] for r in rows], "anchored_left": [r[1] for r in rows], "anchored_right": [r[2] for r in rows]})


def matches_visible(candidate: Column, segments: Column, anchored_left: Column, anchored_right: Column) -> Column:
    """Three tests of their own: first segment in front if anchored, last at the end if anchored, all in order."""
    first, last = F.get(segments, F.lit(0)), F.get(segments, F.size(segments) - 1)
    in_order = F.rlike(candidate, F.array_join(segments, ".*"))
    return (~anchored_left | candidate.startswith(first)) & (~anchored_right | candidate.endswith(last)) & in_order


def matches_length(candidate: Column, estimate: Column, tolerance: int) -> Column:
    return F.abs(F.length(candidate) - estimate) <= tolerance


def constraint_reason(is_gap: Column, markup: Column, visible: Column, estimate: Column) -> Column:
    """First reason against a target, or eligible."""
    return F.when(~is_gap, "not_a_lacuna").when(markup, "unsupported_target_markup").when(F.size(visible) == 0, "no_visible_hebrew").when(estimate < 2, "target_too_short").otherwise("eligible")


def reading_reason(reading: Column, fits: Column) -> Column:
    """First reason against a reading, or eligible."""
    plain = X.letters(reading)
    return (
        F.when(F.trim(reading).rlike(r"\s"), "multiword_reading")
        .when(reading.rlike(r"[/{}<>]"), "correction_or_alternative_markup")
        .when(reading.rlike(r"[○\[\]#?]"), "incomplete_reading")
        .when(F.length(plain) < 2, "reading_too_short")
        .when(~fits, "contradicts_physical_constraint")
        .otherwise("eligible")
    )


def _known_letters(segments: Column, anchored_left: Column, anchored_right: Column, size: Column) -> Column:
    """(position, letter) that a word of ``size`` letters must have: the first segment from the start if anchored, the last one up to the end."""
    first, last = F.get(segments, F.lit(0)), F.get(segments, F.size(segments) - 1)
    at = lambda text, before: F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.struct((i + before).cast("int").alias("pos"), F.substr(text, i, F.lit(1)).alias("letter")))
    none = F.array().cast("array<struct<pos:int,letter:string>>")
    side = lambda on, text, before: F.when(on & (F.length(text) > 0), at(text, before)).otherwise(none)
    return F.array_distinct(F.concat(side(anchored_left, first, F.lit(0)), side(anchored_right, last, size - F.length(last))))


def constrained_pairs(vocabulary: DataFrame, targets: DataFrame, tolerance: int = 1) -> DataFrame:
    """target, candidate of every word within a target's length and letters, by an index of postings.

    A posting has the words of a length with given letters at two positions. Letters at each position are counted over the
    vocabulary (a table of lengths, positions and letters); each distinct constraint and length takes the postings of its two rarest
    known letters, which are made only for the pairs of positions that some constraint takes; what they hold is tested. Constraints that no
    known letter binds meet all words of their lengths. Many targets of one constraint are matched once.

    Defined results: a constraint without segments has all words of its lengths, or none if it is anchored; one whose end segments don't fit
    into a length has no words of it; words may be of any length; repeated words and targets are repeated.
    """
    named = ["segments", "anchored_left", "anchored_right", "estimate"]
    lengths = F.sequence(F.greatest(F.lit(1), F.col("estimate") - tolerance), F.greatest(F.lit(1), F.col("estimate") + tolerance))
    asked = targets.select(*named).distinct().withColumn("len", F.explode(lengths)).filter(F.abs(F.col("len") - F.col("estimate")) <= tolerance)
    asked = asked.withColumn("known", _known_letters(F.col("segments"), F.col("anchored_left"), F.col("anchored_right"), F.col("len"))).filter(~F.exists("known", lambda k: (k["pos"] < 1) | (k["pos"] > F.col("len"))))
    words = vocabulary.select(F.col("word").alias("candidate"), F.length("word").alias("len"))
    letters = words.select("len", F.posexplode(F.split("candidate", "")).alias("pos", "letter")).groupBy("len", (F.col("pos") + 1).cast("int").alias("pos"), "letter").agg(F.count(F.lit(1)).alias("n"))
    held = asked.filter(F.size("known") > 0).select(*named, "len", F.size("known").alias("size"), F.explode("known").alias("k")).select(*named, "len", "size", "k.pos", "k.letter")
    # a letter that no word has there leaves a constraint without words
    rarest = held.join(letters, ["len", "pos", "letter"]).groupBy(*named, "len", "size").agg(F.sort_array(F.collect_list(F.struct("n", "pos", "letter"))).alias("ks")).filter(F.size("ks") == F.col("size"))
    one, two = F.get("ks", F.lit(0)), F.coalesce(F.get("ks", F.lit(1)), F.get("ks", F.lit(0)))
    keys = rarest.select(*named, "len", one["pos"].alias("p"), one["letter"].alias("a"), two["pos"].alias("q"), two["letter"].alias("b"))
    postings = words.join(keys.select("len", "p", "q").distinct(), "len").withColumn("a", F.substr("candidate", F.col("p"), F.lit(1))).withColumn("b", F.substr("candidate", F.col("q"), F.lit(1)))
    near = keys.join(postings, ["len", "p", "q", "a", "b"]).select(*named, "candidate")
    wide = asked.filter(F.size("known") == 0).join(words, "len").select(*named, "candidate")
    met = near.unionByName(wide).filter(matches_visible(F.col("candidate"), F.col("segments"), F.col("anchored_left"), F.col("anchored_right")))
    return targets.select("target", *named).join(met, named).select("target", "candidate")


def unique_wildcard(masked: DataFrame, verses: DataFrame, key: str, group: str) -> DataFrame:
    """key, verse of masked rows (key, group, pattern with ?) that one verse of the group alone fits: joined on group and length, then tested."""
    asked = masked.withColumn("len", F.length("pattern"))
    known = verses.select(group, F.col("text").alias("verse"), F.length("text").alias("len")).distinct()
    like = F.replace(F.replace(F.replace(F.col("pattern"), F.lit("_"), F.lit("\\_")), F.lit("%"), F.lit("\\%")), F.lit("?"), F.lit("_"))
    met = asked.join(known, [group, "len"]).withColumn("_like", like).filter(F.expr("verse LIKE _like"))
    return met.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).filter("_n = 1").select(key, "verse")


#: Regimes of evidence: unknown length, approximate length, and both known exactly; 1 where word boundaries are predicted.
REGIMES = ("U0", "U1", "P0", "P1", "O1")


def open_regimes(candidate: Column, gold: Column, predicted: Column, tolerance: int = 1) -> Column:
    """Regimes that admit a phrase. ``predicted`` is the phrase whose word boundaries the model takes; only O1 sees the gold word's."""
    sizes = lambda p: F.transform(F.split(p, " "), F.length)
    bounds, about = sizes(candidate) == sizes(predicted), F.abs(F.length(candidate) - F.length(gold)) <= tolerance
    tests = dict(zip(REGIMES, (F.lit(True), bounds, about, bounds & about, sizes(candidate) == sizes(gold)), strict=True))
    return F.filter(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items())), lambda x: x.isNotNull())
