"""Golden vectors of the text functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scriptmend.functions import ranking as R
from scriptmend.functions import text as X
from scriptmend.operators import constraints as K
from scriptmend.operators import sequences as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("a", "b", "n"), [("שלום", "שלום", 0), ("שלום", "שלם", 1), ("", "אב", 2)])
def test_distance(spark, a, b, n):
    assert one(spark, F.levenshtein(F.lit(a), F.lit(b))) == n


@pytest.mark.parametrize(("p", "g", "f1"), [("אב גד", "אב גד", 1.0), ("אבגד", "אב גד", 0.0), ("אב גד הו", "אב גד הו", 1.0)])
def test_boundary_f1(spark, p, g, f1):
    assert one(spark, X.boundary_f1(F.lit(p), F.lit(g))) == f1


@pytest.mark.parametrize(("text", "left", "legal"), [(" ", 2, False), ("א  ", 1, False), ("א ", 0, False), ("א ", 2, True)])
def test_legal_prefix(spark, text, left, legal):
    assert one(spark, X.legal_prefix(F.lit(text), F.lit(left))) is legal


def test_join_prefixes(spark):
    parts = F.array(*map(F.lit, ["ו", "ב", "בית", "<GAP>", "ה", "עם"]))
    assert one(spark, X.join_prefixes(parts)) == ["ובבית", "<GAP>", "העם"]
    assert one(spark, X.join_prefixes(F.array(*map(F.lit, ["ו", "<GAP>", "ב"])))) == ["ו", "<GAP>", "ב"]


def test_join_single_prefixes(spark):
    text = F.lit("ו ב בית ל ש שלום ה")
    assert one(spark, X.join_single_prefixes(text)) == "ו בבית ל ששלום ה"
    assert one(spark, X.n_joined(text)) == 2


def test_contiguous_context(spark):
    ws = F.array(*map(F.lit, ["דבר", "<GAP>", "אמת", "וטוב"]))
    left, right = S.contiguous_context(ws, F.lit(2))
    assert one(spark, left) == [] and one(spark, right) == ["וטוב"]


def test_context_keys(spark):
    keys = lambda l, r: [(x["l"], x["r"]) for x in one(spark, S.context_keys(*(F.array(*map(F.lit, s)).cast("array<string>") for s in (l, r))))]  # noqa: E731, E741
    assert keys([], []) == []
    assert keys(["דבר"], []) == [(["דבר"], [])]
    assert keys(["דבר"], ["טוב"]) == [([], ["טוב"]), (["דבר"], []), (["דבר"], ["טוב"])]


def test_restored(spark):
    ok = X.restored(F.lit("אב? ד?"), F.create_map(F.lit("2"), F.lit("ג"), F.lit("5"), F.lit("ה")))
    assert one(spark, ok) == "אבג דה"
    with pytest.raises(Exception, match="expected"):
        one(spark, X.restored(F.lit("אבג"), F.create_map(F.lit("1"), F.lit("ד"))))


@pytest.mark.parametrize(("display", "want"), [("מ]אדם", (["אדם"], False, True)), ("מבין[", (["מבין"], True, False)), ("]○בוכ○○[", (["בוכ"], False, False)), (None, ([], False, False))])
def test_read_segments(display, want):
    assert K.read_segments(display) == want


def test_matches_visible(spark):
    fits = lambda c: one(spark, K.matches_visible(F.lit(c), F.array(F.lit("להרוג")), F.lit(False), F.lit(True)) & K.matches_length(F.lit(c), F.lit(6), 1))
    assert fits("ולהרוג") and not fits("להרוגכ") and not fits("להריג")
    both = K.matches_visible(F.lit("אבxאב"), F.array(F.lit("אב")), F.lit(True), F.lit(True))
    assert one(spark, both)


@pytest.mark.parametrize(("reading", "reason"), [("האדם", "eligible"), ("כי רוח", "multiword_reading"), ("אדם/איש", "correction_or_alternative_markup"), ("{ו}אדם", "correction_or_alternative_markup"), ("אד○ם", "incomplete_reading"), ("א", "reading_too_short")])
def test_reading_reason(spark, reading, reason):
    assert one(spark, K.reading_reason(F.lit(reading), F.lit(True))) == reason


def test_forms(spark):
    assert one(spark, X.retrieval_form(F.lit("[כול]"))) == "כל"
    assert one(spark, X.letters(F.lit(None).cast("string"))) == ""
    assert one(spark, X.redacted(F.lit("ה[מל]ך"))) == "<GAP>"
    assert one(spark, X.redacted(F.lit("מלך"))) == "מלך"


@pytest.mark.parametrize(("n", "name"), [(None, "common"), (0, "unseen"), (3, "rare"), (20, "medium"), (21, "common")])
def test_rarity(spark, n, name):
    assert one(spark, R.rarity(F.lit(n).cast("int"))) == name


def test_scores(spark):
    assert one(spark, R.linear_rank_score(F.lit(0), F.lit(1))) == 1.0
    assert one(spark, R.scaled(F.lit(2.0), F.lit(2.0), F.lit(2.0))) == 1.0
    assert one(spark, R.percent(F.lit(0), F.lit(0))) == 0.0
    assert [one(spark, R.gap_bucket(F.lit(n))) for n in (1, 3, 4, 5, 6)] == ["1", "3", "4-5", "4-5", "6+"]
