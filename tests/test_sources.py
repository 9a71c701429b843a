"""Markup of transcriptions, readings, text graphs and the checks on them, by hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scriptmend.functions import text as X
from scriptmend.operators import classify, manuscripts, readings, validation
from scriptmend.sources import html, textgraph

PAGE = """<table><tr class="line-verse" data-name="1"><td><span class="word" data-word-id="5">א[ב]</span> <span class="word" data-word-id="6">גד<span>ה</span></span>
<span class="alternative-reading">x <span class="word" data-word-id="6">z</span></span><span class="word" data-word-id="0">no</span></td></tr>
<tr><td><span class="word" data-word-id="9">outside</span></td></tr>
<tr class="line-verse" data-name="2"><td><table><tr><td><span class="word" data-word-id="7">שלום</span></td></tr></table><span class="word" data-word-id="6">דבר</span></td></tr>
<tr class="line-verse" data-name="3"><td><span class="word" data-word-id="8">open</span>"""


def test_column_markup(spark):
    want = [("1", 0, 5, "א[ב]", False), ("1", 1, 6, "גדה", False), ("2", 2, 7, "שלום", False), ("2", 3, 6, "דבר", True)]
    assert html.column_words(PAGE) == want and html.column_words(None) == [] == html.column_words("")
    pages = spark.createDataFrame([("c1", PAGE), ("c2", None)], "column string, html string")
    words = html.parse_columns(pages, "column", "html")
    assert sorted(tuple(r)[1:] for r in words.collect()) == sorted(want)
    got = readings.targets(words, ["column"], 2).collect()
    assert [(r.line, r.word_id, r.raw, r.context_words, r.target_index) for r in got] == [("2", 6, "דבר", ["גדה", "שלום", "<TARGET>"], 2)]
    few = readings.targets(words, ["column"]).select(readings.enough_visible(least=2).alias("two"), readings.enough_visible(least=3).alias("three")).first()
    assert (few.two, few.three) == (True, False)
    ids = spark.createDataFrame([("c12",), ("c",), ("xc1",), ("c1 ",)], "i string").filter(html.is_column_id(F.col("i"))).collect()
    assert [r.i for r in ids] == ["c12"]


def test_entries(spark):
    page = "<ul><li class='q'><a href='/transcriptions/4Q%20x/c1'>a</a></li><li class='q b'><a href='/transcriptions/no/c1'>b</a></li><li><a href='/transcriptions/no/'>c</a></li><li class='q'><a href='/other/no/x'>d</a><a href='/transcriptions/1Q1/'>e</a></li></ul>"
    assert html.entry_names(page, "q", "b") == ["4Q x", "1Q1"]
    nested = "<ul><li class=q><ul><li class=b><a href='/transcriptions/in/x'>i</a></li></ul><a href='/transcriptions/out/x'>o</a></li></ul><a href='/transcriptions/after/x'>z</a>"
    assert html.entry_names(nested, "q") == ["out"] and html.entry_names(nested, "b") == ["in"] and html.entry_names(None, "q") == []
    assert html.entry_names("<li class=q><a href='/transcriptions//x'>e</a><a>n</a><a href='/transcriptions/n'>n</a>", "q") == []
    pages = spark.createDataFrame([("p", page), ("n", None)], "k string, html string")
    assert [tuple(r) for r in html.parse_entries(pages, "k", "html", "q", "b").orderBy("n").collect()] == [("p", 0, "4Q x"), ("p", 1, "1Q1")]


def test_merged_readings(spark):
    schema = "word_id long, reading string, assumed boolean, kind string, source_id long, source_name string"
    rows = [(6, "ד[בר", False, "variant", 1, "A"), (6, "דבר", None, "variant", 2, "B"), (6, "דבר", False, "variant", 2, "C"), (6, "רע", False, "variant", 1, "A"), (6, "x", False, "variant", 1, "A"), (6, "טוב", True, "variant", 1, "A"), (6, "טוב", False, "note", 1, "A"), (6, "טוב", False, "variant", None, None), (7, "אב", False, "variant", 3, "D")]
    found = spark.createDataFrame([("s", 6)], "siglum string, word_id long")
    met = readings.with_variants(found, spark.createDataFrame(rows, schema))
    got = {r.reading: (r.sources, r.raw_readings, r.n_rows) for r in readings.merged(met, ["siglum", "word_id"]).collect()}
    assert got == {"דבר": ({"1": "A", "2": "C"}, sorted(["דבר", "ד[בר"]), 3), "רע": ({"1": "A"}, ["רע"], 1)}
    assert tuple(readings.by_target(met, ["siglum", "word_id"]).first()) == ("s", 6, 4, 2, 2)


@pytest.fixture(scope="module")
def graph(tmp_path_factory):
    folder = tmp_path_factory.mktemp("graph")
    files = {"otype": "1-4\tsign\n5-6\tword\nword\n8\tscroll", "glyph": "א\nב\n\n4\tx\\ty", "oslots": "5\t1-2\n3\n8\t1-3", "unread": "broken\tline"}
    for name, body in files.items():
        (folder / f"{name}.tf").write_text(f"@{'edge' if name == 'oslots' else 'node'}\n@valueType=str\n\n{body}\n", encoding="utf-8")
    return str(folder)


def test_text_graph(spark, graph):
    nodes = textgraph.nodes(spark, graph, ["otype", "glyph"])
    got = {r.node: (r.otype, r.glyph) for r in nodes.collect()}
    assert got == {1: ("sign", "א"), 2: ("sign", "ב"), 3: ("sign", ""), 4: ("sign", "x\ty"), 5: ("word", None), 6: ("word", None), 7: ("word", None), 8: ("scroll", None)}
    slots = textgraph.edges(spark, graph, "oslots")
    assert sorted(map(tuple, slots.collect())) == [(5, 1), (5, 2), (6, 3), (8, 1), (8, 2), (8, 3)]
    words, scrolls = textgraph.typed(nodes, "word"), textgraph.typed(nodes, "scroll")
    assert sorted((r.node, r.scroll) for r in textgraph.contained(words, scrolls, slots, "scroll").collect()) == [(5, 8), (6, 8)]
    signs = textgraph.contained(textgraph.typed(nodes, "sign"), words, slots, "word")
    assert sorted((r.node, r.word) for r in signs.collect()) == [(1, 5), (2, 5), (3, 6)]


def test_books(spark):
    rows = spark.createDataFrame([("1Q20", "1"), ("4Q300", None), (None, "")], "scroll string, biblical string")
    assert manuscripts.without_books(rows, " All ").count() == 3
    assert manuscripts.without_books(rows, "Hebrew-Only").count() == 2
    assert manuscripts.non_biblical(rows).count() == 2 and manuscripts.non_biblical(rows, inverse=True).first().scroll == "1Q20"
    assert len(manuscripts.ARAMAIC) == len(set(manuscripts.ARAMAIC)) == 32
    with pytest.raises(ValueError, match="unknown choice"):
        manuscripts.without_books(rows, "some")


def test_rederived(spark):
    events = spark.createDataFrame([(1, "gap", "א?"), (2, "gap", "?"), (3, "word", None)], "word_node long, kind string, pattern string")
    rows = spark.createDataFrame([([1, 2], ["א?", "??"]), ([3, 1], ["?", "x"])], "source_word_nodes array<long>, visible_patterns array<string>")
    assert sorted(map(tuple, validation.not_rederived(rows, events).collect())) == [(1, "x"), (2, "??"), (3, "?")]
    assert validation.checked_labels({"a": 1, "b": 2}, {"a": 1})
    with pytest.raises(ValueError, match="labels differ: b, c"):
        validation.checked_labels({"a": 1, "b": 2}, {"b": 3, "c": 1})
    shares = manuscripts.reconstructed_shares(spark.createDataFrame([(True,), (False,)], "fully_reconstructed boolean"))
    assert tuple(shares.first()) == (2, 1, 0.5)


def test_canonical(spark):
    rows = spark.createDataFrame([("בְּרֵאשִׁ֖ית־ברא  x ?",), ("שׁ",), (None,), ("",)], "t string").select(X.canonical_text(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == ["בראשית ברא ?", "ש", None, ""]


def test_slot_class(spark):
    rows = [("דברים", [], 9, "empty"), ("דבר", ["דבר"], 9, "exact_top1_hit"), ("דבר", ["אב", "דבר"], 9, "exact_top5_hit"), ("דברים", ["אב"], 9, "particle_or_too_short"), ("דבר", ["שלום"], 1, "rare_or_unseen"), ("דבר", ["שלום", "טוב"], 9, "same_length_semantic"), ("דבר", ["שלום"], 9, "other_miss"), ("שלום", ["שלומ"], 9, "exact_top1_hit")]
    df = spark.createDataFrame(rows, "gold string, c array<string>, n long, want string")
    got = df.withColumn("got", classify.slot_class(F.col("gold"), F.col("c"), F.col("n"), X.medial)).filter("NOT got <=> want")
    assert got.count() == 0
    assert [r.p for r in df.select(X.is_particle(F.lit("ם"), ["מ"]).alias("p")).limit(1).collect()] == [True]


def test_loose_form(spark):
    rows = [("דויד", "דד"), ("יהוה", "DIVINE"), ("בו", "בו"), ("שלום", "שלמ")]
    got = [r.x for r in spark.createDataFrame(rows, "w string, want string").select(X.loose_form(F.col("w")).alias("x")).collect()]
    assert got == [w for _, w in rows]
