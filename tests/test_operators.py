"""Operators on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scriptmend.functions import text as X
from scriptmend.operators import augment, candidates, context, fusion, manuscripts, metrics, sequences, splits, validation
from scriptmend.sources import files, html


@pytest.fixture(scope="module")
def graph(spark):
    words = spark.createDataFrame([(1, 1, 0, "אב", None), (2, 1, 1, "##", None), (3, 1, 2, "-", None), (4, 1, 3, "גד", None), (5, 1, 4, "הו", None), (6, 1, 5, "ז", None)], "word_node long, scroll_id long, word_pos int, full string, rem int")
    signs = spark.createDataFrame([(1, 0, "א", None, None), (1, 1, "ב", None, None), (4, 0, "ג", 1, None), (4, 1, "ד", None, None), (5, 0, "ה", 1, None), (5, 1, "ו", 1, None), (6, 0, "ז", None, 1)], "word_node long, sign_pos int, glyph string, rec int, rem int")
    return words, signs


def test_word_status(graph):
    rows = {r.word_node: (r.glyph, r.fully_reconstructed, r.preserved) for r in manuscripts.word_status(*graph).collect()}
    assert rows[1] == ("אב", False, True) and rows[4] == ("גד", False, False) and rows[5] == ("הו", True, False) and rows[2] == ("", False, False)


def test_events_and_gaps(graph):
    events = manuscripts.word_events(*graph)
    rows = {r.word_node: r for r in events.collect()}
    assert (rows[1].kind, rows[1].token) == ("word", "אב")
    assert (rows[2].kind, rows[2].pattern, rows[2].missing_chars_estimate) == ("gap", "??", 2)
    assert rows[3].kind == "separator"
    assert (rows[4].pattern, rows[4].missing_chars_estimate, rows[4].basis) == ("?ד", 1, manuscripts.SIGNS)
    assert (rows[6].pattern, rows[6].missing_chars_estimate, rows[6].basis) == ("ז", None, manuscripts.MARKER)
    gaps = manuscripts.lacunae(events).collect()
    assert len(gaps) == 1
    assert gaps[0].gap_word_count_estimate == 4 and gaps[0].missing_char_count_estimate == 5
    assert gaps[0].left_context == ["אב"] and gaps[0].right_context == []
    assert gaps[0].source_word_nodes == [2, 4, 5, 6]
    chunk = manuscripts.event_chunks(events, 128, 1).first()
    assert chunk.text == "אב <GAP> <GAP> <GAP> <GAP>" and chunk.n_gap_slots == 4
    assert validation.bad_tokens(manuscripts.event_chunks(events, 128, 1)).count() == 0
    assert validation.wrong_counters(manuscripts.event_chunks(events, 128, 1)).count() == 0


def test_composition_groups(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", " ")], "row_id int, book string, composition string")
    assert {r.book: r.grp for r in manuscripts.composition_groups(rows).collect()} == {"a": "x", "b": "BOOK::b"}
    assert {r.book: r.grp for r in manuscripts.composition_groups(rows, first=False).collect()} == {"a": "y", "b": "BOOK::b"}


def test_marker_flags(spark):
    row = spark.range(1).select(manuscripts.marker_flags(F.lit(1), F.lit(None).cast("int"), F.lit(4), F.lit(""), F.lit("x#")).alias("f")).withColumn("c", manuscripts.run_category(F.col("f"))).first()
    assert row.f == ["vacat", "uncertain-4", "empty-glyph", "hash-loss"] and row.c == "vacat"


def test_array_runs_and_window_runs_agree(spark):
    docs = spark.createDataFrame([(1, "a bb ccc dd e fff ggg hh"), (2, ""), (3, "aaa")], "doc_id long, text string")
    by_array = {(r.doc_id, r["first"], r.n) for r in sequences.array_runs(sequences.with_words(docs), ["doc_id"]).collect()}
    rows = sequences.tokens(docs, ["doc_id"]).withColumn("gap", F.length("word") <= 2)
    by_window = {(r.doc_id, r["first"], r.n) for r in sequences.runs(rows, ["doc_id"], "pos", "gap").filter("gap").collect()}
    assert by_array == by_window == {(1, 0, 2), (1, 3, 2), (1, 7, 1)}


def test_chunks_keep_their_index(spark):
    docs = spark.createDataFrame([(1, " ".join(["a"] * 3 + ["word"] * 5))], "doc_id long, text string")
    got = [(r.chunk_index, r.n_units, r.n_kept) for r in sequences.array_chunks(sequences.with_words(docs), ["doc_id"], 3, 2).orderBy("chunk_index").collect()]
    rows = sequences.tokens(docs, ["doc_id"])
    same = [(r.chunk_index, r.n_units, r.n_kept) for r in sequences.chunks(rows, ["doc_id"], "pos", F.length("word") > 2, 3, 2).orderBy("chunk_index").collect()]
    assert got == same == [(1, 3, 3), (2, 2, 2)]


def test_back_off_uses_narrower_window_outside_group(spark):
    text = "one two three four five target six seven eight nine ten"
    other = "x y four five target six seven z w"
    docs = sequences.with_words(spark.createDataFrame([(1, "own", text), (2, "far", other)], "doc_id long, source string, text string"))
    case = sequences.with_words(spark.createDataFrame([(7, "own", text)], "item_id long, own string, text string"))
    asked = context.lookup_cases(case, ["item_id", "own"])
    index = context.parallel_index(docs, asked, "source")
    wide = context.parallel_lookup(asked, index, ["item_id", "own", "pos"]).filter("pos = 5").first()
    narrow = context.parallel_lookup(asked, index, ["item_id", "own", "pos"], "own").filter("pos = 5").first()
    assert (wide.w, wide.predicted) == (5, "target") and (narrow.w, narrow.predicted) == (2, "target")


def test_retrieval_score(spark):
    index = spark.createDataFrame([("דבר", "טוב", 1, 1, "אמת", 3)], "lctx string, rctx string, a int, b int, target string, n long")
    asked = spark.createDataFrame([(1, "דבר", "טוב", 1, 1)], "case_id int, lctx string, rctx string, a int, b int")
    row = context.retrieval_scores(asked, index, ["case_id"]).first()
    assert row.candidate == "אמת" and abs(row.score - (3 + 1.3862943611)) < 1e-9 and row.span == 3 and row.hits == 3


def _ranked(spark, rows):
    return spark.createDataFrame([(1, c, float(s), r) for r, (c, s) in enumerate(rows)], "case_id int, candidate string, score double, rank int")


def test_overlap_and_fallback(spark):
    word, char = _ranked(spark, [("אב", 2), ("גד", 1)]), _ranked(spark, [("גד", 3), ("הו", 2)])
    assert [r.candidate for r in fusion.overlap_ensemble(word, char, "case_id").collect()] == ["גד"]
    alone = fusion.ranked(fusion.overlap_ensemble(_ranked(spark, [("אב", 2)]), char, "case_id"), ["case_id"]).orderBy("rank").collect()
    assert [r.candidate for r in alone] == ["גד", "הו"]


def test_ensemble_has_both(spark):
    got = fusion.rank_ensemble(_ranked(spark, [("אב", 2), ("גד", 1)]), _ranked(spark, [("גד", 3), ("אב", 2)]), "case_id", F.lit(0.5)).collect()
    assert {r.candidate for r in got} == {"אב", "גד"}


def test_best_score(spark):
    rows = spark.createDataFrame([(1, "אב", -2.0, 1), (1, "אב", -1.0, 1), (1, "גד", -1.5, 1)], "case_id int, candidate string, score double, size int")
    top = fusion.ranked(candidates.best_score(rows, ["case_id"]), ["case_id"]).filter("rank = 0").first()
    assert (top.candidate, top.score, top["size"]) == ("אב", -1.0, 1)


def test_length_penalty(spark):
    rows = spark.createDataFrame([(1, "אב", -1.0, 1), (1, "אב גד", -1.2, 2)], "case_id int, candidate string, s double, size int")
    for p, first in ((0.0, "אב"), (1.0, "אב גד")):
        assert fusion.ranked(rows.withColumn("score", F.col("s") + p * F.col("size")), ["case_id"]).filter("rank = 0").first().candidate == first


def test_beam(spark):
    model = spark.createDataFrame([("a", "b", -0.1), ("a", "c", -0.5), ("b", "b", -0.1), ("b", "d", -0.2), ("c", "e", -0.1)], "w1 string, candidate string, score double")
    start = spark.createDataFrame([(1, "a")], "k int, lw string")
    got = [(r.phrase, r.score) for r in candidates.beam(start, model, "k", 2, 2).orderBy("rank").collect()]
    assert got == [("b d", -0.3), ("c e", -0.6)]
    assert candidates.beam(start, model, "k", 2, 1, repeat=True).first().phrase == "b b"


def test_summary_counts_misses(spark):
    ranks = spark.createDataFrame([("s", 0), ("s", 4), ("s", None), ("s", 9)], "system string, gold_rank int")
    row = metrics.summary(ranks, ["system"]).first()
    assert (row.n, row.top1, row.top5, row.top10, row.coverage, row.median_rank) == (4, 25.0, 50.0, 75.0, 75.0, 4.0)


def test_splits(spark):
    groups = spark.createDataFrame([(f"g{i}",) for i in range(20)], "source string")
    split = splits.group_split(groups, "source")
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"heldout": 6, "dev": 2, "train": 12}
    assert all(r.n_common == 0 for r in splits.overlaps(split, "source").collect())
    with pytest.raises(ValueError, match="unknown split"):
        splits.in_split(split, "nowhere")
    single = splits.group_split(groups.limit(1), "source").collect()
    assert [r["split"] for r in single] == ["heldout"]


def test_greedy_disjoint(spark):
    docs = spark.createDataFrame([(i, " ".join(["אב"] * 20)) for i in range(6)], "item_id long, text string")
    spans = sequences.spans(sequences.with_words(docs), ["item_id"], 2, 2)
    got = splits.greedy_disjoint(spans, "item_id", "n_words", ["start"], 2, 2).collect()
    assert len(got) == 4 and len({r.item_id for r in got}) == 4


def test_fingerprint_ignores_order(spark):
    rows = [("a", "x"), ("b", "y")]
    digest = lambda r: validation.fingerprint(spark.createDataFrame(r, "id string, gold string"), "id", "gold").first().sha256
    assert digest(rows) == digest(rows[::-1]) != digest([("a", "x"), ("b", "z")])


def test_augmenters(spark):
    docs = sequences.with_words(spark.createDataFrame([(i, "one two three four five six seven eight nine ten") for i in range(200)], "doc_id long, text string"))
    left = augment.word_dropout(docs, "doc_id", 0.2).filter("augmented is not null")
    assert 0 < left.filter("size(augmented) >= 10").count() + left.count() and left.filter("size(augmented) >= 10").count() == 0
    share = augment.span_mask(docs, "doc_id").agg(F.avg(F.size("masked_at") / 10)).first()[0]
    assert 0.08 < share < 0.2
    masked = augment.scatter_mask(docs, "doc_id", ["xx"])
    assert masked.filter(F.size("masked") != F.size("labels")).count() == 0
    assert augment.substitution(docs, "doc_id", {"one": "uno"}, 1.0).first().augmented[0] == "uno"
    gone = augment.noise(docs, "doc_id", 0.25).agg(F.avg(F.size(F.filter("noisy", lambda w: w == X.GAP)))).first()[0]
    assert 2 < gone < 3


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"scroll": "s", "split": "dev", "chunk_index": 1, "text": "t", "n_units": 1, "n_preserved_words": 1, "n_gap_slots": 0}\n\n', encoding="utf-8")
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), files.CHUNKS).count() == 1
    (tmp_path / "b.csv").write_text('x,y\n1,\n"a ""q""\nb",2\n', encoding="utf-8")
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "b.csv"), ["x", "y"]).collect()) == [("1", ""), ('a "q"\nb', "2")]
    (tmp_path / "m.txt").write_text("heldout:\n  base  1=12.0 5=19.3\ndev:\n  base  1=1\n", encoding="utf-8")
    got = {(r.section, r.label, r.bucket, r.value) for r in files.sectioned_metrics(spark, str(tmp_path / "m.txt")).collect()}
    assert got == {("heldout", "base", "1", 12.0), ("heldout", "base", "5", 19.3), ("dev", "base", "1", 1.0)}
    (tmp_path / "s.json").write_text('{"scroll_splits": {"dev": ["a"], "train": ["b", "c"]}}', encoding="utf-8")
    assert files.split_manifest(spark, str(tmp_path / "s.json")).count() == 3
    assert "| a |" in files.markdown_table(spark.createDataFrame([(1,)], "a int"))
    out = str(tmp_path / "out")
    files.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), out)
    assert '"b":null' in spark.read.text(out).first()[0]
    assert files.digests(spark, str(tmp_path / "s.json")).first().length > 0
    assert spark.range(1).select(F.lit("{'a': 1, 'b c': 2.5}").alias("t")).select(files.dict_literal("t").alias("m")).first().m == {"a": 1.0, "b c": 2.5}


def test_html():
    assert html.blocks("<ul><li class='q x'>a <b>b</b></li><li>c</li></ul><p>d<script>e</script></p>") == [("entry", "a b"), ("entry", "c"), ("paragraph", "d")]
    assert html.blocks("<li class='q'>a</li><li>c</li>", "q") == [("entry", "a")]


def test_strided_spans(spark):
    docs = sequences.with_words(spark.createDataFrame([(1, "aa bb cc d ee ff gg hh")], "doc_id long, text string"))
    got = [(r.start, r.n_words, r.gold) for r in sequences.strided_spans(docs, ["doc_id"], (1, 2), 1, 3).orderBy("start", "n_words").collect()]
    assert got == [(1, 1, "bb"), (1, 2, "bb cc"), (4, 1, "ee"), (4, 2, "ee ff")]


def test_fetch_guards():
    import io

    from scriptmend.sources import http

    class Answer(io.BytesIO):
        url = "https://host/data/x"

        def geturl(self):
            return self.url

    class Elsewhere(Answer):
        url = "https://other/x"

    tries = []

    def flaky(url):
        tries.append(url)
        if len(tries) < 3:
            raise OSError("down")
        return Answer(b'{"a": 1}')

    assert http.fetch_json("https://host/data", "x y", opener=flaky, pause=lambda s: None) == {"a": 1}
    assert tries == ["https://host/data/x%20y"] * 3
    for path in ("../x", "a/%2e%2e/b", "https://other/x"):
        with pytest.raises(ValueError, match="unsafe"):
            http.safe_url("https://host", path)
    with pytest.raises(ValueError, match="another host"):
        http.fetch("https://host", "x", opener=lambda u: Elsewhere(b""))
    with pytest.raises(ValueError, match="over 3"):
        http.fetch("https://host", "x", most=3, opener=lambda u: Answer(b"long"))
    with pytest.raises(ValueError, match="digest"):
        http.fetch_pinned("https://host", "x", "0", opener=lambda u: Answer(b"a"))
