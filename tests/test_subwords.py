"""Pieces against a plain longest match, and the growing beam on hand-made models and against a plain loop."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptmend.operators import growing
from scriptmend.operators import pieces as P


def longest_match(word, known):
    out, at = [], 0
    while at < len(word):
        found = [w for n in range(len(word), at, -1) if (w := ("##" if at else "") + word[at:n]) in known]
        if not found:
            return ["[UNK]"]
        out.append(found[0])
        at += len(found[0]) - 2 * (at > 0)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=4)), st.lists(st.text("abc", min_size=1, max_size=3)), st.lists(st.text("abcd", min_size=1, max_size=9), min_size=1))
def test_trie_is_longest_match(first, inner, asked):
    known = {*first, *("##" + x for x in inner), "a", "b", "##a"}
    for memo in (P.MEMO_CHARS, 10):
        split = P.Splitter(sorted(known), memo)
        assert [split(w) for w in asked] == [longest_match(w, known) for w in asked]


def test_vocabulary(spark):
    counted = spark.createDataFrame([("aba", 3), ("ab", 1), ("cab", 2), ("", 9)], "word string, n long")
    got = {r.piece: r.n for r in P.vocabulary(counted, size=2, longest=3).collect()}
    # letters in both forms; of longer strings the two that save most: aba 3 * 2, ab 4 or cab 2 * 2, ca 2
    assert got == {"a": 4, "c": 2, "##a": 5, "##b": 6, "aba": 3, "ab": 4, "##ba": 3, "##ab": 2}


def test_split_words(spark):
    pieces = spark.createDataFrame([(p,) for p in ("a", "ab", "##b", "##ba")], "piece string")
    rows = spark.createDataFrame([(1, ["abba", "a", "x"], "k"), (2, [], "k"), (3, None, "k"), (4, ["a" + "b" * 100_000], "k"), (1, ["a"], "k")], "id int, ws array<string>, pieces string")
    got = {(r.id, len(r.pieces)): (r.pieces[:5], r.word_ids[:5]) for r in P.split_words(rows, pieces, keep=["id"]).collect()}
    assert got[1, 4] == (["ab", "##ba", "a", "[UNK]"], [0, 0, 1, 2])
    assert got[2, 0] == got[3, 0] == ([], []) and got[1, 1] == (["a"], [0])
    assert got[4, 100_000][0] == ["ab", "##b", "##b", "##b", "##b"]
    aligned = P.alignment(P.split_words(rows.filter("id = 1 and size(ws) = 3"), pieces, keep=["id"]), "id").collect()
    assert sorted(tuple(r) for r in aligned) == [(1, 0, 0, "ab"), (1, 1, 0, "##ba"), (1, 2, 1, "a"), (1, 3, 2, "[UNK]")]
    assert P.split_words(rows.limit(0), pieces).collect() == []


def test_joined(spark):
    df = spark.createDataFrame([(["ab", "##c", "d"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(P.joined(F.col("p"))).collect()] == ["abc d", ""]


def test_a_piece_opens_a_further_slot(spark):
    model = spark.createDataFrame([("x", "ab", -1.0), ("ab", "##c", -0.5), ("ab", "d", -3.0), ("##c", "##c", -2.0), ("##c", "e", -0.25), ("x", "##z", -0.1)], "p1 string, candidate string, score double")
    cases = spark.createDataFrame([(1, "x", 2), (2, "x", 1), (3, "unknown", 2), (4, "x", 0)], "case_id long, last string, slots int")
    got = sorted(tuple(r) for r in growing.growing_beam(cases, model, width=2).collect())
    # the first piece begins a word although ##z is likelier; ab ##c e fills three slots in place of two, ab ##c ##c e four
    assert got == [(1, "abc e", -1.75, 3, 0, 0), (1, "abcc e", -3.75, 4, 0, 1), (2, "ab", -1.0, 1, 0, 0), (4, "", 0.0, 0, 0, 0)]


def test_a_beam_that_never_closes_ends(spark):
    model = spark.createDataFrame([("x", "a", -1.0), ("a", "##b", -1.0), ("##b", "##b", -1.0)], "p1 string, candidate string, score double")
    cases = spark.createDataFrame([(1, "x", 2)], "case_id long, last string, slots int")
    got = growing.growing_beam(cases, model, rounds_a_slot=3).collect()
    assert [tuple(r) for r in got] == [(1, "a" + "b" * 5, -6.0, 6, 1, 0)]
    assert growing.growing_beam(cases.limit(0), model).collect() == []


def plain_beam(cases, model, width, rounds):
    out = []
    for key, last, slots in cases:
        beams = [(0.0, "", last, slots, 0)]
        for _ in range(rounds * max(s for *_, s in cases)):
            grown = []
            for score, phrase, end, left, n in beams:
                if not left:
                    grown.append((score, phrase, end, left, n))
                    continue
                for c, s in model.get(end, ()):
                    if c.startswith("##") and n:
                        grown.append((round(score + s, 6), phrase + c[2:], c, left, n + 1))
                    elif not c.startswith("##"):
                        grown.append((round(score + s, 6), (phrase + " " + c).strip(), c, left - 1, n + 1))
            beams = sorted(grown, key=lambda b: (-b[0], b[1]))[:width]
        out += [(key, p, s, n, left, k) for k, (s, p, _, left, n) in enumerate(beams)]
    return sorted(out)


def test_growing_beam_is_a_plain_loop(spark):
    rng = random.Random(4)
    known = ["a", "b", "cd", "##e", "##f", "##gh"]
    model = {p: [(c, -round(rng.uniform(0.1, 3), 6)) for c in rng.sample(known, 4)] for p in known}
    cases = [(k, rng.choice(known), rng.randrange(1, 4)) for k in range(20)]
    table = spark.createDataFrame([(p, c, s) for p, cs in model.items() for c, s in cs], "p1 string, candidate string, score double")
    got = growing.growing_beam(spark.createDataFrame(cases, "case_id long, last string, slots int"), table, width=3, rounds_a_slot=2).collect()
    assert sorted(tuple(r) for r in got) == plain_beam(cases, model, 3, 2)
