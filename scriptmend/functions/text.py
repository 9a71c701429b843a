"""Column functions over words, readings and markup."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAP = "<GAP>"
# Letters, their final and medial forms, spellings and one-letter prefixes that results depend on.
LETTERS = "א-ת"
FINALS, MEDIALS = "ךםןףץ", "כמנפצ"
SPELLINGS = (("כיא", "כי"), ("לוא", "לא"), ("כול", "כל"))
PREFIXES = "ובכלמשה"
DIVINE = ("יהוה", "אלהימ", "אלהים", "אל", "אדני")


def words(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def split_words(text: Column) -> Column:
    """Blank-separated words, none for a blank text."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def letters(value: Column) -> Column:
    """Hebrew letters only; null is empty."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), f"[^{LETTERS}]", "")


def medial(value: Column) -> Column:
    return F.translate(value, FINALS, MEDIALS)


def retrieval_form(value: Column) -> Column:
    """Letters with medial forms; the first spelling that ends the word is shortened."""
    v = medial(letters(value))
    out = v
    for long, short in reversed(SPELLINGS):
        out = F.when(v.endswith(long), F.concat(F.substring(v, F.lit(1), F.length(v) - len(long)), F.lit(short))).otherwise(out)
    return out


def lemma_form(lemma: Column) -> Column:
    """A lemma with medial forms; divine names are one class, three spellings are shortened as whole words."""
    v = medial(lemma)
    out = F.when(lemma.isin(*DIVINE) | v.isin(*DIVINE), F.lit("DIVINE"))
    for long, short in SPELLINGS:
        out = out.when(v == long, F.lit(short))
    return out.otherwise(v)


def loose_form(word: Column) -> Column:
    """Medial forms without inner vowel letters, for words of over two letters."""
    v = medial(word)
    inner = F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), "[וי]", "")
    return F.when(v.isin(*DIVINE), F.lit("DIVINE")).when(F.length(v) > 2, F.concat(F.left(v, F.lit(1)), inner, F.right(v, F.lit(1)))).otherwise(v)


def is_word(value: Column) -> Column:
    return value.rlike(f"^[{LETTERS}]{{2,}}$")


def is_token(value: Column) -> Column:
    return value.rlike(f"^[{LETTERS}]+$")


def is_content(value: Column, function_words: list[str]) -> Column:
    return (F.length(value) >= 3) & ~value.isin(function_words)


def hebrew_runs(text: Column) -> Column:
    """Runs of two or more letters."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]+"), F.lit(0)), lambda w: F.length(w) > 1)


def canonical_key(value: Column) -> Column:
    """ASCII letters and digits, lower case."""
    return F.lower(F.regexp_replace(value, "[^0-9A-Za-z]", ""))


def slot_count(value: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(value, F.lit("")), f"[^{LETTERS}○]", ""))


def without_brackets(value: Column) -> Column:
    return F.trim(F.translate(value, "[]()", ""))


def join_single_prefixes(text: Column, shortest: int = 3) -> Column:
    """A one-letter prefix is joined to a following word of ``shortest`` letters or more."""
    return F.regexp_replace(text, rf"(?<!\S)([{PREFIXES}]) (?=[{LETTERS}]{{{shortest},}}(?!\S))", "$1")


def n_joined(text: Column, shortest: int = 3) -> Column:
    return F.regexp_count(text, F.lit(rf"(?<!\S)[{PREFIXES}] (?=[{LETTERS}]{{{shortest},}}(?!\S))"))


def join_prefixes(parts: Column) -> Column:
    """Fold of an array: one-letter prefixes gather and go in front of the next whole word; a gap or the end lets them stand alone."""
    flush = lambda acc: F.when(acc["held"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["held"])))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(acc: Column, w: Column) -> Column:
        prefix = (F.length(w) == 1) & F.instr(F.lit(PREFIXES), w).cast("boolean")
        return (
            F.when(w == GAP, F.struct(F.concat(flush(acc), F.array(w)).alias("out"), F.lit("").alias("held")))
            .when(prefix, F.struct(acc["out"].alias("out"), F.concat(acc["held"], w).alias("held")))
            .otherwise(F.struct(F.concat(acc["out"], F.array(F.concat(acc["held"], w))).alias("out"), F.lit("").alias("held")))
        )

    return F.aggregate(parts, start, step, flush)


def redacted(raw: Column) -> Column:
    """A context word without conjecture: a gap where brackets or dashes hide letters, else its letters."""
    count = lambda c: F.length(raw) - F.length(F.replace(raw, F.lit(c), F.lit("")))
    hidden = raw.rlike(rf"\[[^\]]*[{LETTERS}]") | raw.contains("--") | (count("[") != count("]"))
    plain = letters(raw)
    return F.when(hidden | (plain == ""), F.lit(GAP)).otherwise(plain)


def restored(text: Column, missing: Column) -> Column:
    """``?`` at each position of the map is replaced by its character; a position without ``?``, or a ``?`` without position, is an error."""
    chars = F.split(text, "")
    bad = F.exists(F.map_keys(missing), lambda k: F.coalesce(F.get(chars, k.cast("int")), F.lit("")) != "?")
    marks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    fine = F.array_join(F.transform(chars, lambda c, i: F.coalesce(F.try_element_at(missing, i.cast("string")), c)), "")
    return F.when(bad | (marks != F.size(missing)), F.raise_error(F.concat(F.lit("expected a ? at each missing position: "), text))).otherwise(fine)


def boundary_positions(text: Column) -> Column:
    """0-based positions of blanks."""
    return F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(c == " ", i)), lambda i: i.isNotNull())


def boundary_f1(predicted: Column, gold: Column) -> Column:
    """F1 of blank positions; 1 where neither has any."""
    p, g = boundary_positions(predicted), boundary_positions(gold)
    both = F.size(F.array_intersect(p, g))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).otherwise(F.coalesce(F.try_divide(2.0 * both, (F.size(p) + F.size(g)).cast("double")), F.lit(0.0)))


def error_rate(predicted: Column, gold: Column) -> Column:
    return F.levenshtein(predicted, gold) / F.greatest(F.lit(1), F.length(gold))


def with_placeholder(parts: Column, at: Column, mark: str = "⬚⬚⬚") -> Column:
    return F.array_join(F.transform(parts, lambda w, i: F.when(i == at, F.lit(mark)).otherwise(w)), " ")


def wildcard_match(candidate: Column, pattern: Column, mark: str = "⬚") -> Column:
    """Same length, any letter at a mark, final forms folded; an empty pattern matches all."""
    return (pattern == "") | F.rlike(medial(candidate), F.concat(F.lit("^"), F.replace(medial(pattern), F.lit(mark), F.lit(".")), F.lit("$")))


def legal_prefix(text: Column, remaining: Column) -> Column:
    """No leading or double blank, and none at the end unless characters remain after the next."""
    return ~text.startswith(" ") & ~text.contains("  ") & ~(text.endswith(" ") & (remaining < 1))


def contains_all(columns: list[Column], query: str) -> Column:
    """Case-blind substring search over several columns."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower()))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def canonical(value: str | None) -> str | None:
    """Letters, ``?`` and single blanks of a text, without points and accents; a hyphen between words is a blank."""
    if value is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFD", value) if unicodedata.category(c) != "Mn")
    return " ".join(re.sub(f"[^{LETTERS}? ]", "", plain.replace("\u05be", " ")).split())


@F.pandas_udf(T.StringType())
def canonical_text(value: pd.Series) -> pd.Series:
    """``canonical`` over a column: decomposition has no built-in function."""
    return value.map(canonical)


def is_particle(word: Column, particles: list[str]) -> Column:
    """Whether a word, with medial forms, is in a closed list."""
    return medial(word).isin([p.translate(str.maketrans(FINALS, MEDIALS)) for p in particles])
