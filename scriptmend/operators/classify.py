"""Classes of misses, spans and cases: ordered conditions, the first that holds wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISSUES = {"particle_or_too_short": "short function word", "rare_or_unseen": "rare or unseen word", "same_length_semantic": "plausible word of the same length", "other": "other"}


def miss_class(gold: Column, candidates: Column, frequency: Column) -> Column:
    """Class of a single-word case by its gold word, its ranked candidates and the word's frequency."""
    return (
        F.when(F.get(candidates, F.lit(0)) == gold, "hit")
        .when(F.length(gold) <= 2, "particle_or_too_short")
        .when(F.coalesce(frequency, F.lit(0)) <= 3, "rare_or_unseen")
        .when(F.exists(candidates, lambda c: F.length(c) == F.length(gold)), "same_length_semantic")
        .otherwise("other")
    )


def failure_class(gold: Column, candidates: Column, surface: Column, lemma: Column, particle: Column) -> Column:
    """Seven classes of failures."""
    close = F.exists(candidates, lambda c: (F.length(c) == F.length(gold)) & (F.levenshtein(c, gold) <= 2))
    return (
        F.when(F.size(candidates) == 0, "empty")
        .when(particle, "particle_or_split")
        .when(F.length(gold) < 3, "too_short")
        .when((F.coalesce(surface, F.lit(0)) == 0) & (F.coalesce(lemma, F.lit(0)) == 0), "unseen_lexeme")
        .when(F.coalesce(surface, F.lit(0)) == 0, "seen_lemma_unseen_form")
        .when(close, "orthographic_or_morph")
        .otherwise("semantic_or_ambiguous")
    )


def span_status(top1: Column, top5: Column) -> Column:
    """Status of a span from its slots' hits (arrays of booleans)."""
    yes = lambda x: x
    return F.when(F.forall(top1, yes), "all_top1").when(F.forall(top5, yes), "all_top5").when(F.exists(top5, yes), "partial").otherwise("none")


def issue(klass: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ISSUES.items() for x in kv)), klass), F.lit("other"))


def short_top(top: Column, gold: Column) -> Column:
    return F.length(top) + 1 < F.length(gold)


def length_penalty(score: Column, candidate: Column, expected: Column, function_words: list[str]) -> Column:
    """Heuristic rescoring: distance from the expected length, and a malus for short function words."""
    return score - 0.35 * F.abs(F.length(candidate) - expected) - F.when(candidate.isin(function_words), 0.5).otherwise(0.0)


def suppressed(score: Column, candidate: Column, left: Column, right: Column, particles: list[str]) -> Column:
    """A particle next to a particle loses 5."""
    beside = F.coalesce(left.isin(particles), F.lit(False)) | F.coalesce(right.isin(particles), F.lit(False))
    return score - F.when(candidate.isin(particles) & beside, 5.0).otherwise(0.0)


def slot_class(gold: Column, candidates: Column, frequency: Column, form=lambda c: c) -> Column:
    """Class of one slot of a phrase; ``form`` is the form in which words are compared."""
    first = F.get(candidates, F.lit(0))
    return (
        F.when(F.size(candidates) == 0, "empty")
        .when(form(first) == form(gold), "exact_top1_hit")
        .when(F.exists(candidates, lambda c: form(c) == form(gold)), "exact_top5_hit")
        .when((first != "") & (F.length(first) <= F.greatest(F.lit(1), F.length(gold) - 2)), "particle_or_too_short")
        .when(F.coalesce(frequency, F.lit(0)) <= 1, "rare_or_unseen")
        .when(F.exists(candidates, lambda c: F.length(c) == F.length(gold)), "same_length_semantic")
        .otherwise("other_miss")
    )
