"""Registry of the named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analysis, control, corpus, lookup, measures, protocol, ranking, relational, scoring, subwords

FLAGSHIP = "parallel_lookup"

QUERIES = corpus.QUERIES | lookup.QUERIES | ranking.QUERIES | relational.QUERIES | analysis.QUERIES | measures.QUERIES | subwords.QUERIES | scoring.QUERIES | protocol.QUERIES | control.QUERIES | {"char_beam": (ranking.char_beam, measures.CHAR_BEAM)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
