r"""Annotated text graphs in plain feature files, one ``<feature>.tf`` a column.

A file begins with lines that start with ``@`` and a blank line. A node feature then has a line for each node:
``value``, or ``nodes<TAB>value``, where ``nodes`` is a number, a range ``a-b``, or several of them with commas; a line
without nodes goes to the node after the last one named. An edge feature has ``from<TAB>to``, or ``to`` alone.
``\t``, ``\n`` and ``\\`` in values are escaped. Only the files of the features asked for are read. Numbers run on
through a file, so a file is one task and its rows stream; features are read side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = 65_536
_ESCAPES = {r"\t": "\t", r"\n": "\n", "\\\\": "\\"}


def _ranges(spec: str) -> Iterator[tuple[int, int]]:
    for part in spec.split(","):
        a, _, b = part.partition("-")
        yield int(a), int(b or a)


def _plain(value: str) -> str:
    return re.sub(r"\\[tn\\]", lambda m: _ESCAPES[m.group()], value) if "\\" in value else value


def _body(content: str) -> Iterator[str]:
    """Lines after the head; only ``\\n`` ends a line."""
    lines = iter(content.split("\n") if content else [])
    head = True
    held = None
    for line in lines:
        if head:
            head = line.startswith("@")
            if head or line == "":
                continue
        if held is not None:
            yield held
        held = line
    if held:
        yield held


def node_rows(content: str) -> Iterator[tuple[int, int, str]]:
    """first, last, value: nodes of a feature, as ranges."""
    last = 0
    for line in _body(content):
        spec, tab, value = line.partition("\t")
        for a, b in _ranges(spec) if tab else [(last + 1, last + 1)]:
            yield a, b, _plain(value if tab else spec)
            last = b


def edge_rows(content: str) -> Iterator[tuple[int, int, int]]:
    """node, first, last: edges of a feature, as ranges of nodes reached."""
    last = 0
    for line in _body(content):
        spec, tab, to = line.partition("\t")
        sources = list(_ranges(spec)) if tab else [(last + 1, last + 1)]
        for a, b in sources:
            for n in range(a, b + 1):
                yield from ((n, c, d) for c, d in _ranges((to if tab else spec).split("\t")[0]))
            last = b


def _read(spark: SparkSession, folder: str, features: Sequence[str], rows, kinds: tuple, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").load([f"{folder}/{f}.tf" for f in features]).select(F.regexp_extract("path", r"([^/]+)\.tf$", 1).alias("feature"), "content")
    names = ["feature", *(p.split()[0] for p in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for feature, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = []
                for row in rows(content.as_py().decode("utf-8")):
                    held.append(row)
                    if len(held) == _BATCH:
                        yield told(feature, held)
                        held = []
                if held:
                    yield told(feature, held)

    def told(feature: str, held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([feature] * len(held)), *(pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True))], names=names)

    return files.repartition(len(features)).mapInArrow(run, "feature string, " + schema)


def nodes(spark: SparkSession, folder: str, features: Sequence[str]) -> DataFrame:
    """node and a column for each feature; a node that lacks one has null there."""
    rows = _read(spark, folder, features, node_rows, (pa.int64(), pa.int64(), pa.string()), "first long, last long, value string")
    single = rows.select("feature", F.explode(F.sequence("first", "last")).alias("node"), "value")
    return single.groupBy("node").agg(*(F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features))


def edges(spark: SparkSession, folder: str, feature: str) -> DataFrame:
    """node, reached, as single nodes."""
    rows = _read(spark, folder, [feature], edge_rows, (pa.int64(), pa.int64(), pa.int64()), "node long, first long, last long")
    return rows.select("node", F.explode(F.sequence("first", "last")).alias("reached"))


def typed(graph: DataFrame, kind: str) -> DataFrame:
    """Nodes of one type (feature ``otype``)."""
    return graph.filter(F.col("otype") == kind)


def contained(inner: DataFrame, outer: DataFrame, slots: DataFrame, up: str) -> DataFrame:
    """inner, and ``up``: the node of ``outer`` that holds all its slots; who is in none is dropped.

    ``slots`` has the edges from nodes to slots (feature ``oslots``); a node without edges is a slot, and holds itself.
    """
    own = inner.select("node").join(slots, "node", "left").select("node", F.coalesce("reached", "node").alias("slot"))
    over = outer.select(F.col("node").alias(up)).join(slots.withColumnRenamed("node", up), up).select(up, F.col("reached").alias("slot"))
    size = own.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    met = own.join(over, "slot").groupBy("node", up).agg(F.count(F.lit(1)).alias("n"))
    return inner.join(met.join(size, "node").filter("n = size").select("node", up), "node")
