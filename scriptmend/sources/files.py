"""File sources and sinks with explicit schemas."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNKS = "scroll STRING, split STRING, chunk_index INT, text STRING, n_units INT, n_preserved_words INT, n_gap_slots INT"
LACUNAE = "scroll STRING, split STRING, gap_index INT, gap_word_count_estimate INT, gap_word_count_basis STRING, missing_char_count_estimate INT, visible_patterns ARRAY<STRING>, left_context ARRAY<STRING>, right_context ARRAY<STRING>, source_word_nodes ARRAY<BIGINT>, estimate_sources ARRAY<STRING>"
VERSES = "name STRING, verse_idx INT, verse STRING, missing_dictionary MAP<STRING,STRING>"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with explicit nulls."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, all strings; an empty field is an empty string."""
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON document per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def to_document(df: DataFrame) -> DataFrame:
    """A JSON string of each row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def checked(df: DataFrame, rows: int) -> DataFrame:
    """The same rows, or an error if there are not exactly ``rows``."""
    found = df.count()
    if found != rows:
        raise ValueError(f"expected {rows} rows, found {found}")
    return df


def reuse(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written first if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.parquet(path)
    return spark.read.parquet(path)


def split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """scroll, split from a manifest's scroll_splits."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "scroll_splits MAP<STRING,ARRAY<STRING>>").alias("m"))
    return doc.select(F.explode("m.scroll_splits").alias("split", "names")).select(F.explode("names").alias("scroll"), "split")


def sectioned_metrics(spark: SparkSession, path: str) -> DataFrame:
    """section, label, bucket, value from a text report: a line ending in ``:`` opens a section, ``label  bucket=value ...`` fills it.

    Lines are numbered within one small file, which is read whole.
    """
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    section = F.last(F.when(F.trim("line").endswith(":"), F.rtrim(F.trim("line"), F.lit(":"))), ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = whole.withColumn("section", section).filter(F.col("line").contains("="))
    pairs = F.arrays_zip(F.regexp_extract_all("line", F.lit(r"(\S+?)=(\S+)"), F.lit(1)).alias("bucket"), F.regexp_extract_all("line", F.lit(r"(\S+?)=(\S+)"), F.lit(2)).alias("value"))
    return rows.select("section", F.regexp_extract("line", r"^\s*([^=]*?)\s+\S+=", 1).alias("label"), F.explode(pairs).alias("p")).select("section", "label", "p.bucket", F.expr("try_cast(p.value AS double)").alias("value"))


def dict_literal(column: str) -> Column:
    """Map of the ``'key': number`` pairs in a text."""
    pattern = F.lit(r"'([^']+)':\s*(-?\d+(?:\.\d+)?)")
    return F.map_from_arrays(F.regexp_extract_all(column, pattern, F.lit(1)), F.transform(F.regexp_extract_all(column, pattern, F.lit(2)), lambda x: x.cast("double")))


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report's table as Markdown; for metrics, of which there are few: over ``most`` rows is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    show = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line([show(x) for x in r]) for r in rows)]) + "\n"


def manifest(counts: DataFrame, parameters: dict) -> str:
    """A manifest as JSON: schema version, parameters, counts by name."""
    return json.dumps({"schema_version": 1, "parameters": parameters, "counts": {r[0]: r[1] for r in counts.collect()}}, ensure_ascii=False, indent=2)


def report(title: str, sections: dict[str, DataFrame], notes: dict[str, str] | None = None) -> str:
    """A report in Markdown: a title, and for each section its note and its table."""
    parts = [f"# {title}"]
    for name, df in sections.items():
        note = (notes or {}).get(name)
        parts += [f"## {name}", *([note] if note else []), markdown_table(df).rstrip("\n")]
    return "\n\n".join(parts) + "\n"


def write_site(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as JSON lines in a folder of its own, nulls kept."""
    for name, df in tables.items():
        write_jsonl(df, f"{folder}/{name}")


def read_site(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Those tables again, registered as views of their names."""
    out = {name: read_jsonl(spark, f"{folder}/{name}", schema) for name, schema in schemas.items()}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text: files as they are."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def link(base: str, *parts: Column, **query: Column) -> Column:
    """An address under ``base``: path parts and query values are escaped; a null part or value gives null."""
    path = F.concat(F.lit(base.rstrip("/")), *(F.concat(F.lit("/"), F.replace(F.url_encode(p.cast("string")), F.lit("+"), F.lit("%20"))) for p in parts))
    pairs = [F.concat(F.lit(f"{'&' if i else '?'}{k}="), F.url_encode(v.cast("string"))) for i, (k, v) in enumerate(query.items())]
    return F.concat(path, *pairs) if pairs else path
