from __future__ import annotations

import shutil

from pyspark.sql import functions as F

from scriptmend.streaming import events as E

from .conftest import SMALL


def test_stream_equals_batch(spark, tmp_path):
    shutil.copy(f"{SMALL}/events.parquet", tmp_path / "events.parquet")
    batch = spark.read.schema(E.EVENTS).parquet(str(tmp_path / "events.parquet")).withColumn("time", F.col("ts").cast("timestamp"))
    for name, form in (("tumbling", E.tumbling_counts), ("sessions", E.sessions)):
        query = form(E.read_events(spark, str(tmp_path))).writeStream.format("memory").queryName(name).outputMode("complete" if name == "tumbling" else "append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        got = spark.table(name).count()
        want = form(batch).count()
        assert 0 < got <= want
        assert name == "sessions" or got == want
