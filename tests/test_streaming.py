"""Streams of telemetry and merged batches."""

import datetime as dt

from lodestone.sources.files import upsert
from lodestone.streaming import usage as SU


def test_windowed_and_sessions(spark, tmp_path):
    t = dt.datetime(2025, 1, 1, 10)
    data = [(1, "a", 1, 2, 3, True, t), (1, "a", 1, 2, 3, True, t), (2, "a", 1, 2, 3, False, t + dt.timedelta(hours=1)), (3, "b", 1, 2, 3, True, t + dt.timedelta(days=1)), (4, "a", 1, 2, 3, True, t + dt.timedelta(days=5))]
    spark.createDataFrame(data, SU.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, plan in (("w", SU.windowed), ("s", SU.sessions)):
        q = plan(SU.read(spark, str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
    w = {(r["tool"], r["day"].day): (r["calls"], r["failures"]) for r in spark.table("w").collect()}
    assert w[("a", 1)] == (2, 1) and w[("b", 2)] == (1, 0)
    assert spark.table("s").where("tool = 'a'").count() >= 2


def test_upsert_batches(spark, tmp_path):
    schema = "repo_id string, file_path string, hash string"
    for i, part in enumerate(([("r", "a", "1"), ("r", "b", "1")], [("r", "a", "2")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        SU.upsert_batches(stream, str(tmp_path / "out"), ["repo_id", "file_path"], str(tmp_path / "ck"), upsert).awaitTermination(120)
    got = {(r["file_path"], r["hash"]) for r in spark.read.parquet(str(tmp_path / "out" / "v=1")).collect()}
    assert got == {("a", "2"), ("b", "1")}
