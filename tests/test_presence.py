"""Presence as a stream with timers tells what its batch twin tells up to each watermark."""

import datetime as dt
import random

from pyspark.sql import functions as F

from brindle.session import table
from brindle.streaming import monitors as M

SF = "/root/testdata/sf0.001"
SCHEMA = "project_id string, user_id int, ts timestamp"
START = dt.datetime(2024, 1, 1)


def minutes(*rows):
    return [(p, u, START + dt.timedelta(seconds=s)) for p, u, s in rows]


def test_stream_equals_batch_at_every_watermark(spark, tmp_path):
    rng = random.Random(2)
    folder, seen, at = tmp_path / "in", [], 0
    folder.mkdir()
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(SCHEMA).parquet(str(folder))
    changes = M.presence_changes(stream, seconds=120, late="5 minutes")
    q = changes.writeStream.format("memory").queryName("presence_told").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for _ in range(5):
            rows = minutes(*((rng.choice("ab"), rng.randint(1, 4), at + rng.randint(0, 500) - 200) for _ in range(12)))
            rows += minutes(("a", 9, at + 500), ("a", 9, at + 500))
            at += 500
            seen += rows
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
            q.processAllAvailable()
            until = max(t for _, _, t in seen) - dt.timedelta(minutes=5)
            want = M.presence_changes(spark.createDataFrame(seen, SCHEMA), seconds=120, until=until)
            got = spark.table("presence_told")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert {r.change for r in got.collect()} == {"joined", "left"} and got.count() > 15
        spark.createDataFrame(minutes(("late", 1, 0)), SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        q.processAllAvailable()
        assert got.filter("project_id = 'late'").count() == 0
        assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) < 9
    finally:
        q.stop()


def test_batch(spark):
    rows = minutes(("p", 1, 0), ("p", 1, 60), ("p", 1, 60), ("p", 1, 181), ("p", 2, 5), ("p", 1, 400), ("p", None, 1)) + [("p", 3, None)]
    d = M.presence_changes(spark.createDataFrame(rows, SCHEMA), seconds=120)
    got = sorted((r.user_id or 0, int((r.at - START).total_seconds()), r.change) for r in d.collect())
    assert got == [(0, 1, "joined"), (0, 121, "left"), (1, 0, "joined"), (1, 180, "left"), (1, 181, "joined"), (1, 301, "left"), (2, 5, "joined"), (2, 125, "left")]
    assert M.presence_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    e = table(spark, SF, "events")
    n = M.presence_changes(e, ("event_type", "user_id"), seconds=86_400).groupBy("change").agg(F.count("*")).collect()
    assert {r[0] for r in n} == {"joined", "left"}
