"""Streams with late, repeated and restarted input against the batch answer."""

import datetime as dt
import random

from veilspark.operators import control
from veilspark.streaming.control import admit_stream, count_stream

START = dt.datetime(2024, 5, 1, 12, 0, 0)
FILES = "queue string, id string, position long, size long, ts timestamp"


def run(stream, folder, name, mode):
    """One batch of all there is: with timeouts by processing time a stream always has another batch to run."""
    rows = []
    start = stream.writeStream.option("checkpointLocation", f"{folder}/{name}-state").outputMode(mode).foreachBatch(lambda df, _: rows.extend(df.collect()))
    start.trigger(once=True).start().awaitTermination()
    return rows


def test_admission_with_replays_and_restarts(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b"]), f"f{i}", i, rng.choice([5, 20, 60, 200]), START + dt.timedelta(seconds=i)) for i in range(60)]
    late = ("a", "too-late", 61, 1, START - dt.timedelta(hours=2))
    feed = tmp_path / "in"
    source = lambda: spark.readStream.schema(FILES).parquet(str(feed))
    parts = [rows[:20], rows[20:40] + rows[10:20], [*rows[40:], rows[39], late]]
    seen = []
    for part in parts:  # each part is a run of its own: the query is started anew from its checkpoint
        spark.createDataFrame(part, FILES).coalesce(1).write.mode("append").parquet(str(feed))
        seen += run(admit_stream(source(), "queue", "id", "position", "size", "ts", max_file=100, max_queue=300), tmp_path, "out", "append")
    got = {r["id"]: r["reason"] for r in seen}
    want = {r["id"]: r["reason"] for r in control.admit(spark.createDataFrame(rows, FILES), "queue", "position", max_file=100, max_queue=300).collect()}
    assert got == want and set(want.values()) == {None, "file-too-large", "queue-total-exceeded"}
    assert len(seen) == 60


def test_counters_count_each_event_once(spark, tmp_path):
    kind = "user string, event string, n int, ts timestamp"
    rows = [("u", f"e{i}", i % 4 - 1, START + dt.timedelta(seconds=i)) for i in range(30)] + [(None, "x", 2, START)]
    feed, seen = tmp_path / "in", []
    for part in (rows[:15], rows[10:], rows[:30]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(feed))
        seen += run(count_stream(spark.readStream.schema(kind).parquet(str(feed)), "user", "event", "n", "ts"), tmp_path, "count", "update")
    last = {r["user"]: (r["confirms"], r["spans_masked"]) for r in seen}
    assert last == {"u": (30, sum(max(0, r[2]) for r in rows[:30])), "": (1, 2)}
