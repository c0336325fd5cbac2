"""Streams of queries and events against their batch results."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from strandline.streaming import streams


def test_query_stream_equals_batch(spark, tmp_path):
    store = spark.createDataFrame([("A", "c", 1, 100), ("B", "c", 90, 300), ("C", "d", 1, 9)], "label string, div string, low long, high long")
    lines = ["c:95..96", "c:200", "d:5..1", "C", "nothing", "c:400..500"]
    (tmp_path / "in").mkdir()
    for i in range(0, 6, 2):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(lines[i : i + 2]) + "\n")
    got = streams.drain(streams.answer(streams.query_stream(spark, str(tmp_path / "in"), 1), store, 16), "answers")
    want = streams.answer(spark.createDataFrame([(x,) for x in lines], "query string"), store)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5
    text = {r.value for r in streams.framed(got).collect()}
    assert "# Query: c:95..96\n>A c:1..100\n>B c:90..300\n# End" in text


def events(spark, folder):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(60)]
    rows += [(5, start + timedelta(minutes=36), 2, "b", 5.0)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    frame.coalesce(1).write.parquet(folder)
    return frame, spark.readStream.schema(frame.schema).parquet(folder)


def test_windows_sessions_and_duplicates(spark, tmp_path):
    batch, stream = events(spark, str(tmp_path / "e"))
    got = {(r.start, r.event_type): (r.n, r.total) for r in streams.drain(streams.windowed_counts(stream), "windows").collect()}
    want = {(r.w.start, r.event_type): (r.n, r.t) for r in batch.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("t")).collect()}
    assert got and got.items() <= want.items()
    assert streams.drain(streams.first_seen(stream, ("event_id",)), "firsts").count() == 60
    runs = streams.drain(streams.sessions(stream, "25 minutes", "5 minutes"), "sessions").collect()
    assert all(r.n >= 1 and r.end > r.start for r in runs)
