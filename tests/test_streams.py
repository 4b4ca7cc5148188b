"""Streams against results worked out by hand."""

from __future__ import annotations

import datetime as dt

from panelkit.streaming import ingest as s

DAY = dt.datetime(2024, 1, 1)
HOUR, MICRO = dt.timedelta(hours=1), dt.timedelta(microseconds=1)


def test_sessions_part_at_more_than_the_gap(spark, frame, tmp_path):
    """A silence of exactly the gap stays inside; readings of a series that lie in several files meet."""
    ends = [DAY, DAY + 2 * HOUR, DAY + 4 * HOUR + MICRO, DAY + 5 * HOUR]
    far = DAY + dt.timedelta(days=60)
    rows = [("a", t, 1.0) for t in ends] + [("b", DAY + i * HOUR, 1.0) for i in range(50)] + [("~end", far, 0.0)]
    readings = frame("series_id string, ts timestamp, y double", rows)
    readings.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = s.file_stream(spark, f"{tmp_path}/in", readings.schema, "*.parquet")
    got = s.run_once(s.gap_sessions(stream, "2 hours", "1 day"), "sessions")
    assert {tuple(r) for r in got.collect()} == {
        ("a", 2, ends[0], ends[1]),
        ("a", 2, ends[2], ends[3]),
        ("b", 50, DAY, DAY + 49 * HOUR),
    }


def test_sessions_are_merged_before_the_shuffle(spark, frame, tmp_path):
    """Neither Python nor state for each series' readings: a task hands on its sessions."""
    readings = frame("series_id string, ts timestamp, y double", [(f"u{i % 3}", DAY + i * HOUR, 1.0) for i in range(300)])
    readings.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = s.gap_sessions(s.file_stream(spark, f"{tmp_path}/in", readings.schema, "*.parquet"), "48 hours", "1 day")
    with s.stream_conf(spark):
        query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    states = [o for p in query.recentProgress for o in p["stateOperators"]]
    assert {o["operatorName"] for o in states} == {"sessionWindowStateStoreSaveExec"}
    assert max(o["numRowsTotal"] for o in states) == 3
