"""Streams give what the batch operators give on the same rows."""

from __future__ import annotations

import json

import pytest
from build import AS_OF, at, dicts, events
from pyspark.sql import functions as F

from tallyroom.operators.rollup import compact_partials, rollup_daily_stats, stats_from_partials
from tallyroom.streaming import ingest, windows


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def drop_stamp(rows):
    return sorted(str({k: v for k, v in r.items() if k not in ("ingest_source", "ingest_batch", "event_date")}) for r in rows)


@pytest.fixture
def landed(tmp_path):
    def land(name, *posts):
        folder = tmp_path / "landed"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text("".join(json.dumps(p) + "\n" for p in posts))
        return str(folder)

    return land


def post(*names, ip="10.0.0.1"):
    return {"events": [{"name": n, "device_id": "d", "timestamp": "2024-01-01T00:00:00Z"} for n in names], "remote_ip": ip}


def test_ingest_stores_each_file_once(spark, tmp_path, landed):
    paths = [str(tmp_path / p) for p in ("events", "rejected", "checkpoint")]
    ranges = spark.createDataFrame([(167772160, 167772161, "AA")], "lo long, hi long, country string")

    def run(folder):
        finish(ingest.start_ingest(ingest.stream_event_batches(spark, folder, 1), *paths, ranges, AS_OF))
        return dicts(spark.read.parquet(paths[0]))

    first = run(landed("a.json", post("a", "b"), post("c", None), {"events": []}))
    assert sorted(r["name"] for r in first) == ["a", "b"] and {r["country"] for r in first} == {"AA"}
    reasons = sorted(r["reason"] for r in dicts(spark.read.parquet(paths[1])))
    assert reasons == ["invalid event", "no events"]
    both = run(landed("b.json", post("e", ip="::1")))
    assert sorted(r["name"] for r in both) == ["a", "b", "e"]
    assert sorted(r["name"] for r in run(landed("b.json", post("e", ip="::1")))) == ["a", "b", "e"]


def test_a_repeated_micro_batch_leaves_no_copies(spark, tmp_path, landed):
    """A lost checkpoint makes the stream run its batches again."""
    folder = landed("a.json", post("a", "b"))
    for attempt in ("one", "two"):
        finish(ingest.start_ingest(ingest.stream_event_batches(spark, folder), str(tmp_path / "events"),
                                   str(tmp_path / "rejected"), str(tmp_path / attempt), as_of=AS_OF))
    assert spark.read.parquet(str(tmp_path / "events")).count() == 2


def parquet_stream(spark, df, path, files=3):
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def some_events(spark):
    return events(spark, *[dict(ts=f"2024-01-0{1 + i % 3}T00:{i % 60:02d}:{(i * 7) % 60:02d}", device_id=f"d{i % 11}",
                                name="purchase_completed" if i % 4 == 0 else "app_opened",
                                properties='{"revenue":2.5}') for i in range(120)])


def test_minutes(spark, tmp_path):
    df = some_events(spark)
    stream = windows.events_per_minute(parquet_stream(spark, df, str(tmp_path / "in")), "10 days")
    finish(windows.start_window_updates(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.select("ingest_batch").distinct().count() > 1
    got = windows.latest_windows(stored)
    assert drop_stamp(dicts(got)) == drop_stamp(dicts(windows.events_per_minute(df)))


def test_active_hours(spark, tmp_path):
    df = some_events(spark)
    exact = {(r["window_start"], r["active_users"]) for r in dicts(windows.active_last_hour(df))}
    brute = df.select("device_id", F.window("event_ts", "1 hour", "5 minutes")["start"].alias("s")).distinct()
    assert exact == {(r["s"], r["count"]) for r in dicts(brute.groupBy("s").count())}
    stream = windows.active_last_hour(parquet_stream(spark, df, str(tmp_path / "in")), "10 days")
    finish(windows.start_window_updates(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    got = windows.latest_windows(spark.read.parquet(str(tmp_path / "out")))
    # A handful of devices: the sketch is exact.
    assert {(r["window_start"], r["active_users"]) for r in dicts(got)} == exact
    with pytest.raises(ValueError):
        windows.active_last_hour(df, slide_minutes=7)


def test_dedup(spark, tmp_path):
    df = some_events(spark)
    twice = df.unionByName(df.withColumn("id", F.col("id") + 1000))
    stream = windows.stream_dedup(parquet_stream(spark, twice, str(tmp_path / "in")), "10 days")
    finish(ingest.start_append(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    key = ["device_id", "name", "event_ts"]
    got = spark.read.parquet(str(tmp_path / "out")).select(key)
    assert drop_stamp(dicts(got)) == drop_stamp(dicts(windows.stream_dedup(twice).select(key)))


def test_late_events_reopen_their_day(spark, tmp_path):
    df = some_events(spark)
    stream = parquet_stream(spark, df, str(tmp_path / "in"))
    paths = [str(tmp_path / p) for p in ("events", "stats", "checkpoint")]
    finish(ingest.start_daily_rollup(stream, *paths))
    late = events(spark, dict(ts="2024-01-01T09:00:00", device_id="late", id=10_000))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    finish(ingest.start_daily_rollup(stream, *paths))
    stats = stats_from_partials(spark.read.parquet(paths[1]))
    expected = rollup_daily_stats(df.unionByName(late))
    assert drop_stamp(dicts(stats.select(expected.columns))) == drop_stamp(dicts(expected))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    finish(ingest.start_daily_rollup(stream, *paths[:2], str(tmp_path / "lost")))
    again = stats_from_partials(spark.read.parquet(paths[1]))
    assert drop_stamp(dicts(again.select(expected.columns))) == drop_stamp(dicts(expected))
    compact_partials(spark.read.parquet(paths[1]), str(tmp_path / "closed"), at("2024-01-02").date())
    closed = stats_from_partials(spark.read.parquet(str(tmp_path / "closed")))
    kept = expected.filter("date < DATE '2024-01-02'")
    assert drop_stamp(dicts(closed.select(kept.columns))) == drop_stamp(dicts(kept))


def test_streams_share_tables_without_replacing_each_other(spark, tmp_path, landed):
    folder = landed("a.json", post("a", "b"))
    other = tmp_path / "other"
    other.mkdir()
    (other / "b.json").write_text(json.dumps(post("c")) + "\n")
    for source, path in (("one", folder), ("two", str(other))):
        finish(ingest.start_ingest(ingest.stream_event_batches(spark, path), str(tmp_path / "events"),
                                   str(tmp_path / "rejected"), str(tmp_path / source), as_of=AS_OF, source=source))
    assert sorted(r["name"] for r in dicts(spark.read.parquet(str(tmp_path / "events")))) == ["a", "b", "c"]


def test_files_grouped_otherwise_after_a_lost_checkpoint(spark, tmp_path, landed):
    for i in range(3):
        folder = landed(f"{i}.json", post(f"n{i}", f"m{i}"))

    def run(checkpoint, files):
        finish(ingest.start_ingest(ingest.stream_event_batches(spark, folder, files), str(tmp_path / "events"),
                                   str(tmp_path / "rejected"), str(tmp_path / checkpoint), as_of=AS_OF))
        return sorted(r["name"] for r in dicts(spark.read.parquet(str(tmp_path / "events"))))

    names = sorted(f"{c}{i}" for c in "mn" for i in range(3))
    assert run("first", 2) == names
    assert run("second", 1) == names
    assert run("third", 3) == names


def test_streamed_slides_count_exactly(spark, tmp_path):
    df = some_events(spark)
    stream = parquet_stream(spark, df, str(tmp_path / "in"))
    finish(windows.start_device_slides(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    got = windows.hours_from_slides(spark.read.parquet(str(tmp_path / "out")))
    assert drop_stamp(dicts(got)) == drop_stamp(dicts(windows.active_last_hour(df)))
    with pytest.raises(ValueError):
        windows.start_device_slides(stream, "x", "y", slide_minutes=7)


def test_compacted_windows_are_the_last_states(spark, tmp_path):
    df = some_events(spark)
    stream = windows.events_per_minute(parquet_stream(spark, df, str(tmp_path / "in")), "60 days")
    finish(windows.start_window_updates(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    stored = spark.read.parquet(str(tmp_path / "out"))
    windows.compact_windows(stored, str(tmp_path / "closed"), at("2030-01-01").date())
    closed = spark.read.parquet(str(tmp_path / "closed")).drop("window_date")
    assert drop_stamp(dicts(closed)) == drop_stamp(dicts(windows.events_per_minute(df)))


@pytest.mark.parametrize("minutes", [5, 20])
def test_hours_by_deltas_count_exactly(spark, tmp_path, minutes):
    """Files hold slides of the same devices in the same hours and around midnight."""
    df = events(spark, *[dict(ts=f"2024-01-0{1 + i % 2}T{(i * 5) % 3 + (0 if i % 2 else 21):02d}:{(i * 17) % 60:02d}:00",
                              device_id=f"d{i % 4}") for i in range(60)])
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    path, expected = str(tmp_path / "hours"), drop_stamp(dicts(windows.active_last_hour(df, slide_minutes=minutes)))
    for checkpoint, per_batch in (("a", 1), ("b", 3)):
        stream = ingest.stream_event_files(spark, str(tmp_path / "in"), df.schema, per_batch)
        finish(windows.start_hour_counts(stream, path, str(tmp_path / checkpoint), minutes))
        assert drop_stamp(dicts(windows.hours_from_deltas(spark, path))) == expected
    with pytest.raises(ValueError):
        windows.start_hour_counts(df, "x", "y", slide_minutes=7)
