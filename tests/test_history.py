"""What jobs keep beside the events: device bitmaps and the kept snapshot."""

from __future__ import annotations

import random
from datetime import date

import pytest
from build import AS_OF, at, dicts, events, only
from pyspark.sql import functions as F

from tallyroom import clock
from tallyroom.operators import device_days, events as ev, retention, snapshot
from tallyroom.plans.numbering import numbered
from tallyroom.streaming import ingest, kept


def some(spark, n=400, seed=2, devices=60):
    draw = random.Random(seed)
    return events(spark, *[
        dict(ts=f"2024-01-{draw.randrange(1, 31):02d}T{draw.randrange(24):02d}:00:00",
             device_id="hot" if draw.random() < 0.4 else f"d{draw.randrange(devices)}") for _ in range(n)
    ])


def test_numbers_are_consecutive(spark):
    got = numbered(spark.range(0, 1000, numPartitions=7), "n", 5)
    assert sorted(r["n"] for r in dicts(got)) == list(range(5, 1005))
    assert len({r["id"] for r in dicts(got)}) == 1000
    assert numbered(spark.range(0), "n").count() == 0


def bitmaps(spark, path, *batches):
    """Each batch stores its bitmaps before the next one extends the devices."""
    parts = []
    for batch in batches:
        part = device_days.day_bitmaps(batch, device_days.extend_devices(spark, path, batch))
        parts.append(spark.createDataFrame(part.collect(), part.schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return device_days.merged_bitmaps(out)


def test_devices_keep_their_numbers(spark, tmp_path):
    path = str(tmp_path / "devices")
    first = {r["device_id"]: r["number"] for r in dicts(device_days.extend_devices(spark, path, some(spark, 50)))}
    again = {r["device_id"]: r["number"] for r in dicts(device_days.extend_devices(spark, path, some(spark, 50)))}
    more = {r["device_id"]: r["number"] for r in dicts(device_days.extend_devices(spark, path, some(spark, 400)))}
    assert again == first and first.items() <= more.items()
    assert sorted(more.values()) == list(range(len(more)))


def test_bitmaps_count_what_events_count(spark, tmp_path):
    one, two = some(spark, seed=2), some(spark, seed=3)
    both = one.unionByName(two)
    days = bitmaps(spark, str(tmp_path / "d"), one, two)
    window = clock.since_midnight(AS_OF, 14)
    got = device_days.daily_active_users_from_bitmaps(days, window)
    assert dicts(got) == dicts(ev.daily_active_users(both, window))
    got = only(device_days.active_users_from_bitmaps(days, AS_OF))
    assert got.items() <= only(ev.active_users(both, AS_OF)).items()
    closed = device_days.closed_history(days, date(2024, 1, 1))
    assert only(device_days.active_users_from_bitmaps(closed, AS_OF)) == got
    weekly = device_days.weekly_cohort_retention_from_bitmaps(days, AS_OF)
    assert dicts(weekly) == dicts(retention.weekly_cohort_retention(both, AS_OF))


def test_bitmaps_of_several_buckets_and_of_none(spark, tmp_path):
    many = spark.range(40_000).select(
        F.concat(F.lit("d"), "id").alias("device_id"), F.expr("TIMESTAMP '2024-01-29 10:00:00'").alias("event_ts"))
    days = bitmaps(spark, str(tmp_path / "d"), many, many.limit(10))
    assert days.select("bucket").distinct().count() == 2
    assert only(device_days.active_users_from_bitmaps(days, AS_OF))["wau"] == 40_000
    none = bitmaps(spark, str(tmp_path / "n"), some(spark).where("false"))
    assert only(device_days.active_users_from_bitmaps(none, AS_OF))["total_users"] == 0


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.select("device_id", "first_event", "last_event", "events").collect())


def expected(df):
    return rows_of(snapshot.device_snapshot(df.withColumn("event_ts", F.col("event_ts").cast("timestamp"))))


def test_a_batch_counts_once_however_often_it_runs(spark, tmp_path, monkeypatch):
    path, one, two = str(tmp_path / "s"), some(spark, seed=2), some(spark, seed=3)
    kept.add_batch(one, path, "main", "a", buckets=5)
    kept.add_batch(one, path, "main", "a", buckets=5)
    assert rows_of(kept.read_snapshot(spark, path)) == expected(one)
    # It stops after some buckets are written, and runs again.
    some_buckets = two.where(F.pmod(F.xxhash64("device_id"), F.lit(5)) < 2)
    kept.add_batch(some_buckets, path, "main", "b", buckets=5)
    kept.add_batch(two, path, "main", "b", buckets=5)
    assert rows_of(kept.read_snapshot(spark, path)) == expected(one.unionByName(two))
    kept.add_batch(one, path, "other", "a", buckets=5)
    assert rows_of(kept.read_snapshot(spark, path)) == expected(one.unionByName(two).unionByName(one))


def test_a_batch_rewrites_its_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "s")
    kept.add_batch(some(spark), path, "main", "a", buckets=8)
    before = spark.read.parquet(path).groupBy("bucket").agg(F.max("version").alias("v"))
    before = {r["bucket"]: r["v"] for r in dicts(before)}
    kept.add_batch(events(spark, dict(ts="2024-01-02T00:00:00", device_id="hot")), path, "main", "b", buckets=8)
    after = {r["bucket"]: r["v"] for r in dicts(spark.read.parquet(path).groupBy("bucket").agg(F.max("version").alias("v")))}
    assert sum(after[b] != before[b] for b in after) == 1
    for i in range(4):
        kept.add_batch(events(spark, dict(ts="2024-01-02T00:00:00", device_id="hot")), path, "main", f"c{i}", buckets=8)
    assert spark.read.parquet(path).select("bucket", "version").distinct().groupBy("bucket").count().agg(F.max("count")).first()[0] <= 2


@pytest.mark.parametrize("files", [1, None])
def test_kept_by_a_stream_however_files_are_grouped(spark, tmp_path, files):
    rows = some(spark)
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "s")
    for checkpoint, per_batch in (("a", files), ("b", 3), ("c", None)):
        stream = ingest.stream_event_files(spark, str(tmp_path / "in"), rows.schema, per_batch)
        finish(kept.start_device_snapshot(stream, path, str(tmp_path / checkpoint), buckets=4))
        assert rows_of(kept.read_snapshot(spark, path)) == expected(rows)
    stored = kept.read_snapshot(spark, path)
    got = snapshot.weekly_cohort_retention_from_snapshot(stored, rows, AS_OF)
    assert dicts(got) == dicts(retention.weekly_cohort_retention(rows, AS_OF))
    moment = at("2024-01-03T00:00:00")
    assert dicts(snapshot.new_users_from_snapshot(stored, moment)) == dicts(ev.new_users_since(rows, moment))
