"""Plan helpers against brute force, and the shape of physical plans."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from build import AS_OF, dicts, events, only
from pyspark.sql import functions as F

from tallyroom import clock, plans
from tallyroom.operators import events as ev, feeds, funnels, retention, users
from tallyroom.sources import files
from tallyroom.sources.batches import fits_broadcast, ip_to_country


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """One device has most of the rows, the others a few each."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        device = "hot" if i % 3 else f"d{rng.randrange(40)}"
        rows.append(dict(
            ts=f"2024-01-{rng.randrange(1, 30):02d}T{rng.randrange(24):02d}:{rng.randrange(60):02d}:00",
            device_id=device, name=rng.choice(["app_opened", "photo_captured", "paywall_viewed"]),
            session_id=rng.choice([None, f"s{rng.randrange(60)}"]),
            app_version=f"2.{rng.randrange(3)}"))
    return events(spark, *rows).cache()


@pytest.mark.parametrize("salts", [1, 4])
def test_latest_per_key_is_exact_for_hot_and_small_keys(skewed, salts):
    order = [F.col("event_ts").desc(), F.col("id").desc()]
    got = plans.latest_per_key(skewed, ["device_id"], order, 7, ["id"], salts, rank="r")
    by_device = defaultdict(list)
    for row in dicts(skewed):
        by_device[row["device_id"]].append((row["event_ts"], row["id"]))
    expected = {(d, i + 1, row_id) for d, rows in by_device.items()
                for i, (_, row_id) in enumerate(sorted(rows, reverse=True)[:7])}
    assert {(r["device_id"], r["r"], r["id"]) for r in dicts(got)} == expected
    assert "WindowGroupLimit" in plan_of(got)


def test_device_rollup_matches_brute_force(skewed):
    got = {r["device_id"]: r for r in dicts(plans.device_rollup(skewed))}
    by_device = defaultdict(list)
    for row in dicts(skewed):
        by_device[row["device_id"]].append(row)
    assert got.keys() == by_device.keys()
    for device, rows in by_device.items():
        assert got[device]["total_events"] == len(rows)
        assert got[device]["total_sessions"] == len({r["session_id"] for r in rows} - {None})
        assert got[device]["active_days"] == len({r["event_ts"].date() for r in rows})
        assert got[device]["app_version"] == max(r["app_version"] for r in rows)
        assert got[device]["first_seen"] == min(r["event_ts"] for r in rows)


def test_activity_bits_match_the_days(skewed):
    bounds = clock.date_range(AS_OF, 100)
    days = [plans.active_on(bounds, F.lit(n)).alias(f"n{n}") for n in range(-1, 102)]
    got = {r["device_id"]: r for r in dicts(plans.activity_words(skewed, bounds).select("device_id", *days))}
    seen = defaultdict(set)
    for row in dicts(skewed):
        seen[row["device_id"]].add((row["event_ts"].date() - bounds.lo.date()).days)
    for device, row in got.items():
        assert {n for n in range(-1, 102) if row[f"n{n}"]} == seen[device]


def test_device_counts_need_no_expand(skewed):
    for df in (ev.active_users(skewed, AS_OF), funnels.funnel(skewed, clock.date_range(AS_OF)),
               funnels.staged_funnel(skewed, as_of=AS_OF),
               retention.weekly_cohort_retention(skewed, AS_OF),
               users.funnel_dropoff(skewed, "app_opened", "paywall_viewed", clock.date_range(AS_OF))):
        plan = plan_of(df)
        assert "Expand" not in plan and "Join" not in plan
        assert plan.count("Exchange hashpartitioning") == 1


def test_no_nested_loop_in_the_range_join(spark, skewed):
    ranges = spark.createDataFrame([(0, 10, "US")], "lo long, hi long, country string")
    for small in (False, True):
        plan = plan_of(ip_to_country(skewed, ranges, small=small))
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert ("_salt" in plan) == (not small)
    assert fits_broadcast(ranges, 26) and not fits_broadcast(ranges, 25)


def test_single_rows_side_by_side(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(None, 2.5)], "c int, d double")
    assert only(plans.join_single_rows(a, b)) == {"a": 1, "b": "x", "c": None, "d": 2.5}
    with pytest.raises(ValueError):
        plans.join_single_rows(a, a)


def test_size_check(spark):
    assert plans.fits(spark.range(10), 10) and not plans.fits(spark.range(11), 10)


def test_pages(spark):
    df = spark.range(20)
    got = plans.paged(df, F.col("id").desc(), limit=3, offset=5)
    assert [r["id"] for r in got.collect()] == [14, 13, 12]
    assert "TakeOrderedAndProject" in plan_of(got)
    with pytest.raises(ValueError):
        plans.paged(df, F.col("id"), limit=-1)
    with pytest.raises(ValueError):
        plans.order_by("id", "sideways")


@pytest.mark.parametrize("offset", [0, 1, 299, 880, 899, 900, 1200])
def test_deep_offsets_give_the_offset_pages(skewed, offset):
    page = feeds.search_events(skewed, limit=7, offset=offset).rows
    deep = feeds.search_events(skewed, limit=7, offset=offset, deep=-1 if offset else 0).rows
    assert [r["id"] for r in deep.collect()] == [r["id"] for r in page.collect()]
    if 0 < offset < 900:
        # The page is cut from what follows a row, with no rows to pass over.
        assert "Offset" not in plan_of(deep) and "limit=7" in plan_of(deep)


def test_deep_offsets_with_nulls(spark):
    rows = [(i, None if i % 4 == 0 else i // 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(5)
    for order in ("asc", "desc"):
        by = [plans.order_by("v", order), plans.order_by("id", "asc")]
        for offset in range(1, 62, 6):
            rest, none = plans.from_offset(df, "v", order, "id", "asc", offset, deep=0)
            assert none == 0
            got = plans.paged(rest, *by, limit=9)
            assert [r["id"] for r in got.collect()] == [r["id"] for r in plans.paged(df, *by, limit=9, offset=offset).collect()]


def files_read(df) -> int:
    """Files that the scans of an executed query opened."""
    def opened(plan) -> int:
        if "Adaptive" in plan.nodeName():
            plan = plan.executedPlan()
        leaves, total = plan.collectLeaves(), 0
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            if "QueryStage" in leaf.nodeName():
                total += opened(leaf.plan())
            elif leaf.metrics().contains("numFiles"):
                total += leaf.metrics().apply("numFiles").value()
        return total
    return opened(df._jdf.queryExecution().executedPlan())


def test_one_device_opens_a_small_share_of_its_table(spark, skewed, tmp_path):
    path = str(tmp_path / "by-device")
    files.append_by_device(skewed, path, buckets=32)
    files.append_by_device(skewed.withColumn("id", F.col("id") + 900), path, buckets=32)
    table = spark.read.parquet(path)
    everything = len(table.inputFiles())
    device = skewed.filter("device_id <> 'hot'").first()["device_id"]
    history = feeds.user_event_history(table, device)
    assert history.count() == 2 * skewed.filter(F.col("device_id") == device).count()
    found = history.collect()
    assert found and everything > 30
    assert "device_bucket_32" in plan_of(history)
    assert 0 < files_read(history) <= everything / 8
    detail = users.session_timeline(table, device)
    detail.collect()
    assert 0 < files_read(detail) <= everything / 8
    assert feeds.search_events(table, device_id="nobody").rows.count() == 0
