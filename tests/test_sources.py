from __future__ import annotations

import gzip
import json

import pytest
from build import AS_OF, at, changes, dicts, events, lines, only, profiles

from tallyroom import clock, schema
from tallyroom.operators import feeds, profiles as prof, users
from tallyroom.sources import batches, export, files


def post(*sent, **request):
    return json.dumps({"events": list(sent), **request})


def check(spark, *texts):
    return batches.validate_batches(batches.parse_event_batches(lines(spark, *texts)))


GOOD = {"name": "app_opened", "device_id": "d1", "timestamp": "2024-01-01T00:00:00Z"}


def test_defaults_replace_falsy_fields(spark):
    sent = {**GOOD, "category": "", "platform": None, "session_duration_seconds": 0, "properties": None}
    bare = {"name": "x", "device_id": "d2", "timestamp": ""}
    full = {**GOOD, "category": "c", "platform": "web", "session_duration_seconds": 7,
            "properties": {"a": {"b": [1, 2]}, "t": True}, "timestamp": "2024-01-01T02:00:00+02:00"}
    got = dicts(batches.ingest_event_batches(check(spark, post(sent, bare, full)).accepted, AS_OF))
    assert [list(r) for r in got] == [schema.EVENTS.names] * 3
    assert [(r["category"], r["platform"], r["session_duration_seconds"]) for r in got] == [
        ("engagement", "ios", 0), ("engagement", "ios", 0), ("c", "web", 7)]
    assert [r["properties"] for r in got[:2]] == ["{}", "{}"]
    assert json.loads(got[2]["properties"]) == full["properties"]
    assert [r["event_ts"] for r in got] == [at("2024-01-01"), AS_OF, at("2024-01-01")]
    assert len({r["id"] for r in got}) == 3


@pytest.mark.parametrize("bad", [
    {"device_id": "d1"}, {"name": "x"}, {**GOOD, "name": None}, {**GOOD, "timestamp": "yesterday"},
    {**GOOD, "name": "x" * 101}, {**GOOD, "platform": "p" * 21}, {**GOOD, "session_duration_seconds": "long"},
])
def test_one_bad_event_rejects_its_whole_batch(spark, bad):
    checked = check(spark, post(GOOD, bad), post(GOOD))
    assert checked.accepted.count() == 1 and checked.rejected.count() == 1
    assert batches.ingest_event_batches(checked.accepted, AS_OF).count() == 1


def test_reasons(spark):
    texts = ["{}", '{"events":[]}', '{"events":"none"}', '{"events":null}', '{"events":[', "", "   "]
    got = sorted((r["value"], r["reason"]) for r in dicts(check(spark, *texts).rejected))
    assert got == [('{"events":"none"}', "malformed"), ('{"events":[', "malformed"),
                   ('{"events":[]}', "no events"), ('{"events":null}', "no events"), ("{}", "no events")]


def test_every_batch_is_accepted_or_rejected(spark):
    texts = [post(GOOD), post(GOOD, {}), "junk", post(GOOD, remote_ip="1" * 46), post(GOOD, remote_ip=None)]
    checked = check(spark, *texts)
    assert checked.accepted.count() == 2 and checked.rejected.count() == 3


def test_batch_files_carry_the_address(spark, tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()
    (folder / "a.json").write_text(post(GOOD, x_forwarded_for="::ffff:1.2.3.4, 9.9.9.9") + "\n" + post(GOOD, remote_ip="::1") + "\n")
    checked = batches.validate_batches(batches.read_event_batches(spark, str(folder)))
    got = dicts(batches.ingest_event_batches(checked.accepted, AS_OF))
    assert sorted(r["ip_address"] for r in got) == ["1.2.3.4", "127.0.0.1"]


@pytest.mark.parametrize("small", [False, True])
def test_countries(spark, small):
    ips = ["1.2.3.4", "1.2.255.255", "1.3.0.0", "127.0.0.1", "::1", "2001:db8::1", None, "9.9.9.9", "1.5.77.1"]
    df = events(spark, *[dict(ts="2024-01-01T00:00:00", ip_address=ip, country="??") for ip in ips])
    base = 1 << 24
    # The first range ends inside a /16, the second spans several.
    ranges = spark.createDataFrame(
        [(base + 2 * 65536, base + 3 * 65536 - 1, "AA"), (base + 3 * 65536, base + 6 * 65536 - 1, "BB"),
         (0, 10, "ZZ"), (127 << 24, (127 << 24) + 99, "LO")], "lo long, hi long, country string")
    got = {r["id"]: r["country"] for r in dicts(batches.ip_to_country(df, ranges, small=small))}
    assert got == {0: "AA", 1: "AA", 2: "BB", 3: None, 4: None, 5: None, 6: None, 7: None, 8: "BB"}


def test_webhooks(spark):
    event = {"type": "RENEWAL", "app_user_id": "u", "purchased_at_ms": 1704067200000, "expiration_at_ms": 0,
             "price": 9.999, "takehome_percentage": 85, "entitlement_ids": ["a"], "is_trial_conversion": None}
    raw = json.dumps({"event": event, "api_version": "1"})
    checked = batches.ingest_subscription_webhooks(
        lines(spark, raw, '{"event":null}', '{"event":{"app_user_id":"u"}}', "{", json.dumps({"event": {**event, "price": 1e9}})), AS_OF)
    row = only(checked.accepted)
    assert list(row) == schema.SUBSCRIPTION_EVENTS.names
    assert (row["purchased_at"], row["expiration_at"], str(row["price"])) == (at("2024-01-01"), None, "10.00")
    assert json.loads(row["entitlement_ids"]) == ["a"] and row["is_trial_conversion"] is False
    assert row["raw_payload"] == raw and row["created_at"] == AS_OF
    assert sorted(r["reason"] for r in dicts(checked.rejected)) == ["invalid event", "invalid event", "malformed", "no event"]


def exported(**fields):
    return json.dumps({"event_type": "e", "device_id": "d", "event_time": "2024-01-01 00:00:00.5", **fields})


def test_export_sync(spark, tmp_path):
    stored = events(spark, dict(ts="2024-01-01T00:00:00.5", name="seen", device_id="d"))
    texts = [
        exported(event_type="seen"), exported(app_version="first"), exported(app_version="second"),
        exported(event_time=None, server_received_time="2024-01-02 00:00:00", session_id=12345,
                 event_properties={"category": "c", "n": 1}, device_type="phone", language="English"),
        exported(event_time=None), exported(device_id=None), exported(event_type=None),
        exported(event_time="soon"), exported(os_version="v" * 21), '{"event_type": "cut', "", "  ",
    ]
    folder = tmp_path / "export"
    folder.mkdir()
    with gzip.open(folder / "part.json.gz", "wt") as out:
        out.write("\n".join(texts) + "\n")
    result = export.sync_export(export.read_export(spark, str(folder)), stored, as_of=AS_OF)
    assert only(result.counts) == {"synced": 2, "skipped": 2, "errors": 6}
    rows = {r["event_ts"]: r for r in dicts(result.new_rows)}
    assert rows[at("2024-01-01T00:00:00.5")]["app_version"] == "first"
    late = rows[at("2024-01-02")]
    assert (late["category"], late["session_id"], late["device_model"], late["locale"]) == ("c", "12345", "phone", "English")
    assert json.loads(late["properties"]) == {"category": "c", "n": 1}
    again = export.sync_export(export.read_export(spark, str(folder)), stored.withColumn("id", stored.id.cast("string")).unionByName(result.new_rows), as_of=AS_OF)
    assert only(again.counts) == {"synced": 0, "skipped": 4, "errors": 6} and again.new_rows.count() == 0


def test_copies_of_one_line(spark):
    """A third of an export may be one line."""
    texts = [exported(app_version=str(i)) for i in range(300)] + [exported(event_type=f"e{i}") for i in range(600)]
    result = export.sync_export(lines(spark, *texts), events(spark), as_of=AS_OF)
    assert only(result.counts) == {"synced": 601, "skipped": 299, "errors": 0}
    assert only(result.new_rows.filter("name = 'e'"))["app_version"] == "0"


def test_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('date , "Media Source",note\n2024-01-01, organic ,"a, ""b"""\n2024-01-02,,x\n')
    got = dicts(files.read_report_csv(spark, str(path)))
    assert got == [{"date": "2024-01-01", "Media Source": "organic", "note": 'a, "b"'},
                   {"date": "2024-01-02", "Media Source": "", "note": "x"}]
    (tmp_path / "h.csv").write_text("a,b\n")
    empty = files.read_report_csv(spark, str(tmp_path / "h.csv"))
    assert empty.columns == ["a", "b"] and empty.count() == 0


def test_align_schema(spark):
    df = files.align_schema(spark.createDataFrame([("d", 1)], "device_id string, extra int"), schema.PROFILES)
    assert set(df.columns) == {*schema.PROFILES.names, "extra"} and only(df)["phone_verified"] is None
    assert df.schema["created_at"].dataType == schema.PROFILES["created_at"].dataType


def test_merge_keeps_what_a_change_leaves_out(spark):
    current = profiles(spark, dict(device_id="a", email="old", opted_in_marketing=True, phone_verified=True, subscription_tier="pro",
                                   created_at=at("2023-01-01"), updated_at=at("2023-01-01")),
                       dict(device_id="same", email="e", updated_at=at("2023-01-01")))
    feed = changes(spark, dict(device_id="a", email="new", opted_in_marketing=False), dict(device_id="a", email="", display_name="A"),
                   dict(device_id="a"), dict(device_id="b", phone="1"), dict(device_id=None, email="lost"), dict(device_id="", email="lost"))
    got = {r["device_id"]: r for r in dicts(prof.merge_profiles(current, feed, AS_OF))}
    assert got.keys() == {"a", "b", "same"}
    a = got["a"]
    assert (a["email"], a["display_name"], a["subscription_tier"]) == ("new", "A", "pro")
    assert a["opted_in_marketing"] is False and a["phone_verified"] is True
    assert (a["created_at"], a["updated_at"]) == (at("2023-01-01"), AS_OF)
    assert (got["b"]["phone"], got["b"]["phone_verified"], got["b"]["created_at"]) == ("1", False, AS_OF)
    assert got["same"]["updated_at"] == at("2023-01-01")


def test_erasure(spark):
    current = profiles(spark, dict(device_id="a"), dict(device_id="b"))
    ids = spark.createDataFrame([("a",), ("a",), ("x",)], "device_id string")
    assert only(prof.delete_profiles(current, ids))["device_id"] == "b"


def test_phone_feed(spark):
    current = profiles(spark, dict(device_id="known", phone="+1", phone_verified=False), dict(device_id="idle", phone_verified=True))
    feed = spark.createDataFrame(
        [("known", "approved", None, 1), ("new", "approved", None, 1), ("new", "sent", "2125550001", 2),
         ("ghost", "approved", None, 1), ("done", "sent", "+44 1", 1), ("done", "approved", None, 2),
         ("again", "sent", "1", 1), ("again", "approved", None, 2), ("again", "sent", "(212) 555-0002", 3)],
        "device_id string, kind string, phone string, seq long")
    got = {r["device_id"]: (r["phone"], r["phone_verified"]) for r in dicts(prof.apply_phone_changes(current, feed, AS_OF))}
    assert got == {"known": ("+1", True), "idle": (None, True), "new": ("+12125550001", False),
                   "done": ("+441", True), "again": ("+12125550002", False)}


def test_overview(spark):
    df = profiles(spark, dict(device_id="a", email="e", subscription_tier="pro", opted_in_marketing=True),
                  dict(device_id="b", phone="1", opted_in_marketing=False), dict(device_id="c", subscription_tier="pro"))
    assert only(prof.subscriber_overview(df)) == {
        "total_profiles": 3, "with_email": 1, "with_phone": 1, "marketing_opt_in": 1}
    assert only(prof.subscribers_by_tier(df)) == {"subscription_tier": "pro", "count": 2}


def test_csv_files_of_another_column_order_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n3,4\n")
    with pytest.raises(Exception, match="header|FAILED_READ_FILE"):
        files.read_report_csv(spark, str(tmp_path)).collect()


def test_feeds_read_what_ingest_writes(spark, tmp_path):
    """One id is the key of writers and readers."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(post({**GOOD, "session_id": "s"}) + "\n" + post(GOOD, GOOD) + "\n")
    checked = batches.validate_batches(batches.read_event_batches(spark, str(tmp_path / "in")))
    files.append_events(batches.ingest_event_batches(checked.accepted, AS_OF), str(tmp_path / "events"))
    stored = spark.read.parquet(str(tmp_path / "events"))
    name, device = GOOD["name"], GOOD["device_id"]
    assert feeds.recent_events(stored).count() == 3 and feeds.latest_events(stored).count() == 3
    assert feeds.search_events(stored, name=name).rows.count() == 3
    assert feeds.events_by_property(stored, name, "none", "", "", AS_OF, 36500).rows.count() == 3
    assert feeds.user_event_history(stored, device).count() == 3
    assert only(users.latest_event_breakdown(stored))["count"] == 3
    assert users.session_timeline(stored, newest_events=3).count() == 1
    assert users.users_by_event(stored, name, clock.ALL_TIME).rows.count() == 1
    line = json.dumps({"event": {"type": "RENEWAL", "app_user_id": "u"}})
    webhooks = batches.ingest_subscription_webhooks(lines(spark, line), AS_OF).accepted
    assert feeds.recent_subscription_events(webhooks, AS_OF).count() == 1


def test_changes_without_a_device_make_no_profile(spark):
    current = profiles(spark, dict(device_id="a"))
    feed = spark.createDataFrame(
        [(None, "sent", "+15550001111", 1), ("", "sent", "+15550001111", 2), ("b", "sent", "+15550001111", 3)],
        "device_id string, kind string, phone string, seq long")
    assert sorted(r["device_id"] for r in dicts(prof.apply_phone_changes(current, feed, AS_OF))) == ["a", "b"]


def test_scratch_is_released_by_whoever_made_it(spark):
    from tallyroom import session

    path = session.scratch_path(spark, "test")
    spark.range(3).write.parquet(path)
    kept, session._SCRATCH[spark.sparkContext.applicationId] = session._SCRATCH[spark.sparkContext.applicationId], [path]
    assert session.release_scratch(spark) == 1 and not files.table_exists(spark, path)
    session._SCRATCH[spark.sparkContext.applicationId] = kept


def test_export_reads_the_days_it_covers_and_wide_rows_once(spark, tmp_path):
    folder = tmp_path / "export"
    folder.mkdir()
    with gzip.open(folder / "part.json.gz", "wt") as out:
        out.write("\n".join([exported(), exported(event_time="2024-01-03 10:00:00")]) + "\n")
    files.append_events(events(spark, dict(ts="2024-01-01T00:00:00"), dict(ts="2024-02-01T00:00:00")), str(tmp_path / "events"))
    stored = spark.read.parquet(str(tmp_path / "events"))
    result = export.sync_export(export.read_export(spark, str(folder)), stored, as_of=AS_OF)
    plan = result.new_rows._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    aggregates = [line for line in plan.splitlines() if "Aggregate" in line]
    assert aggregates and not any("properties" in line or "first(" in line for line in aggregates)
    for df in result:
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_export_lines_are_numbered_in_order(spark, tmp_path):
    folder = tmp_path / "a b%20c"
    folder.mkdir()
    for name in ("y z.gz", "x.gz"):
        with gzip.open(folder / name, "wt") as out:
            out.write("".join(f"{name}{i}\n" for i in range(3)))
    rows = sorted((r["seq"], r["value"]) for r in dicts(export.read_export(spark, str(folder))))
    assert [v for _, v in rows] == [f"{n}{i}" for n in ("x.gz", "y z.gz") for i in range(3)]
    assert len({s for s, _ in rows}) == 6
