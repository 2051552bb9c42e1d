from __future__ import annotations

import json

from build import AS_OF, at, dicts, lines, only
from pyspark.sql import functions as F

from tallyroom import clock, schema
from tallyroom.operators import reports
from tallyroom.sources.files import read_report_json
from tallyroom.sources.lines import parse_json_lines


def payload(spark, fields, *documents):
    return parse_json_lines(lines(spark, *[json.dumps(d) for d in documents]), fields, "seq")


def test_series(spark):
    df = payload(spark, schema.SERIES_REPORT,
                 {"xValues": ["a", "b", "c"], "series": [[1, None], [9, 9]]}, {"xValues": ["a"]}, {"series": [[4]]},
                 {"xValues": [], "series": [[]]})
    assert [(r["seq"], r["date"], r["count"]) for r in dicts(reports.series_to_rows(df, "seq"))] == [
        (0, "a", 1.0), (0, "b", 0.0), (0, "c", 0.0)]
    got = {r["seq"]: (r["latest"], r["total"], r["average"]) for r in dicts(reports.series_summary(df, "seq"))}
    assert got == {0: (0.0, 1.0, 1.0), 1: (0.0, 0.0, 0.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_series_mean_leaves_out_empty_days(spark):
    df = payload(spark, schema.SERIES_REPORT, {"xValues": list("abcd"), "series": [[0, 3, 4, 0]]})
    assert only(reports.series_summary(df)) == {"latest": 0.0, "total": 7.0, "average": 4.0}


def test_report_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"xValues": ["a"], "series": [[2]], "seriesCollapsed": [[{"value": 125}]]}, indent=1))
    df = read_report_json(spark, str(tmp_path / "r.json"), schema.SERIES_REPORT)
    assert only(reports.series_to_rows(df, value="seconds")) == {"date": "a", "seconds": 2.0}
    assert only(reports.session_length_summary(df)) == {"average": 125.0, "average_formatted": "2m 5s"}


def test_every_document_of_a_file_is_read(spark, tmp_path):
    one = {"xValues": ["a"], "series": [[1]]}
    (tmp_path / "lines.json").write_text("".join(json.dumps({**one, "xValues": [c]}) + "\n" for c in "abc"))
    (tmp_path / "whole.json").write_text(json.dumps({**one, "xValues": ["d"]}, indent=2))
    (tmp_path / "array.json").write_text(json.dumps([{**one, "xValues": [c]} for c in "ef"], indent=2))
    df = read_report_json(spark, str(tmp_path), schema.SERIES_REPORT)
    assert sorted(r["xValues"][0] for r in dicts(df)) == list("abcdef")


def test_session_length_without_an_average(spark):
    df = payload(spark, schema.SERIES_REPORT, {"xValues": ["a"], "series": [[2]]}, {"seriesCollapsed": [[]]})
    assert {r["average_formatted"] for r in dicts(reports.session_length_summary(df))} == {"0s"}


def test_event_totals(spark):
    data = [{"name": "b", "totals": 3}, {"name": "a", "totals": 9}, {"name": "b", "totals": 5}, {"name": "z", "totals": 0},
            {"name": "n"}, {"name": "c", "totals": 9}]
    df = payload(spark, schema.EVENT_TOTALS_REPORT, {"data": data}, {})
    got = dicts(reports.event_totals(df, ["b", "q"], "seq"))
    assert got == [{"seq": 0, "total_events": 26, "b": 3, "q": 0}, {"seq": 1, "total_events": 0, "b": 0, "q": 0}]
    first = dicts(reports.top_events(df, k=2))
    assert [(r["position"], r["name"], r["count"]) for r in first] == [(1, "b", 3), (2, "a", 9)]
    ranked = dicts(reports.top_events(df, k=50, ranked=True))
    assert [(r["name"], r["count"]) for r in ranked] == [("a", 9), ("c", 9), ("b", 5), ("b", 3)]


def test_estimates(spark):
    df = spark.createDataFrame([(1, 10, 100, 0), (2, 0, 4, 8), (3, 100, 600, 40)], "r int, sessions long, photos long, active_users long")
    got = {r["r"]: r for r in dicts(reports.engagement_estimates(df, "r"))}
    assert (got[1]["active_users"], got[1]["sessions_per_user"], got[1]["avg_session_duration_seconds"]) == (1, 10.0, 80)
    assert (got[2]["photos_per_user"], got[2]["avg_session_duration_seconds"]) == (0.5, 30)
    buckets = dicts(reports.estimated_buckets(reports.engagement_estimates(df, "r"), "r"))
    assert {b["r"] for b in buckets} == {1, 3}
    third = {(b["kind"], b["bucket"]): b["count"] for b in buckets if b["r"] == 3}
    assert third[("engagement", "1 session")] == 16 and third[("engagement", "10+ sessions")] == 4
    # Sixty seconds on average: few very short sessions, many below a minute.
    assert third[("duration", "< 30s")] == 20 and third[("duration", "30s-1m")] == 30


def test_retention_points(spark):
    curve = [1.0, 0.456] + [0.0] * 5 + [0.125]
    df = payload(spark, schema.RETENTION_REPORT, {"combinedRetention": curve}, {})
    assert dicts(reports.retention_curve_points(df)) == [{"d1": 46, "d7": 13, "d30": 0}, {"d1": 0, "d7": 0, "d30": 0}]


def test_issues(spark):
    issues = payload(spark, schema.ISSUE, *[{"id": str(i), "level": level, "userCount": i}
                                            for i, level in enumerate(["fatal", "error", "warning", None])]).drop("seq")
    stats = reports.issue_stat_rows(payload(spark, schema.ISSUE_STATS, {"stats": [[1704067200, 3], [1704153600, 4]]}))
    assert only(reports.issue_summary(issues, stats)) == {"total_events": 7, "unresolved_issues": 4, "critical_issues": 2}
    assert [str(r["date"]) for r in dicts(reports.issue_events_by_day(stats))] == ["2024-01-01", "2024-01-02"]
    assert set(only(reports.issue_summary(issues.limit(0), stats.limit(0))).values()) == {0}
    listed = dicts(reports.issue_list(issues))[1]
    assert listed["user_count"] == 1 and "short_id" in listed and "userCount" not in listed


def test_recent_issue_events(spark):
    issues = spark.createDataFrame([("i1", "boom"), ("quiet", "x")], "issue_id string, title string")
    happened = spark.range(40).select("id", F.lit("i1").alias("issue_id"), F.timestamp_seconds("id").alias("event_ts"))
    got = dicts(reports.issue_recent_events(issues, happened, 3))
    assert sorted((r["event_rank"], r["id"], r["title"]) for r in got) == [(1, 39, "boom"), (2, 38, "boom"), (3, 37, "boom")]


def test_reviews(spark):
    df = payload(spark, schema.REVIEW, {"id": "1", "rating": 5}, {"id": "2", "rating": 4}, {"id": "3"}, {"id": "4", "rating": 7})
    assert only(reports.review_summary(df)) == {"total_reviews": 4, "average_rating": 4.0, "rating_1": 0, "rating_2": 0,
                                                "rating_3": 0, "rating_4": 1, "rating_5": 1}
    assert only(reports.review_summary(df.limit(0)))["average_rating"] == 0.0


def test_versions(spark):
    df = payload(spark, schema.VERSION, *[{"id": str(i), "versionString": f"1.{i}", "createdDate": f"2024-01-{i + 1:02d}"} for i in range(12)])
    got = dicts(reports.version_history(df))
    assert [r["id"] for r in got] == [str(i) for i in range(11, 1, -1)] and "seq" not in got[0]


def test_search(spark):
    df = payload(spark, schema.SEARCH_ROW, {"keys": ["a"], "clicks": 1, "impressions": 3, "ctr": 0.33335, "position": 1.25},
                 {"keys": ["b"], "clicks": 9, "impressions": 5, "position": 2}, {"keys": ["c"]})
    assert only(reports.search_totals(df)) == {"clicks": 10, "impressions": 8, "ctr": 125.0, "avg_position": 1.1}
    got = dicts(reports.search_by_dimension(df, "page", 2))
    assert [(r["page"], r["ctr"], r["position"]) for r in got] == [("b", 0.0, 2.0), ("a", 33.34, 1.3)]
    assert set(only(reports.search_totals(df.limit(0))).values()) == {0}


def test_late_sources_end_two_days_ago(spark):
    df = spark.sql("SELECT explode(sequence(DATE '2023-12-01', DATE '2024-01-31')) AS date, 'k' AS key, 1 AS clicks, 1 AS impressions, 1.0D AS ctr, 1.0D AS position")
    kept = clock.lagged_window(AS_OF, 28).apply(df, "date")
    assert only(kept.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))) == {
        "lo": at("2023-12-31").date(), "hi": at("2024-01-28").date()}
