"""Tables that grow batch by batch: the same rows for every grouping, bounded lists."""

from __future__ import annotations

import json
from datetime import date

import pytest
from build import AS_OF, dicts, events
from pyspark.sql import functions as F

from tallyroom.operators.rollup import rollup_daily_stats, stats_from_partials
from tallyroom.sources import batches, ledger
from tallyroom.streaming import ingest

LINE = {"events": [{"name": "a", "device_id": "d", "timestamp": "2024-01-01T00:00:00Z"},
                   {"name": "b", "device_id": "d", "timestamp": "2024-01-02T00:00:00Z"}]}


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


@pytest.fixture
def land(tmp_path):
    def write(name, *posts):
        folder = tmp_path / "landed"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text("".join(json.dumps(p) + "\n" for p in posts))
        return str(folder)
    return write


@pytest.fixture
def run(spark, tmp_path):
    def started(folder, checkpoint, files=None, table="events"):
        stream = ingest.stream_event_batches(spark, folder, files)
        finish(ingest.start_ingest(stream, str(tmp_path / table), str(tmp_path / f"{table}-rejected"),
                                   str(tmp_path / checkpoint), as_of=AS_OF))
        return ledger.committed(spark, str(tmp_path / table))
    return started


def test_equal_lines_count_alike_however_files_are_grouped(land, run):
    """The same line in two files, and twice in one of them."""
    land("a.json", LINE)
    folder = land("b.json", LINE, LINE)
    one, each = run(folder, "x", None, "one"), run(folder, "y", 1, "each")
    ids = sorted(r["id"] for r in dicts(one))
    assert len(ids) == len(set(ids)) == 6
    assert sorted(r["id"] for r in dicts(each)) == ids
    for checkpoint, files in (("lost", None), ("again", 1)):
        assert sorted(r["id"] for r in dicts(run(folder, checkpoint, files, "each"))) == ids


def test_rejected_lines_are_kept_once(spark, tmp_path, land, run):
    folder = land("a.json", {"events": []}, LINE)
    land("b.json", {"events": []}, {"events": []})
    run(folder, "x", 1)
    run(folder, "y")
    rejected = ledger.committed(spark, str(tmp_path / "events-rejected"), day=ingest.LANDED)
    assert [r["reason"] for r in dicts(rejected)] == ["no events"] * 3


def test_a_line_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(batches, "COPY_BLOCK", 3)
    lines = spark.createDataFrame([("x", "f")] * 10 + [("x", "g"), ("y", "f")], "value string, ingest_file string")
    got = sorted((r["ingest_file"], r["value"], r["line_copy"]) for r in dicts(batches.number_copies(lines)))
    assert got == [*[("f", "x", i) for i in range(1, 11)], ("f", "y", 1), ("g", "x", 1)]


def dated(spark, file, *days):
    rows = [(f"{file}-{i}", date.fromisoformat(d), file) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "id string, event_date date, ingest_file string")


def test_rows_without_a_list_are_not_seen(spark, tmp_path):
    """A write that stops before its lists leaves rows that no reader sees; the next one,
    grouped otherwise, brings them."""
    path = str(tmp_path / "t")
    write = ingest._into(path, "s", "event_date")

    def stops(rows, batch):
        write(rows, batch)
        raise OSError
    a, b = dated(spark, "a", "2024-01-01", "2024-01-02"), dated(spark, "b", "2024-01-01")
    with pytest.raises(OSError):
        ledger.store(a, path, "s", stops)
    assert ledger.committed(spark, path) is None
    ledger.store(a.unionAll(b), path, "s", write)
    assert sorted(r["id"] for r in dicts(ledger.committed(spark, path))) == ["a-0", "a-1", "b-0"]
    assert ledger.sweep(spark, path, [date(2024, 1, 1), date(2024, 1, 2)]) == 2
    assert spark.read.parquet(path).count() == 3


def test_lists_do_not_grow_with_the_batches_before(spark, tmp_path):
    path = str(tmp_path / "t")
    write = ingest._into(path, "s", "event_date")
    for i in range(8):
        ledger.store(dated(spark, f"f{i}", "2024-01-01", f"2024-01-{i + 2:02d}"), path, "s", write)
        opened = ledger.lists(spark, path, "event_date", [date(2024, 1, 1)], "s")
        assert opened.select("ingest_file").distinct().count() == i + 1
        # Two versions of one day's list, whatever has been written to it and to other days.
        assert len(opened.inputFiles()) <= 2
    assert len(ledger.lists(spark, path, "event_date", [date(2024, 1, 9)], "s").inputFiles()) == 1


def test_compacted_days_hold_the_same_rows_and_know_their_files(spark, tmp_path):
    path, other = str(tmp_path / "t"), str(tmp_path / "partials")

    def write(rows, batch):
        ingest._into(path, "s", "event_date")(rows, batch)
        ingest._into(other, "s", "date")(rows.withColumnRenamed("event_date", "date"), batch)
    files = [dated(spark, f"f{i}", "2024-01-01", "2024-01-02", "2024-01-03") for i in range(3)]
    for rows in files:
        ledger.store(rows, path, "s", write)
    ledger.store(dated(spark, "z", "2024-01-01"), path, "else", ingest._into(path, "else", "event_date"))
    before = sorted(r["id"] for r in dicts(ledger.committed(spark, path)))
    closed = ledger.compact_days(spark, path, "s", date(2024, 1, 3), others={other: "date"})
    assert closed == [date(2024, 1, 1), date(2024, 1, 2)]
    assert ledger.compact_days(spark, path, "s", date(2024, 1, 3), others={other: "date"}) == []
    assert ledger.sweep(spark, path, closed, others={other: "date"}) == 12
    again = files[2].unionAll(files[0])
    ledger.store(again, path, "s", write)
    for table, day in ((path, "event_date"), (other, "date")):
        rows = ledger.committed(spark, path, table=table, table_day=day) if table == path else ledger.committed(
            spark, path, [date(2024, 1, 2)], table=table, table_day=day)
        wanted = before if table == path else [i for i in before if i.endswith("-1")]
        assert sorted(r["id"] for r in dicts(rows)) == wanted
    held = ledger.lists(spark, path, "event_date", [date(2024, 1, 1)], "s")
    assert held.select("ingest_batch").distinct().count() == 1 and held.count() == 3


def test_rollup_by_file_counts_events_without_ids(spark, tmp_path):
    rows = events(spark, *[dict(ts=f"2024-01-0{1 + i % 3}T00:00:00", device_id=f"d{i % 4}") for i in range(30)]).drop("id")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    table, partials = str(tmp_path / "t"), str(tmp_path / "p")
    for checkpoint, files in (("x", 2), ("y", 1), ("z", None)):
        stream = ingest.stream_event_files(spark, str(tmp_path / "in"), rows.schema, files)
        finish(ingest.start_daily_rollup(stream, table, partials, str(tmp_path / checkpoint)))
        got = stats_from_partials(ledger.committed(spark, table, table=partials, table_day="date"))
        expected = rollup_daily_stats(rows)
        assert sorted(map(str, got.select(expected.columns).collect())) == sorted(map(str, expected.collect()))
    assert ledger.committed(spark, table).count() == 30


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    ledger.store(dated(spark, "a").where("false"), path, "s", ingest._into(path, "s", "event_date"))
    assert ledger.committed(spark, path) is None
    assert ledger.compact_days(spark, path, "s", date(2030, 1, 1)) == []
    assert ledger.lists(spark, path, "event_date").select(F.count("*")).first()[0] == 0


def test_stored_files_are_not_parsed_again(spark, tmp_path, land, run, monkeypatch):
    """A line of an accepted and a rejected batch is numbered and parsed once for both tables;
    after a lost checkpoint, only files that are not stored as a whole are."""
    parsed, real = [], ingest.parse_event_batches

    def counted(lines):
        parsed.append(sorted({r["ingest_file"].rsplit("/", 1)[1] for r in lines.select("ingest_file").collect()}))
        return real(lines)
    monkeypatch.setattr(ingest, "parse_event_batches", counted)
    land("a.json", LINE, {"events": []})
    folder = land("b.json", LINE, LINE)
    ids = sorted(r["id"] for r in dicts(run(folder, "x")))
    assert sorted(r["id"] for r in dicts(run(folder, "y", 1))) == ids and len(ids) == 6
    land("c.json", LINE, {"events": []})
    stored = run(folder, "z")
    assert parsed == [["a.json", "b.json"], ["c.json"]]
    assert stored.count() == 8 and set(ids) < {r["id"] for r in dicts(stored)}
    rejected = ledger.committed(spark, str(tmp_path / "events-rejected"), day=ingest.LANDED)
    assert sorted(r["ingest_file"].rsplit("/", 1)[1] for r in dicts(rejected)) == ["a.json", "c.json"]


def test_a_file_that_one_table_lacks_is_stored_again(spark, tmp_path, land, run, monkeypatch):
    """The quarantine's write fails: the events' lists are there, the file is not finished."""
    folder = land("a.json", LINE, {"events": []})
    real = ledger.store

    def fails(rows, path, *rest, **more):
        if path.endswith("-rejected"):
            raise OSError
        real(rows, path, *rest, **more)
    monkeypatch.setattr(ledger, "store", fails)
    with pytest.raises(Exception):
        run(folder, "x")
    monkeypatch.setattr(ledger, "store", real)
    assert run(folder, "y").count() == 2
    rejected = ledger.committed(spark, str(tmp_path / "events-rejected"), day=ingest.LANDED)
    assert [r["reason"] for r in dicts(rejected)] == ["no events"]
