"""Which batches, and which source files, each day of a table holds.

Beside a table partitioned by day, source and batch, every day has one short list a source:
the files whose rows it holds and the batch they came with. A writer reads the lists of the
days it touches and no folder of the table, leaves out files that another batch brought,
writes its rows and then the next version of the lists. Readers open the batches that the
lists name, so rows of a write that never got to its lists are not seen. Batches are named
by what they hold: the same files give the same name, so a batch that runs again replaces
itself, and files that are grouped anew, after a lost checkpoint, replace nothing.

A file that is wholly stored may be noted as finished, by the day it landed on, so that a
writer that meets it again need not read it to find its days.

One writer at a time may work for a source; sources do not touch each other's lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyroom.sources.files import STAMP, replace_partitions, table_exists

SOURCE, BATCH = STAMP
#: The file a row was read from.
FILE = "ingest_file"
#: Names beginning with an underscore are passed over when the table is read as it is.
_FOLDER = "_ledger"
#: Files of which every row has been stored and listed, by the day they landed on.
_FINISHED = "_ledger_files"


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def lists(
    spark: SparkSession, path: str, day: str, days: Iterable[date] | None = None, source: str | None = None
) -> DataFrame:
    """The newest lists (day, ingest_source, version, ingest_batch, ingest_file) of the table
    at ``path``: of the ``days`` given, whose folders alone are opened, or of all."""
    root = f"{path}/{_FOLDER}"
    schema = f"{BATCH} string, {FILE} string, {day} date, {SOURCE} string, version int"
    if days is None:
        folders = [root]
    else:
        folders = [f"{root}/{day}={d}" + (f"/{SOURCE}={source}" if source else "") for d in sorted(days)]
    folders = [f for f in folders if table_exists(spark, f)]
    if not folders:
        return spark.createDataFrame([], schema)
    every = spark.read.schema(schema).option("basePath", root).parquet(*folders)
    newest = every.groupBy(day, SOURCE).agg(F.max("version").alias("version"))
    return every.join(F.broadcast(newest), [day, SOURCE, "version"])


def _write_lists(entries: DataFrame, path: str, day: str) -> None:
    """Append lists with their version, a file each, which appears as a whole or not."""
    columns = [day, SOURCE, "version"]
    (
        entries.select(BATCH, FILE, *columns).repartition(*columns)
        .write.mode("append").partitionBy(*columns).parquet(f"{path}/{_FOLDER}")
    )
    spark = entries.sparkSession
    for row in entries.select(*columns).distinct().collect():
        # The version before stays for readers that have just looked.
        old = f"{path}/{_FOLDER}/{day}={row[0]}/{SOURCE}={row[1]}/version={row[2] - 2}"
        delete_folder(spark, old)


def batch_name(rows: DataFrame, key: str) -> str:
    """A name that depends on the values of ``key`` and on nothing else."""
    found = rows.select(F.xxhash64(key).alias("h")).distinct().agg(F.count("*"), F.bit_xor("h")).first()
    return f"b{found[0]}-{(found[1] or 0) % 2**64:016x}"


def store(
    rows: DataFrame,
    path: str,
    source: str,
    write: Callable[[DataFrame, str], None],
    key: str = FILE,
    day: str = "event_date",
) -> None:
    """Hand to ``write`` those of ``rows`` (which have ``day``) that no other batch of the
    ledger at ``path`` has brought, with the batch's name, then list them.

    With ``key`` ingest_file, a file is brought for a day or it is not. With another key,
    such as an id, the rows that are stored for the days at hand are compared by it; only
    batches that the lists name are opened. ``write`` may write several tables, which then
    all stand or fall with the lists at ``path``.
    """
    spark = rows.sparkSession
    days = [r[0] for r in rows.select(day).distinct().collect()]
    if not days:
        return
    name = batch_name(rows, key)
    known = lists(spark, path, day, days, source)
    if key == FILE:
        brought = known.where(F.col(BATCH) != name).select(day, FILE).distinct()
        fresh = rows.join(brought, [day, FILE], "left_anti")
    else:
        other = committed(spark, path, days, day)
        fresh = rows if other is None else rows.join(
            other.where((F.col(BATCH) != name) | (F.col(SOURCE) != source)).select(day, key), [day, key], "left_anti"
        )
    write(fresh, name)
    file = FILE if key == FILE else F.lit(name).alias(FILE)
    new = fresh.select(F.lit(name).alias(BATCH), file, day).distinct()
    entries = known.select(BATCH, FILE, day).unionByName(new).distinct()
    # Days that got nothing new keep their lists.
    entries = entries.join(new.select(day).distinct(), day, "left_semi").withColumn(SOURCE, F.lit(source))
    versions = known.groupBy(day).agg(F.max("version").alias("before"))
    entries = entries.join(F.broadcast(versions), day, "left")
    entries = entries.withColumn("version", F.coalesce(F.col("before") + 1, F.lit(0))).drop("before")
    entries = entries.persist()
    try:
        _write_lists(entries, path, day)
    finally:
        entries.unpersist()


def finished(spark: SparkSession, path: str, landed: str, days: Iterable[date], source: str) -> DataFrame:
    """The files (``landed``, ingest_file) that ``finish`` has noted for the table at ``path``,
    of the days they landed on, whose folders alone are opened."""
    root, schema = f"{path}/{_FINISHED}", f"{FILE} string, {landed} date, {SOURCE} string"
    folders = [f"{root}/{landed}={d}/{SOURCE}={source}" for d in sorted(days)]
    folders = [f for f in folders if table_exists(spark, f)]
    if not folders:
        return spark.createDataFrame([], schema).select(landed, FILE)
    rows = spark.read.schema(schema).option("basePath", root).parquet(*folders)
    return rows.select(landed, FILE).distinct()


def finish(files: DataFrame, path: str, source: str, landed: str) -> None:
    """Note that all rows of ``files`` (``landed``, ingest_file) are in the table at ``path``
    and in its lists, for all days; so it comes after them."""
    (
        files.select(FILE, landed, F.lit(source).alias(SOURCE)).coalesce(1)
        .write.mode("append").partitionBy(landed, SOURCE).parquet(f"{path}/{_FINISHED}")
    )


def _folders(named: DataFrame, table: str, day: str, table_day: str) -> list[str]:
    rows = named.select(day, SOURCE, BATCH).distinct().collect()
    return [f"{table}/{table_day}={d}/{SOURCE}={s}/{BATCH}={b}" for d, s, b in sorted(rows)]


def _read(spark: SparkSession, table: str, folders: list[str], day: str) -> DataFrame:
    rows = spark.read.option("basePath", table).parquet(*folders)
    return rows.withColumns({day: F.col(day).cast("date"), **{c: F.col(c).cast("string") for c in STAMP}})


def committed(
    spark: SparkSession, path: str, days: Iterable[date] | None = None, day: str = "event_date",
    table: str | None = None, table_day: str | None = None,
) -> DataFrame | None:
    """The rows that the lists at ``path`` name, of some days or all, from the table there or
    from another ``table`` written under the same ledger. None if there are none."""
    table, table_day = table or path, table_day or day
    folders = _folders(lists(spark, path, day, days), table, day, table_day)
    return _read(spark, table, folders, table_day) if folders else None


def compact_days(
    spark: SparkSession, path: str, source: str, before: date, day: str = "event_date",
    others: dict[str, str] | None = None,
) -> list[date]:
    """Rewrite the days before ``before`` that hold several batches of ``source`` as one
    each, and list that one. Gives the days. ``others`` are the tables under the same ledger,
    with the names of their day columns. Run it where the source's writer does not run;
    readers of the lists see a day as it was or as it is now, and ``sweep`` removes what no
    list names any more."""
    known = lists(spark, path, day, None, source).where((F.col(SOURCE) == source) & (F.col(day) < F.lit(before)))
    many = known.groupBy(day).agg(F.countDistinct(BATCH).alias("n"), (F.max("version") + 1).alias("next")).where("n > 1")
    closed = {r[day]: r["next"] for r in many.collect()}
    if not closed:
        return []
    names = [(d, f"c{n}", n) for d, n in sorted(closed.items())]
    names = F.broadcast(spark.createDataFrame(names, f"{day} date, _name string, _next int"))
    known = known.drop("version").join(names, day).persist()
    try:
        for table, table_day in {path: day, **(others or {})}.items():
            rows = _read(spark, table, _folders(known, table, day, table_day), table_day)
            name = names.select(F.col(day).alias(table_day), F.col("_name").alias(BATCH))
            replace_partitions(rows.drop(BATCH).join(name, table_day), table, table_day, *STAMP)
        entries = known.drop(BATCH).withColumnsRenamed({"_name": BATCH, "_next": "version"}).distinct()
        _write_lists(entries, path, day)
    finally:
        known.unpersist()
    return sorted(closed)


def sweep(
    spark: SparkSession, path: str, days: Iterable[date], day: str = "event_date",
    others: dict[str, str] | None = None,
) -> int:
    """Delete the batches of these days that no list names: what compaction has replaced and
    what interrupted writes have left. Run it when no reader of older lists and no writer is
    at work. Gives the number of folders deleted."""
    gone, hadoop = 0, spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for d in sorted(days):
        named = {(r[0], r[1]) for r in lists(spark, path, day, [d]).select(*STAMP).distinct().collect()}
        for table, table_day in {path: day, **(others or {})}.items():
            pattern = hadoop(f"{table}/{table_day}={d}/{SOURCE}=*/{BATCH}=*")
            system = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            for found in system.globStatus(pattern) or []:
                folder = found.getPath()
                key = tuple(p.getName().split("=", 1)[1] for p in (folder.getParent(), folder))
                if key not in named:
                    gone += bool(system.delete(folder, True))
    return gone
