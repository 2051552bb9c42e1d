"""Report files and the partitioned tables events and rollups are kept in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyroom.plans.devices import device_bucket

#: Row groups of tables clustered by device: small, as a device needs few rows of one.
ROW_GROUP_BYTES = 8 << 20


def read_report_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV report with a header as text columns, trimmed and unquoted; an empty cell
    is empty text. A file with a header alone gives no rows; quoted commas stay within
    their value. Files of one read must have the same columns in the same order; a
    header that differs is an error, not a swap of values."""
    rows = (
        spark.read.option("header", True)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )
    return rows.na.fill("")


def read_report_json(spark: SparkSession, path: str, payload: T.StructType) -> DataFrame:
    """Landed report payloads with a fixed schema: a document per line where every line
    of a file is one, else the whole file as one. A file is read as one value, as it
    holds the answer to one request."""
    files = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", "\\r?\\n"), lambda line: F.trim(line) != "")
    each = F.forall(lines, lambda line: F.try_parse_json(line).isNotNull())
    documents = files.select(F.explode(F.when(each, lines).otherwise(F.array("value"))).alias("_text"))
    parsed = F.from_json("_text", T.ArrayType(payload))
    return documents.select(F.explode(parsed).alias("_row")).select("_row.*")


def align_schema(df: DataFrame, target: T.StructType) -> DataFrame:
    """Add the target's missing columns as nulls and keep everything else."""
    missing = {
        f.name: F.lit(None).cast(f.dataType) for f in target.fields if f.name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def append_events(events: DataFrame, path: str) -> None:
    """Append to a table partitioned by day. Rows are rebalanced by day: small days
    share a task, a day with most of the rows is split over many."""
    dated = events.withColumn("event_date", F.to_date("event_ts"))
    dated.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(path)


def append_by_device(events: DataFrame, path: str, buckets: int = 256) -> None:
    """Append to a table that finds one device fast: partitioned by a hash of the device, rows
    in order of device and time, files with bloom filters of their devices. Ranges of
    device and time are what tasks write, so a device with most of the rows is split over
    many files, and a small one lies in few row groups of one bucket."""
    bucket = device_bucket(F.col("device_id"), buckets)
    order = [f"device_bucket_{buckets}", "device_id", "event_ts"]
    (
        events.withColumn(order[0], bucket)
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .write.mode("append").partitionBy(order[0])
        .option("parquet.bloom.filter.enabled#device_id", "true")
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .parquet(path)
    )


def stamped(df: DataFrame, source: str, number: int | str) -> DataFrame:
    """``df`` with the partition columns of one micro-batch of one stream. The source is a
    name the caller keeps for the stream, so streams that share a table, each counting
    its own batches from 0, never replace each other's rows."""
    return df.withColumns({"ingest_source": F.lit(source), "ingest_batch": F.lit(number)})


STAMP = ["ingest_source", "ingest_batch"]


def table_exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def replace_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Overwrite only the partitions present in ``df``; running it again is harmless."""
    (
        df.hint("rebalance", *partitions)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions).parquet(path)
    )
