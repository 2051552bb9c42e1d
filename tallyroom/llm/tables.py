"""Small helpers of the training-data operators: scratch tables and clean inputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyroom.session import scratch_path

#: A word, as every operator here cuts texts.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once below the shared folder and read again: its lineage ends there,
    so a lost executor costs a read and not the work that led to it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and that nothing will read again: what was made
    of it is a stored table itself."""
    files, context = df.inputFiles(), df.sparkSession.sparkContext
    if files:
        folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def map_rows(df: DataFrame, function, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` for columns of any name: those with a dot travel under another one."""
    def plain(names: list[str]) -> list[str]:
        taken, out = {n.lower() for n in names}, []
        for i, name in enumerate(names):
            if "." in name:
                name = f"__dotted_{i}"
                while name in taken:
                    name += "_"
            out.append(name)
        return out

    to = T.StructType([T.StructField(n, f.dataType) for n, f in zip(plain(schema.names), schema.fields)])
    return df.toDF(*plain(df.columns)).mapInArrow(function, to).toDF(*schema.names)


#: Rows that travel to Python together, at most; ten thousand long texts would be too many.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows if they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def keep_freed_memory() -> None:
    """Let this process keep up to 62 MB that its arrays free. What is larger than any array
    freed so far is mapped anew each time, and getting its pages costs more than most work on
    them; one large array, freed at once and never touched, raises that size."""
    np.empty(31 << 20, dtype=np.uint8)


def whole_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as text ''."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == remainder


def usable_vector(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    def odd(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    clean = vector.isNotNull() & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(clean, F.lit(False))
