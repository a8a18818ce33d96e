"""What the operators of this subpackage share: input shaping, scratch tables in the shared folder, Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator, so a row without id counts as the one with the largest id.
NO_ID = (1 << 63) - 1
#: Rows in one Arrow batch; with texts of up to megabytes this bounds a Python worker's memory.
BATCH_ROWS = 512
#: The sides that may be broadcast; every broadcast is preceded by a count, and a join takes over beyond it.
BROADCAST_BYTES = 32 << 20
#: What a row costs in a broadcast hash table beside its fields.
ROW_OVERHEAD = 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, unless the session already has a lower bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, so that no other column can clash; null text is empty, null id counts as the largest."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def back_id(name: str = "doc_id") -> Column:
    """The id as it was given: null again where it was null."""
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def scratch_root(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master, whose driver and
    executors are one process, takes one of its own; a cluster is refused, as no folder of one machine would do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), f"spindrift-{os.getuid()}")
    return f"{root.rstrip('/')}/spindrift-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; the driver's JVM deletes it when the application ends."""
    root = scratch_root(spark)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    for p in (path, root):
        hpath = jvm.org.apache.hadoop.fs.Path(p)
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


@contextmanager
def _cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends: its result is a written table, so nothing rereads them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written once and read many times, so that a lost executor costs one task and not the lineage."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        path = scratch_path(self.spark, name)
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with _cleaned_shuffles(self.spark):
            writer.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.paths.pop(name))


def bounded_rows(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df, whose rows hold row_bytes each, stays under limit as a hash table. df should be a written table."""
    most = limit // (row_bytes + ROW_OVERHEAD)
    return df.limit(most + 1).count() <= most


def hinted(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted size is under the bound; else as it is, and the join shuffles."""
    return F.broadcast(df) if bounded_rows(df, row_bytes, limit) else df


def map_batches(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; the number of buckets that a shuffle is dealt to follows from it."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def row_name(docs: DataFrame) -> str:
    """A column name that docs does not have, in whatever case."""
    taken, name = {c.lower() for c in docs.columns}, "_row"
    while name in taken:
        name += "_"
    return name


def with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own for each row, as a written table, so that every scan sees the same numbers; and the
    name of this column, which docs had none of."""
    name = row_name(docs)
    return Scratch(docs.sparkSession).keep("rows", docs.withColumn(name, F.monotonically_increasing_id())), name


def row_texts(rows: DataFrame, name: str) -> DataFrame:
    """Row numbers as doc_id and text: what an operator reads to judge each row alone, whatever ids rows share."""
    return rows.select(F.col(name).alias("doc_id"), "text")


def drop_rows(rows: DataFrame, name: str, dropped: DataFrame) -> DataFrame:
    """The rows of with_rows whose number is not in dropped (column row), columns as they were; nothing but numbers moves
    while these are few."""
    dropped = Scratch(rows.sparkSession).keep("dropped", dropped.select(F.col("row").alias(name)))
    return rows.join(hinted(dropped, 16), name, "left_anti").drop(name)


def one_of_each(rows: DataFrame, name: str, groups: DataFrame) -> DataFrame:
    """The rows of with_rows with one row of each group (groups: row, group), that with the smallest id, a null id being
    the largest; of equal ids the first row stays. Rows without a group stay."""
    groups = Scratch(rows.sparkSession).keep("groups", groups.select("row", "group"))
    ids = rows.select(F.col(name).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
    first = groups.join(ids, "row").groupBy("group").agg(F.min(F.struct("id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    return drop_rows(rows, name, groups.join(first, "row", "left_anti"))
