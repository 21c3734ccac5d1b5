"""Shared folder, stored tables and the small column rules that the operators have in common."""

from __future__ import annotations

import atexit
import gc
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.cluster import shared_dir, ship

#: White space in every contract of this subpackage: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
#: One word in those contracts, as a Java, Python and SQL pattern.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans it
            return


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call gets; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tabweave-{uuid.uuid4().hex}/{label}"
    _made.append((spark, path.rsplit("/", 1)[0]))
    return path


def store(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again, which cuts the lineage and survives lost executors.

    The plans behind it are garbage then, and are collected at once: a pipeline has hundreds, and a driver little memory."""
    path = new_path(df.sparkSession, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Collect garbage on both sides, so that Spark removes shuffle files that no live DataFrame needs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Ship the package, and bound the Arrow batches handed to Python by rows and bytes; stricter settings of the session stay."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(table: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``table`` is called so."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; a row without an id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)), F.lit(0)).cast("int")


def held_out(doc_id: Column) -> Column:
    """Fold 2 is never learned from."""
    return fold(doc_id) == 2


def strip_white(text: Column) -> Column:
    """Delete every white-space character; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def with_labels(docs: DataFrame, labels: DataFrame, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Inner join of documents and labels on doc_id, learning folds only.

    Labels of up to ``broadcast_rows`` rows (24 bytes each) are counted and broadcast, so that texts stay where
    they are read; more than that go through Spark's ordinary shuffled join."""
    usable = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    side = F.broadcast(usable) if labels.count() <= broadcast_rows else usable
    return docs.join(side, "doc_id")
