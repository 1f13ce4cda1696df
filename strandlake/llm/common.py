"""Helpers shared by the training-data operators: table reads, shared folders, lineage cuts."""

from __future__ import annotations

import math
import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch, so that a Python worker holds few whole texts at once; a session's own setting goes first.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_LIMIT = "2097152"
#: Short rows of one file of a small table, and bytes of input of one packed partition.
ROWS_A_FILE = 250_000
PACK_BYTES = 8 << 20
MOST_PARTS = 1 << 30
#: Rows of at most a few dozen bytes each that a join may broadcast.
BROADCAST_ROWS = 500_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, BATCH_LIMIT)
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting, as in tests, gets a temporary folder of its own.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
        spark.conf.set("spark.checkpoint.dir", given)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one run's files inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/strandlake/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder; later reads survive lost executors.

    A table that is known to have at most ``rows`` short rows is written in files of
    ROWS_A_FILE rows rather than in one for each of many near-empty partitions.
    """
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, math.ceil(rows / ROWS_A_FILE)))
    return df.checkpoint(eager=True)


def packed(df: DataFrame) -> DataFrame:
    """``df`` read from files, with its smallest partitions put together: PACK_BYTES each, two a core at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(MOST_PARTS, max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / PACK_BYTES))))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: columns are pruned when it is read."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, led by as many underscores as keep them apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    lead = "__"
    while any(f"{lead}{n}" in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def discard(spark: SparkSession, path: str) -> None:
    """Removes files of a run that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, which is cut already, marked for a broadcast if it has at most ``rows`` rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held_out(doc_id) -> Column:
    """True for rows whose crc32(doc_id as text) is divisible by five; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
