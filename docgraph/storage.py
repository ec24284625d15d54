"""The shared folder in which plans are cut, and even shares of work for Python."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as a URI or path.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    and the session is a local one does this make a folder of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="docgraph-")
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there.

    The table stays until it is discarded, or all of the session's are released.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    _tables.add(path)
    return out


_tables: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _tables.discard(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more (a round's state once the next one is written)."""
    for df in tables:
        if getattr(df, "written_to", None):
            _delete(df.sparkSession, df.written_to)


def release(spark: SparkSession) -> int:
    """Deletes all tables this process wrote; for when its results have been read. Gives their number."""
    paths = list(_tables)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def shares(df: DataFrame, text: str) -> int:
    """How many tasks should share rows on which Python works: some thousands of rows and some MB of their texts for each."""
    rows, chars = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text).cast("bigint")), F.lit(0))).first()
    return max(1, min(48, math.ceil(rows / 500)), math.ceil(rows / 5000), math.ceil(chars / (8 << 20)))


def dealt(df: DataFrame, text: str, *by: str) -> DataFrame:
    """``df`` in even shares, whatever the files it is read from; with ``by``, rows alike in those stay together."""
    return df.repartition(shares(df, text), *by)


def batches_of(batch: pa.RecordBatch, *columns: int, rows: int = 500, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``rows`` rows and about ``most`` bytes in its text columns, so that what Python makes of one stays small."""
    sizes = sum((pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns), np.zeros(batch.num_rows, np.int64))
    total, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        upto = min(at + rows, max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right"))))
        yield batch.slice(at, upto - at)
        at = upto
