"""A graph kept up to date from a stream of documents.

Every micro-batch holds whole documents (file, text; a null text removes one).
It is parsed alone, its rows replace those of the same files, and edges are
resolved again, as a new id may change what other files' references mean.  The
state is a numbered table of parsed rows in the shared folder: a batch that
runs again after a failure writes the same number again, from the number before
it, so that nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docgraph.sources import load


class Refresh:
    def __init__(self, spark: SparkSession, state: str, root_name: str = "workspace", suffix: str = load.SUFFIX, then: Callable[[int, load.Workspace], None] | None = None):
        """``state``: a folder all executors share; ``then`` is called with each batch's number and relations."""
        self.spark, self.state, self.root_name, self.suffix, self.then = spark, state.rstrip("/"), root_name, suffix, then

    def _texts(self, number: int) -> str:
        return f"{self.state}/files-{number:08d}"

    def _before(self, number: int) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.state)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return None
        held = sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(where) if s.getPath().getName().startswith("files-"))
        held = [n for n in held if n < number and fs.exists(jvm.org.apache.hadoop.fs.Path(self._texts(n) + "/_SUCCESS"))]
        return self.spark.read.schema("file string, text string").parquet(self._texts(held[-1])) if held else None

    def batch(self, changed: DataFrame, number: int) -> load.Workspace:
        """The relations after a batch; of several versions of one file in it the last by ``at`` (if there is such a column) counts."""
        order = [F.col("at").desc()] if "at" in changed.columns else [F.col("text").isNull(), F.col("text").desc()]
        last = changed.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(*order))).filter("n = 1").select("file", "text")
        old = self._before(number)
        files = last if old is None else load.replace_files(old, last, "file")
        files.filter("text is not null").write.mode("overwrite").parquet(self._texts(number))
        ws = load.relations(self.spark.read.schema("file string, text string").parquet(self._texts(number)), self.root_name, self.suffix)
        if self.then:
            self.then(number, ws)
        return ws

    def start(self, documents: DataFrame, checkpoint: str) -> StreamingQuery:
        """``documents``: a streaming table with file and text."""
        return documents.writeStream.foreachBatch(lambda df, n: self.batch(df, n) and None).option("checkpointLocation", checkpoint).start()


def documents(spark: SparkSession, root: str, suffix: str = load.SUFFIX) -> DataFrame:
    """New and changed documents below a folder as a stream."""
    root = root.rstrip("/")
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*" + suffix).option("recursiveFileLookup", "true").load(root)
    base = "/" + root.split("://", 1)[-1].lstrip("/") if "://" in root else root
    return found.select(F.substring(F.regexp_replace("path", "^[a-z]+:/+", "/"), len(base) + 2, 1 << 30).alias("file"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("at"))
