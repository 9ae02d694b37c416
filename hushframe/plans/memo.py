"""Results of files, kept from run to run.

A store is a folder with one table for each kind of result and one of the files they are of, each partitioned by run. A
run writes its results first and its files last: without its files, what a broken run has left behind is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.storage import written

FILES = "path string, size_bytes bigint, modified_at timestamp, settings string, done_at timestamp"
SAME = ("path", "size_bytes", "modified_at")
#: Version of what the results mean: part of the settings, so that a newer library does not take older results for its own.
VERSION = 1


class ResultStore:
    """`schemas` are those of the results by name; each has a column `dataset`, the path of the file.

    A file is known if it has been seen with the same path, size and time, under the same `settings`.
    """

    def __init__(self, spark: SparkSession, folder: str, schemas: Mapping[str, str], settings: str):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), dict(schemas)
        self.settings = f"{VERSION}/{settings}"

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.createDataFrame([], f"{schema}, run string")
        return self.spark.read.schema(f"{schema}, run string").parquet(f"{self.folder}/{name}")

    def _entries(self, files: DataFrame) -> DataFrame:
        """(path, run) of the known ones of `files`: the last run that has the file as it is now."""
        known = self._table("files", FILES).filter(F.col("settings") == self.settings)
        latest = Window.partitionBy("path").orderBy(F.desc("done_at"), F.desc("run"))
        same = known.join(files.select(*SAME), list(SAME))
        return same.withColumn("rank", F.row_number().over(latest)).filter("rank = 1").select("path", "run")

    def unknown(self, files: DataFrame) -> DataFrame:
        """The files (path, size_bytes, modified_at and any other columns) that have to be read."""
        return files.join(self._entries(files), "path", "left_anti").select(*files.columns)

    def add(self, files: DataFrame, results: Mapping[str, DataFrame]) -> str:
        """Keep the results of files; returns the run."""
        run = uuid.uuid4().hex
        for name in self.schemas:
            results[name].write.parquet(f"{self.folder}/{name}/run={run}")
        now = F.current_timestamp()
        files.select(*SAME, F.lit(self.settings).alias("settings"), now.alias("done_at")).write.parquet(f"{self.folder}/files/run={run}")
        return run

    def of(self, files: DataFrame, name: str) -> DataFrame:
        """The results of the known ones of `files`. Only the folders of runs that one of them is of are read."""
        entries = written(self._entries(files), "known-files")
        runs = [r["run"] for r in entries.select("run").distinct().collect()]
        found = self._table(name, self.schemas[name]).filter(F.col("run").isin(runs) if runs else F.lit(False))
        return found.join(entries.withColumnRenamed("path", "dataset"), ["dataset", "run"]).drop("run")

    def compact(self, files: DataFrame) -> str:
        """Write the results of `files` as one run; the folders of older runs may be deleted after it."""
        known = files.join(self._entries(files), "path", "left_semi")
        return self.add(known, {name: self.of(known, name) for name in self.schemas})
