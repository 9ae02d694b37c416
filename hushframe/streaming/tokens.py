"""Consistent tokens over a stream of tables.

The dictionary is a table that is only ever added to: one folder per micro-batch with the values that were new in it. A
value that any earlier batch has seen keeps its token; new ones are numbered after the last of their type, within a batch
by column and row key as in a single table. So the tokens are those of one table whose rows come batch by batch.

A batch may run again after a failure. Its folder in the dictionary is complete or not there (the job's marker tells), so
the second run takes the numbers of the first if it got so far, and its output replaces that of the first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hushframe.functions.text import canonical_text, is_atomic
from hushframe.modes import PrivacyMode, parse_mode
from hushframe.operators.anonymize_table import KEY, AnonymizedTable, anonymize_table

ENTRIES = "pii_type string, chain string, raw string, token_no bigint, token string"
BATCH = "batch"


class StreamTokens:
    """Tokens of one stream; its `folder` is restricted, as it holds the found values. One query writes to it at a time."""

    def __init__(self, spark: SparkSession, folder: str, row_key: Sequence[str], mode: str | PrivacyMode, as_of: date | str | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.row_key, self.mode, self.as_of = list(row_key), parse_mode(mode), as_of

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(target)

    def _place(self, batch_id: int) -> str:
        return f"{self.folder}/{BATCH}={batch_id}"

    def entries(self, before: int | None = None) -> DataFrame:
        """All tokens so far, or those of the batches before one."""
        if not self._exists(self.folder):
            return self.spark.createDataFrame([], f"{ENTRIES}, {BATCH} bigint")
        found = self.spark.read.schema(f"{ENTRIES}, {BATCH} bigint").parquet(self.folder)
        return found if before is None else found.filter(F.col(BATCH) < before)

    def anonymize(self, rows: DataFrame, batch_id: int) -> AnonymizedTable:
        """The rows of a batch with their tokens; what is new is in the dictionary when this returns."""
        done = self._exists(f"{self._place(batch_id)}/_SUCCESS")
        known = self.entries(batch_id + 1 if done else batch_id).drop(BATCH)
        made = anonymize_table(rows, self.row_key, self.mode, self.as_of, known=known)
        if not done:
            new = made.dictionary.entries.join(known.select(*KEY), list(KEY), "left_anti").drop("occurrences")
            new.select(*KEY, "token_no", "token").write.mode("overwrite").parquet(self._place(batch_id))
        return made

    def sink(self, path: str) -> Callable[[DataFrame, int], None]:
        """A function for `foreachBatch` that writes the anonymized batches to `path`, each to a folder that a repetition
        replaces. All columns that could hold a token are text, so that the batches have one schema."""

        def write(rows: DataFrame, batch_id: int) -> None:
            rows = rows.persist()
            try:
                table = self.anonymize(rows, batch_id).table
                texts = [canonical_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) if is_atomic(f.dataType) else F.col(f"`{f.name}`") for f in table.schema.fields]
                table.select(*texts).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{BATCH}={batch_id}")
            finally:
                rows.unpersist()

        return write

    def start(self, stream: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Anonymize a stream into `path`; `trigger` is that of the writer."""
        writer = stream.writeStream.foreachBatch(self.sink(path)).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
