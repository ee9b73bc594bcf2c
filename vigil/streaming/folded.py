"""A small table kept by a stream: a part per batch, folded into one part now and then.

Batch by batch only the rows that changed are written. Every so many batches all parts are merged into a base; what the
base before the last one covers is deleted, so that a reader opens a bounded number of folders whatever the number of
batches, and a batch that is tried again still finds what it had found before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVERY = 16  # batches from one base to the next


class Folded:
    """``merge`` makes one value of those of a key: rows of a key are added up, or the newest batch's row counts."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], value: str, schema: str, newest: bool = False, every: int = EVERY):
        self.spark, self.folder, self.keys, self.value, self.newest, self.every = spark, folder, keys, value, newest, every
        self.schema = StructType.fromDDL(schema)

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _parts(self, kind: str) -> list[int]:
        """Numbers of the whole parts of a kind (batch or base), in order."""
        files, where = self._files()
        if not files.exists(where):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [f.getPath().getName() for f in files.listStatus(where) if f.isDirectory()]
        whole = [n for n in names if n.startswith(f"{kind}=") and files.exists(path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in whole)

    def _merged(self, rows: DataFrame) -> DataFrame:
        value: Column = F.max_by(self.value, "at") if self.newest else F.sum(self.value)
        return rows.groupBy(*self.keys).agg(value.alias(self.value))

    def upto(self, batch: int | None = None) -> DataFrame:
        """(keys, value) of all batches up to this one."""
        batch = max(self._parts("batch") + self._parts("base"), default=-1) if batch is None else batch
        base = max((n for n in self._parts("base") if n <= batch), default=-1)
        out = self.spark.createDataFrame([], self.schema).withColumn("at", F.lit(-1))
        folders = ([(base, f"{self.folder}/base={base}")] if base >= 0 else []) + [
            (n, f"{self.folder}/batch={n}") for n in self._parts("batch") if base < n <= batch
        ]
        for number, folder in folders:
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(folder).withColumn("at", F.lit(number)))
        return self._merged(out)

    def put(self, changed: DataFrame, batch: int) -> None:
        """The changed rows of a batch, in place of those of an earlier try."""
        changed.select(*self.keys, self.value).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        if batch % self.every == self.every - 1:
            self.upto(batch).write.mode("overwrite").parquet(f"{self.folder}/base={batch}")
            self._clear()

    def _clear(self) -> None:
        bases = self._parts("base")
        if len(bases) < 2:
            return
        files, _ = self._files()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for n in bases[:-2]:
            files.delete(path(f"{self.folder}/base={n}"), True)
        for n in self._parts("batch"):
            if n <= bases[-2]:
                files.delete(path(f"{self.folder}/batch={n}"), True)
