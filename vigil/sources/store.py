"""Tables of files that take each run's rows once: data staged by attempt, one manifest entry per run.

A table is a folder with ``data`` (Parquet, by run and attempt, and by month if asked for) and ``manifest`` (a small file
per run that names the attempt that counts). Rows of attempts that the manifest doesn't name are never read, so a job
that fails, or is tried again, leaves the table as it was; an entry is made once and never changed. Entries are
created and listed through Spark's file systems, so any store that Spark reads will do; the store must refuse to create
a file that exists, as HDFS does.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARTS = ("run", "attempt")
MANIFEST = "run string, attempt string"


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _entry(path: str, run: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", run):
        raise ValueError(f"not a name for a run: {run!r}")
    return f"{path}/manifest/{run}.json"


def is_committed(spark: SparkSession, path: str, run: str) -> bool:
    files, where = _file(spark, _entry(path, run))
    return files.exists(where) and files.getFileStatus(where).getLen() > 0


def _commit(spark: SparkSession, path: str, run: str, attempt: str) -> bool:
    """Makes the run's entry; false if there is one by now. An empty entry is one that was never finished."""
    if is_committed(spark, path, run):
        return False
    files, where = _file(spark, _entry(path, run))
    if files.exists(where):
        files.delete(where, False)
    try:
        out = files.create(where, False)
    except Exception as e:
        if is_committed(spark, path, run):
            return False
        raise RuntimeError(f"no entry could be made for run {run}") from e
    out.write(bytearray(json.dumps({"run": run, "attempt": attempt}).encode()))
    out.close()
    return True


def store(df: DataFrame, path: str, run: str, month_of: str | None = None) -> bool:
    """Adds the rows of a run to the table, by month of a date or time column if one is named; false if the run is there.

    What is stored counts from the moment the manifest names it. Two attempts at once both write, and one counts.
    """
    spark = df.sparkSession
    if is_committed(spark, path, run):
        return False
    attempt = uuid.uuid4().hex
    rows = df.withColumns({"run": F.lit(run), "attempt": F.lit(attempt)})
    parts = list(PARTS)
    if month_of:
        rows, parts = rows.withColumn("month_part", F.date_format(month_of, "yyyy-MM")), ["month_part", *parts]
    rows.write.partitionBy(*parts).mode("append").parquet(f"{path}/data")
    return _commit(spark, path, run, attempt)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(run, attempt) of the runs that count."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest").filter("run is not null")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], MANIFEST)
        raise


def read(spark: SparkSession, path: str, schema: StructType, by_month: bool = False) -> DataFrame:
    """The rows of all runs that count, with their run (and month_part); without any, an empty table of the schema."""
    whole = StructType(list(schema)).add("month_part", "string") if by_month else StructType(list(schema))
    whole = whole.add("run", "string").add("attempt", "string")
    try:
        rows = spark.read.schema(whole).option("basePath", f"{path}/data").parquet(f"{path}/data")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], whole).drop("attempt")
        raise
    return rows.join(manifest(spark, path), list(PARTS), "left_semi").drop("attempt")


def left_over(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(run, attempt, n): what attempts that don't count have left, for whoever clears up."""
    rows = spark.read.schema(StructType(list(schema)).add("run", "string").add("attempt", "string")).parquet(f"{path}/data")
    return rows.join(manifest(spark, path), list(PARTS), "left_anti").groupBy(*PARTS).agg(F.count(F.lit(1)).alias("n"))
