"""Intermediate tables that every executor can read, and plans whose joins may split a hot key."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is written: its shuffle files go when it ends, and Arrow batches are small, so that Python workers hold a few megabytes of long texts each.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where unset in a local session, as in tests, a new temporary one. A cluster must name one, as its executors share no other."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors can reach")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _gone(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, drop: DataFrame | None = None, wide: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Lineage ends at the files, so a lost executor costs no recomputation, and the
    rows read back have no known partitioning: a join over them shuffles both sides, which lets adaptive execution
    split a hot key. ``drop``: an earlier result of this function that is no longer needed. ``wide``: rows are large; they are then read
    in the task's own thread, as each thread of Parquet's vectored reads keeps a direct buffer as large as what it has read at once.
    """
    spark = df.sparkSession
    path = f"{_own(spark)}{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if drop is not None:
        discard(drop)
    reader = spark.read.option("parquet.hadoop.vectored.io.enabled", "false") if wide else spark.read
    out = reader.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def _own(spark: SparkSession) -> str:
    """What the paths of this application's tables begin with."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}-"


def sweep(spark: SparkSession) -> None:
    """Delete all tables of this application that are left, such as those that lazy results still read: to be called when these have been written."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{_own(spark)}*")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(pattern) or ():
        fs.delete(found.getPath(), True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that no later plan reads."""
    if path := getattr(df, "_llm_path", None):
        _gone(df.sparkSession, path)


def spread_key(*keys: str) -> Column:
    """A grouping expression to add to groupBy(*keys): the aggregate is then not partitioned by the keys alone, so a later join shuffles both of its sides and a hot key can be split."""
    return F.pmod(F.xxhash64(*keys), F.lit(8)).cast("byte").alias("_spread")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
