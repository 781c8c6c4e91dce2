"""Where long plans and rounds are cut."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def over_cores(df: DataFrame, row_id: str, rows: int | None = None, a_task: int = 20_000, a_core: int = 2) -> DataFrame:
    """The rows (counted, unless told) dealt to tasks by a hash of row_id and sorted by it, for work that passes over them many times: a small file, or a join of few keys, is one task otherwise. Tasks have ``a_task`` rows, or more if that many tasks would be above ``a_core`` a core."""
    rows = df.count() if rows is None else rows
    tasks = max(1, min(-(-rows // a_task), a_core * df.sparkSession.sparkContext.defaultParallelism))
    return df.repartition(tasks, row_id).sortWithinPartitions(row_id)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as they are now, in the folder of ``spark.checkpoint.dir``. A local session without one gets a folder of its own; a cluster has to name one that all executors share."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a shared folder")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
