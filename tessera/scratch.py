"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by a written table and not by a checkpointed one: the reader
knows the files' real sizes, while a checkpointed frame keeps the estimate of
its plan, which squares with each self-join of a loop.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Larger tables are not broadcast: coded columns of numbers take some fiftieth of their size in memory.
BROADCAST_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temporary folder is set on a local master and any other is refused."""
    found = spark.conf.get(KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage is its files. Joins on more than BROADCAST_BYTES of files are shuffled."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return table.hint("merge") if files.getContentSummary(folder).getLength() > BROADCAST_BYTES else table


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote and that nothing reads any more, such as the state of a round that has ended."""
    context = df.sparkSession.sparkContext
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("tessera-cut-"):
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> int:
    """Delete what ``cut`` and the training-data operators wrote to the shared folder; the number of folders. Results that still read them can't be read any more."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(root) if f.getPath().getName().startswith("tessera-")] if files.exists(root) else []
    return sum(bool(files.delete(path, True)) for path in found)
