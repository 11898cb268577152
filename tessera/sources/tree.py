"""A source of folders: a tree listed by the executors, folder by folder.

Each round lists the folders that the last one found, dealt over all tasks, so
the driver never sees a name. A round costs a level of the tree. File names are
taken as the file system gives them (blanks, ``#``, ``%``, accents); a name that
is not text, a link that leaves the tree and a file that can't be read are rows
with a cause. The pattern of file names is applied where folders are listed.

Local folders and every scheme that Arrow opens (hdfs, s3 and s3a, gs, abfs and
abfss) can be listed; any other is refused before a job starts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut

ENTRIES = "path string, parent string, name string, kind string, size long, problem string"
CONTENTS = "path string, content binary, problem string"
#: Names that Hadoop has for schemes that Arrow knows otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}
MAX_BYTES = 16 << 20
# Folders without source of the project, and causes.
SKIPPED = (".git", ".venv", "node_modules", "__pycache__", "build", "dist")
LEAVES = "the link goes to a file that is not in the tree"
NOT_TEXT = "the name is not text"
TOO_LARGE = "too large"


def _place(spark: SparkSession, root: str) -> tuple[str | None, str]:
    """Where a tree lies: the URI of Arrow's file system (None: local), and the folder in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    folder = uri.getPath().rstrip("/")
    if uri.getScheme() == "file":
        return None, folder
    base = f"{SCHEMES.get(uri.getScheme(), uri.getScheme())}://{uri.getAuthority() or ''}/"
    try:
        _, top = FileSystem.from_uri(base)
    except (pa.ArrowException, OSError, ValueError) as error:
        raise ValueError(f"the tree {root} can't be listed by executors: {error}") from error
    return base, top.rstrip("/") + folder


def _local(top: str, folder: str, pattern: str) -> Iterator[tuple]:
    inside = os.path.realpath(top) + os.sep
    with os.scandir(os.path.join(top, folder) if folder else top) as found:
        for entry in found:
            name, problem = entry.name, None
            if not _is_text(name):
                name, problem = name.encode("utf-8", "replace").decode(), NOT_TEXT
            link = entry.is_symlink()
            if link and not (os.path.realpath(entry.path) + os.sep).startswith(inside):
                problem = problem or LEAVES
            if entry.is_dir():
                yield name, "link" if link else "dir", None, problem
            elif fnmatch(name, pattern):
                try:
                    size = entry.stat().st_size if entry.is_file() else None
                except OSError:
                    size = None
                yield name, "file", size, problem or (None if size is not None else "not a regular file")


def _is_text(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def _remote(system: FileSystem, folder: str, pattern: str) -> Iterator[tuple]:
    for info in system.get_file_info(FileSelector(folder)):
        name = info.path.rstrip("/").rpartition("/")[2]
        if info.type == FileType.Directory:
            yield name, "dir", None, None
        elif fnmatch(name, pattern):
            yield name, "file", info.size, None


def entries(spark: SparkSession, root: str, pattern: str = "*", skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, parent, name, kind, size, problem) of the folders and of the files whose name fits below root; paths are relative to it.

    kind is dir, file or link (to a folder; it is not entered). A folder that
    can't be listed is a dir with a problem. Folders named in ``skipped`` are
    left out with all that is in them.
    """
    base, top = _place(spark, root)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = FileSystem.from_uri(base)[0] if base else None
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                out = []
                try:
                    for name, kind, size, problem in _remote(system, f"{top}/{folder}".rstrip("/"), pattern) if system else _local(top, folder, pattern):
                        if kind == "file" or name not in skipped:
                            out.append((f"{folder}/{name}" if folder else name, folder, name, kind, size, problem))
                except (OSError, pa.ArrowException) as error:
                    out.append((folder, folder.rpartition("/")[0], folder.rpartition("/")[2], "unlisted", None, type(error).__name__))
                for at in range(0, len(out), 10_000):
                    columns = list(zip(*out[at : at + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 4 else pa.string()) for i, c in enumerate(columns)], names=[c.split()[0] for c in ENTRIES.split(", ")])

    found, level = None, spark.range(1).select(F.lit("").alias("path"))
    while True:
        level = cut(level.repartition("path").mapInArrow(listed, ENTRIES))
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        level = level.where("kind = 'dir' and problem is null").select("path")
    if found is None:
        return spark.createDataFrame([], ENTRIES)
    unlisted = found.where("kind = 'unlisted'").select("path", F.col("problem").alias("why"))
    told = found.where("kind <> 'unlisted'").join(unlisted, "path", "left")
    return told.select("path", "parent", "name", "kind", "size", F.coalesce("problem", "why").alias("problem"))


def contents(listed: DataFrame, root: str, limit: int = MAX_BYTES) -> DataFrame:
    """(path, content, problem) of the files among entries; one is in memory at a time. What can't be read keeps its row with a cause."""
    base, top = _place(listed.sparkSession, root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = FileSystem.from_uri(base)[0] if base else None
        for batch in batches:
            for path, size, problem in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                content = None
                if problem is None and size > limit:
                    problem = TOO_LARGE
                if problem is None:
                    try:
                        with system.open_input_file(f"{top}/{path}") if system else open(f"{top}/{path}", "rb") as f:
                            content = f.read()
                    except (OSError, pa.ArrowException) as error:
                        problem = type(error).__name__
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary()), pa.array([problem], pa.string())], names=["path", "content", "problem"])

    return listed.where("kind = 'file'").select("path", "size", "problem").mapInArrow(read, CONTENTS)
