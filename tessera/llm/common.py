"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes of input that one chunk, shard or bucket of an exchange stands for.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the test tables; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns by exact name under new names.

    Unlike ``select`` it stays unambiguous when extra columns have names that
    differ in case only, or that repeat a wanted name (the first one is taken).
    """
    own = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return own.select(*[F.col(f"_c{df.columns.index(old)}").alias(new) for new, old in columns.items()])


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named by number, so that no name can clash, and the number of each name (of its first column)."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), {c: n for c, n in reversed(list(zip(df.columns, names)))}


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset (in
    local tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder."""
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Cut lineage: write df to the shared folder and read it again."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_path(spark, name)
    df.write.format(fmt).option("compression", "zstd").save(path)
    return spark.read.schema(df.schema).format(fmt).load(path)


#: The most buckets that Spark takes.
MOST_BUCKETS = 100_000


def materialize_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``materialize``, dealt into buckets by ``key``: a grouping by it reads its bucket and needs no exchange of these rows.

    Spark exchanges the rows all the same if there are fewer buckets than
    shuffle partitions, so there are at least as many. The table's entry stays
    in the session's catalog; its files lie in the shared folder.
    """
    spark = df.sparkSession
    small_batches(spark)
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or 0
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(first))
    known = f"tessera-{name}-{uuid.uuid4().hex}"
    own = known.replace("-", "_")
    path = f"{shared_dir(spark)}/{known}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(min(max(buckets, least), MOST_BUCKETS), key).saveAsTable(own)
    return spark.table(own)


#: What Catalyst takes for the size of rows whose size it does not know.
UNKNOWN_BYTES = 1 << 62


def source_bytes(docs: DataFrame) -> int:
    """Catalyst's size estimate of the files below docs (no job runs); where it has none, the bytes of the texts."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if total >= UNKNOWN_BYTES:
        total = pick(docs, text="text").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return total


def pieces(total_bytes: int, each: int = CHUNK_BYTES, least: int = 4) -> int:
    """How many chunks of about ``each`` bytes an input is dealt into; grows with the input."""
    return max(least, math.ceil(total_bytes / each))


#: Rows of an Arrow batch: whole texts, so the default of 10,000 would hold tens of megabytes in each worker.
BATCH_ROWS = "2000"


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, unless the session already does."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > int(BATCH_ROWS):
        spark.conf.set(key, BATCH_ROWS)


def add_columns(df: DataFrame, compute: Callable[[list[str | None]], dict], fields: str, *, source: str = "text") -> DataFrame:
    """Replace the column ``source`` by columns computed from it, batch by batch.

    compute gets a batch's values and returns, for each field, a sequence of as
    many values. All other columns pass as they are (ids keep all their bits).
    """
    small_batches(df.sparkSession)
    new = T.StructType.fromDDL(fields)
    kept = [f for f in df.schema.fields if f.name != source]
    schema = T.StructType(kept + new.fields)
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = compute(batch.column(source).to_pylist())
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array(found[f.name], type=f.type, from_pandas=True) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, chosen: Callable[[list[str | None]], object], *, source: str = "text") -> DataFrame:
    """The rows whose ``source`` value is chosen; columns and their order stay."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(chosen(batch.column(source).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


#: Everything in ASCII that is no digit or lower-case letter; it parts the words of ``ascii_words``.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_words(text):
    """Column: the words of a text after lower-casing A-Z; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def row_key(*columns):
    """Column: a 64-bit key of a row; with the id it tells rows apart, equal rows share it."""
    return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\0")) for c in columns])


#: A key is heavy if it has more than 1 / HEAVY of all rows, so there are at most HEAVY of them.
HEAVY = 10_000


def unique_join(rows: DataFrame, known: DataFrame, keys: list[str], copies: str, value: str) -> DataFrame:
    """rows with the column ``value`` of the row of ``known`` with the same keys, null without one.

    ``known`` has one row a key and the number of its rows in ``copies``. Heavy
    keys, at most HEAVY of them, are broadcast; the others are shuffled, so no
    task gets all rows of a heavy key.
    """
    total = max(1, rows.count())
    heavy = F.col(copies) * HEAVY > total
    hot = known.where(heavy).select(*keys, F.col(value).alias("_heavy"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    done = marked.where("_heavy is not null").withColumnRenamed("_heavy", value)
    return done.unionByName(marked.where("_heavy is null").drop("_heavy").join(known.where(~heavy).select(*keys, value), keys, "left"))
