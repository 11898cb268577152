"""Incremental and streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def debounce(changes: DataFrame, quiet_seconds: int, by: str) -> DataFrame:
    """Batch form: one row for each burst of changes (by, ts) whose gaps are below the quiet period."""
    w = Window.partitionBy(by).orderBy("ts")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    burst = F.sum(F.when(gap.isNull() | (gap >= quiet_seconds * 1_000_000), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return changes.withColumn("burst", burst).groupBy(by, "burst").agg(F.count("*").alias("changes"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("burst")


def debounce_stream(changes: DataFrame, quiet_seconds: int, by: str, late_seconds: int = 60) -> DataFrame:
    """Stream form: a session window closes after the quiet period, and the watermark emits it."""
    session = F.session_window("ts", f"{quiet_seconds} seconds")
    return changes.withWatermark("ts", f"{late_seconds} seconds").groupBy(session.alias("s"), by).agg(F.count("*").alias("changes"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("s")


def newest(versions: DataFrame, by: str, order: str) -> DataFrame:
    """Coalescing: the newest version of each key."""
    return versions.groupBy(by).agg(F.max_by(F.struct(*[c for c in versions.columns if c != by]), order).alias("v")).select(by, "v.*")


def changed_only(files: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (path, digest) that must be computed again."""
    return files.join(known.select("path", "digest"), ["path", "digest"], "left_anti")


def refresh(files: DataFrame, known: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Facts of all files: kept where the digest is known, computed elsewhere; vanished files go."""
    kept = known.join(files.select("path", "digest"), ["path", "digest"], "left_semi")
    return kept.unionByName(compute(changed_only(files, known)))


def follow_batches(stream: DataFrame, render: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``render`` once a micro-batch; a failing batch keeps the last good version and is reported."""
    failed: list[tuple[int, str]] = []

    def one(batch: DataFrame, number: int) -> None:
        try:
            render(batch, number)
        except Exception as error:  # the live view must outlive one bad version
            failed.append((number, str(error)))

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
    return query, failed
