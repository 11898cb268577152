"""The fold of live events: the state of each live view after its event lines, as a stream and as a batch.

Lines are JSON objects with an ``event``: ``serving`` (url), ``rendering``,
``rendered`` (version, updates, svg_bytes), ``error`` (version, text), ``stopped``
and ``change`` (path). Any other line leaves the state as it is. ``good`` is the
version of the last successful rendering; an error doesn't take it away. A
change opens a quiet period, a later one moves its end, and when it is over
the view is due: one row with the number of changes.

The stream keeps the state of a view in the state store, with one timer for
its quiet period in event time, so a restart from the checkpoint goes on where
it stopped. Within a batch the lines of a view are folded by (ts, line).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIELDS = "event string, url string, version double, updates double, svg_bytes double, text string, path string"
EVENTS = ("serving", "rendering", "rendered", "error", "stopped", "change")
STATE = "url string, phase string, version long, updates long, good long, svg_bytes long, error string"
WAITING = "changes long, due long"
RESULT = f"view string, what string, ts timestamp, changes long, {STATE}"
START = ("", "", 0, 0, 0, 0, "")


def read_events(lines: DataFrame) -> DataFrame:
    """view, ts, line and the fields of the lines (view, ts, line) that are events; a field of another type is '' or 0."""
    text = F.trim(F.col("line"))
    whole = F.try_parse_json(F.when(text.startswith("{"), text))  # from_json would take the first fields of a broken line
    own = lines.select("view", "ts", "line", F.from_json(F.when(whole.isNotNull(), text), FIELDS).alias("e")).where(F.col("e.event").isin(*EVENTS))
    number = lambda c: F.coalesce(F.col(f"e.{c}").cast("long"), F.lit(0).cast("long")).alias(c)
    said = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit("")).alias(c)
    first = F.coalesce(F.get(F.filter(F.transform(F.split(F.coalesce("e.text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))
    return own.select("view", "ts", "line", F.col("e.event").alias("event"), said("url"), number("version"), number("updates"), number("svg_bytes"), first.alias("text"))


def apply_event(state: tuple, event) -> tuple:
    """The state after one event; ``change`` and ``stopped`` leave it."""
    url, phase, version, updates, good, size, error = state
    if event.event == "serving":
        url = event.url
    elif event.event == "rendering":
        phase = "rendering"
    elif event.event == "rendered":
        phase, version, updates, good, size, error = "ready", event.version, event.updates, event.version, event.svg_bytes, ""
    elif event.event == "error":
        phase, version, error = "error", event.version, event.text
    return url, phase, version, updates, good, size, error


class Fold(StatefulProcessor):
    """State and quiet period of one view."""

    def __init__(self, quiet_seconds: int):
        self.quiet = quiet_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.waiting = handle.getValueState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.state.get()) if self.state.exists() else START
        changes, due = tuple(self.waiting.get()) if self.waiting.exists() else (0, 0)
        frame = pd.concat(list(rows)).sort_values(["ts", "line"], kind="stable")
        before = due
        for event in frame.itertuples(index=False):
            now = apply_event(now, event)
            if event.event == "change":
                changes, due = changes + 1, max(due, int(event.ts.timestamp() * 1000) + self.quiet)
        self.state.update(tuple(now))
        if due != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.waiting.update((changes, due))
        yield _row(key[0], "state", frame["ts"].iloc[-1], changes, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        changes, due = tuple(self.waiting.get())
        now = tuple(self.state.get()) if self.state.exists() else START
        self.waiting.clear()
        yield _row(key[0], "due", pd.Timestamp(due, unit="ms"), changes, now)

    def close(self) -> None:
        pass


def _row(view: str, what: str, ts: pd.Timestamp, changes: int, state: tuple) -> pd.DataFrame:
    return pd.DataFrame([(view, what, ts, changes, *state)], columns=[c.split()[0] for c in RESULT.split(", ")])


def fold_stream(lines: DataFrame, quiet_seconds: int, late_seconds: int = 60) -> DataFrame:
    """Rows (``RESULT``): the state of a view after each batch with lines of it, and a row ``due`` at the end of each quiet period."""
    events = read_events(lines).withWatermark("ts", f"{late_seconds} seconds")
    return events.groupBy("view").transformWithStateInPandas(Fold(quiet_seconds), RESULT, "append", "eventTime")


def fold(lines: DataFrame) -> DataFrame:
    """(view, url, phase, version, updates, good, svg_bytes, error): the state after all lines. One aggregation: each field has a last event that sets it."""
    events = read_events(lines).withColumn("at", F.struct("ts", "line"))
    on = lambda *names: F.col("event").isin(*names)
    last = lambda value, *names: F.max_by(F.when(on(*names), value), F.when(on(*names), F.col("at")))
    phases = F.when(on("rendering"), "rendering").when(on("rendered"), "ready").otherwise("error")
    shown = events.groupBy("view").agg(
        last(F.col("url"), "serving").alias("url"), last(phases, "rendering", "rendered", "error").alias("phase"), last(F.col("version"), "rendered", "error").alias("version"), last(F.col("updates"), "rendered").alias("updates"),
        last(F.col("version"), "rendered").alias("good"), last(F.col("svg_bytes"), "rendered").alias("svg_bytes"), last(F.when(on("error"), F.col("text")).otherwise(""), "rendered", "error").alias("error"),
    )
    blank = {"url": "", "phase": "", "version": 0, "updates": 0, "good": 0, "svg_bytes": 0, "error": ""}
    return shown.select("view", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in blank.items()])


def due_times(lines: DataFrame, quiet_seconds: int) -> DataFrame:
    """(view, due, changes): the quiet periods of all changes as a batch. A change less than the quiet period after the last one moves its end."""
    changes = read_events(lines).where("event = 'change'").select("view", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    order = Window.partitionBy("view").orderBy("at")
    quiet = quiet_seconds * 1000
    opens = F.when(F.col("at") - F.lag("at").over(order) < quiet, 0).otherwise(1)
    period = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = changes.withColumn("opens", opens).withColumn("period", period)
    return numbered.groupBy("view", "period").agg((F.max("at") + quiet).alias("due"), F.count("*").alias("changes")).drop("period")


def follow_versions(stream: DataFrame, render: Callable[[DataFrame, int], None], checkpoint: str, outcomes: str):
    """Run ``render`` once a micro-batch and write how it ended to the table ``outcomes``, a partition a batch.

    A batch that fails is a row with its error, so a restart finds what the
    stream before it did; a batch that is run again replaces its row.
    """

    def one(batch: DataFrame, number: int) -> None:
        error = None
        try:
            render(batch, number)
        except Exception as problem:  # the live view must outlive one bad version
            error = f"{type(problem).__name__}: {problem}"
        batch.sparkSession.createDataFrame([(number, error)], "number long, error string").coalesce(1).write.mode("overwrite").parquet(f"{outcomes}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def last_good(spark: SparkSession, outcomes: str) -> int | None:
    """The last batch that was rendered, over all runs; None if none was."""
    return spark.read.schema("number long, error string, batch long").parquet(outcomes).where("error is null").agg(F.max("number")).first()[0]
