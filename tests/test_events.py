"""The fold of live events: as a batch, as a stream, and across a stop and a restart."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.streaming import events

START = datetime(2024, 1, 1)
SCHEMA = "view string, ts timestamp, line string"


def at(seconds):
    return START + timedelta(seconds=seconds)


def line(**fields):
    return json.dumps(fields)


LINES = [
    ("a", at(0), line(event="serving", url="http://localhost:1")), ("a", at(1), line(event="rendering", version=1)), ("a", at(2), line(event="rendered", version=1, updates=3, svg_bytes=10)),
    ("a", at(3), "not json"), ("a", at(4), '{"event": "rendered", "version": 9'), ("a", at(5), "[1]"), ("a", at(6), line(event="other", version=8)), ("a", at(7), line(event="error", version=2, text="\n  bad name \nmore")),
    ("a", at(8), line(event="change", path="x.py")), ("a", at(10), line(event="change", path="y.py")), ("a", at(20), line(event="change", path="x.py")), ("b", at(1), line(event="rendering", version="no")), ("b", at(2), line(event="stopped")),
]


def plain(rows):
    """Each view's state by a walk over its lines."""
    out = {}
    for view, _, text in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        try:
            e = json.loads(text)
        except ValueError:
            continue
        if not isinstance(e, dict) or e.get("event") not in events.EVENTS:
            continue
        s = out.setdefault(view, {"url": "", "phase": "", "version": 0, "updates": 0, "good": 0, "svg_bytes": 0, "error": ""})
        if e["event"] == "serving":
            s["url"] = e["url"]
        elif e["event"] == "rendering":
            s["phase"] = "rendering"
        elif e["event"] == "rendered":
            s |= {"phase": "ready", "version": e["version"], "good": e["version"], "updates": e.get("updates", 0), "svg_bytes": e.get("svg_bytes", 0), "error": ""}
        elif e["event"] == "error":
            s |= {"phase": "error", "version": e["version"], "error": next((t.strip() for t in e["text"].split("\n") if t.strip()), "")}
    return out


def states(df):
    return {r.view: {c: r[c] for c in ("url", "phase", "version", "updates", "good", "svg_bytes", "error")} for r in df.collect()}


def test_the_batch_fold_equals_a_walk(spark):
    dice = random.Random(1)
    rows = list(LINES)
    for i in range(300):
        kind = dice.choice(["serving", "rendering", "rendered", "error", "change", "stopped", "x"])
        rows.append((f"v{dice.randrange(12)}", at(dice.randrange(10**6)), dice.choice([line(event=kind, url=f"u{i}", version=i, updates=i % 7, svg_bytes=i * 2, text=f"e{i}"), line(event=kind, url=f"u{i}", version=i, updates=i % 7, svg_bytes=i * 2, text=f"e{i}"), "{broken"])))
    assert states(events.fold(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    due = events.due_times(spark.createDataFrame(LINES, SCHEMA), 5).select(F.col("view"), ((F.col("due") - F.unix_millis(F.lit(START).cast("timestamp"))) / 1000).cast("int").alias("due"), "changes")
    assert sorted(tuple(r) for r in due.collect()) == [("a", 15, 2), ("a", 25, 1)]
    assert events.fold(spark.createDataFrame([], SCHEMA)).count() == 0


def run(spark, tmp_path, name):
    query = events.fold_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), 5, 0).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").format("parquet").option("path", f"{tmp_path}/out").queryName(name).start()
    query.processAllAvailable()
    query.stop()


def test_the_stream_goes_on_after_a_restart(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([r for r in LINES if r[1] <= at(9)])
    run(spark, tmp_path, "one")
    put([r for r in LINES if r[1] > at(9)])
    run(spark, tmp_path, "two")
    put([("c", at(1000), line(event="serving", url="later"))])  # moves the watermark beyond all quiet periods
    run(spark, tmp_path, "three")
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    due = sorted((r.view, (r.ts - START).total_seconds(), r.changes) for r in out if r.what == "due")
    assert due[-1] == ("a", 25, 3) or due == [("a", 15, 2), ("a", 25, 1)], due
    last = max((r for r in out if r.view == "a" and r.what == "due"), key=lambda r: r.ts)
    assert (last.phase, last.good, last.version, last.error, last.url) == ("error", 1, 2, "bad name", "http://localhost:1")


def test_outcomes_outlive_the_stream(spark, tmp_path):
    put = lambda n: spark.range(n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []

    def render(batch, number):
        seen.append((number, batch.count()))
        if seen[-1][1] == 2:
            raise ValueError("bad version")

    for n in (3, 2):
        put(n)
        query = events.follow_versions(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), render, f"{tmp_path}/cp", f"{tmp_path}/outcomes")
        query.processAllAvailable()
        query.stop()
    assert seen == [(0, 3), (1, 2)] and events.last_good(spark, f"{tmp_path}/outcomes") == 0
    assert [r.error for r in spark.read.parquet(f"{tmp_path}/outcomes").orderBy("number").collect()] == [None, "ValueError: bad version"]
