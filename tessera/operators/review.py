"""Stateful parts: answers that suppress findings, review states, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def apply_answers(lines: DataFrame, answers: DataFrame) -> DataFrame:
    """Every line's state: answered, pending or open.

    lines: line, kind, p, q, sdk, evidence. answers: selector (item, kind, into,
    from or sdk), value, evidence, policy. An item needs the line's digest, a
    family needs ``policy``. One equi-join a selector, no scan of lines by answers.
    """
    keys = {"item": "line", "kind": "kind", "into": "q", "from": "p", "sdk": "sdk"}
    hits = None
    for selector, column in keys.items():
        own = answers.where(F.col("selector") == selector).select(F.col("value").alias(column), F.col("evidence").alias("given"), "policy")
        ok = (F.col("given") == F.col("evidence")) if selector == "item" else F.col("policy")
        hit = lines.join(own, column).select("line", F.coalesce(ok, F.lit(False)).alias("ok"))
        hits = hit if hits is None else hits.unionByName(hit)
    best = hits.groupBy("line").agg(F.bool_or("ok").alias("ok"))
    return lines.join(best, "line", "left").select("line", F.when(F.col("ok"), "answered").when(F.col("ok").isNotNull(), "pending").otherwise("open").alias("state"))


def stale_answers(answers: DataFrame, lines: DataFrame) -> DataFrame:
    """Items that match no line."""
    return answers.where("selector = 'item'").select(F.col("value").alias("line")).join(lines.select("line"), "line", "left_anti")


def review_state(reviews: DataFrame) -> DataFrame:
    """(key, state): missing without a recorded digest, current if it is the digest now, else stale."""
    state = F.when(F.col("recorded").isNull(), "missing").when(F.col("recorded") == F.col("digest"), "current").otherwise("stale")
    return reviews.select("key", state.alias("state"))


def verdict_states(verdicts: DataFrame, limit: int = 3, weak_limit: int = 2) -> DataFrame:
    """The state after every verdict of a request (key, seq, verdict).

    ``supported`` resets both counters; ``contradicted`` and ``insufficient``
    count each for itself, and at its limit the state is ``unknown``.
    """
    w = Window.partitionBy("key").orderBy("seq")
    run = F.sum(F.when(F.col("verdict") == "supported", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    since = Window.partitionBy("key", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = verdicts.withColumn("run", run).withColumn("attempts", F.count_if(F.col("verdict") == "contradicted").over(since)).withColumn("weak", F.count_if(F.col("verdict") == "insufficient").over(since))
    over = ((F.col("verdict") == "contradicted") & (F.col("attempts") >= limit)) | ((F.col("verdict") == "insufficient") & (F.col("weak") >= weak_limit))
    return counted.select("key", "seq", "verdict", "attempts", "weak", F.when(over, "unknown").otherwise(F.col("verdict")).alias("state"))


def submit(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Verdicts of a submission, all or nothing: (id, accepted, problem)."""
    n = F.count("*").over(Window.partitionBy("id"))
    known = requests.select("id", F.lit(True).alias("known")).distinct()
    problem = F.when(F.col("n") > 1, "duplicate").when(F.col("known").isNull(), "unknown request").when(~F.col("verdict").isin("supported", "contradicted", "insufficient"), "bad verdict")
    checked = items.withColumn("n", n).join(known, "id", "left").withColumn("problem", problem)
    bad = checked.agg(F.coalesce(F.bool_or(F.col("problem").isNotNull()), F.lit(False)).alias("bad"))
    return checked.crossJoin(F.broadcast(bad)).select("id", (~F.col("bad")).alias("accepted"), F.coalesce("problem", F.lit("")).alias("problem"))
