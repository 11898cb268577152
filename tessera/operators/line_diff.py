"""Line differences of many files at once: patience diff as joins, hunks as islands.

A pair of equal lines that is taken splits a file into gaps; a gap is named by
the old place of the pair before it, so lines of both sides know their gap. In a
round each gap gives up its equal lines at the start and at the end, and then
its anchors: lines that stand once on each side (an equi-join), of which the
longest rising run is taken, a fold over the anchors of a gap. Rounds end when
no gap gives a pair; what is left is removed and added. A round takes lines
that are not matched yet only.

Defined results: a text is cut at line feeds, so an empty text is one empty
line; a null text is no file (all lines of the other side are added or
removed); keys must be unique on each side.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut, release

#: Unchanged lines around a change.
CONTEXT = 3
HUNK = "path string, hunk long, old_start long, old_lines long, new_start long, new_lines long, lines array<string>"


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, n, line) of files (path, text); n from 0."""
    return files.where("text is not null").select("path", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).select("path", F.col("n").cast("long").alias("n"), "line")


def longest_rising(frame: pd.DataFrame) -> pd.DataFrame:
    """The longest run of anchors (i, j) that rises on both sides."""
    frame = frame.sort_values("i", kind="stable")
    ends, at, before = [], [], []
    for place, j in enumerate(frame["j"]):
        k = bisect_left(ends, j)
        before.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(j)
            at.append(place)
        else:
            ends[k], at[k] = j, place
    run, place = [], at[-1] if at else -1
    while place >= 0:
        run.append(place)
        place = before[place]
    return frame.iloc[run[::-1]][["path", "i", "j"]]


def _equal_edge(old: DataFrame, new: DataFrame, end: bool) -> DataFrame:
    """Pairs (path, i, j) of the equal lines with which both sides of a gap begin (or end)."""
    gap = Window.partitionBy("path", "gap")
    ranked = lambda side, n: side.withColumn("r", F.row_number().over(gap.orderBy(F.desc(n) if end else n)))
    both = ranked(old, "i").join(ranked(new, "j").withColumnRenamed("line", "other"), ["path", "gap", "r"])
    first_odd = F.min(F.when(F.col("line") != F.col("other"), F.col("r"))).over(gap)
    return both.withColumn("odd", first_odd).where("odd is null or r < odd").select("path", "i", "j")


def _anchors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs of lines that stand once on each side of a gap, in the longest rising run of the gap."""
    once = lambda side, n: side.groupBy("path", "gap", "line").agg(F.count("*").alias("k"), F.min(n).alias(n)).where("k = 1").drop("k")
    both = once(old, "i").join(once(new, "j"), ["path", "gap", "line"]).select("path", "gap", "i", "j")
    return both.groupBy("path", "gap").applyInPandas(longest_rising, "path string, i long, j long")


def _regapped(side: DataFrame, n: str, pairs: DataFrame) -> DataFrame:
    """The lines of a side that no pair took, each with the old place of the last pair before it."""
    taken = pairs.select("path", n, F.col("i").alias("pair"))
    order = Window.partitionBy("path").orderBy(n)
    told = side.join(taken, ["path", n], "left") if n != "i" else side.join(taken.select("path", "i", F.col("i").alias("pair")), ["path", "i"], "left")
    # A gap's own name holds until a new pair inside it comes before the line.
    last = F.last("pair", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return told.withColumn("gap", F.greatest("gap", F.coalesce(last, F.col("gap")))).where("pair is null").drop("pair")


def matched(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, removed, added): pairs (path, i, j) of lines (path, n, line) that stay, and the places of the others (path, i or j) with their gap.

    The rounds hold a line of 32 bytes or more by its SHA-256, and a round's
    tables are deleted when the next ones are written.
    """
    start = F.lit(-1).cast("long")
    told = F.when(F.octet_length("line") < 32, F.col("line").cast("binary")).otherwise(F.unhex(F.sha2("line", 256))).alias("line")
    old = cut(old.select("path", F.col("n").alias("i"), told, start.alias("gap")))
    new = cut(new.select("path", F.col("n").alias("j"), told, start.alias("gap")))
    pairs = None
    while True:
        found = 0
        for step in (lambda a, b: _equal_edge(a, b, False), lambda a, b: _equal_edge(a, b, True), _anchors):
            taken = cut(step(old, new))
            if taken.isEmpty():
                continue
            found += 1
            pairs = taken if pairs is None else pairs.unionByName(taken)
            before, old, new = (old, new), cut(_regapped(old, "i", taken)), cut(_regapped(new, "j", taken))
            for side in before:
                release(side)
        if not found:
            break
    if pairs is None:
        pairs = old.select("path", "i", F.col("i").alias("j")).limit(0)
    return pairs, old.select("path", "i", "gap"), new.select("path", "j", "gap")


def hunks(old: DataFrame, new: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Hunks of the differences between files old and new (path, text): places from 0, lines marked with a blank, ``-`` or ``+``."""
    before, after = numbered_lines(old), numbered_lines(new)
    pairs, removed, added = matched(before, after)
    # Texts meet their places here only: old lines once, new ones if they are added.
    stay = pairs.select("path", "i", F.col("i").alias("gap"), F.lit(0).alias("kind")).unionByName(removed.withColumn("kind", F.lit(1)))
    mark = F.when(F.col("kind") == 0, " ").otherwise("-")
    both = stay.join(before.withColumnRenamed("n", "i"), ["path", "i"]).select("path", "gap", "kind", F.col("i").alias("n"), F.concat(mark, "line").alias("line"))
    come = added.join(after.withColumnRenamed("n", "j"), ["path", "j"]).select("path", "gap", F.lit(2).alias("kind"), F.col("j").alias("n"), F.concat(F.lit("+"), "line").alias("line"))
    order = Window.partitionBy("path").orderBy("gap", "kind", "n")
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda *kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("long")).over(running), F.lit(0).cast("long"))
    near = F.max((F.col("kind") > 0).cast("int")).over(order.rowsBetween(-context, context))
    told = both.unionByName(come).select("path", "kind", "line", "gap", "n", F.row_number().over(order).cast("long").alias("at"), count(0, 1).alias("old"), count(0, 2).alias("new"), near.alias("near")).where("near = 1")
    by_place = Window.partitionBy("path").orderBy("at")
    opens = (F.col("at") != F.lag("at", 1, -1).over(by_place) + 1).cast("long")
    islands = told.withColumn("opens", opens).withColumn("hunk", F.sum("opens").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    size = lambda *kinds: F.sum(F.col("kind").isin(*kinds).cast("long"))
    return islands.groupBy("path", "hunk").agg(F.min("old").alias("old_start"), size(0, 1).alias("old_lines"), F.min("new").alias("new_start"), size(0, 2).alias("new_lines"), lines.alias("lines"))


def applied(old: DataFrame, found: DataFrame) -> DataFrame:
    """(path, text): old files with hunks applied. A hunk whose lines are not those of the file leaves the file's text null."""
    lines = numbered_lines(old)
    shown = found.select("path", "old_start", F.posexplode("lines").alias("at", "line")).withColumn("mark", F.substring("line", 1, 1)).withColumn("line", F.expr("substr(line, 2)"))
    order = Window.partitionBy("path", "old_start").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.withColumn("n", F.col("old_start") + F.coalesce(F.sum((F.col("mark") != "+").cast("long")).over(order), F.lit(0)))
    touched = placed.where("mark <> '+'").select("path", "n", "mark", F.col("line").alias("shown"))
    both = lines.join(touched, ["path", "n"], "full")
    odd = both.where("shown is not null and not shown <=> line").select("path").distinct().withColumn("odd", F.lit(True))
    stay = both.where("mark is null or mark = ' '").select("path", "n", F.lit(1 << 30).alias("at"), "line")
    come = placed.where("mark = '+'").select("path", "n", "at", "line")
    every = stay.unionByName(come).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return every.join(odd, "path", "left").select("path", F.when(F.col("odd").isNull(), F.col("text")).alias("text"))


def unified(found: DataFrame) -> DataFrame:
    """(path, diff): the hunks of a file as unified text."""
    span = lambda start, n: F.concat_ws(",", (F.col(start) + F.when(F.col(n) > 0, 1).otherwise(0)).cast("string"), F.when(F.col(n) != 1, F.col(n).cast("string")))
    text = F.concat_ws("\n", F.concat(F.lit("@@ -"), span("old_start", "old_lines"), F.lit(" +"), span("new_start", "new_lines"), F.lit(" @@")), F.array_join("lines", "\n"))
    head = F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n"))
    return found.groupBy("path").agg(F.concat(head, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk", text.alias("t")))), lambda x: x["t"]), "\n"), F.lit("\n")).alias("diff"))


def capped(diffs: DataFrame, cap: int) -> DataFrame:
    """(selection, diff): the diffs (selection, path, diff) of each selection one after the other, of at most cap characters.

    Lengths are added up first, so no text beyond the cap is gathered.
    """
    before = Window.partitionBy("selection").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    told = diffs.withColumn("start", F.coalesce(F.sum(F.length("diff")).over(before), F.lit(0))).where(F.col("start") < cap)
    short = told.select("selection", "path", F.expr(f"substr(diff, 1, cast({cap} - start as int))").alias("diff"))
    return short.groupBy("selection").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "diff"))), lambda x: x["diff"]), "").alias("diff"))
