"""Settings that files inherit from each other, and targets chosen by conditions.

Inheritance: each file's chain of ``extends`` is walked in rounds, all files at
once. Every file on the way has a precedence: its own settings first, then those
of the last file that it extends with all that is above it, and so on backwards.
A setting is the value of the file with the best precedence, with the folder of
the file that gives it. Loops and missing files are rows with a cause.

Conditions: a specifier is matched with an exact key, else with the pattern key
that has the longest text before its ``*``, then the longest one; the keys are
found by an equi-join with the specifier's own prefixes, so no specifier is held
against every key. Of the key's targets the first in the file's order counts
whose conditions are all active; an explicit null blocks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from .graph import cyclic_core, strongly_connected

TARGETS = "package string, section string, key string, seq int, conditions array<string>, target string, listed boolean"


def chain(extends: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, at, rank) of all files that a file takes settings from, itself included, and problems (path, at, cause).

    extends: path, pos, parent (files in the order in which they are extended);
    files: path. Of two ways to one file the one with the better precedence
    stays: what it gives there can't be given by the other.
    """
    here = files.select("path").distinct()
    last = F.max("pos").over(Window.partitionBy("path"))
    links = cut(extends.select("path", "parent", (last - F.col("pos")).cast("int").alias("step")).dropDuplicates(["path", "parent", "step"]))
    missing = links.join(here.withColumnRenamed("path", "parent"), "parent", "left_anti").select(F.col("path").alias("at"), F.concat(F.lit("the file "), "parent", F.lit(" is not available")).alias("cause"))
    up = links.join(here.withColumnRenamed("path", "parent"), "parent").select(F.col("path").alias("at"), "parent", "step")
    found = cut(here.select("path", F.col("path").alias("at"), F.array().cast("array<int>").alias("rank")))
    new = found
    while True:
        reached = new.join(up, "at").select("path", F.col("parent").alias("at"), F.array_append("rank", F.col("step")).alias("rank")).groupBy("path", "at").agg(F.min("rank").alias("rank"))
        new = cut(reached.join(found.withColumnRenamed("rank", "had"), ["path", "at"], "left").where("had is null or rank < had").where("path <> at").select("path", "at", "rank"))
        if new.isEmpty():
            break
        found = cut(found.join(new.select("path", "at"), ["path", "at"], "left_anti").unionByName(new))
    core = cyclic_core(up.select(F.col("at").alias("src"), F.col("parent").alias("dst")))
    loops = strongly_connected(core)
    inside = loops.join(loops.groupBy("component").agg(F.count("*").alias("k")).where("k > 1").select("component"), "component", "left_semi").select(F.col("node").alias("at"))
    alone = up.where("at = parent").select("at")
    looping = inside.union(alone).distinct().select("at", F.concat(F.lit("a circular extends relation occurs at "), "at").alias("cause"))
    problems = found.join(missing.unionByName(looping), "at").select("path", "at", "cause")
    return found, problems


def effective(extends: DataFrame, settings: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, name, value, given_by): the settings of each file after inheritance, and problems. settings: path, name, value. A file with a loop above it has none."""
    chains, problems = chain(extends, files)
    circular = problems.where("startswith(cause, 'a circular')").select("path").distinct()
    every = chains.join(circular, "path", "left_anti").join(settings.withColumnRenamed("path", "at"), "at")
    best = every.groupBy("path", "name").agg(F.min_by(F.struct("value", "at"), "rank").alias("v"))
    return best.select("path", "name", "v.value", F.col("v.at").alias("given_by")), problems


def targets(files: DataFrame) -> DataFrame:
    """The leaves of the ``imports`` and ``exports`` of package files (package, content), in order (``TARGETS``). A table without keys that begin with a dot is the target of '.'."""

    def leaves(value, conditions: tuple, listed: bool) -> Iterator[tuple]:
        if isinstance(value, dict):
            for name, inner in value.items():
                yield from leaves(inner, (*conditions, name), listed)
        elif isinstance(value, list):
            for inner in value:
                yield from leaves(inner, conditions, True)
        elif value is None or isinstance(value, str):
            yield conditions, value, listed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for package, content in zip(*[batch.column(i).to_pylist() for i in range(2)]):
                try:
                    data = json.loads(content or b"")
                except (ValueError, RecursionError):
                    continue
                for section in ("imports", "exports"):
                    table = data.get(section) if isinstance(data, dict) else None
                    if section == "exports" and table is not None and not (isinstance(table, dict) and any(k.startswith(".") for k in table)):
                        table = {".": table}
                    for key, value in table.items() if isinstance(table, dict) else ():
                        out += [(package, section, key, i, list(c), t, listed) for i, (c, t, listed) in enumerate(leaves(value, (), False))]
            columns = list(zip(*out)) or [()] * 7
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in TARGETS.split(", ")])

    return files.select("package", "content").mapInArrow(run, TARGETS)


def matched_keys(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """(package, section, specifier, key, middle): the key that each specifier takes, and what its ``*`` stands for. keys: package, section, key."""
    asked = requests.select("package", "section", "specifier").distinct()
    exact = keys.where("not contains(key, '*') and not endswith(key, '/')").select("package", "section", F.col("key").alias("specifier"), "key")
    same = asked.join(exact, ["package", "section", "specifier"]).withColumn("middle", F.lit(""))
    patterns = keys.where("contains(key, '*')").select("package", "section", "key", F.substring_index("key", "*", 1).alias("before"), F.expr("substr(key, instr(key, '*') + 1)").alias("after"))
    open_ = asked.join(same.select("package", "section", "specifier"), ["package", "section", "specifier"], "left_anti")
    prefixes = open_.withColumn("n", F.explode(F.sequence(F.lit(0), F.length("specifier") - 1))).withColumn("before", F.expr("substr(specifier, 1, n)"))
    hits = prefixes.join(patterns, ["package", "section", "before"]).where("endswith(specifier, after) and length(specifier) > length(before) + length(after)")
    best = hits.groupBy("package", "section", "specifier").agg(F.max(F.struct(F.length("before").alias("n"), F.length("key").alias("m"), "key", "before", "after")).alias("b"))
    middle = F.expr("substr(specifier, b.n + 1, length(specifier) - b.n - length(b.after))")
    return same.unionByName(best.select("package", "section", "specifier", "b.key", middle.alias("middle")))


def resolve(requests: DataFrame, leaves: DataFrame) -> DataFrame:
    """(package, section, specifier, conditions, key, target) for requests (package, section, specifier, conditions): target is null if no key fits, no condition is active, or null blocks it.

    ``default`` is always active. leaves: ``TARGETS``.
    """
    chosen = matched_keys(requests, leaves.select("package", "section", "key").distinct())
    asked = requests.select("package", "section", "specifier", "conditions").distinct().join(chosen, ["package", "section", "specifier"], "left")
    active = F.array_append(F.col("conditions"), F.lit("default"))
    told = asked.join(leaves.withColumnRenamed("conditions", "needed"), ["package", "section", "key"], "left")
    fits = F.col("seq").isNotNull() & F.forall("needed", lambda c: F.array_contains(active, c)) & ~(F.col("listed") & F.col("target").isNull())
    whole = F.replace("target", F.lit("*"), F.col("middle"))
    first = told.groupBy("package", "section", "specifier", "conditions", "key").agg(F.min_by(F.when(fits, F.struct(whole.alias("t"))), F.when(fits, F.col("seq"))).alias("v"))
    return first.select("package", "section", "specifier", "conditions", "key", F.col("v.t").alias("target"))
