"""Moves: a one-to-one assignment of vanished modules to new ones."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from pyspark.sql import types as T

from .diff import jaccard

# The least similarity of names and surfaces, and the three answers.
NAME_ALIKE = 0.6
SURFACE_OVERLAP = 0.8
HOW = ("same content", "same public names", "the same file name and most of the same public names")
#: Modules with one key that are held against each other at once, on each side.
BLOCK = 512
_TOP, _NONE = 1 << 20, np.iinfo(np.int64).max


@F.pandas_udf(T.DoubleType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two names by matching blocks, 0 to 1 (edit distance would rank differently)."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def _file(path):
    return F.element_at(F.split(path, "/"), -1)


def _common(a, b, end: bool):
    """How many path parts agree from the start or the end."""
    x, y = F.split(a, "/"), F.split(b, "/")
    if end:
        x, y = F.reverse(x), F.reverse(y)
    same = F.zip_with(x, y, lambda p, q: p == q)
    stop = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    return F.when(stop == 0, F.size(same)).otherwise(stop - 1)


def _agree(a: list[list[str]], b: list[list[str]]) -> np.ndarray:
    """How many parts of each a agree with each b from the start."""
    out, k = np.zeros((len(a), len(b)), np.int64), 1
    while True:
        code: dict = {}
        x = np.array([code.setdefault(tuple(p[:k]), len(code)) if len(p) >= k else -1 for p in a])
        y = np.array([code.get(tuple(p[:k]), -2) if len(p) >= k else -2 for p in b])
        same = x[:, None] == y[None]
        if not same.any():
            return out
        out, k = out + same, k + 1


def _place(tail, ratio, head):
    """The order of pairs (tail, ratio, head, each the larger the better) as one number."""
    return ((_TOP - tail) * 1001 + 1000 - ratio) * _TOP + _TOP - head


def first_choices(olds: list[str], files: list[str], cands: list[str], others: list[str], held: list[int | None], holders: list[str | None], least: float) -> list[tuple[str, str, int]]:
    """(old, cand, place): for each old module the first candidate that no better pair holds.

    cands are in order. Two names have no more in common than their letters, so
    a pair's place by that bound is not after its own: only a pair that comes
    first by its bound is compared, until the first place is a compared one.
    """
    a, b = [f.split("/") for f in files], [f.split("/") for f in others]
    x, y = [p[-1] for p in a], [p[-1] for p in b]
    tail, head = _agree([p[::-1] for p in a], [p[::-1] for p in b]), _agree(a, b)
    length = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None]
    both = np.zeros(length.shape, np.int64)
    for c in set("".join(x)) & set("".join(y)):
        both += np.minimum(np.array([s.count(c) for s in x])[:, None], np.array([s.count(c) for s in y])[None])
    bound = np.where(length == 0, 1.0, 2.0 * both / np.maximum(length, 1))
    limit = np.array([_NONE if h is None else h for h in held], np.int64)
    places = _place(tail, np.floor(bound * 1000).astype(np.int64), head)
    places[(bound < least) | (places > limit[None])] = _NONE
    found = []
    for i, row in enumerate(places):
        told = set()
        while row[j := int(row.argmin())] != _NONE:
            if j in told:
                found.append((olds[i], cands[j], int(row[j])))
                break
            told.add(j)
            ratio = SequenceMatcher(None, x[i], y[j]).ratio()
            place = int(_place(int(tail[i, j]), int(ratio * 1000), int(head[i, j])))
            behind = holders[j] is not None and (place, olds[i]) >= (held[j], holders[j])
            row[j] = _NONE if ratio < least or behind else place
    return found


def _choices(olds: DataFrame, cands: DataFrame, least: float) -> DataFrame:
    """(old, cand, place): the first choice of each of olds (key, old, file) among cands (key, cand, file, held, holder) with its key.

    The modules of a key are dealt to blocks, and each pair of blocks is a row,
    so neither a key nor a side of it has to fit one task.
    """
    blocks = lambda df, name: df.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    shared = blocks(olds, "m").join(blocks(cands, "n"), "key")
    deal = lambda name, count: F.pmod(F.xxhash64(name), F.col(count)).cast("int")
    a = olds.join(shared, "key").groupBy("key", deal("old", "m").alias("i"), "n").agg(F.collect_list(F.struct("old", "file")).alias("a"))
    b = cands.join(shared, "key").groupBy("key", deal("cand", "n").alias("j"), "m").agg(F.array_sort(F.collect_list(F.struct("cand", "file", "held", "holder"))).alias("b"))
    a = a.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    b = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    pairs = a.hint("merge").join(b, ["key", "i", "j"]).repartition(4 * olds.sparkSession.sparkContext.defaultParallelism, "key", "i", "j")
    columns = ["a.old", "a.file", "b.cand", "b.file", "b.held", "b.holder"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row for n in range(batch.num_rows) for row in first_choices(*[batch.column(c)[n].as_py() for c in range(len(columns))], least)]
            parts = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, (pa.string(), pa.string(), pa.int64()))], names=["old", "cand", "place"])

    each = pairs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, "old string, cand string, place long")
    return each.groupBy("old").agg(F.min(F.struct("place", "cand")).alias("f")).select("old", "f.cand", "f.place")


def _by_key(olds: DataFrame, cands: DataFrame, least: float) -> DataFrame | None:
    """(old, cand): the greedy assignment of olds (key, old, file) to cands (key, cand, file), pairs with one key.

    All pairs are in one order for both ends, so the greedy assignment is the
    one that comes about if each module takes its first choice, a candidate
    keeps the first pair that asks for it, and who is left asks again among
    those that it has a better claim to. No table of pairs is made.
    """
    olds, cands = olds.select("key", "old", "file"), cands.select("key", "cand", "file")
    holds, asking = None, olds
    while True:
        held = cands.withColumn("held", F.lit(None).cast("long")).withColumn("holder", F.lit(None).cast("string")) if holds is None else cands.join(holds.select("cand", F.col("place").alias("held"), F.col("old").alias("holder")), "cand", "left")
        asked = cut(_choices(asking, held.select("key", "cand", "file", "held", "holder"), least))
        if asked.isEmpty():
            return holds
        every = asked if holds is None else holds.unionByName(asked)
        holds = cut(every.groupBy("cand").agg(F.min(F.struct("place", "old")).alias("f")).select("f.old", "cand", "f.place"))
        asking = cut(olds.join(every.select("old"), "old", "left_semi").join(holds.select("old"), "old", "left_anti").select("key", "old", "file"))


def _sides(gone: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = gone.select(F.col("module").alias("old"), F.col("sha").alias("s"), F.array_sort("names").alias("n"), F.col("file").alias("fa"))
    return a, new.select(F.col("module").alias("cand"), F.col("sha").alias("s2"), F.array_sort("names").alias("n2"), F.col("file").alias("fb"))


def _overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with unequal lists of names that overlap by SURFACE_OVERLAP.

    Unequal sets of names overlap so much only if they share four names and
    hold five at least in all, so the second join takes names of larger
    surfaces only, and of those the first ones in order that a pair can't do
    without.
    """
    cols = ["old", "cand", "n", "n2", "fa", "fb"]
    xa, xb = a.withColumn("d", F.array_distinct("n")), b.withColumn("d2", F.array_distinct("n2"))
    same = xa.where("size(n) > 0").join(xb, F.col("d") == F.col("d2")).where("n <> n2").select(*cols)
    # The names of a set before the last that an overlap of this size may miss.
    needed = lambda c: F.slice(c, 1, (F.size(c) - F.ceil(F.size(c) * F.lit(SURFACE_OVERLAP) - 1e-9) + 1).cast("int"))
    wa, wb = xa.where("size(d) >= 4").select("*", F.explode(needed("d")).alias("w")), xb.where("size(d2) >= 4").select("*", F.explode(needed("d2")).alias("w"))
    most = wa.join(wb, "w").where("d <> d2").select(*cols).distinct().where(jaccard(F.col("n"), F.col("n2")) >= SURFACE_OVERLAP)
    return same.unionByName(most).select(*cols, F.lit(2).alias("rank"))


def _scored(pairs: DataFrame) -> DataFrame:
    scored = pairs.withColumn("alike", alike(_file(F.col("fa")), _file(F.col("fb"))))
    scored = scored.where((F.col("rank") == 0) | (F.col("alike") >= NAME_ALIKE))
    return scored.select("old", "cand", "rank", _common(F.col("fa"), F.col("fb"), True).alias("tail"), F.floor(F.col("alike") * 1000).alias("ratio"), _common(F.col("fa"), F.col("fb"), False).alias("head"))


def candidates(gone: DataFrame, new: DataFrame, ranks: int = len(HOW)) -> DataFrame:
    """Pairs that one of the first ``ranks`` questions admits, with rank 0, 1 or 2 of the strongest and the scores.

    Each question is an equality on content, on names, or on a shared name
    plus bounds, so pairs come from equi-joins. Their number is quadratic in
    the modules with one content or one list of names; ``find`` lists those of
    the last question only.
    """
    a, b = _sides(gone, new)
    cols = ["old", "cand", "n", "n2", "fa", "fb"]
    found = a.join(b, a.s == b.s2).where((F.size("n") > 0) | (_file(F.col("fa")) == _file(F.col("fb")))).select(*cols, F.lit(0).alias("rank"))
    if ranks > 1:
        found = found.unionByName(a.where("size(n) > 0").join(b, a.n == b.n2).select(*cols, F.lit(1).alias("rank")))
    if ranks > 2:
        found = found.unionByName(_overlapping(a, b))
    return _scored(found)


def _of_pairs(pairs: DataFrame) -> DataFrame | None:
    """(old, cand): the greedy assignment of scored pairs: round after round, every pair that is the best of both its ends, a join of two minima."""
    order = F.struct((-F.col("tail")).alias("t"), (-F.col("ratio")).alias("r"), (-F.col("head")).alias("h"), "old", "cand")
    left = cut(pairs.select("old", "cand", order.alias("o")).groupBy("old", "cand").agg(F.min("o").alias("o")))
    found = None
    while True:  # each round takes a pair at least
        best_old = left.groupBy("old").agg(F.min("o").alias("o"))
        best_new = left.groupBy("cand").agg(F.min("o").alias("o"))
        taken = cut(best_old.join(best_new, "o").select("old", "cand"))
        if taken.isEmpty():
            return found
        found = taken if found is None else found.unionByName(taken)
        left = cut(left.join(taken.select("old"), "old", "left_anti").join(taken.select("cand"), "cand", "left_anti"))


def find(gone: DataFrame, new: DataFrame, ranks: int = len(HOW)) -> DataFrame:
    """(old, new, how): the greedy assignment in order of rank, tail, ratio, head and names.

    The questions are asked in turn, each of the modules that those before it
    leave. That is the greedy assignment in one order, as the order begins with
    the rank; so the moves of the first ``ranks`` questions don't depend on the
    others.
    """
    a, b = map(cut, _sides(gone, new))
    found = []
    for rank in range(ranks):
        old, cand = a.select("n", "s", "old", F.col("fa").alias("file")), b.select("n2", "s2", "cand", F.col("fb").alias("file"))
        named = F.coalesce(F.size("n") > 0, F.lit(False))
        if rank == 0:  # a module without names moves with its file name only
            bare, full = lambda s: F.array(s), lambda s: F.array(s, _file(F.col("file")))
            keys = F.explode(F.array(bare("s2"), full("s2")))
            taken = _by_key(old.where("s is not null").withColumn("key", F.when(named, bare("s")).otherwise(full("s"))), cand.where("s2 is not null").withColumn("key", keys), 0.0)
        elif rank == 1:
            taken = _by_key(old.where(named).withColumnRenamed("n", "key"), cand.withColumnRenamed("n2", "key"), NAME_ALIKE)
        else:
            taken = _of_pairs(_scored(_overlapping(a, b)))
        if taken is not None:
            found.append(taken.select("old", F.col("cand").alias("new"), F.lit(HOW[rank]).alias("how")))
            if rank + 1 < ranks:
                a, b = cut(a.join(taken.select("old"), "old", "left_anti")), cut(b.join(taken.select("cand"), "cand", "left_anti"))
    if not found:
        return a.select("old", F.col("old").alias("new"), F.lit(HOW[0]).alias("how")).limit(0)
    return reduce(DataFrame.unionByName, found)
