"""Comparison of snapshots and of keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drift(base: DataFrame, head: DataFrame, key: str, content: str, derived: list[str]) -> DataFrame:
    """(key, change) with added, gone, changed (content differs) or derived (only derived columns differ)."""
    a, b = base.select(key, F.struct(content, *derived).alias("a")), head.select(key, F.struct(content, *derived).alias("b"))
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    other = F.lit(False)
    for c in derived:
        other = other | ~same(c)
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "gone").when(~same(content), "changed").when(other, "derived")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def keyed(base: DataFrame, head: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Rows that differ: added, removed or changed, with the names of the changed fields."""
    a = base.select(*key, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("in_a"))
    b = head.select(*key, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("in_b"))
    names = F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f) for f in fields]))
    how = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.size(names) > 0, "changed")
    joined = a.join(b, key, "full_outer")
    return joined.select(*key, how.alias("how"), F.when(how == "changed", F.array_join(names, ",")).otherwise("").alias("fields")).where("how is not null")


def surface(base: DataFrame, head: DataFrame, key: str, items: str) -> DataFrame:
    """Per key in both: items added and removed, sorted and joined; unchanged keys are left out."""
    a, b = base.select(key, F.col(items).alias("a")), head.select(key, F.col(items).alias("b"))
    text = lambda x, y: F.array_join(F.array_sort(F.array_distinct(F.array_except(x, y))), ",")
    return a.join(b, key).select(key, text("b", "a").alias("added"), text("a", "b").alias("removed")).where("added <> '' or removed <> ''")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one side only, with ``side``."""
    return a.subtract(b).withColumn("side", F.lit("a")).unionByName(b.subtract(a).withColumn("side", F.lit("b")))


def jaccard(a, b):
    """Column: the share of common members; 0 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def changed_components(base: DataFrame, head: DataFrame, owners: DataFrame) -> DataFrame:
    """Components that own an added, removed or edited module: counts, most first."""
    moved = drift(base, head, "module", "sha", [])
    return moved.join(owners, "module").groupBy("owner").agg(F.count("*").alias("touched")).orderBy(F.desc("touched"), "owner")
