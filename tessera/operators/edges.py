"""Import edges between components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crossing(uses: DataFrame, owners: DataFrame) -> DataFrame:
    """(p, q, module, target) of every import whose ends have different owners."""
    src = owners.select("module", F.col("owner").alias("p"))
    dst = owners.select(F.col("module").alias("target"), F.col("owner").alias("q"))
    return uses.select("module", "target").join(src, "module").join(dst, "target").where("p <> q").select("p", "q", "module", "target")


def without_flow(crossings: DataFrame, flows: DataFrame) -> DataFrame:
    """Crossings whose unordered pair no flow connects."""
    key = F.array_sort(F.array("p", "q"))
    joined = flows.select(F.array_sort(F.array("src", "dst")).alias("pair")).distinct()
    return crossings.withColumn("pair", key).join(joined, "pair", "left_anti").drop("pair")


def pair_counts(crossings: DataFrame) -> DataFrame:
    """Per ordered pair: distinct source modules, and imports."""
    return crossings.groupBy("p", "q").agg(F.countDistinct("module").alias("modules"), F.count("*").alias("imports"))


def unordered_pairs(crossings: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) with an import in either direction."""
    return crossings.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def importers(uses: DataFrame) -> DataFrame:
    """Reverse adjacency: (target, importers sorted and joined)."""
    return uses.groupBy(F.col("target").alias("module")).agg(F.array_join(F.array_sort(F.collect_set("module")), ",").alias("importers"))


def rule_outcomes(rules: DataFrame, uses: DataFrame, owned: DataFrame, modules: DataFrame) -> DataFrame:
    """Three-valued results of import rules (id, kind, src, dst): fail, unknown or pass.

    forbid_import: no module of src may import one of dst. allow_imports:
    modules of src may import src and dst only; an import of a module without
    owner is a gap. A gap is also a module of src whose facts may be incomplete
    (not parsed, or imports unresolved or not known). owned: (module, owner),
    possibly several rows a module.
    """
    edges = uses.where("module <> target").select("module", "target").distinct()
    inside = rules.join(owned, F.array_contains("src", F.col("owner"))).select("id", "kind", "src", "dst", "module").dropDuplicates(["id", "module"])
    reach = inside.join(edges, "module").join(owned.select(F.col("module").alias("target"), F.col("owner").alias("to")), "target", "left")
    per = reach.groupBy("id", "kind", "module", "target").agg(
        F.bool_or(F.array_contains("dst", F.col("to"))).alias("to_dst"), F.bool_or(F.array_contains("src", F.col("to"))).alias("to_src"), F.bool_or(F.col("to").isNull()).alias("unowned"))
    bad = F.when(F.col("kind") == "forbid_import", F.coalesce("to_dst", F.lit(False))).when(F.col("kind") == "allow_imports", ~F.col("unowned") & ~F.coalesce("to_dst", F.lit(False)) & ~F.coalesce("to_src", F.lit(False)))
    found = per.groupBy("id").agg(F.count_if(bad).alias("violations"), F.count_if((F.col("kind") == "allow_imports") & F.col("unowned")).alias("unowned"))
    incomplete = modules.where("not parsed or unresolved is null or size(unresolved) > 0").select("module")
    gaps = inside.join(incomplete, "module", "left_semi").groupBy("id").agg(F.count("*").alias("incomplete"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = rules.select("id", "kind").join(found, "id", "left").join(gaps, "id", "left")
    state = F.when(n("violations") > 0, "fail").when(n("unowned") + n("incomplete") > 0, "unknown").otherwise("pass")
    return joined.select("id", "kind", n("violations").alias("violations"), (n("unowned") + n("incomplete")).alias("gaps"), state.alias("result"))
