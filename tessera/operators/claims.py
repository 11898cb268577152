"""Ownership: which component claims which module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ancestors(dotted):
    """Column: the dotted name and all its prefixes at dots, shortest first."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def matches(claims: DataFrame, modules: DataFrame) -> DataFrame:
    """Claims that cover modules: distinct (id, pos, pattern, module).

    ``head.*`` covers module ``head`` and every module whose package is
    ``head`` or lies below it; without a package the module's own name counts.
    Symbol claims cover nothing. The prefix predicate would be a nested loop, so
    each module is exploded into its package's prefixes and joined by equality;
    rows grow with the depth of packages only.
    """
    own = modules.select("module", F.coalesce(F.nullif("package", F.lit("")), F.col("module")).alias("package"))
    keyed = own.select("module", F.explode(F.array_distinct(F.concat(F.array("module"), ancestors(F.col("package"))))).alias("head"))
    wild = claims.where(F.col("pattern").endswith(".*")).select("id", "pos", "pattern", F.regexp_replace("pattern", r"\.\*$", "").alias("head"))
    exact = claims.where(~F.col("pattern").endswith(".*") & ~F.col("pattern").contains(":"))
    found = wild.join(keyed, "head").select("id", "pos", "pattern", "module")
    return found.unionByName(exact.join(own.select("module", F.col("module").alias("pattern")), "pattern").select("id", "pos", "pattern", "module")).distinct()


def owners(claims: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, owner): the first component in model order that claims the module."""
    return matches(claims, modules).groupBy("module").agg(F.min(F.struct("pos", "id")).alias("o")).select("module", F.col("o.id").alias("owner"))


def symbol_claims(claims: DataFrame) -> DataFrame:
    """(id, module, symbol) of the patterns ``module:symbol``."""
    return claims.where(F.col("pattern").contains(":")).select("id", F.substring_index("pattern", ":", 1).alias("module"), F.element_at(F.split("pattern", ":"), -1).alias("symbol"))


def coverage(claims: DataFrame, modules: DataFrame, ignored: DataFrame) -> DataFrame:
    """Every module's owners and state: claimed twice, mapped, or unmapped. An ignore or an empty marker excuses no claims, never two."""
    held = matches(claims, modules).groupBy("module").agg(F.array_sort(F.collect_set("id")).alias("owners"))
    joined = modules.select("module", "empty_marker").join(held, "module", "left").join(ignored.select("module", F.lit(True).alias("skip")).distinct(), "module", "left")
    n = F.when(F.col("owners").isNull(), 0).otherwise(F.size("owners"))
    state = F.when(n > 1, "claimed twice").when((n == 1) | F.col("empty_marker") | F.col("skip"), "mapped").otherwise("unmapped")
    return joined.select("module", F.coalesce(F.array_join("owners", ","), F.lit("")).alias("owners"), state.alias("state"))


def unresolved(claims: DataFrame, modules: DataFrame) -> DataFrame:
    """Claims that cover no module; a symbol claim needs its module."""
    plain = claims.where(~F.col("pattern").contains(":")).join(matches(claims, modules), ["id", "pos", "pattern"], "left_anti")
    symbols = claims.where(F.col("pattern").contains(":")).withColumn("module", F.substring_index("pattern", ":", 1)).join(modules.select("module"), "module", "left_anti")
    return plain.select("id", "pattern").unionByName(symbols.select("id", "pattern"))


def nearest_owner(members: DataFrame, ancestors_of: DataFrame) -> DataFrame:
    """The owner of the closest level: rows (module, map_id, owner), map levels (map_id, level)."""
    joined = members.join(ancestors_of, "map_id")
    return joined.groupBy("module").agg(F.max(F.struct("level", "owner")).alias("o")).select("module", F.col("o.owner").alias("owner"), F.col("o.level").alias("level"))


def sdk_of(imports: DataFrame, sdks: list[str], separators: tuple[str, ...] = (".", "/")) -> DataFrame:
    """(name, sdk): the first listed prefix that the import equals or continues after a separator. The list is a short constant."""
    name = F.col("name")
    chosen = F.lit("")
    for sdk in reversed(sdks):
        hit = name == sdk
        for s in separators:
            hit = hit | name.startswith(sdk + s)
        chosen = F.when(hit, sdk).otherwise(chosen)
    return imports.select("name", chosen.alias("sdk"))
