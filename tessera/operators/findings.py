"""Findings and states of a model against the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import claims as cl


def _matched(claims: DataFrame, modules: DataFrame, matched: DataFrame | None) -> DataFrame:
    return cl.matches(claims, modules).select("id", "module").distinct() if matched is None else matched


def mis_folds(components: DataFrame, claims: DataFrame, modules: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """(id, module): a module that shares no word with its component and no package with another module of it.

    Package sharing is an equality of packages, or one module being the
    other's package; both are found by counts and semi joins, not by pairs.
    matched: distinct (id, module) of the claims, if they are known.
    """
    held = _matched(claims, modules, matched).join(modules.select("module", F.coalesce(F.nullif("package", F.lit("")), F.col("module")).alias("package")), "module")
    many = held.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    held = held.join(many, "id", "left_semi")
    siblings = held.groupBy("id", "package").agg(F.count("*").alias("same"))
    own = components.select("id", F.array_distinct(F.concat(t.words(F.col("id")), t.words(F.col("does")))).alias("own"))
    odd = held.join(siblings, ["id", "package"]).where("same = 1").join(own, "id").where(~t.share_a_word(t.words(F.col("module")), F.col("own")))
    is_package = held.select("id", F.col("package").alias("module")).distinct()
    its_package = held.select("id", F.col("module").alias("package")).distinct()
    odd = odd.select("id", "module", "package").join(is_package.join(held.select("id", "module"), ["id", "module"], "left_semi"), ["id", "module"], "left_anti")
    return odd.join(its_package, ["id", "package"], "left_anti").select("id", "module")


def single_module(components: DataFrame, claims: DataFrame, modules: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """(id, module) of components, actors aside, with exactly one module."""
    held = _matched(claims, modules, matched).join(components.where("kind <> 'actor'").select("id"), "id", "left_semi")
    return held.groupBy("id").agg(F.count("*").alias("n"), F.min("module").alias("module")).where("n = 1").select("id", "module")


def flow_states(flows: DataFrame, components: DataFrame, joined: DataFrame, sharing: DataFrame, reviewed: DataFrame, mechanisms: list[str]) -> DataFrame:
    """(key, state) by the first that holds: external, observed, structural, declared.

    joined, sharing: unordered pairs (a, b) with an import or a shared module;
    reviewed: keys whose review resolves, is current and cites an endpoint.
    """
    actor = components.where("kind = 'actor'").select("id")
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    base = flows.select("key", "src", "dst", "relation", *pair)
    base = base.join(actor.select(F.col("id").alias("src"), F.lit(True).alias("x1")), "src", "left").join(actor.select(F.col("id").alias("dst"), F.lit(True).alias("x2")), "dst", "left")
    base = base.join(joined.unionByName(sharing).distinct().withColumn("link", F.lit(True)), ["a", "b"], "left").join(reviewed.select("key", F.lit(True).alias("seen")).distinct(), "key", "left")
    named = F.lit(False)
    for m in mechanisms:
        named = named | t.mentioned(F.lit(m), F.col("relation"))
    state = F.when(F.col("x1") | F.col("x2"), "external").when(F.col("seen"), "observed").when(F.col("link") | named, "structural").otherwise("declared")
    return base.select("key", state.alias("state"))


def entry_groups(points: DataFrame, owners: DataFrame, collapse: int = 4) -> DataFrame:
    """Ways in by kind and owner: groups of more than ``collapse`` rows with a known owner become one row."""
    joined = points.join(owners, "module", "left")
    big = joined.where("owner is not null").groupBy("kind", "owner").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    one = big.where(F.col("n") > collapse).select("kind", "owner", "n", F.lit("").alias("name"))
    small = joined.join(big.where(F.col("n") > collapse).select("kind", "owner"), ["kind", "owner"], "left_anti")
    return one.unionByName(small.select("kind", "owner", F.lit(1).cast("long").alias("n"), "name"))


def freshness(states: DataFrame, by: str) -> DataFrame:
    """Per group: stale if any is stale, else missing if any is missing, else current."""
    level = F.max(F.when(F.col("state") == "stale", 2).when(F.col("state") == "missing", 1).otherwise(0))
    return states.groupBy(by).agg(F.element_at(F.array(F.lit("current"), F.lit("missing"), F.lit("stale")), level + 1).alias("freshness"))


def level_counts(claims: DataFrame, levels: list[str]) -> DataFrame:
    """(level, n) for every level, also those without claims."""
    spark = claims.sparkSession
    domain = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"))
    return domain.join(claims.groupBy("level").agg(F.count("*").alias("c")), "level", "left").select("level", F.coalesce("c", F.lit(0)).alias("n"))


def flow_review(states: DataFrame) -> DataFrame:
    """(key, line) of flows that need a source review: structural evidence only, or source records that do not resolve. states: key, name, artifact, state, unresolved_refs."""
    needed = states.where("state = 'structural' or (coalesce(unresolved_refs, false) and state <> 'external')")
    text = F.concat(F.lit("flow review: "), "name", F.lit(" ("), "artifact", F.lit(") has structural evidence but no source review. Give source references for direction and artifact, or change the flow."))
    return needed.select("key", text.alias("line"))


def no_endpoint_source(flows: DataFrame, refs: DataFrame, held: DataFrame, components: DataFrame) -> DataFrame:
    """(key, line) of flows with source records of which none is in a module of an endpoint.

    flows: key, name, artifact, src, dst; refs: key, module; held: id, module
    (claims matched with modules); components: id, pos, claims (whether it
    specifies any module). An actor has no modules, so the other end counts.
    """
    cited = refs.select("key", "module").distinct()
    ends = flows.select("key", F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    good = ends.join(cited, "key").join(held.select("id", "module").distinct(), ["id", "module"], "left_semi").select("key").distinct()
    bad = flows.join(cited.select("key").distinct(), "key", "left_semi").join(good, "key", "left_anti")
    named = bad.select("key", F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).join(components.where("claims").select("id", "pos"), "id")
    listed = named.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda e: e["id"]), " or ").alias("ends"))
    where = F.coalesce("ends", F.lit(""))
    text = F.concat(F.lit("no endpoint source: "), "name", F.lit(" ("), "artifact", F.lit("): no source record is in a module of "), where, F.lit(". Add a source record in a module of "), where, F.lit(", or change the flow."))
    return bad.join(listed, "key", "left").select("key", text.alias("line"))


def lost_evidence(flows: DataFrame, base: DataFrame, head: DataFrame, at_base: str = "", model_file: str = "the model") -> DataFrame:
    """(key, kind, line) of flows whose evidence was better at the base. flows: key, name, artifact, of the model under review; base and head: key, state.

    A flow that a side does not know is not compared.
    """
    both = flows.join(base.select("key", F.col("state").alias("was")), "key").join(head.select("key", F.col("state").alias("now")), "key")
    head_text = F.concat(F.lit(": "), "name", F.lit(" ("), "artifact", F.lit(") "))
    kind = (
        F.when((F.col("was") == "observed") & (F.col("now") == "declared"), "evidence lost").when((F.col("was") == "observed") & (F.col("now") != "observed"), "source evidence lost")
        .when((F.col("was") == "structural") & (F.col("now") == "declared"), "structural evidence lost")
    )
    rest = (
        F.when(kind == "evidence lost", F.lit(f"had a current source review{at_base} and no import connects them now. Find the evidence, give the mechanism, or remove the flow in {model_file}"))
        .when(kind == "source evidence lost", F.concat(F.lit(f"was source reviewed{at_base} and is now "), "now", F.lit(". Examine its source references, direction, and artifact.")))
        .otherwise("had an import or declared mechanism at the base commit. That evidence is missing now. Examine the flow.")
    )
    return both.where(kind.isNotNull()).select("key", kind.alias("kind"), F.concat(kind, head_text, rest).alias("line"))


def sequence_measures(steps: DataFrame, journeys: DataFrame, points: DataFrame, covered: DataFrame, flows: DataFrame) -> DataFrame:
    """(measure, n) of the sequences of a map: how many there are, drafted ones, their steps, flows on no step, ways in and those that no sequence covers.

    steps: journey, flow; journeys: journey, drafted; points: identity; covered: identity; flows: key.
    """
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
    parts = [
        n(journeys, "sequences"), n(journeys.where("drafted"), "drafted sequences"), n(steps, "steps"), n(flows.select("key").distinct().join(steps.select(F.col("flow").alias("key")), "key", "left_anti"), "flows on no step"),
        n(points.select("identity").distinct(), "ways in"), n(points.select("identity").distinct().join(covered, "identity", "left_anti"), "ways in without a sequence"),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def map_findings(parts: dict[str, DataFrame], prefixes: DataFrame) -> DataFrame:
    """(map_id, kind, line) of all generators of a tree of maps, with the prefix of each map: (map_id, line) by kind, and prefixes (map_id, prefix)."""
    found = None
    for kind, lines in parts.items():
        own = lines.select("map_id", F.lit(kind).alias("kind"), "line")
        found = own if found is None else found.unionByName(own)
    return found.join(prefixes, "map_id", "left").select("map_id", "kind", F.concat(F.coalesce("prefix", F.lit("")), "line").alias("line"))
