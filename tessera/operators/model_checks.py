"""Checks of a model: each is a table of lines (map_id, check, line); all maps at once.

Uniqueness is a count, a reference an anti-join. Tables carry ``map_id``; ``pos``
is the order in the model, so of two equal ids the later one is reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The form of an id, kinds of import rules, and layers that every model has.
ID_FORM = r"^[A-Za-z0-9_][A-Za-z0-9_.-]*$"
RULE_KINDS = ("forbid_import", "allow_imports")


def _lines(df: DataFrame, check: str, *parts) -> DataFrame:
    return df.select("map_id", F.lit(check).alias("check"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("line"))


def _later(df: DataFrame, *key: str) -> DataFrame:
    """The rows of a key after its first."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("map_id", *key).orderBy("pos"))).where("_n > 1").drop("_n")


def flow_problems(flows: DataFrame) -> DataFrame:
    """Flows with ids of a wrong form or used twice, with one component at both ends, or not told apart on their pair. flows: map_id, pos, id ('' if none), src, dst, artifact."""
    ends = (F.col("src"), " -> ", F.col("dst"))
    named = flows.where("id <> ''")
    form = _lines(named.where(~F.regexp_like("id", F.lit(ID_FORM))), "flow id", "flow ", *ends, " has the id '", F.col("id"), "'. An id contains only letters, digits, '_', '.', and '-'. It starts with a letter, a digit, or '_'")
    twice = _lines(_later(named, "id"), "flow id", "flow id ", F.col("id"), " identifies two flows. Give each flow its own id")
    loops = _lines(flows.where("src = dst"), "flow ends", "flow ", *ends, " has the same component at the two ends. A flow must connect two different components")
    artifacts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "artifact"))), lambda a: F.concat(F.lit("'"), a["artifact"], F.lit("'"))), " and ")
    pairs = flows.groupBy("map_id", "src", "dst").agg(F.count("*").alias("n"), F.bool_and(F.col("id") != "").alias("named"), artifacts.alias("a")).where("n > 1 and not named")
    times = F.when(F.col("n") == 2, "twice").otherwise(F.concat(F.col("n").cast("string"), F.lit(" times")))
    several = _lines(pairs, "flow pair", "flow ", *ends, " appears ", times, " (", F.col("a"), "). Give each flow on this pair its own id. For an artifact that goes back, add a flow in the opposite direction")
    return form.unionByName(twice).unionByName(loops).unionByName(several)


def key_problems(keys: DataFrame, flows: DataFrame) -> DataFrame:
    """Overrides by a key that no flow has, or by key and pair of one flow. keys: map_id, label, key, src, dst (key '' for a pair); flows: map_id, key, src, dst, name."""
    by_key = keys.where("key <> ''").join(flows.select("map_id", "key").distinct(), ["map_id", "key"], "left_anti")
    on_pair = flows.groupBy("map_id", "src", "dst").agg(F.count("*").alias("n"))
    pairs = keys.where("key = ''").drop("key").join(on_pair, ["map_id", "src", "dst"], "left")
    unknown = _lines(by_key, "override key", F.col("label"), " has an unknown flow: ", F.col("key")).unionByName(_lines(pairs.where("n is null"), "override key", F.col("label"), " has an unknown flow: ", F.col("src"), " -> ", F.col("dst")))
    both = flows.join(keys.where("key <> ''").select("map_id", "label", "key").distinct(), ["map_id", "key"]).join(keys.where("key = ''").select("map_id", "label", "src", "dst").distinct(), ["map_id", "label", "src", "dst"])
    return unknown.unionByName(_lines(both, "override key", F.col("label"), " gives flow ", F.col("name"), " two keys: ", F.col("key"), " and the pair. Remove one key"))


def rule_problems(rules: DataFrame, components: DataFrame, invariants: DataFrame) -> DataFrame:
    """Import rules with an empty id or one of another rule, an unknown kind, unknown components or an unknown invariant. rules: map_id, pos, id, kind, src, dst (arrays), invariant; components: map_id, id; invariants: map_id, n."""
    empty = _lines(rules.where(F.trim("id") == ""), "import rule", "a rule of kind ", F.col("kind"), " has an empty id")
    twice = _lines(_later(rules.where(F.trim("id") != ""), "id"), "import rule", F.col("id"), " is the id of two rules. Give each rule its own id")
    kind = _lines(rules.where(~F.col("kind").isin(*RULE_KINDS)), "import rule", F.col("id"), " has unknown kind ", F.col("kind"), f". Use {', '.join(RULE_KINDS)}")
    sides = rules.where(F.col("kind").isin(*RULE_KINDS)).select("map_id", "id", F.explode(F.array_distinct(F.concat("src", "dst"))).alias("component"))
    strange = sides.join(components.select("map_id", F.col("id").alias("component")), ["map_id", "component"], "left_anti")
    refs = _lines(strange, "import rule", F.col("id"), " has unknown component ", F.col("component"))
    lost = rules.where("invariant is not null").join(invariants.select("map_id", F.col("n").alias("invariant")), ["map_id", "invariant"], "left_anti")
    return empty.unionByName(twice).unionByName(kind).unionByName(refs).unionByName(_lines(lost, "import rule", F.col("id"), " has unknown invariant ", F.col("invariant").cast("string")))


def boundary_problems(boundaries: DataFrame) -> DataFrame:
    """Ids of more than one region or container. boundaries: map_id, pos, kind (region or container), id."""
    twice = _later(boundaries, "kind", "id").select("map_id", "kind", "id").distinct()
    both = boundaries.groupBy("map_id", "id").agg(F.countDistinct("kind").alias("k")).where("k > 1")
    return _lines(twice, "boundary", F.col("kind"), " ", F.col("id"), " identifies two boundaries").unionByName(_lines(both, "boundary", "region ", F.col("id"), " has the id of a container. Give each region and container a different id"))


def sequence_problems(journeys: DataFrame, steps: DataFrame, components: DataFrame, flows: DataFrame) -> DataFrame:
    """Sequences with the id of one before, without steps, and steps with unknown components, without words, or without one flow.

    journeys: map_id, pos, id; steps: map_id, journey, step (from 1), acts, measures
    (arrays), say, flow ('' if none), src, dst (of an edge, null if none); flows: map_id, key, src, dst.
    """
    twice = _lines(_later(journeys, "id"), "sequence id", "journey ", F.col("id"), " is the id of two sequences. Give each sequence its own id")
    bare = journeys.select("map_id", F.col("id").alias("journey")).distinct().join(steps.select("map_id", "journey").distinct(), ["map_id", "journey"], "left_anti")
    bare = _lines(bare, "sequence", "journey ", F.col("journey"), " has no steps. Add the examined sequence or remove it")
    where = ("journey ", F.col("journey"), " step ", F.col("step").cast("string"), " ")
    known = components.select("map_id", F.col("id").alias("member"))
    roles = [steps.select("map_id", "journey", "step", F.lit(role).alias("role"), F.explode(role).alias("member")) for role in ("acts", "measures")]
    strange = _lines(roles[0].unionByName(roles[1]).join(known, ["map_id", "member"], "left_anti"), "sequence", *where, F.col("role"), " has unknown component ", F.col("member"))
    by_key = flows.select("map_id", F.col("key").alias("flow"), F.lit(True).alias("found"))
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    on_pair = flows.select("map_id", *pair).groupBy("map_id", "a", "b").agg(F.count("*").alias("n"))
    told = steps.select("*", *pair).join(by_key, ["map_id", "flow"], "left").join(on_pair, ["map_id", "a", "b"], "left")
    problem = (
        F.when((F.col("flow") != "") & F.col("found").isNull(), F.concat(F.lit("has unknown flow "), "flow")).when((F.col("flow") == "") & F.col("src").isNotNull() & F.col("n").isNull(), F.concat(F.lit("has no flow on "), "src", F.lit(" -> "), "dst"))
        .when((F.col("flow") == "") & (F.col("n") > 1), F.concat(F.lit("has several flows on "), "src", F.lit(" -> "), "dst")).when(F.trim(F.coalesce("say", F.lit(""))) == "", "has no say")
    )
    return twice.unionByName(bare).unionByName(strange).unionByName(_lines(told.withColumn("problem", problem).where("problem is not null"), "sequence", *where, F.col("problem")))


def meaning_problems(flows: DataFrame, components: DataFrame, plain: DataFrame, layers: DataFrame) -> DataFrame:
    """Flows without a sentence or with an unknown layer, components without a plain word, and words of none. flows: map_id, name, relation, layer (null: none for its kind), kind; components: map_id, id; plain: map_id, id; layers: map_id, id."""
    silent = _lines(flows.where(F.trim(F.coalesce("relation", F.lit(""))) == ""), "meaning", "flow ", F.col("name"), " has no sentence in relations")
    none = _lines(flows.where("layer is null"), "meaning", "flow ", F.col("name"), " has kind ", F.col("kind"), " with no layer")
    odd = flows.where("layer is not null").join(layers.select("map_id", F.col("id").alias("layer")), ["map_id", "layer"], "left_anti")
    odd = _lines(odd, "meaning", "flow ", F.col("name"), " has unknown layer ", F.col("layer"))
    wordless = _lines(components.select("map_id", "id").join(plain.select("map_id", "id"), ["map_id", "id"], "left_anti"), "meaning", F.col("id"), " has no plain word")
    stray = _lines(plain.select("map_id", "id").distinct().join(components.select("map_id", "id"), ["map_id", "id"], "left_anti"), "meaning", "plain has an unknown component: ", F.col("id"))
    return silent.unionByName(none).unionByName(odd).unionByName(wordless).unionByName(stray)
