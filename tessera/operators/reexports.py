"""Re-exports with ``*``: which names a module gives, and where each is defined.

Two relations, each a semi-naive fixpoint that joins only the rows of the last
round. The first holds the names that a ``*`` of a module gives. The second
holds, for a name of a module, the least and the greatest definition that its
bindings lead to: a name with two different ones is ambiguous, so two values
are enough however many paths there are, and a diamond costs its edges and not
its paths.

Chains take rounds by their logarithm: modules that hold nothing but one
``*`` are contracted first, and names with one binding are followed by pointer
jumping. Rounds remain for names that pass through modules with names of their
own, one for each level of such modules.

Rules: a module whose ``*`` records are marked ``rebinds`` takes the last
binding of a name in source order; any other takes its first named binding,
which hides ``*`` names, and else all ``*`` bindings. A name does not come back
to a module through a chain that passes the module itself. A name without a
binding in an extracted module is a submodule of that name or unknown. A loop
of named re-exports is unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from .graph import cyclic_core, follow, strongly_connected

RECORDS = "module string, pos int, name string, kind string, source string, symbol string, star boolean, rebinds boolean, exported boolean, only array<string>"
WHOLE = "*"
_NODE = "struct<module:string,name:string>"


def _unknown():
    return F.struct(F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("defined_in"), F.lit(None).cast("string").alias("defined_as"))


def _definition(kind, module, symbol):
    return F.struct(kind.alias("kind"), module.alias("defined_in"), symbol.alias("defined_as"))


def spread(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Least fixpoint: facts (module, name) and all that edges (module takes from source, only) carry on."""
    new = cut(facts.distinct())
    seen = new
    while True:
        carried = new.withColumnRenamed("module", "source").join(edges, "source").where("only is null or array_contains(only, name)")
        new = cut(carried.select("module", "name").distinct().join(seen, ["module", "name"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)


def _pass_through(records: DataFrame, read: DataFrame) -> DataFrame:
    """(module, target): modules with one record, an unlimited ``*``; the first module after them that is no such; null in a loop of them."""
    single = records.groupBy("module").agg(F.count("*").alias("n"), F.min("source").alias("source"), F.min(F.col("star") & F.coalesce("exported", F.lit(False)) & F.col("only").isNull()).alias("plain"))
    links = single.where("n = 1 and plain and source <> module").join(read, "module").select(F.col("module").alias("node"), F.col("source").alias("next"))
    return follow(links).select(F.col("node").alias("module"), F.col("end").alias("target"))


def given_names(records: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``*`` records bring: (module, pos, source, name), and (module, source) whose names aren't all known.

    records: ``RECORDS``; modules: module, package, parsed (false if it could not be read).
    """
    read = modules.where("parsed").select("module")
    through = cut(_pass_through(records, read))
    stars = records.where("star").join(through.withColumnRenamed("module", "source"), "source", "left")
    looped = through.where("target is null").select(F.col("module").alias("source"), F.lit(True).alias("looped"))
    stars = cut(stars.join(looped, "source", "left").where("looped is null").select("module", "pos", "source", F.coalesce("target", "source").alias("target"), "exported", "only").where("target <> module"))
    carrying = stars.where("exported").join(read, "module").join(through.select("module"), "module", "left_anti")
    edges = cut(carrying.select("module", F.col("target").alias("source"), "only"))
    own = records.where("not star and exported").join(read, "module").select("module", "name")
    names = spread(own, edges)
    bring = stars.join(names.select(F.col("module").alias("target"), "name"), "target").select("module", "pos", "source", "target", "name")
    core = cut(cyclic_core(edges.select(F.col("module").alias("src"), F.col("source").alias("dst")).distinct()))
    if not core.isEmpty():
        bring = _without_returns(bring, names, own, edges, cut(strongly_connected(core)))
    doubtful = records.where("exported is null").select("module").unionByName(modules.where("not parsed").select("module")).distinct().withColumn("name", F.lit(""))
    unsure = spread(doubtful, edges.withColumn("only", F.lit(None).cast("array<string>"))).select(F.col("module").alias("target"))
    return bring.select("module", "pos", "source", "name"), stars.join(unsure, "target").select("module", "source").distinct()


def _without_returns(bring: DataFrame, names: DataFrame, own: DataFrame, edges: DataFrame, loops: DataFrame) -> DataFrame:
    """bring without names that reach a module of a loop only by way of itself.

    For each module of a loop, the names of the others are spread again inside
    the loop, without that module.
    """
    member = loops.select(F.col("node").alias("module"), F.col("component").alias("loop"))
    taking = edges.join(member, "module").join(member.select(F.col("module").alias("source"), F.col("loop").alias("from_loop")), "source", "left")
    outside = taking.where("from_loop is null or from_loop <> loop").select("module", "source", "only")
    base = own.join(member.select("module"), "module").unionByName(
        outside.join(names.withColumnRenamed("module", "source"), "source").where("only is null or array_contains(only, name)").select("module", "name")
    ).distinct()
    start = member.select(F.col("module").alias("start"), "loop")
    facts = base.join(member, "module").join(start, "loop").where("module <> start").select(F.struct("start", "module").alias("module"), "name")
    inside = taking.where("from_loop = loop").join(start, "loop").where("module <> start and source <> start")
    spread_again = spread(facts, inside.select(F.struct("start", "module").alias("module"), F.struct("start", F.col("source").alias("module")).alias("source"), "only"))
    direct = spread_again.select(F.col("module.start").alias("module"), F.col("module.module").alias("target"), "name")
    same = member.join(member.select(F.col("module").alias("target"), F.col("loop").alias("l2")), F.col("loop") == F.col("l2")).select("module", "target")
    apart = bring.join(same, ["module", "target"], "left_anti")
    return apart.unionByName(bring.join(same, ["module", "target"]).join(direct, ["module", "target", "name"], "left_semi"))


def bindings(records: DataFrame, bring: DataFrame) -> DataFrame:
    """The bindings that decide each name: module, name, pos, star, kind, source, symbol."""
    named = records.where("not star").where("source is null or (source <> module and source <> concat(module, '.', name))")
    named = named.select("module", "name", "pos", F.lit(False).alias("star"), "kind", "source", F.coalesce("symbol", "name").alias("symbol"))
    both = named.unionByName(bring.select("module", "name", "pos", F.lit(True).alias("star"), F.lit("reexport").alias("kind"), "source", F.col("name").alias("symbol")))
    late = records.where("star and rebinds").select("module").distinct().withColumn("late", F.lit(True))
    of_name = Window.partitionBy("module", "name")
    ranked = both.join(late, "module", "left").withColumn("late", F.coalesce("late", F.lit(False)))
    ranked = ranked.withColumn("first_named", F.min(F.when(~F.col("star"), F.col("pos"))).over(of_name)).withColumn("last", F.max("pos").over(of_name))
    chosen = F.when(F.col("late"), F.col("pos") == F.col("last")).when(F.col("first_named").isNotNull(), F.col("pos") == F.col("first_named")).otherwise(True)
    return ranked.where(chosen).select("module", "name", "pos", "star", "kind", "source", "symbol")


def _steps(chosen: DataFrame, modules: DataFrame) -> DataFrame:
    """Each binding as a step from its node: to another node (next), or to a definition (found)."""
    known = chosen.select(F.struct("module", "name").alias("next")).distinct().withColumn("bound", F.lit(True))
    node = F.struct("module", "name").alias("node")
    onward = chosen.where("source is not null and kind = 'reexport'").select(node, "pos", F.struct(F.col("source").alias("module"), F.col("symbol").alias("name")).alias("next"))
    children = modules.select(F.struct(F.col("package").alias("module"), F.expr("substr(module, length(package) + 2)").alias("name")).alias("next"), F.col("module").alias("child")).where("startswith(child, concat(next.module, '.'))")
    onward = onward.join(known, "next", "left").join(children, "next", "left")
    found = F.when(F.col("bound"), F.lit(None)).when(F.col("child").isNotNull(), _definition(F.lit("module"), F.col("child"), F.lit(WHOLE))).otherwise(_unknown())
    here = chosen.where("source is null or kind <> 'reexport'")
    own = F.when(F.col("source").isNull(), _definition(F.col("kind"), F.col("module"), F.col("symbol"))).when(F.col("kind") == "unknown", _unknown()).otherwise(_definition(F.col("kind"), F.col("source"), F.lit(WHOLE)))
    return onward.select("node", "pos", F.when(F.col("bound"), F.col("next")).alias("next"), found.alias("found")).unionByName(here.select(node, "pos", F.lit(None).cast(_NODE).alias("next"), own.alias("found")))


def resolve(records: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(module, name, kind, reexport_of, defined_in, defined_as, ambiguous), and problems (module, reason).

    ``reexport_of`` is the source of the first binding; ``defined_as`` is ``*``
    for a whole module; both definition columns are null if it isn't known.
    """
    bring, unsure = given_names(records, modules)
    chosen = cut(bindings(records, bring))
    steps = cut(_steps(chosen, modules))
    fan = steps.groupBy("node").agg(F.count("*").alias("n"))
    steps = steps.join(fan, "node")
    ends = cut(follow(steps.where("n = 1 and next is not null").select("node", "next")))
    jump = ends.select(F.col("node").alias("next"), F.col("end").alias("far"), F.lit(True).alias("moved"))
    branches = steps.where("n > 1").join(jump, "next", "left").select("node", F.when(F.col("moved"), F.col("far")).otherwise(F.col("next")).alias("next"), "found")
    state = cut(_least_and_greatest(cut(branches), steps.where("n = 1 and found is not null").select("node", "found")))
    one = ends.select("node", "end").join(state.select(F.col("node").alias("end"), "lo", "hi"), "end", "left").select("node", "lo", "hi")
    whole = chosen.groupBy("module", "name").agg(F.min_by("source", "pos").alias("reexport_of"), F.sum(F.col("star").cast("int")).alias("stars"))
    values = state.join(ends.select("node"), "node", "left_anti").unionByName(one).select(F.col("node.module").alias("module"), F.col("node.name").alias("name"), "lo", "hi")
    told = whole.join(values, ["module", "name"], "left")
    clear = F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
    value = F.when(clear, F.col("lo")).otherwise(_unknown())
    apart = F.col("lo").isNotNull() & ~F.col("lo").eqNullSafe(F.col("hi"))
    named = told.select("module", "name", value.alias("v"), "reexport_of", (((F.col("stars") > 1) & (apart | F.col("lo.defined_in").isNull()))).alias("ambiguous"))
    names = named.select("module", "name", "v.kind", F.when(F.col("v.kind") == "module", F.coalesce("v.defined_in", "reexport_of")).otherwise(F.col("reexport_of")).alias("reexport_of"), "v.defined_in", "v.defined_as", "ambiguous")
    ambiguous = names.where("ambiguous").select("module", F.concat(F.lit("ambiguous star export "), "name").alias("reason"))
    not_known = unsure.select("module", F.concat(F.lit("the `*` re-export from "), "source", F.lit(" gives names that are not known")).alias("reason"))
    return names, ambiguous.unionByName(not_known)


def _least_and_greatest(branches: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, lo, hi): the least and greatest definition that each node leads to. branches: node, next, found; ends: node, found."""
    fixed = ends.select("node", F.col("found").alias("lo"), F.col("found").alias("hi"))
    first = branches.where("found is not null").groupBy("node").agg(F.min("found").alias("lo"), F.max("found").alias("hi"))
    links = branches.where("next is not null").select("node", "next").distinct()
    state = cut(fixed.unionByName(first))
    new = state
    while True:
        sent = new.select(F.col("node").alias("next"), "lo", "hi").join(links, "next").groupBy("node").agg(F.min("lo").alias("l"), F.max("hi").alias("h"))
        merged = sent.join(state, "node", "left").select("node", F.least("l", F.coalesce("lo", "l")).alias("lo"), F.greatest("h", F.coalesce("hi", "h")).alias("hi"), (F.col("lo").isNull() | (F.col("l") < F.col("lo")) | (F.col("h") > F.col("hi"))).alias("changed"))
        new = cut(merged.where("changed").drop("changed"))
        if new.isEmpty():
            return state
        state = cut(state.join(new.select("node"), "node", "left_anti").unionByName(new))
