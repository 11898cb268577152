"""The source lines where two components meet, under a budget of lines.

Lines are rows. Each use of a name from the other component gives a line a
priority: import lines and uses of imported names first, then lines that read
a property of a value that comes from an import, then the first lines of the
functions around them, then the lines next to those (``context``, none unless
asked for). A running number by priority cuts near the budget before the texts
are read, so Spark keeps only that many lines of a pair in any task; blank lines and lines that a file
doesn't have take no place.

Defined results: a pair without a use gives no line; a pair of which a module
that imports from the other side has no known call sites, or no source, is in
the second table, with the module; repeated sites count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut

LINES, TARGET_LINES, WIDTH = 60, 12, 160
#: So many times its budget a side's lines are read at first. More rows than these are not broadcast. The tier behind all others.
SLACK, BROADCAST_ROWS, LAST = 2, 200_000, 9
IMPORT, WHOLE, DEFAULT = "import", "*", "default"
SITES = "module string, target string, name string, bound string, line int, uses array<struct<line:int,function:int,member:string>>"


def sides(pairs: DataFrame, owners: DataFrame, uses: DataFrame) -> DataFrame:
    """(src, dst, back, module, target): the imports across each pair; back if they lead from dst to src. owners: module, owner; uses: module, target."""
    ends = owners.select(F.col("module"), F.col("owner").alias("a")), owners.select(F.col("module").alias("target"), F.col("owner").alias("b"))
    across = uses.select("module", "target").join(ends[0], "module").join(ends[1], "target").where("a <> b").distinct()
    there = across.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(False).alias("back"), "module", "target")
    back = across.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(True).alias("back"), "module", "target")
    return pairs.select("src", "dst").distinct().join(there.unionByName(back), ["src", "dst"])


def picks(across: DataFrame, context: int = 0) -> DataFrame:
    """(a, b, module, line, tier, l, blind): the lines of each side with their best priority, (tier, l) in order for one module.

    across: imports (a, b, module) with ``blind`` and the columns of their site, null if there is none. A module that is
    blind has a row without a line, too.
    """
    side = ["a", "b", "module"]
    direct = F.col("bound") == IMPORT
    uses = across.withColumn("u", F.explode("uses")).where(direct | (F.coalesce("u.member", F.lit("")) != ""))
    found = across.where(direct).select(*side, F.lit(1).alias("tier"), "line", F.lit(0).alias("function")).unionByName(
        uses.select(*side, F.when(direct, 1).otherwise(2).alias("tier"), F.col("u.line").alias("line"), F.coalesce("u.function", F.lit(0)).alias("function"))
    )
    # The tiers: what is found, 1 and 2; the functions around those, 5 and 6; lines beside any, 7. One number holds the tier and the line that it is for.
    rank = lambda tier, line: tier.cast("long") * F.lit(1 << 32) + line + F.lit(1 << 31)
    tier, line = F.col("tier"), F.col("line")
    beside = F.transform(F.sequence(line - context, line + context), lambda n: F.struct(n.alias("line"), rank(F.lit(7), line).alias("rank"))) if context else F.array()
    around = F.when((F.col("function") > 0) & (F.col("function") != line), F.array(F.struct(F.col("function").alias("line"), rank(tier + 4, line).alias("rank"))))
    own = F.array(F.struct(line.alias("line"), rank(tier, line).alias("rank")))
    ranks = "array<struct<line:int,rank:bigint>>"
    every = found.select(*side, F.inline(F.concat(own.cast(ranks), F.coalesce(around.cast(ranks), F.array().cast(ranks)), beside.cast(ranks)))).where("line > 0").withColumn("blind", F.lit(False))
    untold = across.where("blind").select(*side, F.lit(None).cast("int").alias("line"), F.lit(None).cast("long").alias("rank"), "blind")
    best = every.unionByName(untold).groupBy(*side, "line").agg(F.min("rank").alias("rank"), F.bool_or("blind").alias("blind"))
    return best.select(*side, "line", F.coalesce(F.shiftright("rank", 32), F.lit(LAST)).alias("tier"), F.col("rank").bitwiseAND(F.lit((1 << 32) - 1)).alias("l"), "blind")


def _written(picked: DataFrame, lines: DataFrame) -> DataFrame:
    """The picked lines that their file has and that are not blank, with their text."""
    near = F.broadcast(picked) if picked.count() <= BROADCAST_ROWS else picked
    texts = lines.select("module", F.col("n").alias("line"), F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("text"))
    return texts.join(near, ["module", "line"]).where("text <> ''")


def code_between(pairs: DataFrame, owners: DataFrame, uses: DataFrame, sites: DataFrame, lines: DataFrame, known: DataFrame, budget: int = LINES, context: int = 0) -> tuple[DataFrame, DataFrame]:
    """(src, dst, at, module, line, text), at most ``budget`` lines a pair, and (src, dst, module) of pairs that can't be told.

    pairs: src, dst; owners: module, owner; uses: module, target; sites:
    ``SITES``; lines: module, n (from 1), text; known: module, sites, source
    (booleans: whether its call sites are known, and its source).

    Lines are picked once for each side (imports from a to b), which the pairs
    a, b and b, a share. Of a side only the first ``SLACK * budget`` lines meet
    the texts; sides that have fewer lines than the budget among those, and
    more behind them, are told again with all their lines.
    """
    asked = cut(pairs.select("src", "dst").distinct())
    wanted = asked.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(asked.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    cards = wanted.select(F.col("a").alias("owner")).distinct()
    own = owners.select("module", "owner").join(cards, "owner", "left_semi").join(known.select("module", "sites", "source"), "module", "left")
    met = uses.select("module", "target").join(own.withColumnRenamed("owner", "a"), "module").join(own.select(F.col("module").alias("target"), F.col("owner").alias("b")), "target").where("a <> b")
    told = met.join(wanted, ["a", "b"], "left_semi").join(sites.select("module", "target", "bound", "line", "uses", F.lit(True).alias("meets")), ["module", "target"], "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    best = picks(told.select("a", "b", "module", "bound", "line", "uses", (no("sites") | (F.coalesce("meets", F.lit(False)) & no("source"))).alias("blind")), context)

    side, order = Window.partitionBy("a", "b"), ["tier", "module", "l", "line"]
    first = best.withColumn("n", F.row_number().over(side.orderBy(*order))).where(F.col("n") <= SLACK * budget)
    first = cut(first.unionByName(best.where("blind").withColumn("n", F.lit(0))))  # one pass for both
    untold = first.where("blind").select("a", "b", "module").distinct()
    picked = first.where("n > 0 and line is not null").drop("blind")
    shown = cut(_written(picked, lines))
    full = shown.groupBy("a", "b").agg(F.count("*").alias("k")).where(F.col("k") >= budget)
    open_ = cut(picked.where(F.col("n") == SLACK * budget).select("a", "b").join(full, ["a", "b"], "left_anti"))
    if not open_.isEmpty():
        rest = cut(best.where("line is not null").join(open_, ["a", "b"], "left_semi").drop("blind").withColumn("n", F.lit(0)))
        shown = shown.join(open_, ["a", "b"], "left_anti").unionByName(_written(rest, lines))

    ways = asked.select("src", "dst", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(False).alias("back")).unionByName(asked.select("src", "dst", F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(True).alias("back")))
    blind = ways.join(untold, ["a", "b"]).select("src", "dst", "module").distinct()
    pair = Window.partitionBy("src", "dst")
    chosen = ways.join(blind.select("src", "dst").distinct(), ["src", "dst"], "left_anti").join(shown, ["a", "b"])
    kept = chosen.withColumn("n", F.row_number().over(pair.orderBy("tier", "back", "module", "l", "line"))).where(F.col("n") <= budget)
    shown = kept.withColumn("at", F.row_number().over(pair.orderBy("back", "module", "line")))
    return shown.select("src", "dst", "at", "module", "line", F.concat(F.col("module"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.substring("text", 1, WIDTH)).alias("text")), blind


def target_lines(code: DataFrame, across: DataFrame, sites: DataFrame, definitions: DataFrame, summaries: DataFrame, limit: int = TARGET_LINES) -> DataFrame:
    """(src, dst, at, text): what the modules define that the chosen lines use, then their first sentences. definitions: module, name, pos, text; summaries: module, sentence."""
    own = across.join(sites, ["module", "target"])
    uses = own.withColumn("u", F.explode("uses")).select("src", "dst", "module", "target", "name", F.col("u.line").alias("line"), F.when(F.col("bound") == IMPORT, F.col("u.member")).otherwise(F.nullif("u.member", F.lit(""))).alias("member"), "bound").where((F.col("bound") == IMPORT) | F.col("member").isNotNull())
    heads = own.where(F.col("bound") == IMPORT).select("src", "dst", "module", "target", "name", "line", F.lit("").alias("member"), "bound")
    used = uses.unionByName(heads).join(code.select("src", "dst", "module", "line"), ["src", "dst", "module", "line"], "left_semi")
    names = used.select("src", "dst", "target", F.explode(F.array("name", "member")).alias("name")).where(F.col("name").isNotNull() & ~F.col("name").isin(WHOLE, DEFAULT, "")).distinct()
    defined = names.join(definitions.withColumnRenamed("module", "target"), ["target", "name"]).select("src", "dst", F.lit(0).alias("kind"), "target", "pos", F.concat("target", F.lit(" defines: "), "text").alias("text"))
    said = used.select("src", "dst", "target").distinct().join(summaries.withColumnRenamed("module", "target"), "target").where("sentence <> ''").select("src", "dst", F.lit(1).alias("kind"), "target", F.lit(0).alias("pos"), F.concat("target", F.lit(" docstring: "), "sentence").alias("text"))
    order = Window.partitionBy("src", "dst").orderBy("kind", "target", "pos", "text")
    return defined.unionByName(said).withColumn("at", F.row_number().over(order)).where(F.col("at") <= limit).select("src", "dst", "at", F.substring("text", 1, WIDTH).alias("text"))
