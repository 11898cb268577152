"""Drafts of sequences: answers in free text become steps, or rows that say why they can't be used.

The JSON between the first ``{`` and the last ``}`` of an answer is read as a
variant, so a field of a wrong type is a problem of its step and not of the
batch. Steps are rows, held against flows, components and modules by joins.

Defined results: an answer with any problem gives no steps; problems are in the
order of the steps, then those of the id and the label; an answer without an id
takes the name of its way in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model_checks import ID_FORM

ANSWERS = "key string, text string, name string, label string"
CONTROL = r"[\x00-\x1f\x7f  ]"
# What a refused answer is told.
NO_JSON, UNREAD, NO_LIST, NO_STEP = "the agent did not answer with JSON", "the agent's JSON could not be read", "steps must be a list", "no sequence step could be used"
SHAPE = "must have lists of component identifiers and a sentence"


def _shape(value):
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _of(value, path: str, kind: str):
    return F.try_variant_get(value, path, kind)


def _texts(value, path: str, needed: bool):
    """Whether a field is a list of texts (or absent, unless needed)."""
    there = _of(value, path, "variant")
    items = _of(value, path, "array<variant>")
    listed = F.startswith(_shape(there), F.lit("ARRAY")) & F.forall(items, lambda i: _shape(i) == "STRING")
    return F.when(there.isNull(), F.lit(not needed)).otherwise(F.coalesce(listed, F.lit(False)))


def _steps(answers: DataFrame) -> DataFrame:
    """(key, step, shaped, acts, measures, edge, refs, flow, say) of each step of the answers that are JSON with a list of steps."""
    raw = answers.where("listed").select("key", F.posexplode(_of(F.col("v"), "$.steps", "array<variant>")).alias("n", "s"))
    s = F.col("s")
    texts = lambda path: F.coalesce(_of(s, path, "array<string>"), F.array().cast("array<string>"))
    flow, say = _of(s, "$.flow", "variant"), _of(s, "$.say", "variant")
    shaped = F.startswith(_shape(s), F.lit("OBJECT")) & _texts(s, "$.acts", True) & _texts(s, "$.measures", True) & _texts(s, "$.edge", False) & _texts(s, "$.source_refs", False) & (flow.isNull() | (_shape(flow) == "STRING")) & (_shape(say) == "STRING")
    told = raw.select("key", (F.col("n") + 1).alias("step"), F.coalesce(shaped, F.lit(False)).alias("shaped"), texts("$.acts").alias("acts"), texts("$.measures").alias("measures"), texts("$.edge").alias("edge"), texts("$.source_refs").alias("refs"), F.coalesce(_of(s, "$.flow", "string"), F.lit("")).alias("flow"), F.coalesce(_of(s, "$.say", "string"), F.lit("")).alias("say"))
    return told.withColumn("shaped", F.col("shaped") & (F.trim("say") != "")).withColumn("edge", F.when(F.size("edge") == 0, F.array(F.lit(""), F.lit(""))).otherwise(F.col("edge")))


def read_answers(answers: DataFrame, flows: DataFrame, components: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, id, label, steps) of the drafts, (key, step, flow, src, dst, acts, measures, say) of their steps, and (key, problems) of refused answers.

    answers: ``ANSWERS``; flows: key, src, dst; components: id; modules: module.
    """
    body = F.coalesce(F.regexp_extract("text", r"(?s)\{.*\}", 0), F.lit(""))
    own = answers.withColumn("body", body).withColumn("v", F.try_parse_json(F.nullif("body", F.lit(""))))
    own = own.withColumn("listed", F.coalesce(F.startswith(_shape(_of(F.col("v"), "$.steps", "variant")), F.lit("ARRAY")), F.lit(False)))
    steps = _steps(own).withColumn("src", F.get("edge", F.lit(0))).withColumn("dst", F.get("edge", F.lit(1)))
    by_key = flows.select(F.col("key").alias("flow"), F.col("src").alias("f_src"), F.col("dst").alias("f_dst"))
    on_pair = flows.groupBy("src", "dst").agg(F.count("*").alias("on_pair"), F.min("key").alias("only"))
    told = steps.join(by_key, "flow", "left").join(on_pair, ["src", "dst"], "left")
    ends = F.when(F.col("flow") != "", F.array("f_src", "f_dst")).otherwise(F.col("edge"))
    named = told.select("key", "step", F.explode(F.array_distinct(F.concat("acts", "measures", ends))).alias("id"))
    strange = named.join(components.select("id"), "id", "left_anti").groupBy("key", "step").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("strange"))
    cited = told.select("key", "step", F.explode("refs").alias("ref")).withColumn("module", F.regexp_replace("ref", "[:@].*$", ""))
    lost = cited.join(modules.select("module"), "module", "left_anti").groupBy("key", "step").agg(F.array_join(F.array_sort(F.collect_set("ref")), ", ").alias("lost"))
    told = told.join(strange, ["key", "step"], "left").join(lost, ["key", "step"], "left")
    problem = (
        F.when(~F.col("shaped"), SHAPE).when(F.regexp_like("say", F.lit(CONTROL)), "has a sentence with a control character")
        .when(F.size("edge") != 2, F.concat(F.lit("has an edge with "), F.size("edge").cast("string"), F.lit(" values. An edge has two component identifiers")))
        .when((F.col("flow") == "") & F.col("on_pair").isNull(), F.concat(F.lit("traces "), F.array_join("edge", " -> "), F.lit(", which is not a flow")))
        .when((F.col("flow") != "") & F.col("f_src").isNull(), F.concat(F.lit("has unknown flow "), "flow")).when((F.col("flow") == "") & (F.col("on_pair") > 1), F.concat(F.lit("has several flows on "), F.array_join("edge", " -> ")))
        .when(F.col("strange").isNotNull(), F.concat(F.lit("has unknown component identifiers: "), "strange")).when(F.col("lost").isNotNull(), F.concat(F.lit("has source references that do not resolve: "), "lost"))
    )
    told = told.withColumn("problem", problem)
    good = told.where("problem is null")
    counted = told.groupBy("key").agg(F.count_if(F.col("problem").isNull()).alias("good"), F.array_sort(F.collect_list(F.when(F.col("problem").isNotNull(), F.struct("step", F.concat(F.lit("step "), F.col("step").cast("string"), F.lit(" "), "problem").alias("p"))))).alias("wrong"))
    given = F.trim(_of(F.col("v"), "$.id", "string"))
    ident = F.coalesce(F.nullif(given, F.lit("")), F.trim("name"))
    label = F.trim(F.coalesce(F.nullif(_of(F.col("v"), "$.label", "string"), F.lit("")), "label"))
    whole = own.join(counted, "key", "left").withColumn("ident", ident).withColumn("shown", label)
    has_id = F.coalesce(given != "", F.lit(False))
    listed = F.array(
        F.when(F.col("body") == "", NO_JSON).when(F.col("v").isNull(), UNREAD).when(~F.col("listed"), NO_LIST), F.when(F.col("v").isNotNull() & (F.coalesce("good", F.lit(0)) == 0), NO_STEP),
        F.when(F.col("v").isNotNull() & has_id & ~F.regexp_like("ident", F.lit(ID_FORM)), F.concat(F.lit("the sequence id '"), "ident", F.lit("' is not correct. An id contains only letters, digits, '_', '.', and '-'. It starts with a letter, a digit, or '_'"))),
        F.when(F.col("v").isNotNull() & ~has_id & F.regexp_like("ident", F.lit(CONTROL)), "the entry point name contains a control character or a Unicode line separator. Give a short sequence id, such as read-request"),
        F.when(F.col("v").isNotNull() & F.regexp_like("shown", F.lit(CONTROL)), "the sequence label contains a control character"),
    )
    of_steps = F.transform(F.coalesce("wrong", F.array().cast("array<struct<step:int,p:string>>")), lambda w: w["p"])
    first, rest = F.slice(listed, 1, 1), F.slice(listed, 2, 4)
    whole = whole.withColumn("problems", F.array_compact(F.concat(first, of_steps, rest)))
    drafts = whole.where("size(problems) = 0").select("key", F.col("ident").alias("id"), F.col("shown").alias("label"), F.col("good").alias("steps"))
    kept = good.join(drafts.select("key"), "key", "left_semi").select("key", "step", F.when(F.col("flow") != "", F.col("flow")).otherwise(F.col("only")).alias("flow"), F.coalesce("f_src", "src").alias("src"), F.coalesce("f_dst", "dst").alias("dst"), "acts", "measures", "say")
    return drafts, kept, whole.where("size(problems) > 0").select("key", "problems")
