"""Questions for a provider of decisions, its answers, and the findings they give.

A question is a row: its key, its kind, its map and what it is about. The options
of owner questions are a table of the map's cards that questions refer to, not
a list on every row. Answers are rows with a type: ``choice`` (choice,
probabilities, confidence), ``predicate`` (probability) or ``refusal``; each
kind of finding is a join of questions with answers and a threshold.

Defined results: a refusal gives no finding and is listed; an answer that does
not agree with its question is a problem row and gives no finding; a kind
without a threshold (null) gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUESTIONS = "key string, kind string, map_id string, subject string, card string"
ANSWERS = "key string, type string, choice string, probabilities map<string,double>, confidence double, probability double"
# The option for no card, and the kinds of findings.
NONE = "none"
MISFOLD, OWNER, SENTENCE, FLOW, GOVERNS = "decision mis-fold", "decision owner", "decision sentence", "decision flow", "decision governs"
#: Modules that a question about a sentence shows.
SHOWN = 6


def _question(df: DataFrame, kind: str, subject, card) -> DataFrame:
    key = F.concat_ws("|", "map_id", F.lit(kind), subject) if kind != "governs" else F.concat_ws("|", "map_id", F.lit(kind), subject, card)
    return df.select(key.alias("key"), F.lit(kind).alias("kind"), "map_id", subject.alias("subject"), card.alias("card"))


def plan_owner(held: DataFrame, unclaimed: DataFrame) -> DataFrame:
    """Who owns a module: for each module of a card, and for modules that no card claims. held: map_id, module, card, kind, empty_marker; unclaimed: map_id, module, empty_marker."""
    placed = held.where("kind <> 'actor' and not empty_marker").select("map_id", "module", "card")
    free = unclaimed.where("not empty_marker").select("map_id", "module", F.lit("").alias("card"))
    return _question(placed.unionByName(free), "owner", F.col("module"), F.col("card"))


def owner_options(cards: DataFrame) -> DataFrame:
    """(map_id, option, brief): the cards of each map that can own a module, and none of them. cards: map_id, card, kind, does, interface, plain."""
    own = cards.where("kind <> 'actor'")
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    parts = F.filter(F.array(F.when(said("plain") != "", F.concat("plain", F.lit("."))), F.nullif(said("does"), F.lit("")), F.when(said("interface") != "", F.concat(F.lit("Interface: "), "interface"))), lambda p: p.isNotNull())
    briefs = own.select("map_id", F.col("card").alias("option"), F.array_join(parts, " ").alias("brief"))
    return briefs.unionByName(cards.select("map_id").distinct().select("map_id", F.lit(NONE).alias("option"), F.lit("No component on this map has the function of this module.").alias("brief")))


def plan_sentences(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whether a card's sentence describes its modules: the questions, and (key, module) that they show, the first SHOWN of each card."""
    own = held.where("kind <> 'actor' and not empty_marker")
    first = own.withColumn("n", F.row_number().over(Window.partitionBy("map_id", "card").orderBy("module"))).where(F.col("n") <= SHOWN)
    questions = _question(own.select("map_id", "card").distinct(), "sentence", F.col("card"), F.col("card"))
    return questions, first.join(questions.select("key", "map_id", "card"), ["map_id", "card"]).select("key", "module")


def plan_flows(flows: DataFrame, cards: DataFrame, code: DataFrame, blind: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whether the code where two cards meet carries a flow: the questions, and (map_id, flow, why) of flows that can't be asked about.

    flows: map_id, flow, src, dst; cards: map_id, card, kind; code and blind:
    src, dst of pairs with lines and of pairs that can't be told (``code_between``).
    """
    actors = cards.where("kind = 'actor'").select("map_id", "card")
    own = flows.join(actors.withColumnRenamed("card", "src"), ["map_id", "src"], "left_anti").join(actors.withColumnRenamed("card", "dst"), ["map_id", "dst"], "left_anti")
    told = own.join(code.select("src", "dst").distinct().withColumn("code", F.lit(True)), ["src", "dst"], "left").join(blind.select("src", "dst").distinct().withColumn("blind", F.lit(True)), ["src", "dst"], "left")
    asked = told.where("code and blind is null")
    left = told.where("code is null or blind").select("map_id", "flow", F.when(F.col("blind"), "not known").otherwise("no line").alias("why"))
    return _question(asked, "flow", F.col("flow"), F.col("src")), left


def plan_governs(rules: DataFrame, cards: DataFrame) -> DataFrame:
    """Whether a rule governs a card that it does not name: every such pair of a map. rules: map_id, rule, governs (array)."""
    pairs = rules.join(cards.where("kind <> 'actor'").select("map_id", "card"), "map_id").where("not array_contains(governs, card)")
    return _question(pairs, "governs", F.col("rule"), F.col("card"))


def _fraction(value):
    return value.isNull() | (value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value <= 1))


def answer_problems(questions: DataFrame, answers: DataFrame, options: DataFrame) -> DataFrame:
    """(key, problem) of answers that do not agree with their questions, the first that holds; a question without an answer is one. Probabilities are checked option by option, by an equi-join."""
    own = questions.select("key", "kind", "map_id", "card").join(answers, "key", "left")
    known = options.select("map_id", F.col("option").alias("name"))
    named = own.where("type = 'choice'").select("key", "map_id", F.explode(F.map_entries("probabilities")).alias("e")).select("key", "map_id", F.col("e.key").alias("name"), F.col("e.value").alias("p"))
    strange = named.join(known, ["map_id", "name"], "left_anti").select("key").distinct().withColumn("strange", F.lit(True))
    wrong = named.where(F.col("p").isNull() | ~_fraction(F.col("p"))).select("key").distinct().withColumn("wrong", F.lit(True))
    picked = own.where("type = 'choice'").select("key", "map_id", F.col("choice").alias("name")).join(known, ["map_id", "name"], "left_semi").select("key").withColumn("picked", F.lit(True))
    told = own.join(strange, "key", "left").join(wrong, "key", "left").join(picked, "key", "left")
    choosing = F.col("kind") == "owner"
    needs = choosing & (F.col("card") != "") & ~F.coalesce(F.map_contains_key("probabilities", F.col("card")), F.lit(False))
    problem = (
        F.when(F.col("type").isNull(), "the answer is not an object").when(F.col("type") == "refusal", F.lit(None))
        .when(choosing & (F.col("type") != "choice"), "the answer does not select an option").when(~choosing & (F.col("type") != "predicate"), "the answer does not give a probability")
        .when(choosing & F.col("picked").isNull(), "choice is not one of the options").when(F.col("strange"), "a probability names an option that is not one of the options")
        .when(F.col("wrong"), "a probability is not a number from 0 to 1").when(choosing & ~_fraction(F.col("confidence")), "confidence is not a number from 0 to 1")
        .when(~choosing & (F.col("probability").isNull() | ~_fraction(F.col("probability"))), "probability is not a number from 0 to 1").when(needs, F.concat(F.lit("no probability for "), "card"))
    )
    return told.select("key", problem.alias("problem")).where("problem is not null")


def spread(answers: DataFrame) -> DataFrame:
    """(key, probabilities, problem) of choices: the probabilities, or the choice at its confidence; a choice with neither is a problem."""
    own = answers.where("type = 'choice'")
    given = F.coalesce(F.size("probabilities"), F.lit(0)) > 0
    value = F.when(given, F.col("probabilities")).when(F.col("confidence").isNotNull(), F.create_map("choice", "confidence"))
    return own.select("key", value.alias("probabilities"), F.when(value.isNull(), F.concat(F.lit("the answer "), "choice", F.lit(" gives no probabilities and no confidence"))).alias("problem"))


def refused(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(key) of the questions that got a refusal."""
    return questions.select("key").join(answers.where("type = 'refusal'").select("key"), "key", "left_semi")


def _two(value):
    return F.format_string("%.2f", value)


def _top(probabilities, n: int = 3):
    ranked = F.array_sort(F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("k"))))
    return F.slice(ranked, 1, n)


def findings(questions: DataFrame, answers: DataFrame, limits: dict[str, float | None], prefixes: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """(key, line, detail) of what the answers say against the map. prefixes: map_id, prefix; limits: misfold_below, owner_at, sentence_below, flow_below, governs_at."""
    own = questions.join(answers.where("type <> 'refusal'"), "key").join(prefixes, "map_id", "left").withColumn("prefix", F.coalesce("prefix", F.lit("")))
    if problems is not None:
        own = own.join(problems.select("key"), "key", "left_anti")
    limit = lambda name: F.lit(limits.get(name)).cast("double")
    like = F.when(F.col("choice") == NONE, "none of the cards").otherwise(F.col("choice"))
    top = _top(F.col("probabilities"))
    listed = F.array_join(F.transform(top, lambda e: F.concat_ws(" ", e["k"], _two(-e["p"]))), ", ")
    names = F.array_join(F.transform(top, lambda e: e["k"]), ", ")
    line = lambda *parts: F.concat("prefix", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    at = F.element_at("probabilities", F.col("card"))
    owners = own.where("kind = 'owner'")
    folded = owners.where("card <> ''").withColumn("p", at).where(F.col("p") < limit("misfold_below")).select(
        "key", line(f"{MISFOLD}: ", F.col("card"), " claims ", F.col("subject")).alias("line"), F.concat(F.lit("reads like "), like, F.lit("; P("), "card", F.lit(") "), _two(F.col("p")), F.lit("; most likely: "), listed).alias("detail")
    )
    sure = F.when(F.col("confidence").isNull(), "no confidence").otherwise(F.concat(F.lit("confidence "), _two(F.col("confidence"))))
    clear = F.coalesce(F.col("confidence") >= limit("owner_at"), F.lit(False))
    free = owners.where("card = ''").where(limit("owner_at").isNotNull()).select(
        "key", line(f"{OWNER}: ", F.col("subject"), " is claimed by no card").alias("line"),
        F.when(clear, F.concat(F.lit("reads like "), like, F.lit("; "), sure)).otherwise(F.concat(F.lit("closest: "), names, F.lit("; "), sure, F.lit("; "), listed)).alias("detail"),
    )
    p = F.col("probability")
    said = lambda what: F.concat(F.lit(f"P({what}) "), _two(p)).alias("detail")
    sentences = own.where("kind = 'sentence'").where(p < limit("sentence_below")).select("key", line(f"{SENTENCE}: ", F.col("subject"), "'s sentence may not describe its modules").alias("line"), said("describes"))
    flows = own.where("kind = 'flow'").where(p < limit("flow_below")).select("key", line(f"{FLOW}: ", F.col("subject"), ": the code where they meet may not carry it").alias("line"), said("carries it"))
    governs = own.where("kind = 'governs'").where(p >= limit("governs_at")).select("key", line(f"{GOVERNS}: invariant ", F.col("subject"), " may govern ", F.col("card"), ", which it does not name").alias("line"), said("governs"))
    return folded.unionByName(free).unionByName(sentences).unionByName(flows).unionByName(governs)


def pair_candidates(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """(a, b): modules that follow each other by name in their package, and modules that import each other, each pair once with a < b. modules: module, package; imports: module, target."""
    after = F.lead("module").over(Window.partitionBy("package").orderBy("module"))
    near = modules.select(F.col("module").alias("a"), after.alias("b")).where("b is not null")
    known = modules.select("module")
    linked = imports.where("module <> target").select("module", "target").join(known, "module", "left_semi").join(known.withColumnRenamed("module", "target"), "target", "left_semi")
    return near.unionByName(linked.select(F.least("module", "target").alias("a"), F.greatest("module", "target").alias("b"))).distinct()
