"""Queries: findings of whole maps, lost evidence, and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bindings import Tables, WrittenTables
from ..operators import claims as cl
from ..operators import decisions, diff, edges, findings, metrics, model_checks, shapes
from ..scratch import cut
from ..sources import facts
from . import analysis, core, more, states  # noqa: F401  their queries are registered first
from .registry import QUERIES, Query, query

# --- evidence of flows -------------------------------------------------------------
# Flows with pos % 7 = 0 were reviewed at the base; at the head those with pos % 21 = 0 are
# no longer, and imports of the base decide its structural ones.

_EVIDENCE = """+ jh as (select distinct least(p, q) as a, greatest(p, q) as b from crossing),
jb as (select distinct least(a.owner, b.owner) as a, greatest(a.owner, b.owner) as b from base_uses u join owner a on a.module = u.module join owner b on b.module = u.target where a.owner <> b.owner),
act as (select id from components where kind = 'actor'),
ev as (select *, case when src in (select id from act) or dst in (select id from act) then 'external' else null end as ext, exists (select 1 from jb where a = least(src, dst) and b = greatest(src, dst)) as linked_b, exists (select 1 from jh where a = least(src, dst) and b = greatest(src, dst)) as linked_h from flows),
both_ as (select *, coalesce(ext, case when pos % 7 = 0 then 'observed' when linked_b then 'structural' else 'declared' end) as was, coalesce(ext, case when pos % 7 = 0 and pos % 21 <> 0 then 'observed' when linked_h and pos % 4 <> 1 then 'structural' else 'declared' end) as now from ev)
"""


def _named(x: Tables) -> DataFrame:
    return x.flows.select("key", F.concat("src", F.lit(" to "), "dst").alias("name"), "kind", "src", "dst", "pos").withColumnRenamed("kind", "artifact")


def _evidence(x: Tables, head: bool) -> DataFrame:
    joined = edges.unordered_pairs(x.pair_counts if head else edges.crossing(x.base_uses, x.owners))
    if head:  # a quarter of the flows have lost their import
        kept = x.flows.where("pos % 4 <> 1").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "key")
        told = findings.flow_states(x.flows, x.components, joined, joined.limit(0), x.flows.where("pos % 7 = 0 and pos % 21 <> 0"), [])
        return told.join(kept.select("key", F.lit(True).alias("kept")), "key", "left").select("key", F.when((F.col("state") == "structural") & F.col("kept").isNull(), "declared").otherwise(F.col("state")).alias("state"))
    return findings.flow_states(x.flows, x.components, joined, joined.limit(0), x.flows.where("pos % 7 = 0"), [])


@query(_EVIDENCE + """select key, kind_ as kind, case kind_ when 'evidence lost' then 'evidence lost: ' || src || ' to ' || dst || ' (' || kind || ') had a current source review at base and no import connects them now. Find the evidence, give the mechanism, or remove the flow in the model'
  when 'source evidence lost' then 'source evidence lost: ' || src || ' to ' || dst || ' (' || kind || ') was source reviewed at base and is now ' || now || '. Examine its source references, direction, and artifact.'
  else 'structural evidence lost: ' || src || ' to ' || dst || ' (' || kind || ') had an import or declared mechanism at the base commit. That evidence is missing now. Examine the flow.' end as line
from (select *, case when was = 'observed' and now = 'declared' then 'evidence lost' when was = 'observed' and now <> 'observed' then 'source evidence lost' when was = 'structural' and now = 'declared' then 'structural evidence lost' end as kind_ from both_) where kind_ is not null""", 370)
def lost_evidence(x: Tables) -> DataFrame:
    return findings.lost_evidence(_named(x), _evidence(x, False), _evidence(x, True), " at base")


@query(_EVIDENCE + "select key, 'flow review: ' || src || ' to ' || dst || ' (' || kind || ') has structural evidence but no source review. Give source references for direction and artifact, or change the flow.' as line from both_ where now = 'structural' or (pos % 10 = 3 and now <> 'external')", 358)
def flow_reviews(x: Tables) -> DataFrame:
    named = _named(x).withColumn("unresolved_refs", F.col("pos") % 10 == 3)
    return findings.flow_review(named.join(_evidence(x, True), "key"))


# A flow cites the first module of its source card, or of a card that it doesn't touch.
_CITES = """+ firsts as (select id, min(module) as module from claimed group by id), refs as (
  select f.key, o.module from flows f join firsts o on o.id = case when f.pos % 3 = 0 then f.src when f.pos % 3 = 1 then 'Pinned' end)
, named as (select e.key, string_agg(c.id, ' or ' order by c.pos, c.id) as ends from (select key, src as id from flows union select key, dst from flows) e join components c using (id) where c.kind <> 'actor' group by e.key)
"""


@query(_CITES + """select f.key, 'no endpoint source: ' || f.src || ' to ' || f.dst || ' (' || f.kind || '): no source record is in a module of ' || coalesce(ends, '') || '. Add a source record in a module of ' || coalesce(ends, '') || ', or change the flow.' as line
from flows f left join named using (key) where f.key in (select key from refs) and not exists (select 1 from refs r join claimed c using (module) where r.key = f.key and c.id in (f.src, f.dst))""", 359)
def flows_without_endpoint_source(x: Tables) -> DataFrame:
    held = x.matched
    firsts = held.groupBy("id").agg(F.min("module").alias("module"))
    cites = x.flows.select("key", F.when(F.col("pos") % 3 == 0, F.col("src")).when(F.col("pos") % 3 == 1, "Pinned").alias("id")).join(firsts, "id")
    components = x.components.select("id", "pos", (F.col("kind") != "actor").alias("claims"))
    return findings.no_endpoint_source(_named(x), cites, held, components)


@query("""+ s as (select distinct key from flows where pos % 5 = 0), p as (select distinct kind, module, case when target = '' then name else target end as what from entry_points), c as (select distinct kind, module, case when target = '' then name else target end as what from entry_points where ord % 4 = 0)
select 'sequences' as measure, count(*) as n from components union all select 'drafted sequences', count(*) from components where pos % 2 = 0 union all select 'steps', count(*) from flows where pos % 5 = 0 union all select 'flows on no step', count(*) from flows where pos % 5 <> 0
union all select 'ways in', count(*) from p union all select 'ways in without a sequence', count(*) from (select * from p except select * from c)""", 376)
def sequence_measures(x: Tables) -> DataFrame:
    steps = x.flows.where("pos % 5 = 0").select(F.col("src").alias("journey"), F.col("key").alias("flow"))
    points = x.entry_points.select("ord", F.struct("kind", "module", F.when(F.col("target") == "", F.col("name")).otherwise(F.col("target")).alias("what")).alias("identity"))
    return findings.sequence_measures(steps, x.components.select(F.col("id").alias("journey"), (F.col("pos") % 2 == 0).alias("drafted")), points, points.where("ord % 4 = 0").select("identity").distinct(), x.flows)


# --- all findings of a tree of maps ----------------------------------------------------
# (kind, query, the card whose map a line is on, the line); cards are on three maps by the
# length of their name, lines without a card on the top one.

_LINES = (
    ("single module", "single_module", "id", "id || ' has one module, ' || module"), ("mis-fold", "mis_folds", "id", "id || ' claims ' || module"), ("no sentence", "flows_without_sentence", None, "key || ' has no sentence'"),
    ("thin layer", "thin_layers", None, "layer || ' has ' || endpoints || ' endpoints'"), ("entry point", "entry_groups", "owner", "kind || ' ' || case when name = '' then n || ' ways in' else name end || ' has no sequence'"),
    ("sequence step", "step_flows", None, "journey || ' ' || pos || ': ' || problem"), ("crossing import", "crossing_imports", "p", "p || ' imports ' || q"), ("declared flow", "flow_states", None, "key || ' is ' || state"),
    ("flow review", "flow_reviews", None, "line"), ("no endpoint source", "flows_without_endpoint_source", None, "line"), ("stale source review", "review_states", "key", "key || ' has a source_review digest that is not the current digest'"),
    ("model sdk", "sdk_imports", None, "name || ' is in ' || sdk"), ("unknown facts", "unknown_counts", None, "cause || ': ' || n"), ("rule", "rules_without_reason", None, "n || ' has no reason'"),
)
_ONLY = {"sequence step": "problem <> ''", "declared flow": "state = 'declared'", "stale source review": "state = 'stale'", "model sdk": "sdk <> ''"}


def _whole() -> str:
    parts = []
    for kind, name, card, line in _LINES:
        where = _ONLY.get(kind, "true")
        parts.append(f"select {f'coalesce(length({card}) % 3, 0)' if card else '0'} as m, '{kind}' as kind, {line} as line from ({QUERIES[name].sql}) where {where}")
    return "select cast(m as varchar) as map_id, kind, case when m = 0 then '' else 'map ' || m || ': ' end || line as line from (" + " union all ".join(parts) + ")"


def _all_lines(x: Tables) -> DataFrame:
    parts = {}
    for kind, name, card, line in _LINES:
        own = QUERIES[name].run(x).where(_ONLY.get(kind, "true"))
        place = F.coalesce(F.length(card) % 3, F.lit(0)) if card else F.lit(0)
        parts[kind] = cut(own.select(place.cast("string").alias("map_id"), F.expr(line).cast("string").alias("line")))  # one generator at a time, not the stages of all at once
    prefixes = x.spark.range(3).select(F.col("id").cast("string").alias("map_id"), F.when(F.col("id") == 0, "").otherwise(F.concat(F.lit("map "), F.col("id").cast("string"), F.lit(": "))).alias("prefix"))
    return findings.map_findings(parts, prefixes)


def all_finding_lines(x: Tables) -> DataFrame:
    """Every generator of findings, one after the other, with the prefix of the map that a line is on."""
    return _all_lines(WrittenTables(x.spark, x.sf_dir))


QUERIES["all_finding_lines"] = Query("all_finding_lines", all_finding_lines, _whole(), (351,))  # its SQL holds that of other queries, bindings and all

# --- decisions ---------------------------------------------------------------------------
# Every question gets an answer whose probability follows from its names.

_ASKED = """+ p as (select *, round((length(module) * 7 + length(owner) * 13) % 101 / 100.0, 2) as p from owner join components on id = owner where kind <> 'actor' and module not in (select module from modules where k % 29 = 0)),
free as (select module, round(length(module) * 11 % 101 / 100.0, 2) as c from modules where module not in (select module from owner) and k % 29 <> 0),
sent as (select distinct owner, round(length(owner) * 9 % 101 / 100.0, 2) as p from p),
act as (select id from components where kind = 'actor'), jn as (select distinct least(p, q) as a, greatest(p, q) as b from crossing), asked as (select key, round(length(key) * 5 % 101 / 100.0, 2) as p from flows where src not in (select id from act) and dst not in (select id from act) and exists (select 1 from jn where a = least(src, dst) and b = greatest(src, dst))),
inv as (select pos % 9 as n, list(distinct id) as governs from components group by pos % 9), gov as (select i.n, c.id, round((i.n * 17 + length(c.id) * 3) % 101 / 100.0, 2) as p from inv i join components c on kind <> 'actor' and not list_contains(governs, c.id))
"""


@query(_ASKED + """select '|owner|' || module as key, 'decision mis-fold: ' || owner || ' claims ' || module as line from p where p < 0.3 union all select '|owner|' || module, 'decision owner: ' || module || ' is claimed by no card' from free
union all select '|sentence|' || owner, 'decision sentence: ' || owner || '''s sentence may not describe its modules' from sent where p < 0.4 union all select '|flow|' || key, 'decision flow: ' || key || ': the code where they meet may not carry it' from asked where p < 0.25
union all select '|governs|' || n || '|' || id, 'decision governs: invariant ' || n || ' may govern ' || id || ', which it does not name' from gov where p >= 0.7""", 332, 333, 334, 335, 336, 337, 338, 339, 340, 341)
def decision_findings(x: Tables) -> DataFrame:
    top = F.lit("").alias("map_id")
    cards = x.components.select(top, F.col("id").alias("card"), "kind")
    owner = cl.owners(x.claims, x.modules).select("module", F.col("owner").alias("card"))
    marked = x.modules.select("module", F.col("empty_marker"))
    held = owner.join(cards, "card").join(marked, "module")
    questions = decisions.plan_owner(held, marked.join(owner, "module", "left_anti").withColumn("map_id", F.lit("")))
    questions = questions.unionByName(decisions.plan_sentences(held)[0])
    crossing = edges.crossing(x.uses, cl.owners(x.claims, x.modules))
    code = crossing.select(F.col("p").alias("src"), F.col("q").alias("dst")).unionByName(crossing.select(F.col("q").alias("src"), F.col("p").alias("dst"))).distinct()
    questions = questions.unionByName(decisions.plan_flows(x.flows.select(top, F.col("key").alias("flow"), "src", "dst"), cards, code, code.limit(0))[0])
    rules = x.components.groupBy((F.col("pos") % 9).alias("n")).agg(F.collect_set("id").alias("governs")).select(top, F.col("n").cast("string").alias("rule"), "governs")
    questions = questions.unionByName(decisions.plan_governs(rules, cards))
    share = lambda n: F.round(n % 101 / 100.0, 2)
    subject, card = F.length("subject"), F.length("card")
    p = F.when(F.col("kind") == "sentence", share(card * 9)).when(F.col("kind") == "flow", share(subject * 5)).when(F.col("kind") == "governs", share(F.col("subject").cast("int") * 17 + card * 3))
    kept = share(subject * 7 + card * 13)
    chosen = F.when(F.col("card") == "", F.create_map(F.lit("none"), share(subject * 11))).otherwise(F.create_map("card", kept))
    owners = F.col("kind") == "owner"
    answers = questions.select(
        "key", F.when(owners, "choice").otherwise("predicate").alias("type"), F.when(owners, F.when(F.col("card") == "", "none").otherwise(F.col("card"))).alias("choice"), F.when(owners, chosen).alias("probabilities"),
        F.when(owners & (F.col("card") == ""), share(subject * 11)).alias("confidence"), p.alias("probability"),
    )
    limits = {"misfold_below": 0.3, "owner_at": 0.8, "sentence_below": 0.4, "flow_below": 0.25, "governs_at": 0.7}
    return decisions.findings(questions, answers, limits, x.spark.range(1).select(top, F.lit("").alias("prefix"))).select("key", "line")


@query("""+ near as (select module as a, lead(module) over (partition by package order by module) as b from modules)
select a, b from near where b is not null union select least(module, target), greatest(module, target) from uses where module <> target""", 174, 430)
def module_pairs(x: Tables) -> DataFrame:
    return decisions.pair_candidates(x.modules, x.uses)


# --- checks ------------------------------------------------------------------------------
# Each module is a facts file of its own, five of six with one fault.

_SCHEMA = {
    "text": "text", "integer": "integer", "path": "path", "texts": ["list", "text"], "named": {"!name": "text"}, "nameds": ["list", "named"],
    "module": {"!file": "path", "!functions": "nameds", "!total": "integer", "loc": "integer", "imports": "texts?"}, "modules": ["map plain", "module"], "facts": {"!components": "modules"},
}


@query("""select module as doc, 'the value at ["components"]["' || module || '"]' || case k % 6 when 1 then '["file"] must be a relative path' when 2 then ' has no "total" key' when 3 then '["functions"][1]["name"] must be a text value' when 4 then '["loc"] must be an integer' else '["imports"][0] must be a text value' end as problem from modules where k % 6 <> 0""", 267, 268, 269, 270, 271, 285)
def shape_problems(x: Tables) -> DataFrame:
    n = F.col("k") % 6
    parts = [
        F.concat(F.lit('"file": "'), F.when(n == 1, "/").otherwise(""), "file", F.lit('"')), F.concat(F.lit(', "functions": [{"name": "f"}, {"name": '), F.when(n == 3, "5").otherwise('"g"'), F.lit("}]")),
        F.when(n == 2, "").otherwise(', "total": 1'), F.concat(F.lit(', "loc": '), F.when(n == 4, '"x"').otherwise(F.col("loc").cast("string"))), F.when(n == 5, ', "imports": [1]').when(n == 0, ', "imports": null').otherwise(', "imports": ["a"]'),
    ]
    content = F.concat(F.lit('{"components": {"'), "module", F.lit('": {'), *parts, F.lit("}}}"))
    return shapes.first_problem(shapes.problems(x.modules.select(F.col("module").alias("doc"), content.alias("content")), _SCHEMA, "facts"))


# The flows of a card are on one of three maps; two of five have no id, some share one, and
# every sixth is there twice.

_DRAWN = """+ drawn as (select cast(length(src) % 3 as varchar) as map_id, pos * 2 + n as pos, case when pos % 5 < 2 then '' when pos % 5 = 2 then 'shared' else 'f' || pos || case when pos % 9 = 0 then ' odd' else '' end || case when n = 1 then 'b' else '' end end as id, src, dst, 'a' || n as artifact
  from flows, range(2) r(n) where n = 0 or pos % 6 = 0)
"""


@query(_DRAWN + """select map_id, 'flow id' as check, 'flow ' || src || ' -> ' || dst || ' has the id ''' || id || '''. An id contains only letters, digits, ''_'', ''.'', and ''-''. It starts with a letter, a digit, or ''_''' as line from drawn where id <> '' and not regexp_full_match(id, '[A-Za-z0-9_][A-Za-z0-9_.-]*')
union all select map_id, 'flow id', 'flow id ' || id || ' identifies two flows. Give each flow its own id' from (select *, row_number() over (partition by map_id, id order by pos) as m from drawn where id <> '') where m > 1
union all select map_id, 'flow pair', 'flow ' || src || ' -> ' || dst || ' appears twice (''a0'' and ''a1''). Give each flow on this pair its own id. For an artifact that goes back, add a flow in the opposite direction' from drawn group by map_id, src, dst having count(*) > 1 and not bool_and(id <> '')""", 275, 276, 282, 283)
def flow_check_lines(x: Tables) -> DataFrame:
    p, n = F.col("pos"), F.col("n")
    twice = x.flows.withColumn("n", F.explode(F.when(p % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    own = F.concat(F.lit("f"), p.cast("string"), F.when(p % 9 == 0, " odd").otherwise(""), F.when(n == 1, "b").otherwise(""))
    drawn = twice.select((F.length("src") % 3).cast("string").alias("map_id"), (p * 2 + n).alias("pos"), F.when(p % 5 < 2, "").when(p % 5 == 2, "shared").otherwise(own).alias("id"), "src", "dst", F.concat(F.lit("a"), n.cast("string")).alias("artifact"))
    return model_checks.flow_problems(drawn)


@query("""+ rules as (select pos, case when pos % 4 = 0 then 'same' else 'r' || pos end as id, case when pos % 5 = 0 then 'other' else 'forbid_import' end as kind, id as a, case when pos % 3 = 0 then 'Nobody' else 'Large' end as b, pos % 9 as invariant from components)
select 'import rule' as check, id || ' is the id of two rules. Give each rule its own id' as line from (select *, row_number() over (partition by id order by pos) as n from rules) where n > 1 union all select 'import rule', id || ' has unknown kind other. Use forbid_import, allow_imports' from rules where kind = 'other'
union all select 'import rule', id || ' has unknown component Nobody' from rules where b = 'Nobody' and kind <> 'other' union all select 'import rule', id || ' has unknown invariant ' || invariant from rules where invariant > 4
union all select 'meaning', id || ' has no plain word' from components where pos % 4 = 1 union all select 'meaning', 'flow ' || key || ' has no sentence in relations' from flows where trim(relation) = '' union all select 'meaning', 'flow ' || key || ' has unknown layer control' from flows where kind = 'control'
union all select 'boundary', 'region ' || kind || ' has the id of a container. Give each region and container a different id' from (select distinct kind from components where kind <> 'tool')""", 273, 274, 277, 278, 452)
def model_check_lines(x: Tables) -> DataFrame:
    p, top = F.col("pos"), F.lit("").alias("map_id")
    rules = x.components.select(top, "pos", F.when(p % 4 == 0, "same").otherwise(F.concat(F.lit("r"), p.cast("string"))).alias("id"), F.when(p % 5 == 0, "other").otherwise("forbid_import").alias("kind"), F.array("id").alias("src"), F.array(F.when(p % 3 == 0, "Nobody").otherwise("Large")).alias("dst"), (p % 9).alias("invariant"))
    components = x.components.select(top, "id")
    found = model_checks.rule_problems(rules, components, x.spark.range(5).select(top, F.col("id").alias("n")))
    flows = x.flows.select(top, F.col("key").alias("name"), "relation", F.col("kind").alias("layer"), "kind")
    layers = x.spark.range(1).select(top, F.lit("data").alias("id"))
    found = found.unionByName(model_checks.meaning_problems(flows, components, x.components.where("pos % 4 <> 1").select(top, "id"), layers))
    kinds = x.components.select(top, "kind").distinct()
    boundaries = kinds.select("map_id", F.lit(1).alias("pos"), F.lit("region").alias("kind"), F.col("kind").alias("id")).unionByName(kinds.where("kind <> 'tool'").select("map_id", F.lit(1).alias("pos"), F.lit("container").alias("kind"), F.col("kind").alias("id")))
    return found.unionByName(model_checks.boundary_problems(boundaries)).select("check", "line")


# --- comparisons ---------------------------------------------------------------------------
# The base has no flow with pos % 10 = 3, other sentences on pos % 7 = 2, and other kinds on
# pos % 11 = 5; rules govern the cards of their number, at the base without the last one.


@query("""+ a as (select key, case when pos % 11 = 5 then 'old' else kind end as kind, case when pos % 7 = 2 then 'old ' || relation else relation end as relation from flows where pos % 10 <> 3), b as (select key, kind, relation from flows where pos % 13 <> 4),
f as (select 'flow' as what, coalesce(a.key, b.key) as item, case when a.key is null then 'added' when b.key is null then 'removed' when a.kind <> b.kind or a.relation <> b.relation then 'changed' end as how, case when a.key is null or b.key is null then '' else concat_ws(',', case when a.kind <> b.kind then 'kind' end, case when a.relation <> b.relation then 'relation' end) end as fields from a full join b on a.key = b.key),
gov as (select pos % 9 as n, list_sort(list(id)) as now, list_sort(list(id)[:]) as was from components group by 1),
r as (select 'rule' as what, cast(n as varchar) as item, case when n = 8 then 'removed' when n = 7 then 'added' when n % 2 = 0 then 'changed' end as how, case when n % 2 = 0 and n < 7 then 'governs' else '' end as fields from gov),
s as (select 'sequence' as what, cast(journey as varchar) as item, 'changed' as how, 'steps' as fields from (select conv_id as journey, count(*) as n, count(*) filter (turn % 5 <> 4) as m from conversations group by conv_id) where n <> m)
select what, item, how, fields from (select * from f union all select * from r union all select * from s) where how is not null""", 126, 127, 128, 129)
def compared_models(x: Tables) -> DataFrame:
    p = F.col("pos")
    base = x.flows.where("pos % 10 <> 3").select(F.col("key").alias("item"), F.when(p % 11 == 5, "old").otherwise(F.col("kind")).alias("kind"), F.when(p % 7 == 2, F.concat(F.lit("old "), "relation")).otherwise(F.col("relation")).alias("relation"))
    head = x.flows.where("pos % 13 <> 4").select(F.col("key").alias("item"), "kind", "relation")
    flows = diff.keyed(base, head, ["item"], ["kind", "relation"]).withColumn("what", F.lit("flow"))
    rules = x.components.groupBy((p % 9).alias("n")).agg(F.array_sort(F.collect_list("id")).alias("governs"))
    named = F.col("n").cast("string").alias("item")
    was = rules.where("n <> 7").select(named, F.when(F.col("n") % 2 == 0, F.concat("governs", F.array(F.lit("Extra")))).otherwise(F.col("governs")).alias("governs"))
    rules = diff.keyed(was, rules.where("n <> 8").select(named, "governs"), ["item"], ["governs"]).withColumn("what", F.lit("rule"))
    steps = lambda df: df.groupBy(F.col("conv_id").cast("string").alias("item")).agg(F.array_sort(F.collect_list("turn")).alias("steps"))
    talks = x.raw("conversations").select("conv_id", "turn")
    all_steps = steps(talks)
    fewer = steps(talks.where("turn % 5 <> 4"))
    sequences = diff.keyed(fewer, all_steps, ["item"], ["steps"]).withColumn("what", F.lit("sequence"))
    return flows.unionByName(rules).unionByName(sequences).select("what", "item", "how", "fields")


@query("select event_type, count(*) as n, median(value) as median, max(value) as most, list_sort(list(value))[cast(floor(count(*) * 0.5) as bigint) + 1] as p50, list_sort(list(value))[cast(floor(count(*) * 0.9) as bigint) + 1] as p90 from events group by event_type", 422)
def usage_quantiles(x: Tables) -> DataFrame:
    e = x.raw("events")
    by = e.groupBy("event_type").agg(F.count("*").alias("n"), F.median("value").alias("median"), F.max("value").alias("most"))
    at = lambda q, name: metrics.index_quantile(e, "event_type", "value", q).withColumnRenamed("v", name)
    return by.join(at(0.5, "p50"), "event_type").join(at(0.9, "p90"), "event_type")


@query("select name as import, string_agg(module, ',' order by module) as modules from (select distinct module, unnest(names) as name from modules) group by name", 60)
def external_imports(x: Tables) -> DataFrame:
    """Every name with the modules that import it."""
    return x.modules.select("module", F.explode(F.array_distinct("names")).alias("import")).groupBy("import").agg(F.array_join(F.array_sort(F.collect_list("module")), ",").alias("modules"))


@query("""select module, n.name, n.kind from (select module, unnest(case when k % 3 = 0 then list_transform(names, lambda w: {'name': w, 'kind': 'word'}) when k % 3 = 1 then list_transform(names[:2], lambda w: {'name': w, 'kind': 'function'}) || list_transform(names[3:], lambda w: {'name': w, 'kind': 'class'})
  else list_transform(names[2:], lambda w: {'name': w, 'kind': 'error'}) end) as n from modules)""", 58, 70)
def names_of_any_schema(x: Tables) -> DataFrame:
    """Names with their kinds: from the list of names, or in older records from the lists of each kind."""
    k, none = F.col("k") % 3, F.lit(None).cast("array<string>")
    old = x.modules.select(
        "module", F.when(k == 0, F.transform("names", lambda n: F.struct(n.alias("name"), F.lit("word").alias("kind")))).alias("names"), F.when(k == 1, F.slice("names", 1, 2)).otherwise(none).alias("functions"),
        F.when(k == 1, F.expr("slice(names, 3, size(names))")).otherwise(none).alias("classes"), F.when(k == 2, F.expr("slice(names, 2, size(names))")).otherwise(none).alias("errors"),
    )
    return facts.public_names(old)
