"""Queries: review states, suppression, verdicts, incremental facts, providers, scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..bindings import Tables
from ..functions import text as t
from ..operators import claims as cl
from ..operators import edges, findings, review
from ..scratch import cut
from ..streaming import live
from .registry import query

_LINES = """+ lines as (select distinct 'crossing import: ' || p || ' imports ' || q as line, 'crossing import' as kind, p, q, cast(null as varchar) as sdk, sha256(p || q) as evidence from open_crossing),
answers as (select 'item' as selector, line as value, case when length(q) % 2 = 0 then evidence else 'old' end as evidence, false as policy from lines where length(p) % 3 = 0 union all select 'item', 'gone: ' || p, evidence, false from lines where p = 'Large' union all select 'into', 'Economy', null, true union all select 'from', 'Promo', null, false)
"""


def _lines(x: Tables) -> tuple[DataFrame, DataFrame]:
    open_ = edges.without_flow(edges.crossing(x.uses, cl.owners(x.claims, x.modules)), x.flows).select("p", "q").distinct()
    lines = cut(open_.select(F.concat(F.lit("crossing import: "), "p", F.lit(" imports "), "q").alias("line"), F.lit("crossing import").alias("kind"), "p", "q", F.lit(None).cast("string").alias("sdk"), F.sha2(F.concat("p", "q"), 256).alias("evidence")))  # read once for each selector
    item = lambda value, ev: [F.lit("item").alias("selector"), value.alias("value"), ev.alias("evidence"), F.lit(False).alias("policy")]
    items = lines.where("length(p) % 3 = 0").select(*item(F.col("line"), F.when(F.length("q") % 2 == 0, F.col("evidence")).otherwise("old")))
    gone = lines.where("p = 'Large'").select(*item(F.concat(F.lit("gone: "), "p"), F.col("evidence")))
    families = x.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(s).alias("selector"), F.lit(v).alias("value"), F.lit(None).cast("string").alias("evidence"), F.lit(p).alias("policy")) for s, v, p in (("into", "Economy", True), ("from", "Promo", False))])))
    return lines, items.unionByName(gone).unionByName(families)


@query(_LINES + """select l.line, case when bool_or(ok) then 'answered' when bool_or(ok) is not null then 'pending' else 'open' end as state from lines l left join (
  select l.line, a.evidence = l.evidence as ok from lines l join answers a on a.selector = 'item' and a.value = l.line union all select l.line, policy from lines l join answers a on a.selector = 'into' and a.value = l.q union all select l.line, policy from lines l join answers a on a.selector = 'from' and a.value = l.p) h using (line) group by l.line""", 77, 78, 302, 303, 304, 342, 456)
def answered_lines(x: Tables) -> DataFrame:
    return review.apply_answers(*_lines(x))


@query(_LINES + "select value as line from answers where selector = 'item' and value not in (select line from lines)", 204)
def stale_answers(x: Tables) -> DataFrame:
    lines, answers = _lines(x)
    return review.stale_answers(answers, lines)


_DIGEST = """+ src as (select c.id, string_agg(m.module || '@' || m.sha, ',' order by m.module) as refs from claimed c join modules m using (module) group by c.id)
, dig as (select id, sha256(concat_ws(chr(31), id, refs)) as digest, length(id) as n from src)
"""


def _digests(x: Tables) -> DataFrame:
    held = x.matched.join(x.modules.select("module", "sha"), "module")
    refs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("module", "sha"))), lambda r: F.concat_ws("@", r["module"], r["sha"])), ",")
    return held.groupBy("id").agg(refs.alias("refs")).select("id", t.canonical_digest(F.col("id"), F.col("refs")).alias("digest"))


@query(_DIGEST + "select id, digest from dig", 195, 243, 244, 245, 246)
def claim_digests(x: Tables) -> DataFrame:
    return _digests(x)


_STATES = _DIGEST + ", st as (select id as key, case when n % 4 = 0 then 'missing' when n % 4 = 1 then 'stale' else 'current' end as state from dig)\n"


def _states(x: Tables) -> DataFrame:
    n = F.length("id")
    return review.review_state(_digests(x).select(F.col("id").alias("key"), "digest", F.when(n % 4 == 0, None).when(n % 4 == 1, "old").otherwise(F.col("digest")).alias("recorded")))


@query(_STATES + "select key, state from st", 305, 306, 360, 361)
def review_states(x: Tables) -> DataFrame:
    return _states(x)


@query(_STATES + "select state, count(*) as n from st group by state", 146, 160)
def review_counts(x: Tables) -> DataFrame:
    return _states(x).groupBy("state").agg(F.count("*").alias("n"))


@query(_STATES + "select kind as \"group\", case when bool_or(state = 'stale') then 'stale' when bool_or(state = 'missing') then 'missing' else 'current' end as freshness from st join components on id = key group by kind", 144)
def group_freshness(x: Tables) -> DataFrame:
    return findings.freshness(_states(x).join(x.components.select(F.col("id").alias("key"), F.col("kind").alias("group")), "key"), "group")


@query(_STATES + "select l.level, count(c.key) as n from (values ('established'), ('examined'), ('unknown')) l(level) left join (select key, case when state = 'current' then 'examined' else 'unknown' end as level from st) c using (level) group by l.level", 143, 368)
def claim_levels(x: Tables) -> DataFrame:
    claims = _states(x).select(F.when(F.col("state") == "current", "examined").otherwise("unknown").alias("level"))
    return findings.level_counts(claims, ["established", "examined", "unknown"])


_VERDICTS = "+ v as (select user_id as key, event_id as seq, case when event_type in ('view', 'error') then 'contradicted' when event_type = 'click' then 'insufficient' else 'supported' end as verdict from events)\n"


def _verdicts(x: Tables) -> DataFrame:
    e = F.col("event_type")
    return x.raw("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(e.isin("view", "error"), "contradicted").when(e == "click", "insufficient").otherwise("supported").alias("verdict"))


@query(_VERDICTS + """, r as (select *, sum(case when verdict = 'supported' then 1 else 0 end) over (partition by key order by seq rows unbounded preceding) as run from v),
c as (select *, count(*) filter (verdict = 'contradicted') over (partition by key, run order by seq rows unbounded preceding) as attempts, count(*) filter (verdict = 'insufficient') over (partition by key, run order by seq rows unbounded preceding) as weak from r)
select key, seq, verdict, attempts, weak, case when (verdict = 'contradicted' and attempts >= 3) or (verdict = 'insufficient' and weak >= 2) then 'unknown' else verdict end as state from c""", 308, 470)
def verdict_states(x: Tables) -> DataFrame:
    return review.verdict_states(_verdicts(x))


@query(_VERDICTS + "select key, arg_max(verdict, seq) as verdict, count(*) as results from v group by key", 161, 307)
def current_verdicts(x: Tables) -> DataFrame:
    return _verdicts(x).groupBy("key").agg(F.max_by("verdict", "seq").alias("verdict"), F.count("*").alias("results"))


@query(_VERDICTS + "select seq as id, false as accepted, case when seq % 5 = 0 then 'duplicate' when key % 3 = 0 then 'unknown request' else '' end as problem from v union all select seq, false, 'duplicate' from v where seq % 5 = 0", 286, 287, 309)
def submission(x: Tables) -> DataFrame:
    v = _verdicts(x)
    requests = v.where("key % 3 <> 0").select(F.col("seq").alias("id"))
    items = v.select(F.col("seq").alias("id"), "verdict")
    return review.submit(requests, items.unionByName(items.where("id % 5 = 0")))


# --- incremental -----------------------------------------------------------------


@query("""+ g as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as b from events), n as (select *, sum(case when b is null or epoch_us(ts) - epoch_us(b) >= 3600000000 * 6 then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as burst from g)
select user_id, count(*) as changes, min(ts) as first, max(ts) as last from n group by user_id, burst""", 290, 473)
def change_bursts(x: Tables) -> DataFrame:
    return live.debounce(x.raw("events").select("user_id", "ts"), 6 * 3600, "user_id")


@query("select user_id, arg_max(event_id, event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id", 294, 296)
def newest_versions(x: Tables) -> DataFrame:
    return live.newest(x.raw("events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("select file as path, sha as digest, case when (file, sha) in (select (file, sha) from base_modules) then 'kept' else 'computed' end as how from modules".replace("(select (file, sha) from", "(select file, sha from"), 298, 299, 300, 301)
def incremental_facts(x: Tables) -> DataFrame:
    files = x.modules.select(F.col("file").alias("path"), F.col("sha").alias("digest"))
    known = x.base_modules.select(F.col("file").alias("path"), F.col("sha").alias("digest"), F.lit("kept").alias("how"))
    return live.refresh(files, known, lambda rows: rows.select("path", "digest", F.lit("computed").alias("how")))


# --- entry points, tests, sources --------------------------------------------------


@query("select ord, kind, module, name, first_value(name) over (partition by module, target order by case kind when 'signup' then 0 else 1 end, ord) as canonical, min(ord) over (partition by module, target) as first_ord from entry_points", 22, 59)
def same_operations(x: Tables) -> DataFrame:
    by = Window.partitionBy("module", "target")
    first = F.first("name").over(by.orderBy(F.when(F.col("kind") == "signup", 0).otherwise(1), "ord"))
    return x.entry_points.select("ord", "kind", "module", "name", first.alias("canonical"), F.min("ord").over(by).alias("first_ord"))


@query("select distinct kind, module, target, case when kind in ('signup', 'purchase') then module || ':' || target else module end as symbol from entry_points", 17, 21)
def started_symbols(x: Tables) -> DataFrame:
    symbol = F.when(F.col("kind").isin("signup", "purchase"), F.concat_ws(":", "module", "target")).otherwise(F.col("module"))
    return x.entry_points.select("kind", "module", "target", symbol.alias("symbol")).distinct()


@query("""+ tst as (select user_id % 7 as file, 'test_' || event_type as name, module, (user_id % 7) = (ord % 7) as prim from entry_points), f as (select module, name, bool_or(prim) as prim from tst group by 1, 2)
select module, count(*) as total, count(*) filter (prim) as prim, sha256(string_agg(name, ',' order by name)) as digest from (select module, name, prim from f) group by module""".replace("event_type", "kind"), 23, 140)
def test_facts(x: Tables) -> DataFrame:
    tests = x.entry_points.select("module", F.concat(F.lit("test_"), "kind").alias("name"), ((F.col("user_id") % 7) == (F.col("ord") % 7)).alias("prim")).groupBy("module", "name").agg(F.bool_or("prim").alias("prim"))
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("name")), ","), 256)
    return tests.groupBy("module").agg(F.count("*").alias("total"), F.count_if("prim").alias("prim"), digest.alias("digest"))


@query("select distinct module, target from uses where target not in (select module from base_modules)", 12, 25)
def unresolved_imports(x: Tables) -> DataFrame:
    return x.uses.select("module", "target").distinct().join(x.base_modules.select(F.col("module").alias("target")), "target", "left_anti")


@query("""select l_partkey as target, l_suppkey as name, min(l_linenumber) as line, string_agg(distinct cast(l_orderkey as varchar), ',' order by cast(l_orderkey as varchar)) as uses from lineitem group by 1, 2""", 15, 16)
def call_records(x: Tables) -> DataFrame:
    uses = F.array_join(F.array_sort(F.collect_set(F.col("l_orderkey").cast("string"))), ",")
    return x.raw("lineitem").groupBy(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("name")).agg(F.min("l_linenumber").alias("line"), uses.alias("uses"))


@query("""+ cfg as (select distinct package as dir from modules where package like '%1' union select distinct split_part(package, '.', 1) from modules)
select m.module, arg_max(c.dir, length(c.dir)) as config from modules m join cfg c on m.package = c.dir or starts_with(m.package, c.dir || '.') group by m.module""", 28, 29, 32)
def nearest_configs(x: Tables) -> DataFrame:
    """The closest configured folder above each module, by equality on exploded ancestors."""
    dirs = x.modules.where("package like '%1'").select(F.col("package").alias("dir")).union(x.modules.select(F.substring_index("package", ".", 1))).distinct()
    above = x.modules.select("module", F.explode(cl.ancestors(F.col("package"))).alias("dir"))
    return above.join(dirs, "dir").groupBy("module").agg(F.max_by("dir", F.length("dir")).alias("config"))


@query("select * from (select 'base' as snapshot_id, module, sha from base_modules union all select 'head', module, sha from modules) where snapshot_id = 'base'", 36, 37, 42, 43, 44, 47)
def facts_at_snapshot(x: Tables) -> DataFrame:
    both = x.base_modules.select(F.lit("base").alias("snapshot_id"), "module", "sha").unionByName(x.modules.select(F.lit("head").alias("snapshot_id"), "module", "sha"))
    return both.where("snapshot_id = 'base'")


@query("select m.map_id, count(k.k) as own, exists (select 1 from maps d join modules z on z.k % 31 = length(d.map_id) where starts_with(d.map_id, m.map_id || '/')) as below from maps m left join modules k on k.k % 31 = length(m.map_id) group by m.map_id", 162, 163)
def change_rollups(x: Tables) -> DataFrame:
    changed = x.modules.select((F.col("k") % 31).alias("n")).groupBy("n").agg(F.count("*").alias("own"))
    maps = x.maps.select("map_id", F.char_length("map_id").cast("long").alias("n")).join(F.broadcast(changed), "n", "left")  # 31 rows
    parts = F.split("map_id", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    below = maps.where("own > 0").select(F.explode(above).alias("map_id")).distinct().withColumn("below", F.lit(True))
    return maps.join(below, "map_id", "left").select("map_id", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("below", F.lit(False)).alias("below"))


# --- providers ---------------------------------------------------------------------


@query("select id, case when p < 0.35 then 'decision sentence' when p >= 0.9 then 'decision governs' else '' end as kind from scores where p < 0.35 or p >= 0.9", 339, 341)
def provider_findings(x: Tables) -> DataFrame:
    kind = F.when(F.col("p") < 0.35, "decision sentence").when(F.col("p") >= 0.9, "decision governs")
    return x.scores.select("id", kind.alias("kind")).where("kind is not null")


@query("select source, arg_max(id, (p, -id)) as best, max(p) as p from scores group by source", 76, 344)
def top_options(x: Tables) -> DataFrame:
    return x.scores.groupBy("source").agg(F.max_by("id", F.struct("p", -F.col("id"))).alias("best"), F.max("p").alias("p"))


@query("select id, source, label, row_number() over (partition by source, label order by id) - 1 as batch from scores", 327)
def question_batches(x: Tables) -> DataFrame:
    return x.scores.select("id", "source", "label", (F.row_number().over(Window.partitionBy("source", "label").orderBy("id")) - 1).cast("long").alias("batch"))


@query("select module, (select string_agg(id, ',' order by id) from components where kind <> 'actor') as options from modules where module not in (select module from owner)", 333)
def question_options(x: Tables) -> DataFrame:
    """Each module without an owner as a question, with the cards that may own one as its options."""
    cards = x.components.where("kind <> 'actor'").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("options"))  # one row: the cards of a model
    return x.modules.select("module").join(cl.owners(x.claims, x.modules), "module", "left_anti").crossJoin(F.broadcast(cards))


@query("select id, p from scores order by p nulls last, id limit 25", 172, 346, 384)
def drift_order(x: Tables) -> DataFrame:
    return x.scores.select("id", "p").orderBy(F.asc_nulls_last("p"), "id").limit(25)


# --- scalars -----------------------------------------------------------------------


@query("select doc_id, trim(substr(regexp_replace(text, '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g'), 1, 80)) as flat from (select doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g')) as text from documents)".replace("trim(substr(regexp_replace(text, '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g'), 1, 80))", "substr(text, 1, 80)"), 236, 250)
def flat_texts(x: Tables) -> DataFrame:
    return x.raw("documents").select("doc_id", t.flat(F.col("text"), 80).alias("flat"))


@query("select doc_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) as digest from documents", 231, 265)
def text_digests(x: Tables) -> DataFrame:
    return x.raw("documents").select("doc_id", t.text_digest(F.col("text")).alias("digest"))


@query("select doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_-])(the)($|[^a-z0-9_-])') as mentioned, regexp_matches(lower(text), '^\\s*(copyright|\\(c\\)|licen[sc]ed? |all rights reserved|spdx-)') as notice from documents", 227, 237)
def mentions(x: Tables) -> DataFrame:
    return x.raw("documents").select("doc_id", t.mentioned(F.lit("the"), F.col("text")).alias("mentioned"), t.is_notice(F.col("text")).alias("notice"))


@query("select k, module || ':' || names[1] || '@' || substr(sha, 1, 12) as ref, module as ref_module, module || '->' || package as edge from modules", 104, 239, 240)
def references(x: Tables) -> DataFrame:
    ref = F.concat("module", F.lit(":"), F.get("names", F.lit(0)), F.lit("@"), F.substring("sha", 1, 12))
    return x.modules.select("k", ref.alias("ref"), t.ref_module(ref).alias("ref_module"), t.edge_key(F.col("module"), F.col("package")).alias("edge"))


@query("select k, upper(names[1][1]) || substr(names[1], 2) || upper(names[2][1]) || substr(names[2], 2) as camel from modules", 229)
def camel_names(x: Tables) -> DataFrame:
    return x.modules.select("k", t.camel(F.concat(F.lit("root."), F.array_join("names", "_"))).alias("camel"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, abs(date_diff('day', cast(ts as date), date '2024-01-15')) as days from events", 254, 35)
def json_props(x: Tables) -> DataFrame:
    return x.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), t.days_between(F.to_date("ts"), F.lit("2024-01-15").cast("date")).cast("long").alias("days"))


# --- constraints -------------------------------------------------------------------


@query("""select 'duplicate pair' as problem, src || '->' || dst as subject from (select least(src, dst) as src, greatest(src, dst) as dst from flows group by 1, 2 having count(*) > 1)
union all select 'unknown kind', id from components where kind not in ('component', 'store', 'actor', 'agent', 'tool')
union all select 'no flow', id from components where id not in (select src from flows union select dst from flows)""")
def model_problems(x: Tables) -> DataFrame:
    twice = x.flows.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).count().where("count > 1").select(F.lit("duplicate pair").alias("problem"), F.concat("a", F.lit("->"), "b").alias("subject"))
    kinds = x.components.where(~F.col("kind").isin("component", "store", "actor", "agent", "tool")).select(F.lit("unknown kind").alias("problem"), F.col("id").alias("subject"))
    ends = x.flows.select(F.col("src").alias("id")).union(x.flows.select("dst")).distinct()
    alone = x.components.select("id").join(ends, "id", "left_anti").select(F.lit("no flow").alias("problem"), F.col("id").alias("subject"))
    return twice.unionByName(kinds).unionByName(alone)


@query("""select k, case when docstring = '' then '$.docstring: empty' when not parsed then '$.parsed: false' when unresolved is null then '$.unresolved: null' when len([n for n in names if n = 'red']) > 0 then '$.names: reserved' end as problem from modules where docstring = '' or not parsed or unresolved is null or len([n for n in names if n = 'red']) > 0""")
def record_problems(x: Tables) -> DataFrame:
    """The first problem of each record, by path."""
    found = F.when(F.col("docstring") == "", "$.docstring: empty").when(~F.col("parsed"), "$.parsed: false").when(F.col("unresolved").isNull(), "$.unresolved: null").when(F.exists("names", lambda n: n == "red"), "$.names: reserved")
    return x.modules.select("k", found.alias("problem")).where("problem is not null")


@query("select c.id, c.kind, len(list(distinct m.module)) as modules, string_agg(distinct m.package, ',' order by m.package) as packages from components c join claimed m using (id) group by c.id, c.kind", 380, 381, 382, 383, 404)
def component_documents(x: Tables) -> DataFrame:
    held = x.matched.join(x.modules.select("module", "package"), "module")
    return x.components.select("id", "kind").join(held, "id").groupBy("id", "kind").agg(F.countDistinct("module").alias("modules"), F.array_join(F.array_sort(F.collect_set("package")), ",").alias("packages"))
