"""Queries: scopes, references, sequences, rules, upserts and the remaining scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..bindings import Tables
from ..functions import text as t
from ..operators import claims as cl
from ..operators import diff, edges
from .core import crossing_imports, flow_states, flows_without_sentence
from .registry import query

# --- scopes ----------------------------------------------------------------------


@query("select u.module, u.target from uses u where u.module in (select module from owner where owner = 'Large') and u.target in (select module from owner where owner = 'Large')", 74, 80, 81, 82, 236)
def uses_in_scope(x: Tables) -> DataFrame:
    """The edges inside one component."""
    inside = cl.owners(x.claims, x.modules).where("owner = 'Large'").select("module")
    return x.uses.select("module", "target").join(inside, "module", "left_semi").join(inside.select(F.col("module").alias("target")), "target", "left_semi")


@query("select distinct c.p as card, m.package as other from crossing c join modules m on m.module = c.target where not exists (select 1 from flows f where f.src = c.p or f.dst = c.p)", 96)
def imports_without_any_flow(x: Tables) -> DataFrame:
    crossings = edges.crossing(x.uses, cl.owners(x.claims, x.modules))
    ends = x.flows.select(F.explode(F.array("src", "dst")).alias("p")).distinct()
    return crossings.join(ends, "p", "left_anti").join(x.modules.select(F.col("module").alias("target"), F.col("package").alias("other")), "target").select(F.col("p").alias("card"), "other").distinct()


@query("""+ o2 as (select module, owner from owner join modules using (module) where k % 10 <> 3), c2 as (select distinct a.owner as p, b.owner as q from base_uses u join o2 a on a.module = u.module join o2 b on b.module = u.target where a.owner <> b.owner)
select 'base' as snapshot_id, p, q from c2 where not exists (select 1 from flows f where (f.src = c2.p and f.dst = c2.q) or (f.src = c2.q and f.dst = c2.p)) union all select distinct 'head', p, q from open_crossing""", 100, 371)
def crossings_by_snapshot(x: Tables) -> DataFrame:
    own = cl.owners(x.claims, x.modules)
    then = own.join(x.modules.where("k % 10 <> 3").select("module"), "module", "left_semi")
    one = lambda name, u, o: edges.without_flow(edges.crossing(u, o), x.flows).select(F.lit(name).alias("snapshot_id"), "p", "q").distinct()
    return one("base", x.base_uses, then).unionByName(one("head", x.uses, own))


# --- references ----------------------------------------------------------------------


@query("""+ refs as (select k, case when k % 6 = 0 then 'gone.' || module else module end || case when k % 2 = 0 then ':' || names[1] when k % 9 = 1 then ':nothing' else '' end || '@' || case when k % 5 = 0 then 'old' else substr(sha, 1, 12) end as ref from modules where k % 4 <> 3)
select k, case when k % 6 = 0 or k % 5 = 0 or (k % 2 <> 0 and k % 9 = 1) then 'unresolved' else 'resolved' end as state from refs""", 103, 104, 292, 365)
def reference_states(x: Tables) -> DataFrame:
    """A reference resolves if the module has the digest and, if one is given, the symbol."""
    k = F.col("k")
    symbol = F.when(k % 2 == 0, F.concat(F.lit(":"), F.get("names", F.lit(0)))).when(k % 9 == 1, ":nothing").otherwise("")
    ref = F.concat(F.when(k % 6 == 0, F.concat(F.lit("gone."), "module")).otherwise(F.col("module")), symbol, F.lit("@"), F.when(k % 5 == 0, "old").otherwise(F.substring("sha", 1, 12)))
    refs = x.modules.where("k % 4 <> 3").select("k", ref.alias("ref"))
    head = F.substring_index("ref", "@", 1)
    refs = refs.select("k", t.ref_module(F.col("ref")).alias("module"), F.get(F.split(head, ":"), F.lit(1)).alias("symbol"), F.substring_index("ref", "@", -1).alias("digest"))
    known = x.modules.select("module", F.substring("sha", 1, 12).alias("digest"), "names", F.lit(True).alias("found"))
    joined = refs.join(known, ["module", "digest"], "left")
    ok = F.col("found") & (F.col("symbol").isNull() | F.array_contains("names", F.col("symbol")))
    return joined.select("k", F.when(F.coalesce(ok, F.lit(False)), "resolved").otherwise("unresolved").alias("state"))


@query("""+ want as (select id, 'word' || (pos % 7) as entry, case when pos % 3 = 0 then 'red' when pos % 3 = 1 then 'hot' else 'nothing' end as head from components)
select w.id, w.head from want w where not exists (select 1 from claimed c join modules m using (module) where c.id = w.id and list_contains(m.names, w.head))""", 112, 113, 262)
def entries_without_name(x: Tables) -> DataFrame:
    """Cards whose declared entry is no public name of their modules."""
    head = F.when(F.col("pos") % 3 == 0, "red(x)").when(F.col("pos") % 3 == 1, "hot").otherwise("nothing")
    want = x.components.select("id", t.identifier_at(head).alias("head"))
    names = cl.matches(x.claims, x.modules).select("id", "module").join(x.modules.select("module", F.explode("names").alias("head")), "module").select("id", "head")
    return want.join(names, ["id", "head"], "left_anti")


@query("""+ parent as (select distinct module from claimed where id = 'Large'), child as (select module, count(*) as n from (select module from modules where package like 'large%' and k % 3 <> 0 union all select module from modules where k % 97 = 0 union all select module from modules where package like 'large%' and k % 11 = 0) group by module)
select coalesce(p.module, c.module) as module, case when c.module is null then 'missing' when p.module is null then 'extra' when n > 1 then 'duplicate' end as problem from parent p full join child c on p.module = c.module where c.module is null or p.module is null or n > 1""", 111, 286)
def nesting_problems(x: Tables) -> DataFrame:
    """Claims of a nested map against its parent card: missing, extra, duplicate."""
    parent = cl.matches(x.claims.where("id = 'Large'"), x.modules).select("module").distinct().withColumn("p", F.lit(True))
    m = x.modules
    child = m.where("package like 'large%' and k % 3 <> 0").select("module").union(m.where("k % 97 = 0").select("module")).union(m.where("package like 'large%' and k % 11 = 0").select("module"))
    joined = parent.join(child.groupBy("module").agg(F.count("*").alias("n")), "module", "full_outer")
    return joined.select("module", F.when(F.col("n").isNull(), "missing").when(F.col("p").isNull(), "extra").when(F.col("n") > 1, "duplicate").alias("problem")).where("problem is not null")


# --- sequences and rules -------------------------------------------------------------

_STEPS = "+ steps as (select conv_id as journey, turn as pos, src, dst from conversations join (select src, dst, row_number() over (order by pos) - 1 as n, count(*) over () as c from flows) f on (conv_id * 7 + turn) % f.c = f.n)\n"


def _steps(x: Tables) -> DataFrame:
    numbered = x.flows.select("src", "dst", (F.row_number().over(Window.orderBy("pos")) - 1).alias("n"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("c"))  # the flows of one model
    size = numbered.select("c").limit(1)
    conv = x.raw("conversations").crossJoin(F.broadcast(size)).select(F.col("conv_id").alias("journey"), F.col("turn").alias("pos"), ((F.col("conv_id") * 7 + F.col("turn")) % F.col("c")).alias("n"))
    return conv.join(F.broadcast(numbered.drop("c")), "n").select("journey", "pos", "src", "dst")


@query(_STEPS + "select src, dst, string_agg(journey || '.' || pos, ',' order by journey, pos) as steps from steps group by src, dst", 201, 381)
def steps_by_flow(x: Tables) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("journey", "pos"))), lambda s: F.concat_ws(".", s["journey"], s["pos"]))
    return _steps(x).groupBy("src", "dst").agg(F.array_join(listed, ",").alias("steps"))


@query(_STEPS + "select journey, string_agg(cast(pos as varchar), ',' order by pos) as steps from steps where src = 'Economy' or dst = 'Economy' group by journey", 200, 348)
def journeys_through(x: Tables) -> DataFrame:
    on = _steps(x).where("src = 'Economy' or dst = 'Economy'")
    return on.groupBy("journey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda p: p.cast("string")), ",").alias("steps"))


@query(_STEPS + "select s.journey, s.pos, case when n = 1 then s.src || '->' || s.dst else '' end as flow, case when n is null then 'no flow' when n > 1 then 'several' else '' end as problem from steps s left join (select least(src, dst) as a, greatest(src, dst) as b, count(*) as n from flows group by 1, 2) f on f.a = least(s.src, s.dst) and f.b = greatest(s.src, s.dst)", 132, 180)
def step_flows(x: Tables) -> DataFrame:
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    n = x.flows.groupBy(*pair).agg(F.count("*").alias("n"))
    joined = _steps(x).select("*", *pair).join(n, ["a", "b"], "left")
    problem = F.when(F.col("n").isNull(), "no flow").when(F.col("n") > 1, "several").otherwise("")
    return joined.select("journey", "pos", F.when(F.col("n") == 1, t.edge_key(F.col("src"), F.col("dst"))).otherwise("").alias("flow"), problem.alias("problem"))


_INV = "+ inv as (select pos % 9 as n, list(distinct id order by id) as governs, pos % 9 % 4 = 0 as bare from components group by pos % 9)\n"


def _invariants(x: Tables) -> DataFrame:
    n = F.col("pos") % 9
    return x.components.groupBy(n.alias("n")).agg(F.array_sort(F.collect_set("id")).alias("governs")).withColumn("bare", F.col("n") % 4 == 0)


@query(_INV + "select unnest(governs) as id, n from inv", 202)
def rules_on_components(x: Tables) -> DataFrame:
    return _invariants(x).select(F.explode("governs").alias("id"), "n")


@query(_INV + "select n, array_to_string([g for g in governs if g in ('Economy', 'Large', 'Promo', 'Pinned')], ',') as cards from inv where len([g for g in governs if g in ('Economy', 'Large', 'Promo', 'Pinned')]) > 0", 199)
def rules_over_cards(x: Tables) -> DataFrame:
    chosen = F.array_intersect("governs", F.array(*[F.lit(c) for c in ("Economy", "Large", "Promo", "Pinned")]))
    return _invariants(x).select("n", F.array_join(chosen, ",").alias("cards")).where("cards <> ''")


@query(_INV + "select n from inv where bare", 85, 362)
def rules_without_reason(x: Tables) -> DataFrame:
    return _invariants(x).withColumn("reason", F.when(F.col("bare"), "  ").otherwise("because")).where(F.trim("reason") == "").select("n")


# --- unions and rollups ----------------------------------------------------------------


@query("""select 'crossing import' as kind, p || ' imports ' || q as line from (select distinct p, q from open_crossing)
union all select 'no sentence', key from flows where trim(relation) = '' union all select 'declared flow', key from (select key from flows where pos % 7 <> 0 and src not in (select id from components where kind = 'actor') and dst not in (select id from components where kind = 'actor')
  and not exists (select 1 from crossing c where least(c.p, c.q) = least(src, dst) and greatest(c.p, c.q) = greatest(src, dst)) and not regexp_matches(lower(relation), '(^|[^a-z0-9_-])largebrand1($|[^a-z0-9_-])'))""")
def finding_lines(x: Tables) -> DataFrame:
    """Three generators of one map; ``all_finding_lines`` has every one."""
    crossing = crossing_imports(x).select(F.lit("crossing import").alias("kind"), F.concat("p", F.lit(" imports "), "q").alias("line"))
    silent = flows_without_sentence(x).select(F.lit("no sentence").alias("kind"), F.col("key").alias("line"))
    declared = flow_states(x).where("state = 'declared'").select(F.lit("declared flow").alias("kind"), F.col("key").alias("line"))
    return crossing.unionByName(silent).unionByName(declared)


@query("""select p as card, count(distinct q) as others, count(*) as imports, string_agg(distinct q, ',' order by q) as names from open_crossing group by p""", 157, 379, 383)
def crossing_rollup(x: Tables) -> DataFrame:
    open_ = edges.without_flow(edges.crossing(x.uses, cl.owners(x.claims, x.modules)), x.flows)
    return open_.groupBy(F.col("p").alias("card")).agg(F.countDistinct("q").alias("others"), F.count("*").alias("imports"), F.array_join(F.array_sort(F.collect_set("q")), ",").alias("names"))


@query("select case when unresolved is null then 'not known' when not parsed then 'not parsed' else 'missing' end as cause, count(*) as n, cast(sum(loc) as bigint) as lines from modules where unresolved is null or not parsed or len(unresolved) > 0 group by 1", 149, 264, 363, 364)
def unknown_counts(x: Tables) -> DataFrame:
    cause = F.when(F.col("unresolved").isNull(), "not known").when(~F.col("parsed"), "not parsed").otherwise("missing")
    return x.modules.where("unresolved is null or not parsed or size(unresolved) > 0").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"), F.sum("loc").alias("lines"))


@query("select package, name, string_agg(substr(sha, 1, 8), '\n' order by module) as prints from (select package, module, sha, names[1] as name from modules) group by package, name", 158, 258)
def surface_fingerprints(x: Tables) -> DataFrame:
    prints = F.transform(F.array_sort(F.collect_list(F.struct("module", "sha"))), lambda s: F.substring(s["sha"], 1, 8))
    return x.modules.groupBy("package", F.get("names", F.lit(0)).alias("name")).agg(F.array_join(prints, "\n").alias("prints"))


@query("select event_type, count(*) as sent, count(*) filter (user_id % 3 = 0) as cached, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as tokens from events group by event_type", 164, 324, 329)
def usage_totals(x: Tables) -> DataFrame:
    return x.raw("events").groupBy("event_type").agg(F.count("*").alias("sent"), F.count_if(F.col("user_id") % 3 == 0).alias("cached"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"))


@query("select 'base' as side, file from base_modules where loc > 45 union all select 'head', file from modules where loc > 45", 8, 165, 189)
def refused_files(x: Tables) -> DataFrame:
    one = lambda side, m: m.where("loc > 45").select(F.lit(side).alias("side"), "file")
    return one("base", x.base_modules).unionByName(one("head", x.modules))


@query("select coalesce(a.module, b.module) as module, coalesce(b.tests_total, a.tests_total) as tests, case when a.module is null then 'inserted' when b.module is null then 'kept' when a.tests_total <> b.tests_total then 'updated' else 'same' end as how from base_modules a full join modules b using (module)", 310, 311, 312, 313, 407)
def upserted(x: Tables) -> DataFrame:
    """The base table after the head's rows are merged into it."""
    a, b = x.base_modules.select("module", F.col("tests_total").alias("a")), x.modules.select("module", F.col("tests_total").alias("b"))
    how = F.when(F.col("a").isNull(), "inserted").when(F.col("b").isNull(), "kept").when(F.col("a") != F.col("b"), "updated").otherwise("same")
    return a.join(b, "module", "full_outer").select("module", F.coalesce("b", "a").alias("tests"), how.alias("how"))


@query("select module from modules where k % 2 = 0 union select module from modules where k % 3 = 0", 133, 289)
def distinct_roots(x: Tables) -> DataFrame:
    m = x.modules
    return m.where("k % 2 = 0").select("module").unionByName(m.where("k % 3 = 0").select("module")).dropDuplicates(["module"])


@query("select lang, n, rank() over (order by n desc) as place, count(*) over (partition by n) > 1 as tie from (select lang, count(*) as n from documents group by lang)", 317)
def detected_languages(x: Tables) -> DataFrame:
    n = x.raw("documents").groupBy("lang").agg(F.count("*").alias("n"))  # one row a language
    return n.select("lang", "n", F.rank().over(Window.orderBy(F.desc("n"))).cast("long").alias("place"), (F.count("*").over(Window.partitionBy("n")) > 1).alias("tie"))


@query("""+ g as (select k, unnest(list_distinct(names)) as w from modules), c as (select id, unnest(list_distinct(string_split(lower(does), ' '))) as w from components), h as (select k, id, count(*) as n from g join c using (w) group by 1, 2)
select k, arg_max(id, (n, id)) as guess from h group by k""", 420)
def word_guesses(x: Tables) -> DataFrame:
    """The component whose words overlap most with a module's; ties to the last name."""
    w = x.modules.select("k", F.explode(F.array_distinct("names")).alias("w"))
    c = x.components.select("id", F.explode(F.array_distinct(F.split(F.lower("does"), " "))).alias("w"))
    return w.join(c, "w").groupBy("k", "id").agg(F.count("*").alias("n")).groupBy("k").agg(F.max_by("id", F.struct("n", "id")).alias("guess"))


@query("""+ pr as (select o_orderkey as pr, list(distinct l_partkey) as files from orders join lineitem on l_orderkey = o_orderkey group by 1), near as (select o_orderkey as pr, list(distinct l_partkey) as guess from orders join lineitem on l_orderkey = o_orderkey where l_linenumber < 4 group by 1)
select pr, len(files) as size, round(coalesce(len(list_intersect(files, guess)), 0) / len(files), 6) as recall from pr left join near using (pr)""", 433)
def change_recall(x: Tables) -> DataFrame:
    lines = x.raw("lineitem").join(x.raw("orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    per = lines.groupBy(F.col("l_orderkey").alias("pr")).agg(F.collect_set("l_partkey").alias("files"), F.collect_set(F.when(F.col("l_linenumber") < 4, F.col("l_partkey"))).alias("guess"))
    return per.select("pr", F.size("files").cast("long").alias("size"), F.round(F.size(F.array_intersect("files", "guess")) / F.size("files"), 6).alias("recall"))


# --- scalars -----------------------------------------------------------------------------


@query("select page_id, regexp_replace(url, '^https?://', '') as bare, 'https://' || regexp_extract(url, '://([^/?#]+)', 1) || '/pull/' || page_id as link from pages", 226, 263)
def page_links(x: Tables) -> DataFrame:
    host = F.regexp_extract("url", r"://([^/?#]+)", 1)
    return x.raw("pages").select("page_id", F.regexp_replace("url", r"^https?://", "").alias("bare"), F.concat(F.lit("https://"), host, F.lit("/pull/"), "page_id").alias("link"))


@query("select k, case when k % 3 = 0 then 'own' when k % 5 = 0 then 'kind' else 'standard' end as label, coalesce(nullif(package, ''), module) as package from modules", 233, 234, 242)
def resolved_labels(x: Tables) -> DataFrame:
    """An override by id, then one by kind, then the standard."""
    k = F.col("k")
    own, kind = F.when(k % 3 == 0, "own"), F.when(k % 5 == 0, "kind")
    return x.modules.select("k", F.coalesce(own, kind, F.lit("standard")).alias("label"), F.coalesce(F.nullif("package", F.lit("")), "module").alias("package"))


@query("select event_id, strftime(ts, '%Y%m%d') || '-' || substr(sha256(event_type || ' number ' || event_id), 1, 8) || '-' || event_type || '-number-' || event_id as id from events", 230, 255)
def plan_ids(x: Tables) -> DataFrame:
    task = F.concat("event_type", F.lit(" number "), "event_id")
    return x.raw("events").select("event_id", t.plan_id(F.to_date("ts"), task).alias("id"))


@query("select doc_id, replace(replace(text, chr(10), '\\x0a'), chr(9), '\\x09') as shown, regexp_matches(text, '[\\x00-\\x1f\\x7f]') as control from documents", 248, 249)
def shown_texts(x: Tables) -> DataFrame:
    return x.raw("documents").select("doc_id", t.printable(F.col("text")).alias("shown"), t.has_control(F.col("text")).alias("control"))


@query("select conv_id, turn, 'Says ' || role as line, case role when 'user' then 'asks' when 'assistant' then 'answers' else 'other' end as kind from conversations", 256, 257)
def rewritten_lines(x: Tables) -> DataFrame:
    """Earlier line forms are rewritten by the first form that matches; the kind comes from a prefix table."""
    old = F.concat(F.lit("talk: "), "role")
    line = F.coalesce(F.when(old.startswith("talk: "), F.regexp_replace(old, "^talk: ", "Says ")), old)
    kinds = x.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("role"), F.lit(b).alias("kind")) for a, b in (("user", "asks"), ("assistant", "answers"))])))
    return x.raw("conversations").select("conv_id", "turn", "role", line.alias("line")).join(F.broadcast(kinds), "role", "left").select("conv_id", "turn", "line", F.coalesce("kind", F.lit("other")).alias("kind"))


@query("select package, replace(package, '.', '/') as parent, count(*) as n from modules group by package", 266)
def common_parents(x: Tables) -> DataFrame:
    # What the first and the last file in order share, all between them share.
    ends = F.array_compact(F.array(F.min("file"), F.max("file")))
    return x.modules.groupBy("package").agg(t.common_parent(ends).alias("parent"), F.count("*").alias("n"))


@query("""+ d as (select coalesce(a.module, b.module) as module, case when a.module is null then 'added' when b.module is null then 'gone' when a.sha <> b.sha then 'changed' end as change from base_modules a full join modules b using (module))
select coalesce(owner, '(none)') as owner, count(*) filter (change = 'added') as added, count(*) filter (change = 'gone') as gone, count(*) filter (change = 'changed') as changed from d left join owner using (module) where change is not null group by 1""", 373, 374, 375, 457)
def delta_by_component(x: Tables) -> DataFrame:
    change = diff.drift(x.base_modules, x.modules, "module", "sha", []).join(cl.owners(x.claims, x.modules), "module", "left")
    n = lambda c: F.count_if(F.col("change") == c).alias(c)
    return change.groupBy(F.coalesce("owner", F.lit("(none)")).alias("owner")).agg(n("added"), n("gone"), n("changed"))
