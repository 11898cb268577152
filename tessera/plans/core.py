"""Queries: projections, ownership, edges, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bindings import Tables
from ..functions import text as t
from ..operators import claims as cl
from ..operators import diff, edges, findings, graph
from .registry import query

# --- projections and predicates ------------------------------------------------


@query("select module, loc, len(names) as n_names, tests_total, case when docstring = '' then '' else regexp_extract(replace(docstring, '  ', ' '), '^[^.]*\\.') end as opening from modules", 54, 228, 450)
def facts_modules(x: Tables) -> DataFrame:
    return x.modules.select("module", "loc", F.size("names").cast("long").alias("n_names"), "tests_total", t.first_sentence(F.col("docstring")).alias("opening"))


@query("select count(*) filter (docstring <> '') as described, count(*) as modules, cast(sum(len(names)) as bigint) as names, cast(sum(tests_total) as bigint) as tests from modules", 55, 142, 307)
def facts_summary(x: Tables) -> DataFrame:
    return x.modules.agg(F.count_if(F.col("docstring") != "").alias("described"), F.count("*").alias("modules"), F.sum(F.size("names").cast("long")).alias("names"), F.sum("tests_total").alias("tests"))


@query("select module, loc from modules where k = 7 union all select module, loc from (select module, loc from modules order by levenshtein(module, 'economy.brand1.absent'), module limit 1)", 56)
def facts_module_lookup(x: Tables) -> DataFrame:
    near = x.modules.orderBy(F.levenshtein("module", F.lit("economy.brand1.absent")), "module").limit(1)
    return x.modules.where("k = 7").select("module", "loc").unionByName(near.select("module", "loc"))


@query("select module, unnest(names) as name, 'word' as kind from modules", 57)
def facts_names(x: Tables) -> DataFrame:
    return x.modules.select("module", F.explode("names").alias("name"), F.lit("word").alias("kind"))


@query("select name as import, string_agg(module, ',' order by module) as modules from (select distinct module, names[2] as name from modules where names[2] in ('gear', 'bolt')) group by name", 13)
def facts_external(x: Tables) -> DataFrame:
    own = x.modules.select("module", F.get("names", F.lit(1)).alias("import")).where(F.col("import").isin("gear", "bolt")).distinct()
    return own.groupBy("import").agg(F.array_join(F.array_sort(F.collect_list("module")), ",").alias("modules"))


@query("select module, target as other, 'imports' as how from uses where module in (select module from modules where k < 5) union all select target, module, 'imported by' from uses where target in (select module from modules where k < 5)", 61)
def facts_imports(x: Tables) -> DataFrame:
    few = x.modules.where("k < 5").select("module")
    out = x.uses.join(few, "module", "left_semi").select("module", F.col("target").alias("other"), F.lit("imports").alias("how"))
    back = x.uses.select(F.col("target").alias("module"), F.col("module").alias("other")).join(few, "module", "left_semi")
    return out.unionByName(back.withColumn("how", F.lit("imported by")))


@query("select target as module, string_agg(distinct module, ',' order by module) as importers from uses group by target", 141, 306)
def facts_importers(x: Tables) -> DataFrame:
    return edges.importers(x.uses)


@query("select module from modules where empty_marker", 71, 72)
def facts_empty_markers(x: Tables) -> DataFrame:
    return x.modules.where("empty_marker").select("module")


@query("select module, parsed and unresolved is not null and len(unresolved) = 0 as complete, unresolved is null as not_known from modules", 66, 116, 364)
def facts_completeness(x: Tables) -> DataFrame:
    known = F.col("unresolved").isNotNull()
    return x.modules.select("module", (F.col("parsed") & known & (F.coalesce(F.size("unresolved"), F.lit(0)) <= 0)).alias("complete"), (~known).alias("not_known"))


@query("select module, k % 3 = 0 as guard, split_part(module, '.', 2) in ('brand1', 'brand2') as planed, case when split_part(module, '.', 2) in ('brand1', 'brand2') then split_part(module, '.', 2) else 'core' end as plane from modules", 73, 252)
def facts_planes(x: Tables) -> DataFrame:
    plane = t.plane_of(F.col("module"), ["brand1", "brand2"])
    return x.modules.select("module", (F.col("k") % 3 == 0).alias("guard"), (plane != "core").alias("planed"), plane.alias("plane"))


@query("select file, replace(regexp_replace(file, '\\.py$', ''), '/', '.') as module, file like '%/red%.py' as red from modules", 9, 83, 84, 159, 235)
def path_modules(x: Tables) -> DataFrame:
    return x.modules.select("file", t.module_of(F.col("file")).alias("module"), F.col("file").rlike(t.glob_pattern("**/red*.py")).alias("red"))


# --- ownership -----------------------------------------------------------------


@query("select id, module from claimed", 62, 63, 64, 87, 88)
def claim_matches(x: Tables) -> DataFrame:
    return x.matched


@query("select module, owner from owner", 89)
def module_owners(x: Tables) -> DataFrame:
    return x.owners


@query("select id, split_part(pattern, ':', 1) as module, split_part(pattern, ':', 2) as symbol from claims where contains(pattern, ':')", 65)
def symbol_claims(x: Tables) -> DataFrame:
    return cl.symbol_claims(x.claims)


@query("""+ held as (select module, string_agg(distinct id, ',' order by id) as owners, count(distinct id) as n from claimed group by module)
select m.module, coalesce(owners, '') as owners, case when n > 1 then 'claimed twice' when n = 1 or empty_marker or k % 41 = 0 then 'mapped' else 'unmapped' end as state from modules m left join held using (module)""", 110, 198)
def claim_coverage(x: Tables) -> DataFrame:
    return cl.coverage(x.claims, x.modules, x.modules.where("k % 41 = 0"))


@query("""+ odd as (select id, pattern from claims union all select 'Ghost', 'nowhere.*' union all select 'Ghost', 'nowhere.leaf')
select id, pattern from odd where pattern like 'nowhere%'""", 130, 131)
def claims_unresolved(x: Tables) -> DataFrame:
    ghost = x.spark.range(1).select(F.lit("Ghost").alias("id"), F.lit(9999).cast("long").alias("pos"), F.explode(F.array(F.lit("nowhere.*"), F.lit("nowhere.leaf"))).alias("pattern"))
    return cl.unresolved(x.claims.unionByName(ghost), x.modules)


@query("""select m.module, string_agg(distinct o.owner, ',' order by o.owner) as owners from (
  select module, owner from owner union select split_part(pattern, ':', 1), id from claims where contains(pattern, ':')) o join modules m using (module) group by m.module""", 90, 91)
def module_claimants(x: Tables) -> DataFrame:
    both = cl.owners(x.claims, x.modules).unionByName(cl.symbol_claims(x.claims).select("module", F.col("id").alias("owner")))
    return both.join(x.modules.select("module"), "module").groupBy("module").agg(F.array_join(F.array_sort(F.collect_set("owner")), ",").alias("owners"))


@query("""+ owned as (select module, 0 as level, 'top' as owner from modules union all select module, 1, 'region' || (k % 5) from modules where k % 5 <> 2 union all select module, 2, 'nation' || (k % 25) from modules where (k % 25) % 4 = 0)
select module, arg_max(owner, level) as owner, max(level) as level from owned group by module""", 92)
def nearest_owners(x: Tables) -> DataFrame:
    m = x.modules
    top = m.select("module", F.lit("").alias("map_id"), F.lit("top").alias("owner"))
    region = m.where("k % 5 <> 2").select("module", F.lit("r").alias("map_id"), F.concat(F.lit("region"), F.col("k") % 5).alias("owner"))
    nation = m.where("(k % 25) % 4 = 0").select("module", F.lit("r/n").alias("map_id"), F.concat(F.lit("nation"), F.col("k") % 25).alias("owner"))
    levels = x.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("map_id"), F.lit(n).alias("level")) for n, i in enumerate(("", "r", "r/n"))])))
    return cl.nearest_owner(top.unionByName(region).unionByName(nation), F.broadcast(levels))  # three rows


@query("""select i as name, case when i = 'red' or starts_with(i, 'red.') then 'red' when i = 'hot' or starts_with(i, 'hot.') then 'hot' else '' end as sdk from (select distinct names[1] || '.' || names[2] as i from modules)""", 79, 357)
def sdk_imports(x: Tables) -> DataFrame:
    names = x.modules.select(F.concat_ws(".", F.get("names", F.lit(0)), F.get("names", F.lit(1))).alias("name")).distinct()
    return cl.sdk_of(names, ["red", "hot"])


# --- edges -----------------------------------------------------------------------


@query("select p, q, count(distinct module) as modules, count(*) as imports from open_crossing group by p, q", 98, 145, 257, 355)
def crossing_imports(x: Tables) -> DataFrame:
    """Flagship: imports between components that no flow connects."""
    return edges.without_flow(x.pair_counts, x.flows)


@query("select p, q, count(distinct module) as modules, count(*) as imports from crossing group by p, q", 93, 97, 99)
def crossing_pairs(x: Tables) -> DataFrame:
    return x.pair_counts


@query("select distinct least(p, q) as a, greatest(p, q) as b from crossing", 101)
def joined_by_import(x: Tables) -> DataFrame:
    return edges.unordered_pairs(edges.crossing(x.uses, cl.owners(x.claims, x.modules)))


@query("select distinct least(c.id, o.owner) as a, greatest(c.id, o.owner) as b from (select id, split_part(pattern, ':', 1) as module from claims where contains(pattern, ':')) c join owner o using (module) where c.id <> o.owner", 102)
def sharing_a_module(x: Tables) -> DataFrame:
    own = cl.owners(x.claims, x.modules)
    return cl.symbol_claims(x.claims).join(own, "module").where("id <> owner").select(F.least("id", "owner").alias("a"), F.greatest("id", "owner").alias("b")).distinct()


@query("select c.src, c.dst, count(*) as n from flows c group by 1, 2", 94, 152, 241)
def flow_counts(x: Tables) -> DataFrame:
    return x.flows.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("select a.src, a.dst from flows a where not exists (select 1 from flows b where b.src = a.dst and b.dst = a.src)", 95, 366)
def flows_one_way(x: Tables) -> DataFrame:
    back = x.flows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return x.flows.select("src", "dst").join(back, ["src", "dst"], "left_anti")


_RULES = [("no-economy-large", "forbid_import", ["Economy"], ["Large"]), ("no-pinned-ghost", "forbid_import", ["Pinned"], ["Ghost"]), ("small-own", "allow_imports", ["Small"], ["Promo"]), ("ghost", "forbid_import", ["Ghost"], ["Large"])]


@query("""+ rules as (select * from (values ('no-economy-large', 'forbid_import', 'Economy', 'Large'), ('no-pinned-ghost', 'forbid_import', 'Pinned', 'Ghost'), ('small-own', 'allow_imports', 'Small', 'Promo'), ('ghost', 'forbid_import', 'Ghost', 'Large')) v(id, kind, src, dst)),
owned as (select distinct id as owner, module from claimed), inside as (select distinct r.*, o.module from rules r join owned o on o.owner = r.src),
hit as (select i.id, i.kind, i.src, i.dst, i.module, u.target, bool_or(o.owner = i.dst) as d, bool_or(o.owner = i.src) as s, bool_or(o.owner is null) as n from inside i join uses u using (module) left join owned o on o.module = u.target group by all),
bad as (select id, count(*) filter (case when kind = 'forbid_import' then coalesce(d, false) else not n and not coalesce(d, false) and not coalesce(s, false) end) as violations, count(*) filter (kind = 'allow_imports' and n) as unowned from hit group by id),
gap as (select i.id, count(*) as g from inside i join modules m using (module) where not parsed or unresolved is null or len(unresolved) > 0 group by i.id)
select r.id, r.kind, coalesce(violations, 0) as violations, coalesce(unowned, 0) + coalesce(g, 0) as gaps, case when coalesce(violations, 0) > 0 then 'fail' when coalesce(unowned, 0) + coalesce(g, 0) > 0 then 'unknown' else 'pass' end as result
from rules r left join bad using (id) left join gap using (id)""", 114, 115, 203, 369, 453)
def import_rules(x: Tables) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(k).alias("kind"), F.array(*map(F.lit, s)).alias("src"), F.array(*map(F.lit, d)).alias("dst")) for i, k, s, d in _RULES])
    rules = x.spark.range(1).select(F.inline(listed))
    owned = cl.matches(x.claims, x.modules).select("module", F.col("id").alias("owner")).distinct()
    return edges.rule_outcomes(F.broadcast(rules), x.uses, owned, x.modules)  # a model's rules are few


@query("""+ e as (select distinct p as src, q as dst from open_crossing), r(src, dst) as (select src, dst from e)
select distinct e.src, e.dst from e where (e.dst, e.src) in (with recursive c(a, b) as (select src, dst from e union select c.a, e.dst from c join e on c.b = e.src) select a, b from c)""", 208, 209)
def cycle_imports(x: Tables) -> DataFrame:
    open_ = edges.without_flow(edges.crossing(x.uses, cl.owners(x.claims, x.modules)), x.flows)
    return graph.cycle_edges(open_.select(F.col("p").alias("src"), F.col("q").alias("dst")))


# --- comparisons -----------------------------------------------------------------


@query("""select module, change from (select coalesce(a.module, b.module) as module, case when a.module is null then 'added' when b.module is null then 'gone' when a.sha <> b.sha then 'changed' when a.tests_total <> b.tests_total then 'derived' end as change
from base_modules a full join modules b using (module)) where change is not null""", 45, 120, 185, 186)
def snapshot_drift(x: Tables) -> DataFrame:
    return diff.drift(x.base_modules, x.modules, "module", "sha", ["tests_total"])


@query("""select module, how, fields from (select coalesce(a.module, b.module) as module, case when a.module is null then 'added' when b.module is null then 'removed' when a.file is distinct from b.file or a.loc is distinct from b.loc or a.tests_total is distinct from b.tests_total then 'changed' end as how,
case when a.module is null or b.module is null then '' else concat_ws(',', case when a.file is distinct from b.file then 'file' end, case when a.loc is distinct from b.loc then 'loc' end, case when a.tests_total is distinct from b.tests_total then 'tests_total' end) end as fields
from base_modules a full join modules b using (module)) where how is not null""", 125, 194)
def keyed_diff(x: Tables) -> DataFrame:
    return diff.keyed(x.base_modules, x.modules, ["module"], ["file", "loc", "tests_total"])


@query("""select module, added, removed from (select module, coalesce(array_to_string(list_sort(list_distinct([w for w in b.names if not list_contains(a.names, w)])), ','), '') as added, coalesce(array_to_string(list_sort(list_distinct([w for w in a.names if not list_contains(b.names, w)])), ','), '') as removed
from base_modules a join modules b using (module)) where added <> '' or removed <> ''""", 191, 192, 193)
def surface_changes(x: Tables) -> DataFrame:
    return diff.surface(x.base_modules, x.modules, "module", "names")


@query("select module, target, 'a' as side from (select module, target from base_uses except select module, target from uses) union all select module, target, 'b' from (select module, target from uses except select module, target from base_uses)", 187, 190, 197)
def edges_changed(x: Tables) -> DataFrame:
    return diff.symmetric_difference(x.base_uses.select("module", "target"), x.uses.select("module", "target"))


@query("""+ moved as (select coalesce(a.module, b.module) as module from base_modules a full join modules b using (module) where a.module is null or b.module is null or a.sha <> b.sha)
select owner, count(*) as touched from moved join owner using (module) group by owner""", 139, 189, 372)
def touched_components(x: Tables) -> DataFrame:
    return diff.changed_components(x.base_modules, x.modules, cl.owners(x.claims, x.modules))


@query("""+ changed as (select b.module from base_modules a right join modules b using (module) where a.module is null or a.sha <> b.sha),
direct as (select distinct owner from changed join owner using (module)),
adj as (select distinct o.owner from uses u join changed c on c.module = u.target join owner o on o.module = u.module where u.module not in (select module from changed))
select owner, 'direct' as reach from direct union all select owner, 'adjacent' from adj where owner not in (select owner from direct)""", 119)
def change_reach(x: Tables) -> DataFrame:
    """Components that own changed modules, and those that import them."""
    changed = diff.drift(x.base_modules, x.modules, "module", "sha", []).where("change <> 'gone'").select("module")
    own = cl.owners(x.claims, x.modules)
    direct = changed.join(own, "module").select("owner").distinct()
    importers = x.uses.join(changed.select(F.col("module").alias("target")), "target", "left_semi").select("module").distinct().join(changed, "module", "left_anti")
    near = importers.join(own, "module").select("owner").distinct().join(direct, "owner", "left_anti")
    return direct.withColumn("reach", F.lit("direct")).unionByName(near.withColumn("reach", F.lit("adjacent")))


@query("""+ sim as (select a.k as a, b.k as b, len(list_intersect(a.names, b.names)) as i, len(list_distinct(list_concat(a.names, b.names))) as u from base_modules a join modules b on a.k = b.k)
select a as k, case when u = 0 then 0.0 else round(i / u, 6) end as overlap from sim""", 196, 440)
def surface_overlap(x: Tables) -> DataFrame:
    b = x.modules.select("k", F.col("names").alias("n2"))
    return x.base_modules.join(b, "k").select("k", F.round(diff.jaccard(F.col("names"), F.col("n2")), 6).alias("overlap"))


# --- findings ----------------------------------------------------------------------


@query("select c.id, min(c.module) as module from claimed c join components k using (id) where kind <> 'actor' group by c.id having count(distinct c.module) = 1", 148)
def single_module(x: Tables) -> DataFrame:
    return findings.single_module(x.components, x.claims, x.modules, x.matched)


@query("""+ held as (select distinct id, module, package from claimed), many as (select id from held group by id having count(*) > 1),
w as (select h.id, h.module, h.package, list_transform(regexp_extract_all(h.module, '[A-Z]+|[a-z0-9]+'), lambda s: lower(s)) as mine, list_transform(regexp_extract_all(c.id || ' ' || c.does, '[A-Z]?[a-z0-9]+|[A-Z]+'), lambda s: lower(s)) as own from held h join many using (id) join components c using (id)),
share as (select distinct id, module from (select id, module, unnest(mine) as a, own from w) q, unnest(q.own) as o(b) where a = b or (length(a) >= 4 and starts_with(b, a)) or (length(b) >= 4 and starts_with(a, b)))
select id, module from w where (id, module) not in (select id, module from share) and not exists (select 1 from held h where h.id = w.id and h.module <> w.module and (h.package = w.package or h.module = w.package or w.module = h.package))""", 224, 225, 352, 421)
def mis_folds(x: Tables) -> DataFrame:
    return findings.mis_folds(x.components, x.claims, x.modules, x.matched)


@query("select key from flows where trim(relation) = ''", 240, 353)
def flows_without_sentence(x: Tables) -> DataFrame:
    return x.flows.where(F.trim(F.coalesce("relation", F.lit(""))) == "").select("key")


@query("""+ j as (select distinct least(p, q) as a, greatest(p, q) as b from crossing), act as (select id from components where kind = 'actor')
select key, case when src in (select id from act) or dst in (select id from act) then 'external' when pos % 7 = 0 then 'observed' when exists (select 1 from j where a = least(src, dst) and b = greatest(src, dst)) or regexp_matches(lower(relation), '(^|[^a-z0-9_-])largebrand1($|[^a-z0-9_-])') then 'structural' else 'declared' end as state from flows""", 105, 227, 356, 367)
def flow_states(x: Tables) -> DataFrame:
    joined = edges.unordered_pairs(x.pair_counts)
    return findings.flow_states(x.flows, x.components, joined, joined.limit(0), x.flows.where("pos % 7 = 0"), ["LargeBrand1"])


@query("""+ e as (select e.*, owner from entry_points e left join owner using (module)), big as (select kind, owner, count(*) as n from e where owner is not null group by all having count(*) > 4)
select kind, owner, n, '' as name from big union all select e.kind, e.owner, 1, e.name from e left join big b on b.kind = e.kind and b.owner = e.owner where b.kind is null""", 150, 151, 354)
def entry_groups(x: Tables) -> DataFrame:
    return findings.entry_groups(x.entry_points, x.owners)


@query("""select layer, count(distinct node) as endpoints from (select 'data' as layer union all select 'control' union all select 'none') l left join (select kind, src as node from flows union all select kind, dst from flows) f on f.kind = l.layer group by layer having count(distinct node) < 1000""", 67, 68, 69, 147)
def thin_layers(x: Tables) -> DataFrame:
    layers = x.spark.range(1).select(F.explode(F.array(F.lit("data"), F.lit("control"), F.lit("none"))).alias("layer"))
    ends = x.flows.select("kind", F.explode(F.array("src", "dst")).alias("node"))
    return layers.join(ends, layers.layer == ends.kind, "left").groupBy("layer").agg(F.countDistinct("node").alias("endpoints")).where("endpoints < 1000")


@query("""select kind, module, name from (select *, bool_or(ord % 4 = 0) over (partition by kind, module, name, target) as covered from entry_points) where not covered""", 86, 117, 118, 232)
def ways_in_uncovered(x: Tables) -> DataFrame:
    identity = t.entry_identity(F.col("kind"), F.col("module"), F.col("target"), F.col("name"))
    e = x.entry_points.withColumn("identity", identity)
    return e.join(e.where("ord % 4 = 0").select("identity"), "identity", "left_anti").select("kind", "module", "name")
