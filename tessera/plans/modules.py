"""Queries: what a tree of modules gives and how it is put together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..bindings import Tables, WrittenTables
from ..operators import claims as cl
from ..operators import code_between as between
from ..operators import edges, line_diff, reexports, settings, ways_in, workspace
from ..scratch import cut, shared_dir
from ..sources import snapshots, syntax
from ..streaming import events
from .registry import query

# --- star re-exports -------------------------------------------------------------
# A package takes all of its modules by `*` and names one symbol of its last module; a
# type takes its packages by `*`, some of them limited to the names of one module, and the
# next type, so the types form a loop. Names that begin with b are not given by `*`.


def _star_records(x: Tables) -> tuple[DataFrame, DataFrame]:
    kind, empty = F.substring_index("package", ".", 1), F.lit(None).cast("array<string>")
    columns = ["module", "pos", "name", "kind", "source", "symbol", "star", "rebinds", "exported", "only"]
    words = x.modules.select("module", F.posexplode(F.array_distinct("names")).alias("pos", "name"))
    text, no = F.lit(None).cast("string"), F.lit(False)
    own = words.select("module", "pos", "name", F.lit("function").alias("kind"), text.alias("source"), text.alias("symbol"), no.alias("star"), no.alias("rebinds"), (~F.col("name").startswith("b")).alias("exported"), empty.alias("only"))
    last = x.modules.groupBy("package").agg(F.max_by(F.struct("module", F.get("names", F.lit(0)).alias("name")), "k").alias("m"), F.min_by("names", "k").alias("first"))
    named = last.select(F.col("package").alias("module"), F.lit(-1), "m.name", F.lit("reexport"), F.col("m.module").alias("source"), "m.name", no, no, F.lit(True), empty)

    def star(module, pos, source, only=empty):
        return [module.alias("module"), pos.cast("int"), F.lit("*"), F.lit("reexport"), source.alias("source"), text, F.lit(True), no, F.lit(True), only]

    up = x.modules.select(*star(F.col("package"), F.col("k"), F.col("module")))
    packages = last.select(*star(kind, F.row_number().over(Window.partitionBy(kind).orderBy("package")), F.col("package"), F.when(F.col("package").endswith("3"), F.col("first"))))
    types = x.modules.select(kind.alias("t")).distinct()
    order = Window.orderBy("t")  # over the few types
    ring = types.select("t", F.coalesce(F.lead("t").over(order), F.min("t").over(Window.partitionBy())).alias("next")).where("t <> next")
    records = own.union(named).union(up).union(packages).union(ring.select(*star(F.col("t"), F.lit(1000), F.col("next")))).toDF(*columns)
    parsed = F.lit(True).alias("parsed")
    modules = x.modules.select("module", "package", parsed).union(last.select("package", kind, parsed)).union(types.select("t", "t", parsed))
    return records, modules


@query("""+ kinds as (select distinct split_part(package, '.', 1) as t from modules),
lasts as (select package, split_part(package, '.', 1) as t, max_by(module, k) as source, max_by(names[1], k) as name, min_by(names, k) as first from modules group by package),
owns as (select distinct module, unnest(names) as name, module as defined_in from modules),
star as (
  select package as module, module as source, cast(null as varchar[]) as only_ from modules union all select t, package, case when package like '%3' then first end from lasts
  union all select * from (select t, coalesce(lead(t) over (order by t), min(t) over ()) as source, null from kinds) where t <> source
),
given as (with recursive g(module, name, defined_in, passed) as (
  select module, name, defined_in, not starts_with(name, 'b') from owns union select package, name, source, true from lasts
  union select s.module, g.name, g.defined_in, s.only_ is null or list_contains(s.only_, g.name) from g join star s on s.source = g.module
  where g.passed and not exists (select 1 from lasts l where l.package = s.module and l.name = g.name)
) select * from g)
select module, name, case when count(distinct defined_in) = 1 then min(defined_in) end as defined_in from given group by module, name""", 211, 212, 213, 214)
def star_reexports(x: Tables) -> DataFrame:
    names, _ = reexports.resolve(*_star_records(x))
    return names.select("module", "name", "defined_in")


# --- snapshots -------------------------------------------------------------------
# Each order is a commit, each customer a branch at its last order. Each region is a
# revision of a tree of documents.


@query("""+ commits as (select sha256('commit ' || o_orderkey) as revision, o_orderkey as k, o_custkey from orders),
names as (select c_name as name, max_by(revision, k) as revision from commits join customer on c_custkey = o_custkey group by c_name),
wanted as (select left(revision, 4 + cast(k % 4 as int)) as ref from commits union select c_name from customer union select revision from commits),
hits as (select w.ref, count(c.revision) as n, min(c.revision) as one from wanted w left join commits c on starts_with(c.revision, w.ref) group by w.ref)
select ref, coalesce(names.revision, case when n = 1 then one end) as revision, case when names.revision is not null or n = 1 then null when n > 1 then 'the ref ' || ref || ' is ambiguous: ' || n || ' revisions begin with it'
  else 'unknown ref ' || ref || '. Give a commit, branch, or tag that Git can resolve.' end as cause from hits left join names on name = ref""", 40)
def refs_resolved(x: Tables) -> DataFrame:
    commits = x.raw("orders").select(F.sha2(F.concat(F.lit("commit "), F.col("o_orderkey").cast("string")), 256).alias("revision"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c_custkey"))
    names = commits.join(x.raw("customer"), "c_custkey").groupBy(F.col("c_name").alias("name")).agg(F.max_by("revision", "k").alias("revision"))
    short = commits.select(F.expr("left(revision, 4 + cast(k % 4 as int))").alias("ref"))
    return snapshots.resolve_refs(short.union(x.raw("customer").select("c_name")).union(commits.select("revision")), names, commits.select("revision"))


def _store(x: Tables) -> snapshots.SnapshotStore:
    """Trees of all documents at five revisions, by region: later ones hold more documents, some edited."""
    store = snapshots.SnapshotStore(x.spark, f"{shared_dir(x.spark)}/tessera-store-{uuid.uuid4().hex}")
    region = x.raw("region").select("r_regionkey", F.lower("r_name").alias("name"), F.sha2(F.concat(F.lit("region "), F.col("r_regionkey").cast("string")), 256).alias("revision"))
    d, k = F.col("doc_id"), F.col("r_regionkey")
    text = F.concat(F.when(d % 7 == k, "edited ").otherwise(""), F.coalesce("text", F.lit(""))).cast("binary")
    content = F.when(d % 13 == 0, F.concat(text, F.unhex(F.lit("FF")))).otherwise(text)
    path = F.concat(F.when(d % 17 == 0, "c:/").otherwise(""), F.coalesce("source", F.lit("x")), F.lit("/"), d.cast("string"), F.lit(".txt"))
    held = x.raw("documents").withColumn("r_regionkey", F.explode(F.sequence((d % 5).cast("int"), F.lit(4))))
    entries = held.join(region.withColumn("r_regionkey", k.cast("int")), "r_regionkey").select("revision", path.alias("path"), F.when(d % 11 == 0, "120000").otherwise("100644").alias("mode"), content.alias("content"))
    store.write(entries, region.select("name", "revision"))
    return store


_TREE = """+ region_of as (select r_regionkey as k, lower(r_name) as name, sha256('region ' || r_regionkey) as revision from region),
docs as (select doc_id as d, case when doc_id % 17 = 0 then 'c:/' else '' end || coalesce(source, 'x') || '/' || doc_id || '.txt' as path, coalesce(text, '') as text from documents),
entries as (select r.*, d, path, d % 11 = 0 as link, case when d % 7 = k then 'edited ' else '' end || text as text from region_of r join docs on d % 5 <= k)
"""


@query(_TREE + """, wanted as (select name as ref, revision, k, d, path from region_of join docs on d % 5 = k or (d + 1) % 5 = k union all select left(revision, 9), revision, k, d, path from region_of join docs on (d + 2) % 5 = k union all select 'nowhere', null, -1, d, path from docs),
told as (select w.ref, w.path, w.revision, e.text, case when w.revision is null then 'unknown ref nowhere. Give a commit, branch, or tag that Git can resolve.' when e.text is null then null when w.d % 17 = 0 then 'the path contains a colon. Windows reads a colon as a drive or a data stream'
  when e.link then 'source could not be read: the Git entry is not a regular file' when w.d % 13 = 0 then 'source could not be read: the text is not UTF-8' end as problem from wanted w left join entries e on e.revision = w.revision and e.path = w.path)
select ref, path, revision, case when problem is null then sha256(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) end as text_sha, problem from told""", 36, 37, 42, 43, 44, 47)
def texts_at_revisions(x: Tables) -> DataFrame:
    store = _store(x)
    region = x.raw("region").select("r_regionkey", F.lower("r_name").alias("name"), F.substring(F.sha2(F.concat(F.lit("region "), F.col("r_regionkey").cast("string")), 256), 1, 9).alias("short"))
    d, k = F.col("doc_id"), F.col("r_regionkey")
    path = F.concat(F.when(d % 17 == 0, "c:/").otherwise(""), F.coalesce("source", F.lit("x")), F.lit("/"), d.cast("string"), F.lit(".txt")).alias("path")
    each = x.raw("documents").select("doc_id", path, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("shift"))
    asked = each.withColumn("r_regionkey", (d + F.col("shift")) % 5).join(region, "r_regionkey").select(F.when(F.col("shift") == 2, F.col("short")).otherwise(F.col("name")).alias("ref"), "path")
    return store.texts(asked.union(x.raw("documents").select(F.lit("nowhere"), path))).select("ref", "path", "revision", F.sha2("text", 256).alias("text_sha"), "problem")


@query(_TREE + """select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'removed' else 'modified' end as change
from (select * from entries where k = 2) a full join (select * from entries where k = 3) b on a.path = b.path where a.path is null or b.path is null or (a.text <> b.text and a.d % 17 <> 0)""", 45)
def revision_changes(x: Tables) -> DataFrame:
    store = _store(x)
    ids = {r.r_regionkey: r.revision for r in x.raw("region").select("r_regionkey", F.sha2(F.concat(F.lit("region "), F.col("r_regionkey").cast("string")), 256).alias("revision")).collect()}  # five rows
    return store.changed(ids[2], ids[3])


@query("""+ n as (select count(*) as n from modules), up as (select k as id, (k - 1) // 2 as parent from modules where k > 0 union select k, (k - 1) // 3 from modules where k > 0 and k % 4 = 0),
anc as (with recursive a(id, x) as (select k, k from modules union select a.id, up.parent from a join up on up.id = a.x) select * from a), pairs as (select k as a, (k * 7 + 3) % n as b from modules, n)
select a, b, max(l.x) as base from pairs left join anc l on l.id = a left join anc r on r.id = b and r.x = l.x where r.x is not null group by a, b""", 41)
def merge_bases(x: Tables) -> DataFrame:
    k = F.col("k")
    none = F.array().cast("array<bigint>")
    parents = F.when(k == 0, none).when(k % 4 == 0, F.array_distinct(F.array(F.floor((k - 1) / 2), F.floor((k - 1) / 3)))).otherwise(F.array(F.floor((k - 1) / 2)))
    commits = x.modules.select(k.alias("id"), k.alias("generation"), parents.alias("parents"))
    n = x.modules.agg(F.count("*").alias("n"))
    return snapshots.merge_bases(commits, x.modules.join(F.broadcast(n)).select(k.alias("a"), ((k * 7 + 3) % F.col("n")).alias("b")))  # one row


# --- ways in ---------------------------------------------------------------------
# Each part is a source file of one of six kinds, numbered by its key.

_SOURCES = (
    "from fastapi import APIRouter as R\nr = R()\n@r.get('/p/%1$d')\ndef read_%1$d(): ...\n@q.get('/p')\ndef other(): ...\n",
    "import flask\napp = flask.Flask(__name__)\n@app.route('/f/%1$d', methods=['get', 'POST'])\ndef f_%1$d(): ...\n",
    "urlpatterns = [path('list/%1$d/', views.v%1$d)] + [re_path('^m%1$d', include([url('in/', inner)]))]\n",
    "import click as ck\n@ck.group()\ndef g%1$d(): ...\n@g%1$d.command('show')\ndef s(): ...\n@g%1$d.group(name='deep')\ndef d(): ...\n@d.command()\ndef end_%1$d(): ...\n",
    "from celery import Celery, shared_task\nc = Celery('t')\n@shared_task\ndef t%1$d(): ...\n@c.task(bind=True)\ndef b(self): ...\n",
    "class C(cleo.Command):\n    name = 'c%1$d'\ndef main():\n    x.add_subparsers().add_parser('sub%1$d')\n",
)


@query("""select module, kind, name, target from modules join (values
  (0, 'route', 'GET /p/#', 'read_#'), (1, 'route', 'GET /f/#', 'f_#'), (1, 'route', 'POST /f/#', 'f_#'), (2, 'route', '/list/#/', 'views.v#'), (2, 'route', '/^m#', ''), (2, 'route', '/in/', 'inner'),
  (3, 'command', 'g#', 'g#'), (3, 'command', 'show', 's'), (3, 'command', 'deep', 'd'), (3, 'command', 'end_#', 'end_#'), (4, 'task', 't#', 't#'), (4, 'task', 'b', 'b'), (5, 'command', 'c#', 'C'), (5, 'subcommand', 'sub#', '')
) t(n, kind_, name_, target_) on k % 6 = n, lateral (select kind_ as kind, replace(name_, '#', cast(k as varchar)) as name, replace(target_, '#', cast(k as varchar)) as target)
union all select module, 'candidate', 'q.get', 'ways in: ' || module || '.other' from modules where k % 6 = 0""", 17, 18, 20, 21)
def ways_in_sources(x: Tables) -> DataFrame:
    k = F.col("k")
    text = F.coalesce(*[F.when(k % 6 == i, F.format_string(source, k)) for i, source in enumerate(_SOURCES)])
    # Their keys are few bytes, their parsing is not: all cores take part, however few files the table has.
    keys = x.modules.select("k", "file").repartition(4 * x.spark.sparkContext.defaultParallelism, "k")
    files = keys.select(F.col("file").alias("path"), F.encode(text, "UTF-8").alias("content"), F.lit(None).cast("string").alias("problem"))
    nodes = cut(syntax.nodes(files))
    ways, unsure = ways_in.in_source(nodes)
    below = ways_in.subcommands(nodes).select("module", F.lit("subcommand").alias("kind"), "name", F.lit("").alias("target"))
    return ways.unionByName(below).unionByName(unsure.select("module", F.lit("candidate").alias("kind"), F.col("target").alias("name"), F.concat(F.lit("ways in: "), "name").alias("target")))


# --- workspace members -------------------------------------------------------------
# Each type is a repository; its folders are the parts of its modules' files. Every
# repository lists the same patterns.

_GLOBS = {
    "brand1?": "brand1[^/]", "brand2*/*": "brand2[^/]*/[^/]+", "**/anvil": "([^/]+/)*anvil", "brand12/hot/**": "brand12/hot(/.+)?", "*/[a-h]*/*": "[^/]+/[a-h][^/]*/[^/]+",
    "brand[!12]?/**/[0-9]*": "brand[^12/][^/]/([^/]+/)*[0-9][^/]*", "**/[m-z]*/**": "([^/]+/)*[m-z][^/]*(/.+)?", "brand13/small": "brand13/small",
}


def _folder_rows(x: Tables) -> DataFrame:
    path = F.replace(F.concat(F.substring_index("package", ".", -1), F.lit("/"), F.substring_index("module", ".", -1)), F.lit("_"), F.lit("/"))
    parts = F.split(path, "/")
    own = x.modules.select(F.substring_index("package", ".", 1).alias("repo"), parts.alias("p")).select("repo", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    at = lambda n: F.array_join(F.slice("p", 1, n), "/")
    return own.select("repo", at(F.col("n")).alias("path"), at(F.col("n") - 1).alias("parent"), F.get("p", F.col("n") - 1).alias("name")).distinct()


@query("""+ parts as (select split_part(package, '.', 1) as repo, string_split(replace(split_part(package, '.', 2) || '/' || leaf, '_', '/'), '/') as p from modules),
folders as (select distinct repo, array_to_string(p[1:n], '/') as path from (select repo, p, unnest(range(1, len(p) + 1)) as n from parts))
select repo, path from folders where """ + " or ".join(f"regexp_full_match(path, '{r}')" for r in _GLOBS.values()), 2, 3)
def workspace_members(x: Tables) -> DataFrame:
    patterns = x.modules.select(F.substring_index("package", ".", 1).alias("repo")).distinct().withColumn("pattern", F.explode(F.array(*[F.lit(g) for g in _GLOBS])))
    return workspace.matching(patterns, _folder_rows(x))


# --- line differences ---------------------------------------------------------------
# Each document against an edition of it with lines dropped, added and changed.


@query("""select doc_id, sha256(array_to_string(flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: case
  when ((i - 1) * 7 + doc_id) % 5 = 0 then [] when (i - 1 + doc_id) % 6 = 0 then [x, 'new ' || (i - 1)] when ((i - 1) * 3 + doc_id) % 11 = 0 then ['~' || x] else [x] end)), chr(10))) as text_sha from documents""", 46)
def applied_diffs(x: Tables) -> DataFrame:
    d = x.raw("documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    none, doc = F.array().cast("array<string>"), F.col("doc_id")
    edited = F.flatten(F.transform(F.split("text", "\n", -1), lambda line, n: F.when((n * 7 + doc) % 5 == 0, none).when((n + doc) % 6 == 0, F.array(line, F.concat(F.lit("new "), n.cast("string")))).when((n * 3 + doc) % 11 == 0, F.array(F.concat(F.lit("~"), line))).otherwise(F.array(line))))
    found = line_diff.hunks(d.select("path", "text"), d.select("path", F.array_join(edited, "\n").alias("text")))
    return line_diff.applied(d.select("path", "text"), found).select(F.col("path").cast("long").alias("doc_id"), F.sha2("text", 256).alias("text_sha"))


# --- code between components ----------------------------------------------------------
# Every import across two cards has one site, whose lines follow from the lengths of the
# names; each module has 24 lines, every fifth of them blank.


@query("""+ pairs as (select distinct p as src, q as dst from crossing),
across as (select p.src, p.dst, false as back, c.module, c.target from pairs p join (select distinct * from crossing) c on c.p = p.src and c.q = p.dst union all select p.src, p.dst, true, c.module, c.target from pairs p join (select distinct * from crossing) c on c.p = p.dst and c.q = p.src),
blind as (select distinct a.src, a.dst from across a join modules m using (module) where k % 701 = 0 or k % 803 = 0),
site as (select *, length(module) as a, length(target) as b from across where not exists (select 1 from blind where blind.src = across.src and blind.dst = across.dst)),
uses_ as (select *, (a + b) % 3 <> 0 as direct, 3 + b % 20 as use_line, a % 4 as fn from site),
picks as (
  select src, dst, back, module, 1 + a % 7 as line, 1 as tier, 0 as o, 1 + a % 7 as l from uses_ where direct union all select src, dst, back, module, use_line, case when direct then 1 else 2 end, 0, use_line from uses_ where direct or b % 2 = 0
  union all select src, dst, back, module, fn, 3, case when direct then 1 else 2 end, use_line from uses_ where (direct or b % 2 = 0) and fn > 0 and fn <> use_line
), best as (select src, dst, back, module, line, min({'tier': tier, 'o': o, 'back': back::int, 'm': module, 'l': l}) as rank from picks where line between 1 and 24 and line % 5 <> 0 group by all),
cut as (select *, row_number() over (partition by src, dst order by rank, line) as n from best)
select src, dst, cast(row_number() over (partition by src, dst order by back, module, line) as int) as at, module, cast(line as int) as line, module || ':' || line || ': code ' || line as text from cut where n <= 60""", 124, 350)
def code_between_cards(x: Tables) -> DataFrame:
    x = WrittenTables(x.spark, x.sf_dir)
    owners = x.owners
    across = cut(edges.crossing(x.uses, owners))  # read three times
    pairs = across.select(F.col("p").alias("src"), F.col("q").alias("dst")).distinct()
    a, b = F.length("module"), F.length("target")
    use = F.struct((3 + b % 20).cast("int").alias("line"), (a % 4).cast("int").alias("function"), F.when(b % 2 == 0, "m").otherwise("").alias("member"))
    sites = across.select("module", "target", F.lit("x").alias("name"), F.when((a + b) % 3 == 0, "value").otherwise("import").alias("bound"), (1 + a % 7).cast("int").alias("line"), F.array(use).alias("uses"))
    n = F.col("n")
    lines = x.modules.select("module", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("n")).withColumn("text", F.when(n % 5 == 0, "  ").otherwise(F.concat(F.lit("  code "), n.cast("string"))))
    known = x.modules.select("module", (F.col("k") % 701 != 0).alias("sites"), (F.col("k") % 803 != 0).alias("source"))
    return between.code_between(pairs, owners, across, sites, lines, known)[0]


# --- settings ---------------------------------------------------------------------------
# Each part is a settings file that extends one or two files of lower numbers; two of every
# fifty extend each other.


@query("""+ links as (select k, 0 as pos, case when k % 50 = 21 then k + 1 when k % 50 = 22 then k - 1 else k // 2 end as parent from modules where k % 5 <> 0 or k % 50 in (21, 22) union all select k, 1, k // 3 from modules where k % 7 = 0 and k % 5 <> 0 and k % 50 not in (21, 22) and k > 0),
last_ as (select k, parent, max(pos) over (partition by k) - pos as step from links where k <> parent),
own as (select k, 'target' as name, 't' || k as value from modules where k % 3 = 0 union all select k, 'base', 'b' || k from modules where k % 4 = 1 union all select k, 'paths', 'p' || k from modules where k % 6 = 2),
walk as (with recursive w(k, spot, rank, n) as (select k, k, cast([] as bigint[]), 0 from modules union all select w.k, l.parent, list_append(w.rank, l.step), n + 1 from w join last_ l on l.k = w.spot where n < 16 and w.spot % 50 not in (21, 22)) select * from w),
bad as (select distinct k from walk where spot % 50 in (21, 22)),
best as (select w.k, o.name, arg_min({'v': o.value, 'spot': w.spot}, w.rank) as v from walk w join own o on o.k = w.spot where w.k not in (select k from bad) group by w.k, o.name)
select k as path, name, v.v as value, v.spot as given_by from best union all select k, 'problem', 'circular', cast(-1 as bigint) from bad""", 28, 29)
def inherited_settings(x: Tables) -> DataFrame:
    k = F.col("k")
    pair = (k % 50).isin(21, 22)
    first = x.modules.where((k % 5 != 0) | pair).select(k.alias("path"), F.lit(0).alias("pos"), F.when(k % 50 == 21, k + 1).when(k % 50 == 22, k - 1).otherwise(F.floor(k / 2)).alias("parent"))
    second = x.modules.where((k % 7 == 0) & (k % 5 != 0) & ~pair & (k > 0)).select(k, F.lit(1), F.floor(k / 3))
    extends = first.union(second).where("path <> parent")
    named = F.inline(F.filter(F.array(*[F.struct(c.alias("on"), F.lit(n).alias("name"), F.concat(F.lit(v), k.cast("string")).alias("value")) for c, n, v in ((k % 3 == 0, "target", "t"), (k % 4 == 1, "base", "b"), (k % 6 == 2, "paths", "p"))]), lambda s: s["on"]))
    own = x.modules.select(k.alias("path"), named).select("path", "name", "value")
    found, problems = settings.effective(extends, own, x.modules.select(k.alias("path")))
    circular = problems.where("startswith(cause, 'a circular')").select("path").distinct()
    return found.unionByName(circular.select("path", F.lit("problem").alias("name"), F.lit("circular").alias("value"), F.lit(-1).cast("bigint").alias("given_by")))


_LEAVES = (
    ("#one", 0, (), "./one.js"), ("#w/*", 0, ("types",), "./types/*.d.ts"), ("#w/*", 1, ("import", "dev"), "./dev/*.js"), ("#w/*", 2, ("default",), "./w/*.js"), ("#w/hot/*", 0, ("require",), None), ("#w/hot/*", 1, ("default",), "./hot/*"),
    ("#w/*.json", 0, (), "./json/*"), ("#w/cold/*", 0, ("import",), "./cold/*"),
)


@query("""+ packages as (select distinct package from modules), leaves(key, seq, needed, target) as (values """ + ", ".join(f"('{k}', {i}, cast([{', '.join(repr(c) for c in cs)}] as varchar[]), {'null' if t is None else repr(t)})" for k, i, cs, t in _LEAVES) + """),
requests as (select distinct package, case when k % 9 = 0 then '#one' when k % 9 = 1 then '#none' else '#w/' || replace(leaf, '_', '/') || case when k % 4 = 0 then '.json' else '' end end as specifier, [['import'], ['require'], ['types', 'import'], ['import', 'dev']][k % 4 + 1] as conditions from modules),
keyed as (select r.*, l.key, row_number() over (partition by package, specifier, conditions order by case when key = specifier then 0 else 1 end, length(split_part(key, '*', 1)) desc, length(key) desc) as n from requests r join (select distinct key from leaves) l
  on key = specifier or (contains(key, '*') and starts_with(specifier, split_part(key, '*', 1)) and ends_with(specifier, split_part(key, '*', 2)) and length(specifier) > length(key) - 1)),
told as (select k.package, k.specifier, k.conditions, k.key, l.target, substr(k.specifier, length(split_part(k.key, '*', 1)) + 1, length(k.specifier) - length(k.key) + 1) as middle, row_number() over (partition by k.package, k.specifier, k.conditions order by l.seq) as m
  from keyed k join leaves l on l.key = k.key where k.n = 1 and len(list_filter(l.needed, lambda c: c <> 'default' and not list_contains(k.conditions, c))) = 0)
select r.package, r.specifier, array_to_string(r.conditions, ',') as conditions, replace(t.target, '*', t.middle) as target from requests r left join told t on t.package = r.package and t.specifier = r.specifier and t.conditions = r.conditions and t.m = 1""", 32)
def conditional_targets(x: Tables) -> DataFrame:
    k = F.col("k")
    section = F.lit("imports").alias("section")
    leaf = F.array(*[F.struct(F.lit(key).alias("key"), F.lit(i).alias("seq"), F.array(*[F.lit(c) for c in cs]).cast("array<string>").alias("conditions"), F.lit(t).cast("string").alias("target"), F.lit(False).alias("listed")) for key, i, cs, t in _LEAVES])
    leaves = x.modules.select("package").distinct().select("package", section, F.inline(leaf))
    word = F.concat(F.lit("#w/"), F.replace(F.substring_index("module", ".", -1), F.lit("_"), F.lit("/")), F.when(k % 4 == 0, ".json").otherwise(""))
    wanted = F.array(*[F.array(*[F.lit(c) for c in cs]) for cs in (("import",), ("require",), ("types", "import"), ("import", "dev"))])
    requests = x.modules.select("package", section, F.when(k % 9 == 0, "#one").when(k % 9 == 1, "#none").otherwise(word).alias("specifier"), F.get(wanted, (k % 4).cast("int")).alias("conditions"))
    return settings.resolve(requests, leaves).select("package", "specifier", F.array_join("conditions", ",").alias("conditions"), "target")


# --- live events --------------------------------------------------------------------------
# Each user's events are the lines of a live view: signups serve, views begin a rendering,
# purchases end one, errors break one, clicks change a file; some lines are cut off.


def _live_lines(x: Tables) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    event = F.when(kind == "signup", "serving").when(kind == "view", "rendering").when(kind == "purchase", "rendered").when(kind == "error", "error").otherwise("change")
    line = F.to_json(F.struct(event.alias("event"), F.concat(F.lit("u"), i.cast("string")).alias("url"), i.alias("version"), (i % 7).alias("updates"), (i * 2).alias("svg_bytes"), F.concat(F.lit("\n  e"), i.cast("string"), F.lit(" \nmore")).alias("text")))
    return x.raw("events").select(F.col("user_id").cast("string").alias("view"), "ts", F.when(i % 13 == 0, F.substring(line, 1, 20)).otherwise(line).alias("line"))


_LIVE = "+ e as (select cast(user_id as varchar) as view, ts, event_id as i, event_type as t from events where event_id % 13 <> 0)\n"


@query(_LIVE + """select view, coalesce(max_by('u' || i, ts) filter (t = 'signup'), '') as url, coalesce(max_by(case t when 'view' then 'rendering' when 'purchase' then 'ready' else 'error' end, ts) filter (t in ('view', 'purchase', 'error')), '') as phase,
  coalesce(max_by(i, ts) filter (t in ('purchase', 'error')), 0) as version, coalesce(max_by(i % 7, ts) filter (t = 'purchase'), 0) as updates, coalesce(max_by(i, ts) filter (t = 'purchase'), 0) as good,
  coalesce(max_by(i * 2, ts) filter (t = 'purchase'), 0) as svg_bytes, coalesce(max_by(case t when 'error' then 'e' || i else '' end, ts) filter (t in ('purchase', 'error')), '') as error from e group by view""", 293)
def live_states(x: Tables) -> DataFrame:
    return events.fold(_live_lines(x))


@query(_LIVE + """, g as (select view, epoch_us(ts) // 1000 as ts, lag(epoch_us(ts) // 1000) over (partition by view order by ts) as b from e where t = 'click'),
n as (select *, sum(case when b is null or ts - b >= 86400000 then 1 else 0 end) over (partition by view order by ts rows unbounded preceding) as period from g)
select view, max(ts) + 86400000 as due, count(*) as changes from n group by view, period""", 290)
def quiet_periods(x: Tables) -> DataFrame:
    return events.due_times(_live_lines(x), 86400)
