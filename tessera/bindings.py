"""The fact tables, derived from the relational test tables.

Each property builds one table of the blueprint lazily; ``SQL`` holds the same
derivations as common table expressions for DuckDB, so that a query and the
SQL it is held against start from the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import claims as cl
from .operators import edges
from .scratch import cut

#: Tables that grow with the facts. Spark takes the size of the compressed file for that of the
#: rows, so joins on them say that they are shuffled; a table of millions of names is never broadcast.
GROWING = ("customer", "supplier", "part", "orders", "lineitem", "events")


class Tables:
    """The blueprint tables over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return table.hint("merge") if name in GROWING else table

    @cached_property
    def modules(self) -> DataFrame:
        """Head snapshot: one module a part; package is type and brand."""
        k = F.col("p_partkey")
        package = F.concat(F.lower("p_type"), F.lit("."), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
        leaf = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), k)
        return self.raw("part").select(
            k.alias("k"), F.concat(package, F.lit("."), leaf).alias("module"), package.alias("package"),
            F.concat(F.replace(package, F.lit("."), F.lit("/")), F.lit("/"), leaf, F.lit(".py")).alias("file"),
            F.sha2(F.concat_ws("|", k, "p_name", "p_brand", "p_type", "p_size"), 256).alias("sha"),
            F.split("p_name", " ").alias("names"), F.col("p_size").cast("long").alias("loc"), (k % 4).alias("tests_total"),
            F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("The "), "p_name", F.lit(" part.  Made by "), "p_brand", F.lit("."))).alias("docstring"),
            (k % 17 != 0).alias("parsed"),
            F.when(k % 19 == 0, None).when(k % 23 == 0, F.array(F.lit("missing"))).otherwise(F.array().cast("array<string>")).alias("unresolved"),
            (k % 29 == 0).alias("empty_marker"),
        )

    @cached_property
    def base_modules(self) -> DataFrame:
        """Base snapshot: some modules are absent, edited or named otherwise."""
        k, m = F.col("k"), self.modules
        edited = k % 7 == 2
        renamed = k % 20 == 5
        return m.where("k % 10 <> 3").select(
            "k", F.when(renamed, F.concat("package", F.lit(".old_"), F.substring_index("module", ".", -1))).otherwise(F.col("module")).alias("module"), "package",
            F.when(renamed, F.concat(F.replace("package", F.lit("."), F.lit("/")), F.lit("/old_"), F.substring_index("module", ".", -1), F.lit(".py"))).otherwise(F.col("file")).alias("file"),
            F.when(edited, F.sha2(F.concat(F.lit("edited"), "sha"), 256)).otherwise(F.col("sha")).alias("sha"),
            F.when(edited, F.concat("names", F.array(F.lit("extra")))).otherwise(F.col("names")).alias("names"), "loc", ((k + F.when(edited, 1).otherwise(0)) % 4).alias("tests_total"),
        )

    def _edges(self, orders: DataFrame | None) -> DataFrame:
        lines = self.raw("lineitem")
        if orders is not None:
            lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
        part = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k"))
        after = part.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("k").alias("t"))
        pairs = part.join(after, ["l_orderkey", "l_linenumber"]).where("k <> t").select("k", "t").distinct()
        ids = self.modules.select("k", "module", "names")
        return pairs.join(ids.select("k", "module"), "k").join(ids.select(F.col("k").alias("t"), F.col("module").alias("target"), F.slice("names", 1, 1).alias("names")), "t").select("module", "target", "names")

    @cached_property
    def uses(self) -> DataFrame:
        """Import edges of the head snapshot: parts on consecutive lines of an order."""
        return self._edges(None)

    @cached_property
    def base_uses(self) -> DataFrame:
        """Import edges of orders before 1999."""
        return self._edges(self.raw("orders").where("o_orderdate < timestamp'1999-01-01'"))

    @cached_property
    def components(self) -> DataFrame:
        """Cards: one for pinned modules, one for each brand that ends in 1 by type, one for each type but one."""
        m = self.modules
        pinned = self.spark.range(1).select(F.lit("Pinned").alias("id"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("head"))
        brands = m.where("package like '%1'").select("package").distinct().select(
            F.concat(F.initcap(F.substring_index("package", ".", 1)), F.initcap(F.substring_index("package", ".", -1))).alias("id"), F.lit(None).cast("long").alias("pos"), F.col("package").alias("head"))
        types = m.select(F.substring_index("package", ".", 1).alias("t")).distinct().where("t <> 'standard'").select(F.initcap("t").alias("id"), F.lit(None).cast("long").alias("pos"), F.col("t").alias("head"))
        rank = F.row_number().over(_by("id")).cast("long")
        all_cards = pinned.unionByName(brands.withColumn("pos", 100 + rank)).unionByName(types.withColumn("pos", 1000 + rank))
        kinds = F.array(*[F.lit(x) for x in ("component", "store", "agent", "tool", "actor", "component", "context")])
        return all_cards.select("id", "pos", "head", F.get(kinds, (F.col("pos") % 7).cast("int")).alias("kind"), F.concat(F.lit("Keeps the "), F.replace("head", F.lit("."), F.lit(" ")), F.lit(" parts")).alias("does"))

    @cached_property
    def claims(self) -> DataFrame:
        """Patterns of the cards: ``head.*``, exact modules, and ``module:symbol``."""
        wild = self.components.where("head <> ''").select("id", "pos", F.concat("head", F.lit(".*")).alias("pattern"))
        exact = self.modules.where("k % 50 = 1").select(F.lit("Pinned").alias("id"), F.lit(0).cast("long").alias("pos"), F.col("module").alias("pattern"))
        symbol = self.modules.where("k % 100 = 7").select(F.lit("Pinned").alias("id"), F.lit(0).cast("long").alias("pos"), F.concat("module", F.lit(":"), F.get("names", F.lit(0))).alias("pattern"))
        return wild.unionByName(exact).unionByName(symbol)

    @cached_property
    def flows(self) -> DataFrame:
        """Arrows between cards, half of the possible ones by a rule on the ids."""
        c = self.components.select("id", "pos")
        pairs = c.select(F.col("id").alias("src"), F.col("pos").alias("a")).join(c.select(F.col("id").alias("dst"), F.col("pos").alias("b")), (F.col("a") * 3 + F.col("b") * 5) % 11 == 0)
        pairs = pairs.where("src <> dst")
        return pairs.select(
            "src", "dst", F.concat("src", F.lit("->"), "dst").alias("key"), (F.col("a") * 10000 + F.col("b")).alias("pos"), F.when((F.col("a") + F.col("b")) % 3 == 0, "data").otherwise("control").alias("kind"),
            F.when((F.col("a") + F.col("b")) % 4 == 0, "").otherwise(F.concat(F.lit("sends to "), "dst")).alias("relation"),
        )

    @cached_property
    def matched(self) -> DataFrame:
        """Distinct (id, module): the modules that each card claims."""
        return cl.matches(self.claims, self.modules).select("id", "module").distinct()

    @cached_property
    def owners(self) -> DataFrame:
        """(module, owner): the first card that claims the module."""
        return cl.owners(self.claims, self.modules)

    @cached_property
    def pair_counts(self) -> DataFrame:
        """(p, q, modules, imports) of the imports across each ordered pair of cards."""
        return edges.pair_counts(edges.crossing(self.uses, self.owners))

    @cached_property
    def entry_points(self) -> DataFrame:
        """Ways in: events of five kinds, placed in modules."""
        n = self.raw("part").select(F.count("*").alias("n"))
        e = self.raw("events").crossJoin(F.broadcast(n))  # one row
        return e.select((F.col("event_id") % F.col("n")).alias("k"), "event_id", "user_id", "event_type").join(self.modules.select("k", "module"), "k").select(
            F.col("event_id").alias("ord"), F.col("event_type").alias("kind"), "module", F.concat(F.lit("e"), "event_id").alias("name"), F.concat(F.lit("t"), F.col("user_id") % 40).alias("target"), "user_id")

    @cached_property
    def maps(self) -> DataFrame:
        """The tree of maps: the top, a map for each region, one for each nation below its region."""
        top = self.spark.range(1).select(F.lit("").alias("map_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("level"))
        regions = self.raw("region").select(F.lower("r_name").alias("map_id"), F.lit("").alias("parent_id"), F.lit(1).alias("level"))
        nations = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.concat(F.lower("r_name"), F.lit("/"), F.lower("n_name")).alias("map_id"), F.lower("r_name").alias("parent_id"), F.lit(2).alias("level"))
        return top.unionByName(regions).unionByName(nations)

    @cached_property
    def scores(self) -> DataFrame:
        """Provider answers: a probability for each labelled document, with its label."""
        p = F.round(((F.col("n_chars") * 7 + F.col("doc_id") * 13) % 101) / 100.0, 2)
        return self.raw("documents").join(self.raw("labels"), "doc_id").select(F.col("doc_id").alias("id"), "source", F.least(F.lit(1.0), F.round(p * 0.8 + F.col("quality") * 0.2, 2)).alias("p"), (F.col("quality") == 1).alias("label"))


class WrittenTables(Tables):
    """The cards, what follows from them, and the owners, written once: a query that reads them often holds no copy of their plans for each time."""

    @cached_property
    def components(self) -> DataFrame:
        return cut(super().components)

    @cached_property
    def claims(self) -> DataFrame:
        return cut(super().claims)

    @cached_property
    def flows(self) -> DataFrame:
        return cut(super().flows)

    @cached_property
    def matched(self) -> DataFrame:
        return cut(super().matched)

    @cached_property
    def owners(self) -> DataFrame:
        return cut(super().owners)

    @cached_property
    def pair_counts(self) -> DataFrame:
        return cut(super().pair_counts)


def _by(*columns: str):
    from pyspark.sql.window import Window

    return Window.orderBy(*columns)  # over the cards of a model, a bounded table


SQL = """
with modules0 as (
  select p_partkey as k, p_name, p_brand, p_size, lower(p_type) || '.' || lower(replace(p_brand, '#', '')) as package, replace(p_name, ' ', '_') || '_' || p_partkey as leaf,
    sha256(concat_ws('|', p_partkey, p_name, p_brand, p_type, p_size)) as sha from part
), modules as (
  select k, package || '.' || leaf as module, package, replace(package, '.', '/') || '/' || leaf || '.py' as file, sha, string_split(p_name, ' ') as names, cast(p_size as bigint) as loc, k % 4 as tests_total,
    case when k % 5 = 0 then '' else 'The ' || p_name || ' part.  Made by ' || p_brand || '.' end as docstring, k % 17 <> 0 as parsed,
    case when k % 19 = 0 then null when k % 23 = 0 then ['missing'] else cast([] as varchar[]) end as unresolved, k % 29 = 0 as empty_marker, leaf from modules0
), base_modules as (
  select k, case when k % 20 = 5 then package || '.old_' || leaf else module end as module, package, case when k % 20 = 5 then replace(package, '.', '/') || '/old_' || leaf || '.py' else file end as file,
    case when k % 7 = 2 then sha256('edited' || sha) else sha end as sha, case when k % 7 = 2 then list_append(names, 'extra') else names end as names, loc, (k + case when k % 7 = 2 then 1 else 0 end) % 4 as tests_total
  from modules where k % 10 <> 3
), part_of as (select l_orderkey as o, l_linenumber as n, min(l_partkey) as k from lineitem group by 1, 2),
uses as (
  select a.module, b.module as target, b.names[1:1] as names from (select distinct x.k, y.k as t from part_of x join part_of y on x.o = y.o and y.n = x.n + 1 where x.k <> y.k) p join modules a on a.k = p.k join modules b on b.k = p.t
), base_uses as (
  select a.module, b.module as target, b.names[1:1] as names from (select distinct x.k, y.k as t from part_of x join part_of y on x.o = y.o and y.n = x.n + 1 join orders on o_orderkey = x.o where x.k <> y.k and o_orderdate < '1999-01-01') p join modules a on a.k = p.k join modules b on b.k = p.t
), brand_cards as (select upper(package[1]) || substr(split_part(package, '.', 1), 2) || upper(split_part(package, '.', 2)[1]) || substr(split_part(package, '.', 2), 2) as id, package as head from (select distinct package from modules where package like '%1')),
type_cards as (select upper(t[1]) || substr(t, 2) as id, t as head from (select distinct split_part(package, '.', 1) as t from modules) where t <> 'standard'),
cards as (
  select 'Pinned' as id, 0 as pos, '' as head union all select id, 100 + row_number() over (order by id), head from brand_cards union all select id, 1000 + row_number() over (order by id), head from type_cards
), components as (select id, pos, head, ['component', 'store', 'agent', 'tool', 'actor', 'component', 'context'][pos % 7 + 1] as kind, 'Keeps the ' || replace(head, '.', ' ') || ' parts' as does from cards),
claims as (
  select id, pos, head || '.*' as pattern from components where head <> '' union all select 'Pinned', 0, module from modules where k % 50 = 1
  union all select 'Pinned', 0, module || ':' || names[1] from modules where k % 100 = 7
), flows as (
  select a.id as src, b.id as dst, a.id || '->' || b.id as key, a.pos * 10000 + b.pos as pos, case when (a.pos + b.pos) % 3 = 0 then 'data' else 'control' end as kind, case when (a.pos + b.pos) % 4 = 0 then '' else 'sends to ' || b.id end as relation
  from components a join components b on (a.pos * 3 + b.pos * 5) % 11 = 0 where a.id <> b.id
), entry_points as (
  select event_id as ord, event_type as kind, module, 'e' || event_id as name, 't' || (user_id % 40) as target, user_id from (select *, event_id % n as spot from events, (select count(*) as n from part)) join modules on k = spot
), maps as (
  select '' as map_id, cast(null as varchar) as parent_id, 0 as level union all select lower(r_name), '', 1 from region union all select lower(r_name) || '/' || lower(n_name), lower(r_name), 2 from nation join region on n_regionkey = r_regionkey
), scores as (
  select doc_id as id, source, least(1.0, round(round(((n_chars * 7 + doc_id * 13) % 101) / 100.0, 2) * 0.8 + quality * 0.2, 2)) as p, quality = 1 as label from documents join labels using (doc_id)
), claimed as (
  select distinct c.id, c.pos, m.module, m.package, m.k from claims c join modules m on (c.pattern like '%.*' and (m.module = replace(c.pattern, '.*', '') or m.package = replace(c.pattern, '.*', '') or starts_with(m.package, replace(c.pattern, '.*', '') || '.'))) or c.pattern = m.module
), owner as (select module, arg_min(id, pos) as owner from claimed group by module),
crossing as (select a.owner as p, b.owner as q, u.module, u.target from uses u join owner a on a.module = u.module join owner b on b.module = u.target where a.owner <> b.owner),
open_crossing as (select * from crossing c where not exists (select 1 from flows f where (f.src = c.p and f.dst = c.q) or (f.src = c.q and f.dst = c.p)))
"""
