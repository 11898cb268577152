"""Source divergence audit: a baseline-correction inverted index.

Each language keeps the terms of at least ``least`` of its documents. A source
gives a kept term the probability (in parts of ``SCALE``)
p = 1 + floor(SCALE * (count + 1) / (N + V)). The divergence of source g from
source h is the sum over all kept terms of f(p, q) = floor((p - q)^2 / q).

The index has a row for each kept term with its postings (source, count). All
pairs of sources start at V * f(z_g, z_h), z being the probability of a count
of zero, so terms that neither has cost nothing. Corrections come from the
postings only:

* what one source has changes f against z of any other; it depends on the
  count alone, so it is taken once for each distinct count of a source, times
  the number of its terms with that count;
* what both have is put right by f(p, q) - f(p, z_h) - f(z_g, q) + f(z_g, z_h),
  summed in tasks over buckets of terms. A bucket's postings are dealt by
  blocks of ``BLOCK`` sources, so neither a term that every source has nor a
  language with very many sources ends in one task, and no row is made for a
  pair of postings: a task returns one sum for each pair of sources.

The table of pairs is the result that is asked for; nothing larger is made.
Counting runs over Arrow batches with bounded tables, so a source with a third
of all documents is summed before it is shuffled. Long arithmetic is exact as
long as V and counts stay below 10^9 a source (beyond it fails, it does not
wrap).

Defined results: null text, lang or source is ''; each row is a document,
repeated ones too; a language without kept terms has pairs of value 0; a
source alone in its language has no pair; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, pick, small_batches, table

SCALE = 1_000_000_000
#: Documents that a kept term is in, and the most terms listed for a source.
LEAST, TOP = 3, 200
#: Sources in a block, postings in a bucket, pairs of postings expanded at a time, entries counted in a task before they are passed on.
BLOCK, POSTINGS, PAIRS, HELD = 1024, 50_000, 1 << 20, 300_000

#: Bytes of UTF-8 texts: A-Z lower-cased, everything in ASCII but letters turned into a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Partial counts: lang, source, term, count, docs; and a row with a null term for each source of a task."""
    small_batches(docs.sparkSession)
    blank = lambda name: F.coalesce(name, F.lit(""))
    own = pick(docs, lang="lang", source="source", text="text").select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").cast("binary").alias("text"))
    names = ["lang", "source", "term", "count", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[Counter, Counter]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, docs) in found.items():
                n = len(counts) + 1
                columns = [pa.array([lang] * n), pa.array([source] * n), pa.array([None, *[t.decode() for t in counts]], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([0, *counts.values()], pa.int64()), pa.array([0, *[docs[t] for t in counts]], pa.int64())], names=names)
            found.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                counts, docs = found.setdefault((lang, source), (Counter(), Counter()))
                words = Counter(text.translate(_BYTES).split())
                size -= len(counts)
                counts.update(words)
                docs.update(words.keys())
                size += len(counts)
                if size > held:
                    yield from flushed()
                    size = 0
        yield from flushed()

    return own.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def inverted_index(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """Kept terms: lang, term, total, postings (source, count). One row a term; a posting list has one entry a source at most."""
    terms = counts.where("term is not null").repartition("lang", "term")
    per = terms.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    return per.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "count")).alias("postings")).where(F.col("docs") >= least).drop("docs")


def _p(count, n, v):
    """Column: the probability of a count; decimals, as SCALE * count may leave 64 bits."""
    whole = lambda c: f"cast({c} as decimal(20,0))"
    return F.expr(f"1 + (cast({SCALE} as decimal(18,0)) * ({whole(count)} + 1)) div ({whole(n)} + {whole(v)})")


def _f(p, q):
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def sources_of(counts: DataFrame, postings: DataFrame, kept: DataFrame) -> DataFrame:
    """One row a source: lang, source, gid (from 0 in its language), v, n, z (the probability of a count of 0; null if v = 0), blocks and n_lang of its language."""
    known = counts.where("term is null").select("lang", "source").distinct()
    sums = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    own = known.join(sums, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), "n_lang")
    whole = Window.partitionBy("lang")
    numbered = own.withColumn("gid", F.row_number().over(whole.orderBy("source")) - 1).withColumn("blocks", F.floor((F.count("*").over(whole) - 1) / BLOCK) + 1)
    return numbered.select("lang", "source", "gid", "v", "n", "n_lang", F.expr("if(v > 0, cast(0 as bigint), null)").alias("zero"), "blocks").select("lang", "source", "gid", "v", "n", "n_lang", _p("zero", "n", "v").alias("z"), "blocks")


def _facing(left: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row of left (a source's) with each other source of its language: an equi-join by language and block of the other."""
    dealt = left.withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    others = sources.select("lang", F.floor(F.col("gid") / BLOCK).cast("int").alias("block"), F.col("source").alias("item"), F.col("gid").alias("other"), F.col("z").alias("zo"))
    return dealt.join(others, ["lang", "block"]).where("gid <> other").drop("block")


def one_sided(postings: DataFrame, sources: DataFrame) -> DataFrame:
    """Corrections for what one source has: lang, gid, other, value, in both directions."""
    same = postings.groupBy("lang", "gid", "z", "blocks", "p").agg(F.count("*").alias("k"))
    facing = _facing(same, sources)
    forth = facing.groupBy("lang", "gid", "other").agg(F.sum(F.col("k") * (_f("p", "zo") - _f("z", "zo"))).alias("value"), F.sum(F.col("k") * (_f("zo", "p") - _f("zo", "z"))).alias("back"))
    return forth.select("lang", "gid", "other", F.explode(F.array(F.struct("gid", "other", "value"), F.struct(F.col("other").alias("gid"), F.col("gid").alias("other"), F.col("back").alias("value")))).alias("x")).select("lang", "x.*")


def _pair_sums(term: np.ndarray, left: tuple, right: tuple, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of corrections over pairs of postings of equal terms: ids of both sources and the sum.

    left and right: gid, p and z of the postings of a block and of all sources,
    both sorted by term. Pairs are expanded ``pairs`` at a time.
    """
    (lt, lg, lp, lz), (rt, rg, rp, rz) = left, right
    first, last = np.searchsorted(rt, lt, "left"), np.searchsorted(rt, lt, "right")
    width = last - first
    ids_l, at_l = np.unique(lg, return_inverse=True)
    ids_r, at_r = np.unique(rg, return_inverse=True)
    total = np.zeros(len(ids_l) * len(ids_r), np.int64)
    ends = np.cumsum(width)
    start = 0
    while start < len(lt):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + pairs, "right")))
        own = np.repeat(np.arange(start, stop), width[start:stop])
        before = np.repeat(ends[start:stop] - width[start:stop] - (ends[start - 1] if start else 0), width[start:stop])
        other = first[own] + np.arange(len(own)) - before
        p, z, q, y = lp[own], lz[own], rp[other], rz[other]
        f = lambda a, b: (a - b) * (a - b) // b
        np.add.at(total, at_l[own] * len(ids_r) + at_r[other], f(p, q) - f(p, y) - f(z, q) + f(z, y))
        start = stop
    hit = np.flatnonzero(total)
    a, b = ids_l[hit // max(1, len(ids_r))], ids_r[hit % max(1, len(ids_r))]
    apart = a != b
    return a[apart], b[apart], total[hit][apart]


def two_sided(postings: DataFrame, each: int = POSTINGS, pairs: int = PAIRS) -> DataFrame:
    """Corrections for what both sources have: lang, gid, other, value, partial sums of buckets of terms.

    postings: lang, term, gid, blocks, p, z.
    """
    buckets = max(1, -(-postings.count() // each))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets))
    dealt = postings.select("lang", bucket.alias("bucket"), F.xxhash64("term").alias("term"), F.crc32(F.encode("term", "UTF-8")).alias("more"), "gid", "p", "z", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        order = group.sort_by([("term", "ascending"), ("more", "ascending"), ("gid", "ascending")])
        term, more, gid, p, z = (order.column(c).to_numpy() for c in ("term", "more", "gid", "p", "z"))
        number = np.cumsum(np.r_[0, (np.diff(term) != 0) | (np.diff(more) != 0)]) if len(term) else term
        own = gid // BLOCK == key[2].as_py()
        a, b, value = _pair_sums(number, (number[own], gid[own], p[own], z[own]), (number, gid, p, z), pairs)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "gid": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "value": pa.array(value, pa.int64())})

    return dealt.groupBy("lang", "bucket", "block").applyInArrow(run, "lang string, gid long, other long, value long")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, each: int = POSTINGS) -> DataFrame:
    """lang, source, part, item, value, rank: divergence of each pair of sources of a language, and the terms that mark a source against its language."""
    counts = materialize(term_counts(docs), "divergence-counts")
    index = materialize(inverted_index(counts, least), "divergence-index")
    kept = index.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    flat = index.select("lang", "term", "total", F.explode("postings").alias("x")).select("lang", "term", "total", "x.source", "x.count")
    sources = materialize(sources_of(counts, flat, kept), "divergence-sources")
    known = flat.join(sources, ["lang", "source"])
    postings = materialize(known.select("lang", "term", "source", "gid", "blocks", "z", _p("count", "n", "v").alias("p"), _p("total", "n_lang", "v").alias("q")), "divergence-postings")
    corrections = one_sided(postings, sources).unionByName(two_sided(postings, each))
    sums = corrections.groupBy("lang", "gid", "other").agg(F.sum("value").alias("correction"))
    base = _facing(sources, sources).select("lang", "source", "item", "gid", "other", F.coalesce(F.col("v") * _f("z", "zo"), F.lit(0)).alias("base"))
    pairs = base.join(sums, ["lang", "gid", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("base") + F.coalesce("correction", F.lit(0))).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and marking terms over all documents; nulls, ties, repeats and empty tables as the module states."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = rf"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select id, lang, source, unnest(w) as term from d),
kept as (select lang, term from t group by lang, term having count(distinct id) >= {LEAST}),
v as (select lang, count(*) as v from kept group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as c from t join kept using (lang, term) group by all),
n as (select lang, source, sum(c) as n from c group by all),
full_c as (select g.lang, g.source, kept.term, coalesce(c.c, 0) as c, coalesce(n.n, 0) as n, v.v from g join kept on kept.lang = g.lang join v on v.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term left join n on n.lang = g.lang and n.source = g.source),
p as (select lang, source, term, c, 1 + ({SCALE}::hugeint * (c + 1)) // (n + v) as p from full_c),
whole as (select lang, term, 1 + ({SCALE}::hugeint * (sum(c) + 1)) // (sum(sum(c)) over (partition by lang) + any_value(v)) as q from full_c group by lang, term),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, (p - q) * (p - q) // q as value from p join whole using (lang, term) where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= {TOP}
"""
