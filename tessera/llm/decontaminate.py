"""Benchmark decontamination: a prefix-filtered set join, DataFrame functions only.

Words are maximal runs of characters other than ASCII non-alphanumerics,
after lower-casing A-Z. Each benchmark item is cut into windows of ``WINDOW``
consecutive words (an item of fewer words, but not none, is one window). The
shingles of a window are ordered by rarity among all windows; exact
containment has a prefix of one token, so only the rarest shingle of each
window, with its place in the window, is joined with the shingles of the
documents. The place fixes where the window would start; bounds of length and
position and then the equality of all words decide.

The prefix tokens are broadcast only if they are proven to be few
(``BROADCAST_ROWS``); else both sides are shuffled by token, and each
document row carries just the words around it. Frequent tokens cause rows in
proportion to their occurrences, never pairs of documents.

Defined results: null texts have no words (no hits; digest of an empty
string); an item without words has no window; an item with a null id makes
words hit but is not counted or listed; repeated item rows count once; each
repeated document row gives its row; empty tables work; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD_GAP, ascii_words, materialize, numbered, pick, row_key, table

WINDOW = 10
#: Words in a shingle; windows of fewer words are their own shingle.
SHINGLE = 5
#: At most so many prefix tokens (of some 300 bytes) are broadcast.
BROADCAST_ROWS = 200_000


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows: words, how many, and the ids of their items."""
    items = pick(benchmark, item_id="item_id", text="text").select("item_id", ascii_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - size))
    cut = items.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s") + 1, size).alias("window"))
    return cut.groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def prefix_tokens(windows: DataFrame) -> DataFrame:
    """Each window with its rarest shingle: k words at offset ``at`` and their hash ``token``."""
    k = F.least(F.lit(SHINGLE), F.size("window"))
    shingles = windows.select("window", "items", k.alias("k"), F.explode(F.sequence(F.lit(0), F.size("window") - k)).alias("at"))
    shingles = shingles.withColumn("token", _token(F.slice("window", F.col("at") + 1, F.col("k"))))
    rarity = shingles.groupBy("token").agg(F.count("*").alias("seen"))
    best = F.min_by(F.struct("k", "at", "token", "items"), F.struct("seen", "token", "at")).alias("p")
    return shingles.join(rarity, "token").groupBy("window").agg(best).select("window", F.size("window").alias("length"), "p.*")


def _token(words):
    return F.xxhash64(F.array_join(words, " "))


def _token_at(k: int):
    """The hash of the k words at ``pos`` of ``words``, null past the end."""
    own = [F.get("words", F.col("pos") + i) for i in range(k)]
    whole = F.concat_ws(" ", *own) if k > 1 else own[0]
    return F.when(F.col("pos") + k <= F.size("words"), F.xxhash64(whole))


def occurrences(docs: DataFrame, tokens: DataFrame, *, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Verified places of windows of at most ``window`` words: document key, start, length, items. docs: doc_id, key, words."""
    known = tokens.groupBy("k").agg(F.count("*").alias("n")).collect()  # at most SHINGLE rows
    few = sum(r.n for r in known) <= broadcast_rows
    side = F.broadcast(tokens) if few else tokens
    found = None
    for k in sorted(r.k for r in known):
        own = docs.select("doc_id", "key", "words", F.posexplode_outer("words").alias("pos", "word"))  # outer: no filter is inferred that would split the text twice
        own = own.withColumn("token", _token_at(k)).where("token is not null").drop("word")
        if few:
            joined = own.join(side.where(F.col("k") == k), "token")
            start = F.col("pos") - F.col("at")
            base = F.lit(0)
        else:  # rows are shuffled: carry the words a window can reach, not the document
            base = F.greatest(F.lit(0), F.col("pos") - window)
            own = own.select("doc_id", "key", "token", "pos", base.alias("base"), F.size("words").alias("n"), F.slice("words", base + 1, 2 * window + SHINGLE).alias("words"))
            joined = own.join(side.where(F.col("k") == k), "token")
            start, base = F.col("pos") - F.col("at"), F.col("base")
        inside = start - base
        fits = (inside >= 0) & (inside + F.col("length") <= F.size("words"))
        same = F.slice("words", F.greatest(F.lit(0), inside) + 1, F.col("length")) == F.col("window")
        hits = joined.where(fits & same).select("doc_id", "key", start.alias("start"), "length", "items")
        found = hits if found is None else found.unionByName(hits)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    own = pick(docs, doc_id="doc_id", text="text").select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), ascii_words(F.col("text")).alias("words"))
    hits = occurrences(own, prefix_tokens(benchmark_windows(benchmark, window)), window=window, broadcast_rows=broadcast_rows)
    counts = own.select("doc_id", "key", F.size("words").cast("long").alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    if hits is None:  # no benchmark
        return counts.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    start_end = F.struct(F.col("start").alias("s"), (F.col("start") + F.col("length")).alias("e"))
    per = hits.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(start_end)).alias("spans"), F.collect_set("items").alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["e"]))).alias("n"), F.greatest(a["e"], x["e"]).alias("e")),
        lambda a: a["n"].cast("long"),
    )
    items = F.array_sort(F.array_distinct(F.flatten("items")))
    per = per.select(F.col("doc_id").alias("hit_doc"), F.col("key").alias("hit_key"), covered.alias("n_hit"), items.alias("items"))
    joined = counts.join(per, counts.doc_id.eqNullSafe(per.hit_doc) & (counts.key == per.hit_key), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and items of all documents; nulls, repeats and empty tables as the module states."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every row whose text holds a benchmark window; the columns stay, whatever their names.

    Rows are told apart by the hash of id and text: equal rows go or stay
    together. Null and empty texts stay; an empty benchmark drops nothing.
    """
    own, columns = numbered(docs)
    key = row_key(own[columns["doc_id"]], own[columns["text"]])
    words = own.select(F.col(columns["doc_id"]).alias("doc_id"), key.alias("key"), ascii_words(F.col(columns["text"])).alias("words"))
    hits = occurrences(words, prefix_tokens(benchmark_windows(table(spark, sf_dir, "benchmark"))))
    if hits is None:
        return docs
    bad = materialize(hits.select("key").distinct(), "contaminated")
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return own.withColumn("key", key).join(bad, "key", "left_anti").drop("key").toDF(*docs.columns)


_SQL_WORDS = f"[x for x in regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_GAP}') if x <> '']"
ORACLE = f"""
with d as (select row_number() over () as rid, doc_id, {_SQL_WORDS} as w from documents),
b as (select item_id, {_SQL_WORDS} as w from benchmark),
win as (
  select distinct item_id, list_slice(w, s + 1, s + {WINDOW}) as win
  from (select item_id, w, unnest(range(0, greatest(1, len(w) - {WINDOW - 1}))) as s from b where len(w) > 0)
), firsts as (select distinct win[1] as word from win),
lens as (select distinct len(win) as n from win),
p as (select rid, w, unnest(range(1, len(w) + 1)) as i from d),
cand as (select p.rid, p.i, n, list_slice(w, p.i, p.i + n - 1) as win from p join firsts on p.w[p.i] = firsts.word cross join lens where p.i + n - 1 <= len(p.w)),
hit as (select c.rid, c.i, c.n, win.item_id from cand c join win on c.win = win.win),
spread as (select distinct rid, unnest(range(i, i + n)) as at from hit),
n_hit as (select rid, count(*) as n_hit from spread group by rid),
items as (select rid, count(*) as n_items, string_agg(t, ',' order by t) as ids from (select distinct rid, cast(item_id as varchar) as t from hit where item_id is not null) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n_hit using (rid) left join items using (rid)
"""
