"""Conversation prefix trie: subtree totals by leaf-peeling message passing.

A node is a distinct sequence of first d turns of conversations. Its key is
the sum, over the turns before it, of hashes of (place, role, text) in four
lanes of 31 bits: a running sum over a conversation, so no list of a
conversation's turns is ever held, and conversations with the same first turns
get the same key. Counts of members are aggregated before they are shuffled,
so a first turn that a third of all conversations share is no hot task.

Totals go from the leaves to the root. Each node holds a counter of children
that have not finished; a node at zero has finished and sends its totals to
its parent, summed on the way; rounds end when only the root has finished.
Runs of nodes with one child each (the tail of any long conversation) would
take a round a node, so they are contracted first by doubling pointers: a run
of n nodes takes log2(n) rounds, and peeling takes as many rounds as there are
branchings above each other. Each round's state is a table in the shared
folder. Nodes inside a run read their totals off the end of the run.

Ids of the members that end at a node are hashed in numerical order as a
stream: sorted runs of ids are joined to strings in many tasks, so that the
task with the hash state of a node with very many copies reads few rows.

Defined results: turns go by (turn, role, text), null turns first; null role
or text is empty; repeated rows count each; rows with a null conv_id are no
conversation; a conversation whose rebuilt form has no turns ends at the root;
an empty table has no node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pick, shared_path, table, unique_join

MASK = (1 << 31) - 1
#: Members in one string of ids, and places of a conversation in one block of a running sum.
RUN, BLOCK = 10_000, 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, number: str, order: list, sums: dict, block: int = BLOCK) -> DataFrame:
    """rows with each column of ``sums`` added up over the rows of their conversation up to themselves.

    Sums are taken within blocks of ``number``; only conversations with more
    than one block have a second level, so no task gets a long one whole.
    """
    cut = rows.withColumn("_block", F.coalesce(F.floor(F.col(number) / block), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv_id", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = materialize(cut.withColumns({f"_r_{new}": F.sum(old).over(inside) for new, old in sums.items()}), "trie-blocks")
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("conv_id", "_block").agg(*[F.max(f"_r_{new}").alias(new) for new in sums])  # no summand is negative
    offsets = totals.select("conv_id", "_block", *[F.sum(new).over(before).alias(f"_o_{new}") for new in sums]).where(f"_o_{next(iter(sums))} is not null")
    told = local.join(offsets, ["conv_id", "_block"], "left")
    return told.select(*rows.columns, *[(F.col(f"_r_{new}") + F.coalesce(f"_o_{new}", F.lit(0))).alias(new) for new in sums])


def ordered_turns(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, at (place from 0), turn_hash (of role and text, 128 bits), chars (code points of the text); texts go no further."""
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    own = rows.select("conv_id", "turn", role.alias("role"), told.alias("turn_hash"), F.length(text).cast("long").alias("chars"), F.substring(text, 1, 64).alias("head"))
    order = [F.col("turn").asc_nulls_first(), "role", "head", "turn_hash"]
    return running(own, "turn", order, {"place": F.lit(1).cast("long")}, block).select("conv_id", (F.col("place") - 1).alias("at"), "turn_hash", "chars")


def shared_openings(turns: DataFrame, block: int = 100, modulus: int = 6) -> DataFrame:
    """Conversations rebuilt: the first h turns of the first conversation of their block, then their own turns after the first h; h = crc32(id) % modulus.

    Returns conv_id, depth (from 1), turn_hash, chars.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus
    openings = turns.where(F.col("at") < modulus - 1).where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), "at", "turn_hash", "chars")
    lengths = openings.groupBy("base").agg(F.count("*").alias("n"))
    ids = turns.where("at = 0").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    ids = ids.join(lengths, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("n", F.lit(0))).alias("taken"))
    first = ids.join(openings, "base").where("at < taken").select("conv_id", (F.col("at") + 1).alias("depth"), "turn_hash", "chars")
    rest = turns.join(ids, "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("depth"), "turn_hash", "chars")
    return first.unionByName(rest)


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each turn of each conversation: depth, chars, the key of the node it leads to and of the node before. turns: conv_id, depth, turn_hash, chars."""
    hashes = [F.xxhash64(F.lit(i), "depth", "turn_hash") for i in range(2)]
    lanes = [lane for h in hashes for lane in (h.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(h, 33))]
    own = turns.withColumns({f"h{i}": lane for i, lane in enumerate(lanes)})
    summed = running(own, "depth", ["depth"], {f"s{i}": F.col(f"h{i}") for i in range(4)}, block)

    def key(lane):
        return F.struct(*[F.shiftleft(lane(i).bitwiseAND(F.lit(MASK)), 31).bitwiseOR(lane(i + 1).bitwiseAND(F.lit(MASK))).alias(name) for i, name in ((0, "a"), (2, "b"))])

    return summed.select("conv_id", "depth", "chars", key(lambda i: F.col(f"s{i}")).alias("node"), key(lambda i: F.col(f"s{i}") - F.col(f"h{i}")).alias("parent"))


def _root():
    return F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))


def nodes_of(paths: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes below the root and the root: node, parent (null for the root), depth, chars, conv_id, n_convs."""
    own = paths.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    return own.unionByName(root.select(_root().alias("node"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), zero.alias("depth"), zero.alias("chars"), "conv_id", "n_convs"))


def contracted(single: DataFrame) -> DataFrame:
    """Runs of nodes with one child: node, parent, depth, end (the first node that is no part of the run) and saved (summed from node to before the end).

    single: node, parent, depth, next, saved. Doubling: each round a node's
    pointer takes its target's pointer, until no target is part of a run.
    """
    state = single.select("node", "parent", "depth", F.col("next").alias("end"), "saved", F.lit(True).alias("open"))
    while not state.where("open").isEmpty():
        ahead = state.select(F.col("node").alias("end"), F.col("end").alias("further"), F.col("saved").alias("more"), F.col("open").alias("goes_on"))
        moved = state.where("open").drop("open").join(ahead, "end", "left").select(
            "node", "parent", "depth", F.coalesce("further", "end").alias("end"), (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), F.coalesce("goes_on", F.lit(False)).alias("open")
        )
        state = materialize(moved.unionByName(state.where("not open")), "trie-runs")
    return state.drop("open")


def peeled(tree: DataFrame) -> DataFrame:
    """Totals of each node over its subtree: node, n_leaves, saved_tokens.

    tree: node, parent, remaining (children), saved (its own), carried (what
    the run above it saves, which goes to the parent with its totals). A round
    takes the nodes without unfinished children and sends their sums to the
    parents; a node with none left stands in one round's table only.
    """
    spark, rounds, zero = tree.sparkSession, [], F.lit(0)
    leaf = F.when(F.col("remaining") == 0, 1).otherwise(0).cast("long")
    state = tree.select("node", "parent", "remaining", "carried", leaf.alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    while True:
        rounds.append(shared_path(spark, "trie-round"))
        state.write.parquet(rounds[-1])
        state = spark.read.schema(state.schema).parquet(rounds[-1])
        ready, waiting = state.where("remaining = 0"), state.where("remaining > 0")
        if waiting.isEmpty():
            return spark.read.schema(state.schema).parquet(*rounds).where("remaining = 0").select("node", "n_leaves", "saved_tokens")
        sent = ready.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("k"), F.sum("n_leaves").alias("leaves"), F.sum(F.col("saved_tokens") + F.col("carried")).alias("saved"))
        state = waiting.join(sent, "node", "left").select(
            "node", "parent", (F.col("remaining") - F.coalesce("k", zero)).alias("remaining"), "carried", (F.col("n_leaves") + F.coalesce("leaves", zero)).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("saved", zero)).alias("saved_tokens"),
        )


def ends_digest(ends: DataFrame) -> DataFrame:
    """node and sha: the SHA-256 of its conv_ids in numerical order, comma-joined. ends: node, conv_id."""
    flat = ends.select("node.a", "node.b", "conv_id")
    schema = "a long, b long, first long, ids string"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def flushed() -> None:
            if held:
                out.append((*key, held[0], ",".join(map(str, held))))
                held.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[i], pa.int64()) for i in range(3)] + [pa.array(columns[3], pa.string())], names=["a", "b", "first", "ids"])

        for batch in batches:
            for a, b, conv in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if key != (a, b) or len(held) == RUN:
                    flushed()
                key = (a, b)
                held.append(conv)
            if len(out) >= 1000:
                yield made()
        flushed()
        if out:
            yield made()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)]):
                if key != (a, b):
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield arrays(out)
        if key:
            yield arrays([(*key, state.hexdigest())])

    def arrays(rows: list[tuple]) -> pa.RecordBatch:
        a, b, sha = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha, pa.string())], names=["a", "b", "sha"])

    joined = flat.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(runs, schema)
    told = joined.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(hashed, "a long, b long, sha string")
    return told.select(F.struct("a", "b").alias("node"), "sha")


def trie(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of conversations, one row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth (from 1, without gaps), turn_hash, chars; ids: all conv_ids, each once.
    """
    paths = materialize(prefixes(turns, block), "trie-paths")
    nodes = materialize(nodes_of(paths, ids), "trie-nodes")
    families = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.min("node").alias("child"))
    saved = (F.col("n_convs") - 1) * F.col("chars")
    told = materialize(nodes.join(families, "node", "left").select(*nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), "child", saved.alias("saved")), "trie-counted")
    runs = contracted(told.where("n_children = 1").select("node", "parent", "depth", F.col("child").alias("next"), "saved"))
    # A node with several children or none hangs on what stands above its run, if it has one.
    tops = materialize(runs.groupBy("end").agg(F.min_by(F.struct("parent", "saved"), "depth").alias("top"), F.count("*").alias("copies")), "trie-tops")
    heads = told.where("n_children <> 1").join(tops.withColumnRenamed("end", "node"), "node", "left")
    above = F.when(F.col("copies").isNotNull(), F.col("top.parent")).otherwise(F.col("parent"))
    totals = peeled(heads.select("node", above.alias("parent"), F.col("n_children").alias("remaining"), "saved", F.coalesce("top.saved", F.lit(0)).alias("carried")))
    at_end = totals.withColumnRenamed("node", "end").join(tops, "end").select("end", "copies", F.struct("n_leaves", "saved_tokens").alias("total"))
    inside = unique_join(runs.select("node", "end", "saved"), at_end, ["end"], "copies", "total")
    whole = totals.unionByName(inside.select("node", F.col("total.n_leaves").alias("n_leaves"), (F.col("saved") + F.col("total.saved_tokens")).alias("saved_tokens")))
    ends = ids.join(paths.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node")), "conv_id", "left").select(F.coalesce("node", _root()).alias("node"), "conv_id")
    named = unique_join(told, told.select(F.col("node").alias("parent"), F.col("n_children").alias("children"), F.col("conv_id").alias("parent_conv_id")), ["parent"], "children", "parent_conv_id")
    return named.join(whole, "node").join(ends_digest(ends), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of conversations as they stand."""
    turns = ordered_turns(conversations, block)
    return trie(turns.select("conv_id", (F.col("at") + 1).alias("depth"), "turn_hash", "chars"), turns.where("at = 0").select("conv_id"), block)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with shared openings; nulls, ties, repeats and empty tables as the module states."""
    turns = materialize(ordered_turns(table(spark, sf_dir, "conversations")), "trie-turns")
    return trie(shared_openings(turns), turns.where("at = 0").select("conv_id"))


#: crc32 of a string, a bit at a time: a step of 256 or more shifts, any other mixes a byte in.
_SQL_CRC = """xor(4294967295, list_reduce([cast(4294967295 as bigint)] || flatten(list_transform(range(1, length(cast({0} as varchar)) + 1), lambda i: [cast(ascii(cast({0} as varchar)[i]) as bigint)] || [cast(x as bigint) for x in range(256, 264)])),
  lambda c, b: case when b < 256 then xor(c, b) when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"""
ORACLE = f"""
with own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as i, coalesce(role, '') as role, coalesce(text, '') as text
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)
), ids as (select conv_id, conv_id - conv_id % 100 as base, {_SQL_CRC.format("conv_id")} % 6 as h from (select distinct conv_id from own)),
rebuilt as (
  select ids.conv_id, own.i, own.role, own.text from ids join own on own.conv_id = ids.base where own.i < ids.h
  union all select ids.conv_id, own.i + 6, own.role, own.text from ids join own using (conv_id) where own.i >= ids.h
), placed as (select conv_id, row_number() over (partition by conv_id order by i) as d, role, text from rebuilt),
paths as (select conv_id, d, length(text) as chars, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by conv_id order by d)) as node from placed),
steps as (select conv_id, d, chars, node, coalesce(lag(node) over (partition by conv_id order by d), 'root') as parent from paths union all select conv_id, 0, 0, 'root', null from ids),
nodes as (select node, any_value(parent) as parent, any_value(d) as depth, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n_convs from steps group by node),
families as (select parent as node, count(*) as n from nodes where parent is not null group by parent),
below as (select distinct a.node, b.node as other from steps a join steps b on a.conv_id = b.conv_id and b.d >= a.d),
totals as (
  select below.node, sum(case when f.n is null then 1 else 0 end) as n_leaves, sum((n.n_convs - 1) * n.chars) as saved
  from below join nodes n on n.node = below.other left join families f on f.node = below.other group by below.node
), ends as (select node, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as sha from (select conv_id, max_by(node, d) as node from steps group by conv_id) group by node)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(f.n, 0) as n_children, cast(t.n_leaves as bigint) as n_leaves, cast(t.saved as bigint) as saved_tokens, coalesce(e.sha, sha256('')) as ends_sha256
from nodes n join totals t using (node) left join families f using (node) left join ends e using (node) left join nodes p on p.node = n.parent
"""
