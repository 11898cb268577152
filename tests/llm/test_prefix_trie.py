"""The conversation trie against plain Python: shared openings, long runs, repeats, ties, nulls, empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import prefix_trie
from tessera.llm.common import materialize

SCHEMA = "conv_id long, turn long, role string, text string, depth string, Node int"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def turns_of(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(own)] for c, own in out.items()}


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[h:]
    return out


def brute(turns):
    nodes = defaultdict(lambda: {"members": [], "ends": [], "children": set()})
    for c in sorted(turns):
        own = turns[c]
        for d in range(len(own) + 1):
            node = nodes[tuple(own[:d])]
            node["members"].append(c)
            if d:
                nodes[tuple(own[: d - 1])]["children"].add(tuple(own[:d]))
        nodes[tuple(own)]["ends"].append(c)
    totals = {}
    for key in sorted(nodes, key=len, reverse=True):
        node = nodes[key]
        saved = (len(node["members"]) - 1) * (len(key[-1][1]) if key else 0)
        totals[key] = (sum(totals[k][0] for k in node["children"]) or 1, saved + sum(totals[k][1] for k in node["children"]))
    return sorted(
        (n["members"][0], len(k), nodes[k[:-1]]["members"][0] if k else None, len(n["members"]), len(n["children"]), *totals[k], hashlib.sha256(",".join(map(str, n["ends"])).encode()).hexdigest())
        for k, n in nodes.items()
    )


def varied(seed, n=120, base=0):
    dice = random.Random(seed)
    rows = []
    for c in range(base, base + n):
        for t in range(dice.randrange(0, 7)):
            rows.append((c, t, dice.choice(["user", "assistant", None]), dice.choice(["a", "b", "café \U0001f600", "", None])))
    return rows


CASES = {
    "varied": varied(1) + varied(2, 60, 200) + [(None, 0, "user", "lost"), (100, None, "user", "first"), (100, 0, "user", "again"), (100, 0, "user", "again")],
    "copies": [(c, t, "user", f"same {t}") for c in range(50) for t in range(5)] + [(50, t, "user", f"same {t}") for t in range(9)],
    "long run": [(7, t, "user", f"x{t % 3}") for t in range(400)] + [(8, t, "user", f"x{t % 3}") for t in range(170)],
    "one root child": [(7, 0, "a", "bb")],
    "negative ids": [(c, t, "u", f"{c % 2}{t}") for c in range(-130, -90) for t in range(3)],
}


def found(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("case", CASES)
def test_trie_of_rebuilt_conversations_equals_plain_python(spark, case):
    turns = materialize(prefix_trie.ordered_turns(conversations(spark, CASES[case])), "test-turns")
    assert found(prefix_trie.trie(prefix_trie.shared_openings(turns), turns.where("at = 0").select("conv_id"))) == brute(rebuilt(turns_of(CASES[case])))


def test_small_blocks_and_runs_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = CASES["copies"] + CASES["long run"]
    assert found(prefix_trie.conversation_trie(conversations(spark, rows), block=4)) == brute(turns_of(rows))


def test_empty_table_has_no_node(spark):
    assert found(prefix_trie.conversation_trie(conversations(spark, []))) == []


def test_long_runs_take_few_rounds(spark):
    n = 3000
    single = spark.range(n).selectExpr("named_struct('a', id, 'b', 0L) as node", "named_struct('a', id - 1, 'b', 0L) as parent", "id as depth", "named_struct('a', id + 1, 'b', 0L) as next", "1L as saved")
    calls = []
    real = prefix_trie.materialize
    prefix_trie.materialize = lambda df, name: calls.append(name) or real(df, name)
    try:
        ends = prefix_trie.contracted(single)
    finally:
        prefix_trie.materialize = real
    assert len(calls) <= 13 and ends.where(f"end.a = {n} and saved = {n} - node.a").count() == n
