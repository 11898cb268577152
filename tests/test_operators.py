"""Operators on small literal tables: ties, cycles, empty inputs, nulls."""

import random
from difflib import SequenceMatcher
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import claims as cl
from tessera.operators import diff, edges, graph, history, layout, metrics, moves, review
from tessera.plans import analysis


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def collected(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def covers(pattern, module, package):
    if ":" in pattern:
        return False
    if not pattern.endswith(".*"):
        return pattern == module
    head, own = pattern[:-2], package or module
    return module == head or own == head or own.startswith(head + ".")


def test_claims_match_the_plain_predicate_on_random_cases(spark):
    dice = random.Random(7)
    names = ["a", "ab", "a.b", "a.b.c", "a.bc", "b", "b.a"]
    modules = [(f"{n}.m{i}" if dice.random() < 0.7 else f"{n}{i}", dice.choice([None, "", n, n + ".x"])) for i, n in enumerate(names * 6)]
    patterns = [(f"c{i}", i, dice.choice([f"{h}.*", h, f"{h}:s", dice.choice(modules)[0]])) for i, h in enumerate(names * 4)]
    found = cl.matches(frame(spark, "id string, pos long, pattern string", patterns), frame(spark, "module string, package string", modules))
    assert collected(found, "id", "module") == sorted({(c, m) for c, _, p in patterns for m, k in modules if covers(p, m, k)})


def test_first_claim_in_model_order_owns(spark):
    claims = frame(spark, "id string, pos long, pattern string", [("B", 2, "p.*"), ("A", 1, "p.m"), ("A", 1, "p.m")])
    modules = frame(spark, "module string, package string, empty_marker boolean", [("p.m", "p", False), ("p.n", "p", False), ("q.z", "q", False), ("q.e", "q", True)])
    assert collected(cl.owners(claims, modules), "module", "owner") == [("p.m", "A"), ("p.n", "B")]
    states = cl.coverage(claims, modules, modules.where("module = 'p.m'"))
    assert collected(states, "module", "state") == [("p.m", "claimed twice"), ("p.n", "mapped"), ("q.e", "mapped"), ("q.z", "unmapped")]


def test_import_rules_have_three_results(spark):
    modules = frame(spark, "module string, parsed boolean, unresolved array<string>", [("a", True, []), ("b", True, []), ("c", False, []), ("d", True, None), ("e", True, [])])
    owned = frame(spark, "module string, owner string", [("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")])
    uses = frame(spark, "module string, target string", [("a", "b"), ("a", "a"), ("b", "e")])
    rules = frame(spark, "id string, kind string, src array<string>, dst array<string>", [
        ("1", "forbid_import", ["A"], ["B"]), ("2", "forbid_import", ["B"], ["A"]), ("3", "forbid_import", ["C"], ["A"]),
        ("4", "forbid_import", ["D"], ["A"]), ("5", "allow_imports", ["A"], ["B"]), ("6", "allow_imports", ["B"], ["A"]), ("7", "allow_imports", ["A"], ["C"])])
    found = edges.rule_outcomes(rules, uses, owned, modules)
    assert collected(found, "id", "result") == [("1", "fail"), ("2", "pass"), ("3", "unknown"), ("4", "unknown"), ("5", "pass"), ("6", "unknown"), ("7", "fail")]


def test_graph_on_cycles_and_empty_graphs(spark):
    g = frame(spark, "src string, dst string", [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("e", "f")])
    assert collected(graph.cycle_edges(g), "src", "dst") == [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")]
    assert collected(graph.strongly_connected(g), "node", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "f")]
    seen, hops = graph.bfs(g, frame(spark, "node string", [("a",)]), 5)
    assert collected(seen, "node", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert ("c", "a", 3) in collected(hops, "src", "dst", "depth") and ("d", "d", 4) in collected(hops, "src", "dst", "depth")
    assert graph.reach(g.limit(0)).count() == 0
    nodes = frame(spark, "node string", [(x,) for x in "abcdefg"])
    assert collected(graph.connected(nodes, g), "node", "component") == [(x, "a") for x in "abcd"] + [("e", "e"), ("f", "e"), ("g", "g")]


def test_chains_end_and_loops_are_null(spark):
    links = frame(spark, "node string, next string", [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("w", "x"), ("s", "s")])
    assert dict((r.node, r.end) for r in graph.follow(links).collect()) == {"a": "d", "b": "d", "c": "d", "x": None, "y": None, "w": None, "s": None}


def test_drift_and_keyed_comparison(spark):
    a = frame(spark, "k string, sha string, n int", [("1", "x", 1), ("2", "x", 1), ("3", "x", 1), ("4", "x", None)])
    b = frame(spark, "k string, sha string, n int", [("2", "y", 1), ("3", "x", 2), ("4", "x", None), ("5", "x", 1)])
    assert collected(diff.drift(a, b, "k", "sha", ["n"]), "k", "change") == [("1", "gone"), ("2", "changed"), ("3", "derived"), ("5", "added")]
    assert collected(diff.keyed(a, b, ["k"], ["sha", "n"]), "k", "how", "fields") == [("1", "removed", ""), ("2", "changed", "sha"), ("3", "changed", "n"), ("5", "added", "")]


def test_jaccard_of_two_empty_sets_is_zero(spark):
    row = spark.range(1).select(diff.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j")).first()
    assert row.j == 0


def naive_moves(gone, new):
    def name(m):
        return m["file"].split("/")[-1]

    def common(a, b):
        n = 0
        for x, y in zip(a, b):
            if x != y:
                break
            n += 1
        return n

    def alike(a, b):
        return SequenceMatcher(None, name(a), name(b)).ratio()

    asks = [
        lambda a, b: a["sha"] == b["sha"] and (a["names"] or name(a) == name(b)),
        lambda a, b: a["names"] and sorted(a["names"]) == sorted(b["names"]) and alike(a, b) >= 0.6,
        lambda a, b: a["names"] and b["names"] and len(set(a["names"]) & set(b["names"])) / len(set(a["names"]) | set(b["names"])) >= 0.8 and alike(a, b) >= 0.6,
    ]
    out, taken = {}, set()
    for how, ask in zip(moves.HOW, asks):
        pairs = []
        for a in gone:
            for b in new:
                if a["module"] not in out and b["module"] not in taken and ask(a, b):
                    x, y = a["file"].split("/"), b["file"].split("/")
                    pairs.append((-common(x[::-1], y[::-1]), -int(alike(a, b) * 1000), -common(x, y), a["module"], b["module"]))
        for *_, old, cand in sorted(pairs):
            if old not in out and cand not in taken:
                out[old] = (cand, how)
                taken.add(cand)
    return {(o, c, h) for o, (c, h) in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_moves_equal_the_greedy_assignment(spark, seed):
    dice = random.Random(seed)
    words = ["route", "routing", "view", "views", "store"]

    def some(n, tag):
        return [{"module": f"{tag}{i}", "sha": dice.choice("abcdefgh"), "names": dice.sample(["A", "B", "C", "D", "E", "F"], dice.choice([0, 1, 5, 6])), "file": f"{dice.choice('xy')}/{dice.choice('pq')}/{dice.choice(words)}.py"} for i in range(n)]

    gone, new = some(9, "o"), some(9, "n")
    schema = "module string, sha string, names array<string>, file string"
    as_rows = lambda ms: [(m["module"], m["sha"], m["names"], m["file"]) for m in ms]
    found = moves.find(frame(spark, schema, as_rows(gone)), frame(spark, schema, as_rows(new)))
    assert {tuple(r) for r in found.select("old", "new", "how").collect()} == naive_moves(gone, new)


def test_first_choices_equal_all_pairs():
    """The bound by letters skips no pair: blocks of any size give the first choice among all pairs that no better one holds."""
    dice = random.Random(5)
    path = lambda: "/".join([dice.choice("xy"), dice.choice("pq"), "".join(dice.choice("abcd_") for _ in range(dice.randrange(6))) + ".py"])
    for least in (0.0, 0.6):
        olds, cands = [(f"o{i}", path()) for i in range(12)], [(f"n{i:02}", path()) for i in range(15)]

        def place(f, g):
            x, y = f.split("/"), g.split("/")
            same = lambda p, q: next((i for i, (s, t) in enumerate(zip(p, q)) if s != t), min(len(p), len(q)))
            return int(moves._place(same(x[::-1], y[::-1]), int(SequenceMatcher(None, x[-1], y[-1]).ratio() * 1000), same(x, y)))

        held = [(place(dice.choice(olds)[1], g), dice.choice(["n", "o3", "p"])) if dice.random() < 0.4 else (None, None) for _, g in cands]
        want = []
        for o, f in olds:
            asked = [(place(f, g), c) for (c, g), (h, holder) in zip(cands, held) if SequenceMatcher(None, f.split("/")[-1], g.split("/")[-1]).ratio() >= least and (h is None or (place(f, g), o) < (h, holder))]
            want += [(o, c, p) for p, c in [min(asked)]] if asked else []
        assert moves.first_choices(*map(list, zip(*olds)), *map(list, zip(*cands)), *map(list, zip(*held)), least) == want


@pytest.mark.parametrize("seed", range(3))
def test_moves_of_one_key_in_many_blocks(spark, seed, monkeypatch):
    """Modules of one content or one list of names that compete, in blocks of two: candidates change hands over several rounds."""
    monkeypatch.setattr(moves, "BLOCK", 2)
    dice = random.Random(seed)

    def some(n, tag):
        return [{"module": f"{tag}{i}", "sha": dice.choice(f"ab{tag}"), "names": dice.choice([[], ["A", "B"], ["A", "B"], ["C"]]), "file": f"{dice.choice('xy')}/{dice.choice('pq')}/{dice.choice(['', 'old_'])}hot_{dice.randrange(30)}.py"} for i in range(n)]

    gone, new = some(14, "o"), some(11, "n")
    schema = "module string, sha string, names array<string>, file string"
    as_rows = lambda ms: [(m["module"], m["sha"], m["names"], m["file"]) for m in ms]
    found = moves.find(frame(spark, schema, as_rows(gone)), frame(spark, schema, as_rows(new)))
    assert {tuple(r) for r in found.select("old", "new", "how").collect()} == naive_moves(gone, new)


def test_module_moves_asks_all_questions(spark):
    """The query and its statement assign by content, by names and by most of the names, as the plain walk does."""
    import duckdb

    dice = random.Random(11)
    words = ["route", "routing", "view", "views", "store"]

    def some(n, tag):
        return [{"module": f"{tag}{i}", "sha": dice.choice("abcdefgh"), "names": dice.sample(["A", "B", "C", "D", "E", "F"], dice.choice([0, 1, 5, 6])), "file": f"{dice.choice('xy')}/{dice.choice('pq')}/{dice.choice(words)}.py"} for i in range(n)]

    gone, new = some(15, "o"), some(15, "n")
    as_rows = lambda ms: [(m["module"], m["sha"], m["names"], m["file"]) for m in ms]
    schema = "module string, sha string, names array<string>, file string"
    want = naive_moves(gone, new)
    assert {how for *_, how in want} == set(moves.HOW)
    tables = SimpleNamespace(base_modules=frame(spark, schema, as_rows(gone)), modules=frame(spark, schema, as_rows(new)))
    assert {tuple(r) for r in analysis.module_moves(tables).select("old", "new", "how").collect()} == want
    con = duckdb.connect()
    for name, rows in (("base_modules", gone), ("modules", new)):
        con.sql(f"create table {name} (module varchar, sha varchar, names varchar[], file varchar)")
        con.executemany(f"insert into {name} values (?, ?, ?, ?)", as_rows(rows))
    assert set(con.sql("with " + analysis._MOVES.removeprefix("+ ")).fetchall()) == want


def test_gap_sampling_keeps_the_head(spark):
    import datetime

    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    rows = [(i, day(d)) for i, d in enumerate([0, 0, 2, 3, 4, 7, 8])]
    kept = history.gap_sample(frame(spark, "seq long, day date", rows), 3)
    assert [r[0] for r in collected(kept, "seq")] == [0, 3, 5, 6]


def test_metrics_on_ties_and_missing_classes(spark):
    rows = frame(spark, "p double, label boolean", [(0.5, True), (0.5, False), (0.9, True), (0.1, False)])
    assert metrics.auc(rows).first().auc == pytest.approx(0.875)
    assert metrics.auc(rows.where("label")).first().auc is None
    clusters = frame(spark, "truth string, guess string", [("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")])
    one = metrics.pairwise(clusters).first()
    assert (one.precision, one.recall) == (pytest.approx(1 / 3), pytest.approx(1 / 2))


def test_verdicts_count_to_their_limits(spark):
    seq = ["contradicted", "insufficient", "contradicted", "contradicted", "supported", "insufficient", "insufficient"]
    found = review.verdict_states(frame(spark, "key string, seq int, verdict string", [("k", i, v) for i, v in enumerate(seq)]))
    assert [r.state for r in found.orderBy("seq").collect()] == ["contradicted", "insufficient", "contradicted", "unknown", "supported", "insufficient", "unknown"]


def test_submission_is_all_or_nothing(spark):
    requests = frame(spark, "id string", [("a",), ("b",)])
    good = review.submit(requests, frame(spark, "id string, verdict string", [("a", "supported"), ("b", "contradicted")]))
    assert {r.accepted for r in good.collect()} == {True}
    bad = review.submit(requests, frame(spark, "id string, verdict string", [("a", "supported"), ("z", "supported")]))
    assert {r.accepted for r in bad.collect()} == {False}


def test_boxes_meet_once_whatever_cells_they_share(spark):
    dice = random.Random(3)
    boxes = [("g", i, dice.randrange(200), dice.randrange(200), dice.randrange(1, 90), dice.randrange(1, 90)) for i in range(60)]
    found = layout.overlapping_boxes(frame(spark, "by string, id int, x int, y int, w int, h int", boxes), 40)
    want = set()
    for _, i, x, y, w, h in boxes:
        for _, j, u, v, a, b in boxes:
            wide, high = min(x + w, u + a) - max(x, u), min(y + h, v + b) - max(y, v)
            if i < j and wide > 0 and high > 0:
                want.add((i, j, wide * high))
    assert {tuple(r) for r in found.select("a", "b", "area").collect()} == want and found.count() == len(want)


def test_scalars(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column.alias("v")).first().v

    lit = F.lit
    assert sorted(value(t.words(lit("HTTPServer_fooBar2")))) == ["bar2", "foo", "http", "server"]
    assert value(t.share_a_word(F.array(lit("route")), F.array(lit("router")))) and not value(t.share_a_word(F.array(lit("rou")), F.array(lit("router"))))
    assert value(t.first_sentence(lit("  One\n two.  Three. "))) == "One two."
    assert value(t.first_sentence(lit(None).cast("string"))) == ""
    assert value(t.mentioned(lit("Core"), lit("the core, here"))) and not value(t.mentioned(lit("core"), lit("hard-core")))
    assert value(t.camel(lit("root.my_mod.sub"))) == "MyModSub"
    assert value(t.module_of(lit("src/pkg/__init__.py"), "src")) == "pkg"
    assert value(t.ref_module(lit("a.b:Sym@123"))) == "a.b"
    assert value(t.printable(lit("a\tb"))) == "a\\x09b"
    assert value(t.headings(lit("# A\n## B c \ntext\n## D"))) == ["B c", "D"]
    assert value(t.identifier_at(lit("Class.method(x)"))) == "Class.method"
    assert value(t.common_parent(F.array(lit("a/b/c.py"), lit("a/b/d/e.py")))) == "a/b"
    assert value(t.polyline_length(F.array(lit(0.0), lit(3.0), lit(3.0)), F.array(lit(0.0), lit(0.0), lit(4.0)))) == 7
    import re

    assert re.match(t.glob_pattern("src/**/*.py"), "src/a/b/c.py") and not re.match(t.glob_pattern("*.py"), "a/b.py")
