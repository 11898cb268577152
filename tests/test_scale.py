"""Work that must not grow with the square of a group: plans without pairs or lists of a group, against plain results."""

import random

from pyspark.sql import functions as F

from tessera.bindings import Tables
from tessera.functions import text as t
from tessera.operators import layout, moves
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_common_parents_gather_no_files(spark):
    found = registry.queries()["common_parents"](spark, SF)
    assert "collect_list" not in plan(found)
    files = spark.createDataFrame([("a/b/c.py",), ("a/b-d/c.py",), ("a/bc/x/y.py",)], "file string")
    assert files.agg(t.common_parent(F.array(F.min("file"), F.max("file"))).alias("p")).first().p == "a"


def test_peaks_make_no_pairs(spark):
    dice = random.Random(3)
    spans = [(f"g{i % 3}", i, lo := dice.randrange(30), lo + dice.choice([0, 0, 1, 4, 9])) for i in range(200)] + [("alone", 900, 5, 5), ("two", 901, 1, 2), ("two", 902, 2, 3)]
    found = layout.peaks(spark.createDataFrame(spans, "by string, id long, lo long, hi long"), "by")
    real = {}
    for g, i, lo, hi in spans:
        n = sum(g == g2 and lo2 < hi and lo < hi2 for g2, _, lo2, hi2 in spans)
        real[g] = max(real.get(g, 0), n)
    assert rows(found, "by", "peak") == sorted((g, n) for g, n in real.items() if n)
    many = spark.range(60_000).selectExpr("'g' as by", "id", "id % 50 as lo", "id % 50 + 1 + id % 7 as hi")  # 3.6 billion pairs
    assert layout.peaks(many, "by").first().peak > 1200


def test_module_groups_join_no_package_with_itself(spark):
    found = registry.queries()["module_groups"](spark, SF)
    k = [(r.k, r.package) for r in Tables(spark, SF).modules.select("k", "package").collect()]
    least, last = {}, {}
    for n, package in sorted(k):
        before = last.get(package)
        least[n] = least[before] if before is not None and n - before < 40 else n
        last[package] = n
    assert rows(found, "node", "component") == sorted(least.items())


SIDE = "module string, sha string, names array<string>, file string"


def test_content_moves_ask_for_content_only(spark):
    gone = spark.createDataFrame([("a", "1", ["x", "y"], "p/a.py"), ("b", "2", ["x", "y"], "p/b.py")], SIDE)
    new = spark.createDataFrame([("c", "1", ["z"], "q/c.py"), ("d", "9", ["x", "y"], "q/b.py")], SIDE)
    assert rows(moves.find(gone, new, 1), "old", "new", "how") == [("a", "c", moves.HOW[0])]
    assert rows(moves.candidates(gone, new, 1), "old", "cand", "rank") == [("a", "c", 0)]


def test_overlaps_come_from_needed_names(spark):
    """2,000 modules that share one name on each side: four million pairs by that name, none of them alike enough."""
    name = lambda i: ["common", *[f"n{i}_{j}" for j in range(4)]]
    gone = [(f"o{i}", "-", name(i), f"o/f{i}.py") for i in range(2000)]
    new = [(f"n{i}", "+", [*name(i), "more"], f"n/f{i}.py") for i in range(2000)]
    same = [("twice", "-", ["r", "r"], "o/twice.py")], [("once", "+", ["r"], "n/twice.py")]
    found = moves.find(spark.createDataFrame(gone + same[0], SIDE), spark.createDataFrame(new + same[1], SIDE))
    assert rows(found, "old", "new", "how") == sorted([(f"o{i}", f"n{i}", moves.HOW[2]) for i in range(2000)] + [("twice", "once", moves.HOW[2])])
    side = spark.createDataFrame(gone[:3], SIDE)
    assert not rows(moves.candidates(side, side.limit(0)), "old", "cand")


def test_growing_tables_are_not_broadcast(spark):
    """Their compressed files are small, their rows are not."""
    for name in ("flows_without_endpoint_source", "crossed_boxes", "module_owners"):
        joins = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in "\n".join(row for row in joins.split("\n") if "head#" in row or "across#" in row or "pattern#" in row), name


def test_labels_of_equal_rank_end(spark):
    """Two labels that want one place and have one rank: neither is before the other, so a rule by rank alone takes none and goes on for ever."""
    both = spark.createDataFrame([("g", i, 1, 1, 0, 0, 10, 8) for i in (1, 2)], "by string, id long, rank long, n long, x long, y long, w long, h long")
    assert rows(layout.place_labels(both, both.limit(0), 3, 50), "by", "id", "n") == [("g", 1, 1)]


def test_all_lines_are_one_generator_at_a_time(spark):
    """The lines of each generator are written before the next one is planned, so no plan holds all of them."""
    found = plan(registry.queries()["all_finding_lines"](spark, SF))
    assert "Aggregate" not in found and "Window" not in found and found.count("Join") == 1
