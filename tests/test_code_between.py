"""Code between two components: priorities, the budget, blank lines, modules that can't be told."""

import random

from tessera.operators import code_between as cb

USE = "module string, target string"


def tables(spark, sites, lines, uses=None, known=None, owners=None):
    owners = owners or {"w": "Writer", "w2": "Writer", "l": "Ledger", "o": "Other"}
    uses = uses or sorted({(s[0], s[1]) for s in sites})
    modules = sorted({m for m, _ in uses} | set(owners))
    return (
        spark.createDataFrame(list(owners.items()), "module string, owner string"), spark.createDataFrame(uses, USE), spark.createDataFrame(sites, cb.SITES),
        spark.createDataFrame([(m, n, t) for m, own in lines.items() for n, t in enumerate(own, 1)], "module string, n int, text string"),
        spark.createDataFrame([(m, *(known or {}).get(m, (True, True))) for m in modules], "module string, sites boolean, source boolean"),
    )


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows) or [("Writer", "Ledger")], "src string, dst string")


def texts(df):
    return [r.text for r in df.orderBy("src", "dst", "at").collect()]


SITES = [
    ("w", "l", "Ledger", "import", 1, [(5, 4, None), (9, 0, "record")]), ("w", "l", "Ledger", "value", 5, [(6, 4, "record"), (7, 4, None)]), ("l", "w", "*", "import", 2, []), ("w", "o", "x", "import", 3, []),
]
LINES = {"w": ["from l import Ledger", "", "import o", "def run():", "    ledger = Ledger()", "    ledger.record(1)", "    use(ledger)", "   ", "Ledger.record()"], "l": ["# head", "import w"]}


def test_lines_of_both_directions_in_order(spark):
    code, blind = cb.code_between(pairs(spark), *tables(spark, SITES, LINES))
    assert texts(code) == ["w:1: from l import Ledger", "w:4: def run():", "w:5: ledger = Ledger()", "w:6: ledger.record(1)", "w:9: Ledger.record()", "l:2: import w"] and blind.count() == 0


def test_the_budget_cuts_by_priority(spark):
    of = lambda n, **k: texts(cb.code_between(pairs(spark), *tables(spark, SITES, LINES), budget=n, **k)[0])
    assert of(3) == ["w:1: from l import Ledger", "w:5: ledger = Ledger()", "w:9: Ledger.record()"]
    assert of(5) == ["w:1: from l import Ledger", "w:5: ledger = Ledger()", "w:6: ledger.record(1)", "w:9: Ledger.record()", "l:2: import w"]
    assert "w:7: use(ledger)" in of(60, context=1) and "l:1: # head" in of(60, context=1) and len(of(6, context=1)) == 6


def test_what_cannot_be_told_is_a_row(spark):
    code, blind = cb.code_between(pairs(spark, ("Writer", "Ledger"), ("Writer", "Other")), *tables(spark, SITES, LINES, known={"l": (False, True)}))
    assert [tuple(r) for r in blind.collect()] == [("Writer", "Ledger", "l")] and texts(code) == ["w:3: import o"]
    no_source, blind = cb.code_between(pairs(spark), *tables(spark, SITES, LINES, known={"w": (True, False)}))
    assert texts(no_source) == [] and blind.count() == 1
    quiet, blind = cb.code_between(pairs(spark), *tables(spark, [s for s in SITES if s[0] == "w"], LINES, uses=[("w", "l"), ("l", "w")], known={"l": (True, False)}))
    assert len(texts(quiet)) == 5 and blind.count() == 0  # no line of l uses a name, so its source isn't needed


def test_definitions_and_first_sentences_of_the_targets(spark):
    owners, uses, sites, lines, known = tables(spark, SITES, LINES)
    code, _ = cb.code_between(pairs(spark), owners, uses, sites, lines, known)
    definitions = spark.createDataFrame([("l", "Ledger", 1, "class Ledger: def record(self, n)"), ("l", "record", 0, "def record(n)"), ("l", "other", 2, "def other()")], "module string, name string, pos int, text string")
    summaries = spark.createDataFrame([("l", "Keeps it."), ("w", "")], "module string, sentence string")
    across = cb.sides(pairs(spark), owners, uses)
    assert texts(cb.target_lines(code, across, sites, definitions, summaries)) == ["l defines: def record(n)", "l defines: class Ledger: def record(self, n)", "l docstring: Keeps it."]
    assert texts(cb.target_lines(code, across, sites, definitions, summaries, 1)) == ["l defines: def record(n)"]


def plain(sites, lines, budget):
    """The lines as a walk in tiers takes them."""
    own = []
    for k, (module, other) in enumerate([("w", "l"), ("w2", "l"), ("l", "w"), ("l", "w2")]):
        own += [(k if module != "l" else 2, s) for s in sites if s[:2] == (module, other)]
    items = [(k, s, line, function, member) for k, s in own for line, function, member in ([(s[4], 0, "")] if s[3] == "import" else []) + [u for u in s[5] if s[3] == "import" or u[2]]]
    first = sorted((i for i in items if i[1][3] == "import"), key=lambda i: (i[0], i[2]))
    second = sorted((i for i in items if i[1][3] != "import"), key=lambda i: (i[0], i[2]))
    third = [(k, s, f, 0, "") for k, s, line, f, _ in first + second if f and f != line]
    chosen = []
    for k, s, line, _, _ in first + second + third:
        if len(chosen) < budget and (k, s[0], line) not in chosen and 0 < line <= len(lines[s[0]]) and lines[s[0]][line - 1].strip():
            chosen.append((k, s[0], line))
    return [f"{m}:{n}: {lines[m][n - 1].strip()}" for _, m, n in sorted(chosen)]


def test_random_sites_equal_a_walk_in_tiers(spark):
    dice = random.Random(4)
    lines = {m: [dice.choice(["  ", f" code {n}"]) if n % 3 == 0 else f"code {n}" for n in range(30)] for m in ("w", "w2", "l")}
    sites = []
    for module, target in (("w", "l"), ("w2", "l"), ("l", "w"), ("l", "w2")):
        for _ in range(6):
            uses = [(dice.randrange(1, 34), dice.randrange(0, 30), dice.choice(["", "m", None])) for _ in range(dice.randrange(4))]
            sites.append((module, target, "n", dice.choice(["import", "value"]), dice.randrange(1, 31), uses))
    made = tables(spark, sites, lines)
    for budget in (5, 17, 60):
        assert texts(cb.code_between(pairs(spark), *made, budget=budget)[0]) == plain(sites, lines, budget)


def test_blank_lines_of_highest_priority_do_not_end_a_side(spark):
    """Sixteen first lines are blank, four times the budget: the lines behind them are found all the same."""
    sites = [("w", "l", "n", "import", i, [(20 + i, 0, None)]) for i in range(1, 17)]
    lines = {"w": ["  "] * 16 + ["never"] * 4 + [f"code {n}" for n in range(21, 37)], "l": []}
    code, _ = cb.code_between(pairs(spark), *tables(spark, sites, lines), budget=4)
    assert texts(code) == [f"w:{n}: code {n}" for n in range(21, 25)]


def test_texts_meet_the_first_lines_of_a_side_only(spark):
    """The cut at the budget comes before the texts, which are as many as all lines of all files."""
    plan = cb.code_between(pairs(spark), *tables(spark, SITES, LINES))[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("left_anti" if "left_anti" in plan else "LeftAnti")[0] and "uses#" not in plan
