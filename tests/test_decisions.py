"""Questions, answers and findings of decisions; reviews of flows and lost evidence."""

from tessera.operators import decisions as d
from tessera.operators import findings

LIMITS = {"misfold_below": 0.3, "owner_at": 0.8, "sentence_below": 0.4, "flow_below": 0.25, "governs_at": 0.7}
HELD = [("", "pkg.a", "Writer", "component", False), ("", "pkg.b", "Writer", "component", False), ("", "pkg.empty", "Writer", "component", True), ("", "pkg.user", "User", "actor", False), ("in", "pkg.c", "Store", "store", False)]
CARDS = [("", "Writer", "component", "Writes.", "write(x)", "The writer"), ("", "User", "actor", "", None, None), ("", "Ledger", "store", "Keeps.", None, None), ("in", "Store", "store", None, None, None)]


def tables(spark):
    held = spark.createDataFrame(HELD, "map_id string, module string, card string, kind string, empty_marker boolean")
    cards = spark.createDataFrame(CARDS, "map_id string, card string, kind string, does string, interface string, plain string")
    free = spark.createDataFrame([("", "pkg.free", False), ("", "pkg.none", True)], "map_id string, module string, empty_marker boolean")
    return held, cards, free


def keys(df):
    return sorted(r.key for r in df.collect())


def test_questions_of_each_kind(spark):
    held, cards, free = tables(spark)
    assert keys(d.plan_owner(held, free)) == ["in|owner|pkg.c", "|owner|pkg.a", "|owner|pkg.b", "|owner|pkg.free"]
    questions, shown = d.plan_sentences(held)
    assert keys(questions) == ["in|sentence|Store", "|sentence|Writer"] and sorted(tuple(r) for r in shown.collect()) == [("in|sentence|Store", "pkg.c"), ("|sentence|Writer", "pkg.a"), ("|sentence|Writer", "pkg.b")]
    flows = spark.createDataFrame([("", "f1", "Writer", "Ledger"), ("", "f2", "User", "Writer"), ("", "f3", "Ledger", "Writer"), ("", "f4", "Writer", "Writer2")], "map_id string, flow string, src string, dst string")
    pairs = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string")
    asked, left = d.plan_flows(flows, cards, pairs(("Writer", "Ledger"), ("Writer", "Ledger"), ("Writer", "Writer2")), pairs(("Writer", "Writer2")))
    assert keys(asked) == ["|flow|f1"] and sorted((r.flow, r.why) for r in left.collect()) == [("f3", "no line"), ("f4", "not known")]
    rules = spark.createDataFrame([("", "1", ["Writer"]), ("", "2", ["Writer", "Ledger"]), ("in", "3", [])], "map_id string, rule string, governs array<string>")
    assert keys(d.plan_governs(rules, cards)) == ["in|governs|3|Store", "|governs|1|Ledger"]
    options = {(r.map_id, r.option): r.brief for r in d.owner_options(cards).collect()}
    assert options["", "Writer"] == "The writer. Writes. Interface: write(x)" and set(options) == {("", "Writer"), ("", "Ledger"), ("", "none"), ("in", "Store"), ("in", "none")}


def answered(spark):
    held, cards, free = tables(spark)
    rules = spark.createDataFrame([("", "1", ["Writer"])], "map_id string, rule string, governs array<string>")
    questions = d.plan_owner(held, free).unionByName(d.plan_sentences(held)[0]).unionByName(d.plan_governs(rules, cards))
    rows = [
        ("|owner|pkg.a", "choice", "Ledger", {"Writer": 0.2, "Ledger": 0.7, "none": 0.1}, 0.7, None), ("|owner|pkg.b", "choice", "Writer", {"Writer": 0.3}, None, None), ("|owner|pkg.free", "choice", "none", {"none": 0.9, "Writer": 0.05, "Ledger": 0.05}, 0.9, None),
        ("in|owner|pkg.c", "refusal", None, None, None, None), ("|sentence|Writer", "predicate", None, None, None, 0.25), ("in|sentence|Store", "predicate", None, None, None, 0.4), ("|governs|1|Ledger", "predicate", None, None, None, 0.75),
    ]
    return questions, spark.createDataFrame(rows, d.ANSWERS), d.owner_options(cards), rows


def test_findings_of_answers(spark):
    questions, answers, options, _ = answered(spark)
    prefixes = spark.createDataFrame([("", ""), ("in", "in: ")], "map_id string, prefix string")
    found = {r.key: (r.line, r.detail) for r in d.findings(questions, answers, LIMITS, prefixes).collect()}
    assert found == {
        "|owner|pkg.a": ("decision mis-fold: Writer claims pkg.a", "reads like Ledger; P(Writer) 0.20; most likely: Ledger 0.70, Writer 0.20, none 0.10"),
        "|owner|pkg.free": ("decision owner: pkg.free is claimed by no card", "reads like none of the cards; confidence 0.90"),
        "|sentence|Writer": ("decision sentence: Writer's sentence may not describe its modules", "P(describes) 0.25"),
        "|governs|1|Ledger": ("decision governs: invariant 1 may govern Ledger, which it does not name", "P(governs) 0.75"),
    }
    assert d.answer_problems(questions, answers, options).count() == 0 and keys(d.refused(questions, answers)) == ["in|owner|pkg.c"]
    unsure = d.findings(questions, answers, LIMITS | {"owner_at": 0.95, "misfold_below": None, "sentence_below": 0.0, "governs_at": 0.9}, prefixes).collect()
    assert [(r.key, r.detail) for r in unsure] == [("|owner|pkg.free", "closest: none, Ledger, Writer; confidence 0.90; none 0.90, Ledger 0.05, Writer 0.05")]


def test_answers_that_do_not_agree_with_their_questions(spark):
    questions, _, options, rows = answered(spark)
    bad = {
        "|owner|pkg.a": ("choice", "Ghost", {"Writer": 0.5}, None, None), "|owner|pkg.b": ("choice", "Writer", {"Writer": 0.5, "Ghost": 0.5}, None, None), "|owner|pkg.free": ("choice", "none", {"none": 1.5}, None, None),
        "in|owner|pkg.c": ("choice", "Store", {"none": 0.5}, 0.5, None), "|sentence|Writer": ("predicate", None, None, None, None), "in|sentence|Store": ("choice", "Store", None, None, None),
    }
    answers = spark.createDataFrame([(k, *v) for k, v in bad.items()], d.ANSWERS)
    problems = d.answer_problems(questions, answers, options)
    assert {r.key: r.problem for r in problems.collect()} == {
        "|owner|pkg.a": "choice is not one of the options", "|owner|pkg.b": "a probability names an option that is not one of the options", "|owner|pkg.free": "a probability is not a number from 0 to 1",
        "in|owner|pkg.c": "no probability for Store", "|sentence|Writer": "probability is not a number from 0 to 1", "in|sentence|Store": "the answer does not give a probability", "|governs|1|Ledger": "the answer is not an object",
    }
    assert d.findings(questions, answers, LIMITS, spark.createDataFrame([], "map_id string, prefix string"), problems).count() == 0


def test_spread_falls_back_to_the_confidence(spark):
    rows = [("a", "choice", "X", {"X": 0.4, "Y": 0.6}, 0.4, None), ("b", "choice", "X", {}, 0.7, None), ("c", "choice", "X", None, None, None), ("d", "refusal", None, None, None, None)]
    found = {r.key: (r.probabilities, r.problem) for r in d.spread(spark.createDataFrame(rows, d.ANSWERS)).collect()}
    assert found == {"a": ({"X": 0.4, "Y": 0.6}, None), "b": ({"X": 0.7}, None), "c": (None, "the answer X gives no probabilities and no confidence")}


def test_adjacent_and_connected_pairs(spark):
    modules = spark.createDataFrame([("p.a", "p"), ("p.b", "p"), ("p.c", "p"), ("q.z", "q")], "module string, package string")
    imports = spark.createDataFrame([("q.z", "p.a"), ("p.a", "p.b"), ("p.b", "p.a"), ("p.c", "p.c"), ("p.c", "out"), ("q.z", "p.a")], "module string, target string")
    assert sorted(tuple(r) for r in d.pair_candidates(modules, imports).collect()) == [("p.a", "p.b"), ("p.a", "q.z"), ("p.b", "p.c")]


def test_reviews_and_lost_evidence_of_flows(spark):
    states = spark.createDataFrame([("f1", "A to B", "x", "structural", False), ("f2", "B to C", "y", "observed", True), ("f3", "U to A", "z", "external", True), ("f4", "C to A", "w", "declared", False)], "key string, name string, artifact string, state string, unresolved_refs boolean")
    assert sorted((r.key, r.line[:28]) for r in findings.flow_review(states).collect()) == [("f1", "flow review: A to B (x) has "), ("f2", "flow review: B to C (y) has ")]
    flows = spark.createDataFrame([("f1", "A to B", "x", "A", "B"), ("f2", "B to U", "y", "B", "U"), ("f3", "A to C", "z", "A", "C")], "key string, name string, artifact string, src string, dst string")
    refs = spark.createDataFrame([("f1", "m.a"), ("f1", "m.other"), ("f2", "m.a"), ("f2", "m.a")], "key string, module string")
    held = spark.createDataFrame([("A", "m.a"), ("B", "m.b")], "id string, module string")
    components = spark.createDataFrame([("A", 1, True), ("B", 2, True), ("U", 3, False), ("C", 4, True)], "id string, pos int, claims boolean")
    assert [tuple(r) for r in findings.no_endpoint_source(flows, refs, held, components).collect()] == [("f2", "no endpoint source: B to U (y): no source record is in a module of B. Add a source record in a module of B, or change the flow.")]
    side = lambda *rows: spark.createDataFrame(list(rows), "key string, state string")
    lost = findings.lost_evidence(flows, side(("f1", "observed"), ("f2", "observed"), ("f3", "structural"), ("gone", "observed")), side(("f1", "declared"), ("f2", "structural"), ("f3", "declared")), " at base", "map.toml")
    found = {r.key: (r.kind, r.line) for r in lost.collect()}
    assert found["f1"] == ("evidence lost", "evidence lost: A to B (x) had a current source review at base and no import connects them now. Find the evidence, give the mechanism, or remove the flow in map.toml")
    assert found["f2"] == ("source evidence lost", "source evidence lost: B to U (y) was source reviewed at base and is now structural. Examine its source references, direction, and artifact.")
    assert found["f3"][0] == "structural evidence lost" and len(found) == 3
    assert findings.lost_evidence(flows, side(("f1", "declared"), ("f2", "observed")), side(("f1", "observed"), ("f2", "observed"))).count() == 0


def test_all_lines_get_the_prefix_of_their_map(spark):
    lines = lambda *rows: spark.createDataFrame(list(rows), "map_id string, line string")
    found = findings.map_findings({"one": lines(("", "x"), ("in", "y")), "two": lines(("in", "z"))}, spark.createDataFrame([("", ""), ("in", "in: ")], "map_id string, prefix string"))
    assert sorted(tuple(r) for r in found.collect()) == [("", "one", "x"), ("in", "one", "in: y"), ("in", "two", "in: z")]


def test_measures_of_sequences(spark):
    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    found = findings.sequence_measures(rows("journey string, flow string", ("j", "f1"), ("j", "f1"), ("k", None)), rows("journey string, drafted boolean", ("j", True), ("k", False)), rows("identity string", ("a",), ("b",), ("b",)), rows("identity string", ("b",)), rows("key string", ("f1",), ("f2",)))
    assert {r.measure: r.n for r in found.collect()} == {"sequences": 2, "drafted sequences": 1, "steps": 3, "flows on no step": 1, "ways in": 2, "ways in without a sequence": 1}
