"""Checks of models, as small tables of two maps."""

from tessera.operators import model_checks as mc


def lines(df):
    return sorted((r.map_id, r.line) for r in df.collect())


def test_flows_that_are_not_told_apart(spark):
    rows = [("", 1, "a", "X", "Y", "n"), ("", 2, "a", "Y", "Z", "n"), ("", 3, "b d", "X", "Z", "n"), ("", 4, "", "X", "X", "n"), ("", 5, "", "P", "Q", "one"), ("", 6, "", "P", "Q", "two"), ("in", 1, "a", "X", "Y", "n"), ("in", 2, "", "P", "Q", "one"), ("", 7, "c", "R", "S", "n"), ("", 8, "d", "R", "S", "m")]
    found = lines(mc.flow_problems(spark.createDataFrame(rows, "map_id string, pos int, id string, src string, dst string, artifact string")))
    assert found == sorted([
        ("", "flow id a identifies two flows. Give each flow its own id"), ("", "flow X -> Z has the id 'b d'. An id contains only letters, digits, '_', '.', and '-'. It starts with a letter, a digit, or '_'"),
        ("", "flow X -> X has the same component at the two ends. A flow must connect two different components"),
        ("", "flow P -> Q appears twice ('one' and 'two'). Give each flow on this pair its own id. For an artifact that goes back, add a flow in the opposite direction"),
    ])


def test_override_keys(spark):
    flows = spark.createDataFrame([("", "k1", "X", "Y", "X to Y"), ("", "k2", "Y", "Z", "Y to Z")], "map_id string, key string, src string, dst string, name string")
    keys = spark.createDataFrame([("", "relations", "k1", None, None), ("", "relations", "", "X", "Y"), ("", "relations", "gone", None, None), ("", "layers", "", "A", "B"), ("", "layers", "", "Y", "Z"), ("in", "layers", "k1", None, None)], "map_id string, label string, key string, src string, dst string")
    assert lines(mc.key_problems(keys, flows)) == [("", "layers has an unknown flow: A -> B"), ("", "relations gives flow X to Y two keys: k1 and the pair. Remove one key"), ("", "relations has an unknown flow: gone"), ("in", "layers has an unknown flow: k1")]


def test_import_rules(spark):
    rules = spark.createDataFrame([("", 1, "r", "forbid_import", ["X"], ["Y"], 1), ("", 2, "r", "allow_imports", ["X"], ["Gone"], 9), ("", 3, " ", "forbid_import", [], [], None), ("", 4, "s", "other", ["Gone"], [], None)], "map_id string, pos int, id string, kind string, src array<string>, dst array<string>, invariant int")
    found = lines(mc.rule_problems(rules, spark.createDataFrame([("", "X"), ("", "Y"), ("in", "Gone")], "map_id string, id string"), spark.createDataFrame([("", 1)], "map_id string, n int")))
    assert found == [("", "a rule of kind forbid_import has an empty id"), ("", "r has unknown component Gone"), ("", "r has unknown invariant 9"), ("", "r is the id of two rules. Give each rule its own id"), ("", "s has unknown kind other. Use forbid_import, allow_imports")]


def test_boundaries_and_meaning(spark):
    boundaries = spark.createDataFrame([("", 1, "region", "a"), ("", 2, "region", "a"), ("", 3, "container", "a"), ("", 4, "container", "b"), ("in", 1, "region", "b")], "map_id string, pos int, kind string, id string")
    assert lines(mc.boundary_problems(boundaries)) == [("", "region a has the id of a container. Give each region and container a different id"), ("", "region a identifies two boundaries")]
    flows = spark.createDataFrame([("", "f", " ", "data", "d"), ("", "g", "x", None, "odd"), ("", "h", None, "none", "d")], "map_id string, name string, relation string, layer string, kind string")
    ids = lambda *rows: spark.createDataFrame(list(rows), "map_id string, id string")
    found = lines(mc.meaning_problems(flows, ids(("", "X"), ("in", "Y")), ids(("", "Z"), ("in", "Y")), ids(("", "data"))))
    assert found == [("", "X has no plain word"), ("", "flow f has no sentence in relations"), ("", "flow g has kind odd with no layer"), ("", "flow h has no sentence in relations"), ("", "flow h has unknown layer none"), ("", "plain has an unknown component: Z")]


def test_sequences(spark):
    journeys = spark.createDataFrame([("", 1, "j"), ("", 2, "j"), ("", 3, "empty")], "map_id string, pos int, id string")
    steps = spark.createDataFrame([("", "j", 1, ["X"], ["Gone"], "says", "k", None, None), ("", "j", 2, [], [], "says", "lost", None, None), ("", "j", 3, [], [], " ", "", "X", "Y"), ("", "j", 4, [], [], "says", "", "Y", "Z"), ("", "j", 5, [], [], "says", "", "Z", "X"), ("", "j", 6, [], [], None, "", None, None)], "map_id string, journey string, step int, acts array<string>, measures array<string>, say string, flow string, src string, dst string")
    flows = spark.createDataFrame([("", "k", "X", "Y"), ("", "l", "Y", "Z"), ("", "m", "Z", "Y")], "map_id string, key string, src string, dst string")
    found = lines(mc.sequence_problems(journeys, steps, spark.createDataFrame([("", "X")], "map_id string, id string"), flows))
    assert found == [
        ("", "journey empty has no steps. Add the examined sequence or remove it"), ("", "journey j is the id of two sequences. Give each sequence its own id"), ("", "journey j step 1 measures has unknown component Gone"), ("", "journey j step 2 has unknown flow lost"),
        ("", "journey j step 3 has no say"), ("", "journey j step 4 has several flows on Y -> Z"), ("", "journey j step 5 has no flow on Z -> X"), ("", "journey j step 6 has no say"),
    ]
