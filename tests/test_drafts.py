"""Answers in free text become drafts of sequences, or say why not."""

import json

from tessera.operators import drafts

STEP = {"acts": ["A"], "measures": [], "edge": ["A", "B"], "say": "A tells B"}


def answer(*steps, **more):
    return "Here it is:\n" + json.dumps({"id": "read", "label": "Read it", "steps": list(steps)} | more) + "\nDone."


CASES = {
    "good": answer(STEP, STEP | {"flow": "k2", "edge": []}, STEP | {"source_refs": ["m.a:x@1"]}), "no id": answer(STEP, id=None, label=""), "prose": "I can't do it", "broken": "{ not json }", "no list": answer(steps={"a": 1}), "no steps": answer(),
    "shape": answer(STEP | {"acts": "A"}, STEP | {"say": " "}, STEP | {"edge": [1, 2]}, 7, STEP), "edge": answer(STEP | {"edge": ["A"]}), "trace": answer(STEP | {"edge": ["B", "C"]}), "several": answer(STEP | {"edge": ["C", "D"]}),
    "flow": answer(STEP | {"flow": "lost"}), "cards": answer(STEP | {"acts": ["Z", "A", "Y"]}), "refs": answer(STEP | {"source_refs": ["gone:x", "m.a"]}), "id": answer(STEP, id="not a slug"), "control": answer(STEP | {"say": "a b"}), "label": answer(STEP, label="a\u0007b"),
}


def test_answers_are_read_or_refused(spark):
    rows = spark.createDataFrame([(k, t, "GET /read", "label of the way in") for k, t in CASES.items()] + [("null", None, "n", "l")], drafts.ANSWERS)
    flows = spark.createDataFrame([("k1", "A", "B"), ("k2", "B", "A"), ("k3", "C", "D"), ("k4", "C", "D")], "key string, src string, dst string")
    found, steps, refused = drafts.read_answers(rows, flows, spark.createDataFrame([(c,) for c in "ABCD"], "id string"), spark.createDataFrame([("m.a",)], "module string"))
    assert {r.key: (r.id, r.label, r.steps) for r in found.collect()} == {"good": ("read", "Read it", 3), "no id": ("GET /read", "label of the way in", 1)}
    assert sorted((r.key, r.step, r.flow, r.src, r.dst) for r in steps.collect()) == [("good", 1, "k1", "A", "B"), ("good", 2, "k2", "B", "A"), ("good", 3, "k1", "A", "B"), ("no id", 1, "k1", "A", "B")]
    assert {r.key: r.problems for r in refused.collect()} == {
        "prose": [drafts.NO_JSON], "null": [drafts.NO_JSON], "broken": [drafts.UNREAD], "no list": [drafts.NO_LIST, drafts.NO_STEP], "no steps": [drafts.NO_STEP], "shape": [f"step {n} {drafts.SHAPE}" for n in (1, 2, 3, 4)],
        "edge": ["step 1 has an edge with 1 values. An edge has two component identifiers", drafts.NO_STEP], "trace": ["step 1 traces B -> C, which is not a flow", drafts.NO_STEP], "several": ["step 1 has several flows on C -> D", drafts.NO_STEP],
        "flow": ["step 1 has unknown flow lost", drafts.NO_STEP], "cards": ["step 1 has unknown component identifiers: Y, Z", drafts.NO_STEP], "refs": ["step 1 has source references that do not resolve: gone:x", drafts.NO_STEP],
        "id": ["the sequence id 'not a slug' is not correct. An id contains only letters, digits, '_', '.', and '-'. It starts with a letter, a digit, or '_'"], "control": ["step 1 has a sentence with a control character", drafts.NO_STEP], "label": ["the sequence label contains a control character"],
    }


def test_no_answers(spark):
    none = spark.createDataFrame([], drafts.ANSWERS)
    parts = drafts.read_answers(none, spark.createDataFrame([], "key string, src string, dst string"), spark.createDataFrame([], "id string"), spark.createDataFrame([], "module string"))
    assert [p.count() for p in parts] == [0, 0, 0]
