"""Shapes of JSON documents by a rule table, against a walk along the same rules."""

import json
import random

from tessera.operators import shapes

SCHEMA = {
    "text": "text", "integer": "integer", "boolean": "boolean", "path": "path", "name": "name", "list": "list",
    "texts": ["list", "text"], "named": {"!name": "text"}, "nameds": ["list", "named"], "uses": ["map", "texts"],
    "module": {"!file": "path", "!functions": "nameds", "!total": "integer", "uses": "uses", "loc": "integer", "parsed": "boolean", "imports": "texts?", "label": "name"},
    "modules": ["map plain", "module"], "facts": {"!components": "modules", "points": "list"},
}
GOOD = {"file": "a.py", "functions": [{"name": "f"}], "total": 1, "uses": {"b": ["x"]}, "imports": None}


def found(spark, documents, **more):
    rows = spark.createDataFrame([(d, c if isinstance(c, str) else json.dumps(c)) for d, c in documents.items()], "doc string, content string")
    return {r.doc: r.problem for r in shapes.first_problem(shapes.problems(rows, SCHEMA, "facts", **more)).collect()}


def walk(value, kind, nullable=False):
    """The first problem of a value: the keys that lead to it and the requirement; None if it is right."""
    shape = SCHEMA[kind]
    if nullable and value is None:
        return None
    if isinstance(shape, str):
        if shape in ("path", "name", "text"):
            if not isinstance(value, str):
                return [], "must be a text value"
            if shape == "path" and (value.startswith(("/", "\\")) or value[1:2] == ":"):
                return [], "must be a relative path"
            return ([], "must not contain a control character") if shape != "text" and any(ord(c) < 32 for c in value) else None
        right = {"integer": int, "boolean": bool, "list": list}[shape]
        return None if isinstance(value, right) and (shape == "boolean" or not isinstance(value, bool)) else ([], shapes.MUST[shape])
    if isinstance(shape, list):
        items = list(enumerate(value)) if isinstance(value, list) and shape[0] == "list" else list(value.items()) if isinstance(value, dict) and shape[0] != "list" else None
        if items is None:
            return [], shapes.MUST["list" if shape[0] == "list" else "object"]
        if shape[0].endswith("plain") and any(ord(c) < 32 for k, _ in items for c in k):
            return [], "has a key with a control character"
        checks = [(k, v, shape[1]) for k, v in items]
    else:
        if not isinstance(value, dict):
            return [], "must be an object"
        for k in shape:
            if k.startswith("!") and k[1:] not in value:
                return [], f'has no "{k[1:]}" key'
        ordered = sorted(shape, key=lambda k: not k.startswith("!"))
        checks = [(k.lstrip("!"), value[k.lstrip("!")], shape[k]) for k in ordered if k.lstrip("!") in value]
    for key, inner, child in checks:
        wrong = walk(inner, child.rstrip("?"), child.endswith("?"))
        if wrong:
            return [key, *wrong[0]], wrong[1]
    return None


def told(value):
    wrong = walk(value, "facts")
    if wrong is None:
        return None
    return f"the value at {''.join(f'[{json.dumps(k)}]' for k in wrong[0])} {wrong[1]}" if wrong[0] else f"the file {wrong[1]}"


def test_first_problems_equal_a_walk(spark):
    dice = random.Random(3)
    odd = ["x", 1, True, None, [], {}, 1.5, "/abs", "C:\\x", "a\nb", [1], [{"name": 2}], {"k": "v"}, [{"n": "x"}], "é \"q\""]
    documents = {"good": {"components": {"m": GOOD}}, "none": {}, "list": [], "text": "x"}
    for i in range(150):
        modules = {}
        for m in range(dice.randrange(3)):
            record = json.loads(json.dumps(GOOD))
            for _ in range(dice.randrange(3)):
                key = dice.choice(["file", "functions", "total", "uses", "loc", "parsed", "imports", "label", "extra"])
                if dice.random() < 0.25:
                    record.pop(key, None)
                else:
                    record[key] = dice.choice(odd)
            modules[dice.choice([f"m{m}", 'q"uote', "new\nline", f"é{m}"])] = record if dice.random() < 0.95 else dice.choice(odd)
        documents[f"d{i}"] = {"components": modules if dice.random() < 0.97 else dice.choice(odd)} | ({"points": dice.choice(odd)} if dice.random() < 0.2 else {})
    got = found(spark, {d: json.dumps(c, ensure_ascii=False) for d, c in documents.items()})
    real = {d: told(c) for d, c in documents.items()}
    plain = lambda t: t and t.encode().decode("unicode_escape", "replace") if t and "\\u" in t else t  # noqa: E731  json escapes letters beyond ASCII, Spark does not
    assert {d: plain(p) for d, p in got.items()} == {d: plain(p) for d, p in real.items() if p} and len(got) > 60


def test_documents_that_are_too_deep_or_no_json(spark):
    deep = "[" * 9 + "]" * 9
    assert found(spark, {"deep": '{"components": {}, "points": ' + deep + "}", "broken": "{", "empty": ""}, max_depth=6) == {"deep": "the JSON value has more than 6 levels", "broken": "the file is not JSON", "empty": "the file is not JSON"}
    assert found(spark, {"ok": '{"components": {}, "points": [[]]}'}) == {}
    none = spark.createDataFrame([], "doc string, content string")
    assert shapes.problems(none, SCHEMA, "facts").count() == 0
