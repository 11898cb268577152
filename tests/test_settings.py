"""Inherited settings and conditional targets, as small tables."""

import json

from tessera.operators import settings


def inherited(spark, extends, own):
    files = spark.createDataFrame([(p,) for p in sorted({p for p, _ in own} | set(extends))], "path string")
    links = spark.createDataFrame([(p, i, parent) for p, parents in extends.items() for i, parent in enumerate(parents)], "path string, pos int, parent string")
    values = spark.createDataFrame([(p, n, v) for (p, _), named in own.items() for n, v in named.items()], "path string, name string, value string")
    found, problems = settings.effective(links, values, files)
    out = {}
    for r in found.collect():
        out.setdefault(r.path, {})[r.name] = (r.value, r.given_by)
    return out, sorted((r.path, r.cause) for r in problems.collect())


def test_a_child_overrides_its_parents_and_a_later_parent_an_earlier_one(spark):
    own = {("app", 0): {"a": "1"}, ("one", 0): {"a": "2", "b": "2", "c": "2", "d": "2"}, ("two", 0): {"b": "3", "e": "3"}, ("base", 0): {"c": "4", "d": "4", "e": "4", "f": "4"}, ("top", 0): {"g": "5"}}
    found, problems = inherited(spark, {"app": ["one", "two"], "one": ["base"], "two": ["base"], "base": ["top"]}, own)
    assert found["app"] == {"a": ("1", "app"), "b": ("3", "two"), "c": ("4", "base"), "d": ("4", "base"), "e": ("3", "two"), "f": ("4", "base"), "g": ("5", "top")}
    assert found["one"] == {"a": ("2", "one"), "b": ("2", "one"), "c": ("2", "one"), "d": ("2", "one"), "e": ("4", "base"), "f": ("4", "base"), "g": ("5", "top")} and problems == []


def test_loops_and_missing_files_are_rows_with_a_cause(spark):
    own = {(p, 0): {"x": p} for p in ("a", "b", "c", "self", "ok", "lone")}
    found, problems = inherited(spark, {"a": ["b"], "b": ["a"], "c": ["b"], "self": ["self"], "ok": ["gone", "lone"]}, own)
    assert set(found) == {"ok", "lone"} and found["ok"] == {"x": ("ok", "ok")}
    assert ("ok", "the file gone is not available") in problems and {p for p, _ in problems} == {"a", "b", "c", "self", "ok"}
    assert ("c", "a circular extends relation occurs at a") in problems


PACKAGES = {
    "p": {
        "imports": {"#a": {"node": "./node.js", "default": "./a.js"}, "#lib/*": "./lib/*.js", "#lib/deep/*": {"types": "./types/*.d.ts", "import": {"dev": "./dev/*.js"}, "default": "./deep/*.js"}, "#lib/*.json": "./json/*", "#lib/private/*": None, "#list": [{"node": None}, "./second.js"], "#dir/": "./no"},
        "exports": {"import": "./index.mjs", "require": "./index.cjs"},
    },
    "q": {"exports": {".": "./q.js", "./*": {"never": "./n"}}}, "r": {"exports": "./r.js"}, "odd": [1],
}


def test_targets_by_key_and_condition(spark):
    files = spark.createDataFrame([(p, json.dumps(d).encode()) for p, d in PACKAGES.items()] + [("bad", b"{"), ("none", None)], "package string, content binary")
    cases = {
        ("p", "imports", "#a", ("node",)): "./node.js", ("p", "imports", "#a", ("import",)): "./a.js", ("p", "imports", "#lib/x", ()): "./lib/x.js", ("p", "imports", "#lib/x.json", ()): "./json/x",
        ("p", "imports", "#lib/deep/y/z", ("types",)): "./types/y/z.d.ts", ("p", "imports", "#lib/deep/y", ("import",)): "./deep/y.js", ("p", "imports", "#lib/deep/y", ("import", "dev")): "./dev/y.js",
        ("p", "imports", "#lib/private/k", ()): None, ("p", "imports", "#list", ("node",)): "./second.js", ("p", "imports", "#lib/", ()): None, ("p", "imports", "#nothing", ()): None, ("p", "imports", "#dir/", ()): None,
        ("p", "exports", ".", ("require",)): "./index.cjs", ("p", "exports", ".", ("import", "require")): "./index.mjs", ("p", "exports", ".", ()): None, ("q", "exports", ".", ()): "./q.js", ("q", "exports", "./x", ()): None,
        ("r", "exports", ".", ()): "./r.js", ("bad", "exports", ".", ()): None,
    }
    requests = spark.createDataFrame([(p, s, x, list(c)) for p, s, x, c in cases], "package string, section string, specifier string, conditions array<string>")
    found = {(r.package, r.section, r.specifier, tuple(r.conditions)): r.target for r in settings.resolve(requests, settings.targets(files)).collect()}
    assert found == cases


def test_nothing_to_resolve(spark):
    none = spark.createDataFrame([], settings.TARGETS)
    assert settings.resolve(spark.createDataFrame([], "package string, section string, specifier string, conditions array<string>"), none).count() == 0
    assert settings.targets(spark.createDataFrame([], "package string, content binary")).count() == 0
