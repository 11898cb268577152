"""Source trees, snapshots and logs."""

from pyspark.sql import functions as F

from tessera.sources import facts, python_source
from tessera.sources import tree as trees
from tessera.streaming import live

TREE = {
    "app/__init__.py": "# the package\n",
    "app/core.py": '"""The core.  More."""\nimport os\nimport requests\nfrom app import store\nfrom .store import Store as S\nLIMIT = 3\n\n\ndef run():\n    return S\n\n\nclass BadError(Exception):\n    pass\n\n\nif __name__ == "__main__":\n    run()\n',
    "app/store.py": "class Store:\n    pass\n\n\ndef test_store():\n    pass\n",
    "app/broken.py": "def (:\n",
    "build/skip.py": "x = 1\n",
    "app/sub/__init__.py": "",
    "app/__main__.py": "from app import core\ncore.run()\n",
    "app/_private.py": "x = 1\n",
    "app/deep.py": "x = " + "(" * 5000 + ")" * 5000 + "\n",
}
#: Names that a URI would have to quote.
ODD = ["app/a b.py", "app/a#b.py", "app/a%20b.py", "app/\u00e9t\u00e9.py", "app/x?y.py", "odd dir #1/p%q/z.py"]


def tree(tmp_path):
    for path, text in TREE.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    return str(tmp_path)


def test_python_tree_becomes_facts(spark, tmp_path):
    found = python_source.extract(spark, tree(tmp_path)).cache()
    by = {r.module: r for r in found.collect()}
    assert set(by) == {"app", "app.core", "app.store", "app.broken", "app.sub", "app.__main__", "app._private", "app.deep"}
    assert by["app.sub"].parsed and by["app.sub"].loc == 0 and not by["app.deep"].parsed
    assert [n.name for n in by["app.core"].names] == ["LIMIT", "run", "BadError"] and by["app.core"].mains
    assert by["app.broken"].names is None and by["app.broken"].problem == "SyntaxError" and by["app.store"].tests == ["test_store"]
    uses = {(r.module, r.target): r.names for r in python_source.uses(found).collect()}
    assert uses == {("app.core", "app.store"): ["Store"], ("app.__main__", "app.core"): []}
    assert [(r["import"], r.modules) for r in python_source.external(found).collect()] == [("requests", ["app.core"])]
    assert [r.module for r in python_source.entry_points(found).collect()] == ["app.core"]


def test_any_file_name_is_listed_and_read(spark, tmp_path):
    for i, path in enumerate(ODD):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"x = {i}\n")
    (tmp_path / "app" / "not.txt").write_text("no")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "m.py").write_text("no")
    (tmp_path / "app" / "gone.py").symlink_to("/etc/hostname")
    (tmp_path / "app" / "here.py").symlink_to("a b.py")
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "app" / "big.py").write_text("#" * 100)
    open(bytes(tmp_path) + b"/app/bad\xff.py", "w").close()
    listed = trees.entries(spark, str(tmp_path), "*.py")
    found = {r.path: (r.content, r.problem) for r in trees.contents(listed, str(tmp_path), limit=99).collect()}
    assert {p: found[p] for p in ODD} == {p: (f"x = {i}\n".encode(), None) for i, p in enumerate(ODD)}
    assert found["app/here.py"] == (b"x = 0\n", None) and found["app/gone.py"] == (None, trees.LEAVES) and found["app/big.py"] == (None, trees.TOO_LARGE) and found["app/bad?.py"] == (None, trees.NOT_TEXT)
    assert len(found) == len(ODD) + 4
    folders = {r.path: r.kind for r in listed.where("kind <> 'file'").collect()}
    assert folders == {"app": "dir", "odd dir #1": "dir", "odd dir #1/p%q": "dir", "loop": "link"}
    assert {r.path for r in python_source.files(spark, f"file://{tmp_path}").collect()} == set(found)


def test_a_tree_that_is_empty_or_missing(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert trees.entries(spark, str(tmp_path / "none")).count() == 0
    assert [(r.path, r.problem) for r in trees.contents(spark.createDataFrame([("a.py", "", "a.py", "file", 1, None)], trees.ENTRIES), str(tmp_path)).collect()] == [("a.py", "FileNotFoundError")]


def test_snapshots_round_trip_and_keep_null_apart_from_empty(spark, tmp_path):
    rows = [("b", "b.py", "p", 1, "s", "", ["x"], {"a": ["n"]}, True, []), ("a", "a.py", "p", 2, "s", "", [], {}, False, None)]
    df = spark.createDataFrame(rows, "module string, file string, package string, loc long, sha string, docstring string, names array<string>, uses map<string,array<string>>, parsed boolean, unresolved array<string>")
    facts.write(df, str(tmp_path / "out"))
    back = {r.module: r for r in facts.read(spark, str(tmp_path / "out")).collect()}
    assert back["a"].unresolved is None and back["b"].unresolved == [] and back["b"].uses == {"a": ["n"]}


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"type": "a", "n": 1}\nnot json\n{"type": "b", "n": 2}\n')
    assert facts.read_log(spark, str(tmp_path / "log.jsonl"), "type string, n long").count() == 2
    text = spark.range(1).select(facts.strip_comments(F.lit('{"u": "http://x", // c\n "v": [1, 2,], /* d */}')).alias("t")).first().t
    import json

    assert json.loads(text) == {"u": "http://x", "v": [1, 2]}


def test_debounce_batch_equals_stream(spark, tmp_path):
    schema = "path string, ts timestamp"
    rows = [("a", f"2024-01-01 00:00:{s:02d}") for s in (0, 1, 2, 20, 21)] + [("b", "2024-01-01 00:00:05")]
    df = spark.createDataFrame(rows, "path string, t string").select("path", F.to_timestamp("t").alias("ts"))
    batch = live.debounce(df, 5, "path")
    df.unionByName(spark.createDataFrame([("z", "2024-01-01 01:00:00")], "path string, t string").select("path", F.to_timestamp("t").alias("ts"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = live.debounce_stream(stream, 5, "path", 1).writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.path, r.changes) for r in spark.table("bursts").where("path <> 'z'").collect()}
    assert got == {(r.path, r.changes) for r in batch.collect()} == {("a", 3), ("a", 2), ("b", 1)}


def test_a_failing_batch_keeps_the_last_good_version(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    good = []

    def render(batch, number):
        good.append(batch.count())
        raise ValueError("bad version")

    query, failed = live.follow_batches(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), render, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert good == [3] and failed[0][1] == "bad version"
