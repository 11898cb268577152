"""Workspace members by glob and package roots, against pathlib on real folders."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import workspace
from tessera.sources import syntax, tree

FOLDERS = ["pkgs/one/one", "pkgs/two/src/two", "pkgs/.hid/x", "pkgs/a+b (1)/deep/er", "libs/x1/y", "libs/x2/y", "libs/z/y/z", "src/app", "build", "docs", "plain"]
PACKAGES = ["pkgs/one/one", "pkgs/two/src/two", "libs/x1/y", "src/app", "build", "docs", "app", "pkgs/a+b (1)/deep"]
PATTERNS = ["pkgs/*", "libs/x?/y", "libs/x[!1]/*", "**/y", "**", "src/**", "./pkgs//one/", "pkgs/a+b (1)/*", "*/*/deep/**", "none/*", "libs/**/z", "p*", "libs/[xz]*/y"]


@pytest.fixture(scope="module")
def listed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for folder in FOLDERS + PACKAGES:
        (root / folder).mkdir(parents=True, exist_ok=True)
    for folder in PACKAGES:
        (root / folder / "__init__.py").write_text("X = 1\n")
    outside = tmp_path_factory.mktemp("outside")
    (outside / "victim").mkdir()
    (outside / "victim" / "__init__.py").write_text("X = 1\n")
    (root / "linked").symlink_to(outside)
    (root / "victim").symlink_to(outside / "victim")
    return root, tree.entries(spark, str(root), skipped=(".git",)).withColumn("repo", F.lit("r")).cache()


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def test_each_pattern_reaches_what_pathlib_finds(spark, listed):
    root, entries = listed
    many = entries.drop("repo").withColumn("repo", F.explode(F.array(*[F.lit(p) for p in PATTERNS])))
    found = {}
    for r in workspace.members(spark.createDataFrame([(p, p) for p in PATTERNS], "repo string, pattern string"), many).collect():
        found.setdefault(r.repo, set()).add(r.path)
    for p in PATTERNS:
        real = {d.relative_to(root).as_posix() for d in Path(root).glob(p) if d.is_dir() and not d.is_symlink() and "linked" not in d.parts} - {"."}
        assert found.get(p, set()) == real, p


def test_roots_of_members_and_links_that_leave(spark, listed):
    _, entries = listed
    members = workspace.members(spark.createDataFrame([("r", "linked"), ("r", "pkgs/*"), ("r", "libs/x1")], "repo string, pattern string"), entries)
    assert paths(members) == ["libs/x1", "pkgs/.hid", "pkgs/a+b (1)", "pkgs/one", "pkgs/two"]
    assert sorted((r.path, r.name) for r in workspace.package_roots(entries, members).collect()) == [("app", "app"), ("build", "build"), ("libs/x1/y", "y"), ("pkgs/a+b (1)/deep", "deep"), ("pkgs/one/one", "one"), ("pkgs/two/src/two", "two"), ("src/app", "app")]


def test_member_lists_of_project_files(spark):
    texts = {"a": "[tool.uv.workspace]\nmembers = ['pkgs/*', 'x', 3, 'x']\n", "b": "[tool.uv.workspace]\nmembers = 'pkgs/*'\n", "c": "[tool.uv.workspace]\nmembers = ['/abs/*', '../up', 'a/../b', 'C:/x', '', 'w\\\\..\\\\z']\n", "d": "[project]\nname = 'x'\n"}
    files = spark.createDataFrame([(p, t.encode(), None) for p, t in texts.items()], "path string, content binary, problem string")
    patterns, problems = workspace.member_patterns(syntax.tables(files).withColumnRenamed("path", "repo"))
    assert sorted(tuple(r) for r in patterns.collect()) == [("a", "pkgs/*"), ("a", "x")]
    said = sorted(tuple(r) for r in problems.collect())
    assert [r for r, _ in said] == ["b"] + ["c"] * 6 and said[0][1] == "the value of tool.uv.workspace.members must be an array"
    assert sum("must be a relative path" in why for _, why in said) == 5


def test_no_patterns_and_no_folders(spark):
    none = spark.createDataFrame([], "repo string, " + tree.ENTRIES)
    patterns = spark.createDataFrame([], "repo string, pattern string")
    assert workspace.members(patterns, none).count() == 0 and workspace.package_roots(none, workspace.members(patterns, none)).count() == 0
