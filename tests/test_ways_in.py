"""Ways in found by structural joins: what sources register, what project files name. All sources stand in one table."""

import ast

import pyarrow as pa
import pytest

from tessera.operators import ways_in
from tessera.scratch import cut
from tessera.sources import syntax

SOURCES = {
    "web.py": """
from fastapi import APIRouter
from flask import Flask
router = APIRouter()
app = Flask(__name__)

@router.get("/recipes/{slug}")
def read_recipe(slug): ...

@router.post("/recipes")
async def make_recipe(): ...

@app.route("/health", methods=["GET", "head"])
def health(): ...

@app.route("/plain")
def plain(): ...
""",
    "urls.py": """
from django.urls import path, re_path
urlpatterns = [
    path("documents/", views.documents, name="documents"),
    re_path(r"^fetch/doc/(?P<pk>\\d+)$", views.fetch),
    path("nested/", include([path("inner/", inner)])),
] + extra
other = [path("not/", views.nothing)]
""",
    "click.py": """
from click import Group
from typer import Typer
cli = Group()
app = Typer()
@cli.group(name="config")
def config_group(): ...

@config_group.command("show")
def show(): ...

@config_group.group()
def deeper(): ...

@deeper.command()
def deepest(): ...

@app.command()
def serve(): ...
""",
    "cleo.py": 'class AddCommand(Command):\n    name = "add"\n    description = "add a package"\nclass Odd(base.Command):\n    name = other()\n',
    "app/management/commands/reindex.py": "class Command(BaseCommand):\n    help = 'reindex'\n",
    "not_ways.py": "@group()\ndef _render_stack(self): ...\n@property\ndef name(self): ...\n@cache.get(\"key\")\ndef value(): ...\n",
    "direct.py": "from click import command\n@command()\ndef run(): pass\n",
    "renamed.py": "from click import command as cli\n@cli()\ndef run(): pass\n",
    "dotted.py": "import click as ck\n@ck.command()\ndef run(): pass\n",
    "local.py": "class Cache:\n def get(self, path): return lambda fn: fn\ncache = Cache()\n@cache.get('/key')\ndef read(): pass\n",
    "unknown.py": '@router.get("/read")\ndef read(): pass\n',
    "tasks.py": 'from celery import Celery, shared_task\napp = Celery("tasks")\n@shared_task\ndef train_classifier(): ...\n@app.task(bind=True)\ndef empty_trash(self): ...\n',
    "parsers.py": "def main():\n    sub = p.add_subparsers()\n    sub.add_parser('build', help='x').add_argument('a')\n    sub.add_parser(name)\n    make().add_parser('ship')\n",
    "broken.py": "def (:\n", "empty.py": "", "pkg/__main__.py": "from . import cli\ncli.main()\n", "deep.py": "x = " + "-" * 300 + "1\n",
}
PROJECT = """
[project.scripts]
tool = "parsers:main"
gone = "elsewhere:main"
odd = "nocolon"
[project.entry-points.pytest11]
cov = "tasks:setup"
[tool.poetry.scripts]
poet = "click:cli"
table = {callable = "web:app"}
bad = 1
"""


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(p, s.encode(), None) for p, s in SOURCES.items()] + [("unread.py", None, "too large")]
    return cut(syntax.nodes(spark.createDataFrame(rows, "path string, content binary, problem string").repartition(3)))


@pytest.fixture(scope="module")
def found(nodes):
    ways, unsure = ways_in.in_source(nodes)
    out = {}
    for r in ways.collect():
        out.setdefault(r.module, set()).add((r.kind, r.name, r.target))
    return out, {(r.module, r.target) for r in unsure.collect()}


def test_nodes_are_numbered_as_intervals(nodes):
    for path in ("web.py", "deep.py"):
        rows = {r.id: r for r in nodes.where(f"path = '{path}'").collect()}
        tree = ast.parse(SOURCES[path])
        assert len(rows) == sum(not isinstance(n, ast.expr_context) for n in ast.walk(tree))
        for r in rows.values():
            above, p = set(), r.parent
            while p >= 0:
                above.add(p)
                p = rows[p].parent
            assert above == {a.id for a in rows.values() if a.id < r.id <= a.last}
    assert {r.path for r in nodes.select("path").distinct().collect()} == set(SOURCES) - {"broken.py"}


def test_web_routes_are_read_with_their_method_and_path(found):
    assert found[0]["web"] == {("route", "GET /recipes/{slug}", "read_recipe"), ("route", "POST /recipes", "make_recipe"), ("route", "GET /health", "health"), ("route", "HEAD /health", "health"), ("route", "GET /plain", "plain")}


def test_routes_come_from_the_urlpatterns_table(found):
    assert found[0]["urls"] == {("route", "/documents/", "views.documents"), ("route", "/^fetch/doc/(?P<pk>\\d+)$", "views.fetch"), ("route", "/nested/", ""), ("route", "/inner/", "inner")}


def test_commands_are_read_from_groups_classes_and_places(found):
    assert found[0]["click"] == {("command", "config", "config_group"), ("command", "show", "show"), ("command", "deeper", "deeper"), ("command", "deepest", "deepest"), ("command", "serve", "serve")}
    assert found[0]["cleo"] == {("command", "add", "AddCommand")}
    assert found[0]["app.management.commands.reindex"] == {("command", "manage.py reindex", "Command")}


def test_what_is_not_a_way_in_is_not_one(found):
    assert not {"not_ways", "local", "unknown"} & set(found[0])
    assert found[1] == {("not_ways", "group"), ("unknown", "router.get")}


def test_bindings_tell_frameworks_from_local_names(found):
    assert found[0]["direct"] == found[0]["renamed"] == found[0]["dotted"] == {("command", "run", "run")}
    assert found[0]["tasks"] == {("task", "train_classifier", "train_classifier"), ("task", "empty_trash", "empty_trash")}


def test_project_files_and_names(spark, nodes):
    files = spark.createDataFrame([("pyproject.toml", PROJECT.encode(), None)], "path string, content binary, problem string")
    modules = spark.createDataFrame([("parsers", ["main"], False), ("tasks", ["train_classifier"], False), ("web", ["health"], True), ("click", [], False), ("pkg.__main__", [], False)], "module string, functions array<string>, root boolean")
    ways, _, problems = ways_in.all_ways(nodes, syntax.tables(files), modules)
    every = {(r.kind, r.name, r.module, r.target, r.symbol) for r in ways.collect()}
    assert {e for e in every if e[0] in ("console_script", "plugin")} == {
        ("console_script", "tool", "parsers", "main", "main"), ("console_script", "poet", "click", "cli", "cli"), ("console_script", "table", "web", "app", "app"), ("plugin", "pytest11: cov", "tasks", "setup", "setup"),
    }
    assert {e for e in every if e[0] == "subcommand"} == {("subcommand", "build", "parsers", "tool", ""), ("subcommand", "ship", "parsers", "tool", "")}
    assert {("main_module", "python -m pkg", "pkg.__main__", "", ""), ("main_function", "main", "parsers", "main", "main"), ("public_function", "health", "web", "", "health")} <= every
    assert ("route", "/documents/", "urls", "views.documents", "") in every
    assert [(r.path, r.reason) for r in problems.collect()] == [("pyproject.toml", "the value of tool.poetry.scripts.bad must be a string or a table")]


def test_project_values_that_are_no_tables_are_problems(spark):
    texts = {"a.toml": 'project = "oops"\n', "b.toml": "[tool.poetry]\nscripts = 'x'\n", "c.toml": "not toml", "d.toml": "﻿[project]\nname = 'ok'\n"}
    files = spark.createDataFrame([(p, t.encode(), None) for p, t in texts.items()] + [("e.toml", None, "PermissionError")], "path string, content binary, problem string")
    ways, problems = ways_in.in_project(syntax.tables(files), spark.createDataFrame([], "module string"))
    said = {r.path: r.reason for r in problems.collect()}
    assert ways.count() == 0 and set(said) == {"a.toml", "b.toml", "c.toml", "e.toml"}
    assert said["a.toml"] == "the value of project must be a table" and said["b.toml"] == "the value of tool.poetry.scripts must be a table" and said["c.toml"].startswith("The parser could not read c.toml") and said["e.toml"] == "PermissionError"


def test_no_files(spark):
    none = spark.createDataFrame([], "path string, content binary, problem string")
    ways, unsure = ways_in.in_source(cut(syntax.nodes(none)))
    assert ways.count() == unsure.count() == syntax.tables(none).count() == 0


def test_nodes_of_many_files_share_a_batch(monkeypatch):
    """A batch for each file costs more than its parsing; a large file is still cut."""
    files = [(f"p/f{i}.py", f"p.f{i}", b"x = 1\n") for i in range(100)] + [("p/bad.py", "p.bad", b"x ="), ("p/none.py", "p.none", None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files)], names=["path", "module", "content"])
    (found,) = syntax.node_batches(iter([batch]))
    assert found.num_rows == 400 and set(found.column(0).to_pylist()) == {f[0] for f in files[:100]}
    monkeypatch.setattr(syntax, "BATCH", 150)
    cut_ = list(syntax.node_batches(iter([batch])))
    assert [b.num_rows for b in cut_] == [150, 150, 100] and pa.Table.from_batches(cut_).to_pylist() == found.to_pylist()
