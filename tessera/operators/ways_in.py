"""Ways into a system, found in the table of syntax nodes by structural joins.

Web routes, url tables, commands, background tasks and subcommands that a
source registers; scripts and plugin hooks that a project file names; modules
and functions that are started by their names. Every step is an equi-join of
children with parents by file, or a running window over a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from ..sources.syntax import children, inside

# What registers a way in, and what the frameworks' objects take.
HTTP_METHODS = ("get", "post", "put", "patch", "delete", "head", "options")
COMMAND_DECORATORS = ("command", "group")
TASK_DECORATORS = ("task", "shared_task", "periodic_task")
ROUTE_CALLS = ("path", "re_path", "url")
RECEIVERS = {
    "route": ("fastapi.FastAPI", "fastapi.APIRouter", "flask.Flask"),
    "command": ("typer.Typer", "click.Group"),
    "task": ("celery.Celery",),
}
#: Kinds whose target is the name in the module that they start.
STARTS_TARGET = ("console_script", "main_function", "route", "command", "task", "plugin")
UNKNOWN = "The framework binding is unknown. Examine the registration source."
FUNCTIONS = ("FunctionDef", "AsyncFunctionDef")
POINT = ["module", "kind", "name", "target"]


def _head(name):
    return F.regexp_replace(name, r"\.?[^.]*$", "")


def _tail(name):
    return F.substring_index(name, ".", -1)


def bindings(nodes: DataFrame) -> DataFrame:
    """(path, name, value, since): what names mean at the top of a module: what they import, or the kind of object they hold. The last one counts."""
    top = nodes.where("parent = 0 and field = 'body'")
    aliases = children(top.where(F.col("kind").isin("Import", "ImportFrom")).select("path", "id", "kind", F.ltrim(F.col("text"), F.lit(".")).alias("origin")), nodes.withColumn("text", F.struct("text", "alias")), "names", "alias")
    imported = aliases.where("kind = 'Import' or origin <> ''").select(
        "path", F.coalesce("c_text.alias", "c_text.text").alias("name"), F.when(F.col("kind") == "Import", F.col("c_text.text")).otherwise(F.concat_ws(".", "origin", "c_text.text")).alias("value"), F.col("child").alias("at")
    ).groupBy("path", "name").agg(F.max_by("value", "at").alias("value"))
    built = children(top.where("kind = 'Assign'").select("path", "id"), nodes, "value", "Call").select("path", "id", F.col("c_text").alias("callee"))
    held = children(built, nodes, "targets", "Name").select("path", "id", "callee", F.col("c_text").alias("name"))
    made = held.join(imported.select("path", F.col("name").alias("callee"), F.col("value").alias("known")), ["path", "callee"], "left").withColumn("made", F.coalesce("known", "callee"))
    kind = F.coalesce(*[F.when(F.col("made").isin(*names), kind) for kind, names in RECEIVERS.items()], F.lit("local"))
    receivers = made.groupBy("path", "name").agg(F.max_by(kind, "id").alias("value"))
    both = imported.withColumn("rank", F.lit(0)).unionByName(receivers.withColumn("rank", F.lit(1)))
    return both.groupBy("path", "name").agg(F.max_by("value", "rank").alias("value")).withColumn("since", F.lit(-1))


def _decorators(nodes: DataFrame) -> DataFrame:
    """A row for each decorator of a function: path, module, function, id, call (it is a call), name, first, given, methods."""
    functions = nodes.where(F.col("kind").isin(*FUNCTIONS)).select("path", "module", "id", F.col("text").alias("function"))
    each = children(functions, nodes, "decorator_list").select("path", "module", "function", F.col("id").alias("function_id"), F.col("child").alias("id"), (F.col("c_kind") == "Call").alias("call"), F.when(F.col("c_kind").isin("Call", "Name", "Attribute"), F.col("c_text")).otherwise("").alias("name"))
    each = cut(each)
    calls = each.where("call").select("path", "id")
    first = children(calls, nodes, "args", "Constant").where("c_pos = 0").select("path", "id", F.coalesce("c_text", F.lit("")).alias("first"))
    words = children(calls, nodes, "keywords").where(F.col("c_text").isin("name", "methods")).select("path", F.col("id").alias("call_id"), F.col("child").alias("id"), F.col("c_text").alias("word"))
    given = children(words.where("word = 'name'"), nodes, "value").groupBy("path", F.col("call_id").alias("id")).agg(F.min_by(F.when(F.col("c_kind") == "Constant", F.col("c_text")), "id").alias("given"))
    lists = children(words.where("word = 'methods'"), nodes, "value", "List", "Tuple").select("path", "call_id", F.col("child").alias("id"))
    listed = children(lists, nodes, "elts", "Constant").where("c_text <> ''").groupBy("path", "call_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_pos", F.upper("c_text").alias("m")))), lambda x: x["m"]).alias("methods"))
    listed = listed.groupBy("path", F.col("call_id").alias("id")).agg(F.min_by("methods", "id").alias("methods"))
    told = each
    for part in (first, given, listed):
        told = told.join(part, ["path", "id"], "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return told.select("path", "module", "function", "function_id", "id", "call", "name", blank("first"), blank("given"), F.coalesce("methods", F.array(F.lit("GET"))).alias("methods"))


def _looked_up(decorators: DataFrame, bound: DataFrame) -> DataFrame:
    """decorators with what their name (direct) and the part before its last dot (receiver) mean where they stand."""
    told = decorators.withColumn("head", _head(F.col("name")))
    for column, key in (("receiver", "head"), ("direct", "name")):
        known = bound.select("path", F.col("name").alias(key), F.col("value").alias("v"), "since")
        hits = told.select("path", "id", key).join(known, ["path", key]).where("since < id").groupBy("path", "id").agg(F.max_by("v", "since").alias(column))
        told = told.join(hits, ["path", "id"], "left")
    receiver = F.coalesce("receiver", F.lit(""))
    implied = F.when(receiver.isin("click", "celery"), F.concat_ws(".", receiver, _tail(F.col("name"))))
    return told.withColumn("last", _tail(F.col("name"))).withColumn("direct", F.coalesce("direct", implied, F.lit(""))).withColumn("known", F.col("receiver")).withColumn("receiver", receiver)


def _kind():
    """What a decorator registers: route, routes, command or task; null if nothing."""
    last, receiver, direct, path = F.col("last"), F.col("receiver"), F.col("direct"), F.col("first").startswith("/")
    on_call = (
        F.when((receiver == "route") & last.isin(*HTTP_METHODS) & path, "route").when((receiver == "route") & (last == "route") & path, "routes")
        .when((last.isin(*COMMAND_DECORATORS) & (receiver == "command")) | direct.isin("click.command", "click.group"), "command")
        .when((last.isin(*TASK_DECORATORS) & (receiver == "task")) | (direct == "celery.shared_task"), "task")
    )
    return F.when(F.col("call"), on_call).when(direct == "celery.shared_task", "task")


def _resolved(nodes: DataFrame) -> DataFrame:
    """Decorators with what they register; functions that are themselves groups of commands bind their names for the decorators after them, in rounds."""
    decorators, base = cut(_decorators(nodes)), cut(bindings(nodes))
    told = lambda some, known, groups: _looked_up(some, known if groups is None else known.unionByName(groups)).withColumn("registers", _kind())
    grouping = (F.col("registers") == "command") & F.col("call") & (F.col("name").endswith("group") | (F.col("direct") == "click.group"))
    some, known, groups, n = decorators, base, None, 0
    while True:
        found = cut(told(some, known, groups).where(grouping).select("path", F.col("function").alias("name"), F.lit("command").alias("value"), F.col("function_id").alias("since")).distinct())
        now = found.count()
        if now == n:
            return told(decorators, base, groups)
        if groups is None:  # a file without groups has none in later rounds
            paths = found.select("path").distinct()
            some, known = cut(decorators.join(paths, "path", "left_semi")), cut(base.join(paths, "path", "left_semi"))
        groups, n = found, now


def decorated(resolved: DataFrame) -> DataFrame:
    """(module, kind, name, target) that decorators register."""
    found = resolved.where("registers is not null")
    method = F.explode(F.when(F.col("registers") == "routes", F.col("methods")).otherwise(F.array(F.upper("last"))))
    routes = found.where("registers in ('route', 'routes')").withColumn("method", method).select("module", F.lit("route").alias("kind"), F.concat_ws(" ", "method", "first").alias("name"), F.col("function").alias("target"))
    said = F.coalesce(F.nullif("first", F.lit("")), F.nullif("given", F.lit("")), "function")
    commands = found.where("registers = 'command'").select("module", F.col("registers").alias("kind"), said.alias("name"), F.col("function").alias("target"))
    tasks = found.where("registers = 'task'").select("module", F.col("registers").alias("kind"), F.col("function").alias("name"), F.col("function").alias("target"))
    return routes.unionByName(commands).unionByName(tasks)


def candidates(resolved: DataFrame) -> DataFrame:
    """(module, name, target, reason): decorators that look like registrations, on an object whose framework is not known."""
    route = F.col("last").isin(*HTTP_METHODS, "route") & F.col("first").startswith("/")
    other = F.col("last").isin(*COMMAND_DECORATORS, *TASK_DECORATORS)
    likely = resolved.where("registers is null and call").where(route | other).where(~F.col("known").eqNullSafe("local"))
    return likely.select("module", F.concat_ws(".", "module", "function").alias("name"), F.col("name").alias("target"), F.lit(UNKNOWN).alias("reason"))


def url_tables(nodes: DataFrame) -> DataFrame:
    """Routes in lists named urlpatterns: each call of a route function anywhere below the assignment."""
    tables = children(nodes.where("kind = 'Assign'").select("path", "id", "last"), nodes, "targets", "Name").where("c_text = 'urlpatterns'").select("path", "id", "last").distinct()
    calling = (F.col("kind") == "Call") & F.col("text").isin(*ROUTE_CALLS)
    # Of the nodes only those that open a table or may be one of its calls are put in order.
    calls = inside(nodes.where(calling | (F.col("kind") == "Assign")).select("path", "module", "id", "kind"), tables).where("kind = 'Call'").select("path", "module", "id")
    args = children(calls, nodes, "args").where("c_pos < 2").groupBy("path", "module", "id").agg(
        F.max(F.when((F.col("c_pos") == 0) & (F.col("c_kind") == "Constant"), F.col("c_text"))).alias("route"), F.max(F.when((F.col("c_pos") == 1) & F.col("c_kind").isin("Name", "Attribute"), F.col("c_text"))).alias("view")
    )
    route, view = F.coalesce("route", F.lit("")), F.coalesce("view", F.lit(""))
    return args.where((route != "") | (view != "")).select("module", F.lit("route").alias("kind"), F.concat(F.lit("/"), F.ltrim(route, F.lit("/"))).alias("name"), view.alias("target"))


def class_commands(nodes: DataFrame) -> DataFrame:
    """Commands that are classes: by their place in the package, or by a literal ``name`` in their body."""
    classes = nodes.where("kind = 'ClassDef'").select("path", "module", "id", F.col("text").alias("target"))
    based = children(classes, nodes, "bases", "Name", "Attribute").where(_tail(F.col("c_text")).endswith("Command")).select("path", "module", "id", "target").distinct()
    body = children(based.select("path", "id"), nodes, "body", "Assign", "AnnAssign").select("path", F.col("id").alias("class_id"), F.col("child").alias("id"))
    naming = children(body, nodes, "targets", "Name").unionByName(children(body, nodes, "target", "Name")).where("c_text = 'name'").select("path", "class_id", "id").distinct()
    values = naming.join(children(naming, nodes, "value", "Constant").select("path", "id", F.col("c_text").alias("value")), ["path", "id"], "left")
    named = values.groupBy("path", F.col("class_id").alias("id")).agg(F.max_by(F.coalesce("value", F.lit("")), "id").alias("named"))
    parts = F.split("module", r"\.")
    managed = (F.size(parts) >= 3) & (F.try_element_at(parts, F.lit(-3)) == "management") & (F.try_element_at(parts, F.lit(-2)) == "commands")
    name = F.when(managed, F.concat(F.lit("manage.py "), F.try_element_at(parts, F.lit(-1)))).otherwise(F.nullif("named", F.lit("")))
    return based.join(named, ["path", "id"], "left").select("module", F.lit("command").alias("kind"), name.alias("name"), "target").where("name is not null")


def subcommands(nodes: DataFrame) -> DataFrame:
    """(module, name) of parsers added with a literal name."""
    calls = nodes.where("kind = 'Call'").select("path", "module", "id")
    adding = children(calls, nodes, "func", "Attribute").where(_tail(F.col("c_text")) == "add_parser").select("path", "module", "id")
    return children(adding, nodes, "args", "Constant").where("c_pos = 0 and c_text is not null").select("module", F.col("c_text").alias("name"))


def in_source(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ways in that sources register (module, kind, name, target), and candidates whose framework isn't known. nodes are read several times: pass a written table."""
    resolved = cut(_resolved(nodes))
    return decorated(resolved).unionByName(url_tables(nodes)).unionByName(class_commands(nodes)).distinct(), candidates(resolved)


def in_project(tables: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scripts and hooks of a project file that lead to modules (module), and problems (path, reason). tables: what ``syntax.tables`` gives."""
    key = F.col("key")
    at = lambda *names: (F.size(key) >= len(names)) & (F.slice(key, 1, len(names)) == F.array(*[F.lit(n) for n in names]))
    leaf = tables.where("kind = 'string'").withColumn("n", F.size("key"))
    scripts = leaf.where(at("project", "scripts") & (F.col("n") == 3) & F.contains("value", F.lit(":"))).withColumn("kind", F.lit("console_script")).withColumn("name", F.get("key", F.lit(2)))
    poetry = leaf.where(at("tool", "poetry", "scripts") & ((F.col("n") == 4) | ((F.col("n") == 5) & (F.get("key", F.lit(4)) == "callable")))).withColumn("kind", F.lit("console_script")).withColumn("name", F.get("key", F.lit(3)))
    hooks = leaf.where(at("project", "entry-points") & (F.col("n") == 4)).withColumn("kind", F.lit("plugin")).withColumn("name", F.concat(F.get("key", F.lit(2)), F.lit(": "), F.get("key", F.lit(3))))
    every = scripts.unionByName(poetry).unionByName(hooks).withColumn("module", F.trim(F.substring_index("value", ":", 1))).withColumn("target", F.trim(F.regexp_replace("value", "^[^:]*:?", "")))
    wrong = []
    for names in (("project",), ("project", "scripts"), ("project", "entry-points"), ("tool",), ("tool", "poetry"), ("tool", "poetry", "scripts")):
        wrong.append(tables.where(at(*names) & (F.size(key) == len(names)) & ~F.col("kind").isin("table", "problem")).select("path", F.lit(f"the value of {'.'.join(names)} must be a table").alias("reason")))
    wrong.append(tables.where(at("tool", "poetry", "scripts") & (F.size(key) == 4) & ~F.col("kind").isin("string", "table")).select("path", F.concat(F.lit("the value of "), F.array_join("key", "."), F.lit(" must be a string or a table")).alias("reason")))
    problems = tables.where("kind = 'problem'").select("path", F.col("value").alias("reason"))
    for part in wrong:
        problems = problems.unionByName(part)
    return every.select(*POINT).join(modules.select("module"), "module", "left_semi"), problems


def by_name(modules: DataFrame) -> DataFrame:
    """Ways in that a module's names make: its being ``__main__``, a function main, the functions of a package root. modules: module, functions, root."""
    main = modules.where(F.col("module").endswith(".__main__")).select("module", F.lit("main_module").alias("kind"), F.concat(F.lit("python -m "), F.regexp_replace("module", r"\.__main__$", "")).alias("name"), F.lit("").alias("target"))
    started = modules.where(F.array_contains("functions", "main")).select("module", F.lit("main_function").alias("kind"), F.lit("main").alias("name"), F.lit("main").alias("target"))
    public = modules.where("root").select("module", F.lit("public_function").alias("kind"), F.explode("functions").alias("name"), F.lit("").alias("target"))
    return main.unionByName(started).unionByName(public)


def all_ways(nodes: DataFrame, tables: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every way in (module, kind, name, target, symbol), candidates, and problems of the project file. A subcommand's target is the script of its module."""
    sources, unsure = in_source(nodes)
    project, problems = in_project(tables, modules)
    scripts = project.where("kind = 'console_script'").groupBy("module").agg(F.max("name").alias("script"))
    below = subcommands(nodes).join(scripts, "module", "left").select("module", F.lit("subcommand").alias("kind"), "name", F.coalesce("script", F.lit("")).alias("target"))
    every = sources.unionByName(project).unionByName(by_name(modules)).unionByName(below).distinct()
    symbol = F.when(F.col("kind") == "public_function", F.col("name")).when(F.col("kind").isin(*STARTS_TARGET) & ~F.contains("target", F.lit(".")), F.col("target")).otherwise("")
    return every.withColumn("symbol", symbol), unsure, problems
