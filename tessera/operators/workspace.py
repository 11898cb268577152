"""Workspace members by glob, and package roots.

Patterns run over a table of folders as an automaton over path segments: a
state is what is left of a pattern and the folder it has come to. A round is an
equi-join of states with the children of their folders (by name too, where the
next segment has no wildcard), so no pattern is held against every folder, and
equal states of different patterns are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut

# Folders that are no package roots, unless a build folder is a package itself.
NO_ROOT = (".git", ".venv", "node_modules", "__pycache__", "tests", "docs")
MEMBERS = ("tool", "uv", "workspace", "members")


def member_patterns(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo, pattern) of the project files' member lists, and problems (repo, reason). tables: repo, key, kind, value as ``syntax.tables`` gives them."""
    key = F.col("key")
    at = F.slice(key, 1, 4) == F.array(*[F.lit(m) for m in MEMBERS])
    own = tables.where(at)
    wrong = own.where((F.size(key) == 4) & (F.col("kind") != "array")).select("repo", F.lit(f"the value of {'.'.join(MEMBERS)} must be an array").alias("reason"))
    listed = own.where((F.size(key) == 5) & (F.col("kind") == "string")).select("repo", F.col("value").alias("pattern")).distinct()
    bad = refused(F.col("pattern"))
    return listed.where(bad == ""), wrong.unionByName(listed.where(bad != "").select("repo", bad.alias("reason")))


def refused(pattern):
    """Column: why a member pattern is refused, '' if it isn't."""
    flat = F.replace(pattern, F.lit("\\"), F.lit("/"))
    outside = flat.startswith("/") | F.regexp_like(flat, F.lit("^[A-Za-z]:")) | F.array_contains(F.split(flat, "/"), "..")
    named = F.concat(F.lit("the workspace member pattern '"), pattern, F.lit("'"))
    return F.when(outside, F.concat(named, F.lit(" must be a relative path in the repository. Remove an absolute path or a '..' part."))).when(F.size(segments(pattern)) == 0, F.concat(named, F.lit(" is not correct"))).otherwise("")


def segments(pattern):
    """Column: the parts of a pattern, without empty ones and ``.``."""
    return F.filter(F.split(pattern, "/"), lambda p: ~p.isin("", "."))


def segment_regex(segment):
    """Column: the regular expression of one part: ``*`` and ``?`` for any characters, ``[..]`` and ``[!..]`` for one of a set."""
    plain = F.regexp_replace(segment, r"([.+^$(){}|\\])", r"\\$1")
    return F.concat(F.lit("^(?s:"), F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\*+", ".*"), r"\?", "."), r"\[!", "[^"), F.lit(")$"))


def matching(patterns: DataFrame, folders: DataFrame) -> DataFrame:
    """(repo, path): the folders that patterns (repo, pattern) reach; ``**`` is any number of folders. folders: repo, path, parent, name."""
    folders = cut(folders.select("repo", "path", "parent", "name"))
    children = folders.select("repo", F.col("parent").alias("at"), "path", "name")
    states = cut(patterns.select("repo", segments(F.col("pattern")).alias("rest"), F.lit("").alias("at")).distinct())
    seen, reached = states, None
    while not states.isEmpty():
        done = states.where("size(rest) = 0").select("repo", F.col("at").alias("path"))
        reached = done if reached is None else reached.unionByName(done)
        open_ = states.where("size(rest) > 0").withColumn("next", F.get("rest", F.lit(0))).withColumn("tail", F.expr("slice(rest, 2, size(rest))"))
        deep = open_.where("next = '**'")
        wild = F.regexp_like("next", F.lit(r"[*?\[]"))
        named = open_.where(~wild).select("repo", "at", F.col("next").alias("name"), "tail").join(children, ["repo", "at", "name"]).select("repo", F.col("tail").alias("rest"), F.col("path").alias("at"))
        globbed = open_.where(wild & (F.col("next") != "**")).withColumn("regex", segment_regex(F.col("next"))).join(children, ["repo", "at"]).where("regexp_like(name, regex)").select("repo", F.col("tail").alias("rest"), F.col("path").alias("at"))
        below = deep.join(children, ["repo", "at"]).select("repo", "rest", F.col("path").alias("at"))
        new = named.unionByName(globbed).unionByName(below).unionByName(deep.select("repo", F.col("tail").alias("rest"), "at")).distinct()
        states = cut(new.join(seen, ["repo", "rest", "at"], "left_anti"))
        seen = seen.unionByName(states)
    return folders.select("repo", "path").limit(0) if reached is None else reached.distinct()


def members(patterns: DataFrame, entries: DataFrame) -> DataFrame:
    """(repo, path) of the workspace members: folders that patterns reach, without the top one and without links out of the tree. entries: repo and the columns of ``tree.entries``."""
    folders = entries.where("kind in ('dir', 'link') and problem is null")
    return matching(patterns, folders).where("path <> ''")


def package_roots(entries: DataFrame, members: DataFrame) -> DataFrame:
    """(repo, path, name): folders with ``__init__.py`` right below the top or a member, or below its ``src``. entries: repo and the columns of ``tree.entries``."""
    tops = entries.select("repo").distinct().withColumn("base", F.lit("")).unionByName(members.select("repo", F.col("path").alias("base")))
    parents = tops.select("repo", F.explode(F.array("base", F.concat_ws("/", F.nullif("base", F.lit("")), F.lit("src")))).alias("parent")).distinct()
    packages = entries.where("kind = 'file' and name = '__init__.py' and problem is null").select("repo", F.col("parent").alias("path"))
    folders = entries.where("kind in ('dir', 'link') and problem is null").where(~F.col("name").startswith(".") & ~F.col("name").isin(*NO_ROOT))
    return folders.join(parents, ["repo", "parent"], "left_semi").join(packages, ["repo", "path"], "left_semi").select("repo", "path", "name")
