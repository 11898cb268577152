"""Syntax trees as a table of nodes, so that what a source registers is found by joins.

A node's ``id`` is its place in a walk that takes a node before its children,
and ``last`` the id of its last descendant: b lies in a exactly if both are of
one file and a.id < b.id <= a.last. Children know their ``parent``, the
``field`` that holds them and their place ``pos`` in it. ``text`` is what a
node says by itself: a name, a dotted name, a string, the callee of a call.
Intervals of one tree nest, so the nearest enclosing node of a kind is a
running window over a file and not a join of all its nodes with each other.
"""

from __future__ import annotations

import ast
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import module_of

NODES = "path string, module string, id int, last int, parent int, kind string, field string, pos int, text string, alias string, line int"
TABLES = "path string, key array<string>, kind string, value string"
#: Nodes in a batch.
BATCH = 20_000


def dotted(node: ast.AST) -> str:
    """The dotted name of an expression, '' if it is none; a part after anything else stands alone."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def _callee(node: ast.Call) -> str:
    return dotted(node.func)


#: What a node of a kind says; other kinds say their name or argument.
_SAID = {
    ast.Name: dotted, ast.Attribute: dotted, ast.Call: _callee, ast.Constant: lambda node: node.value if isinstance(node.value, str) else None,
    ast.ImportFrom: lambda node: "." * node.level + (node.module or ""),
}


def _said(node: ast.AST) -> str | None:
    said = _SAID.get(type(node))
    return said(node) if said else getattr(node, "name", None) or getattr(node, "arg", None)


def walk(tree: ast.AST) -> Iterator[tuple]:
    """(id, last, parent, kind, field, pos, text, alias, line) of all nodes, parents first; without recursion, as trees can be deep."""
    rows, open_ = [], [(tree, -1, "", 0)]
    while open_:
        node, parent, field, pos = open_.pop()
        if node is None:  # all below ``parent`` is numbered
            rows[parent][1] = len(rows) - 1
            continue
        own = len(rows)
        rows.append([own, own, parent, type(node).__name__, field, pos, _said(node), getattr(node, "asname", None), getattr(node, "lineno", 0)])
        below = []
        for name in node._fields:
            value = getattr(node, name, None)
            if value.__class__ is list:
                below += [(child, own, name, i) for i, child in enumerate(value) if isinstance(child, ast.AST) and not isinstance(child, ast.expr_context)]
            elif isinstance(value, ast.AST) and not isinstance(value, ast.expr_context):
                below.append((value, own, name, 0))
        if below:
            open_.append((None, own, "", 0))
            open_ += reversed(below)
    return map(tuple, rows)


def node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of batches of files (path, module, content): a batch of nodes is of many small files, or of a part of a large one."""
    names = [c.split()[0] for c in NODES.split(", ")]
    types = [pa.string(), pa.string(), *[pa.int32()] * 3, pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]
    rows: list[tuple] = []

    def packed() -> pa.RecordBatch:
        columns = list(zip(*rows))
        columns[8] = [None if t is None else t.encode("utf-8", "replace").decode() for t in columns[8]]  # a literal can hold half a surrogate pair
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        for path, module, content in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            try:
                found = walk(ast.parse(content.decode("utf-8-sig"))) if content is not None else ()
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue
            for node in found:
                rows.append((path, module, *node))
                if len(rows) == BATCH:
                    yield packed()
                    rows.clear()
    if rows:
        yield packed()


def nodes(files: DataFrame) -> DataFrame:
    """The nodes of files (path, content, problem). A file that can't be read or parsed has none; its record says why."""
    return files.select("path", module_of(F.col("path")).alias("module"), "content").mapInArrow(node_batches, NODES)


def children(parents: DataFrame, nodes: DataFrame, field: str, *kinds: str) -> DataFrame:
    """parents (path, id, ..) with each of their children in a field: columns child, c_kind, c_pos, c_text. An equi-join by file and parent."""
    own = nodes.where(F.col("field") == field)
    own = own.where(F.col("kind").isin(*kinds)) if kinds else own
    return parents.join(own.select("path", F.col("parent").alias("id"), F.col("id").alias("child"), F.col("kind").alias("c_kind"), F.col("pos").alias("c_pos"), F.col("text").alias("c_text")), ["path", "id"])


def inside(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """nodes with the id ``within`` of the nearest of outer (path, id, last) before them, if they lie in it.

    For outer nodes that don't lie in each other; a running window over each file.
    """
    marks = outer.select("path", "id", F.struct("id", "last").alias("mark"))
    order = Window.partitionBy("path").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    told = nodes.join(marks, ["path", "id"], "left").withColumn("open", F.last("mark", ignorenulls=True).over(order))
    return told.where(F.col("id") <= F.col("open.last")).withColumn("within", F.col("open.id")).drop("mark", "open")


def tables(files: DataFrame) -> DataFrame:
    """(path, key, kind, value) of every value of TOML files (path, content, problem): a leaf, an empty table or array, or the cause why a file has none.

    kind is string, array, table or other; the elements of an array have its
    key and their place. A file that can't be read is a row of kind problem.
    """

    def flat(key: list[str], value) -> Iterator[tuple]:
        if isinstance(value, dict):
            yield key, "table", None
            for k, v in value.items():
                yield from flat([*key, k], v)
        elif isinstance(value, list):
            yield key, "array", None
            for i, v in enumerate(value):
                yield from flat([*key, str(i)], v)
        else:
            yield key, "string" if isinstance(value, str) else "other", str(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content, problem in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                try:
                    found = list(flat([], tomllib.loads(content.decode("utf-8-sig")))) if content is not None else [([], "problem", problem)]
                except (ValueError, RecursionError) as error:
                    found = [([], "problem", f"The parser could not read {path}: {error}")]
                out += [(path, *row) for row in found]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.list_(pa.string()), pa.string(), pa.string()))], names=["path", "key", "kind", "value"])

    return files.select("path", "content", "problem").mapInArrow(run, TABLES)
