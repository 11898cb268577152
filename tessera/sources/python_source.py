"""A source of facts: Python source trees, read by Spark and parsed in Arrow batches."""

from __future__ import annotations

import ast
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import module_of
from . import tree

RECORD = (
    "path string, module string, parsed boolean, problem string, docstring string, loc long, names array<struct<name:string,kind:string>>, "
    "imports array<struct<target:string,name:string,local:string,line:long>>, mains boolean, tests array<string>"
)


def files(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """(path, content, problem) of every source file below root; files that can't be read or are too large keep their row with a cause."""
    return tree.contents(tree.entries(spark, root, glob), root)


def _names(tree: ast.Module) -> list[dict]:
    out = []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append((node.name, "function"))
        elif isinstance(node, ast.ClassDef):
            bases = " ".join(ast.unparse(b) for b in node.bases)
            out.append((node.name, "error" if "Error" in bases or "Exception" in bases else "class"))
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            out += [(t.id, "constant") for t in targets if isinstance(t, ast.Name) and t.id.isupper()]
    return [{"name": n, "kind": k} for n, k in out if not n.startswith("_")]


def _imports(tree: ast.Module, module: str, package: bool) -> list[dict]:
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [{"target": a.name, "name": "", "local": a.asname or a.name.split(".")[0], "line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            parts = module.split(".")
            up = parts[: len(parts) - node.level + package] if node.level else []
            target = ".".join([*up, *([node.module] if node.module else [])])
            out += [{"target": target, "name": a.name, "local": a.asname or a.name, "line": node.lineno} for a in node.names]
    return out


def _is_main(node: ast.stmt) -> bool:
    return isinstance(node, ast.If) and "__name__" in ast.unparse(node.test) and "__main__" in ast.unparse(node.test)


def parse(path: str, module: str, content: bytes | None, problem: str | None) -> dict:
    """The facts of one file; a file that does not parse keeps its row with a problem."""
    none = {"path": path, "module": module, "parsed": False, "docstring": "", "loc": 0, "names": None, "imports": None, "mains": False, "tests": None}
    if content is None:
        return none | {"problem": problem}
    try:
        parsed = ast.parse(text := content.decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n"))
        found = {"docstring": ast.get_docstring(parsed) or "", "names": _names(parsed), "imports": _imports(parsed, module, path.endswith("__init__.py")), "mains": any(map(_is_main, parsed.body))}
    except (RecursionError, MemoryError):  # nested more deeply than the parser can follow
        return none | {"problem": "depth"}
    except (SyntaxError, ValueError) as error:
        return none | {"problem": type(error).__name__}
    tests = [n.name for n in parsed.body if isinstance(n, ast.FunctionDef) and n.name.startswith("test_")]
    tests += [f"{c.name}.{n.name}" for c in parsed.body if isinstance(c, ast.ClassDef) for n in c.body if isinstance(n, ast.FunctionDef) and n.name.startswith("test_")]
    return found | {
        "path": path, "module": module, "parsed": True, "problem": None, "loc": text.count("\n") + bool(text and not text.endswith("\n")),
        "tests": tests,
    }


def records(found: DataFrame) -> DataFrame:
    """One record a module of files (path, content, problem), from a source tree or a committed one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([parse(r.path, r.module, r.content, r.problem) for r in frame.itertuples()], columns=[c.split()[0] for c in RECORD.split(", ")])

    return found.select("path", "content", "problem").withColumn("module", module_of(F.col("path"))).mapInPandas(run, RECORD)


def extract(spark: SparkSession, root: str) -> DataFrame:
    """One record a module of a source tree."""
    return records(files(spark, root))


def uses(records: DataFrame) -> DataFrame:
    """(module, target, names): imports that resolve to modules of the tree, a name of a package being tried as a module first."""
    known = records.select(F.col("module").alias("target"))
    each = records.select("module", F.explode("imports").alias("i")).select("module", "i.target", "i.name")
    deeper = each.where("name <> ''").select("module", F.concat("target", F.lit("."), "name").alias("target"), F.lit("").alias("name"), F.col("target").alias("t0"), F.col("name").alias("n0")).join(known, "target", "left_semi")
    plain = each.join(deeper.select("module", F.col("t0").alias("target"), F.col("n0").alias("name")), ["module", "target", "name"], "left_anti").join(known, "target", "left_semi")
    both = plain.select("module", "target", "name").unionByName(deeper.select("module", "target", "name")).where("module <> target")
    return both.groupBy("module", "target").agg(F.array_sort(F.collect_set(F.nullif("name", F.lit("")))).alias("names"))


def external(records: DataFrame) -> DataFrame:
    """(import, modules): third-party packages with the modules that import them."""
    roots = records.select(F.substring_index("module", ".", 1).alias("top")).distinct()
    standard = [*sys.stdlib_module_names]
    tops = records.select("module", F.explode("imports").alias("i")).select("module", F.substring_index("i.target", ".", 1).alias("top")).where(F.col("top") != "")
    return tops.where(~F.col("top").isin(standard)).join(roots, "top", "left_anti").groupBy(F.col("top").alias("import")).agg(F.array_sort(F.collect_set("module")).alias("modules"))


def entry_points(records: DataFrame) -> DataFrame:
    """(kind, module, name) of the modules that can be started."""
    return records.where("mains").select(F.lit("main").alias("kind"), "module", F.col("module").alias("name"))
