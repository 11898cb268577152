"""Shape checks of JSON documents by a table of rules.

A document is a table of its values (``values``); a rule table says, for each
type, which keys it has, of which type their values are, and what a value must
be. Types go down from the root in rounds, an equi-join of a level's values with
the rules by (type, key). Every check is then a filter or an anti-join over all
documents at once. A problem has a rank (the order in which a walk along the
rules would meet it), so the first problem of a document is a minimum.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut

VALUES = "doc string, id int, parent int, key string, spot int, kind string, text string, depth int"
RULES = "type string, pos int, key string, child string, required boolean, nullable boolean"
TYPES = "type string, kind string, plain boolean"
MAX_DEPTH = 32
# What a value of a kind must be.
MUST = {"text": "must be a text value", "integer": "must be an integer", "boolean": "must be true or false", "object": "must be an object", "list": "must be a list", "path": "must be a text value", "name": "must be a text value", "any": ""}
RELATIVE, CONTROL, KEYS = "must be a relative path", "must not contain a control character", "has a key with a control character"


def values(documents: DataFrame) -> DataFrame:
    """(doc, id, parent, key, spot, kind, text, depth) of each value of documents (doc, content): ids parents first, spot the place in its parent. A document that is no JSON has one value of kind ``broken``."""
    types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())

    def flat(doc: str, content) -> Iterator[tuple]:
        try:
            open_ = [(json.loads(content or ""), -1, "", 0, 1)]
        except (ValueError, RecursionError) as error:
            yield doc, 0, -1, "", 0, "broken", str(error), 1
            return
        n = 0
        while open_:
            value, parent, key, spot, depth = open_.pop()
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else {str: "text", int: "integer", float: "number", dict: "object", list: "list"}[type(value)]
            yield doc, n, parent, key, spot, kind, value if kind == "text" else None if kind in ("object", "list") else json.dumps(value), depth
            items = value.items() if kind == "object" else ((str(i), v) for i, v in enumerate(value)) if kind == "list" else ()
            open_ += reversed([(v, n, k, i, depth + 1) for i, (k, v) in enumerate(items)])
            n += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in VALUES.split(", ")]
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(flat(doc, content))
                for at in range(0, len(rows), 50_000):
                    columns = [[None if isinstance(v, str) and not _whole(v) else v for v in c] for c in zip(*rows[at : at + 50_000])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return documents.select("doc", "content").mapInArrow(run, VALUES)


def _whole(text: str) -> bool:
    try:
        text.encode()
    except UnicodeEncodeError:  # half a surrogate pair
        return False
    return True


def rules(spark: SparkSession, schema: dict) -> tuple[DataFrame, DataFrame]:
    """The rule table and the table of types of a schema.

    schema: type -> a kind, a list or map of a type (``["list", type]``, ``["map", type]``), or a
    record: key -> type, with ``!`` before a key that is required and ``?`` after a
    type that may be null; ``" plain"`` after map: keys without control characters.
    """
    links, kinds = [], []
    for name, shape in schema.items():
        if isinstance(shape, str):
            kinds.append((name, shape, False))
        elif isinstance(shape, list):
            kind, child = shape
            kinds.append((name, "list" if kind == "list" else "object", kind.endswith("plain")))
            links.append((name, 0, "*", child.rstrip("?"), False, child.endswith("?")))
        else:
            kinds.append((name, "object", False))
            ordered = sorted(shape, key=lambda k: not k.startswith("!"))
            links += [(name, i, k.lstrip("!"), shape[k].rstrip("?"), k.startswith("!"), shape[k].endswith("?")) for i, k in enumerate(ordered)]
    return spark.createDataFrame(links, RULES), spark.createDataFrame(kinds, TYPES)


def typed(found: DataFrame, rule: DataFrame, root: str) -> DataFrame:
    """found with type, rank and keys of each value that the rules reach: rank orders problems, keys lead to the value."""
    none = F.array().cast("array<int>")
    level = cut(found.where("parent = -1").select("*", F.lit(root).alias("type"), F.lit(False).alias("nullable"), none.alias("rank"), F.array().cast("array<string>").alias("keys"), F.lit("").alias("above")))
    links = F.broadcast(rule)  # the rules of one schema
    reached = level
    while True:
        up = level.select("doc", F.col("id").alias("parent"), F.col("type").alias("p_type"), F.col("kind").alias("p_kind"), F.col("rank").alias("p_rank"), F.col("keys").alias("p_keys"))
        below = found.join(up, ["doc", "parent"]).join(links.select(F.col("type").alias("p_type"), "pos", F.col("key").alias("r_key"), "child", F.col("nullable")), "p_type").where("r_key = key or r_key = '*'")
        place = F.when(F.col("r_key") == "*", F.col("spot")).otherwise(F.col("pos"))
        shown = F.when(F.col("p_kind") == "list", F.concat(F.lit("["), "key", F.lit("]"))).otherwise(F.concat(F.lit("["), F.to_json(F.struct("key")), F.lit("]")))
        shown = F.regexp_replace(shown, r'^\[\{"key":(.*)\}\]$', "[$1]")
        level = cut(below.select(*found.columns, F.col("child").alias("type"), "nullable", F.array_append("p_rank", place).alias("rank"), F.array_append("p_keys", shown).alias("keys"), F.col("p_kind").alias("above")))
        if level.isEmpty():
            return reached
        reached = reached.unionByName(level)


def problems(documents: DataFrame, schema: dict, root: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(doc, rank, keys, requirement) of every value that breaks a rule, and of documents that are too deep or no JSON."""
    found = cut(values(documents))
    rule, types = rules(documents.sparkSession, schema)
    judged = types.select("type", F.col("kind").alias("must"), "plain")
    own = cut(typed(found, rule, root).join(F.broadcast(judged), "type"))
    checked = own.select("doc", "id", "type", "rank", F.array_join("keys", "").alias("keys"), "nullable", "plain", "text", "must", F.col("kind").alias("is"))
    null_ok = F.col("nullable") & (F.col("is") == "null")
    texts = F.col("must").isin("path", "name")
    fits = (F.col("must") == "any") | (F.col("is") == F.col("must")) | (texts & (F.col("is") == "text"))
    said = F.coalesce(*[F.when(F.col("must") == kind, text) for kind, text in MUST.items()])
    absolute = F.regexp_like("text", F.lit(r"^(/|\\|[A-Za-z]:)"))
    control = F.regexp_like("text", F.lit(r"[\x00-\x1f\x7f]"))
    wrong = (
        F.when(null_ok, F.lit(None)).when(~fits, said).when((F.col("must") == "path") & absolute, RELATIVE).when(texts & control, CONTROL)
    )
    values_wrong = checked.withColumn("requirement", wrong).where("requirement is not null").select("doc", "rank", "keys", "requirement")
    objects = checked.where(F.col("is") == "object").select("doc", F.col("id").alias("parent"), "type", "rank", "keys", "plain")
    has = found.select("doc", "parent", "key")
    needed = objects.join(F.broadcast(rule.where("required")), "type").join(has, ["doc", "parent", "key"], "left_anti")
    minus = F.lit(-1)
    missing = needed.select("doc", F.concat("rank", F.array(minus, F.col("pos"))).alias("rank"), "keys", F.concat(F.lit('has no "'), "key", F.lit('" key')).alias("requirement"))
    odd = objects.where("plain").join(has.where(F.regexp_like("key", F.lit(r"[\x00-\x1f\x7f]"))), ["doc", "parent"]).select("doc", F.array_append("rank", minus).alias("rank"), "keys", F.lit(KEYS).alias("requirement")).distinct()
    first = F.array(F.lit(-2))
    deep = found.where(F.col("kind").isin("object", "list") & (F.col("depth") > max_depth)).select("doc").distinct().select("doc", first.alias("rank"), F.lit("").alias("keys"), F.lit(f"the JSON value has more than {max_depth} levels").alias("requirement"))
    broken = found.where("kind = 'broken'").select("doc", first.alias("rank"), F.lit("").alias("keys"), F.lit("the file is not JSON").alias("requirement"))
    return values_wrong.join(broken.select("doc"), "doc", "left_anti").unionByName(missing).unionByName(odd).unionByName(deep).unionByName(broken)


def first_problem(found: DataFrame) -> DataFrame:
    """(doc, problem): the first problem of each document as text."""
    text = F.when(F.array_contains("rank", -2), F.col("requirement")).when(F.col("keys") == "", F.concat(F.lit("the file "), "requirement")).otherwise(F.concat(F.lit("the value at "), "keys", F.lit(" "), "requirement"))
    return found.groupBy("doc").agg(F.min_by(text, "rank").alias("problem"))
