"""Reading and writing fact snapshots and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODULE_LINE = "module string, file string, package string, loc long, sha string, docstring string, names array<string>, uses map<string,array<string>>, parsed boolean, unresolved array<string>, _bad string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Module records, one JSON object a line; malformed lines stay with their text in ``_bad``."""
    return spark.read.schema(MODULE_LINE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def write(modules: DataFrame, path: str) -> None:
    """Module records, one JSON object a line, in order of the module over all files."""
    modules.repartitionByRange("module").sortWithinPartitions("module").write.option("ignoreNullFields", False).json(path)


def lines(modules: DataFrame) -> DataFrame:
    """The same lines as a column."""
    return modules.select("module", F.to_json(F.struct(*sorted(modules.columns)), {"ignoreNullFields": "false"}).alias("line"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def strip_comments(text):
    """Column: JSON without // and /* */ comments outside strings and without trailing commas."""
    bare = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    return F.regexp_replace(bare, r'("(?:[^"\\]|\\.)*+")|,(?=\s*[}\]])', "$1")


#: Lists of names by kind, as records of older schemas have them.
OLDER = {"functions": "function", "classes": "class", "errors": "error", "types": "type", "constants": "constant"}


def public_names(records: DataFrame) -> DataFrame:
    """(module, name, kind) of records: from ``names`` (name, kind), or where that is null from the lists of each kind that the records have."""

    def of(column: str, kind: str):
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))

    lists = [of(c, kind) for c, kind in OLDER.items() if c in records.columns]
    own = F.coalesce("names", F.concat(*lists)) if lists else F.col("names")
    return records.select("module", F.explode(own).alias("n")).select("module", "n.name", "n.kind")
