"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def auc(rows: DataFrame) -> DataFrame:
    """Chance that a true row scores above a false one, ties one half; NaN without one of both. rows: p, label.

    Rows are counted by score first, so the ordered window runs over distinct scores.
    """
    by = rows.groupBy("p").agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = by.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2))
    return wins.agg((F.sum("wins") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def sweep(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """(t, found, suggested): shares of true and of false rows at or above each threshold of a short grid."""
    share = lambda of: F.count_if(of & (F.col("p") >= F.col("t"))) / F.count_if(of)
    return rows.crossJoin(F.broadcast(grid)).groupBy("t").agg(share(F.col("label")).alias("found"), share(~F.col("label")).alias("suggested"))


def threshold_within(curve: DataFrame, budget: float) -> DataFrame:
    """The least threshold that suggests at most ``budget`` of the false rows."""
    return curve.where(F.col("suggested") <= budget).agg(F.min("t").alias("t"))


def index_quantile(rows: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """The value at index int(n q) of each sorted group (not interpolated)."""
    w = Window.partitionBy(by).orderBy(value)
    ranked = rows.select(by, F.col(value).alias("v"), (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy(by)).alias("n"))
    return ranked.where(F.col("i") == F.floor(F.col("n") * q)).select(by, "v")


def pairwise(rows: DataFrame) -> DataFrame:
    """Pair precision, recall and F1 of two clusterings (truth, guess) by contingency counts, without pairs."""
    pairs = lambda *by: rows.groupBy(*by).count().agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0)).alias("n"))
    both, truth, guess = pairs("truth", "guess"), pairs("truth"), pairs("guess")
    one = both.select(F.col("n").alias("b")).crossJoin(truth.select(F.col("n").alias("t"))).crossJoin(guess.select(F.col("n").alias("g")))  # one row each
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("b"), F.col("g")), share(F.col("b"), F.col("t"))
    return one.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def leave_one_out(rows: DataFrame) -> DataFrame:
    """(id, guess): the most frequent owner among the other rows of the same package; ties by name; null without others."""
    n = rows.groupBy("package", "owner").agg(F.count("*").alias("n"))
    # only the two most frequent owners can win once a row takes itself away, and its own
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("package").orderBy(F.desc("n"), "owner"))).where("r <= 2")
    lists = top.groupBy("package").agg(F.sort_array(F.collect_list(F.struct("r", "owner", "n"))).alias("top"))  # two entries
    joined = rows.join(n.withColumnRenamed("n", "own"), ["package", "owner"]).join(lists, "package")
    options = F.concat(F.filter("top", lambda x: x["owner"] != F.col("owner")), F.array(F.struct(F.lit(0).alias("r"), F.col("owner").alias("owner"), (F.col("own") - 1).alias("n"))))
    best = F.array_min(F.transform(F.filter(options, lambda x: x["n"] > 0), lambda x: F.struct((-x["n"]).alias("m"), x["owner"].alias("owner"))))
    return joined.select("id", best["owner"].alias("guess"))
