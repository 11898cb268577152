"""Growth over time: sampling, windows and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gap_sample(days: DataFrame, every: int, by: list[str] | None = None) -> DataFrame:
    """(seq, day) kept when ``every`` or more days passed since the last kept one; the last row is always kept.

    Rows (…by, seq, day) are folded in order of seq, one fold a group, over the
    group's distinct days: what is kept depends on what was kept before, which
    no window frame can express.
    """
    by = by or []
    first = days.groupBy(*by, "day").agg(F.min("seq").alias("seq"))  # only the first row of a day can be kept
    folded = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "day"))).alias("rows"))
    kept = F.aggregate("rows", F.expr("cast(array() as array<struct<seq:bigint,day:date>>)"), lambda acc, x: F.when((F.size(acc) == 0) | (F.datediff(x["day"], F.element_at(acc, -1)["day"]) >= every), F.concat(acc, F.array(x))).otherwise(acc))
    rows = folded.select(*by, F.explode(kept).alias("r")).select(*by, "r.seq", "r.day")
    head = days.groupBy(*by).agg(F.max(F.struct("seq", "day")).alias("r")).select(*by, "r.seq", "r.day")
    return rows.unionByName(head).distinct()


def windows(samples: DataFrame, measures: list[str]) -> DataFrame:
    """Differences of consecutive samples by seq."""
    w = Window.orderBy("seq")  # samples of one history, a bounded table
    before = [F.lag(m).over(w).alias(f"b_{m}") for m in measures]
    rows = samples.select("seq", *measures, F.lag("seq").over(w).alias("base"), *before).where("base is not null")
    return rows.select("base", F.col("seq").alias("head"), *[(F.col(m) - F.col(f"b_{m}")).alias(m) for m in measures])


def largest(rows: DataFrame, size: str, tie: str, k: int) -> DataFrame:
    """The k largest rows; of equal sizes the latest first."""
    return rows.orderBy(F.desc(size), F.desc(tie)).limit(k)


def growth(cards: DataFrame) -> DataFrame:
    """(seq, card, grew): change of each card's count between consecutive samples; absent counts as 0."""
    seqs = cards.select("seq").distinct().withColumn("n", F.row_number().over(Window.orderBy("seq")))
    numbered = cards.join(F.broadcast(seqs), "seq")  # samples: a bounded table
    a = numbered.select("card", "n", F.col("count").alias("now"))
    b = numbered.select("card", (F.col("n") + 1).alias("n"), F.col("count").alias("was"))
    last = seqs.agg(F.max("n").alias("last"))
    rows = a.join(b, ["card", "n"], "full_outer").join(F.broadcast(last)).where("n > 1 and n <= last")
    grew = F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))
    return rows.withColumn("grew", grew).where("grew <> 0").join(F.broadcast(seqs), "n").select("seq", "card", "grew")
