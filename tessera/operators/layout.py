"""Geometry: islands, bands, overlaps and grid joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import cut


def islands(spans: DataFrame, by: str) -> DataFrame:
    """Merged runs (by, lo, hi, members) of the overlapping or touching spans (by, lo, hi) of each group."""
    w = Window.partitionBy(by).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0)
    numbered = spans.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("members")).drop("run")


def bands(runs: DataFrame, by: str, end: float) -> DataFrame:
    """Free bands between the runs of a group, before the first and after the last, within 0 and ``end``."""
    w = Window.partitionBy(by).orderBy("lo")
    edge = runs.select(by, "lo", "hi", F.lead("lo").over(w).alias("next"), F.lag("hi").over(w).alias("prev"))
    first = edge.where("prev is null and lo > 0").select(by, F.lit(0.0).alias("lo"), F.col("lo").cast("double").alias("hi"))
    rest = edge.select(by, F.col("hi").cast("double").alias("lo"), F.coalesce("next", F.lit(end)).cast("double").alias("hi")).where("lo < hi")
    return first.unionByName(rest)


def overlapping_boxes(boxes: DataFrame, cell: int) -> DataFrame:
    """Pairs (a < b) of boxes (by, id, x, y, w, h) of one group that overlap, and the shared area.

    Boxes are dealt to the grid cells they touch and joined by cell, so only
    near boxes meet; a pair counts in the cell of its overlap's corner.
    """
    from ..functions.text import overlap_area

    at = lambda v: F.floor(F.col(v) / cell)
    last = lambda v, s: F.floor((F.col(v) + F.col(s) - 1) / cell)
    dealt = boxes.withColumn("cx", F.explode(F.sequence(at("x"), last("x", "w")))).withColumn("cy", F.explode(F.sequence(at("y"), last("y", "h"))))
    a = dealt.select("by", "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in ("id", "x", "y", "w", "h")])
    b = dealt.select("by", "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in ("id", "x", "y", "w", "h")])
    area = overlap_area(*[F.col(f"a_{c}") for c in ("x", "y", "w", "h")], *[F.col(f"b_{c}") for c in ("x", "y", "w", "h")])
    corner = (F.col("cx") == F.floor(F.greatest("a_x", "b_x") / cell)) & (F.col("cy") == F.floor(F.greatest("a_y", "b_y") / cell))
    return a.join(b, ["by", "cx", "cy"]).where("a_id < b_id").withColumn("area", area).where((F.col("area") > 0) & corner).select("by", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "area")


def peaks(spans: DataFrame, by: str) -> DataFrame:
    """Per group, the most spans (lo <= hi) that any one span overlaps, itself included (not a sweep maximum).

    A span overlaps those that begin before its end, without those that end up
    to its start: two running counts over the places of a group, so no pair of
    spans is made. An empty span is in the second count of its own place only.
    """
    whole = spans.where("lo is not null and hi is not null").groupBy(by, "lo", "hi").agg(F.count("*").alias("k"))
    point = lambda v, begin, end, empty: F.struct(F.col(v).alias("v"), begin.alias("begin"), end.alias("end"), empty.alias("empty"))
    none, k = F.lit(0).cast("long"), F.col("k")
    places = whole.select(by, F.inline(F.array(point("lo", k, none, F.when(F.col("lo") == F.col("hi"), k).otherwise(none)), point("hi", none, k, none)))).groupBy(by, "v").agg(F.sum("begin").alias("begin"), F.sum("end").alias("end"), F.sum("empty").alias("empty"))
    upto = Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    told = places.select(by, "v", (F.sum("begin").over(upto) - F.col("begin")).alias("begun"), F.sum("end").over(upto).alias("ended"), "empty")
    begun, ended = told.select(by, F.col("v").alias("hi"), "begun"), told.select(by, F.col("v").alias("lo"), "ended", "empty")
    n = F.col("begun") - F.col("ended") + F.when(F.col("lo") == F.col("hi"), F.col("empty")).otherwise(0)
    return whole.join(begun, [by, "hi"]).join(ended, [by, "lo"]).withColumn("n", n).where("n > 0").groupBy(by).agg(F.max("n").alias("peak"))


def _cells(low, high, cell: int):
    return F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))


def crossed_boxes(segments: DataFrame, boxes: DataFrame, cell: int) -> DataFrame:
    """(by, segment, box): horizontal and vertical segments (by, id, x0, y0, x1, y1) that go into the inside of boxes (by, id, x, y, w, h) of their group.

    Both are dealt to the grid cells that they pass through and joined by cell;
    a pair counts in the first cell that both are in. A segment is horizontal if
    it is at least as wide as high, and lies where it begins.
    """
    flat = F.abs(F.col("y1") - F.col("y0")) <= F.abs(F.col("x1") - F.col("x0"))
    along = segments.select(
        "by", F.col("id").alias("segment"), flat.alias("flat"), F.when(flat, F.col("y0")).otherwise(F.col("x0")).alias("at"),
        F.when(flat, F.least("x0", "x1")).otherwise(F.least("y0", "y1")).alias("lo"), F.when(flat, F.greatest("x0", "x1")).otherwise(F.greatest("y0", "y1")).alias("hi"),
    )
    dealt = along.withColumn("across", F.floor(F.col("at") / cell)).withColumn("place", _cells(F.col("lo"), F.col("hi"), cell))
    # A box as segments of either direction see it: across is where they lie, along where they run.
    seen = boxes.select("by", F.col("id").alias("box"), F.explode(F.array(
        F.struct(F.lit(True).alias("flat"), F.col("y").alias("a0"), (F.col("y") + F.col("h")).alias("a1"), F.col("x").alias("l0"), (F.col("x") + F.col("w")).alias("l1")),
        F.struct(F.lit(False).alias("flat"), F.col("x").alias("a0"), (F.col("x") + F.col("w")).alias("a1"), F.col("y").alias("l0"), (F.col("y") + F.col("h")).alias("l1")),
    )).alias("s")).select("by", "box", "s.*")
    boxed = seen.withColumn("across", _cells(F.col("a0"), F.col("a1"), cell)).withColumn("place", _cells(F.col("l0"), F.col("l1"), cell))
    both = dealt.join(boxed, ["by", "flat", "across", "place"])
    first = F.col("place") == F.floor(F.greatest("lo", "l0") / cell)
    return both.where("a0 < at and at < a1 and lo < l1 and hi > l0").where(first).select("by", "segment", "box")


# How far labels stay from corners, arrow heads and ports, and where along and beside a run they may sit.
CORNER_CLEAR, ARROW_CLEAR, PORT_CLEAR, BESIDE, MARGIN = 12.0, 16.0, 6.0, 4.0, 20.0
GUTTER_OFFSETS = (-38.0, 38.0, -53.0, 53.0)
STEPS, STEP = 10, 0.05


def label_candidates(routes: DataFrame, height: float, canvas: tuple[float, float]) -> DataFrame:
    """(by, id, n, segment, longest, x, y, w, h): places for the labels of routes (by, id, points (x, y), w), best first: the longest segment, its middle, the line before its sides."""
    spots = [0.5] + [0.5 + sign * k * STEP for k in range(1, STEPS + 1) for sign in (-1, 1)]
    segment = F.transform(F.slice("points", 1, F.greatest(F.lit(0), F.size("points") - 1)), lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), F.get("points", i + 1)["x"].alias("x1"), F.get("points", i + 1)["y"].alias("y1")))
    cut_ = routes.select("by", "id", "w", F.size("points").alias("m"), F.posexplode(segment).alias("segment", "s")).select("by", "id", "w", "m", "segment", "s.*")
    long = cut_.withColumn("length", F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0"))).withColumn("flat", F.abs(F.col("y1") - F.col("y0")) < 1e-6)
    order = Window.partitionBy("by", "id").orderBy(F.desc("length"), "segment")
    ranked = long.withColumn("place", F.row_number().over(order))
    high, wide = F.lit(height), F.col("w")
    along, side = F.when(F.col("flat"), wide).otherwise(high), F.when(F.col("flat"), high).otherwise(wide)
    clear0 = F.when(F.col("segment") > 0, CORNER_CLEAR).otherwise(PORT_CLEAR)
    clear1 = F.when(F.col("segment") < F.col("m") - 2, CORNER_CLEAR).otherwise(ARROW_CLEAR)
    free = F.col("length") - clear0 - clear1 - along
    spot = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(spots)]))
    each = ranked.withColumn("free", free).withColumn("half", clear0 + along / 2).withColumn("reach", side / 2 + BESIDE).select("*", spot.alias("spot")).select("*", "spot.i", "spot.t")
    step = F.col("half") + F.col("free") * F.col("t")
    sign = F.when(F.when(F.col("flat"), F.col("x1") > F.col("x0")).otherwise(F.col("y1") > F.col("y0")), 1.0).otherwise(-1.0)
    offsets = F.array(F.lit(0.0), -F.col("reach"), F.col("reach"))
    on_line = each.where("free >= 0").select("*", F.posexplode(offsets).alias("o", "off"))
    on_line = on_line.select(
        "by", "id", "segment", "place", F.lit(0).alias("row"), "i", "o", "w",
        F.when(F.col("flat"), F.col("x0") + sign * step).otherwise(F.col("x0") + F.col("off")).alias("cx"), F.when(F.col("flat"), F.col("y0") + F.col("off")).otherwise(F.col("y0") + sign * step).alias("cy"),
    )
    gutter = each.where("flat").select("*", F.posexplode(F.array(*[F.lit(v) for v in GUTTER_OFFSETS])).alias("o", "off"))
    middle = (F.col("x0") + F.col("x1")) / 2 + (F.col("t") - 0.5) * F.greatest(F.lit(0.0), F.col("length") - 12)
    beside = gutter.select("by", "id", "segment", "place", F.lit(1).alias("row"), "i", "o", "w", middle.alias("cx"), (F.col("y0") + F.col("off")).alias("cy"))
    boxes = on_line.unionByName(beside).withColumn("x", F.col("cx") - wide / 2).withColumn("y", F.col("cy") - height / 2)
    inside = boxes.where((F.col("x") >= -MARGIN) & (F.col("y") >= -MARGIN) & (F.col("x") + wide <= canvas[0] + MARGIN) & (F.col("y") + height <= canvas[1] + MARGIN))
    number = F.row_number().over(Window.partitionBy("by", "id").orderBy("place", "row", "i", "o"))
    return inside.select("by", "id", number.alias("n"), "segment", (F.col("place") == 1).alias("longest"), "x", "y", "w", high.alias("h"))


def _meeting(a: DataFrame, b: DataFrame, cell: int) -> DataFrame:
    """Pairs of boxes of two tables that share area, joined by grid cell, each pair once; columns of b get the prefix b_."""
    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("cx", _cells(F.col("x"), F.col("x") + F.col("w"), cell)).withColumn("cy", _cells(F.col("y"), F.col("y") + F.col("h"), cell))

    other = dealt(b).select("by", "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "by"])
    both = dealt(a).join(other, ["by", "cx", "cy"])
    first = (F.col("cx") == F.floor(F.greatest("x", "b_x") / cell)) & (F.col("cy") == F.floor(F.greatest("y", "b_y") / cell))
    return both.where(first & (F.least(F.col("x") + F.col("w"), F.col("b_x") + F.col("b_w")) > F.greatest("x", "b_x")) & (F.least(F.col("y") + F.col("h"), F.col("b_y") + F.col("b_h")) > F.greatest("y", "b_y"))).drop("cx", "cy")


def place_labels(candidates: DataFrame, obstacles: DataFrame, gap: float, cell: int) -> DataFrame:
    """(by, id, n): for each label the place that a greedy walk gives it: labels by ``rank``, places by n, the first that is free.

    candidates: by, id, rank (of the label, unique in its figure), n, x, y, w, h; obstacles: by, x,
    y, w, h. A label without a free place has no row. Places that conflict
    share a grid cell, so in a round a place is taken if it is the first of its
    label and the first of all in each of its cells; what conflicts with it
    goes. That is the walk's result, as a place is only decided by those before
    it, but all figures, and all parts of a figure that don't touch, go on at
    once, and no table of conflicts is made: of a cell only its first place is
    looked at, and only taken places meet others.
    """
    key, box = ["by", "id", "n"], ["by", "x", "y", "w", "h"]
    own = candidates.select(*key, "rank", "x", "y", "w", "h")
    blocked = _meeting(own.select(*box).distinct(), obstacles.select(*box).distinct(), cell).select(*box).distinct()  # equal places fare alike
    live, taken = cut(own.join(blocked, box, "left_anti")), None
    span = lambda v, s: [F.floor((F.col(v) - gap) / cell), F.floor((F.col(v) + F.col(s) + gap) / cell)]
    while not live.isEmpty():
        (x0, x1), (y0, y1) = span("x", "w"), span("y", "h")
        place = F.struct("rank", "n", "id", "x", "y", "w", "h", "cells").alias("place")
        dealt = live.withColumn("cells", (x1 - x0 + 1) * (y1 - y0 + 1)).select("by", place, F.explode(F.sequence(x0, x1)).alias("cx"), F.sequence(y0, y1).alias("ys")).select("by", "place", "cx", F.explode("ys").alias("cy"))
        firsts = dealt.groupBy("by", "cx", "cy").agg(F.min("place").alias("place"))
        alone = firsts.groupBy("by", "place").agg(F.count("*").alias("k")).where(F.col("k") == F.col("place.cells")).select("by", "place.*")
        label = live.groupBy("by", "id").agg(F.min("n").alias("n"))
        now = cut(alone.join(label, key).select(*key, "x", "y", "w", "h"))
        taken = now.select(*key) if taken is None else taken.unionByName(now.select(*key))
        rest = live.join(now.select("by", "id"), ["by", "id"], "left_anti")
        padded = now.select("by", (F.col("x") - gap).alias("x"), (F.col("y") - gap).alias("y"), (F.col("w") + 2 * gap).alias("w"), (F.col("h") + 2 * gap).alias("h"))
        hit = _meeting(rest.select(*box).distinct(), padded, cell).select(*box).distinct()
        live = cut(rest.join(hit, box, "left_anti"))
    return candidates.select(*key).limit(0) if taken is None else taken
