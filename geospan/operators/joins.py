"""Joins by order: the latest row before a time, and points in intervals, as equi-joins on cells of the axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], width: float) -> DataFrame:
    """Each left row with the right row of the same ``by`` whose ``on`` is the largest that is not larger; right columns are prefixed with ``r_``.

    ``on`` is numeric on both sides. The axis is cut into cells of ``width``:
    rows are put in order within a key's cell only, and what a cell begins with is
    the last row of the cells before it, of which there is one each. So a key with
    many rows is many tasks. Of right rows that tie the largest by its columns
    counts; left rows with a null in ``on`` or ``by`` find nothing.
    """
    cell = F.floor(F.col("_t") / width)
    l = left.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col(on).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*right.columns)).schema[0].dataType).alias("_r"))  # noqa: E741
    r = right.where(F.col(on).isNotNull()).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col(on).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.struct(*right.columns).alias("_r"))
    keys = [f"_k{i}" for i in range(len(by))]
    both = l.unionByName(r).withColumn("_cell", cell)
    inside = Window.partitionBy(*keys, "_cell").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy(*keys, "_cell").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_r"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*(F.col(k).alias(f"o{k}") for k in keys), F.col("_cell").alias("_o"), F.last("_end", ignorenulls=True).over(before)["_r"].alias("_carry"))
    found = both.withColumn("_own", F.last("_r", ignorenulls=True).over(inside)).where("_side = 1")
    same = [F.col(k) == F.col(f"o{k}") for k in keys] + [F.col("_cell") == F.col("_o")]
    known = F.col("_t").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    out = found.join(carried, same, "left").withColumn("_hit", F.when(known, F.coalesce("_own", "_carry")))
    return out.select("_l.*", *(F.col("_hit")[c].alias(f"r_{c}") for c in right.columns))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of a point and an interval that holds it, ends included; interval columns are prefixed with ``r_``.

    An interval is sent to each cell of ``width`` that it crosses, a point to one,
    so that a pair meets once.
    """
    by = by or []
    cells = F.explode(F.sequence(F.floor(F.col(f"r_{start}") / width), F.floor(F.col(f"r_{end}") / width)))
    spans = intervals.where(F.col(start) <= F.col(end)).select(*(F.col(c).alias(f"r_{c}") for c in intervals.columns)).withColumn("_cell", cells).withColumns({c: F.col(f"r_{c}") for c in by})
    pairs = points.withColumn("_cell", F.floor(F.col(at) / width)).join(spans, ["_cell", *by])
    return pairs.where(F.col(at).between(F.col(f"r_{start}"), F.col(f"r_{end}"))).drop("_cell")


def interval_counts(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float, by: list[str], of: str) -> DataFrame:
    """``of, n``: how many points the intervals of each value of ``of`` hold, ends included; values without any are left out.

    No pair is formed: of a cell of ``width`` the points are counted in order up
    to each end and up to before each start, and the counts of the cells before it
    are carried, of which there is one each. Points at one place are one row.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    own = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    place = lambda c: F.col(c).cast("double").alias("_t")
    none = F.lit(None).cast(intervals.schema[of].dataType).alias("_of")
    held = points.where(F.col(at).isNotNull()).groupBy(*own, place(at)).agg(F.count("*").alias("_m")).select(*keys, "_t", F.lit(1).alias("_turn"), "_m", F.lit(0).alias("_sign"), none)
    spans = intervals.where(F.col(start) <= F.col(end))
    ends = [spans.select(*own, place(c), F.lit(turn).alias("_turn"), F.lit(0).cast("long").alias("_m"), F.lit(sign).alias("_sign"), F.col(of).alias("_of")) for c, turn, sign in ((start, 0, -1), (end, 2, 1))]
    # NaN is the largest number, here as in comparisons.
    cell = F.when(F.isnan("_t"), F.lit(2**63 - 1)).otherwise(F.floor(F.col("_t") / width))
    every = held.unionByName(ends[0]).unionByName(ends[1]).withColumn("_cell", cell)
    for k in keys:
        every = every.where(F.col(k).isNotNull())
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.groupBy(*keys, "_cell").agg(F.sum("_m").alias("_all")).select(*keys, "_cell", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*keys, "_cell").orderBy("_t", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    counted = every.withColumn("_up", F.sum("_m").over(inside)).where("_turn <> 1").join(carried, [*keys, "_cell"])
    return counted.groupBy(F.col("_of").alias(of)).agg(F.sum(F.col("_sign") * (F.col("_up") + F.col("_carry"))).alias("n")).where("n > 0")
