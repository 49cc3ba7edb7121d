"""Priorities from pairwise judgements (the analytic hierarchy process), for many judges at once.

A judgement is a row ``i, j, a``: criterion i counts ``a`` times as much as j. The
weights are the principal eigenvector of a judge's matrix. They are found by
power iteration inside one expression over the matrix as an array, so that any
number of judges is one aggregation and nothing comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Random consistency indices for 1 to 10 criteria; 1.49 from there on.
RANDOM_INDEX = (0.0, 0.0, 0.58, 0.90, 1.12, 1.24, 1.32, 1.41, 1.45, 1.49)
LAST_INDEX = 1.49
#: Power steps; a matrix of judgements is positive, and the second eigenvalue of one that is nearly consistent is small.
STEPS = 60


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _times(matrix: Column, v: Column) -> Column:
    return F.transform(matrix, lambda row: _dot(row, v))


def _scaled(v: Column) -> Column:
    """Divided by the sum, which positive vectors have."""
    return F.aggregate(F.array(v), F.lit(None).cast("array<double>"), lambda _, w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda s, y: s + y)))


def random_index(n: Column, counted_from_one: bool) -> Column:
    """The index of n criteria: at place n of the table, or with ``counted_from_one`` at place n - 1."""
    table = F.array(*map(F.lit, RANDOM_INDEX))
    return F.coalesce(F.get(table, n - 1 if counted_from_one else n), F.lit(LAST_INDEX))


def priorities(judgements: DataFrame, by: list[str], strict: bool = False) -> DataFrame:
    """``*by, criteria, weights, consistency_ratio`` from ``*by, i, j, a``; judgements that are missing are the inverse of their counterpart, or 1.

    ``strict``: the random index of n criteria is taken from place n of the
    published table; otherwise from place n + 1, as results made elsewhere have it.
    """
    pairs = judgements.select(*by, "i", "j", F.col("a").cast("double").alias("a")).where("i IS NOT NULL AND j IS NOT NULL AND a > 0")
    both = pairs.withColumn("told", F.lit(0)).unionByName(pairs.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), (1 / F.col("a")).alias("a")).withColumn("told", F.lit(1)))
    both = both.groupBy(*by, "i", "j").agg(F.min(F.struct("told", "a"))["a"].alias("a"))
    whole = both.groupBy(*by).agg(F.array_sort(F.collect_set("i")).alias("criteria"), F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), "a"))).alias("told"))
    cell = lambda i, j: F.when(i == j, F.lit(1.0)).otherwise(F.coalesce(F.try_element_at(F.col("told"), F.struct(i.alias("i"), j.alias("j"))), F.lit(1.0)))
    whole = whole.withColumn("matrix", F.transform("criteria", lambda i: F.transform("criteria", lambda j: cell(i, j)))).withColumn("n", F.size("criteria"))
    even = F.transform("criteria", lambda _: 1.0 / F.col("n"))
    whole = whole.withColumn("weights", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), even, lambda v, _: _scaled(_times(F.col("matrix"), v))))
    # The weights sum to 1, so the largest eigenvalue is what their image sums to.
    largest = F.aggregate(_times(F.col("matrix"), F.col("weights")), F.lit(0.0), lambda s, x: s + x)
    index = random_index(F.col("n"), strict)
    ratio = F.when((F.col("n") > 1) & (index > 0), (largest - F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0)) / F.nullif(index, F.lit(0.0))).otherwise(0.0)
    return whole.select(*by, "criteria", "weights", ratio.alias("consistency_ratio"))


class AHP:
    """One judge's matrix, for a handful of criteria, without a session."""

    def __init__(self, criteria: list[str], strict: bool = False):
        self.criteria, self.strict, self.weights, self.consistency_ratio = criteria, strict, {}, 0.0

    def fit(self, matrix) -> AHP:
        rows = [[float(a) for a in row] for row in matrix]
        n = len(self.criteria)
        if len(rows) != n or any(len(row) != n for row in rows):
            raise ValueError("the matrix must be square, one row for each criterion")
        image = lambda v: [sum(a * x for a, x in zip(row, v, strict=True)) for row in rows]
        v = [1 / n] * n
        for _ in range(STEPS):
            w = image(v)
            v = [x / sum(w) for x in w]
        place = n - 1 if self.strict else n
        index = RANDOM_INDEX[place] if place < len(RANDOM_INDEX) else LAST_INDEX
        self.weights = dict(zip(self.criteria, v, strict=True))
        self.consistency_ratio = (sum(image(v)) - n) / (n - 1) / index if n > 1 and index else 0.0
        return self

    def is_consistent(self, threshold: float = 0.1) -> bool:
        return self.consistency_ratio < threshold
