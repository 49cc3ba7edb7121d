"""Seeded test scenes. What is drawn by chance is a handful of shapes, by the driver and in the generator's order; pixels are made by the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from geospan.operators.raster import grid


class SyntheticGenerator:
    """Images, masks and change pairs from one stream of numbers: the same calls after the same seed give the same scenes."""

    def __init__(self, spark: SparkSession, seed: int = 42):
        self.spark, self.draw = spark, np.random.RandomState(seed)

    def _painted(self, height: int, width: int, most: int, sizes: tuple[int, int]) -> list[tuple]:
        """Squares, cut at the image's edges, with a colour: ``y1, y2, x1, x2, r, g, b``."""
        out = []
        for _ in range(self.draw.randint(1, most)):
            x, y, half = self.draw.randint(10, width - 10), self.draw.randint(10, height - 10), self.draw.randint(*sizes) // 2
            colour = self.draw.rand(3).astype(np.float32) * np.float32(0.5) + np.float32(0.5)
            out.append((max(0, y - half), min(height, y + half), max(0, x - half), min(width, x + half), *map(float, colour)))
        return out

    @staticmethod
    def _under(shape: tuple) -> Column:
        """Whether a pixel is in a square."""
        y1, y2, x1, x2 = map(int, shape[:4])
        return F.col("row").between(y1, y2 - 1) & F.col("col").between(x1, x2 - 1)

    def rgb_image(self, height: int = 64, width: int = 64, add_objects: bool = True) -> DataFrame:
        """``row, col, r, g, b`` between 0 and 1: noise, with bright squares."""
        noise = self.draw.rand(3, height, width).astype(np.float32) * np.float32(0.3) + np.float32(0.2)
        shapes = self._painted(height, width, 5, (5, 15)) if add_objects else []
        return self._image(noise, shapes)

    def _image(self, noise: np.ndarray, shapes: list[tuple]) -> DataFrame:
        import pandas as pd

        r, c = np.indices(noise.shape[1:])
        base = self.spark.createDataFrame(pd.DataFrame({"row": r.ravel(), "col": c.ravel(), **{n: noise[k].ravel().astype(float) for k, n in enumerate("rgb")}}))
        out = [F.col(n) for n in "rgb"]
        for shape in shapes:  # the last one on top
            out = [F.when(self._under(shape), F.lit(colour)).otherwise(below) for colour, below in zip(shape[4:], out, strict=True)]
        return base.select("row", "col", *(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)).alias(n) for v, n in zip(out, "rgb", strict=True)))

    def mask(self, height: int = 64, width: int = 64, num_classes: int = 2) -> DataFrame:
        """``row, col, cls``: discs of a class, the last one on top, on class 0."""
        discs = [(self.draw.randint(0, width), self.draw.randint(0, height), self.draw.randint(10, 30), self.draw.randint(1, num_classes)) for _ in range(self.draw.randint(2, 6))]
        cls = F.lit(0)
        for x, y, radius, kind in discs:
            cls = F.when(F.sqrt((F.col("col") - x) * (F.col("col") - x) + (F.col("row") - y) * (F.col("row") - y)) <= radius, int(kind)).otherwise(cls)
        return grid(self.spark, height, width).select("row", "col", cls.alias("cls"))

    def change_pair(self, height: int = 64, width: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Before, after, and ``row, col, change``."""
        noise = self.draw.rand(3, height, width).astype(np.float32) * np.float32(0.3) + np.float32(0.2)
        there = self._painted(height, width, 5, (5, 15))
        new = self._painted(height, width, 4, (8, 20))
        change = F.lit(0)
        for shape in new:
            change = F.when(self._under(shape), 1).otherwise(change)
        change = grid(self.spark, height, width).select("row", "col", change.alias("change"))
        return self._image(noise, there), self._image(noise, [*there, *new]), change

    def tabular_features(self, num_samples: int = 100, num_features: int = 10) -> DataFrame:
        """``sample, features`` between 0 and 1."""
        values = self.draw.rand(num_samples, num_features).astype(np.float32).astype(float)
        return self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "sample long, features array<double>")


@udtf(returnType="seed: bigint, x: int, y: int, radius: int, cls: int")
class Discs:
    """A table function: the discs of a mask by seed, so that any number of masks is drawn by the executors."""

    def eval(self, seed: int, height: int, width: int, num_classes: int):
        draw = np.random.RandomState(seed)
        for _ in range(draw.randint(2, 6)):
            yield seed, int(draw.randint(0, width)), int(draw.randint(0, height)), int(draw.randint(10, 30)), int(draw.randint(1, num_classes))


def masks(spark: SparkSession, seeds: DataFrame, height: int = 64, width: int = 64, num_classes: int = 2) -> DataFrame:
    """``seed, row, col, cls`` of a mask for each row of ``seeds (seed)``; as ``SyntheticGenerator(seed).mask`` draws it."""
    spark.udtf.register("discs", Discs)
    seeds.select(F.col("seed").cast("bigint")).createOrReplaceTempView("_seeds")
    drawn = spark.sql(f"SELECT d.* FROM _seeds, LATERAL discs(seed, {height}, {width}, {num_classes}) d")
    discs = drawn.groupBy("seed").agg(F.collect_list(F.struct("x", "y", "radius", "cls")).alias("discs"))  # five at most
    pixel = F.explode(F.sequence(F.lit(0), F.lit(height * width - 1)))
    out = discs.withColumn("at", pixel).withColumn("row", F.expr(f"at div {width}")).withColumn("col", F.col("at") % width)
    over = lambda cls, d: F.when(F.sqrt((F.col("col") - d["x"]) * (F.col("col") - d["x"]) + (F.col("row") - d["y"]) * (F.col("row") - d["y"])) <= d["radius"], d["cls"]).otherwise(cls)
    return out.select("seed", "row", "col", F.aggregate("discs", F.lit(0), over).alias("cls"))
