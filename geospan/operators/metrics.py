"""Evaluation metrics over tables with ``pred`` and ``target`` columns; each is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def pred() -> Column:
    return F.col("pred")


def target() -> Column:
    return F.col("target")


def _sum(x: Column) -> Column:
    return F.sum(x.cast("double"))


def _tp() -> Column:
    return _sum(pred() * target())


def iou(smooth: float = 1e-6) -> Column:
    return (_tp() + smooth) / (_sum(pred()) + _sum(target()) - _tp() + smooth)


def dice(smooth: float = 1e-6) -> Column:
    return (2 * _tp() + smooth) / (_sum(pred()) + _sum(target()) + smooth)


def precision() -> Column:
    return _tp() / (_tp() + _sum(pred() * (1 - target())) + EPS)


def recall() -> Column:
    return _tp() / (_tp() + _sum((1 - pred()) * target()) + EPS)


def f1_score() -> Column:
    return 2 * precision() * recall() / (precision() + recall() + EPS)


def accuracy() -> Column:
    return F.avg((pred() == target()).cast("double"))


def mse() -> Column:
    return F.avg((pred() - target()) * (pred() - target()))


def rmse() -> Column:
    return F.sqrt(mse())


def mae() -> Column:
    return F.avg(F.abs(pred() - target()))


def psnr(max_val: float = 1.0) -> Column:
    return 10 * F.log10(max_val**2 / (mse() + EPS))


def psnr_exact(max_val: float = 1.0) -> Column:
    """Infinite where the two agree."""
    return F.when(mse() == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(float(max_val) ** 2) / F.when(mse() == 0, 1.0).otherwise(mse())))


def r_squared() -> Column:
    """From the residuals and the spread of the target, in one pass."""
    spread = F.var_pop(target().cast("double")) * F.count(target())
    return 1 - _sum((target() - pred()) * (target() - pred())) / (spread + EPS)


METRICS = {"iou": iou, "dice": dice, "precision": precision, "recall": recall, "f1": f1_score, "accuracy": accuracy, "mse": mse, "rmse": rmse, "mae": mae, "psnr": psnr, "r2": r_squared}


def evaluate(df: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Several metrics in one pass, optionally by group."""
    return df.groupBy(*(by or [])).agg(*(METRICS[n]().alias(n) for n in names))


def mean_iou(df: DataFrame, classes: int, smooth: float = 1e-6) -> DataFrame:
    """The mean of class-wise overlaps over the classes found in the target; 0 if none is.

    The confusion table has at most classes squared rows; nothing larger is shuffled.
    """
    confusion = df.where(target().between(0, classes - 1) | pred().between(0, classes - 1)).groupBy("pred", "target").agg(F.count("*").alias("n"))
    per = confusion.select(F.explode(F.array_distinct(F.array("pred", "target"))).alias("cls"), "pred", "target", "n").where(F.col("cls").between(0, classes - 1))
    n = F.col("n").cast("double")
    inside = per.groupBy("cls").agg(F.sum(F.when((pred() == F.col("cls")) & (target() == F.col("cls")), n).otherwise(0.0)).alias("both"), F.sum(F.when(pred() == F.col("cls"), n).otherwise(0.0)).alias("p"), F.sum(F.when(target() == F.col("cls"), n).otherwise(0.0)).alias("t"))
    return inside.where("t > 0").agg(F.coalesce(F.avg((F.col("both") + smooth) / (F.col("p") + F.col("t") - F.col("both") + smooth)), F.lit(0.0)).alias("mean_iou"))


def ssim(df: DataFrame, dims: tuple[int, int], window: int = 11, c1: float = 1e-4, c2: float = 9e-4) -> DataFrame:
    """Structural similarity of two rasters from local means."""
    from geospan.operators.focal import uniform

    parts = df.select("row", "col", pred().alias("mp"), target().alias("mt"), (pred() * pred()).alias("pp"), (target() * target()).alias("tt"), (pred() * target()).alias("pt"))
    m = uniform(parts, ["mp", "mt", "pp", "tt", "pt"], window, dims)
    mp, mt, pp, tt, pt = (F.col(n) for n in ("mp", "mt", "pp", "tt", "pt"))
    value = ((2 * mp * mt + c1) * (2 * (pt - mp * mt) + c2)) / ((mp * mp + mt * mt + c1) * ((pp - mp * mp) + (tt - mt * mt) + c2))
    return m.agg(F.avg(value).alias("ssim"))
