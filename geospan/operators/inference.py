"""Model inference over tiles: a pluggable scorer in Arrow batches, and what surrounds it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geospan.operators.vector import suppress

BOXES = "tile_row long, tile_col long, class_id int, class_name string, conf double, x1 double, y1 double, x2 double, y2 double"


@dataclass(frozen=True)
class Detector:
    """Names of the classes, tile size and overlap of a detector; the scorer is given by the user."""

    model_id: str
    class_names: tuple[str, ...]
    tile_size: int = 512
    overlap: int = 64
    threshold: float = 0.5


DETECTORS = {
    "ship": Detector("ship_detector", ("ship",)), "building": Detector("building_detector", ("building",)), "aircraft": Detector("aircraft_detector", ("aircraft",)),
    "vehicle": Detector("vehicle_detector", ("vehicle", "car", "truck")),
}
SEGMENTERS = {"water": ("background", "water"), "crop": ("background", "crop"), "greenhouse": ("background", "greenhouse"), "change": ("no_change", "change")}


def detect(tiles: DataFrame, scorer: Callable[[np.ndarray], list[tuple[int, float, float, float, float, float]]], detector: Detector) -> DataFrame:
    """Boxes of all tiles in image coordinates, overlapping ones suppressed by image.

    ``tiles``: ``image, tile_row, tile_col, row_off, col_off, height, width,
    data``. The scorer takes a (height, width) array and gives (class, confidence,
    x1, y1, x2, y2) in tile coordinates.
    """
    names, least = detector.class_names, detector.threshold
    ddl = "image long, id long, " + BOXES

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for t in pdf.itertuples():
                array = np.asarray(t.data, np.float32).reshape(t.height, t.width)
                for n, (k, conf, x1, y1, x2, y2) in enumerate(scorer(array)):
                    if conf >= least:
                        rows.append((t.image, ((t.tile_row << 24) + t.tile_col << 16) + n, t.tile_row, t.tile_col, k, names[k], conf, x1 + t.col_off, y1 + t.row_off, x2 + t.col_off, y2 + t.row_off))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ddl.split(", ")])

    return suppress(tiles.mapInPandas(run, ddl))


def segment(tiles: DataFrame, scorer: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``row, col, cls, seq`` of all tile pixels; mosaicking takes the last tile of a pixel."""
    ddl = "row long, col long, cls int, seq long"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for t in pdf.itertuples():
                cls = np.asarray(scorer(np.asarray(t.data, np.float32).reshape(t.height, t.width)))
                r, c = np.indices(cls.shape)
                yield pd.DataFrame({"row": r.ravel() + t.row_off, "col": c.ravel() + t.col_off, "cls": cls.ravel().astype("int32"), "seq": (t.tile_row << 20) + t.tile_col})

    return tiles.mapInPandas(run, ddl)


def onnx_scores(df: DataFrame, model: bytes, vector: str, key: str) -> DataFrame:
    """``key, scores``: an ONNX model over an array column, one session for each Python worker; the model is sent once a task."""
    ddl = f"{key} long, scores array<float>"

    def run(batches):
        import onnxruntime
        import pandas as pd

        session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for pdf in batches:
            out = session.run(None, {name: np.stack(pdf[vector].to_numpy()).astype(np.float32)})[0]
            yield pd.DataFrame({key: pdf[key], "scores": list(out.reshape(len(pdf), -1))})

    return df.select(F.col(key).cast("long").alias(key), vector).mapInPandas(run, ddl)


def _parts(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """For pixels in order of row and column, without repeats: the index of the first pixel of the 4-connected part of each."""
    if not len(rows):
        return np.zeros(0, np.int64)
    begins = np.r_[True, (np.diff(rows) != 0) | (np.diff(cols) != 1)]
    first, run = np.flatnonzero(begins), np.cumsum(begins) - 1
    # The pixel below: rows and columns of a block as one number.
    low, wide = int(cols.min()), int(cols.max() - cols.min()) + 2
    at = (rows - rows[0]) * wide + (cols - low)
    below = np.searchsorted(at, at + wide)
    hit = np.flatnonzero(at[np.minimum(below, len(at) - 1)] == at + wide)
    u, v, root = run[hit], run[below[hit]], np.arange(len(first))
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return first[root[run]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


def small_objects_removed(df: DataFrame, least: int = 100, value: str = "mask", band: int = 512) -> DataFrame:
    """A mask without 4-connected parts of ``least`` pixels or fewer.

    The raster is cut into blocks of ``band`` by ``band`` pixels, whose parts are
    found in one task each. Parts that touch across the edges of blocks, of which
    there are few, are joined by large and small stars over tables.
    """
    from geospan.checkpoints import saved as _saved
    from geospan.components import components

    kinds = {c: df.schema[c].dataType.simpleString() for c in ("row", "col")}

    def run(pdf):
        pdf = pdf.sort_values(["row", "col"], kind="stable", ignore_index=True)
        rows, cols = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        own = pdf["on"].to_numpy().nonzero()[0]
        new = np.r_[True, (np.diff(rows[own]) != 0) | (np.diff(cols[own]) != 0)][: len(own)]
        once = own[new]
        part = once[_parts(rows[once].astype(np.int64), cols[once].astype(np.int64))] if len(own) else own
        first = np.full(len(pdf), -1)
        first[own] = part[np.cumsum(new) - 1]
        return pdf.assign(prow=np.where(first < 0, 0, rows[first]), pcol=np.where(first < 0, 0, cols[first]), on=first >= 0)

    whole = (F.col("row").isNotNull()) & F.col("col").isNotNull()
    block = [F.floor(F.col(c) / band).alias(f"_{c}") for c in ("row", "col")]
    pixels = df.select("row", "col", F.coalesce(F.col(value) > 0, F.lit(False)).alias("on"))
    ddl = f"row {kinds['row']}, col {kinds['col']}, on boolean, prow long, pcol long"
    labelled = _saved(pixels.where(whole).groupBy(*block).applyInPandas(run, ddl).select("row", "col", F.when(F.col("on"), F.struct("prow", "pcol")).alias("part")))
    on = labelled.where("part IS NOT NULL")
    touch = None
    for axis, other in (("row", "col"), ("col", "row")):
        here = on.where(F.pmod(axis, F.lit(band)) == band - 1).select((F.col(axis) + 1).alias(axis), other, F.col("part").alias("u"))
        pairs = here.join(on.where(F.pmod(axis, F.lit(band)) == 0).select("row", "col", F.col("part").alias("v")), ["row", "col"]).select("u", "v")
        touch = pairs if touch is None else touch.unionByName(pairs)
    joined = components(touch)
    sizes = _saved(on.groupBy("part").agg(F.countDistinct("row", "col").alias("n")).join(joined.withColumnRenamed("node", "part"), "part", "left").withColumn("component", F.coalesce("component", "part")))
    large = sizes.groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") > least).select("component")
    kept = sizes.join(large, "component", "left_semi").select("part", F.lit(1).alias("_on"))
    out = labelled.join(kept, "part", "left").select("row", "col", F.coalesce("_on", F.lit(0)).alias(value))
    return out.unionByName(pixels.where(~whole).select("row", "col", F.lit(0).alias(value)))
