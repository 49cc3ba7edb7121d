"""The model zoo, capabilities and products as tables: registries that are filtered, joined with files and verified as DataFrames."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geospan.operators import arrays, inference, zonal
from geospan.workflow import Pipeline, PipelineConfig, PipelineRegistry, Registry

# The zoo's models by task: name, domain, input channels, and classes (or outputs) of each size; then bytes of each size above the smallest.
TASKS = {
    "detection": (
        ("ship_detector", "maritime", 3, {"tiny": 1, "base": 1, "large": 5}), ("building_detector", "urban", 3, {"tiny": 1, "base": 1, "large": 3}), ("aircraft_detector", "aviation", 3, {"tiny": 1, "base": 1}),
        ("vehicle_detector", "transport", 3, {"tiny": 1, "base": 4}), ("solar_panel_detector", "energy", 3, {"tiny": 1, "base": 2}), ("wind_turbine_detector", "energy", 3, {"tiny": 1, "base": 1}),
        ("oil_tank_detector", "energy", 3, {"tiny": 1, "base": 2}), ("pool_detector", "urban", 3, {"tiny": 1}), ("sar_ship_detector", "sar", 2, {"tiny": 1}),
    ),
    "segmentation": (
        ("segmentation", "general", 3, {"tiny": 2, "base": 6}), ("land_cover", "environment", 3, {"tiny": 5, "base": 8}), ("water_segmentation", "water", 3, {"tiny": 2, "base": 5}), ("flood_mapping", "water", 3, {"tiny": 2, "base": 3}),
        ("crop_segmentation", "agriculture", 3, {"tiny": 2, "base": 7}), ("forest_segmentation", "forestry", 3, {"tiny": 2, "base": 4}), ("road_segmentation", "transport", 3, {"tiny": 2, "base": 5}),
        ("building_footprint", "urban", 3, {"tiny": 2, "base": 4}), ("greenhouse_detector", "agriculture", 3, {"tiny": 2, "base": 3}), ("cloud_segmentation", "imaging", 3, {"tiny": 3, "base": 4}),
        ("sar_segmentation", "sar", 2, {"tiny": 2}), ("sar_oil_spill_detector", "sar", 2, {"tiny": 2}),
    ),
    "change_detection": (("change_detector", "general", 6, {"tiny": 2, "base": 2}), ("urban_change_detector", "urban", 6, {"tiny": 3}), ("deforestation_detector", "forestry", 6, {"tiny": 3, "base": 4})),
    "super_resolution": (("super_resolution", "imaging", 3, {"tiny": 3, "2x": 3, "4x": 3}), ("pan_sharpening", "imaging", 4, {"tiny": 3, "base": 3})),
    "classification": (("scene_classifier", "general", 3, {"tiny": 5, "base": 15}), ("damage_classifier", "risk", 3, {"tiny": 4})),
    "embedding": (("geo_embedding", "general", 3, {"tiny": 256, "base": 768}),),
    "regression": (("yield_predictor", "agriculture", 12, {"tiny": 1, "base": 1}), ("biomass_estimator", "forestry", 6, {"tiny": 1}), ("height_estimator", "urban", 3, {"tiny": 1})),
}
MB = 1 << 20
BYTES = {
    "tiny": {"": 102_400}, "large": {"": 200 * MB}, "2x": {"": 50 * MB}, "4x": {"": 100 * MB},
    "base": {"detection": 50 * MB, "classification": 50 * MB, "segmentation": 100 * MB, "super_resolution": 100 * MB, "regression": 100 * MB, "change_detection": 200 * MB, "embedding": 300 * MB},
}
DOMAINS = ("ai", "tourism", "analysis", "indices", "water", "environment", "forestry", "imaging", "assets", "energy", "urban", "agriculture", "risk", "defense", "sar")
MATURITIES = ("stable", "beta", "research", "deprecated")
LICENSE, VERSION = "Apache-2.0", "1.0.0"

ENTRY = "model_id string, name string, task string, framework string, input_channels int, num_classes int, sha256 string, size_bytes long, license string, source string, version string, domain string, maturity string"


def entries() -> list[dict]:
    """All models of the zoo; the smallest size of each is in the repository, the others are released."""
    out = []
    for task, models in TASKS.items():
        for name, domain, channels, sizes in models:
            for size, classes in sizes.items():
                known = BYTES[size]
                out.append({"model_id": f"{name}_{size}", "name": f"{name}_{size}".replace("_", " ").title(), "task": task, "framework": "pytorch", "input_channels": channels, "num_classes": classes, "sha256": "", "size_bytes": known.get(task, known.get("")), "license": LICENSE, "source": "repo" if size == "tiny" else "release", "version": VERSION, "domain": domain, "maturity": "stable"})
    return out


#: Models, capabilities and loaded models; capabilities are the user's to register.
MODELS = Registry("model_id", ENTRY, "Unknown model")
for _entry in entries():
    MODELS.add(**_entry)
CAPABILITIES = Registry("capability_id", "capability_id string, name string, domain string, description string, maturity string, pipeline_id string, cli_command string", "Unknown capability")


def register_capability(capability_id: str, name: str, domain: str, maturity: str = "stable", **rest) -> None:
    if domain not in DOMAINS or maturity not in MATURITIES:
        raise ValueError(f"Unknown domain or maturity: {domain}, {maturity}")
    CAPABILITIES.add(capability_id=capability_id, name=name, domain=domain, maturity=maturity, **rest)


def models(spark: SparkSession, task: str | None = None, domain: str | None = None) -> DataFrame:
    """The zoo as a table, of one task or domain."""
    out = MODELS.table(spark)
    for name, value in (("task", task), ("domain", domain)):
        out = out.where(F.col(name) == value) if value else out
    return out


def list_models(task: str | None = None, domain: str | None = None) -> list[str]:
    return MODELS.where(task=task, domain=domain)


class Loaded:
    """Models by id, made once by what they were registered with."""

    def __init__(self) -> None:
        self.makers, self.made = {}, {}

    def register(self, model_id: str, maker) -> None:
        self.makers[model_id] = maker

    def get(self, model_id: str):
        """The model, made when first asked for; None for one that is not registered."""
        if model_id not in self.made and model_id in self.makers:
            self.made[model_id] = self.makers[model_id]()
        return self.made.get(model_id)

    def ids(self) -> list[str]:
        return list(self.makers)

    def clear_cache(self) -> None:
        self.made.clear()


# The cache: files below a folder for each model -----------------------------------------------------------------------


def cache_dir(root: str | None = None) -> str:
    """``root``, the folder that GEOSPAN_CACHE names, or one in the user's cache; made if it is not there."""
    where = root or os.environ.get("GEOSPAN_CACHE") or os.path.join(os.path.expanduser("~"), ".cache", "geospan")
    os.makedirs(where, exist_ok=True)
    return where


def model_path(model_id: str, root: str | None = None) -> str:
    return os.path.join(cache_dir(root), model_id)


def is_cached(model_id: str, root: str | None = None) -> bool:
    where = model_path(model_id, root)
    return os.path.isdir(where) and bool(os.listdir(where))


def clear_cache(model_id: str | None = None, root: str | None = None) -> int:
    """Remove one model's files, or all; returns how many models went."""
    gone = [m for m in ([model_id] if model_id else os.listdir(cache_dir(root))) if os.path.isdir(model_path(m, root))]
    for m in gone:
        shutil.rmtree(model_path(m, root))
    return len(gone)


def cache_info(spark: SparkSession, root: str) -> DataFrame:
    """``model_id, files, bytes, mb`` of a cache folder that the executors can read; no rows if nothing is cached."""
    if not any(files for _, _, files in os.walk(root)):
        return spark.createDataFrame([], "model_id string, files long, bytes long, mb double")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.element_at(F.split("path", "/"), -2).alias("model_id"), "length")
    return rows.groupBy("model_id").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).withColumn("mb", F.round(F.col("bytes") / MB, 2))


def integrity(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (``name, checksum``) against a manifest (``name, sha256``): ``name, ok``; files that are gone are not ok."""
    told = manifest.select("name", F.lower("sha256").alias("sha256"))
    return told.join(files.select("name", F.lower("checksum").alias("checksum")), "name", "left").select("name", F.coalesce(F.col("sha256") == F.col("checksum"), F.lit(False)).alias("ok"))


# Products -------------------------------------------------------------------------------------------------------------

# Kinds of products.
PRODUCT_TYPES = ("raster", "vector", "detection", "segmentation", "classification", "index", "change", "dem", "dsm", "mosaic", "composite")


def product(kind: str, name: Column, *sources: Column, **properties: Column) -> Column:
    """A product as a struct: an id made of its kind, name and sources, and its properties."""
    if kind not in PRODUCT_TYPES:
        raise ValueError(f"Unknown product type: {kind}")
    made_of = F.array(*(s.cast("string") for s in sources)) if sources else F.array().cast("array<string>")
    key = F.sha2(F.concat_ws("/", F.lit(kind), name.cast("string"), made_of), 256)
    told = F.create_map(*(x for k, v in properties.items() for x in (F.lit(k), v.cast("string")))) if properties else F.create_map().cast("map<string,string>")
    return F.struct(F.substring(key, 1, 16).alias("product_id"), F.lit(kind).alias("product_type"), name.cast("string").alias("name"), made_of.alias("sources"), told.alias("properties"))


# Pipelines that are registered -----------------------------------------------------------------------------------------


def _with(**made) -> dict:
    return made


@PipelineRegistry.register("ship_detection", "Ship detection", "ai")
def ship_detection() -> Pipeline:
    """``tiles`` and ``scorer`` to ``detections``."""
    return Pipeline(PipelineConfig("ship_detection", "Ship detection"), lambda given: _with(detections=inference.detect(given["tiles"], given["scorer"], inference.DETECTORS["ship"])))


@PipelineRegistry.register("change_detection", "Change detection", "ai")
def change_detection() -> Pipeline:
    """``input1`` and ``input2`` to ``change``."""
    return Pipeline(PipelineConfig("change_detection", "Change detection"), lambda given: _with(change=zonal.change_pair(given["input1"], given["input2"], given.get("threshold", 0.5))))


@PipelineRegistry.register("water_detection", "Water detection", "water")
def water_detection() -> Pipeline:
    """``tiles`` and ``scorer`` to ``mask``."""
    return Pipeline(PipelineConfig("water_detection", "Water detection"), lambda given: _with(mask=inference.segment(given["tiles"], given["scorer"])))


@PipelineRegistry.register("super_resolution", "Super resolution", "imaging")
def super_resolution(scale_factor: float = 2) -> Pipeline:
    """``input`` to ``enhanced``, by ``scale_factor``."""

    def enhance(given: dict) -> dict:
        return _with(enhanced=arrays.by_array(given["input"], lambda a: arrays.cubic_zoom(a, scale_factor), given.get("value", "z")))

    return Pipeline(PipelineConfig("super_resolution", "Super resolution", parameters={"scale_factor": scale_factor}), enhance)
