"""GeoJSON, GeoParquet and well-known binary points: features as rows, with envelopes."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GEOJSON = "crs struct<properties: struct<name: string>>, features array<struct<id: string, geometry: struct<type: string, coordinates: string>, properties: string>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``id, type, coordinates, properties, crs``: coordinates and properties are JSON text; the CRS defaults to EPSG:4326."""
    return from_geojson(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"), "json")


def from_geojson(df: DataFrame, column: str) -> DataFrame:
    """Feature collections in a text column, one row for each feature."""
    parsed = df.select(F.from_json(column, GEOJSON).alias("c")).select(F.coalesce("c.crs.properties.name", F.lit("EPSG:4326")).alias("crs"), F.explode("c.features").alias("f"))
    return parsed.select("f.id", "f.geometry.type", "f.geometry.coordinates", "f.properties", "crs")


def point_of(coordinates: Column) -> tuple[Column, Column]:
    xy = F.from_json(coordinates, "array<double>")
    return xy[0], xy[1]


def ring_of(coordinates: Column) -> Column:
    """The outer ring of a polygon."""
    return F.transform(F.from_json(coordinates, "array<array<array<double>>>")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def write_geojson(path: str, data: dict, indent: int | None = 2) -> None:
    """A collection that the driver holds, as one file."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=indent, ensure_ascii=False)


def geometry_to_feature(geometry: dict, properties: dict | None = None, key: str | int | None = None) -> dict:
    out = {"type": "Feature", "geometry": geometry, "properties": properties or {}}
    return {**out, "id": key} if key else out


def features_to_geojson(features: Iterable[dict], crs: str | None = None) -> dict:
    out: dict = {"type": "FeatureCollection", "features": list(features)}
    if crs:
        out["crs"] = {"type": "name", "properties": {"name": crs}}
    return out


def write_feature_lines(df: DataFrame, column: str, path: str) -> None:
    """Features as JSON text, one a line, by all executors."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def point_wkb(x: Column, y: Column) -> Column:
    """Little-endian well-known binary of points; bytes of a double come from its arrow column."""

    @F.pandas_udf("binary")
    def pack(a, b):
        return (a.combine(b, lambda p, q: struct.pack("<BIdd", 1, 1, p, q))).astype(object)

    return pack(x.cast("double"), y.cast("double"))


def from_point_wkb(geometry: Column) -> Column:
    @F.pandas_udf("x double, y double")
    def unpack(values):
        import pandas as pd

        return pd.DataFrame([struct.unpack(("<" if v[0] == 1 else ">") + "dd", v[5:21]) if v is not None else (None, None) for v in values], columns=["x", "y"])

    return unpack(geometry)


def read_geoparquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_geoparquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """``path, n, shape, attributes`` of ``.shp`` files and the tables beside them, from any store; points, lines and polygons of the plane.

    A shape's rings are put together by their direction: holes go into the ring
    before them. Attributes are texts by name.
    """
    from geospan.operators.overlay import SHAPE

    files = spark.read.format("binaryFile").load([path, path[:-4] + ".dbf"]) if path.lower().endswith(".shp") else spark.read.format("binaryFile").load(path)
    stem, kind = F.regexp_replace("path", "(?i)\\.(shp|dbf)$", ""), F.lower(F.right("path", F.lit(3)))
    both = files.select(stem.alias("path"), kind.alias("kind"), "content").where(F.col("kind").isin("shp", "dbf")).groupBy("path").agg(F.max(F.when(F.col("kind") == "shp", F.col("content"))).alias("shp"), F.max(F.when(F.col("kind") == "dbf", F.col("content"))).alias("dbf"))

    def read(shp, dbf):
        from geospan.operators.overlay import _out

        rows = list(_dbf(bytes(dbf))) if dbf else []
        return [{"n": n, "shape": _out(shape), "attributes": rows[n] if n < len(rows) else {}} for n, shape in enumerate(_shp(bytes(shp)))]

    made = F.udf(read, f"array<struct<n:int,shape:{SHAPE},attributes:map<string,string>>>", useArrow=True)
    return both.where("shp IS NOT NULL").select("path", F.explode(made("shp", "dbf")).alias("f")).select("path", "f.*")


def _shp(data: bytes) -> Iterator[tuple | None]:
    """Shapes of a file: null ones are None."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("no shape file")
    at = 100
    while at + 8 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        kind = struct.unpack("<i", body[:4])[0] % 10  # with heights or measures, the same comes first
        if kind == 0:
            yield None
        elif kind == 1:
            yield "point", [[[struct.unpack("<dd", body[4:20])]]]
        elif kind == 8:
            n = struct.unpack("<i", body[36:40])[0]
            yield "point", [[[struct.unpack_from("<dd", body, 40 + 16 * i)]] for i in range(n)]
        elif kind in (3, 5):
            parts, n = struct.unpack("<ii", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), n]
            points = [struct.unpack_from("<dd", body, 44 + 4 * parts + 16 * i) for i in range(n)]
            runs = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            if kind == 3:
                yield "line", [[run] for run in runs]
            else:
                whole: list = []
                for run in runs:  # outer rings turn right
                    if whole and sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(run, run[1:], strict=False)) > 0:
                        whole[-1].append(run)
                    else:
                        whole.append([run])
                yield "polygon", whole
        else:
            raise ValueError(f"shapes of kind {kind} are not read")


def _dbf(data: bytes) -> Iterator[dict[str, str]]:
    """Rows of the table beside a shape file; deleted ones stay in their place, empty."""
    n, head, size = struct.unpack("<iHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    for i in range(n):
        row = data[head + i * size : head + (i + 1) * size]
        out, place = {}, 1
        for name, width in fields:
            out[name] = row[place : place + width].decode("latin-1").strip()
            place += width
        yield {} if row[:1] == b"*" else out


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """``path, layer, fid, shape, attributes`` (JSON text) of the feature tables of GeoPackage files, from any store; a file must fit in a row."""
    from geospan.operators.overlay import SHAPE

    def read(content):
        import sqlite3

        from geospan.functions import shapes
        from geospan.operators.overlay import _out

        con = sqlite3.connect(":memory:")
        con.deserialize(bytes(content))
        out = []
        for table, column in con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY 1"):
            if layer and table != layer:
                continue
            rows = con.execute(f'SELECT rowid, * FROM "{table}"')
            names = [d[0] for d in rows.description]
            for row in rows:
                told = dict(zip(names[1:], row[1:], strict=True))
                blob = told.pop(column)
                # A header of eight bytes, and an envelope whose kind three of its bits tell.
                skip = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] if blob else 0
                out.append({"layer": table, "fid": row[0], "shape": _out(shapes.of_wkb(blob[skip:])) if blob else None, "attributes": json.dumps({k: v for k, v in told.items() if not isinstance(v, bytes)})})
        con.close()
        return out

    made = F.udf(read, f"array<struct<layer:string,fid:bigint,shape:{SHAPE},attributes:string>>", useArrow=True)
    return spark.read.format("binaryFile").load(path).select("path", F.explode(made("content")).alias("f")).select("path", "f.*")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """By suffix."""
    suffix = path.lower().rsplit(".", 1)[-1]
    readers = {"parquet": read_geoparquet, "json": read_geojson, "geojson": read_geojson, "shp": read_shapefile, "gpkg": read_geopackage}
    if suffix not in readers:
        raise ValueError(f"no reader for .{suffix} here: convert it to GeoParquet or GeoJSON")
    return readers[suffix](spark, path)


def write_features(df: DataFrame, path: str, shape: str = "shape") -> None:
    """Shapes and attributes by suffix: GeoParquet with binary shapes, or GeoJSON features, one a line; both by all executors."""
    from geospan.operators import overlay as O

    rest = [c for c in df.columns if c != shape]
    if path.lower().endswith(".parquet"):
        write_geoparquet(df.withColumn("geometry", O.to_wkb(F.col(shape))).drop(shape), path)
    elif path.lower().endswith((".geojson", ".geojsonl", ".json")):
        head = F.concat(F.lit('{"type":"Feature","geometry":'), O.to_geojson(F.col(shape)), F.lit(',"properties":'), F.to_json(F.struct(*rest)) if rest else F.lit("{}"), F.lit("}"))
        write_feature_lines(df.select(head.alias("feature")), "feature", path)
    else:
        raise ValueError(f"no writer for {path}")


def stac_items(df: DataFrame, column: str) -> DataFrame:
    """Catalogue search answers in a text column: ``id, xmin, ymin, xmax, ymax, ts, collection, properties, assets``."""
    schema = "features array<struct<id: string, collection: string, bbox: array<double>, properties: string, assets: map<string, struct<href: string>>>>"
    f = df.select(F.explode(F.from_json(column, schema)["features"]).alias("f"))
    box = [F.coalesce(F.get("f.bbox", F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))]
    when = F.try_to_timestamp(F.get_json_object("f.properties", "$.datetime"))
    return f.select("f.id", *box, when.alias("ts"), "f.collection", "f.properties", F.transform_values("f.assets", lambda _, a: a["href"]).alias("assets"))


def asset(df: DataFrame, key: str = "visual") -> DataFrame:
    """The address of an asset; an item without it is an error that lists what there is."""
    there = F.try_element_at("assets", F.lit(key))
    return df.withColumn("href", F.coalesce(there, F.raise_error(F.concat(F.lit(f"no asset {key}; available: "), F.array_join(F.map_keys("assets"), ", "))).cast("string")))


def manifest(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """``(digest, name)`` of a checksum list."""
    for line in lines:
        digest, _, name = line.strip().partition(" ")
        if name.strip():
            yield digest.lower(), name.strip().lstrip("*")


def verify_files(spark: SparkSession, folder: str, expected: list[tuple[str, str]]) -> DataFrame:
    """``name, expected, actual, ok`` for each file of a list; hashing is spread over the executors."""
    wanted = spark.createDataFrame(expected, "expected string, name string")
    there = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("actual"))
    return wanted.join(there, "name", "left").select("name", "expected", "actual", F.coalesce(F.lower("expected") == F.col("actual"), F.lit(False)).alias("ok"))
