"""Round trips of the file sources, workflows and models."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geospan.operators import inference as D
from geospan.operators import overlay as O
from geospan.sources import features as S
from geospan.sources import tiff, zarr
from geospan.streaming import events as E
from geospan.workflow import Evidence, Pipeline, PipelineConfig, PipelineRegistry, ProvenanceRecord, get_sensor
from tests.test_operators import array_of, grid_of


@pytest.mark.parametrize("compress", [True, False])
def test_tiff(spark, tmp_path, compress):
    data = np.random.default_rng(1).normal(size=(3, 70, 45)).astype(np.float32)
    path = str(tmp_path / "a.tif")
    tiff.write_geotiff(path, data, (0.5, 0.0, 10.0, 0.0, -0.5, 20.0), nodata=-9.0, compress=compress, tile=32)
    pixels, about = tiff.read_geotiff(spark, path, [1, 3])
    assert (about["width"], about["height"], about["count"], about["nodata"]) == (45, 70, 3, -9.0)
    assert about["transform"] == (0.5, 0.0, 10.0, 0.0, -0.5, 20.0)
    assert np.allclose(array_of(pixels.where("band = 3"), "value", (70, 45)), data[2]) and not pixels.where("band = 2").count()
    window, _ = tiff.read_geotiff(spark, path, [2], (30, 40, 5, 50))
    assert window.count() == 10 * 40
    reader = tiff.TiffReader({"path": path, "bands": "2", "window": "0,32,33,45"})
    assert [p.tiles for p in reader.partitions()] == [[(0, 1)]]  # other tiles are not read
    files = spark.read.format("binaryFile").load(path)
    tiles = tiff.tiles_of_files(files, [3], (33, 70, 0, 10)).collect()
    assert [(t.band, t.tile_row, t.tile_col) for t in tiles] == [(3, 1, 0), (3, 2, 0)] and np.allclose(np.array(tiles[0].data).reshape(32, 32), data[2, 32:64, :32])
    items = spark.createDataFrame([("i", {"visual": path})], "id string, assets map<string,string>")
    assert tiff.load_assets(items, spark, bands=[1]).count() == 6


def packed_tiff(path, array, compression, encode, differences=False):
    """One strip, written here byte by byte."""
    h, w = array.shape
    rows = np.diff(array, axis=1, prepend=array.dtype.type(0)) if differences else array
    data = encode(np.ascontiguousarray(rows.astype("<u2")).tobytes())
    tags = [(256, 3, w), (257, 3, h), (258, 3, 16), (259, 3, compression), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, h), (279, 4, len(data)), (317, 3, 2 if differences else 1)]
    data += b"\0" * (len(data) % 2)
    body = b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I", v) for t, k, v in tags)
    path.write_bytes(b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(tags)) + body + b"\0\0\0\0")


def lzw(data):
    table, out, bits, n, width, last = {}, bytearray(), 0, 0, 9, b""

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
        bits &= (1 << n) - 1

    put(256)
    table = {bytes((i,)): i for i in range(256)}
    size = 258
    for i in range(len(data)):
        byte = data[i : i + 1]
        if last + byte in table:
            last += byte
            continue
        put(table[last])
        table[last + byte] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256)
            table, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
        last = byte
    put(table[last])
    size += 1
    width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


@pytest.mark.parametrize("differences", [False, True])
def test_tiff_compressions(tmp_path, differences):
    rng = np.random.default_rng(3)
    array = np.cumsum(rng.integers(0, 3, (90, 120)), axis=1).astype(np.uint16)
    literal = lambda d: b"".join(bytes((len(d[i : i + 100]) - 1,)) + d[i : i + 100] for i in range(0, len(d), 100))
    for compression, encode in ((1, bytes), (5, lzw), (32773, literal)):
        path = tmp_path / f"{compression}.tif"
        packed_tiff(path, array, compression, encode, differences)
        h = tiff.read_header(str(path))
        with open(path, "rb") as f:
            assert (tiff.read_tile(f, h, 0, 0, 0) == array).all()
    assert tiff.unpack_bits(bytes([254, 7, 1, 8, 9, 128])) == bytes([7, 7, 7, 8, 9])


def test_rasters_by_executors(spark, tmp_path):
    """Pixel tables written as folders of tiles and as chunks, and read back."""
    z = np.random.default_rng(4).normal(size=(70, 45)).astype(np.float32)
    tiff.write_tiles(grid_of(spark, z), str(tmp_path / "tiles"), 32, transform=(0.5, 0.0, 10.0, 0.0, -0.5, 20.0))
    names = sorted(p.name for p in (tmp_path / "tiles").glob("*.tif"))
    assert len(names) == 6 and (tmp_path / "tiles" / "_SUCCESS").read_text().split() == names
    out = np.full_like(z, np.nan)
    for name in names:
        h = tiff.read_header(str(tmp_path / "tiles" / name))
        r, c = round((20.0 - h.transform[5]) / 0.5), round((h.transform[2] - 10.0) / 0.5)
        with open(tmp_path / "tiles" / name, "rb") as f:
            out[r : r + h.height, c : c + h.width] = tiff.read_tile(f, h, 0, 0, 0)
    assert (out == z).all()
    chunks = tiff.pixel_tiles(grid_of(spark, z), 32).select(F.array("row_off", "col_off").alias("start"), F.array("height", "width").alias("shape"), "data")
    spark.dataSource.register(zarr.ZarrSource)
    chunks.write.format("geospan_zarr").mode("append").option("chunks", "32,32").option("attrs", '{"units": "m"}').save(str(tmp_path / "z"))
    back = np.zeros_like(z)
    for r in spark.read.format("geospan_zarr").load(str(tmp_path / "z")).collect():
        back[tuple(slice(s, s + n) for s, n in zip(r.start, r.shape, strict=True))] = np.array(r.data).reshape(r.shape)
    assert (back == z).all() and zarr.attributes(str(tmp_path / "z")) == {"units": "m"}


def test_zarr_codecs():
    import zlib

    import pyarrow as pa

    data = b"abc" * 500
    assert zarr.decoded(data, None, 1500) == zarr.decoded(zlib.compress(data), {"id": "zlib"}, 1500) == zarr.decoded(pa.Codec("gzip").compress(data, asbytes=True), {"id": "gzip"}, 1500) == data
    assert zarr.decoded(pa.Codec("zstd").compress(data, asbytes=True), {"id": "zstd"}, 1500) == zarr.decoded(struct.pack("<I", 1500) + pa.Codec("lz4_raw").compress(data, asbytes=True), {"id": "lz4"}, 1500) == data
    with pytest.raises(ValueError):
        zarr.decoded(data, {"id": "blosc"}, 1500)


def test_shape_files(spark, tmp_path):
    """A polygon with a hole, a null shape and two lines, and the tables beside them."""
    outer, hole = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]

    def parts(kind, *runs):
        points = [p for run in runs for p in run]
        starts = np.cumsum([0, *(len(r) for r in runs)])[:-1]
        return struct.pack("<i4dii", kind, 0, 0, 4, 4, len(runs), len(points)) + struct.pack(f"<{len(runs)}i", *starts) + b"".join(struct.pack("<dd", *p) for p in points)

    bodies = [parts(5, outer, hole, [(10, 10), (10, 11), (11, 11), (10, 10)]), struct.pack("<i", 0), parts(3, [(0, 0), (1, 1)], [(2, 2), (3, 3)]), struct.pack("<idd", 1, 7, 8)]
    records = b"".join(struct.pack(">ii", i + 1, len(b) // 2) + b for i, b in enumerate(bodies))
    (tmp_path / "a.shp").write_bytes(struct.pack(">i", 9994) + b"\0" * 96 + records)
    field = lambda name, width: name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15
    rows = b"".join(flag + f"{n:<5}{k:>3}".encode() for flag, n, k in ((b" ", "one", 1), (b" ", "two", 2), (b"*", "gone", 3), (b" ", "four", 4)))
    (tmp_path / "a.dbf").write_bytes(b"\3\0\0\0" + struct.pack("<iHH", 4, 32 + 64 + 1, 9) + b"\0" * 20 + field("NAME", 5) + field("K", 3) + b"\r" + rows)
    found = S.read_features(spark, str(tmp_path / "a.shp")).orderBy("n").collect()
    shapes = [O._in(r["shape"]) for r in found]
    assert O.S.area(shapes[0]) == 15.5 and len(shapes[0][1]) == 2 and shapes[1] is None and len(shapes[2][1]) == 2 and shapes[3] == ("point", [[[(7.0, 8.0)]]])
    assert [r.attributes for r in found] == [{"NAME": "one", "K": "1"}, {"NAME": "two", "K": "2"}, {}, {"NAME": "four", "K": "4"}]


def test_geopackages_and_writers(spark, tmp_path):
    import sqlite3

    con = sqlite3.connect(tmp_path / "a.gpkg")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    con.execute("CREATE TABLE places (fid INTEGER PRIMARY KEY, name TEXT, geom BLOB)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('places', 'geom')")
    texts = ["POINT (1 2)", "POLYGON ((0 0, 4 0, 4 4, 0 0))"]
    for i, (text, flags) in enumerate(zip(texts, (1, 3), strict=True)):
        blob = b"GP\0" + bytes([flags]) + struct.pack("<i", 4326) + (struct.pack("<4d", 0, 4, 0, 4) if flags == 3 else b"") + O.S.to_wkb(O.S.of_wkt(text))
        con.execute("INSERT INTO places VALUES (?, ?, ?)", (i + 1, f"p{i}", blob))
    con.commit()
    con.close()
    found = S.read_features(spark, str(tmp_path / "a.gpkg")).orderBy("fid")
    assert [(O.S.to_wkt(O._in(r["shape"])), json.loads(r.attributes)["name"], r.layer) for r in found.collect()] == [(t, f"p{i}", "places") for i, t in enumerate(texts)]
    df = found.select("fid", "layer", "shape")
    S.write_features(df, str(tmp_path / "o.parquet"))
    back = S.read_features(spark, str(tmp_path / "o.parquet")).orderBy("fid").select(O.to_wkt(O.from_wkb(F.col("geometry"))).alias("w")).collect()
    assert [r.w for r in back] == texts
    S.write_features(df, str(tmp_path / "o.geojson"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "o.geojson")).collect()]
    assert sorted(x["geometry"]["type"] for x in lines) == ["Point", "Polygon"] and {x["properties"]["layer"] for x in lines} == {"places"}
    with pytest.raises(ValueError):
        S.write_features(df, "a.txt")


def test_zarr(spark, tmp_path):
    data = np.random.default_rng(2).normal(size=(4, 50, 64)).astype(np.float32)
    path = str(tmp_path / "a.zarr")
    zarr.write_zarr(path, data, (1, 32, 32), {"units": "m"})
    spark.dataSource.register(zarr.ZarrSource)
    out = np.zeros_like(data)
    for r in spark.read.format("geospan_zarr").load(path).collect():
        out[tuple(slice(s, s + n) for s, n in zip(r.start, r.shape, strict=True))] = np.array(r.data).reshape(r.shape)
    assert (out == data).all() and zarr.attributes(path) == {"units": "m"}


def test_geojson(spark, tmp_path):
    data = S.features_to_geojson([S.geometry_to_feature({"type": "Point", "coordinates": [1.5, 2.0]}, {"a": 1}, 7), S.geometry_to_feature({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]})], "EPSG:3857")
    S.write_geojson(str(tmp_path / "a.geojson"), data)
    found = S.read_features(spark, str(tmp_path / "a.geojson"))
    x, y = S.point_of(F.col("coordinates"))
    row = found.where("type = 'Point'").select("id", "crs", x.alias("x"), y.alias("y"), "properties").first()
    assert (row.id, row.crs, row.x, row.y, json.loads(row.properties)) == ("7", "EPSG:3857", 1.5, 2.0, {"a": 1})
    assert len(found.where("type = 'Polygon'").select(S.ring_of(F.col("coordinates")).alias("r")).first().r) == 4
    with pytest.raises(ValueError):
        S.read_features(spark, "a.fgb")


def test_geoparquet_points(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "name string, x double, y double").withColumn("geometry", S.point_wkb(F.col("x"), F.col("y")))
    S.write_geoparquet(df, str(tmp_path / "p.parquet"))
    row = S.read_features(spark, str(tmp_path / "p.parquet")).select(S.from_point_wkb(F.col("geometry")).alias("p")).first()
    assert (row.p.x, row.p.y) == (1.0, 2.0)


def test_stac(spark):
    answer = json.dumps({"features": [{"id": "i", "collection": "c", "bbox": [1, 2, 3, 4], "properties": {"datetime": "2024-01-02T03:04:05Z"}, "assets": {"visual": {"href": "u"}}}, {"id": "j", "properties": {}, "assets": {}}]})
    items = {r.id: r for r in S.stac_items(spark.createDataFrame([(answer,)], "t string"), "t").collect()}
    assert items["i"].xmax == 3.0 and items["i"].ts.hour == 3 and items["j"].xmin == 0.0 and items["j"].ts is None
    found = S.stac_items(spark.createDataFrame([(answer,)], "t string"), "t")
    assert S.asset(found.where("id = 'i'")).first().href == "u"
    with pytest.raises(Exception, match="no asset"):
        S.asset(found.where("id = 'j'")).collect()


def test_verification(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "m.bin").write_bytes(b"abc")
    good = "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"
    found = {r.name: r.ok for r in S.verify_files(spark, str(tmp_path / "f"), [*S.manifest([f"{good}  m.bin", f"{good} gone.bin"])]).collect()}
    assert found == {"m.bin": True, "gone.bin": False}


def test_pipeline_records(spark):
    run = Pipeline(PipelineConfig("p")).add_step(lambda d: {"value": d["value"] + 1}).run({"value": 10})
    assert run.outputs == {"value": "11"} and run.status == "COMPLETED" and run.row(spark).first().pipeline_id == "p"
    broken = Pipeline(PipelineConfig("q")).add_step(lambda d: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        broken.run({})
    assert broken.runs[0].status == "FAILED"
    PipelineRegistry.register("p", "P", "test")(lambda: Pipeline(PipelineConfig("p")))
    assert PipelineRegistry.by_domain("test") == ["p"] and PipelineRegistry.create("p").config.pipeline_id == "p"


def test_provenance(tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    record = ProvenanceRecord("r", "p")
    record.add_input(Evidence.from_file(str(tmp_path / "x")))
    record.to_json(str(tmp_path / "r.json"))
    assert ProvenanceRecord.from_json(str(tmp_path / "r.json")) == record
    assert get_sensor("sentinel2").get_band_wavelength("B04") == 665.0 and get_sensor("none") is None


def test_detection(spark):
    tiles = spark.createDataFrame([(1, 0, 0, 0, 0, 2, 2, [0.0, 9.0, 0.0, 0.0]), (1, 0, 1, 0, 1, 2, 2, [9.0, 0.0, 0.0, 0.0])], "image long, tile_row long, tile_col long, row_off long, col_off long, height int, width int, data array<double>")

    def scorer(array):
        r, c = np.unravel_index(array.argmax(), array.shape)
        return [(0, 0.9, float(c), float(r), float(c + 1), float(r + 1)), (0, 0.1, 0.0, 0.0, 1.0, 1.0)]

    found = D.detect(tiles, scorer, D.DETECTORS["ship"]).collect()
    assert [(r.x1, r.y1, r.class_name) for r in found] == [(1.0, 0.0, "ship")]


def test_small_objects(spark):
    mask = np.zeros((9, 12), int)
    mask[0:3, 0:4] = 1
    mask[5, 2:5] = 1
    mask[6, 4] = mask[7, 4] = mask[7, 5] = 1
    mask[4, 9] = 1
    found = D.small_objects_removed(grid_of(spark, mask, "mask"), 5)
    wanted = mask.copy()
    wanted[4, 9] = 0
    assert (array_of(found, "mask", mask.shape) == wanted).all()


def test_streams(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    job = E.tumbling(stream, "6 hours", ["event_type"]).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    batch = E.tumbling(table, "6 hours", ["event_type"])
    assert sorted(spark.table("windows").select("start", "event_type", "n").collect()) == sorted(batch.select("start", "event_type", "n").collect())
