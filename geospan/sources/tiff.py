"""GeoTIFF: a Python data source of tiles that reads and writes, and functions for whole files.

Strips and tiles, uncompressed, deflated, LZW or packed bits, with or without
horizontal differences, little or big endian, with the scale and tie point of the
geographic tags. Reading plans one partition for each run of tiles; only the
bands and tiles asked for are read. The source opens paths that executors see;
``tiles_of_files`` takes files from any store that Spark reads.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Tag numbers, and sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS_A_STRIP, COUNTS, PLANAR = 256, 257, 258, 259, 273, 277, 278, 279, 284
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
SCALE, TIE, NODATA, PREDICTOR = 33550, 33922, 42113, 317
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8), 16: ("Q", 8)}


@dataclass
class Header:
    width: int
    height: int
    count: int
    dtype: np.dtype
    compression: int
    differences: bool
    tile_width: int
    tile_height: int
    offsets: list[int]
    sizes: list[int]
    separate: bool
    transform: tuple[float, float, float, float, float, float]
    nodata: float | None

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height)


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        return header_of(f, path)


def header_of(f, path: str = "this") -> Header:
    """From an open file, or bytes as one."""
    order = {b"II": "<", b"MM": ">"}.get(f.read(2))
    if not order or struct.unpack(order + "H", f.read(2))[0] != 42:
        raise ValueError(f"{path} is no TIFF file")
    f.seek(struct.unpack(order + "I", f.read(4))[0])
    tags = {}
    entries = [f.read(12) for _ in range(struct.unpack(order + "H", f.read(2))[0])]
    for entry in entries:
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if kind not in TYPES:
            continue
        code, size = TYPES[kind]
        if n * size <= 4:
            raw = entry[8 : 8 + n * size]
        else:
            f.seek(struct.unpack(order + "I", entry[8:])[0])
            raw = f.read(n * size)
        tags[tag] = raw if code == "s" else struct.unpack(f"{order}{n}{code}", raw)
    one = lambda tag, other=None: tags[tag][0] if tag in tags else other
    if one(COMPRESSION, 1) not in _DECODED:
        raise ValueError(f"compression {one(COMPRESSION)} is not read")
    if one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"predictor {one(PREDICTOR)} is not read")
    kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
    scale, tie = tags.get(SCALE, (1.0, 1.0, 0.0)), tags.get(TIE, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    transform = (scale[0], 0.0, tie[3] - tie[0] * scale[0], 0.0, -scale[1], tie[4] + tie[1] * scale[1])
    tiled = TILE_WIDTH in tags
    nodata = float(tags[NODATA].rstrip(b"\0").decode()) if NODATA in tags else None
    return Header(one(WIDTH), one(HEIGHT), one(SAMPLES, 1), np.dtype(f"{order}{kind}{one(BITS) // 8}"), one(COMPRESSION, 1), one(PREDICTOR, 1) == 2, one(TILE_WIDTH, one(WIDTH)), one(TILE_HEIGHT, min(one(ROWS_A_STRIP, one(HEIGHT)), one(HEIGHT))), list(tags[TILE_OFFSETS if tiled else OFFSETS]), list(tags[TILE_COUNTS if tiled else COUNTS]), one(PLANAR, 1) == 2, transform, nodata)


def unlzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; 256 clears the table, 257 ends."""
    out, table, bits, held, width, last = [], [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            table = [bytes((i,)) for i in range(256)] + [b"", b""]
        if code < len(table):
            text = table[code]
        elif last and code == len(table):
            text = last + last[:1]
        else:
            raise ValueError("a code that is not in the table")
        out.append(text)
        if last:
            table.append(last + text[:1])
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        last = text
    return b"".join(out)


def unpack_bits(data: bytes) -> bytes:
    """Runs: a count and bytes as they are, or a count and one byte to repeat."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
    return b"".join(out)


_DECODED = {1: bytes, 5: unlzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def read_tile(f, h: Header, band: int, row: int, col: int) -> np.ndarray:
    """One band of one tile, cut to the raster."""
    at = row * h.across + col + (band * h.across * h.down if h.separate else 0)
    f.seek(h.offsets[at])
    raw = f.read(h.sizes[at])
    data = np.frombuffer(_DECODED[h.compression](raw), h.dtype)
    samples = 1 if h.separate else h.count
    rows = len(data) // (h.tile_width * samples)
    tile = data[: rows * h.tile_width * samples].reshape(rows, h.tile_width, samples)[:, :, 0 if h.separate else band]
    if h.differences:
        tile = np.cumsum(tile, axis=1, dtype=h.dtype.newbyteorder("="))
    return tile[: h.height - row * h.tile_height, : h.width - col * h.tile_width].astype(np.float32)


@dataclass
class Tiles(InputPartition):
    path: str
    band: int
    tiles: list[tuple[int, int]]


TILES = "path string, band int, tile_row int, tile_col int, row_off int, col_off int, height int, width int, data array<float>"
_SCHEMA = pa.schema([("path", pa.string()), *((n, pa.int32()) for n in ("band", "tile_row", "tile_col", "row_off", "col_off", "height", "width")), ("data", pa.list_(pa.float32()))])


def _row(path: str, h: Header, band: int, row: int, col: int, tile: np.ndarray) -> pa.RecordBatch:
    data = pa.ListArray.from_arrays(pa.array([0, tile.size], pa.int32()), pa.array(np.ascontiguousarray(tile).ravel()))
    numbers = (band, row, col, row * h.tile_height, col * h.tile_width, *tile.shape)
    return pa.RecordBatch.from_arrays([pa.array([path]), *(pa.array([n], pa.int32()) for n in numbers), data], schema=_SCHEMA)


def _wanted(h: Header, window: list[int] | None) -> list[tuple[int, int]]:
    """Tiles that meet the rows and columns [start, stop) of a window."""
    r0, r1, c0, c1 = window or (0, h.height, 0, h.width)
    return [(r, c) for r in range(h.down) if r * h.tile_height < r1 and (r + 1) * h.tile_height > r0 for c in range(h.across) if c * h.tile_width < c1 and (c + 1) * h.tile_width > c0]


def _numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x]


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bands, self.window = _numbers(options.get("bands", "")), _numbers(options.get("window", "")) or None
        self.each = int(options.get("tilesPerPartition", 64))

    def partitions(self) -> list[Tiles]:
        out = []
        names = sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if n.lower().endswith((".tif", ".tiff"))) if os.path.isdir(self.path) else [self.path]
        for name in names:
            h = read_header(name)
            tiles = _wanted(h, self.window)
            out += [Tiles(name, b, tiles[i : i + self.each]) for b in self.bands or range(1, h.count + 1) for i in range(0, len(tiles), self.each)]
        return out

    def read(self, part: Tiles) -> Iterator[pa.RecordBatch]:
        h = read_header(part.path)
        with open(part.path, "rb") as f:
            for row, col in part.tiles:
                yield _row(part.path, h, part.band, row, col, read_tile(f, h, part.band - 1, row, col))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class TiffWriter(DataSourceWriter):
    """A file for each tile and band in a folder that the executors see, with its own place in the transform ``scale_x, x, scale_y, y``."""

    def __init__(self, options: dict):
        self.folder, self.transform = options["path"], [float(x) for x in options.get("transform", "1,0,-1,0").split(",")]
        self.nodata = float(options["nodata"]) if "nodata" in options else None
        os.makedirs(self.folder, exist_ok=True)

    def write(self, iterator) -> Written:
        names, (a, x, e, y) = [], self.transform
        for row in iterator:
            name = f"b{row.band}_r{row.row_off}_c{row.col_off}.tif"
            place = (a, 0.0, x + a * row.col_off, 0.0, e, y + e * row.row_off)
            whole = os.path.join(self.folder, name)
            write_geotiff(f"{whole}.{os.getpid()}", np.asarray(row.data, np.float32).reshape(row.height, row.width), place, self.nodata)
            os.replace(f"{whole}.{os.getpid()}", whole)  # a task that runs again writes the same file
            names.append(name)
        return Written(names)

    def commit(self, messages) -> None:
        with open(os.path.join(self.folder, "_SUCCESS"), "w", encoding="utf-8") as f:
            f.write("\n".join(sorted(n for m in messages if m for n in m.names)))

    def abort(self, messages) -> None:
        for message in messages:
            for name in message.names if message else ():
                os.remove(os.path.join(self.folder, name))


class TiffSource(DataSource):
    """``spark.read.format("geospan_tiff").option("bands", "1,3").option("window", "0,512,0,512").load(path)``: one row for each
    tile and band; such rows are written with ``df.write.format("geospan_tiff").mode("append").save(folder)``, a file a tile."""

    @classmethod
    def name(cls) -> str:
        return "geospan_tiff"

    def schema(self) -> str:
        return TILES

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)

    def writer(self, schema, overwrite) -> TiffWriter:
        return TiffWriter(self.options)


def tiles_of_files(files: DataFrame, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Tiles of ``files`` (``path, content``, as ``binaryFile`` reads them from any store); a file must fit in a row."""
    wanted = list(window) if window else None

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = io.BytesIO(content.as_buffer())
                h = header_of(f, path)
                for band in bands or range(1, h.count + 1):
                    for row, col in _wanted(h, wanted):
                        yield _row(path, h, band, row, col, read_tile(f, h, band - 1, row, col))

    return files.select("path", "content").mapInArrow(run, TILES)


def load_assets(items: DataFrame, spark: SparkSession, key: str = "visual", **options) -> DataFrame:
    """The tiles of an asset of catalogue items (``assets``: addresses by key); their addresses, which the driver receives, are paths of any store."""
    from geospan.sources.features import asset

    paths = [r.href for r in asset(items, key).select("href").distinct().collect()]
    return tiles_of_files(spark.read.format("binaryFile").load(paths), **options)


def pixel_tiles(df: DataFrame, tile: int = 256, value: str = "z", band: int = 1) -> DataFrame:
    """A dense pixel table as rows of tiles, to be written."""
    at = df.withColumn("tile_row", F.expr(f"CAST(row div {tile} AS INT)")).withColumn("tile_col", F.expr(f"CAST(col div {tile} AS INT)"))
    rows = at.groupBy("tile_row", "tile_col").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.array_sort(F.collect_list(F.struct("row", "col", F.col(value).cast("float").alias("v")))).alias("p"))
    whole = lambda c: c.cast("int")
    return rows.select(F.lit("").alias("path"), F.lit(band).alias("band"), "tile_row", "tile_col", whole(F.col("r0")).alias("row_off"), whole(F.col("c0")).alias("col_off"), whole(F.col("r1") - F.col("r0") + 1).alias("height"), whole(F.col("c1") - F.col("c0") + 1).alias("width"), F.col("p.v").alias("data"))


def write_tiles(df: DataFrame, folder: str, tile: int = 256, value: str = "z", band: int = 1, transform=(1.0, 0.0, 0.0, 0.0, -1.0, 0.0), nodata: float | None = None) -> None:
    """A pixel table of any size as a folder of files, by all executors."""
    df.sparkSession.dataSource.register(TiffSource)
    writer = pixel_tiles(df, tile, value, band).write.format("geospan_tiff").mode("append").option("transform", f"{transform[0]},{transform[2]},{transform[4]},{transform[5]}")
    (writer.option("nodata", str(nodata)) if nodata is not None else writer).save(folder)


def read_geotiff(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> tuple[DataFrame, dict]:
    """Pixels ``band, row, col, value`` of the bands and rows and columns [start, stop) asked for, and what the header says."""
    spark.dataSource.register(TiffSource)
    reader = spark.read.format("geospan_tiff")
    for name, numbers in (("bands", bands), ("window", window)):
        reader = reader.option(name, ",".join(map(str, numbers))) if numbers else reader
    tiles = reader.load(path)
    pixels = tiles.select("band", "row_off", "col_off", "width", F.posexplode("data").alias("i", "value"))
    pixels = pixels.select("band", (F.col("row_off") + F.expr("i div width")).cast("long").alias("row"), (F.col("col_off") + F.col("i") % F.col("width")).cast("long").alias("col"), "value")
    if window:
        r0, r1, c0, c1 = window
        pixels = pixels.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    h = read_header(path)
    return pixels, {"width": h.width, "height": h.height, "count": h.count, "dtype": h.dtype.name, "transform": h.transform, "nodata": h.nodata}


def write_geotiff(path: str, data: np.ndarray, transform=(1.0, 0.0, 0.0, 0.0, -1.0, 0.0), nodata: float | None = None, compress: bool = True, tile: int = 256) -> None:
    """A raster that fits the driver as one deflated file of square tiles; two dimensions become one band."""
    data = np.asarray(data)[None] if np.asarray(data).ndim == 2 else np.asarray(data)
    count, height, width = data.shape
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    chunks = []
    for band in data:
        for r in range(0, height, tile):
            for c in range(0, width, tile):
                block = np.zeros((tile, tile), data.dtype.newbyteorder("<"))
                part = band[r : r + tile, c : c + tile]
                block[: part.shape[0], : part.shape[1]] = part
                chunks.append(zlib.compress(block.tobytes(), 6) if compress else block.tobytes())
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [data.dtype.itemsize * 8] * count), (COMPRESSION, 3, [8 if compress else 1]), (262, 3, [1]), (SAMPLES, 3, [count]), (PLANAR, 3, [2]), (TILE_WIDTH, 3, [tile]), (TILE_HEIGHT, 3, [tile]), (FORMAT, 3, [kind] * count), (SCALE, 12, [transform[0], -transform[4], 0.0]), (TIE, 12, [0.0, 0.0, 0.0, transform[2], transform[5], 0.0])]
    offsets = list(np.cumsum([8, *(len(x) for x in chunks)])[:-1])
    tags += [(TILE_OFFSETS, 4, [int(o) for o in offsets]), (TILE_COUNTS, 4, [len(x) for x in chunks])]
    if nodata is not None:
        tags.append((NODATA, 2, str(nodata).encode() + b"\0"))
    body = b"".join(chunks)
    body += b"\0" * (len(body) % 2)
    start = 8 + len(body)
    extra, entries, extra_at = b"", b"", start + 2 + 12 * len(tags) + 4
    for tag, code, values in sorted(tags, key=lambda t: t[0]):
        raw = values if code == 2 else struct.pack(f"<{len(values)}{TYPES[code][0]}", *values)
        entries += struct.pack("<HHI", tag, code, len(values))
        if len(raw) <= 4:
            entries += raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<I", extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", start) + body + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra)
