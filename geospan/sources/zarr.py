"""Zarr (version 2, one array; zlib, gzip, zstd, lz4 or uncompressed chunks): a data source of chunks that reads and writes, and a writer of arrays."""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def _array_path(path: str, variable: str | None) -> str:
    """The array itself, or of a group the variable asked for, else the first."""
    if os.path.exists(os.path.join(path, ".zarray")):
        return path
    names = sorted(n for n in os.listdir(path) if os.path.exists(os.path.join(path, n, ".zarray")))
    if variable:
        if variable not in names:
            raise KeyError(variable)
        return os.path.join(path, variable)
    if not names:
        raise ValueError("the group holds no array")
    return os.path.join(path, names[0])


def attributes(path: str, variable: str | None = None) -> dict:
    name = os.path.join(_array_path(path, variable), ".zattrs")
    if not os.path.exists(name):
        return {}
    with open(name, encoding="utf-8") as f:
        return json.load(f)


def decoded(raw: bytes, compressor: dict | None, size: int) -> bytes:
    """A chunk of ``size`` bytes."""
    kind = compressor["id"] if compressor else None
    if kind is None:
        return raw
    if kind in ("zlib", "gzip"):
        return zlib.decompress(raw, 47)
    if kind == "zstd":
        return pa.Codec("zstd").decompress(raw, size, asbytes=True)
    if kind == "lz4":  # its size in four bytes first
        return pa.Codec("lz4_raw").decompress(raw[4:], size, asbytes=True)
    raise ValueError(f"chunks by {kind} are not read")


@dataclass
class Chunk(InputPartition):
    path: str
    places: list[tuple[int, ...]]


class ZarrReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = _array_path(options["path"], options.get("variable"))
        with open(os.path.join(self.path, ".zarray"), encoding="utf-8") as f:
            self.meta = json.load(f)
        self.each = int(options.get("chunksPerPartition", 16))

    def partitions(self) -> list[Chunk]:
        counts = [-(-n // c) for n, c in zip(self.meta["shape"], self.meta["chunks"], strict=True)]
        places = list(itertools.product(*map(range, counts)))
        return [Chunk(self.path, places[i : i + self.each]) for i in range(0, len(places), self.each)]

    def read(self, part: Chunk) -> Iterator[pa.RecordBatch]:
        meta, schema = self.meta, pa.schema([("start", pa.list_(pa.int32())), ("shape", pa.list_(pa.int32())), ("data", pa.list_(pa.float32()))])
        for place in part.places:
            name = os.path.join(part.path, meta.get("dimension_separator", ".").join(map(str, place)))
            if os.path.exists(name):
                with open(name, "rb") as f:
                    raw = decoded(f.read(), meta["compressor"], int(np.prod(meta["chunks"])) * np.dtype(meta["dtype"]).itemsize)
                data = np.frombuffer(raw, meta["dtype"]).reshape(meta["chunks"], order=meta.get("order", "C"))
            else:
                data = np.full(meta["chunks"], meta["fill_value"] or 0, meta["dtype"])
            start = [p * c for p, c in zip(place, meta["chunks"], strict=True)]
            data = data[tuple(slice(0, n - s) for n, s in zip(meta["shape"], start, strict=True))].astype(np.float32)
            values = pa.ListArray.from_arrays(pa.array([0, data.size], pa.int32()), pa.array(np.ascontiguousarray(data).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([start], schema.types[0]), pa.array([list(data.shape)], schema.types[1]), values], schema=schema)


@dataclass
class Ends(WriterCommitMessage):
    shape: list[int]


class ZarrWriter(DataSourceWriter):
    """Chunks as executors have them, into a folder that they see; the array's size is known when all are there."""

    def __init__(self, options: dict):
        self.path, self.chunks = options["path"], [int(x) for x in options["chunks"].split(",")]
        self.attrs, self.level = json.loads(options.get("attrs", "{}")), int(options.get("level", 5))
        os.makedirs(self.path, exist_ok=True)

    def write(self, iterator) -> Ends:
        ends = [0] * len(self.chunks)
        for row in iterator:
            if any(s % c for s, c in zip(row.start, self.chunks, strict=True)):
                raise ValueError(f"no chunk starts at {list(row.start)}")
            block = np.zeros(self.chunks, np.float32)
            block[tuple(map(slice, row.shape))] = np.asarray(row.data, np.float32).reshape(row.shape)
            name = os.path.join(self.path, ".".join(str(s // c) for s, c in zip(row.start, self.chunks, strict=True)))
            with open(f"{name}.{os.getpid()}", "wb") as f:
                f.write(zlib.compress(block.tobytes(), self.level))
            os.replace(f"{name}.{os.getpid()}", name)
            ends = [max(e, s + n) for e, s, n in zip(ends, row.start, row.shape, strict=True)]
        return Ends(ends)

    def commit(self, messages) -> None:
        _write_about(self.path, [max(n) for n in zip(*(m.shape for m in messages if m), strict=True)], self.chunks, np.dtype("<f4"), self.level, self.attrs)

    def abort(self, messages) -> None:
        pass  # without its description the folder is no array


class ZarrSource(DataSource):
    """``spark.read.format("geospan_zarr").load(path)``: one row for each chunk; such rows are written with
    ``df.write.format("geospan_zarr").mode("append").option("chunks", "1,256,256").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "geospan_zarr"

    def schema(self) -> str:
        return "start array<int>, shape array<int>, data array<float>"

    def reader(self, schema) -> ZarrReader:
        return ZarrReader(self.options)

    def writer(self, schema, overwrite) -> ZarrWriter:
        return ZarrWriter(self.options)


def _write_about(path: str, shape: list[int], chunks: list[int], dtype: np.dtype, level: int, attrs: dict) -> None:
    about = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype.str, "compressor": {"id": "zlib", "level": level}, "fill_value": 0, "order": "C", "filters": None}
    for name, what in ((".zarray", about), (".zattrs", attrs)):
        with open(os.path.join(path, name), "w", encoding="utf-8") as f:
            json.dump(what, f)


def write_zarr(path: str, data: np.ndarray, chunks: tuple[int, ...] | None = None, attrs: dict | None = None, level: int = 5) -> None:
    """Chunks of at most 256 along each axis by default, deflated."""
    data = np.asarray(data)
    chunks = chunks or tuple(min(256, n) for n in data.shape)
    os.makedirs(path, exist_ok=True)
    _write_about(path, list(data.shape), list(chunks), data.dtype, level, attrs or {})
    for place in itertools.product(*(range(-(-n // c)) for n, c in zip(data.shape, chunks, strict=True))):
        block = np.zeros(chunks, data.dtype)
        part = data[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunks, strict=True))]
        block[tuple(map(slice, part.shape))] = part
        with open(os.path.join(path, ".".join(map(str, place))), "wb") as f:
            f.write(zlib.compress(block.tobytes(), level))
