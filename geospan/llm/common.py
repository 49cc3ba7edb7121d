"""Shared plumbing of the corpus operators.

Every operator selects the few columns it needs under private names before it
does anything else, so that extra or clashing columns of the caller's table
never reach its plan.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geospan.checkpoints import saved

#: Rows that are held as Python strings at once, and bytes of an Arrow batch in steps that an operator runs itself, where the session leaves the default.
ROWS_AT_ONCE, BATCH = 256, "16m"
#: Arrow type of each SQL type name used in the operators' schemas.
ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
}

_UPPER = bytes(range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string such as ``"a long, b string"``."""
    return pa.schema([pa.field(*(lambda n, t: (n, ARROW[t]))(*part.split())) for part in re.split(r",\s*", ddl)])


def lower_ascii(text: str) -> str:
    """``text`` with A-Z, and no other letter, in lower case."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").translate(_UPPER).decode("utf-8", "surrogatepass")


def sha256_hex(data: str | bytes) -> str:
    return hashlib.sha256(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data).hexdigest()


def give_back() -> None:
    """Let the C library return freed memory to the system: from now on blocks of a megabyte and more at once, the rest now."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim"):
        for option, value in ((-3, 1 << 20), (-1, 4 << 20)):  # thresholds of mapping a block by itself, and of trimming the heap
            libc.mallopt(option, value)
        libc.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that gives freed memory back: workers of one executor don't all keep their peaks."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        usual = pa.default_memory_pool()
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            pa.set_memory_pool(usual)
            give_back()

    return inside


def map_lists(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], ddl: str, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """Apply a Python function to lists of ids and whole texts (null: empty), in Arrow batches: one narrow stage and no shuffle.

    ``make`` builds the function once in each task; the function gets the lists
    of ids, texts and ``keep`` columns of a few rows, and yields rows of ``ddl``.
    Few rows are held as Python objects at a time.
    """
    schema, keep = arrow_schema(ddl), list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = list(function(*(c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep))).mapInArrow(lean(run), ddl)


def map_texts(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], ddl: str, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """``map_lists`` with a function of one id, text and ``keep`` columns."""

    def one_by_one():
        function = make()
        return lambda *columns: (row for values in zip(*columns, strict=True) for row in function(*values))

    return map_lists(df, one_by_one, ddl, id_col, text_col, keep)


class Taken:
    """A set of spans that is asked whether it meets another span."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches, cut so that rows with equal values in the first ``keys`` (numeric) columns stay together."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        other = np.zeros(batch.num_rows, bool)
        for i in range(keys):
            column = batch.column(i).to_numpy()
            other |= column != column[-1]
        last = np.flatnonzero(other)
        cut = int(last[-1]) + 1 if len(last) else 0
        held = batch.slice(cut)
        if cut:
            yield batch.slice(0, cut)
    if held is not None and held.num_rows:
        yield held


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder that the cluster names."""
    with small_batches(df.sparkSession):
        return saved(df)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller Arrow batches than the default for what runs inside, unless the session asks for a size of its own: texts are long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = name in spark.conf.getAll
    if not own:
        spark.conf.set(name, BATCH)
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(name)
