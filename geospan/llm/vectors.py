"""Near-duplicate vectors: a pivot-permutation index.

Each vector is described by its nearest pivots in order.
Inverted lists hold the vectors under every pair of these pivots, so that two
vectors meet in a list exactly if they share two pivots or more; they count as a
candidate in the list of their two smallest common pivots only. Candidates are
then verified by cosine in double precision.

The lists are not written out. Pivots that are near each other make a *cell*,
and a vector is sent once to each cell that holds the smaller pivot of one of its
pairs; the lists of a cell are built where its vectors are. A cell of more than
``CELL`` vectors is cut into blocks, and each pair of blocks is a unit of its
own, so that no task holds more than two. Links are counted in place: a unit
writes one row for each vector that has any, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geospan.llm.common import arrow_schema, checkpointed, lean, partitions_for, runs_of
from geospan.llm.components import components

#: Nearest pivots that describe a vector, and the least cosine of a link.
NEAREST, COSINE = 10, 0.9
#: Bounds on the number of pivots, between which lists have about LIST vectors.
PIVOTS, LIST = (32, 4096), 200
#: Vectors of a cell or of a block of a larger one, copies of a vector that cells are planned for, lists up to which pairs are compared one by one, and rows of a tile.
CELL, COPIES, SHORT, TILE = 32768, 6, 32, 1024


def _valid(values: object) -> np.ndarray | None:
    """The vector in double precision; None if it is null, empty, zero or holds null or non-finite components."""
    if values is None or not len(values) or None in values:
        return None
    x = np.array(values, np.float64)
    return x + 0.0 if np.isfinite(x).all() and (x != 0).any() else None


def _packed(x: np.ndarray) -> bytes:
    """The components in single precision where that loses nothing, behind a byte that tells the width."""
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    return b"\4" + small.tobytes() if (small == x).all() else b"\x08" + x.astype("<f8").tobytes()


def _unit(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, f"<f{data[0]}", offset=1).astype(np.float64)
    x = x / np.abs(x).max()
    return x / math.sqrt(float(x @ x))


def _units(data: list[bytes], size: int | None = None) -> np.ndarray:
    """Unit vectors as rows; with ``size`` cut or padded with zeros to it."""
    rows = [_unit(d) for d in data]
    if size is not None:
        rows = [r[:size] if len(r) >= size else np.pad(r, (0, size - len(r))) for r in rows]
    return np.array(rows) if rows else np.zeros((0, size or 0))


def prepare(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, key, x``: a digest of the vector, and its components as bytes; both null for vectors that link with nothing."""
    schema = arrow_schema("vec_id long, key binary, x binary")

    def run(batches):
        for batch in batches:
            ids, keys, xs = batch.column(0), [], []
            for values in batch.column(1).to_pylist():
                x = _valid(values)
                keys.append(None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                xs.append(None if x is None else _packed(x))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(xs, pa.binary())], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(lean(run), "vec_id long, key binary, x binary")


def _by_place(x: np.ndarray) -> np.ndarray:
    """An order in which neighbours are near: halves along the direction of most spread, again and again."""
    order, todo = [], [np.arange(len(x))]
    while todo:
        part = todo.pop()
        if len(part) < 3:
            order.append(part)
            continue
        z = x[part] - x[part].mean(0)
        axis = np.linalg.svd(z, full_matrices=False)[2][0]
        ranked = part[np.argsort(z @ axis, kind="stable")]
        todo += [ranked[len(part) // 2 :], ranked[: len(part) // 2]]
    return np.concatenate(order) if order else np.empty(0, int)


def choose_pivots(vectors: DataFrame, rows: int, least: float) -> np.ndarray:
    """Pivots from a sample, the vectors whose digests come first, at most four times PIVOTS[1].

    One that would link with an earlier pivot is left out: among many pivots from
    one group of copies the order of the nearest would be chance. A direction
    that all vectors share does no harm, as it adds the same to all cosines with
    a pivot.
    """
    wanted = min(PIVOTS[1], max(PIVOTS[0], math.ceil(math.sqrt(NEAREST * (NEAREST - 1) * rows / LIST))))
    found = [r.x for r in vectors.orderBy("key").select("x").limit(4 * wanted).collect()]
    sample = _units(found, max(((len(x) - 1) // x[0] for x in found), default=1))
    free, chosen = np.ones(len(sample), bool), []
    for at in range(len(sample)):
        if free[at] and len(chosen) < wanted:
            chosen.append(at)
            free &= sample @ sample[at] < least
    pivots = sample[chosen]
    return pivots[_by_place(pivots)]


def describe(vectors: DataFrame, pivots: np.ndarray, nearest: int = NEAREST) -> DataFrame:
    """``v, m, d, x, perm``: the numbers of the nearest pivots, nearest first, as 16-bit integers."""
    ddl = "v long, m long, d boolean, x binary, perm binary"
    schema, k = arrow_schema(ddl), min(nearest, len(pivots))

    def run(batches):
        for batch in batches:
            perms = []
            for at in range(0, batch.num_rows, TILE):
                near = _units(batch.column(3).slice(at, TILE).to_pylist(), pivots.shape[1]) @ pivots.T
                perms += [p.tobytes() for p in np.argsort(-near, axis=1, kind="stable")[:, :k].astype("<i2")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(perms, pa.binary())], schema=schema)

    return vectors.select("v", "m", "d", "x").mapInArrow(lean(run), ddl)


def _cells_of(perms: list[bytes], cells: int, pivots: int) -> np.ndarray:
    """Which cells each vector is sent to: those of the smaller pivots of its pairs (of its only pivot, if it has no more)."""
    perm = np.sort(np.frombuffer(b"".join(perms), "<i2").reshape(len(perms), -1).astype(np.int64), axis=1)
    first = perm[:, : max(1, perm.shape[1] - 1)] * cells // pivots
    out = np.zeros((len(perms), cells), bool)
    out[np.arange(len(perms))[:, None], first] = True
    return out


def _cell_sizes(described: DataFrame, cells: int, pivots: int) -> dict[int, int]:
    """Vectors of each cell: at most one number for each pivot."""
    schema = arrow_schema("cell int, n long")

    def run(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                total += _cells_of(batch.column(0).slice(at, TILE).to_pylist(), cells, pivots).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells), pa.int32()), pa.array(total)], schema=schema)

    return {r.cell: r.n for r in described.select("perm").mapInArrow(lean(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}


def _sent(described: DataFrame, cells: int, pivots: int, sizes: dict[int, int]) -> DataFrame:
    """Each vector's rows for its cells: ``cell, lo, hi`` (a pair of blocks), ``block``, and the vector."""
    ddl = "cell long, lo long, hi long, block long, v long, m long, d boolean, x binary, perm binary"
    schema = arrow_schema(ddl)
    blocks = np.array([max(1, -(-sizes.get(c, 0) // CELL)) for c in range(cells)])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                row, cell = np.nonzero(_cells_of(part.column(4).to_pylist(), cells, pivots))
                many = blocks[cell]
                own = (part.column(0).to_numpy()[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many
                take = np.repeat(np.arange(len(row)), many)
                other = np.arange(len(take)) - np.repeat(np.cumsum(many) - many, many)
                row, cell, own = row[take], cell[take], own[take]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cell.astype(np.int64), np.minimum(own, other), np.maximum(own, other), own)] + [c.take(pa.array(row)) for c in part.columns], schema=schema)

    return described.mapInArrow(lean(run), ddl)


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tile_edges(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few edges that connect what the matrix connects; a row and a column may be the same vector."""
    a, b = rows.copy(), cols.copy()
    while True:
        low_a = np.minimum(a, np.where(linked, b[None, :], np.iinfo(np.int64).max).min(1))
        low_b = np.minimum(b, np.where(linked, low_a[:, None], np.iinfo(np.int64).max).min(0))
        if (low_a == a).all() and (low_b == b).all():
            return np.concatenate((rows, cols)), np.concatenate((a, b))
        a, b = low_a, low_b


class _Unit:
    """One pair of blocks of a cell: links of its vectors whose two smallest common pivots have their list here."""

    def __init__(self, cell: int, lo: int, hi: int, block: np.ndarray, x: np.ndarray, m: np.ndarray, d: np.ndarray, perm: np.ndarray, cells: int, pivots: int, least: float):
        self.cell, self.mixed, self.block, self.lo = cell, lo != hi, block, lo
        self.x, self.m, self.d, self.perm, self.cells, self.pivots, self.least = x, m, d, np.sort(perm, axis=1), cells, pivots, least
        self.links = np.zeros(len(x), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.doubled: list[tuple[np.ndarray, np.ndarray]] = []

    def lists(self) -> Iterator[tuple[int, np.ndarray]]:
        """``key, rows`` of each list of two vectors or more."""
        keys, rows = [], []
        every = np.arange(len(self.x))
        for i, j in combinations(range(self.perm.shape[1]), 2) if self.perm.shape[1] > 1 else [(0, 0)]:
            here = self.perm[:, i] * self.cells // self.pivots == self.cell
            keys.append((self.perm[:, i] * self.pivots + self.perm[:, j])[here])
            rows.append(every[here])
        key, row = np.concatenate(keys), np.concatenate(rows)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
        self.short_key, self.short_row = [], []
        for a, b in zip(starts.tolist(), np.r_[starts[1:], len(key)].tolist() if len(key) else [], strict=True):
            if b - a > SHORT:
                yield int(key[a]), row[a:b]
            elif b - a > 1:
                self.short_key.append(key[a:b])
                self.short_row.append(row[a:b])

    def run(self) -> None:
        for key, rows in self.lists():
            self._long(key, rows)
        if self.short_key:
            self._short(np.concatenate(self.short_key), np.concatenate(self.short_row))

    def _found(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.links, i, self.m[j])
        np.add.at(self.links, j, self.m[i])
        self.edges.append((i, j))
        for a, b in ((i, j), (j, i)):
            if self.d[b].any():
                self.doubled.append((a[self.d[b]], b[self.d[b]]))

    def _short(self, key: np.ndarray, row: np.ndarray) -> None:
        """Rows next to each other under one key: each is compared with those that follow it."""
        for off in range(1, SHORT):
            same = np.flatnonzero(key[:-off] == key[off:])
            if not len(same):
                break
            for at in range(0, len(same), 65536):
                s = same[at : at + 65536]
                i, j = row[s], row[s + off]
                if self.mixed:
                    across = self.block[i] != self.block[j]
                    s, i, j = s[across], i[across], j[across]
                good = np.einsum("ij,ij->i", self.x[i], self.x[j]) >= self.least
                s, i, j = s[good], i[good], j[good]
                common = (self.perm[i][:, :, None] == self.perm[j][:, None, :]).any(2)
                mine = (common & (self.perm[i] <= (key[s] % self.pivots)[:, None])).sum(1) == min(2, self.perm.shape[1])
                if mine.any():
                    self._found(i[mine], j[mine])

    def _long(self, key: int, rows: np.ndarray) -> None:
        """A list by tiles: common pivots and cosines by matrix products."""
        known, place = np.unique(np.where(self.perm[rows] <= key % self.pivots, self.perm[rows], -1), return_inverse=True)
        place = place.reshape(len(rows), -1)

        def inside(at: np.ndarray) -> np.ndarray:
            out = np.zeros((len(at), len(known)), np.float32)
            out[np.arange(len(at))[:, None], place[at]] = 1
            return out[:, known >= 0]

        parts = [np.arange(a, min(a + TILE, len(rows))) for a in range(0, len(rows), TILE)]
        if self.mixed:
            low = self.block[rows] == self.lo
            halves = [np.flatnonzero(low), np.flatnonzero(~low)]
            tiles = [[h[a : a + TILE] for a in range(0, len(h), TILE)] for h in halves]
            pairs = [(a, b, False) for a in tiles[0] for b in tiles[1]]
        else:
            pairs = [(parts[a], parts[b], a == b) for a in range(len(parts)) for b in range(a, len(parts))]
        for a, b, same in pairs:
            left, right = rows[a], rows[b]
            linked = (inside(a) @ inside(b).T == min(2, self.perm.shape[1])) & (self.x[left] @ self.x[right].T >= self.least)
            if same:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            self.links[left] += linked @ self.m[right]
            if not same:
                self.links[right] += self.m[left] @ linked
            self.edges.append(_tile_edges(linked, left, right))
            for mask, one, other in ((linked, left, right), *(() if same else ((linked.T, right, left),))):
                twice = self.d[other]
                if twice.any():
                    i, j = np.nonzero(mask[:, twice])
                    self.doubled.append((one[i], other[twice][j]))


def _linked(sent: DataFrame, cells: int, pivots: int, least: float) -> DataFrame:
    """``a, b, l``: vector a is connected with b, and has l links more; l null: a links with b, which several ids share with others."""
    ddl = "a long, b long, l long"
    schema = arrow_schema(ddl)

    def units(batch):
        cell, lo, hi, block, v, m = (batch.column(i).to_numpy() for i in range(6))
        d, xs = batch.column(6).to_numpy(zero_copy_only=False), batch.column(7).to_pylist()
        perm = np.frombuffer(b"".join(batch.column(8).to_pylist()), "<i2").reshape(len(v), -1).astype(np.int64)
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(v)].tolist(), strict=True):
            rows = [_unit(x) for x in xs[a:b]]
            sizes = np.array([len(r) for r in rows])
            for size in np.unique(sizes):  # vectors of different lengths never link
                at = np.flatnonzero(sizes == size)
                if len(at) > 1:
                    yield v[a:b][at], _Unit(int(cell[a]), int(lo[a]), int(hi[a]), block[a:b][at], np.array([rows[i] for i in at]), m[a:b][at], d[a:b][at], perm[a:b][at], cells, pivots, least)

    def run(batches):
        for batch in runs_of(batches, 3):
            for v, unit in units(batch):
                unit.run()
                if not unit.edges:
                    continue
                label = _joined(len(v), *(np.concatenate([e[k] for e in unit.edges]) for k in (0, 1)))
                some = np.flatnonzero((unit.links > 0) | (label != np.arange(len(v))))
                yield pa.RecordBatch.from_arrays([pa.array(v[some]), pa.array(v[label[some]]), pa.array(unit.links[some])], schema=schema)
                if unit.doubled:
                    pairs = np.unique(np.stack([v[np.concatenate([e[k] for e in unit.doubled])] for k in (0, 1)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(pairs.shape[1], pa.int64())], schema=schema)

    order = ("cell", "lo", "hi")
    return sent.repartition(partitions_for(sent.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(lean(run), ddl)


def near_vectors(df: DataFrame, least: float = COSINE, nearest: int = NEAREST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row for each row of ``df``.

    A link is a pair of different ids whose cosine is at least ``least``;
    ``n_links`` counts the other ids that a row's vector links with. Null
    vectors, empty and zero ones, and ones with null or non-finite components
    link with nothing; vectors of different lengths never link. Equal vectors
    are indexed once and counted as often as they have ids. A row without an id
    links with nothing, is in no component and is kept. An id with several
    vectors is one node of a component, and counts once for each that links with
    any of them. An empty table gives no rows.
    """
    given = checkpointed(prepare(df, id_col, vec_col))
    known = given.where("key IS NOT NULL AND vec_id IS NOT NULL")
    holders = checkpointed(known.groupBy("key", "vec_id").agg(F.first("x").alias("x")))
    several = checkpointed(holders.groupBy("vec_id").count().where("count > 1").select("vec_id", F.lit(True).alias("several")))
    doubled = not several.isEmpty()
    held = holders.join(several, "vec_id", "left") if doubled else holders.withColumn("several", F.lit(None).cast("boolean"))
    # ids that hold only this vector, whether others do too, and the smallest of all.
    vectors = held.groupBy("key").agg(F.first("x").alias("x"), F.count(F.when(F.col("several").isNull(), 1)).alias("m"), F.count("several").alias("d"), F.min("vec_id").alias("id"))
    vectors = checkpointed(vectors.select(F.monotonically_increasing_id().alias("v"), "key", "x", "m", (F.col("d") > 0).alias("d"), "id"))
    rows = vectors.count()
    pivots = choose_pivots(vectors, rows, least)
    n = max(1, len(pivots))
    cells = max(1, min(n, -(-COPIES * rows // CELL)))
    described = checkpointed(describe(vectors, pivots, nearest))
    links = checkpointed(_linked(_sent(described, cells, n, _cell_sizes(described, cells, n)), cells, n, least))
    counts = links.groupBy(F.col("a").alias("v")).agg(F.sum("l").alias("l"))
    edges = links.where("l IS NOT NULL").select(F.col("a").alias("u"), F.col("b").alias("v"))
    names = vectors.select("key", "v", "m", "d", "id")
    if doubled:
        # Ids with several vectors: who links with which of them, each once, and their vectors tied together.
        shared = checkpointed(held.where("several").join(names.select("key", "v"), "key").select("vec_id", "v"))
        met = links.where("l IS NULL").select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(shared.select("v", F.col("v").alias("w")))
        met = checkpointed(met.distinct().join(shared.withColumnRenamed("v", "w"), "w").select("v", "vec_id").distinct())
        edges = edges.unionByName(shared.join(shared.groupBy("vec_id").agg(F.min("v").alias("u")), "vec_id").select("u", "v").where("u <> v"))
    component = components(edges).withColumnRenamed("node", "v")
    placed = names.join(counts, "v", "left").join(component, "v", "left").withColumn("component", F.coalesce("component", "v"))
    lowest = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    placed = placed.join(lowest, "component").select("key", "v", F.coalesce("l", F.lit(0)).alias("l"), "m", "component_id")
    found = given.select("vec_id", "key").join(placed, "key", "left")
    own = F.col("l") + F.col("m") - 1
    if doubled:
        others = met.groupBy("v").agg(F.count("*").alias("more"))
        found = found.join(others, "v", "left")
        # An id with several vectors is not among the m, but among those met, and so is taken off once either way.
        own = F.col("l") + F.col("m") + F.coalesce("more", F.lit(0)) - 1
    links_of = F.when(F.col("vec_id").isNotNull() & F.col("key").isNotNull(), own).otherwise(0).cast("long")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce(F.when(F.col("key").isNotNull(), F.col("component_id")), "vec_id"))
    return found.select("vec_id", links_of.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
