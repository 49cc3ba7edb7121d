"""Near-duplicate documents: MinHash signatures, banding, verification and connected components.

Documents with the same set of word shingles are one set first. Each set has a
signature of universal hash minima, cut into bands; sets with an equal band are
in one bucket. A bucket's centre is the set that shares the most bands with
others; each member is compared with the centre: signatures first, with a
margin that no real link falls under, then the full sets. What is then left are
centres whose members are in different components. Of these, each member's
difference to the centre is taken; the differences of two members give their
exact similarity, so members are compared in blocks by one matrix product, and
only edges that join components are written. The members of a large group's
largest component meet only those of its other components, so a group of which
most is joined already costs as many rows as it has members. No pair that shares
a band and could join two components is left out, and no pairs of a group are
emitted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geospan.llm.common import arrow_schema, checkpointed, lean, lower_ascii, map_texts, partitions_for, runs_of
from geospan.llm.components import components

#: Words in a shingle; minima in a band; bands; least similarity in percent. A pair of similarity 0.85 shares no band with a chance of 2e-7.
WORDS, ROWS, BANDS, PERCENT = 5, 5, 26, 85
#: Signatures of linked sets differ by chance: pairs whose share of equal minima is this much below the threshold (six standard deviations) are not linked.
MARGIN = 0.2
#: Members and bytes of differences in a block of a centre, and elements whose product is taken at once.
BLOCK, BLOCK_BYTES, FEATURES = 1024, 4_000_000, 2048
#: Rows up to which a table of centres is small enough to send to all executors; larger ones are joined by key.
SMALL = 20_000
#: Words whose hashes a task keeps, and their longest: some 20 MB.
KEPT_WORDS, LONGEST_WORD = 100_000, 64

_K = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    """Hashes of words; once there are too many, they are collected anew."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word, 1)
        if len(word) <= LONGEST_WORD:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value


class Shingler:
    """The set of a text as sorted 64-bit hashes of its shingles."""

    def __init__(self, words: int = WORDS):
        self.n = words
        self.hashes = _Hashes()

    def set_of(self, text: str) -> np.ndarray:
        words = lower_ascii(text).encode("utf-8", "surrogatepass").split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        total = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            total = total * _K + h[i : len(h) - n + 1 + i]
        return np.unique(_mix(total + np.uint64(n)))


class Signer:
    """Minima of ``k`` universal hashes a * x + b modulo 2**32 over the set's hashes."""

    def __init__(self, k: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 31, k, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, k, dtype=np.uint32)

    def sign(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048]
            np.minimum(least, (self.a[:, None] * part[None, :] + self.b[:, None]).min(1), out=least)
        return least


def sign_documents(df: DataFrame, words: int, rows: int, bands: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, key`` (of the set) and ``sig`` of each row."""

    def make():
        shingler, signer = Shingler(words), Signer(rows * bands)

        def one(key, text):
            hashes = shingler.set_of(text)
            if not len(hashes):
                return [(key, 0, None, None)]
            signature = signer.sign(hashes)
            return [(key, len(hashes), hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), signature.tobytes())]

        return one

    return map_texts(df, make, "doc_id long, n long, key binary, sig binary", id_col, text_col)


def _band_rows(sets: DataFrame, rows: int, bands: int) -> DataFrame:
    """``id, band`` for each set and band; the band's number is part of its hash."""
    schema = arrow_schema("id long, band long")

    def run(batches):
        for batch in batches:
            minima = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, bands, rows).astype(np.uint64)
            total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), minima.shape[:2])
            for i in range(rows):
                total = _mix(total * _K + minima[:, :, i])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), bands)), pa.array(total.ravel().view(np.int64))], schema=schema)

    return sets.select("id", "sig").mapInArrow(lean(run), "id long, band long")


def _agreeing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, share``: the share of minima in which the signatures of each pair agree."""
    signatures = sets.select("id", "sig")
    both = pairs.join(signatures.withColumnsRenamed({"id": "a", "sig": "sa"}), "a").join(signatures.withColumnsRenamed({"id": "b", "sig": "sb"}), "b")
    schema = arrow_schema("a long, b long, share double")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).mean(1))], schema=schema)

    return both.select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long, share double")


def _full_sets(documents: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``id, s``: the whole sets of the documents wanted."""

    def make():
        shingler = Shingler(words)
        return lambda key, text: [(key, shingler.set_of(text).tobytes())]

    return checkpointed(map_texts(documents.join(ids, "_id", "left_semi"), make, "id long, s binary", "_id", "_text"))


def _similar(pairs: DataFrame, documents: DataFrame, words: int) -> DataFrame:
    """``a, b, inter, uni``: sizes of the intersection and the union of the full sets of each pair."""
    full = _full_sets(documents, pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), words)
    both = pairs.join(full.withColumnsRenamed({"id": "a", "s": "x"}), "a").join(full.withColumnsRenamed({"id": "b", "s": "y"}), "b")
    schema = arrow_schema("a long, b long, inter long, uni long")

    def run(batches):
        for batch in batches:
            inter, uni = [], []
            xs, ys = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                both = np.concatenate((np.frombuffer(xs[i].as_buffer(), np.uint64), np.frombuffer(ys[i].as_buffer(), np.uint64)))
                both.sort(kind="stable")
                inter.append(int((both[1:] == both[:-1]).sum()))
                uni.append(len(both) - inter[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inter, pa.int64()), pa.array(uni, pa.int64())], schema=schema)

    return both.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long, inter long, uni long")


def _sent(df: DataFrame) -> DataFrame:
    """``df``, a checkpointed table of centres, to be sent to all executors if its size allows that."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _differences(members: DataFrame, full: DataFrame) -> DataFrame:
    """``centre, id, component, n, d``: each member's size, and the elements that are in its set or the centre's only.

    The centre's set is copied for every ``BLOCK`` members, so that a large group is not joined in one task.
    """
    large = checkpointed(members.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts")).where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = members.join(_sent(large), "centre", "left").select("centre", "id", "component", F.pmod(F.xxhash64("id"), parts).alias("part"))
    centres = members.select("centre").distinct().join(_sent(large), "centre", "left").select("centre", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    sets = centres.join(full.withColumnsRenamed({"id": "centre", "s": "y"}), "centre")
    both = dealt.join(full.withColumnsRenamed({"s": "x"}), "id").join(sets, ["centre", "part"])
    ddl = "centre long, id long, component long, n long, d binary"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            sizes, differ = [], []
            for x, y in zip(batch.column(3), batch.column(4), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                sizes.append(len(x))
                differ.append(np.setxor1d(x, np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(differ, pa.binary())], schema=schema)

    return both.select("centre", "id", "component", "x", "y").mapInArrow(lean(run), ddl)


def _shared(differ: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share; elements of one set only are left out of the product."""
    sizes = np.array([len(d) for d in differ])
    out = np.zeros((len(differ), len(differ)), np.float32)
    if not sizes.sum():
        return out
    _, place, count = np.unique(np.concatenate(differ), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    common = count[place] > 1
    rows, cols = np.repeat(np.arange(len(differ)), sizes)[common], number[place[common]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, FEATURES):
        a, b = np.searchsorted(cols, (at, at + FEATURES))
        part = np.zeros((len(differ), FEATURES), np.float32)
        part[rows[a:b], cols[a:b] - at] = 1
        out += part @ part.T
    return out


def _joining(differences: DataFrame, percent: int, partitions: int) -> DataFrame:
    """``u, v``: edges that join members of a centre which are linked but in different components.

    With D the difference to the centre, two sets differ in |Dx| + |Dy| - 2 |Dx
    and Dy| elements, which with their sizes gives the similarity exactly. A
    large group's largest component is dealt into the first blocks, the rest
    into the others; only pairs of blocks with one of the others meet. One edge
    a member and block pair is written.
    """
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES)).cast("long")
    parts = differences.groupBy("centre", "component").agg(F.count("*").alias("n"), F.sum(F.octet_length("d")).alias("bytes"))
    most = F.max(F.struct("n", "bytes", "component"))
    large = parts.groupBy("centre").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), most.alias("m")).where(blocks("n", "bytes") > 1)
    large = large.select("centre", F.col("m.component").alias("giant"), blocks("m.n", "m.bytes").alias("first"), (F.col("n") - F.col("m.n")).alias("n"), (F.col("bytes") - F.col("m.bytes")).alias("bytes"))
    large = checkpointed(large.select("centre", "giant", "first", F.greatest(blocks("n", "bytes"), F.lit(1)).alias("others")))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = differences.join(_sent(large), "centre", "left").withColumns({"first": F.coalesce("first", zero), "others": F.coalesce("others", one)})
    free = F.coalesce(F.col("component") != F.col("giant"), F.lit(True))
    rows = rows.withColumn("free", free).withColumn("own", F.when(free, F.col("first") + F.pmod(F.xxhash64("id"), F.col("others"))).otherwise(F.pmod(F.xxhash64("id"), F.greatest("first", one))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("free"), zero).otherwise(F.col("first")), F.col("first") + F.col("others") - 1)))
    rows = rows.select("centre", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id", "component", "n", "d")
    rows = rows.repartition(partitions, "centre", "lo", "hi").sortWithinPartitions("centre", "lo", "hi")
    schema = arrow_schema("u long, v long")

    def run(batches):
        for batch in runs_of(batches, 3):
            centre, lo, hi, ids, component, n = (batch.column(i).to_numpy() for i in range(6))
            differ = [np.frombuffer(d, np.uint64) for d in batch.column(6).to_pylist()]
            cuts = np.flatnonzero((centre[1:] != centre[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            for a, b in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(ids)])).tolist(), strict=True):
                if b - a < 2 or (component[a:b] == component[a]).all():
                    continue
                size = np.array([len(d) for d in differ[a:b]])
                apart = size[:, None] + size[None, :] - 2 * _shared(differ[a:b]).astype(np.int64)
                total = n[a:b, None] + n[None, a:b]
                linked = (100 * (total - apart) >= percent * (total + apart)) & (component[a:b, None] != component[None, a:b])
                label = ids[a:b].copy()
                while True:
                    low = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1))
                    if (low == label).all():
                        break
                    label = low
                moved = label != ids[a:b]
                if moved.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][moved]), pa.array(label[moved])], schema=schema)

    return rows.mapInArrow(lean(run), "u long, v long")


def near_duplicates(df: DataFrame, percent: int = PERCENT, words: int = WORDS, rows: int = ROWS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of ``df``.

    Two documents are linked if 100 * intersection >= percent * union of their
    shingle sets; the component is the smallest id reachable over links.
    Null or empty text, or text without words: an empty set, linked with
    nothing. Rows that share an id are one document, linked if any of their
    texts is. A row without an id has no component and is kept.
    """
    documents = df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    signed = checkpointed(sign_documents(documents, words, rows, bands, "_id", "_text"))
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    firsts = some.groupBy("key").agg(F.min("doc_id").alias("id"))
    sets = checkpointed(firsts.join(some.select("key", F.col("doc_id").alias("id"), "sig").dropDuplicates(["key", "id"]), ["key", "id"]).select("id", "sig"))
    known = _links(documents, sets, percent, words, rows, bands)
    of_set = firsts.join(known.withColumnRenamed("node", "id"), "id", "left").select("key", F.coalesce("component", "id").alias("component"))
    # An id with two texts ties their components together.
    doubled = some.groupBy("doc_id").agg(F.min("key").alias("k1"), F.max("key").alias("k2")).where("k1 <> k2").select("doc_id")
    if not doubled.isEmpty():
        ties = some.join(doubled, "doc_id", "left_semi").select("doc_id", "key").distinct().join(firsts, "key").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
        edges = ties.unionByName(known.select(F.col("node").alias("u"), F.col("component").alias("v")))
        own = components(edges.unionByName(some.join(firsts, "key").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))))
        found = signed.join(own.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    else:
        found = signed.join(of_set, "key", "left")
    component = F.coalesce(F.col("component"), F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _links(documents: DataFrame, sets: DataFrame, percent: int, words: int, per_band: int, bands: int) -> DataFrame:
    """``node, component`` of the sets that are linked with others."""
    least = percent / 100 - MARGIN
    rows = _band_rows(sets, per_band, bands)
    buckets = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = checkpointed(rows.join(buckets, "band"))
    weight = members.groupBy("id").agg(F.sum("n").alias("w"))
    weighed = members.join(weight, "id").select("band", "id", "w")
    centres = weighed.groupBy("band").agg(F.max(F.struct("w", (-F.col("id")).alias("i"))).alias("c")).select("band", (-F.col("c.i")).alias("centre"))
    placed = checkpointed(members.select("band", "id").join(centres, "band"))
    stars = placed.where("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    looked = checkpointed(_agreeing(stars, sets))
    near = looked.where(F.col("share") >= least).select("a", "b")
    sizes = checkpointed(_similar(near, documents, words).groupBy("a", "b").agg(F.max(F.struct(F.col("inter") / F.col("uni"), "inter", "uni")).alias("m")).select("a", "b", "m.inter", "m.uni"))
    linked = sizes.where(F.col("inter") * 100 >= F.col("uni") * percent)
    first = checkpointed(components(linked.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    # Centres whose members are not all in one component.
    named = placed.select("centre", "id").distinct().join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = checkpointed(named.groupBy("centre").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("centre"))
    left = checkpointed(named.join(_sent(mixed), "centre", "left_semi").select("centre", "id", "component"))
    if left.isEmpty():
        return first
    full = _full_sets(documents, left.select(F.explode(F.array("centre", "id")).alias("_id")).distinct(), words)
    more = checkpointed(_joining(checkpointed(_differences(left, full)), percent, partitions_for(documents.sparkSession)))
    return components(more.unionByName(first.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def keep_one(df: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose document is the first of its component, with all columns.

    Of rows that share an id, one stays: the one whose columns' digest is the
    smallest, whatever their order. Rows without an id stay all; null and empty
    texts are near-duplicates of nothing; an empty table gives no rows.
    """
    found = checkpointed(near_duplicates(df, percent, id_col=id_col, text_col=text_col).select("doc_id", "kept"))
    gone = found.where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct()
    rest = df.join(gone, id_col, "left_anti").select(df.columns)
    repeated = found.where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(id_col)).count().where("count > 1").select(id_col)
    if repeated.isEmpty():
        return rest
    whole = F.struct(*df.columns)
    one = rest.join(repeated, id_col, "left_semi").groupBy(id_col).agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("row")).select("row.*")
    return rest.join(repeated, id_col, "left_anti").select(df.columns).unionByName(one)
