"""Suffix-array dedup: bytes covered by a long string that an earlier document also holds.

Documents are packed into blocks of a few megabytes, a long one in pieces, and
consecutive blocks into groups. Each window of ``size`` bytes has a gram of
``GRAM`` bytes with the least hash (its minimiser). At least half of its other bytes
are on one side of that gram; so many of them, next to the gram, and the gram itself
are what it is named by. So equal windows, wherever they are, get the same name, and
texts that share a few words do not; a run of windows with one name is a *stretch* of text.
Names are dealt to ranges of their hash. Three exchanges, all of packed arrays:

1. Groups send the names they hold, once each, to the ranges. A range answers
   which names are in several documents; all other text is done.
2. Groups send the stretches of those names, each different one once, to the
   ranges. A range builds the suffix array of its stretches by induced sorting,
   finds the permuted common prefixes of at least ``size`` bytes, and so the
   smallest document of each window; it answers with runs of windows.
3. Groups mark the bytes of windows that a smaller document holds, and count.

Groups and ranges are of bounded size and are processed one after the other, in
the order in which the exchange sorts them; both grow with the root of the input
up to their bound, so that messages do not get small. Nothing is sent for each
pair of documents; a passage in a third of all documents is one name and one
stretch for each group. A name whose stretches differ very often (a common short
passage between different texts) is *hot*: its windows are dealt one by one, by a
hash of all their bytes, so that no range holds them all. Names and answers are
hints and places only: what is removed has been compared byte by byte.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geospan.llm.common import arrow_schema, give_back, lean, partitions_for, runs_of
from geospan.llm.suffixes import common_with_previous, suffix_array, words_at

#: Bytes of a repeated string, and of the grams whose hashes name a window.
SIZE, GRAM = 50, 16
#: Bytes of text in a block or a piece, windows named at once, and different stretches from which a name is hot.
BLOCK_BYTES, AT_ONCE, HOT = 1_500_000, 400_000, 4096
#: Least and most bytes of text of a group and for each range, and names that a message should hold.
GROUP_BYTES, RANGE_BYTES, MOST_BYTES, MESSAGE = 3_000_000, 3_000_000, 16_000_000, 512
#: Stretches of one name in a group from which their differences are counted.
COUNTED = 32
#: Bytes of text for each name, on average.
SIZE_OF_NAME = 10

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_M = np.uint64(0xFF51AFD7ED558CCD)
_NEVER = np.iinfo(np.int64).max


@functools.cache
def _codec():
    return pa.Codec("zstd", 1)


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _codec().compress(data, asbytes=True)


def _unpack(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return _codec().decompress(data[8:], size, asbytes=True) if size else b""


def pack_blocks(df: DataFrame, id_col: str, text_col: str, size: int, block_bytes: int, group_bytes: int) -> DataFrame:
    """``group, block, ids, known, rows, pieces, own, sizes, cuts, data``: consecutive documents in blocks.

    A document of more than ``block_bytes`` is cut into pieces; a piece holds
    ``own`` bytes, and behind them the bytes that its last windows reach into.
    ``rows`` numbers the rows of the table, ``pieces`` is -1 for whole documents,
    ``cuts`` are the stretches.
    """
    ddl = "group long, block long, ids binary, known binary, rows binary, pieces binary, own binary, sizes binary, cuts binary, data binary"
    schema = arrow_schema(ddl)

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, int, int, int, bytes]] = []
        now = {"bytes": 0, "block": base, "group": base, "in_group": 0, "row": base}

        def block():
            ids, data = [h[0] for h in held], b"".join(h[4] for h in held)
            sizes = np.array([len(h[4]) for h in held], "<i8")
            cuts = _cut(np.frombuffer(data, np.uint8), sizes, [i is not None for i in ids], size)
            row = {"group": now["group"], "block": now["block"], "ids": np.array([0 if i is None else i for i in ids], "<i8").tobytes(), "known": np.array([i is not None for i in ids]).tobytes()}
            row |= {"rows": np.array([h[1] for h in held], "<i8").tobytes(), "pieces": np.array([h[2] for h in held], "<i4").tobytes(), "own": np.array([h[3] for h in held], "<i8").tobytes(), "sizes": sizes.tobytes(), "cuts": _pack(_cuts_out(*cuts)), "data": _pack(data)}
            now["in_group"] += now["bytes"]
            now["block"] += 1
            if now["in_group"] >= group_bytes:
                now["group"], now["in_group"] = now["group"] + 1, 0
            held.clear()
            now["bytes"] = 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        def parts(text: memoryview) -> Iterator[tuple[int, int, bytes]]:
            """Piece number, own bytes, and bytes; the last piece has all that is left."""
            if len(text) <= block_bytes:
                yield -1, len(text), bytes(text)
                return
            cut = max(block_bytes, size)
            starts = range(0, len(text) - size + 1, cut)
            for number, a in enumerate(starts):
                last = a + cut > len(text) - size
                b = len(text) if last else a + cut
                yield number, b - a, bytes(text[a : b if last else b + size - 1])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()), strict=True):
                    for piece, own, data in parts(memoryview(text.as_buffer())):
                        if held and now["bytes"] + len(data) > block_bytes:
                            yield block()
                        held.append((i, now["row"], piece, own, data))
                        now["bytes"] += len(data)
                    now["row"] += 1
        if held:
            yield block()

    return df.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(lean(run), ddl)


def _hashed(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """A hash of grams by their first and last eight bytes."""
    h = head * _A + tail * _B
    h ^= h >> np.uint64(32)
    h *= _M
    h ^= h >> np.uint64(29)
    return h


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position that has so many."""
    w, n = words_at(data), len(data) - gram + 1
    if gram >= 8:
        return _hashed(w[:n], w[gram - 8 : gram - 8 + n])
    short = w[:n] & np.uint64((1 << (8 * gram)) - 1)
    return _hashed(short, short)


def _spread(least: np.ndarray) -> np.ndarray:
    """Least hashes are small; mixed once more, they fall evenly on the ranges."""
    x = (least ^ (least >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(30))


def _words_of(data: np.ndarray, size: int) -> np.ndarray:
    """The eight bytes from each place at which a window has so many, without copies where that can be."""
    return np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,)) if size >= 8 and len(data) >= 8 else words_at(data)


def _place_bits(size: int) -> np.uint64:
    """Low bits of a gram's hash that make room for its place among those named at once."""
    return np.uint64((AT_ONCE + size).bit_length())


def _half(size: int) -> int:
    """Bytes before its least gram from which a window is named with bytes before it, not behind it."""
    return (size - min(GRAM, size) + 1) // 2


def _named(words: np.ndarray, starts: np.ndarray, grams: np.ndarray, size: int) -> np.ndarray:
    """The name of each window: a hash of its least gram and of the bytes next to it that all windows have with most of theirs on that side."""
    gram, half = min(GRAM, size), _half(size)
    before = grams - starts >= max(half, 1)
    names = np.empty(len(grams), np.uint64)
    for side, shift, length in ((True, half, gram + half), (False, 0, size - max(half, 1) + 1)):
        names[before == side] = _hash_of(words, (grams - shift)[before == side], length)
    return _spread(names)


def _hash_of(words: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """A hash of all of the ``length`` bytes from each place."""
    if length < 8:
        short = words[places] & np.uint64((1 << (8 * length)) - 1)
        return _hashed(short, short)
    total = np.zeros(len(places), np.uint64)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        total = (total ^ words[places + at]) * _M
        total ^= total >> np.uint64(32)
    return total


def _cut(data: np.ndarray, sizes: np.ndarray, known: list[bool], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end of windows and place of the first one's least gram of each stretch.

    The hash's low bits are replaced by the place, so that the least one tells
    where it is: of equal hashes the leftmost, in all equal windows alike. Windows
    of one gram are cut where half of their other bytes are before it. In periodic
    text, where each window has a gram of its own, neighbours of one name are put
    together again, at most as many as can share a gram.
    """
    n = len(data) - size + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 3
    usable = np.zeros(n + 1, np.int8)  # windows inside one document that has an id
    first = np.concatenate(([0], np.cumsum(sizes)))
    for a, b, has_id in zip(first[:-1], first[1:], known, strict=True):
        if has_id and b - a >= size:
            usable[a] += 1
            usable[b - size + 1] -= 1
    usable = np.cumsum(usable[:-1]) > 0
    gram, bits, half = min(GRAM, size), _place_bits(size), _half(size)
    per_window, mask = size - gram + 1, (np.uint64(1) << bits) - np.uint64(1)
    changes, values = [], []
    for at in range(0, n, AT_ONCE):
        count = min(AT_ONCE, n - at)
        h = _gram_hashes(data[at : at + count + size - 1], gram)
        h >>= bits
        h <<= bits
        h |= np.arange(len(h), dtype=np.uint64)
        least, reach = h, 1
        while 2 * reach <= per_window:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < per_window:
            least = np.minimum(least[: len(least) - (per_window - reach)], least[per_window - reach :])
        new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (usable[at + 1 : at + count] != usable[at : at + count - 1]))))
        changes.append(new + at)
        values.append((least[new] & mask).astype(np.int64) + at)
    starts, grams = np.concatenate(changes), np.concatenate(values)
    ends = np.concatenate((starts[1:], [n]))
    good = usable[starts]
    starts, ends, grams = starts[good], ends[good], grams[good]
    # From where on fewer than half of a window's other bytes are before its gram.
    turn = np.clip(grams - max(half, 1) + 1, starts, ends)
    starts, ends, grams = np.stack((starts, turn), axis=1).reshape(-1), np.stack((turn, ends), axis=1).reshape(-1), np.repeat(grams, 2)
    some = ends > starts
    starts, ends, grams = starts[some], ends[some], grams[some]
    if not len(starts):
        return starts, ends, grams
    names = _named(_words_of(data, size), starts, grams, size)
    apart = np.concatenate(([True], (names[1:] != names[:-1]) | (starts[1:] != ends[:-1]) | (starts[1:] // per_window != starts[:-1] // per_window)))
    return starts[apart], ends[np.concatenate((apart[1:], [True]))], grams[apart]


def _cuts_out(starts: np.ndarray, ends: np.ndarray, grams: np.ndarray) -> bytes:
    """The stretches as small numbers: the gap before each, its windows, and how far behind its start the gram is."""
    gaps = starts - np.concatenate(([0], ends[:-1]))
    return len(starts).to_bytes(8, "little") + b"".join(x.astype("<u4").tobytes() for x in (gaps, ends - starts, grams - starts))


def _cuts_in(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    gaps, windows, grams = np.frombuffer(data, "<u4", 3 * n, 8).reshape(3, n).astype(np.int64)
    ends = np.cumsum(gaps + windows)
    return ends - windows, ends, ends - windows + grams


class Block:
    """A block's documents and pieces, and the stretches of windows that share a name."""

    def __init__(self, row: dict, size: int):
        self.ids, self.known, self.rows = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], bool), np.frombuffer(row["rows"], "<i8")
        self.pieces, self.own, self.sizes = np.frombuffer(row["pieces"], "<i4"), np.frombuffer(row["own"], "<i8"), np.frombuffer(row["sizes"], "<i8")
        self.data, self.size = np.frombuffer(_unpack(row["data"]), np.uint8), size
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.starts, self.ends, grams = _cuts_in(_unpack(row["cuts"]))
        self.names = _named(_words_of(self.data, size), self.starts, grams, size)
        self.document = self.ids[np.searchsorted(self.first, self.starts, "right") - 1]

    def ends_differ(self) -> np.ndarray:
        """For each stretch a number that tells apart most stretches of one name: of its length and its first and last bytes."""
        words = words_at(self.data)
        last = np.maximum(self.ends + self.size - 9, 0)
        return (words[self.starts] * _A) ^ (words[last] * _B) ^ (self.ends - self.starts).astype(np.uint64)

    def window_names(self, windows: np.ndarray) -> np.ndarray:
        """A hash of all bytes of each window."""
        return _spread(_hash_of(_words_of(self.data, self.size), windows, self.size))


def _slices(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)])) if len(sorted_keys) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(sorted_keys[a]), a, b


def _range_of(names: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of each name, and 32 bits that tell names of a range apart; rare mistakes only cost time."""
    top = (names >> np.uint64(32)) * np.uint64(ranges)
    low = (top & np.uint64(0xFFFFFFFF)) ^ (names & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B1)
    return (top >> np.uint64(32)).astype(np.int64), low & np.uint64(0xFFFFFFFF)


class _Numbers:
    """Consecutive numbers for different contents; single windows of hot names are apart from stretches of the same bytes."""

    def __init__(self) -> None:
        self.next = itertools.count().__next__
        self.known = {one: defaultdict(self.next) for one in (False, True)}

    def of(self, contents: Iterator[bytes], one: bool, n: int) -> np.ndarray:
        return np.fromiter(map(self.known[one].__getitem__, contents), np.int64, n)

    def all(self) -> tuple[list[bytes], np.ndarray]:
        """The contents by number, and whether each is a single window."""
        out, single = [b""] * sum(map(len, self.known.values())), np.zeros(sum(map(len, self.known.values())), bool)
        for one, known in self.known.items():
            for content, number in known.items():
                out[number] = content
            single[list(known.values())] = one
        return out, single


class Group:
    """The blocks of a group, and their stretches one after the other."""

    def __init__(self, blocks: list[dict], size: int, ranges: int):
        self.blocks = [Block(row, size) for row in sorted(blocks, key=lambda r: r["block"])]
        self.ranges, self.size = ranges, size
        joined = lambda name, kind: np.concatenate([np.empty(0, kind), *(getattr(b, name) for b in self.blocks)])
        self.starts, self.ends, names, self.document = joined("starts", np.int64), joined("ends", np.int64), joined("names", np.uint64), joined("document", np.int64)
        self.block = np.repeat(np.arange(len(self.blocks)), [len(b.starts) for b in self.blocks])
        self.range, low = _range_of(names, ranges)
        key = (self.range.astype(np.uint64) << np.uint64(32)) | low
        # The distinct names in order, and the place of each stretch's among them.
        self.keys, self.place = np.unique(key, return_inverse=True)
        self.place = self.place.reshape(-1)

    def several(self) -> np.ndarray:
        """Of each name, whether several documents here hold it."""
        lo, hi = np.full(len(self.keys), _NEVER), np.full(len(self.keys), -_NEVER)
        np.minimum.at(lo, self.place, self.document)
        np.maximum.at(hi, self.place, self.document)
        return lo != hi

    def different(self, counted: int) -> np.ndarray:
        """About how many different stretches each name has here, of which there are ``counted``; of others, how many stretches."""
        count = np.bincount(self.place, minlength=len(self.keys))
        some = np.flatnonzero(count[self.place] >= counted)
        if len(some):
            sort = np.concatenate([b.ends_differ() for b in self.blocks])[some]
            pairs = np.unique(np.stack((self.place[some].astype(np.uint64), sort)), axis=1)[0].astype(np.int64)
            new = np.bincount(pairs, minlength=len(self.keys))
            count = np.where(count >= counted, new, count)
        return np.minimum(count, 65535)

    def units(self, marks: list[dict]) -> None:
        """What is to be compared, after the answers to the names: stretches of shared names, and single windows of hot ones.

        Sets block, first window, end and content of each unit, and of the different contents the range, bytes, smallest document, and whether they are single windows.
        """
        shared, hot = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        at = {r: (a, b) for r, a, b in _slices((self.keys >> np.uint64(32)).astype(np.int64))}
        for m in marks:
            a, b = at[m["range"]]
            shared[a:b], hot[a:b] = (np.unpackbits(np.frombuffer(m[c], np.uint8), count=b - a).astype(bool) for c in ("a", "b"))
        wanted = np.flatnonzero(shared[self.place])
        is_hot = hot[self.place[wanted]]
        plain, cut = wanted[~is_hot], wanted[is_hot]
        block, start, end, where = self.block[plain], self.starts[plain], self.ends[plain], self.range[plain]
        document, alone = self.document[plain], np.zeros(len(plain), bool)
        if len(cut):
            n = self.ends[cut] - self.starts[cut]
            windows = np.repeat(self.starts[cut] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            own = np.repeat(self.block[cut], n)
            keys = np.empty(len(windows), np.uint64)
            for k, b in enumerate(self.blocks):
                keys[own == k] = b.window_names(windows[own == k])
            block, start, end = np.concatenate((block, own)), np.concatenate((start, windows)), np.concatenate((end, windows + 1))
            where, document = np.concatenate((where, _range_of(keys, self.ranges)[0])), np.concatenate((document, np.repeat(self.document[cut], n)))
            alone = np.concatenate((alone, np.ones(len(windows), bool)))
        numbers = _Numbers()
        which = np.empty(len(block), np.int64)
        for k, b in enumerate(self.blocks):
            data = b.data.tobytes()
            for one in (False, True):
                here = np.flatnonzero((block == k) & (alone == one))
                which[here] = numbers.of((data[s:e] for s, e in zip(start[here].tolist(), (end[here] + self.size - 1).tolist(), strict=True)), one, len(here))
        texts, _ = numbers.all()
        first = np.zeros(len(texts), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        order = np.argsort(where[first], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        least = np.full(len(texts), _NEVER)
        np.minimum.at(least, rank[which], document)
        self.unit_block, self.unit_start, self.unit_document, self.content = block, start, document, rank[which]
        self.content_range, self.content_alone, self.content_least = where[first[order]], alone[first[order]], least
        self.content_texts = [texts[i] for i in order.tolist()]

    def gone(self, answers: list[dict]) -> list[np.ndarray]:
        """Of each block, which bytes are in a window that a smaller document holds."""
        marks = [np.zeros(len(b.data) + 1, np.int32) for b in self.blocks]
        if len(self.content):
            by_range = {m["range"]: m for m in answers}
            runs, ends, least = [], [], []
            for r, _, _ in _slices(self.content_range):
                m = by_range[r]
                runs.append(np.frombuffer(_unpack(m["a"]), "<u4").astype(np.int64))
                ends.append(np.frombuffer(_unpack(m["b"]), "<u4").astype(np.int64))
                least.append(np.frombuffer(_unpack(m["c"]), "<i8"))
            runs, ends, least = np.concatenate(runs), np.concatenate(ends), np.concatenate(least)
            first = np.concatenate(([0], np.cumsum(runs)))
            begins = np.concatenate(([0], ends[:-1]))
            begins[first[:-1]] = 0
            n = runs[self.content]
            take = np.repeat(first[self.content] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            unit = np.repeat(np.arange(len(n)), n)
            smaller = least[take] < self.unit_document[unit]
            take, unit = take[smaller], unit[smaller]
            for k, mark in enumerate(marks):
                here = self.unit_block[unit] == k
                start = self.unit_start[unit[here]]
                np.add.at(mark, start + begins[take[here]], 1)
                np.add.at(mark, start + ends[take[here]] - 1 + self.size, -1)
        return [np.cumsum(mark[:-1]) > 0 for mark in marks]


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range after the other; ``range`` is the first column."""
    for batch in runs_of(batches, 1):
        for _, a, b in _slices(batch.column(0).to_numpy()):
            yield batch.slice(a, b - a)


_ANSWER = "group long, kind int, range long, a binary, b binary, c binary"


def _send_names(packed: DataFrame, size: int, ranges: int, counted: int) -> DataFrame:
    ddl = "range long, group long, names binary, several binary, different binary"
    schema = arrow_schema(ddl)

    def run(table: pa.Table) -> pa.Table:
        give_back()
        group = Group(table.to_pylist(), size, ranges)
        several, different, low = group.several(), group.different(counted).astype("<u2"), (group.keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        key = table.column("group")[0].as_py()
        rows = [{"range": r, "group": key, "names": low[a:b].tobytes(), "several": np.packbits(several[a:b]).tobytes(), "different": _pack(different[a:b].tobytes())} for r, a, b in _slices((group.keys >> np.uint64(32)).astype(np.int64))]
        return pa.Table.from_batches([_rows(rows, schema)])

    return packed.groupBy("group").applyInArrow(run, ddl)


def _answer_names(sent: DataFrame, partitions: int, most: int) -> DataFrame:
    """For each group and range, of each name sent: whether several documents hold it (a), and whether it is hot (b)."""
    schema = arrow_schema(_ANSWER)

    def run(batches):
        for batch in _by_range(batches):
            names = [np.frombuffer(x, "<u4") for x in batch.column(2).to_pylist()]
            several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)).astype(bool) for x, n in zip(batch.column(3).to_pylist(), names, strict=True)]
            different = [np.frombuffer(_unpack(x), "<u2").astype(np.int64) for x in batch.column(4).to_pylist()]
            every, place = np.unique(np.concatenate(names), return_inverse=True)
            place = place.reshape(-1)
            shared = (np.bincount(place) > 1) | (np.bincount(place, np.concatenate(several)) > 0)
            hot = shared & (np.bincount(place, np.concatenate(different)) > most)
            rows, at = [], 0
            for group, n in zip(batch.column(1).to_pylist(), names, strict=True):
                own = place[at : at + len(n)]
                at += len(n)
                rows.append({"group": group, "kind": 0, "range": batch.column(0)[0].as_py(), "a": np.packbits(shared[own]).tobytes(), "b": np.packbits(hot[own]).tobytes(), "c": b""})
            yield _rows(rows, schema)

    return sent.repartition(partitions, "range").sortWithinPartitions("range").mapInArrow(lean(run), _ANSWER)


def _send_contents(packed: DataFrame, marks: DataFrame, size: int, ranges: int) -> DataFrame:
    ddl = "range long, group long, sizes binary, least binary, alone binary, data binary"
    schema = arrow_schema(ddl)

    def run(blocks: pa.Table, marked: pa.Table) -> pa.Table:
        give_back()
        group = Group(blocks.to_pylist(), size, ranges)
        group.units(marked.to_pylist())
        key, rows, texts = blocks.column("group")[0].as_py(), [], group.content_texts
        for r, a, b in _slices(group.content_range):
            rows.append({"range": r, "group": key, "sizes": np.array([len(t) for t in texts[a:b]], "<u4").tobytes(), "least": group.content_least[a:b].tobytes(), "alone": np.packbits(group.content_alone[a:b]).tobytes(), "data": _pack(b"".join(texts[a:b]))})
        return pa.Table.from_batches([_rows(rows, schema)])

    return packed.groupBy("group").cogroup(marks.groupBy("group")).applyInArrow(run, ddl)


def _share_names(texts: list[bytes], size: int) -> np.ndarray:
    """Which contents have the name of another one."""
    gram, bits = min(GRAM, size), _place_bits(size)
    first = np.cumsum([0, *(len(t) for t in texts[:-1])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = _gram_hashes(data, gram)
    least = np.full(len(first), np.iinfo(np.uint64).max)
    for i in range(size - gram + 1):
        np.minimum(least, h[first + i] >> bits << bits | np.uint64(i), out=least)
    grams = first + (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    _, place, count = np.unique(_named(_words_of(data, size), first, grams, size), return_inverse=True, return_counts=True)
    return count[place.reshape(-1)] > 1


def smallest_documents(texts: list[bytes], least: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the texts, one after the other, the smallest document that holds it.

    ``least``: the smallest document of each text. Returns a number for each
    byte position (_NEVER where no window starts), and the positions where the texts start.
    """
    sizes = np.array([len(t) for t in texts])
    first = np.concatenate(([0], np.cumsum(sizes)))
    text = np.frombuffer(b"".join(texts), np.uint8)
    here = np.repeat(least, sizes)
    window = np.zeros(len(text) + 1, np.int64)
    np.add.at(window, first[:-1], 1)
    np.add.at(window, first[1:] - size + 1, -1)
    here = np.where(np.cumsum(window[:-1]) > 0, here, _NEVER)
    words = words_at(text)
    array = suffix_array(text, words)
    array = array[here[array] != _NEVER]  # equal windows stay neighbours without what is between texts
    same = common_with_previous(words, array, size)
    groups = np.flatnonzero(~same)
    low = np.minimum.reduceat(here[array], groups)
    out = np.full(len(text), _NEVER)
    out[array] = np.repeat(low, np.diff(np.concatenate((groups, [len(array)]))))
    return out, first


def _answer_contents(sent: DataFrame, size: int, partitions: int) -> DataFrame:
    """For each group and range: runs of windows of each content (a: how many), by end (b) and smallest document (c)."""
    schema = arrow_schema(_ANSWER)

    def run(batches):
        for batch in _by_range(batches):
            numbers = _Numbers()
            messages, lows = [], []
            for group, sizes, least, alone, data in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                raw, sizes = _unpack(data), np.frombuffer(sizes, "<u4")
                alone = np.unpackbits(np.frombuffer(alone, np.uint8), count=len(sizes)).astype(bool)
                ends, which = np.cumsum(sizes.astype(np.int64)), np.empty(len(sizes), np.int64)
                for one in (False, True) if alone.any() else (False,):
                    here = np.flatnonzero(alone == one)
                    which[here] = numbers.of((raw[a:b] for a, b in zip((ends - sizes)[here].tolist(), ends[here].tolist(), strict=True)), one, len(here))
                messages.append((group, which))
                lows.append(np.frombuffer(least, "<i8"))
            every = np.concatenate([w for _, w in messages])
            texts, single = numbers.all()
            low = np.full(len(texts), _NEVER)
            np.minimum.at(low, every, np.concatenate(lows))
            # The only content of its name, and a single window, shares no window with another content: its own smallest document is the answer.
            shares = _share_names(texts, size) & ~single
            owner, end, value = np.flatnonzero(~shares), np.array([len(t) for t in texts])[~shares] - size + 1, low[~shares]
            some = np.flatnonzero(shares)
            if len(some):
                found, first = smallest_documents([texts[i] for i in some.tolist()], low[some], size)
                # Runs of equal answers in each content.
                new = np.concatenate(([True], found[1:] != found[:-1]))
                new[first[:-1]] = True
                every_run = np.flatnonzero(new)
                stop = np.concatenate((every_run[1:], [len(found)]))
                asked = found[every_run] != _NEVER
                at, stop = every_run[asked], stop[asked]
                own = np.searchsorted(first, at, "right") - 1
                owner, end, value = np.concatenate((owner, some[own])), np.concatenate((end, stop - first[own])), np.concatenate((value, found[at]))
                order = np.argsort(owner, kind="stable")
                owner, end, value = owner[order], end[order], value[order]
            begin = np.searchsorted(owner, np.arange(len(texts) + 1))
            counts = np.diff(begin)
            for group, which in messages:
                runs = counts[which]
                take = np.repeat(begin[which] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
                yield _rows([{"group": group, "kind": 1, "range": batch.column(0)[0].as_py(), "a": _pack(runs.astype("<u4").tobytes()), "b": _pack(end[take].astype("<u4").tobytes()), "c": _pack(value[take].astype("<i8").tobytes())}], schema)

    return sent.repartition(partitions, "range").sortWithinPartitions("range").mapInArrow(lean(run), _ANSWER)


_DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _outcome(key: int | None, size: int, removed: int, spans: int, digest: str, kept: bytes | None, texts: bool) -> dict:
    return {"doc_id": key, "n_bytes": size, "n_removed": removed, "n_spans": spans, "kept_sha256": digest} | ({"kept_text": kept.decode("utf-8", "replace")} if texts else {})


def _finish(packed: DataFrame, answers: DataFrame, size: int, ranges: int, texts: bool) -> DataFrame:
    """The outcome of each whole document; of each piece of a long one (``piece`` at least 0) its bytes and which of them, and of those behind, are gone."""
    ddl = _DONE + (", kept_text string" if texts else "") + ", row long, piece int, data binary, gone binary"
    schema = arrow_schema(ddl)

    def run(blocks: pa.Table, given: pa.Table) -> pa.Table:
        give_back()
        group, told = Group(blocks.to_pylist(), size, ranges), given.to_pylist()
        group.units([m for m in told if m["kind"] == 0])
        out = []
        for block, gone in zip(group.blocks, group.gone([m for m in told if m["kind"] == 1]), strict=True):
            for i, (a, b) in enumerate(zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True)):
                own, key, piece = gone[a:b], int(block.ids[i]) if block.known[i] else None, int(block.pieces[i])
                place = {"row": int(block.rows[i]), "piece": piece}
                if piece < 0:
                    kept = block.data[a:b][~own].tobytes()
                    spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
                    out.append(_outcome(key, b - a, int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), kept, texts) | place)
                else:
                    size_own = int(block.own[i])
                    out.append({"doc_id": key, "n_bytes": size_own, **place, "data": _pack(block.data[a : a + size_own].tobytes()), "gone": _pack(np.packbits(own).tobytes())})
        return pa.Table.from_batches([_rows(out, schema)])

    return packed.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(run, ddl)


def _put_together(done: DataFrame, partitions: int, texts: bool) -> DataFrame:
    """The pieces of each long document, in order, as one outcome; one piece is held at a time."""
    ddl = _DONE + (", kept_text string" if texts else "")
    schema = arrow_schema(ddl)
    names = [f.name for f in schema]

    def run(batches):
        state = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state and state["row"] != row["row"]:
                    out.append(ended(state))
                    state = None
                if row["piece"] < 0:
                    out.append({n: row[n] for n in names})
                    continue
                state = state or {"row": row["row"], "key": row["doc_id"], "size": 0, "removed": 0, "spans": 0, "sha": hashlib.sha256(), "kept": [], "over": np.empty(0, bool), "inside": False}
                data = np.frombuffer(_unpack(row["data"]), np.uint8)
                bits = np.frombuffer(_unpack(row["gone"]), np.uint8)
                gone = np.unpackbits(bits).astype(bool)
                own = gone[: len(data)].copy()
                over = state["over"][: len(own)]
                own[: len(over)] |= over
                kept = data[~own].tobytes()
                state["sha"].update(kept)
                if texts:
                    state["kept"].append(kept)
                state["spans"] += int((own[1:] & ~own[:-1]).sum()) + int(len(own) > 0 and bool(own[0]) and not state["inside"])
                state["inside"] = bool(own[-1]) if len(own) else state["inside"]
                state["size"] += len(data)
                state["removed"] += int(own.sum())
                state["over"] = gone[len(data) :]
            if out:
                yield _rows(out, schema)
        if state:
            yield _rows([ended(state)], schema)

    def ended(state: dict) -> dict:
        return _outcome(state["key"], state["size"], state["removed"], state["spans"], state["sha"].hexdigest(), b"".join(state["kept"]) if texts else None, texts)

    return done.repartition(partitions, "row").sortWithinPartitions("row", "piece").mapInArrow(lean(run), ddl)


def repeated_bytes(df: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, block_bytes: int = BLOCK_BYTES, texts: bool = False, group_bytes: int | None = None, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_text``), one row for each row of ``df``.

    A byte is removed if a string of ``size`` bytes that covers it also starts in
    a document with a smaller id. Strings are judged on the input; they never
    cross documents. Null text is empty. Rows that share an id are as one
    document: none removes from another. A row without an id removes nothing and
    loses nothing. ``kept_text``: what is left, bytes that are no UTF-8 any more
    as U+FFFD. ``shards``: the number of ranges, by default from the size of the text;
    ``hot``: different stretches from which a name's windows are dealt one by one.
    """
    partitions = partitions_for(df.sparkSession)
    total, longest = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.max(F.octet_length(F.col(text_col).cast("string")))).first()
    total = total or 0
    even = math.isqrt(SIZE_OF_NAME * MESSAGE * total)
    ranges = shards or max(partitions, -(-total // min(MOST_BYTES, max(RANGE_BYTES, even))))
    packed = pack_blocks(df, id_col, text_col, size, block_bytes, group_bytes or min(MOST_BYTES, max(GROUP_BYTES, even)))
    packed = packed.repartition(partitions, "group")
    marks = _answer_names(_send_names(packed, size, ranges, min(COUNTED, hot)), partitions, hot)
    answers = _answer_contents(_send_contents(packed, marks, size, ranges), size, partitions)
    done = _finish(packed, marks.unionByName(answers), size, ranges, texts)
    if (longest or 0) > block_bytes:
        return _put_together(done, partitions, texts)
    return done.drop("row", "piece", "data", "gone")
