"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

The ranks are compiled into a finite-state transducer over bytes. A state is
the list of *live boundaries*: the positions from which a vocabulary token may
still run past the last byte read, each as the place in a trie of the tokens that
the bytes behind it lead to, and the one token that ends there in the canonical
encoding of the bytes before it. Whether a token may follow another is a property
of the two alone: no merge may cross the boundary between them before it is too
late, which the halves that the tokens were merged from tell. So the token that
ends at the next byte is found from the state and the byte. States are
determinised when first met. Tokens are emitted as soon as all live boundaries
share them: the lookahead is bounded by the longest token.

``Transducer`` reads one piece, which may arrive in parts. ``Lanes`` is the same
machine in arrays, which reads all new words of a batch side by side, a byte of
each in one step. The ids of words that come again are kept.

Decoding turns ids into bytes and bytes into text with an incremental UTF-8
machine that carries at most three bytes from one id to the next.

All tables of a worker are bounded: about 90 MB with the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from geospan.llm.common import map_lists
from geospan.llm.recent import Recent

#: A rank beyond all.
_NONE = 1 << 60
#: Determinised states and pairs of tokens that the machine for single pieces keeps.
MAX_STATES, MAX_PAIRS = 4_000, 50_000
#: States and pairs that the lanes keep, states whose steps are found by their number, and bytes of words that are read in lanes.
LANE_STATES, LANE_PAIRS, DENSE, LANE_BYTES = 200_000, 500_000, 4096, 64
#: Bytes of a worker's table of pieces, ids whose digests are taken at once, and characters that are split at once.
PIECE_BYTES, AT_ONCE, SEGMENT = 32_000_000, 65_536, 1 << 20

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Bytes to token ids; equal to merging the lowest rank first.

    The ranks must be those of merges: a token of several bytes that merges can
    make joins two tokens of lower rank last. Tokens that merges cannot make are
    never emitted but as a whole piece.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.left, self.right = self._halves()
        self._plant()
        self.pairs: dict[int, bool] = {}
        self.states: dict[tuple, tuple[dict, tuple]] = {}
        self.start = self._state(((0, -1),))

    def _plant(self) -> None:
        """The trie: the child of a node (0: the root) by a byte, the token that a node is, and whether tokens go on from it."""
        self.trie: dict[int, int] = {}
        self.token_of, self.inner = [-1], [True]
        for data, token in self.ranks.items():
            node = 0
            for byte in data:
                key = node << 8 | byte
                child = self.trie.get(key)
                if child is None:
                    self.inner[node] = True
                    child = self.trie[key] = len(self.token_of)
                    self.token_of.append(-1)
                    self.inner.append(False)
                node = child
            self.token_of[node] = token

    def _merged(self, data: bytes, below: int = _NONE) -> list[bytes]:
        """The definition, with merges of rank less than ``below``."""
        parts, get = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        ranks = [get(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while ranks:
            best = min(ranks)
            if best >= below:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], _NONE)
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], _NONE)
        return parts

    def _halves(self) -> tuple[list[int], list[int]]:
        """The two tokens whose merge makes each token: -1 for bytes, -2 where merges never make it."""
        left, right = [-1] * len(self.tokens), [-1] * len(self.tokens)
        for data, token in self.ranks.items():
            if len(data) > 1:
                parts = self._merged(data, token) if len(data) > 2 else [data[:1], data[1:]]
                left[token], right[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-2, -2)
                if max(left[token], right[token]) >= token:
                    raise ValueError(f"rank {token} is not above the ranks that it joins")
        return left, right

    def follows(self, first: int, then: int) -> bool:
        """Whether the canonical encoding of the joint bytes is these two tokens, each canonical by itself.

        Looks back in time from the finished tokens: of the parts on both sides
        of the boundary, the one that was merged later is taken apart. The
        boundary is crossed if the parts that met there make a token whose rank
        comes before the merge that took one of them away; of equal ranks the
        leftmost goes first.
        """
        left, right = self.left, self.right
        if left[then] == -2 or first < 0:
            return left[then] != -2
        get, tokens, until = self.ranks.get, self.tokens, _NONE
        while True:
            if get(tokens[first] + tokens[then], _NONE) < until:
                return False
            if right[first] >= 0 and (first > then or left[then] < 0):
                until, first = first, right[first]
            elif left[then] >= 0:
                until, then = then + 1, left[then]
            else:
                return True

    def _known(self, first: int, then: int) -> bool:
        key = first * len(self.tokens) + then
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.follows(first, then)
        return known

    def _state(self, live: tuple) -> tuple[dict, tuple]:
        """live: node and token before of each boundary, the first one first."""
        state = self.states.get(live)
        if state is None:
            state = ({}, live)
            if len(self.states) < MAX_STATES:
                self.states[live] = state
        return state

    def _step(self, state: tuple[dict, tuple], byte: int) -> tuple[tuple, int, int]:
        """The next state, the token that ends with this byte, and its length."""
        known = state[0].get(byte)
        if known is not None:
            return known
        token, still = -1, []
        for node, before in state[1]:
            child = self.trie.get(node << 8 | byte)
            if child is None:
                continue
            if token < 0 <= self.token_of[child] and self._known(before, self.token_of[child]):
                token = self.token_of[child]
            if self.inner[child]:
                still.append((child, before))
        if token < 0:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        still.append((0, token))
        following = self._state(tuple(still))
        known = (following, token, len(self.tokens[token]))
        if following[1] in self.states:  # the table is bounded: what comes after it is full is found anew each time
            state[0][byte] = known
        return known

    def encode_stream(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that arrives in parts, each as soon as it is certain."""
        state, ends = self.start, []  # of the bytes not yet covered by emitted tokens: the token that ends there, and its length
        read = since = 0
        places: list[int] = [0]  # of the live boundaries
        for part in pieces:
            for byte in part:
                live = [at for at, (node, _) in zip(places, state[1], strict=True) if self.inner[self.trie.get(node << 8 | byte, 0)] and (node << 8 | byte) in self.trie]
                state, token, size = self._step(state, byte)
                read += 1
                places = [*live, read]
                ends.append((token, size))
                if len(ends) >= 4 * self.longest and (settled := self._settled(ends, [at - since for at in places])):
                    yield from self._back(ends, settled)
                    del ends[:settled]
                    since += settled
        yield from self._back(ends, len(ends))

    @staticmethod
    def _back(ends: list[tuple[int, int]], to: int) -> list[int]:
        out = []
        while to > 0:
            token, size = ends[to - 1]
            out.append(token)
            to -= size
        return out[::-1]

    @staticmethod
    def _settled(ends: list[tuple[int, int]], live: list[int]) -> int:
        """The last boundary that the encodings up to all live boundaries share."""
        ats = set(live)
        while len(ats) > 1:
            last = max(ats)
            ats.discard(last)
            ats.add(last - ends[last - 1][1])
        return max(ats.pop(), 0)

    def encode(self, piece: bytes) -> list[int]:
        token = self.ranks.get(piece)
        return [token] if token is not None else list(self.encode_stream((piece,)))


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.room, self.n = np.empty(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            room = np.empty(2 * (self.n + len(more)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in a sorted table, and which of them are there."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


class Lanes:
    """The machine over many words at once, a byte of each word in a step; states and steps are numbers in arrays."""

    def __init__(self, machine: Transducer):
        self.machine, self.kinds = machine, len(machine.tokens)
        keys = np.fromiter(machine.trie.keys(), np.int64, len(machine.trie))
        order = np.argsort(keys)
        self.trie_key, self.trie_child = keys[order], np.fromiter(machine.trie.values(), np.int32, len(keys))[order]
        self.token_of, self.inner = np.array(machine.token_of, np.int32), np.array(machine.inner)
        self.sizes = np.array([len(t) for t in machine.tokens], np.int64)
        self.made = np.array(machine.left) != -2
        self.pair_key, self.pair_good = np.empty(0, np.int64), np.empty(0, bool)
        self._forget()

    def _forget(self) -> None:
        self.first, self.count, self.node, self.before = _Grown(np.int64), _Grown(np.int32), _Grown(np.int32), _Grown(np.int32)
        self.hash, self.hash_state = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.step_key, self.step_next, self.step_token = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.dense_next, self.dense_token = np.full(DENSE << 8, -1, np.int32), np.empty(DENSE << 8, np.int32)
        self._start_batch()
        self._states(np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64), np.full(1, -1))

    def _start_batch(self) -> None:
        self.new_hashes: dict[int, int] = {}
        self.new_steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.new_pairs: dict[int, bool] = {}

    def _end_batch(self) -> None:
        """What was found in this batch goes into the sorted tables."""
        if self.new_hashes:
            hashes, states = np.fromiter(self.new_hashes.keys(), np.uint64, len(self.new_hashes)), np.fromiter(self.new_hashes.values(), np.int64, len(self.new_hashes))
            order = np.argsort(np.concatenate((self.hash, hashes)), kind="stable")
            self.hash, self.hash_state = np.concatenate((self.hash, hashes))[order], np.concatenate((self.hash_state, states))[order]
        if self.new_steps:
            key, following, token = (np.concatenate((old, *(s[i] for s in self.new_steps))) for i, old in enumerate((self.step_key, self.step_next, self.step_token)))
            self.step_key, at = np.unique(key, return_index=True)
            self.step_next, self.step_token = following[at], token[at]
        if self.new_pairs:
            if len(self.pair_key) > LANE_PAIRS:
                self.pair_key, self.pair_good = np.empty(0, np.int64), np.empty(0, bool)
            key = np.concatenate((self.pair_key, np.fromiter(self.new_pairs.keys(), np.int64, len(self.new_pairs))))
            good = np.concatenate((self.pair_good, np.fromiter(self.new_pairs.values(), bool, len(self.new_pairs))))
            order = np.argsort(key, kind="stable")
            self.pair_key, self.pair_good = key[order], good[order]
        self._start_batch()
        if self.first.n > LANE_STATES:
            self._forget()

    def _follow(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        key = before.astype(np.int64) * self.kinds + token
        at, known = _find(self.pair_key, key)
        good = self.pair_good[at] if len(self.pair_key) else np.zeros(len(key), bool)
        free = before < 0
        good[free] = self.made[token[free]]
        left = ~known & ~free
        if left.any():
            todo, back = np.unique(key[left], return_inverse=True)
            pairs, follows = self.new_pairs, self.machine.follows
            for k in todo.tolist():
                if k not in pairs:
                    pairs[k] = follows(*divmod(k, self.kinds))
            good[left] = np.fromiter(map(pairs.__getitem__, todo.tolist()), bool, len(todo))[back]
        return good

    def _states(self, starts: np.ndarray, counts: np.ndarray, node: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The numbers of states that are given as runs of live boundaries; new ones are kept."""
        place = np.arange(len(node)) - np.repeat(starts, counts)
        h = (node.astype(np.uint64) + np.uint64(1)) * _A ^ (before.astype(np.int64) + 2).astype(np.uint64) * _B
        h = (h ^ (h >> np.uint64(29))) * (_C + place.astype(np.uint64) * np.uint64(2))
        h = np.add.reduceat(h ^ (h >> np.uint64(32)), starts) * _A
        h ^= h >> np.uint64(31)
        at, known = _find(self.hash, h)
        out = self.hash_state[at] if len(self.hash) else np.empty(len(h), np.int64)
        left = np.flatnonzero(~known)
        mine, new = self.new_hashes, []
        for i, value in zip(left.tolist(), h[left].tolist(), strict=True):
            number = mine.get(value)
            if number is None:
                number = mine[value] = self.first.n + len(new)
                new.append(i)
            out[i] = number
        if new:
            new = np.array(new)
            n = counts[new]
            take = np.repeat(starts[new] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self.first.add(self.node.n + np.cumsum(n) - n)
            self.count.add(n)
            self.node.add(node[take])
            self.before.add(before[take])
        return out

    def _determinise(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state and token of steps (state and byte) that are not known yet."""
        state, byte = keys >> 8, keys & 255
        n = self.count.room[state].astype(np.int64)
        of = np.repeat(np.arange(len(keys)), n)
        at = np.repeat(self.first.room[state] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        before = self.before.room[at]
        where, there = _find(self.trie_key, self.node.room[at].astype(np.int64) << 8 | byte[of])
        of, before, child = of[there], before[there], self.trie_child[where[there]]
        token = self.token_of[child]
        good = token >= 0
        good[good] = self._follow(before[good], token[good])
        owner, first = np.unique(of[good], return_index=True)
        if len(owner) < len(keys):
            raise ValueError("the vocabulary has no token for a byte")
        token = token[good][first]
        keep = self.inner[child]
        of, child, before = of[keep], child[keep], before[keep]
        counts = np.bincount(of, minlength=len(keys)) + 1
        starts = np.cumsum(counts) - counts
        node, last = np.zeros(len(of) + len(keys), np.int32), np.empty(len(of) + len(keys), np.int32)
        node[np.arange(len(of)) + of] = child
        last[np.arange(len(of)) + of] = before
        last[starts + counts - 1] = token
        return self._states(starts, counts, node, last), token

    def _go(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state and token of each step."""
        near = key < DENSE << 8
        at = np.where(near, key, 0)
        following, token = self.dense_next[at], self.dense_token[at]
        far = np.flatnonzero(~near)
        if len(far) and len(self.step_key):
            at, known = _find(self.step_key, key[far])
            following[far], token[far] = np.where(known, self.step_next[at], -1), self.step_token[at]
        elif len(far):
            following[far] = -1
        left = np.flatnonzero(following < 0)
        if len(left):
            todo, back = np.unique(key[left], return_inverse=True)
            new, made = self._determinise(todo)
            following[left], token[left] = new[back], made[back]
            dense = todo < DENSE << 8
            self.dense_next[todo[dense]], self.dense_token[todo[dense]] = new[dense], made[dense]
            self.new_steps.append((todo[~dense], new[~dense].astype(np.int32), made[~dense]))
        return following, token

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (none empty), one word after the other, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        begin = (np.cumsum(size) - size)[order]
        data, size = np.frombuffer(b"".join(words), np.uint8), size[order]
        state, tokens = np.zeros(len(words), np.int64), []
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i))  # the words that are longer
            following, token = self._go(state[:n] << 8 | data[begin[:n] + i])
            state[:n] = following
            tokens.append(token)
        self._end_batch()
        flat = np.concatenate(tokens) if tokens else np.empty(0, np.int32)
        base = np.cumsum([0, *map(len, tokens)])
        rounds, active, to = [], np.arange(len(words)), size.copy()
        while len(active):
            token = flat[base[to[active] - 1] + active]
            rounds.append((active, token))
            to[active] -= self.sizes[token]
            active = active[to[active] > 0]
        count = np.zeros(len(words), np.int64)
        for active, _ in rounds:
            count[active] += 1
        in_order = np.empty(len(words), np.int64)
        in_order[order] = count
        start = (np.cumsum(in_order) - in_order)[order]
        ids = np.empty(int(count.sum()), np.int32)
        for back, (active, token) in enumerate(rounds):
            ids[start[active] + count[active] - 1 - back] = token
        return ids, in_order


class Utf8Machine:
    """Incremental UTF-8 decoding: bytes in, whole characters out, wrong bytes as U+FFFD."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data, self.held = self.held + data, b""
        if not last:
            cut = self._cut(data)
            data, self.held = data[:cut], data[cut:]
        return data.decode("utf-8", "replace")

    @staticmethod
    def _cut(data: bytes) -> int:
        """Where a character begins that is not complete yet; the length if there is none."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF8 else 1
                return len(data) - back if need > back else len(data)
        return len(data)


class Codec:
    """Texts to ids and back, for one rank file and split pattern. The ids of pieces that come again are kept, as bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine, self.split = Transducer(ranks), regex.compile(pattern).findall
        self.lanes = Lanes(self.machine)
        self.kind = np.dtype("H" if len(self.machine.tokens) <= 1 << 16 else "I")
        self.pieces = Recent(PIECE_BYTES)
        self.decimal = list(map(str, range(len(self.machine.tokens))))

    def _learn(self, pieces: list[str]) -> list[str]:
        """Put the ids of all pieces into the table; returns the pieces that were not there."""
        new = self.pieces.missing(pieces)
        words, short = [], []
        for piece in new:
            data = piece.encode("utf-8")
            token = self.machine.ranks.get(data)
            if token is not None:
                self.pieces[piece] = array(self.kind.char, (token,)).tobytes()
            elif len(data) > LANE_BYTES:
                self.pieces[piece] = array(self.kind.char, self.machine.encode(data)).tobytes()
            else:
                words.append(data)
                short.append(piece)
        ids, count = self.lanes.encode(words)
        raw, end = ids.astype(self.kind).tobytes(), (np.cumsum(count) * self.kind.itemsize).tolist()
        for piece, a, b in zip(short, [0, *end], end, strict=False):
            self.pieces[piece] = raw[a:b]
        return new

    @staticmethod
    def _segments(text: str) -> Iterator[str]:
        """Parts of a long text; a single space between two characters that are no white space always starts a new match of the pattern."""
        at = 0
        while len(text) - at > SEGMENT:
            cut = text.find(" ", at + SEGMENT)
            while 0 < cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.find(" ", cut + 1)
            if cut < 0 or cut >= len(text) - 1:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encode_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; the new words of a few texts are read side by side."""
        at = 0
        while at < len(texts):
            if len(texts[at]) > SEGMENT:
                yield np.concatenate([ids for part in self._segments(texts[at]) for ids in self._encoded([part])])
                at += 1
                continue
            end, size = at, 0
            while end < len(texts) and size + len(texts[end]) <= SEGMENT:
                size += len(texts[end])
                end += 1
            yield from self._encoded(texts[at:end])
            at = end

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        split = list(map(self.split, texts))
        new = self._learn(list(chain.from_iterable(split)))
        out = [np.frombuffer(b"".join(map(self.pieces.__getitem__, pieces)), self.kind) for pieces in split]
        self.pieces.settle(new)
        return out

    def encode(self, text: str) -> list[int]:
        return next(self.encode_texts([text])).tolist()

    def encode_both(self, text: str) -> tuple[list[int], str]:
        """The ids, and the same in decimal, joined by a space."""
        ids = self.encode(text)
        return ids, " ".join(map(self.decimal.__getitem__, ids))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.machine.tokens.__getitem__, ids))

    def decode(self, ids: list[int], at_once: int = 4096) -> Iterator[str]:
        machine = Utf8Machine()
        for at in range(0, len(ids), at_once):
            yield machine.feed(self.decode_bytes(ids[at : at + at_once]))
        yield machine.feed(b"", last=True)

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """Of the ids in decimal joined by a space, and of the text that they decode to, as UTF-8; in parts, so that neither is held whole."""
        said, decoded, machine = hashlib.sha256(), hashlib.sha256(), Utf8Machine()
        for at in range(0, len(ids), AT_ONCE):
            part = ids[at : at + AT_ONCE].tolist()
            said.update((" " * (at > 0) + " ".join(map(self.decimal.__getitem__, part))).encode())
            decoded.update(machine.feed(self.decode_bytes(part), last=at + AT_ONCE >= len(ids)).encode("utf-8"))
        return said.hexdigest(), decoded.hexdigest()


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec; a worker serves many tasks and reads the ranks once."""
    if (path, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def _each(df: DataFrame, path: str | None, pattern: str | None, id_col: str, text_col: str, row, ddl: str) -> DataFrame:
    """``row(codec, id, ids)`` for every whole text, one narrow stage: nothing is shuffled."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def make():
        own = codec(path, pattern)
        return lambda keys, texts: (row(own, key, ids) for key, ids in zip(keys, own.encode_texts(texts), strict=True))

    return map_lists(df, make, ddl, id_col, text_col)


def encode_documents(df: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every whole text, one row for each row of ``df``, without special tokens.

    Null text counts as empty and gives no ids; a null id is kept; repeated rows
    stay repeated. The rank file must be readable at ``path`` on each executor.
    """
    return _each(df, path, pattern, id_col, text_col, lambda own, key, ids: (key, ids.tolist()), "doc_id long, ids array<int>")


def encode_and_check(df: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every whole text; the digest is of what the ids decode to, as UTF-8.

    Nulls, empty texts and repeated rows as in ``encode_documents``: no ids, and the digest of nothing, for null or empty text.
    """

    def row(own: Codec, key, ids: np.ndarray):
        return key, len(ids), ids.tolist(), own.digests(ids)[1]

    return _each(df, path, pattern, id_col, text_col, row, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def encode_digest(df: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids again, and return counts and digests.

    ``doc_id, n_tokens, ids_sha256`` (of the decimal ids joined by a space) and
    ``decoded_sha256`` (of the decoded bytes); nulls and repeats as in
    ``encode_documents``.
    """

    def row(own: Codec, key, ids: np.ndarray):
        return key, len(ids), *own.digests(ids)

    return _each(df, path, pattern, id_col, text_col, row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
