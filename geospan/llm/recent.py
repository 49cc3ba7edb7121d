"""A memory of computed values, bounded by the bytes it takes."""

from __future__ import annotations

from collections.abc import Iterable
from sys import getsizeof

#: What a dictionary spends on an entry besides its key and value, and places of the marks of keys that were asked for once.
ENTRY, MARKS = 60, 1 << 20


class Recent(dict):
    """Values of keys that are asked for again and again.

    A caller asks which keys are ``missing``, sets their values, uses the table,
    and lets it ``settle``. A key stays from the second time that it is missing:
    most different words of a corpus come once, and leave a mark only, which other
    words may share. At half of ``most_bytes`` only what is asked for from then on
    stays.
    """

    def __init__(self, most_bytes: int, longest: int = 64):
        super().__init__()
        self.half, self.longest = most_bytes // 2, longest
        self.old: dict = {}
        self.bytes = self.marked = 0
        self.marks = bytearray(MARKS)

    def missing(self, keys: Iterable) -> list:
        """The different keys that have no value."""
        out = []
        for key in set(keys):
            if key in self:
                continue
            value = self.old.get(key)
            if value is None:
                out.append(key)
            else:
                self[key] = value
                self._weigh(key, value)
        return out

    def settle(self, new: list) -> None:
        """After the values of ``new``, which were missing, have been used."""
        for key in new:
            at = hash(key) % MARKS
            if self.marks[at] and len(key) <= self.longest:
                self._weigh(key, self[key])
            else:
                del self[key]
                self.marked += not self.marks[at]
                self.marks[at] = 1
        if self.marked > MARKS // 2:
            self.marks, self.marked = bytearray(MARKS), 0
        if self.bytes > self.half:
            self.old, self.bytes = dict(self), 0
            self.clear()

    def _weigh(self, key, value) -> None:
        self.bytes += getsizeof(key) + getsizeof(value) + ENTRY
