"""Secrets: probabilistic automata of credential formats, inferred from labelled examples.

The labelled credentials of a format, whole with their prefixes, go into a
prefix tree with counts. A character that most examples of a node share is an
edge of its own; the rest share one edge, on which the classes of characters are
counted, so that a tree over random bodies does not thin out. States with enough
examples are merged, in breadth-first order, if the frequencies
of their ends, edges and classes agree by Hoeffding's bound, and those of their
successors do: a format of fixed length keeps its length, one without a length
becomes a loop. A candidate's score is its log likelihood under the best
automaton, less that under a model of ordinary text, whose pairs of characters
are counted over all documents; candidates above a threshold are secrets.
Candidates also start and end within a run of their characters: behind and
before the characters that join names and values, and wherever a format's
literal prefix is.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geospan.llm.common import Taken, arrow_schema, lean, lower_ascii, map_texts, sha256_hex

# Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "token")
_ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_CUES = ("pass", "secret", "token", "key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Least characters of a candidate, runs of a candidate's characters, and the characters before or behind which one may start or end within a run.
SHORTEST = 16
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_JOINTS = frozenset("+/=_-")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"

#: Labelled credentials of each format that the automata are fitted on (a bounded sample), confidence of the state merging, and the least score of a secret.
EXAMPLES, ALPHA, LEAST = 1000, 0.05, 2.0
#: Chance below which it is no accident that one state never shows what the other one does.
NEVER = 1e-4
#: Least examples of two states that may be merged, and least examples and share of a node's for a character to be an edge of its own.
EVIDENCE, OWN, OWN_SHARE = 30, 8, 0.3
#: Weight of the even distribution in the model of ordinary text, in counts and as a share of a character's count.
FLOOR, FLOOR_SHARE = 20.0, 0.1


def labelled(n: int = EXAMPLES, seed: int = 7) -> dict[str, list[str]]:
    """Examples of published credential formats; the labels are the format names. Web tokens and keys have no fixed length."""
    rng = random.Random(seed)
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = upper + lower + digit

    def some(letters: str, size: int) -> str:
        return "".join(rng.choice(letters) for _ in range(size))

    def more(mean: int) -> int:
        return int(rng.expovariate(1 / mean))

    formats: dict[str, Callable[[], str]] = {
        "cloud_access": lambda: "AKIA" + some(upper + digit, 16),
        "cloud_session": lambda: "ASIA" + some(upper + digit, 16),
        "code_host": lambda: "ghp_" + some(mixed, 36),
        "code_host_lab": lambda: "glpat-" + some(mixed + "_-", 20),
        "chat_bot": lambda: "xoxb-" + some(digit, 12) + "-" + some(digit, 12) + "-" + some(mixed, 24),
        "maps": lambda: "AIza" + some(mixed + "_-", 35),
        "payment": lambda: "sk_live_" + some(mixed, 24),
        "web_token": lambda: "eyJ" + some(mixed + "_-", 17 + more(60)),
        "digest": lambda: some(digit + "abcdef", rng.choice((32, 40, 64))),
        "base64_key": lambda: some(mixed + "+/", 40 + more(60)),
    }
    return {name: [make() for _ in range(n)] for name, make in formats.items()}


def examples_of(table: DataFrame, most: int = EXAMPLES) -> dict[str, list[str]]:
    """Labelled credentials from a table ``format, credential``: of each format the ``most`` whose digests come first.

    Rows with a null, and repeated rows, are left out; formats must be few.
    """
    rows = table.select(F.col("format").cast("string").alias("f"), F.col("credential").cast("string").alias("c")).where("f IS NOT NULL AND c IS NOT NULL AND c <> ''").distinct()
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("f").orderBy(F.sha2("c", 256)))).where(F.col("n") <= most)
    out: dict[str, list[str]] = defaultdict(list)
    for r in rows.orderBy("f", "n").collect():  # at most ``most`` a format
        out[r.f].append(r.c)
    return dict(out)


def character_class(char: str) -> str:
    """Letters and digits by kind; a hexadecimal letter apart; other characters are themselves."""
    return "d" if "0" <= char <= "9" else "h" if "a" <= char <= "f" else "l" if "g" <= char <= "z" else "U" if "A" <= char <= "Z" else char


#: Characters of each class, of those that candidates have.
_MEMBERS: dict[str, str] = {}
for _char in LETTERS:
    _MEMBERS[character_class(_char)] = _MEMBERS.get(character_class(_char), "") + _char
#: The edge that all characters without one of their own share.
_REST = ""


class Automaton:
    """A probabilistic automaton, inferred by merging compatible states of a prefix tree."""

    def __init__(self, examples: Iterable[str], alpha: float = ALPHA, classes: Callable[[str], str] | None = None):
        self.classes, self.members = (classes, {}) if classes else (character_class, _MEMBERS)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._grow(list(examples))
        self._merge()
        self._weigh()

    def _grow(self, examples: list[str]) -> None:
        """The prefix tree: of each node the examples that pass, that end, that take each edge, and the classes on the shared edge."""
        self.total: list[int] = []
        self.ends: list[int] = []
        self.counts: list[Counter] = []
        self.kinds: list[Counter] = []
        self.to: list[dict[str, int]] = []
        todo = [(self._node(examples, 0), examples, 0)]
        while todo:
            node, texts, at = todo.pop()
            going = [x for x in texts if len(x) > at]
            chars = Counter(x[at] for x in going)
            own = {c for c, n in chars.items() if n >= max(OWN, OWN_SHARE * len(texts))}
            parts: dict[str, list[str]] = defaultdict(list)
            for x in going:
                parts[x[at] if x[at] in own else _REST].append(x)
            self.kinds[node].update(self.classes(x[at]) for x in parts.get(_REST, ()))
            for symbol, part in sorted(parts.items()):
                self.counts[node][symbol] = len(part)
                self.to[node][symbol] = child = self._node(part, at + 1)
                todo.append((child, part, at + 1))

    def _node(self, examples: list[str], at: int) -> int:
        self.total.append(len(examples))
        self.ends.append(sum(len(x) == at for x in examples))
        self.counts.append(Counter())
        self.kinds.append(Counter())
        self.to.append({})
        return len(self.to) - 1

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        """Hoeffding's bound on two frequencies; what one state never shows must be likely not to be seen at the other's rate."""
        if not n or not m or a == b == 0:
            return False
        if (a == 0 and n >= EVIDENCE and b >= OWN and (1 - b / m) ** n < NEVER) or (b == 0 and m >= EVIDENCE and a >= OWN and (1 - a / n) ** m < NEVER):
            return True
        return abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        """Whether two states have examples enough, and their frequencies and those of their successors agree."""
        if min(self.total[p], self.total[q]) < EVIDENCE:
            return False
        todo, seen = [(p, q)], set()
        while todo:
            p, q = todo.pop()
            if (p, q) in seen or p == q:
                continue
            seen.add((p, q))
            n, m = self.total[p], self.total[q]
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for mine, other in ((self.counts[p], self.counts[q]), (self.kinds[p], self.kinds[q])):
                if any(self._differ(mine[s], n, other[s], m) for s in mine.keys() | other.keys()):
                    return False
            todo += [(self.to[p][s], self.to[q][s]) for s in self.to[p].keys() & self.to[q].keys()]
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree under q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.total[p] += self.total[q]
            self.ends[p] += self.ends[q]
            self.counts[p] += self.counts[q]
            self.kinds[p] += self.kinds[q]
            for symbol, child in self.to[q].items():
                if symbol in self.to[p]:
                    todo.append((self.to[p][symbol], child))
                else:
                    self.to[p][symbol] = child

    def _merge(self) -> None:
        kept, fringe = [0], [(0, s) for s in sorted(self.to[0])]
        while fringe:
            parent, symbol = fringe.pop(0)
            q = self.to[parent][symbol]
            if q in kept:
                continue
            p = next((p for p in kept if self._compatible(p, q)), None)
            if p is None:
                kept.append(q)
            else:
                self.to[parent][symbol] = p
                self._fold(p, q)
            fringe = [(r, s) for r in kept for s in sorted(self.to[r]) if self.to[r][s] not in kept]
        self.states = kept

    def _weigh(self) -> None:
        """Log probabilities: of each character from each state, and of the end. What no example shows is impossible."""
        self.steps: dict[int, dict[str, tuple[int, float]]] = {}
        self.stop: dict[int, float] = {}
        for q in self.states:
            total, steps = self.total[q], {}
            for kind, n in self.kinds[q].items():
                chars = self.members.get(kind, kind)
                for char in chars:
                    steps[char] = (self.to[q][_REST], math.log(n / total / len(chars)))
            steps |= {s: (self.to[q][s], math.log(n / total)) for s, n in self.counts[q].items() if s != _REST}
            self.steps[q] = steps
            self.stop[q] = math.log(self.ends[q] / total) if self.ends[q] else -math.inf

    def prefix(self) -> str:
        """The characters that all examples begin with."""
        state, out = 0, ""
        while len(self.counts[state]) == 1 and not self.ends[state] and len(out) < SHORTEST:
            (symbol,) = self.counts[state]
            if symbol == _REST:
                break
            state, out = self.to[state][symbol], out + symbol
        return out

    def log_likelihood(self, text: str) -> float:
        state, total = 0, 0.0
        for char in text:
            step = self.steps[state].get(char)
            if step is None:
                return -math.inf
            state = step[0]
            total += step[1]
        return total + self.stop[state]


class Background:
    """Ordinary text: the probability of a candidate's character after the one before it, or (place 0) at the start of a run."""

    def __init__(self, logs: np.ndarray):
        self.logs = [row.tolist() for row in logs]

    @classmethod
    def of(cls, counts: np.ndarray) -> Background:
        """``counts[b, c]``: how often c follows b; smoothed towards what classes of characters make likely."""
        n = counts.sum(1, keepdims=True)
        floor = FLOOR + FLOOR_SHARE * n
        return cls(np.log((counts + floor * np.exp(cls.prior_logs())) / (n + floor)))

    @staticmethod
    def prior_logs() -> np.ndarray:
        """Lower-case runs are likely, changes of class are not."""
        kind = lambda c: "l" if character_class(c) in "hl" else character_class(c)
        out = np.empty((len(LETTERS) + 1, len(LETTERS) + 1))
        for i, before in enumerate("^" + LETTERS):
            weights = []
            for char in LETTERS:
                new, old = kind(char), kind(before)
                if old == "^":
                    weights.append({"l": 0.6, "d": 0.1, "U": 0.3}.get(new, 0.02) / len(_SAME[new]))
                elif new == old:
                    weights.append({"l": 0.9, "d": 0.6, "U": 0.6}.get(new, 0.3) / len(_SAME[new]))
                else:
                    weights.append({"l": 0.05 if old == "d" else 0.25, "d": 0.02, "U": 0.02}.get(new, 0.02) / len(_SAME[new]))
            out[i, 1:] = np.log(np.array(weights) / sum(weights))
        out[:, 0] = -30.0
        return out

    @classmethod
    def prior(cls) -> Background:
        """Where no documents are at hand."""
        return cls(cls.prior_logs())

    def of_run(self, text: str) -> list[float]:
        """Log probability of each character of a run; the first as the start."""
        places = [_PLACE[c] for c in text]
        return [self.logs[b][c] for b, c in zip([0, *places], places)]  # noqa: B905


_SAME: dict[str, str] = {}
for _char in LETTERS:
    _kind = "l" if character_class(_char) in "hl" else character_class(_char)
    _SAME[_kind] = _SAME.get(_kind, "") + _char
_PLACE = {c: i + 1 for i, c in enumerate(LETTERS)}
_PLACES = np.zeros(256, np.uint16)
for _char, _at in _PLACE.items():
    _PLACES[ord(_char)] = _at


def background(df: DataFrame, text_col: str = "text") -> Background:
    """Pairs of characters counted over the whole texts of all rows; an empty table gives the prior.

    Counted on the bytes of the Arrow batches; the driver receives one number for
    each pair of the few characters that candidates have.
    """
    size = len(LETTERS) + 1
    schema = arrow_schema("pair int, n long")

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary())
            _, offsets, data = texts.buffers()
            if data is None:
                continue
            ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            for a in range(int(ends[0]), int(ends[-1]), 1 << 20):
                b = min(a + (1 << 20), int(ends[-1]))
                before = max(a - 1, int(ends[0]))
                place = _PLACES[np.frombuffer(data, np.uint8)[before:b]]
                first = place.copy()
                first[ends[(ends >= before + 1) & (ends <= b)] - before - 1] = 0  # the last byte of a text comes before no other
                total += np.bincount(first[:-1] * np.uint16(size) + place[1:], minlength=size * size)
                if before == a and b > a:
                    total[place[0]] += 1
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], schema=schema)

    rows = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(lean(run), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((size, size))
    for r in rows:
        counts[divmod(r.pair, size)] = r.n
    counts[:, 0] = 0
    return Background.of(counts) if counts.any() else Background.prior()


class Scorer:
    """Automata of all formats against a model of ordinary text; each with the literal prefix of its examples."""

    def __init__(self, examples: dict[str, list[str]], alpha: float = ALPHA, ordinary: Background | None = None):
        self.ordinary = ordinary or Background.prior()
        self.formats: dict[str, tuple[str, Automaton]] = {}
        for name, texts in sorted(examples.items()):
            automaton = Automaton(texts, alpha)
            self.formats[name] = (automaton.prefix(), automaton)

    def against(self, ordinary: Background) -> Scorer:
        """The same formats against another model of ordinary text."""
        out = Scorer({})
        out.formats, out.ordinary = self.formats, ordinary
        return out

    def score(self, text: str) -> tuple[float, str]:
        """The best format's log-likelihood ratio, and the format."""
        best, name = max((automaton.log_likelihood(text), name) for name, (_, automaton) in self.formats.items())
        return (best - sum(self.ordinary.of_run(text)) if best > -math.inf else best), name

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """``(start, end, score)`` of the credentials in the run ``text``.

        From the left, each format takes the first start from which it scores
        enough and the furthest end at which it does; what overlaps is one span
        with the best score. What can still be scored from a state at a place is
        kept for the starts that come to it later, so long runs cost linear time.
        """
        n = len(text)
        plain = self.ordinary.of_run(text)
        ends = [c in _JOINTS for c in text] + [True]
        begins = [0, *(i + 1 for i in range(n) if ends[i])]
        found: list[tuple[int, int]] = []
        for prefix, automaton in self.formats.values():
            known: dict[tuple[int, int], float] = {}
            done = 0
            for s in (m.start() for m in re.finditer(f"(?={re.escape(prefix)})", text)) if prefix else begins:
                if s < done or s + SHORTEST > n:
                    continue
                far = _furthest(automaton, s, text, plain, self.ordinary.of_run(text[s])[0], ends, known)
                if far:
                    found.append((s, far))
                    done = far
        out: list[tuple[int, int, float]] = []
        for s, e in sorted(found):
            value = self.score(text[s:e])[0]
            if value < LEAST - 1e-6:  # the sums are the same but for their order
                continue
            if out and s < out[-1][1]:
                out[-1] = (out[-1][0], max(e, out[-1][1]), max(value, out[-1][2]))
            else:
                out.append((s, e, value))
        return out


def _furthest(automaton: Automaton, s: int, text: str, plain: list[float], first: float, ends: list[bool], known: dict[tuple[int, int], float]) -> int:
    """The furthest end at which a candidate from ``s`` scores ``LEAST``; 0 if there is none. ``first``: the log probability of its first character as a start."""
    n, at, state = len(text), s, 0
    value = plain[s] - first
    while at < s + SHORTEST:
        step = automaton.steps[state].get(text[at])
        if step is None:
            return 0
        value += step[1] - plain[at]
        state, at = step[0], at + 1

    # The best that can be added from each place and state on the way, from its end backwards.
    way, i, q = [], at, state
    while (i, q) not in known:
        step = automaton.steps[q].get(text[i]) if i < n else None
        if step is None:
            known[i, q] = automaton.stop[q] if ends[i] else -math.inf
            break
        way.append((i, q, step[1] - plain[i]))
        i, q = i + 1, step[0]
    best = known[i, q]
    for i, q, gain in reversed(way):
        best = max(best + gain, automaton.stop[q]) if ends[i] else best + gain
        known[i, q] = best

    far = 0
    while value + known[at, state] >= LEAST:
        if ends[at] and value + automaton.stop[state] >= LEAST:
            far = at
        step = automaton.steps[state].get(text[at]) if at < n else None
        if step is None:
            break
        value += step[1] - plain[at]
        state, at = step[0], at + 1
    return far


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed rules."""
    found = []
    low = lower_ascii(text) if not text.islower() else text
    if any(cue in low for cue in _CUES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


def _gaps(taken: Taken, start: int, end: int) -> Iterable[tuple[int, int]]:
    """The parts of a run, long enough for a candidate, that no taken span meets."""
    at = bisect_right(taken.ends, start)
    while start < end:
        stop = min(end, taken.starts[at]) if at < len(taken.starts) else end
        if stop - start >= SHORTEST:
            yield start, stop
        start = taken.ends[at] if at < len(taken.starts) else end
        at += 1


def find(text: str, scorer: Scorer) -> list[tuple[int, str, int, float]]:
    """``(start, kind, end, score)`` in order: base spans, and candidates between them that look like a credential."""
    found = base_spans(text)
    out = []
    for s, k, e in found:
        value = _CANDIDATE.search(text, s, e)  # an assignment's value, without its name
        out.append((s, k, e, scorer.score(value[0] if value else text[s:e])[0]))
    taken = Taken((start, end) for start, _, end in found)
    for m in _CANDIDATE.finditer(text):
        for a, b in _gaps(taken, *m.span()):
            out += [(a + s, 3, a + e, value) for s, e, value in scorer.spans(text[a:b])]
    return [(s, KINDS[k], e, value) for s, k, e, value in sorted(out)]


def fitted(df: DataFrame, examples: dict[str, list[str]] | DataFrame | None = None, text_col: str = "text") -> Scorer:
    """Automata of the labelled credentials (by format, or a table ``format, credential``; by default ``labelled()``), against the ordinary text of ``df``."""
    given = labelled() if examples is None else examples_of(examples) if isinstance(examples, DataFrame) else examples
    return Scorer(given, ordinary=background(df, text_col))


def find_secrets(df: DataFrame, examples: dict[str, list[str]] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``doc_id, kind, start, end, score`` per span, in code points; null text has none, repeated rows repeat.

    ``examples``: labelled credentials by format, or a table of them; by default those of ``labelled()``.
    """
    scorer = fitted(df, examples, text_col)

    def make():
        return lambda key, text: [(key, kind, s, e, v if math.isfinite(v) else -99.0) for s, kind, e, v in find(text, scorer)]

    return map_texts(df, make, "doc_id long, kind string, start long, end long, score double", id_col, text_col)


def redact(df: DataFrame, mark: str = "[secret]", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``df`` with every secret in ``text`` replaced by ``mark``; spans that touch or overlap become one mark.

    All other columns and all rows stay, repeated rows too. Null and empty text
    stay as they are. ``chars_col``, if the table has it, is counted anew.
    """
    schema, scorer = df.schema, fitted(df, None, text_col)
    names = df.columns

    def run(batches):
        at = names.index(text_col)
        for batch in batches:
            texts = batch.column(at)
            out = []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if text:
                    parts, done = [], 0
                    for s, _, e, _ in find(text, scorer):
                        if s >= done:
                            parts += [text[done:s], mark]
                        done = max(done, e)
                    text = "".join([*parts, text[done:]]) if parts else text
                out.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    new = df.mapInArrow(lean(run), schema)
    return new.withColumn(chars_col, F.length(text_col).cast(schema[chars_col].dataType)) if chars_col and chars_col in names else new


def secrets_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of the base kinds, the digest of the base spans, and all spans.

    Null or empty text counts 0 and has the digest of the empty string; a null
    id is kept; repeated rows stay repeated. Two narrow stages: the pairs of
    characters of ordinary text are counted first.
    """
    scorer = fitted(df, None, text_col)

    def make():
        def one(key, text):
            spans = find(text, scorer)
            base = [x for x in spans if x[1] != "token"]
            kinds = [x[1] for x in base]
            yield key, *(kinds.count(k) for k in KINDS[:3]), sha256_hex(",".join(f"{k}:{s}:{e}" for s, k, e, _ in base)), ",".join(f"{k}:{s}:{e}" for s, k, e, _ in spans), len(spans)

        return one

    return map_texts(df, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long", id_col, text_col)
