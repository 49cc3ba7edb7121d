"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Each line is described by a few ratios; the field is fitted by gradient ascent
on a bounded sample of labelled documents. Lines of good documents are content,
those of bad ones boilerplate, and so that the field sees one turn into the
other, lines of a bad document are also put between those of a good one. Viterbi
decoding finds the best labels of all lines of a document together. A document
stays if it passes the fixed rules and enough of its words are in content lines.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geospan.llm.common import lean, map_texts

# The symbols and the white space of the base rules.
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
#: Least words, and most percent of words in repeated windows, of the base rules.
MIN_WORDS, MAX_REPEAT = 50, 50
#: Labelled documents of each label that the field is fitted on, and runs of lines, evenly spaced over the whole document, that are read of each.
SAMPLE, RUNS, RUN_LINES = 300, 4, 16
#: Least share of words in content lines.
CONTENT_SHARE = 0.5

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_MARKS = SYMBOLS.encode()
_SHOUT = b"!"
FEATURES = ("bias", "symbols_per_word", "upper_share", "exclamations_per_word", "digit_share", "short", "stop_at_end", "repeated_line")


def describe(line: bytes, n_words: int, seen: bool) -> tuple[float, ...]:
    """Features of a line with words, each between 0 and 1."""
    size = len(line)
    letters = size - len(line.translate(None, _LOWER))
    upper = size - len(line.translate(None, _UPPER))
    return (
        1.0,
        min(1.0, (size - len(line.translate(None, _MARKS))) / n_words),
        upper / max(1, upper + letters),
        min(1.0, line.count(_SHOUT) / n_words),
        (size - len(line.translate(None, _DIGITS))) / size,
        1.0 if n_words < 4 else 0.0,
        1.0 if line.rstrip()[-1:] in (b".", b"!", b"?") else 0.0,
        1.0 if seen else 0.0,
    )


def lines_of(data: bytes) -> tuple[list[tuple[float, ...]], list[int], int]:
    """Features and words of each line with words, and how many such lines equal an earlier one."""
    features, words, seen, repeats = [], [], set(), 0
    for line in data.split(b"\n"):
        n = len(line.split())
        if n:
            again = line in seen
            repeats += again
            seen.add(line)
            features.append(describe(line, n, again))
            words.append(n)
    return features, words, repeats


class Field:
    """Two labels, content (0) and boilerplate (1): emission weights by feature, transition and start weights."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.emit, self.move, self.start = emit, move, start

    def viterbi(self, features: list[tuple[float, ...]]) -> list[int]:
        """The best labels; ties go to content."""
        scores = (np.array(features) @ self.emit.T).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = scores[0][0] + float(self.start[0]), scores[0][1] + float(self.start[1])
        back = []
        for s0, s1 in scores[1:]:
            from_a = a + m00 >= b + m10
            to_b = a + m01 >= b + m11
            back.append((0 if from_a else 1, 0 if to_b else 1))
            a, b = (a + m00 if from_a else b + m10) + s0, (a + m01 if to_b else b + m11) + s1
        label = 0 if a >= b else 1
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]

    @classmethod
    def prior(cls) -> Field:
        """Where no labelled rows are at hand: marks, capitals and exclamations speak against content."""
        emit = np.zeros((2, len(FEATURES)))
        emit[1] = [-3.0, 5.0, 4.0, 4.0, 2.0, 0.0, 0.0, 0.0]
        return cls(emit, np.array([[0.5, -0.5], [-0.5, 0.5]]), np.zeros(2))

    @classmethod
    def fit(cls, documents: list[tuple[list[tuple[float, ...]], list[int]]], rounds: int = 120, rate: float = 0.1, penalty: float = 0.02) -> Field:
        """Maximum penalised likelihood; documents: features and labels of their lines.

        The batch is padded to the longest document; forward and backward sums
        run over all documents at once. Documents of content only, of boilerplate
        only, and of both weigh the same together.
        """
        documents = [(f, y) for f, y in documents if f]
        if len({label for _, y in documents for label in y}) < 2:
            return cls.prior()
        n, longest, d = len(documents), max(len(f) for f, _ in documents), len(FEATURES)
        x, there, gold = np.zeros((n, longest, d)), np.zeros((n, longest)), np.zeros((n, longest, 2))
        for i, (f, y) in enumerate(documents):
            x[i, : len(f)], there[i, : len(f)] = f, 1
            gold[i, np.arange(len(y)), y] = 1
        sizes = there.sum(1).astype(int)
        kind = np.where(gold[:, :, 1].sum(1) == 0, 0, np.where(gold[:, :, 0].sum(1) == 0, 1, 2))
        weight = 1 / np.bincount(kind, minlength=3).clip(1)[kind] / len(np.unique(kind)) / sizes
        theta = [cls.prior().emit, cls.prior().move, np.zeros(2)]
        moments = [(np.zeros_like(t), np.zeros_like(t)) for t in theta]
        rows = np.arange(n)
        for step in range(1, rounds + 1):
            emit, move, start = theta
            e = x @ emit.T
            forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
            forward[:, 0] = e[:, 0] + start
            for t in range(1, longest):
                forward[:, t] = np.logaddexp(forward[:, t - 1, :1] + move[0], forward[:, t - 1, 1:] + move[1]) + e[:, t]
            for t in range(longest - 2, -1, -1):
                onward = backward[:, t + 1] + e[:, t + 1]
                value = np.logaddexp(move[:, 0] + onward[:, :1], move[:, 1] + onward[:, 1:])
                backward[:, t] = np.where((t + 1 < sizes)[:, None], value, 0.0)
            last = forward[rows, sizes - 1]
            z = np.logaddexp(last[:, 0], last[:, 1])
            node = np.exp(forward + backward - z[:, None, None]) * there[:, :, None]
            grad_emit = np.einsum("i,itk,itd->kd", weight, gold - node, x)
            grad_start = (weight[:, None] * (gold[:, 0] - node[:, 0])).sum(0)
            grad_move = np.zeros((2, 2))
            for t in range(1, longest):
                pair = np.exp(forward[:, t - 1, :, None] + move[None] + (e[:, t] + backward[:, t])[:, None, :] - z[:, None, None]) * (there[:, t] * weight)[:, None, None]
                seen = gold[:, t - 1, :, None] * gold[:, t, None, :] * weight[:, None, None]
                grad_move += (seen - pair).sum(0)
            for k, (t, g) in enumerate(zip(theta, (grad_emit, grad_move, grad_start), strict=True)):
                g = g - penalty * (t - (cls.prior().emit if k == 0 else 0)) / 10
                m, v = moments[k]
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                moments[k] = (m, v)
                theta[k] = t + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(*theta)


def evenly(lines: list, runs: int = RUNS, size: int = RUN_LINES) -> list:
    """Runs of consecutive lines, evenly spaced from the first line to the last; all lines if they are no more than that."""
    if len(lines) <= runs * size:
        return lines
    starts = [round(k * (len(lines) - size) / (runs - 1)) for k in range(runs)]
    return [line for a in starts for line in lines[a : a + size]]


def with_turns(good: list[list], bad: list[list]) -> list[tuple[list, list[int]]]:
    """Line labels for documents of content, of boilerplate, and of content with boilerplate behind its first half."""
    out = [(lines, [0] * len(lines)) for lines in good] + [(lines, [1] * len(lines)) for lines in bad]
    for k in range(max(len(good), len(bad)) if good and bad else 0):
        g, b = good[k % len(good)], bad[k % len(bad)]
        half = (len(g) + 1) // 2
        out.append((g[:half] + b + g[half:], [0] * half + [1] * len(b) + [0] * (len(g) - half)))
    return out


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on at most ``sample`` documents of each quality label, the ones whose ids hash lowest.

    The driver receives the features of at most ``RUNS`` times ``RUN_LINES`` lines
    of each, from all over the document. Documents without text, id or label are
    left out; of two labels of a document the larger counts; rows that repeat an
    id count each, up to four times the sample. With one label only, or none, the
    prior is returned.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(picked), "_id")  # at most 2 * sample rows

    def one(key, text, y):
        yield key, y, [v for line in evenly(lines_of(text.encode("utf-8", "surrogatepass"))[0]) for v in line]

    got = map_texts(rows, lambda: one, "doc_id long, y int, flat array<double>", "_id", "_text", ["_y"]).orderBy("doc_id", F.hash("flat")).limit(4 * sample).collect()
    d, lines = len(FEATURES), {0: [], 1: []}
    for r in got:
        if r.flat:
            lines[r.y].append([tuple(r.flat[i : i + d]) for i in range(0, len(r.flat), d)])
    return Field.fit(with_turns(lines[1], lines[0]))


def n_repeated(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    inside, until = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            inside += at + 3 - max(at, until)
            until = at + 3
    return inside


def judge(text: str, field: Field) -> tuple[int, int, int, int, int, bool, bool, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    features, sizes, repeats = lines_of(data)
    n_repeat = n_repeated(words)
    failed = len(words) < MIN_WORDS or 100 * n_repeat > MAX_REPEAT * len(words)
    share = sum(n for n, y in zip(sizes, field.viterbi(features), strict=True) if y == 0) / len(words) if words else 0.0
    return len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)), repeats, n_repeat, failed, not failed and share >= CONTENT_SHARE, share


def quality(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with the base counts, ``content_share`` and ``kept``.

    Null or empty text has no words, fails the base rules and is not kept; a
    null id is kept as it is; repeated rows stay repeated. One narrow stage.
    """
    return map_texts(df, lambda: lambda key, text: [(key, *judge(text, field))], "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double", id_col, text_col)


def keep_good(df: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns; rows with null or empty text go, repeated rows are kept or go together."""
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            yield batch.filter(pa.array([judge(texts[i].as_py() or "", field)[6] for i in range(batch.num_rows)], pa.bool_()))

    return df.mapInArrow(lean(run), df.schema)
