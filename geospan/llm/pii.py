"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from geospan.llm.common import Taken, map_texts, sha256_hex

# Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "national", "number")
BASE = 4
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: Score before context, by kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.95, "national": 0.4, "number": 0.3}
#: Words near a span that raise its score.
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address", "addr"), "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "account", "bank"), "national": ("ssn", "social", "security"), "number": ("phone", "tel", "telephone", "call", "mobile", "fax"),
}
#: What a context word adds, how far it may stand off in characters, and the least score of a span that the method adds.
RAISE, NEAR, LEAST = 0.4, 48, 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
# Characters of an international account number, by country, of the public registry; others have 15 to 34.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_ACCOUNT = re.compile(r"(?:\x20?[A-Z0-9]){15,34}")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NUMBER = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])")
_WORD = re.compile(r"[A-Za-z]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of an international account number: its letters as 10 to 35, the first four characters last."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: the local part runs back as far as its characters go, so that each character is looked at a few times at most."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's size that stand alone, in groups or not; where the size is not known the longest that the check confirms."""
    free = 0
    for head in _IBAN.finditer(text):
        run = _ACCOUNT.match(text, head.start()) if head.start() >= free else None
        if not run:
            continue
        ends = [at + 1 for at in range(run.start(), run.end()) if text[at] != " "]  # after each character
        sizes = [IBAN_SIZES[head[1]]] if head[1] in IBAN_SIZES else range(34, 14, -1)
        for size in sizes:
            end = ends[size - 1] if size <= len(ends) else len(text) + 1
            if end <= len(text) and not text[end : end + 1].isalnum() and mod97(text[run.start() : end].replace(" ", "")):
                yield run.start(), end
                free = end
                break


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that their checks confirm."""
    for start, end in _emails(text):
        yield "email", start, end
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in _accounts(text):
        yield "iban", start, end
    for kind, pattern in (("national", _NATIONAL), ("number", _NUMBER)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, raised if a context word of the kind stands near."""
    near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR // 2]
    known = CONTEXT[kind]
    return min(1.0, PRIOR[kind] + RAISE * any(word.lower() in known for word in _WORD.findall(near)))


def find(text: str) -> list[tuple[int, str, int, float]]:
    """``(start, kind, end, score)`` in order: all base spans, and added ones that score enough and overlap no base span."""
    found, proposed = [], list(_proposed(text))
    base = Taken((start, end) for kind, start, end in proposed if KINDS.index(kind) < BASE)
    for kind, start, end in proposed:
        value = score(text, kind, start, end)
        if KINDS.index(kind) >= BASE and (value < LEAST or base.meets(start, end)):
            continue
        found.append((start, KINDS.index(kind), end, value))
    return [(start, KINDS[k], end, value) for start, k, end, value in sorted(found)]


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``doc_id, kind, start, end, score, value`` per span, in code points; repeated rows repeat, null text has none."""
    return map_texts(df, lambda: lambda key, text: [(key, kind, s, e, v, text[s:e]) for s, kind, e, v in find(text)], "doc_id long, kind string, start long, end long, score double, value string", id_col, text_col)


def pii_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of the base kinds, the digest of the base spans, all spans, their scores and number.

    Null or empty text counts 0 and has the digest of the empty string; a null
    id is kept; repeated rows stay repeated. One narrow stage.
    """

    def one(key, text):
        spans = find(text)
        said = [f"{kind}:{s}:{e}" for s, kind, e, _ in spans]
        kinds = [kind for _, kind, _, _ in spans]
        yield key, *(kinds.count(k) for k in KINDS[:BASE]), sha256_hex(",".join(x for x, k in zip(said, kinds, strict=True) if k in KINDS[:BASE])), ",".join(said), ",".join(f"{v:.2f}" for *_, v in spans), len(spans)

    return map_texts(df, lambda: one, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, n_spans long", id_col, text_col)
