"""Format-preserving pseudonyms for personal data.

A validated value is ranked among all values of its format, the rank is permuted by a keyed Feistel network over
exactly that many numbers, and the result is written in the same format, with the separators as they were. The
permutation depends on the key and the kind of value alone, so equal values stay linked across documents
and whoever holds the key can invert it.
"""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

ROUNDS = 8
KINDS = ("email", "ip", "iban", "date", "phone", "ssn", "card", "secret")

_FINDS = re.compile(
    r"""(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
    |(?P<secret>(?<![0-9A-Za-z])(?=[a-f]*[0-9])[0-9a-f]{24,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?=[A-F]*[0-9])[0-9A-F]{24,}(?![0-9A-Za-z]))
    |(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))
    |(?P<date>(?<!\w)(?:\d{4}-\d\d-\d\d(?=[Tt]\d\d)|(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d{1,2}[/.]\d{1,2}[/.]\d{4})(?!\w)))
    |(?P<iban>(?<!\w)[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
    |(?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))
    |(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\w))
    |(?P<card>(?<!\w)\d(?:[ -]?\d){12,18}(?!\w))""",
    re.X | re.A,
)
# Lengths of IBANs by country (others are found by their check alone), and the country calling codes of one and of two digits.
_IBAN_LENGTH = dict(AT=20, BE=16, CH=21, CZ=24, DE=22, DK=18, ES=24, FI=18, FR=27, GB=22, GR=27, HU=28, IE=22, IT=27, LU=20, NL=18, NO=15, PL=28, PT=25, SE=24)
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_MAYBE = re.compile(r"[0-9]{2}|@")


class Cipher:
    """Keyed permutations of {0, ..., size - 1} for any size."""

    def __init__(self, key: str):
        self.key = key.encode()[:64]

    def _round(self, kind: str, size: int, step: int, half: int) -> int:
        return int.from_bytes(blake2b(f"{kind}|{size}|{step}|{half}".encode(), key=self.key, digest_size=24).digest(), "big")

    def _once(self, kind: str, size: int, value: int, back: bool) -> int:
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        left, right = divmod(value, b)
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if step % 2:
                right = (right + sign * self._round(kind, size, step, left)) % b
            else:
                left = (left + sign * self._round(kind, size, step, right)) % a
        return left * b + right

    def permute(self, kind: str, size: int, value: int, good: Callable[[int], bool] = lambda v: True, back: bool = False) -> int:
        """Walks on until the number is in range and good, which keeps this a permutation of the good numbers."""
        if size < 2:
            return value
        while True:
            value = self._once(kind, size, value, back)
            if value < size and good(value):
                return value


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _check_digit(body: str) -> str:
    return next(str(c) for c in range(10) if luhn(body + str(c)))


def _refill(shape: str, new: str, kind: Callable[[str], bool]) -> str:
    """shape with its characters of the kind replaced in order."""
    it = iter(new)
    return "".join(next(it) if kind(c) else c for c in shape)


def _mixed(cipher: Cipher, kind: str, text: str, back: bool) -> str:
    """Permute the letters and digits of a text, each staying a letter (of its case) or a digit."""
    radix = [10 if c.isdigit() else 26 for c in text if c.isalnum()]
    low = [c for c in text.lower() if c.isalnum()]
    value = size = 0 if not radix else 1
    value = 0
    for c, r in zip(low, radix):
        value = value * r + (int(c) if r == 10 else ord(c) - 97)
        size *= r
    if size < 2:
        return text
    value, out = cipher.permute(f"{kind}:{','.join(map(str, radix))}", size, value, back=back), []
    for r in reversed(radix):
        value, d = divmod(value, r)
        out.append(str(d) if r == 10 else chr(97 + d))
    new = _refill(text, "".join(reversed(out)), str.isalnum)
    return "".join(n.upper() if o.isupper() else n for n, o in zip(new, text))


def _digits(cipher: Cipher, kind: str, text: str, skip: int = 0, good: Callable[[str], bool] = lambda s: True, back: bool = False) -> str:
    digits = [c for c in text if c.isdigit()]
    body = "".join(digits[skip:])
    write = lambda v: str(v).zfill(len(body))
    new = write(cipher.permute(f"{kind}:{len(body)}", 10 ** len(body), int(body), lambda v: good(write(v)), back))
    return _refill(text, "".join(digits[:skip]) + new, str.isdigit)


def _ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _day(text: str) -> tuple[dt.date, str] | None:
    """The date, and how it is written: year first, month first (with strokes, where that is a date) or day first."""
    parts = list(map(int, re.split(r"[-/.]", text)))
    for order in ("ymd",) if len(re.split(r"[-/.]", text)[0]) == 4 else ("mdy", "dmy") if "/" in text else ("dmy",):
        at = dict(zip(order, parts))
        try:
            return dt.date(at["y"], at["m"], at["d"]), order
        except ValueError:
            continue
    return None


def _date(cipher: Cipher, text: str, back: bool) -> str | None:
    if (found := _day(text)) is None:
        return None
    day, order = found
    first, last = (dt.date(1900, 1, 1), dt.date(2099, 12, 31)) if 1900 <= day.year <= 2099 else (dt.date(1, 1, 1), dt.date(9999, 12, 31))
    start, size = first.toordinal(), last.toordinal() - first.toordinal() + 1
    ranges = (lambda v: True) if size < 100_000 else (lambda v: not 1900 <= dt.date.fromordinal(v + start).year <= 2099)
    read_as = lambda v: _day(_written(dt.date.fromordinal(v + start), order, text))
    # a date keeps the digits of its month and of its day, so that one written without zeros keeps its length in every format
    digits = lambda d: (d.month > 9, d.day > 9)
    good = lambda v: ranges(v) and digits(dt.date.fromordinal(v + start)) == digits(day) and read_as(v) == (dt.date.fromordinal(v + start), order)
    # equal dates meet whatever their format: only day-first dates with strokes need numbers of their own
    kind = "date" if order != "dmy" or "." in text else "date:dmy"
    return _written(dt.date.fromordinal(cipher.permute(kind, size, day.toordinal() - start, good, back) + start), order, text)


def _written(day: dt.date, order: str, shape: str) -> str:
    parts, gaps = re.split(r"[-/.]", shape), re.findall(r"[-/.]", shape)
    value = {"y": day.year, "m": day.month, "d": day.day}
    new = [str(value[c]).zfill(len(p)) for c, p in zip(order, parts)]
    return new[0] + gaps[0] + new[1] + gaps[1] + new[2]


def pseudonym(cipher: Cipher, kind: str, text: str, back: bool = False) -> str | None:
    """The value's pseudonym, or (back) the value of a pseudonym; None if the text is no valid value of the kind."""
    if kind == "email":
        local, _, domain = text.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_mixed(cipher, 'local', local, back)}@{_mixed(cipher, 'host', host, back)}.{top}"
    if kind == "secret":
        low = text.lower()
        value = cipher.permute(f"hex:{len(text)}", 16 ** len(text), int(low, 16), back=back)
        new = format(value, "x").zfill(len(text))
        return new.upper() if text.isupper() else new
    if kind == "ip":
        parts = list(map(int, text.split(".")))
        if max(parts) > 255:
            return None
        value = cipher.permute("ip", 1 << 32, int.from_bytes(bytes(parts), "big"), back=back)
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "date":
        return _date(cipher, text, back)
    if kind == "iban":
        flat = text.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if number(flat[4:] + flat[:4]) % 97 != 1:
            return None
        body = _mixed(cipher, "iban" + flat[:2], flat[4:], back)
        check = 98 - number(body + flat[:2] + "00") % 97
        return _refill(text, f"{flat[:2]}{check:02d}{body}", str.isalnum)
    if kind == "ssn":
        return _digits(cipher, kind, text, good=_ssn, back=back) if _ssn(text.replace("-", "")) else None
    if kind == "phone":
        n = sum(map(str.isdigit, text))
        head = re.sub(r"\D", "", text)[:3]
        country = next((k for k in (1, 2) if head[:k] in _CODES), 3) if text[0] == "+" else 0
        return _digits(cipher, kind, text, skip=min(country, n - 4), back=back)
    digits = re.sub(r"\D", "", text)
    if not luhn(digits) or digits.strip("0") == "":
        return None
    body = _digits(cipher, "card", digits[:-1], back=back)
    return _refill(text, body + _check_digit(body), str.isdigit)


def _readings(found: re.Match, inside: bool) -> list[str]:
    """What the match may be, best first: all of it, or for cards and IBANs a shorter beginning that ends with a group.

    inside: it begins in a match that failed.
    """
    kind, text = found.lastgroup, found[0]
    if kind not in ("card", "iban"):
        return [text]
    ends = [m.start() for m in re.finditer(r"[ -]", text)]
    if kind == "iban":
        whole = [text, *(text[:e] for e in reversed(ends) if e - text[:e].count(" ") >= 15)]
        return sorted(whole, key=lambda t: len(t.replace(" ", "")) != _IBAN_LENGTH.get(t[:2]))
    # a list of small numbers is no card: a part of a match counts only in groups of three digits or more
    grouped = lambda t: sum(map(str.isdigit, t)) >= 13 and min(map(len, re.split(r"[ -]", t))) >= 3
    return [t for t in (text, *(text[:e] for e in reversed(ends))) if grouped(t) or t == text and not inside]


def hide(cipher: Cipher, text: str) -> tuple[str, Counter]:
    """The text with every valid value replaced, and how many of each kind.

    A match that fails its check in every reading hides no other: the search goes on behind its first character.
    """
    counts: Counter = Counter()
    if not _MAYBE.search(text):
        return text, counts
    out, done, at, failed = [], 0, 0, 0
    while found := _FINDS.search(text, at):
        at = found.start() + 1
        for value in _readings(found, found.start() < failed):
            if (new := pseudonym(cipher, found.lastgroup, value)) is not None:
                out += [text[done : found.start()], new]
                at = done = found.start() + len(value)
                counts[found.lastgroup] += 1
                break
        else:
            failed = max(failed, found.end())
    return "".join([*out, text[done:]]), counts


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_values, and n_<kind> for each kind) for each row of docs, whole texts.

    Values that fail their check (Luhn, mod 97, calendar, byte range, reserved numbers) stay as they are. A
    null text comes back empty with counts of 0. Row by row: repeated rows come back repeated, an empty table gives no
    rows, other columns are not looked at.
    """
    fields = ["text string", *(f"n_{k} int" for k in KINDS)]

    @F.pandas_udf("struct<" + ", ".join(f.replace(" ", ":") for f in fields) + ">")
    def swapped(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cipher = Cipher(key)
        for batch in texts:
            got = [hide(cipher, t) for t in batch]
            yield pd.DataFrame({"text": [t for t, _ in got], **{f"n_{k}": [c[k] for _, c in got] for k in KINDS}})

    out = docs.select("doc_id", swapped(text_of()).alias("s")).select("doc_id", "s.*")
    return out.withColumn("n_values", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)))
