"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted by key within their format.

A value's pseudonym depends on the key, its kind and its digits or letters only: equal values stay equal across documents, however
they are written (dates in any of the forms, North American numbers with or without +1), and whoever has the key can turn them back.
"""

from __future__ import annotations

import bisect
import calendar
import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import slices, unused

ROUNDS = 8
#: Dates are permuted among those of these years.
FIRST, LAST = date(1900, 1, 1), date(2099, 12, 31)

#: Kinds with their patterns, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[\w.%+-]*[\w%+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])(?:(?:\+?1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:\+?1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}|\+\d{1,3}(?:[ .-]\d{2,4}){2,4}|\+\d{8,15})(?!\d)",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ipv4": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/-]|\.\d)",
}
KINDS = tuple(PATTERNS)


def _combined() -> re.Pattern:
    """One pattern with a group for each kind; numbered references are moved to where their groups end up."""
    parts, at = [], 1
    for kind, pattern in PATTERNS.items():
        inner = re.compile(pattern).groups
        parts.append(f"(?P<{kind}>{re.sub(r'\\([1-9])', lambda m, at=at: f'\\{int(m[1]) + at}', pattern)})")
        at += inner + 1
    return re.compile("|".join(parts))


ANY = _combined()
ALONE = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
#: How many characters a country's IBANs have.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
HINT = re.compile(r"[0-9@]")


def permute(x: int, size: int, key: bytes, tweak: str, back: bool = False, allowed: Callable[[int], bool] = lambda _: True) -> int:
    """A keyed permutation of the allowed numbers below size: a Feistel network over two halves, walked until it is among them."""
    a = isqrt(size - 1) + 1 if size > 1 else 1
    b = -(-size // a)

    def mixed(part: int, k: int, n: int) -> int:
        raw = hashlib.blake2b(f"{tweak}:{size}:{k}:{part}".encode(), key=key, digest_size=32).digest()
        return int.from_bytes(raw, "big") % n

    while True:
        left, right = divmod(x, b)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                right = (right + sign * mixed(left, k, b)) % b
            else:
                left = (left + sign * mixed(right, k, a)) % a
        x = left * b + right
        if x < size and allowed(x):
            return x


def _radix(c: str) -> tuple[int, int]:
    """How many characters there are of the same class, and the first of them; others than ASCII letters and digits stay."""
    if "0" <= c <= "9":
        return 10, 48
    if "a" <= c <= "z":
        return 26, 97
    return (26, 65) if "A" <= c <= "Z" else (1, ord(c))


def permute_text(text: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Letters and digits permuted as one number, each within its class and place."""
    kinds = [_radix(c) for c in text]
    x = 0
    for c, (n, first) in zip(text, kinds, strict=True):
        x = x * n + ord(c) - first
    x = permute(x, prod(n for n, _ in kinds), key, tweak, back)
    out = []
    for n, first in reversed(kinds):
        x, d = divmod(x, n)
        out.append(chr(first + d))
    return "".join(reversed(out))


def refill(shape: str, digits: str) -> str:
    """The digits in the places of the shape's digits."""
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in shape)


def luhn(digits: str) -> int:
    """The sum that is a multiple of 10 for valid numbers."""
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _email(text, key, back):
    local, _, domain = text.rpartition("@")
    return f"{permute_text(local, key, 'email@' + domain.lower(), back)}@{domain}"


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(text, key, back):
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    body = permute_text(plain[4:], key, "iban" + plain[:2], back)
    new = iter(plain[:2] + f"{98 - _iban_rest(plain[:2] + '00' + body):02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


def _phone(text, key, back):
    digits = _digits(text)
    if not 8 <= len(digits) <= 15:
        return None
    country = len(digits) - 10 if len(digits) > 10 else min(2, len(digits) - 7) if text[0] == "+" else 0
    n = len(digits) - country
    code = digits[:country] or "1"  # ten digits without a country code are those of +1
    return refill(text, digits[:country] + f"{permute(int(digits[country:]), 10**n, key, 'phone' + code, back):0{n}d}")


def _card(text, key, back):
    digits = _digits(text)
    if luhn(digits) % 10 or not digits.strip("0"):
        return None
    n = len(digits) - 1
    body = f"{permute(int(digits[:-1]), 10**n, key, 'card', back, allowed=bool):0{n}d}"
    return refill(text, body + str(-luhn(body + "0") % 10))


def _ssn_is_valid(x: int) -> bool:
    return x // 10**6 not in (0, 666) and x // 10**6 < 900 and x // 10**4 % 100 > 0 and x % 10**4 > 0


def _ssn(text, key, back):
    x = int(_digits(text))
    return refill(text, f"{permute(x, 10**9, key, 'ssn', back, _ssn_is_valid):09d}") if _ssn_is_valid(x) else None


def _ipv4(text, key, back):
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    return ".".join(map(str, permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ipv4", back).to_bytes(4, "big")))


def _class(day: date) -> tuple[bool, bool, bool]:
    """What a date's written forms depend on: whether the month or the day takes one digit, and whether the day may be a month."""
    return day.month < 10, day.day < 10, day.day <= 12


@functools.cache
def _days() -> dict[tuple[bool, bool, bool], list[int]]:
    """The days from FIRST on, of each class in ascending order."""
    out: dict[tuple[bool, bool, bool], list[int]] = {}
    for x in range((LAST - FIRST).days + 1):
        out.setdefault(_class(FIRST + timedelta(days=x)), []).append(x)
    return out


def _date(text, key, back):
    """Dates are permuted among those of their class, so that every form of a day has the same pseudonym and keeps its width."""
    sign = next(c for c in text if not c.isdigit())
    fields = text.split(sign)
    if sign == "-":
        order = (0, 1, 2)
    elif sign == ".":
        order = (2, 1, 0)
    else:  # month first where it can be; what cannot is day first, and stays so
        order = (2, 0, 1) if int(fields[0]) <= 12 else (2, 1, 0)
    year, month, day = (int(fields[k]) for k in order)
    if not (FIRST.year <= year <= LAST.year and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
        return None
    old = date(year, month, day)
    alike = _days()[_class(old)]
    at = permute(bisect.bisect_left(alike, (old - FIRST).days), len(alike), key, "date", back)
    new = FIRST + timedelta(days=alike[at])
    out = [""] * 3
    for k, v in zip(order, (new.year, new.month, new.day), strict=True):
        out[k] = f"{v:0{len(fields[k])}d}"
    return sign.join(out)


CHANGES = {"email": _email, "iban": _iban, "phone": _phone, "card": _card, "ssn": _ssn, "ipv4": _ipv4, "date": _date}


def _ends(kind: str, text: str, start: int, end: int) -> list[int]:
    """Where a value that a pattern takes to run from start to end may end, in the order in which these are tried."""
    if kind == "iban":
        places = [k for k in range(start, end) if text[k] != " "]
        n = IBAN_LENGTHS.get(text[start : start + 2], 0)
        cut = places[n - 1] + 1 if 0 < n < len(places) else end
        return [cut, end] if text[cut : cut + 1] == " " and cut < end else [end]
    if kind == "phone" and text[start] == "+":
        return [end, *(k for k in range(end - 1, start, -1) if text[k] in " .-" and text[k - 1] in "0123456789")]
    return [end]


def _value(text: str, kind: str, start: int, end: int, key: bytes, back: bool, failed: list[tuple[str, int, int]]) -> tuple[str, int] | None:
    """The new value of the kind from start and where the old one ends; adds to failed what depends on its digits and is not valid."""
    ends = _ends(kind, text, start, end)
    if kind == "phone":  # a card behind it keeps its first group
        for stop in ends[1:]:
            if (n := ALONE["card"].match(text, stop + 1)) and n.end() > end and len(_digits(text[start:stop])) >= 8:
                if _card(n[0], key, back) is not None:
                    ends = [stop]
                    break
                failed.append(("card", n.start(), n.end()))
    for stop in ends:
        if (new := CHANGES[kind](text[start:stop], key, back)) is None:
            failed.append((kind, start, stop))
            continue
        others = [(k, a, b) for k, a, b in failed if a < stop and b > start]
        # what was not valid stays so with the new value in it: else the way back would take it for a value
        while any(CHANGES[k](text[a : max(a, start)] + new[max(0, a - start) : b - start] + text[stop : max(b, stop)], key, back) is not None for k, a, b in others):
            new = CHANGES[kind](new, key, back)
        return new, stop
    return None


def pseudonymised(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with all validated values permuted (back: restored), and the kind, start and end of each in the text given."""
    if not HINT.search(text):
        return text, []
    parts, found, at, place = [], [], 0, 0
    failed: list[tuple[str, int, int]] = []
    while m := ANY.search(text, place):
        start, first = m.start(), m.lastgroup or next(k for k in KINDS if m[k] is not None)
        failed = [x for x in failed if x[2] > start]
        place = start + 1
        for kind in KINDS[KINDS.index(first) :]:  # not valid: other kinds may still fit at this place
            if (n := m if kind == first else ALONE[kind].match(text, start)) and (value := _value(text, kind, start, n.end(), key, back, failed)):
                new, place = value
                parts += [text[at:start], new]
                found.append((kind, start, place))
                at = place
                break
    return "".join([*parts, text[at:]]), found


def pseudonyms(docs: DataFrame, key: bytes, text: str = "text", to: str = "values", back: bool = False) -> DataFrame:
    """docs with pseudonyms in the place of validated values in `text`, and the column `to`: kind, start and end of each value.

    Emails keep their domain, phones their country code, cards and IBANs their check digits' validity, dates stay dates of
    1900 to 2099 and keep whether month and day have one digit and whether the day is over 12, so that all forms of a day link. What fails its validation (a number by Luhn's or the IBAN's check, octets over 255, days that no month has)
    stays as it is. Null and empty texts stay, with no values; every row stays, repeated rows too; a column named `to` is
    replaced; texts of any length are read whole. Offsets count code points of the text given.

    An IBAN ends at its country's length and a phone at 15 digits, also where a word or number follows; a card right behind a phone
    stays whole. After a number that is not valid the search goes on at its next character. A value that overlaps such a number is
    permuted among those that leave it not valid, so that the way back finds the same values; where two values overlap one and the
    same such number, that holds for each with the other as it was, and the way back may rarely miss.
    """
    docs = docs.drop(to)
    names = docs.columns
    place = names.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{to}` array<struct<kind: string, start: int, end: int>>"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            done = [(None, []) if t is None else pseudonymised(t, key, back) for t in batch.column(place).to_pylist()]
            values = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in found] for _, found in done], kind)
            columns = [pa.array([t for t, _ in done], pa.string()) if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, values], names=[*names, to])

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, key: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, text with pseudonyms, and how many values of each kind it has (see pseudonyms for odd rows).

    A null id and a null text stay null; repeated rows stay repeated; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).cast("string").alias(text))
    to = unused(rows, "values")
    found = pseudonyms(rows, key, text, to)
    return found.select(id_col, text, *[F.size(_of(F.col(to), k)).cast("long").alias(f"n_{k}") for k in KINDS])


def _of(values, kind: str):
    return F.filter(values, lambda v: v["kind"] == kind)
