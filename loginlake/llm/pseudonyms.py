"""Format-preserving pseudonyms of personal numbers and dates by keyed Feistel networks.

Values are found by format and validated (check digits, number plans, calendar, octets). What is
not fixed by the format is permuted by a Feistel network whose round function is a keyed hash, so
pseudonyms are values of the same format, different values stay different, and equal values get
equal pseudonyms in all documents without any table. Where the format has invalid values, the
permutation is repeated until it meets a valid one, which keeps it a permutation of valid values.

Kinds: card (check digit and first digit kept right), phone (ten digits of the North American
plan), ssn, ip (four octets), date (a day from 1900 to 2099 in the same notation) and the local
part of an email (letters to letters, digits to digits; signs and domain stay). Separators and
letter case stay. Spans are code points of the original, the end exclusive.

Null texts stay null and empty ones empty, without spans. Repeated values and rows get equal
pseudonyms. Long texts are passed whole. Only the text is read; output columns replace columns of
the same name.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterable
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_batches, read_table, strings

ROUNDS = 10
#: Key of the registered query; a production run passes its own secret.
EXAMPLE_KEY = b"example key of the registered query"
#: Formats of personal data.
NUMBERS = re.compile(
    r"""(?<![\w.+-])(?:
      (?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})
    | (?P<date>\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})
    | (?P<ssn>\d{3}-\d{2}-\d{4})
    | (?P<phone>(?:\+?1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4})
    | (?P<card>\d(?:[ -]?\d){12,18})
    )(?!\w|[.-]\d)""",
    re.X | re.A,
)
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
LOCAL_LENGTH = 64
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


class Feistel:
    """A keyed permutation of the numbers below left * right, for each purpose its own."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, purpose: str, number: int, value: int, size: int) -> int:
        digest = hmac.digest(self.key, f"{purpose}:{number}:{value}".encode(), hashlib.sha256)
        return int.from_bytes(digest[:16], "big") % size

    def permute(self, value: int, left: int, right: int, purpose: str) -> int:
        a, b = divmod(value, right)
        for number in range(ROUNDS):
            if number % 2:
                b = (b + self._round(purpose, number, a, right)) % right
            else:
                a = (a + self._round(purpose, number, b, left)) % left
        return a * right + b

    def valid(self, value: int, left: int, right: int, purpose: str, accepted: Callable[[int], bool]) -> int:
        while True:
            value = self.permute(value, left, right, purpose)
            if accepted(value):
                return value


def luhn_digit(digits: str) -> int:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 else d * 2 - 9 * (d > 4)
    return -total % 10


def phone_ok(value: int) -> bool:
    s = f"{value:010d}"
    return s[0] in "23456789" and s[3] in "23456789"


def ssn_ok(value: int) -> bool:
    s = f"{value:09d}"
    return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"


def _filled(pattern: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in pattern)


def _card(found: str, feistel: Feistel) -> str | None:
    digits = re.sub(r"\D", "", found)
    if luhn_digit(digits[:-1]) != int(digits[-1]) or digits[0] == "0":
        return None
    n = len(digits) - 2
    left, right = 10 ** (n // 2), 10 ** (n - n // 2)
    new = digits[0] + f"{feistel.permute(int(digits[1:-1]), left, right, f'card{n}'):0{n}d}"
    return _filled(found, new + str(luhn_digit(new)))


def _phone(found: str, feistel: Feistel) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not phone_ok(int(digits[-10:])):
        return None
    new = feistel.valid(int(digits[-10:]), 10**5, 10**5, "phone", phone_ok)
    return _filled(found, digits[:-10] + f"{new:010d}")


def _ssn(found: str, feistel: Feistel) -> str | None:
    value = int(found.replace("-", ""))
    return _filled(found, f"{feistel.valid(value, 10**4, 10**5, 'ssn', ssn_ok):09d}") if ssn_ok(value) else None


def _ip(found: str, feistel: Feistel) -> str | None:
    octets = [int(x) for x in found.split(".")]
    if max(octets) > 255 or any(x != "0" and x[0] == "0" for x in found.split(".")):
        return None
    new = feistel.permute(int.from_bytes(octets, "big"), 1 << 16, 1 << 16, "ip")
    return ".".join(map(str, new.to_bytes(4, "big")))


def _date(found: str, feistel: Feistel) -> str | None:
    parts = re.split(r"([-/.])", found)
    mark = parts[1]
    numbers = [int(x) for x in parts[::2]]
    order = {"-": (0, 1, 2), "/": (2, 0, 1), ".": (2, 1, 0)}[mark]  # ISO, month first, day first
    try:
        day = (date(*(numbers[k] for k in order)) - FIRST_DAY).days
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    new = FIRST_DAY + timedelta(feistel.valid(day, 271, 271, "date", lambda x: x < DAYS))
    values = (new.year, new.month, new.day)
    widths = [len(x) if x[0] == "0" or len(x) == 4 else 0 for x in parts[::2]]
    placed = [values[order.index(k)] for k in range(3)]
    return mark.join(f"{v:0{max(w, 2 if mark == '-' else 0)}d}" for v, w in zip(placed, widths, strict=True))


def _email(local: str, feistel: Feistel) -> str:
    out = list(local)
    for name, size, first in (("letters", 26, "a"), ("digits", 10, "0")):
        at = [i for i, c in enumerate(local) if (c.isalpha() if size == 26 else c.isdigit())]
        if not at:
            continue
        value = 0
        for i in at:
            value = value * size + ord(local[i].lower()) - ord(first)
        n = len(at)
        value = feistel.permute(value, size ** (n // 2), size ** (n - n // 2), f"email {name} {n}")
        for i in reversed(at):
            value, rest = divmod(value, size)
            letter = chr(ord(first) + rest)
            out[i] = letter.upper() if local[i].isupper() else letter
    return "".join(out)


VALIDATED = {"ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonyms(text: str, feistel: Feistel) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) in order, without overlaps."""
    out, at = [], text.find("@")
    while at >= 0:
        local, domain = LOCAL.search(text[max(0, at - LOCAL_LENGTH) : at]), DOMAIN.match(text, at + 1)
        if local and domain:
            out.append((at - len(local[0]), domain.end(), "email", _email(local[0], feistel) + text[at : domain.end()]))
        at = text.find("@", at + 1)
    emails, at = list(out), 0
    while found := NUMBERS.search(text, at):
        kind = found.lastgroup
        new = VALIDATED[kind](found[0], feistel)
        inside = any(a < found.end() and found.start() < b for a, b, _, _ in emails)
        if new is None or inside:
            at = found.start() + 1
            continue
        out.append((found.start(), found.end(), kind, new))
        at = found.end()
    return sorted(out)


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with replaced texts and the column private: the spans, kinds and pseudonyms."""
    kept = [c for c in docs.columns if c not in (text, "private")]
    private = StructType.fromDDL("private array<struct<start:bigint,end:bigint,kind:string,pseudonym:string>>")

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        feistel = Feistel(key)

        def apply(batch):
            texts, spans = [], []
            for body in strings(batch, text):
                found = pseudonyms(body, feistel) if body else []
                parts, at = [], 0
                for start, end, _, new in found:
                    parts += [body[at:start], new]
                    at = end
                texts.append("".join([*parts, body[at:]]) if found else body)
                spans.append([{"start": a, "end": b, "kind": k, "pseudonym": p} for a, b, k, p in found])
            yield {c: batch.column(c) for c in kept} | {text: texts, "private": spans}

        return apply

    schema = docs.select(*kept).schema.add(text, "string").add(private["private"])
    return map_batches(docs.select(*kept, text), make, schema)


def op3_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """One row for each value found; documents without any have none."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudonymise(docs, EXAMPLE_KEY)
    return found.select("doc_id", F.explode("private").alias("found")).select("doc_id", "found.*")
