"""Operator 5: format-preserving Feistel pseudonyms of personal data.

E-mail addresses, IPv4 and IPv6 addresses, phone, card and social security numbers, IBANs, dates (numeric, or with an English month), quoted secrets and
settings of keys and passwords are found by pattern and validated (Luhn, modulo 97, number ranges, calendar). Each valid value is ranked in the
finite set of values of its format, moved by a keyed permutation of that set, and written back in the same format, so equal values get equal
pseudonyms in all documents and the original never stays: the permutation is a Feistel network E conjugating a keyed shift, x -> E'(E(x) + s),
which has no fixed point.

Defined results: null text stays null, with no values found; text without values is returned as it is, whatever its length; a place that several
formats fit is of the first in the order of `FOUND`; repeated rows are replaced alike. Other columns stay (the counts then get a `_` if one has their
name). Ten digits in a row without any mark are left alone: most such numbers are no phone numbers.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructType

from .common import chunks, free_name, released, text_bytes

#: For tests and the driver's query; production passes its own secret.
DEMO_KEY = b"replace this key"
ROUNDS, SLICE = 8, 4 << 20
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: English names, in calendar order.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]

FOUND = re.compile(
    rf"""
    (?P<secret>(?<=")(?:[0-9a-f]{{32,64}}|[A-Za-z0-9_\-]{{24,64}})(?="))
  | (?P<setting>(?<![A-Za-z0-9])(?i:api[_\-]?key|access[_\-]?key|secret|token|password|passwd)[ ]?[=:][ ]?[A-Za-z0-9_\-]{{16,64}}(?![A-Za-z0-9_\-]))
  | (?P<email>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[\w\-]+\.)+[^\W\d_]{{2,}})
  | (?P<iban>(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?|[a-z]{{2}}[0-9]{{2}}[a-z0-9]{{11,30}})(?![A-Za-z0-9]))
  | (?P<ipv6>(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}[0-9A-Fa-f]{{0,4}}(?![0-9A-Za-z:.]))
  | (?P<ip>(?<![0-9.])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?![0-9]|\.[0-9]))
  | (?P<date>(?<![0-9./\-])(?:[0-9]{{4}}(?P<dash>[\-/])[0-9]{{2}}(?P=dash)[0-9]{{2}}|[0-9]{{1,2}}(?P<mark>[./])[0-9]{{1,2}}(?P=mark)[0-9]{{4}})(?![0-9]|[./\-][0-9]))
  | (?P<named>(?<![0-9A-Za-z])(?:[0-9]{{1,2}}[ ](?:{"|".join(MONTHS)})|(?:{"|".join(MONTHS)})[ ][0-9]{{1,2}},)[ ][0-9]{{4}}(?![0-9]))
  | (?P<ssn>(?<![0-9\-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9\-]))
  | (?P<phone>(?<![0-9])(?:\+?1[ .\-]?)?(?:\([0-9]{{3}}\)[ ]?|[0-9]{{3}}[ .\-])[0-9]{{3}}[ .\-][0-9]{{4}}(?![0-9]))
  | (?P<intl>(?<![0-9A-Za-z])\+[0-9]{{2,3}}(?:[ .\-]?[0-9]{{2,4}}){{2,5}}(?![0-9]))
  | (?P<card>(?<![0-9])[0-9](?:[ \-]?[0-9]){{12,18}}(?![0-9]))
    """,
    re.VERBOSE,
)
MAY_HOLD = re.compile(r"[0-9@\"]")


class Permutation:
    """A keyed permutation without fixed points of range(n), n > 1, for one kind of value."""

    def __init__(self, key: bytes, kind: str, n: int):
        self.n = n
        self.a = max(2, int(n**0.5) if n < 1 << 52 else 1 << (n.bit_length() // 2))
        self.b = -(-n // self.a)
        label = hashlib.blake2b(f"{kind}:{n}".encode(), digest_size=16).digest()
        self.key = hashlib.blake2b(label, key=key[:64], digest_size=32).digest()
        self.shift = 1 + self._f(ROUNDS, 0) % (n - 1)

    def _f(self, step: int, value: int) -> int:
        raw = value.to_bytes((value.bit_length() + 7) // 8 + 1, "big")
        return int.from_bytes(hashlib.blake2b(raw, key=self.key, salt=step.to_bytes(2, "big"), digest_size=64).digest(), "big")

    def _forward(self, x: int) -> int:
        while True:
            left, right = x // self.b, x % self.b
            for step in range(0, ROUNDS, 2):
                left = (left + self._f(step, right)) % self.a
                right = (right + self._f(step + 1, left)) % self.b
            x = left * self.b + right
            if x < self.n:
                return x

    def _back(self, x: int) -> int:
        while True:
            left, right = x // self.b, x % self.b
            for step in range(ROUNDS - 2, -1, -2):
                right = (right - self._f(step + 1, left)) % self.b
                left = (left - self._f(step, right)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        return self._back((self._forward(x) + self.shift) % self.n)

    def undo(self, x: int) -> int:
        return self._back((self._forward(x) - self.shift) % self.n)


def luhn_digit(body: str) -> str:
    """The check digit that makes body + digit valid."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def refilled(shape: str, values: str) -> str:
    """shape with its digits and letters replaced, in order, by values."""
    at = iter(values)
    return "".join(next(at) if c.isalnum() else c for c in shape)


class Pseudonyms:
    """Replaces the validated values of a text; one key for all documents."""

    def __init__(self, key: bytes):
        self.key = key
        self.permutation = lru_cache(maxsize=4096)(lambda kind, n: Permutation(key, kind, n))
        self.moved = lru_cache(maxsize=50_000)(self._moved)

    def _number(self, kind: str, x: int, n: int) -> int:
        return self.permutation(kind, n)(x) if n > 1 else x

    def _classes(self, kind: str, text: str) -> str:
        """ASCII letters and digits moved within their class, letters' cases kept; equal up to case stays equal."""
        sizes = [26 if c.isalpha() else 10 for c in text if c.isascii() and c.isalnum()]
        x = n = 0
        n = 1
        for c in text:
            if c.isascii() and c.isalnum():
                size = 26 if c.isalpha() else 10
                x, n = x * size + (ord(c.lower()) - 97 if c.isalpha() else int(c)), n * size
        shape = "".join("a" if c.isalpha() else "0" if c.isalnum() else c for c in text)
        x, out = self._number(f"{kind}:{shape}", x, n), []
        for size in reversed(sizes):
            x, r = divmod(x, size)
            out.append(chr(97 + r) if size == 26 else str(r))
        done = refilled(text, "".join(reversed(out)))
        return "".join(d.upper() if c.isupper() else d for c, d in zip(text, done, strict=True))

    def secret(self, s: str) -> str | None:
        if not re.search(r"[0-9]", s) or not re.search(r"[A-Za-z]", s):
            return None
        if re.fullmatch(r"[0-9a-f]+", s):
            return f"{self._number(f'hex:{len(s)}', int(s, 16), 16 ** len(s)):0{len(s)}x}"
        return self._classes("secret", s)

    def setting(self, s: str) -> str | None:
        name, value = re.fullmatch(r"([^=:]*[=:][ ]?)(.*)", s).groups()
        new = self.secret(value)
        return new and name + new

    def email(self, s: str) -> str | None:
        local, _, domain = s.partition("@")
        return f"{self._classes('email:' + domain.lower(), local)}@{domain}"

    def ip(self, s: str) -> str | None:
        octets = [int(p) for p in s.split(".")]
        if max(octets) > 255:
            return None
        x = self._number("ip", int.from_bytes(bytes(octets), "big"), 1 << 32)
        width = 3 if len(s) == 15 and any(p[0] == "0" for p in s.split(".")) else 1  # padded octets stay padded
        return ".".join(f"{o:0{width}d}" for o in x.to_bytes(4, "big"))

    def ipv6(self, s: str) -> str | None:
        try:
            address = ipaddress.IPv6Address(s)
        except ValueError:
            return None
        if not int(address) >> 16:  # unspecified, loopback: nobody's
            return None
        new = ipaddress.IPv6Address(self._number("ipv6", int(address), 1 << 128))
        text = str(new) if "::" in s or len(s) < 39 else new.exploded
        return text.upper() if s != s.lower() else text

    def date(self, s: str) -> str | None:
        parts = re.split(r"[./-]", s)
        mark = s[len(parts[0])]
        try:
            if len(parts[0]) == 4:
                order, day = "ymd", datetime.date(*map(int, parts))
            else:
                order = "dmy" if "." in s or int(parts[0]) > 12 else "mdy"
                a, b, y = map(int, parts)
                day = datetime.date(y, b, a) if order == "dmy" else datetime.date(y, a, b)
        except ValueError:
            return None
        new = self._day(day)
        if new is None:
            return None
        if order == "ymd":
            return new.isoformat().replace("-", mark)
        two = 2 if len(parts[0]) == len(parts[1]) == 2 else 1
        first, second = (new.day, new.month) if order == "dmy" else (new.month, new.day)
        return f"{first:0{two}d}{mark}{second:0{two}d}{mark}{new.year:04d}"

    def _day(self, day: datetime.date) -> datetime.date | None:
        if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return None
        return datetime.date.fromordinal(FIRST_DAY + self._number("date", day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1))

    def named(self, s: str) -> str | None:
        a, b, year = s.replace(",", "").split(" ")
        number, month = (a, b) if a.isdigit() else (b, a)
        try:
            new = self._day(datetime.date(int(year), MONTHS.index(month) + 1, int(number)))
        except ValueError:
            return None
        if new is None:
            return None
        month, number = MONTHS[new.month - 1], f"{new.day:0{2 if number[0] == '0' else 1}d}"
        return f"{number} {month} {new.year}" if a.isdigit() else f"{month} {number}, {new.year}"

    def ssn(self, s: str) -> str | None:
        area, group, serial = map(int, s.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        area -= 1 + (area > 666)
        x = self._number("ssn", (area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        area += 1
        return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, s: str) -> str | None:
        digits = re.sub(r"[^0-9]", "", s)
        lead, number = digits[:-10], digits[-10:]
        return refilled(s, lead + f"{self._number('phone', int(number), 10**10):010d}")

    def intl(self, s: str) -> str | None:
        digits = re.sub(r"[^0-9]", "", s)
        if not 8 <= len(digits) <= 15:
            return None
        head = re.match(r"\+([0-9]{2,3}?)(?=[ .\-])", s)
        lead = head[1] if head else digits[:2]
        body = digits[len(lead) :]
        return refilled(s, lead + f"{self._number(f'intl:{lead}:{len(body)}', int(body), 10 ** len(body)):0{len(body)}d}")

    def card(self, s: str) -> str | None:
        digits = re.sub(r"[^0-9]", "", s)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        n = len(digits) - 1
        body = str(self._number(f"card:{n}", int(digits[:-1]) - (low := 10 ** (n - 1)), 9 * low) + low) if digits[0] != "0" else "0" + f"{self._number(f'card0:{n}', int(digits[1:-1]), 10 ** (n - 1)):0{n - 1}d}"
        return refilled(s, body + luhn_digit(body))

    def iban(self, s: str) -> str | None:
        flat = s.replace(" ", "")
        value = lambda t: int("".join(str(int(c, 36)) for c in t))
        if not 15 <= len(flat) <= 34 or value(flat[4:] + flat[:4]) % 97 != 1:
            return None
        body = self._classes(f"iban:{flat[:2]}", flat[4:])
        return refilled(s, flat[:2] + f"{98 - value(body + flat[:2] + '00') % 97:02d}" + body)

    def _moved(self, kind: str, value: str) -> str | None:
        return getattr(self, kind)(value)

    def replace(self, text: str, counts: Counter) -> str:
        if not MAY_HOLD.search(text):
            return text

        def one(m: re.Match) -> str:
            new = self.moved(m.lastgroup, m[0])
            if new is None:
                return m[0]
            counts[m.lastgroup] += 1
            return new

        return FOUND.sub(one, text)


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with text replaced and, last, pii_kinds: a map of kind -> number of values replaced. key: the secret that all documents share."""
    if not key:
        raise ValueError("a secret key is needed")
    at = docs.columns.index("text")
    name = free_name(docs.columns, "pii_kinds")
    schema = StructType([*docs.schema.fields]).add(name, MapType(StringType(), LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        names = Pseudonyms(key)
        for batch in batches:
            for i, j in chunks(text_bytes(batch.column(at))[1], SLICE):
                part = batch.slice(i, j - i)
                texts, kinds = [], []
                for text in part.column(at).to_pylist():
                    counts: Counter = Counter()
                    texts.append(text if text is None else names.replace(text, counts))
                    kinds.append(sorted(counts.items()))
                columns = [*part.columns, pa.array(kinds, pa.map_(pa.string(), pa.int64()))]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def op5_pii(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_values, kinds (name:count, in order of name)."""
    done = pseudonymised(docs.select("doc_id", "text"), key)
    pairs = F.transform(F.map_entries("pii_kinds"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    total = F.aggregate(F.map_values("pii_kinds"), F.lit(0).cast("long"), lambda a, v: a + v)
    return done.select("doc_id", "text", total.alias("n_values"), F.array_join(pairs, ",").alias("kinds"))
