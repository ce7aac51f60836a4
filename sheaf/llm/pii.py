"""Personal data as format-preserving pseudonyms.

Validated numbers, dates, addresses and credentials are replaced by others of the same format: the value is read as an
integer within its format's domain and permuted there by a keyed balanced Feistel network (cycle-walking back into the
domain and until the value is valid again, checksums included). A permutation links equal values across documents,
never maps two values to one, and is undone by whoever has the key. Everything around a value stays as it is.

Kinds: email (the local part's letters and digits), card (Luhn), iban (mod 97), phone (international and North
American), ipv4, date (a real day from 1900 to 2099, kept in its notation), key (access keys and values given to
password, token, secret or api_key).

Texts without a digit or an at sign are passed over at once. Null and empty texts stay as they are and hold nothing.
Overlapping candidates go to the leftmost, then to the kind named first. An invalid candidate is tried again without its
last groups (an IBAN first at its country's length), then the search goes on behind its first character. Pseudonyms leave
refused forms around them invalid, so that ``undo`` finds the same values; a value within such a form (a card before a
short number, say) may for that have another pseudonym than it has alone. Repeated rows give repeated results.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheaf.llm import textkit as tk
from sheaf.llm.exact_dedup import unused

FEISTEL_ROUNDS = 10


class Permutation:
    """A keyed permutation of 0 .. size - 1."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.half = max(1, (max(2, size) - 1).bit_length() + 1 >> 1)
        self.mask = (1 << self.half) - 1
        self.keys = [hashlib.blake2b(f"{tweak}|{size}|{r}".encode(), key=key, digest_size=32).digest() for r in range(FEISTEL_ROUNDS)]

    def _round(self, r: int, x: int) -> int:
        data = x.to_bytes(self.half // 8 + 1, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.keys[r], digest_size=min(64, self.half // 8 + 9)).digest(), "big") & self.mask

    def _once(self, x: int, order) -> int:
        a, b = x >> self.half, x & self.mask
        for r in order:
            a, b = b, a ^ self._round(r, b)
        return b << self.half | a

    def forward(self, x: int) -> int:
        while True:
            x = self._once(x, range(FEISTEL_ROUNDS))
            if x < self.size:
                return x

    def backward(self, x: int) -> int:
        while True:
            x = self._once(x, reversed(range(FEISTEL_ROUNDS)))
            if x < self.size:
                return x


# Character classes that are permuted within themselves.
CLASSES = (string.digits, string.ascii_lowercase, string.ascii_uppercase)
HEX = "0123456789abcdef"


def alphabets(text: str) -> list[str | None]:
    """The class of each character; lower-case hexadecimal strings are one class; others than ASCII alphanumerics stay."""
    if len(text) >= 8 and set(text) <= set(HEX) and re.search("[a-f]", text):
        return [HEX] * len(text)
    return [next((c for c in CLASSES if x in c), None) for x in text]


def to_number(text: str, kinds: list[str | None]) -> tuple[int, int]:
    """A mixed-radix number and the size of its domain."""
    value, size = 0, 1
    for x, kind in zip(text, kinds):
        if kind:
            value, size = value * len(kind) + kind.index(x), size * len(kind)
    return value, size


def to_text(value: int, text: str, kinds: list[str | None]) -> str:
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if kinds[i]:
            value, digit = divmod(value, len(kinds[i]))
            out[i] = kinds[i][digit]
    return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _phone(digits: str, abroad: bool) -> bool:
    """A number with a country code other than 1 has 8 to 15 digits; others follow the North American plan."""
    if abroad:
        return 8 <= len(digits) <= 15
    national = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    return len(national) == 10 and national[0] in "23456789" and national[3] in "23456789"


def _ipv4(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(str(int(p)) == p and int(p) < 256 for p in parts) and parts[0] != "0"


FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days
# Date notations as a pattern, the order of its groups, and how it is written.
DATES = (
    (re.compile(r"(\d{4})([-/.])(\d{2})\2(\d{2})"), (1, 3, 4), "{y:04d}{s}{m:02d}{s}{d:02d}"),
    (re.compile(r"(\d{2})([-/.])(\d{2})\2(\d{4})"), (4, 3, 1), "{d:02d}{s}{m:02d}{s}{y:04d}"),
)


def _day(text: str) -> tuple[int, str, str] | None:
    """Day number, separator and notation of a real date; where day-first is no date, month-first is tried."""
    for pattern, (y, m, d), form in DATES:
        if match := pattern.fullmatch(text):
            for month, day, out in ((m, d, form), (d, m, "{m:02d}{s}{d:02d}{s}{y:04d}")):
                try:
                    at = datetime.date(int(match[y]), int(match[month]), int(match[day])).toordinal() - FIRST_DAY
                except ValueError:
                    continue
                if 0 <= at < DAYS:
                    return at, match[2], out
                return None
    return None


# IBAN lengths by country.
IBAN_LENGTHS = {country: int(n) for n, *countries in map(str.split, (
    "15 NO;16 BE;18 DK FI FO GL NL SD FK;19 MK SI;20 AT BA EE KZ LT LU MN XK;21 CH HR LI LV;22 BG BH CR DE GB GE IE ME RS VA;23 AE GI IL IQ OM SO TL;24 AD CZ ES MD PK RO SA SE SK TN VG;"
    "25 LY PT ST;26 IS TR;27 BI DJ FR GR IT MC MR SM;28 AL AZ BY CY DO GT HU LB NI PL SV;29 BR EG PS QA UA;30 JO KW MU YE;31 MT SC;32 LC;33 RU").split(";")) for country in countries}  # fmt: skip


def forms(kind: str, text: str) -> list[int]:
    """Ends of the forms of a candidate, in the order they are tried: whole, then without its last groups."""
    ends = [len(text)]
    if kind in ("iban", "card", "phone"):
        ends += [m.start() for m in re.finditer(r"(?<=[A-Z0-9])[ .-]+", text)][::-1]
    if kind == "iban":
        size = IBAN_LENGTHS.get(text[:2])
        exact = [end for end in ends if len(text[:end].replace(" ", "")) == size]
        ends = [*exact, *(end for end in ends if end not in exact and (size is None or end == len(text)))]
        ends = [end for end in ends if len(text[:end].replace(" ", "")) >= 12]
    if kind == "card":
        ends = [end for end in ends if sum(c.isdigit() for c in text[:end]) >= 13]
    return ends


class Pseudonyms:
    """Finds values and permutes them under one key; ``undo`` reverses it."""

    #: What candidates look like, in the order of preference at one place.
    PATTERN = re.compile(
        r"(?P<email>(?<![\w.+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
        r"|(?:(?i:password|passwd|token|secret|api[_-]?key)\s*[=:]\s*[\"']?)(?P<key>[A-Za-z0-9_/+-]{12,})"
        r"|(?P<access>(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9]))"
        r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
        r"|(?P<ipv4>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
        r"|(?P<date>(?<![\w./-])(?:\d{4}([-/.])\d{2}\7\d{2}|\d{2}([-/.])\d{2}\8\d{4})(?![\w/-]|\.\d))"
        r"|(?P<card>(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\10\d{4}\10\d{4}(?:\10\d{1,3})?|\d{4}([ -])\d{6}\11\d{5})(?![\w-]))"
        r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,12}(?:[ .-]\d{2,9}){0,4}|(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\w-]|\.\d))"
    )

    def __init__(self, key: bytes):
        self.key = key[:64]
        self.permutation: Callable[[str, int], Permutation] = lru_cache(4096)(lambda tweak, size: Permutation(self.key, tweak, size))

    def _walk(self, tweak: str, value: int, size: int, back: bool, valid: Callable[[int], bool] | None = None) -> int:
        p = self.permutation(tweak, size)
        step = p.backward if back else p.forward
        value = step(value)
        while valid and not valid(value):
            value = step(value)
        return value

    def _spelled(self, kind: str, text: str, back: bool, valid: Callable[[str], bool] | None = None, fixed: int = 0) -> str:
        """Permute the characters of a text within their classes, all but the first ``fixed`` of them."""
        head, tail = text[:fixed], text[fixed:]
        kinds = alphabets(tail)
        value, size = to_number(tail, kinds)
        if size < 2:
            return text
        shape = "".join("." if k is None else str(len(k)) for k in kinds)
        return head + to_text(self._walk(f"{kind}|{head}|{shape}", value, size, back, valid and (lambda v: valid(head + to_text(v, tail, kinds)))), tail, kinds)

    def valid(self, kind: str, text: str) -> bool:
        """Whether a candidate is a value of its kind."""
        digits = re.sub(r"\D", "", text)
        if kind == "key":
            return bool(re.search(r"\d", text))
        if kind == "card":
            return luhn(digits) and len(set(digits)) > 1
        if kind == "iban":
            return mod97(text.replace(" ", "")) == 1
        if kind == "ipv4":
            return _ipv4(text)
        if kind == "date":
            return _day(text) is not None
        return kind != "phone" or _phone(digits, text[0] == "+" and text[1] != "1")

    def value(self, kind: str, text: str, back: bool = False, fits: Callable[[str], bool] = lambda new: True) -> str | None:
        """The pseudonym of a candidate, one that ``fits`` as the text itself does, or None if it is no value of its kind."""
        if not self.valid(kind, text):
            return None
        digits = re.sub(r"\D", "", text)
        if kind == "email":
            local, at, domain = text.partition("@")
            return self._spelled(kind, local, back, lambda x: fits(x + at + domain)) + at + domain
        if kind == "key":
            return self._spelled(kind, text, back, lambda x: fits(x))
        if kind == "access":
            return self._spelled(kind, text, back, lambda x: fits(x), fixed=4)

        def spaced(new: str) -> str:
            it = iter(new)
            return "".join(next(it) if c.isalnum() else c for c in text)

        if kind == "card":
            whole = lambda body: spaced(next(body + c for c in string.digits if luhn(body + c)))
            return whole(self._spelled(kind, digits[:-1], back, lambda body: fits(whole(body)), fixed=1))
        if kind == "iban":
            plain = text.replace(" ", "")
            whole = lambda body: spaced(f"{plain[:2]}{98 - mod97(plain[:2] + '00' + body):02d}{body}")
            return whole(self._spelled(kind + plain[:2], plain[4:], back, lambda body: fits(whole(body))))
        if kind == "ipv4":
            dotted = lambda v: ".".join(map(str, v.to_bytes(4, "big")))
            number = int.from_bytes(bytes(map(int, text.split("."))), "big")
            return dotted(self._walk(kind, number, 1 << 32, back, lambda v: v >> 24 > 0 and fits(dotted(v))))
        if kind == "date":
            at, separator, form = _day(text)
            plain_day = lambda v: (_day(_written(v, separator, form)) or (v,))[0] == v and fits(_written(v, separator, form))
            return _written(self._walk(kind + form, at, DAYS, back, plain_day), separator, form)
        abroad = text[0] == "+" and text[1] != "1"
        code = len(re.match(r"\+(\d{1,3})", text)[1]) if text[0] == "+" else 0
        code = min(code if abroad else 1 if len(digits) == 11 else 0, len(digits) - 5)
        return spaced(self._spelled(kind, digits, back, lambda d: _phone(d, abroad) and fits(spaced(d)), fixed=code))

    def candidates(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(kind, start, end) of the values, in order, and of the forms that were refused."""
        values, refused, at = [], [], 0
        while m := self.PATTERN.search(text, at):
            kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m[k])
            start, at = m.start(kind), m.start() + 1
            for end in forms(kind, m[kind]):
                if self.valid(kind, text[start : start + end]):
                    values.append((kind, start, start + end))
                    at = start + end
                    break
                refused.append((kind, start, start + end))
        return values, refused

    def replaced(self, text: str | None, back: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in it."""
        if not text or not re.search(r"[0-9@]", text):
            return text, []
        values, refused = self.candidates(text)
        new = {span: text[span[1] : span[2]] for span in values}

        def now(start: int, end: int, around: list[tuple[str, int, int]]) -> str:
            """A stretch of the text as replaced so far; values that reach over its end are cut there."""
            out, at = [], start
            for span in around:
                a, b = max(span[1], start), min(span[2], end)
                out += [text[at:a], new[span][a - span[1] : len(new[span]) if b == span[2] else b - span[1]]]
                at = b
            return "".join([*out, text[at:end]])

        # Undone in the opposite order, each value sees what it saw before.
        for span in reversed(values) if back else values:
            kind, start, end = span
            near = [(k, a, b, [v for v in values if v[1] < b and a < v[2]]) for k, a, b in refused if a < end and start < b]

            def fits(x: str) -> bool:
                new[span] = x
                return not any(self.valid(k, now(a, b, around)) for k, a, b, around in near)

            new[span] = self.value(kind, text[start:end], back, fits if near else lambda x: True)
        out, found, at, size = [], [], 0, 0
        for span in values:
            kind, start, end = span
            out += [text[at:start], new[span]]
            size += start - at
            found.append(("key" if kind == "access" else kind, size, size + len(new[span])))
            size, at = size + len(new[span]), end
        return "".join([*out, text[at:]]), found

    def undo(self, text: str | None) -> str | None:
        return self.replaced(text, back=True)[0]


KINDS = ("email", "key", "access", "iban", "ipv4", "date", "card", "phone")


def _written(at: int, separator: str, form: str) -> str:
    day = datetime.date.fromordinal(FIRST_DAY + at)
    return form.format(y=day.year, m=day.month, d=day.day, s=separator)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def pseudonymised(docs: DataFrame, key: bytes, text_col: str = "text", into: str = "pii") -> DataFrame:
    """All rows and columns, the text with pseudonyms in place of the text, and where they are."""
    into = unused(docs, into)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            for part in tk.slices(batch, text_col):
                done = [names.replaced(x) for x in part.column(column).to_pylist()]
                columns = list(part.columns)
                columns[column] = pa.array([x for x, _ in done], pa.string())
                spans = pa.array([[dict(zip(("kind", "start", "end"), s)) for s in found] for _, found in done], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*columns, spans], [*part.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, SPANS)]))
