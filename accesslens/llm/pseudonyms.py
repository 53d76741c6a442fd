"""Personal data replaced by format-preserving Feistel pseudonyms.

Card numbers, IBANs, phone and social-security numbers, IPv4 and e-mail addresses and
dates are found by pattern, validated, and permuted by a keyed Feistel network over the
values of their format: the same value gets the same pseudonym in every document and
in every spelling (separators, case, date order), two values never share one, and the
length of the text and all that makes the value valid stay as they were. Whoever has
the key can invert it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslens.llm.shared import arrow_map, quoted

ROUNDS = 8
KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date")
#: Dates outside these years are no one's birthday or appointment.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of range(n), one for each `tweak`."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, k: int, half: int, bits: int) -> int:
        size = -(-bits // 8)
        out, block = b"", 0
        while len(out) < size:
            seed = b"%b|%d|%d|%x" % (tweak, k, block, half)
            out += hashlib.blake2b(seed, key=self.key, digest_size=64).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _once(self, value: int, bits: int, tweak: bytes, inverse: bool) -> int:
        left, right = value >> bits, value & ((1 << bits) - 1)
        for k in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ self._round(tweak, k, left, bits), left
            else:
                left, right = right, left ^ self._round(tweak, k, right, bits)
        return left << bits | right

    def permuted(
        self, value: int, n: int, tweak: str, valid: Callable[[int], bool] = lambda _: True, inverse: bool = False
    ) -> int:
        """The image of a valid `value`; the walk goes on past values out of range or not valid."""
        bits = max(1, -(-(n - 1).bit_length() // 2))
        label = f"{tweak}|{n}".encode()
        while True:
            value = self._once(value, bits, label, inverse)
            if value < n and valid(value):
                return value


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_value(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def _mixed(characters: str, alphabets: list[str]) -> tuple[int, int]:
    """A number for `characters`, and how many there are over the same alphabets."""
    value, n = 0, 1
    for c, alphabet in zip(characters, alphabets, strict=True):
        value, n = value * len(alphabet) + alphabet.index(c), n * len(alphabet)
    return value, n


def _unmixed(value: int, alphabets: list[str]) -> str:
    out = []
    for alphabet in reversed(alphabets):
        value, k = divmod(value, len(alphabet))
        out.append(alphabet[k])
    return "".join(reversed(out))


_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def _refilled(template: str, characters: str, is_slot: Callable[[str], bool]) -> str:
    """`template` with its slots filled in order, each in the case that it had."""
    fill = iter(characters)
    return "".join((next(fill).upper() if c.isupper() else next(fill)) if is_slot(c) else c for c in template)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _with_digits(text: str, digits: str) -> str:
    return _refilled(text, digits, _DIGITS.__contains__)


@dataclass(frozen=True)
class Permuter:
    """Pseudonyms of validated values; `None` for what isn't valid."""

    feistel: Feistel
    inverse: bool = False

    def _move(self, value, n, tweak, valid=lambda _: True) -> int:
        return self.feistel.permuted(value, n, tweak, valid, self.inverse)

    def card(self, text: str) -> str | None:
        """The issuer's digit stays; the Luhn sum stays valid."""
        digits = _digits(text)
        if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
            return None
        n, lead = len(digits) - 1, digits[0]
        spelled = lambda v: lead + str(v).zfill(n)
        valid = lambda v: luhn(spelled(v)) and len(set(spelled(v))) > 1
        return _with_digits(text, spelled(self._move(int(digits[1:]), 10**n, f"card{lead}", valid)))

    def iban(self, text: str) -> str | None:
        """Country and layout stay; the check digits are those of the new number."""
        flat = text.replace(" ", "").lower()
        if not 15 <= len(flat) <= 34 or _iban_value(flat) % 97 != 1:
            return None
        alphabets = [_DIGITS if c in _DIGITS else _LETTERS for c in flat[4:]]
        value, n = _mixed(flat[4:], alphabets)
        body = _unmixed(self._move(value, n, f"iban{flat[:2]}"), alphabets)
        check = 98 - _iban_value(f"{flat[:2]}00{body}") % 97
        return _refilled(text, f"{flat[:2]}{check:02d}{body}", str.isalnum)

    def phone(self, text: str) -> str | None:
        """The country code stays; area and exchange keep starting with 2-9 if they did."""
        digits = _digits(text)
        if not 10 <= len(digits) <= 13:
            return None
        code, number = digits[:-10], digits[-10:]
        dialled = lambda v: (s := str(v).zfill(10))[0] > "1" and s[3] > "1"
        kind = dialled(int(number))
        moved = self._move(int(number), 10**10, "phone", lambda v: dialled(v) == kind)
        return _with_digits(text, code + str(moved).zfill(10))

    def ssn(self, text: str) -> str | None:
        issued = lambda v: (
            0 < v // 10**6 < 900 and v // 10**6 != 666 and v // 10**4 % 100 > 0 and v % 10**4 > 0
        )
        value = int(_digits(text))
        if not issued(value):
            return None
        return _with_digits(text, str(self._move(value, 10**9, "ssn", issued)).zfill(9))

    def ip(self, text: str) -> str | None:
        """Each part keeps its number of digits."""
        parts = text.split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        value, n = 0, 1
        ranges = [{1: (0, 10), 2: (10, 90), 3: (100, 156)}[len(p)] for p in parts]
        for p, (low, size) in zip(parts, ranges, strict=True):
            value, n = value * size + int(p) - low, n * size
        value = self._move(value, n, "ip" + "".join(str(len(p)) for p in parts))
        out = []
        for low, size in reversed(ranges):
            value, k = divmod(value, size)
            out.append(str(low + k))
        return ".".join(reversed(out))

    def email(self, text: str) -> str | None:
        """Letters become letters and digits digits, up to the last label; marks stay."""
        cut = text.rindex(".")
        slots = [c for c in text[:cut].lower() if c in _LETTERS or c in _DIGITS]
        alphabets = [_DIGITS if c in _DIGITS else _LETTERS for c in slots]
        value, n = _mixed("".join(slots), alphabets)
        shape = "".join("9" if c in _DIGITS else "a" if c in _LETTERS else c for c in text[:cut].lower())
        moved = _unmixed(self._move(value, n, f"email{shape}{text[cut:].lower()}"), alphabets)
        return _refilled(text[:cut], moved, lambda c: c.isascii() and c.isalnum()) + text[cut:]

    def date(self, text: str) -> str | None:
        """Another day of 1900 to 2099 in the same order of day, month and year.

        A leading day or month is a month where it can be one, so a day before the
        month stays over 12 and reads the same way again.
        """
        a, b, c = (int(x) for x in re.split(r"\D", text))
        mark = text[4] if text[4] in "-/." else text[2]
        year_first = text[4] == mark
        if year_first:
            year, month, day = a, b, c
        else:
            year, month, day = (c, a, b) if a <= 12 and mark != "." else (c, b, a)
        try:
            value = dt.date(year, month, day).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= value <= LAST_DAY:
            return None
        late = not year_first and mark != "." and a > 12
        of = lambda v: dt.date.fromordinal(FIRST_DAY + v)
        # days over 12 are permuted among themselves, so every spelling of a date agrees
        moved = of(
            self._move(
                value - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date", lambda v: (of(v).day > 12) == (day > 12)
            )
        )
        if year_first:
            return f"{moved.year:04d}{mark}{moved.month:02d}{mark}{moved.day:02d}"
        first, second = (moved.day, moved.month) if late or mark == "." else (moved.month, moved.day)
        return f"{first:02d}{mark}{second:02d}{mark}{moved.year:04d}"


# fixed values: the patterns of the formats
_PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w.+-])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])",
    "ssn": r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "ip": r"(?<![\w.-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w-]|\.[0-9])",
    "date": r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![\w/-]|\.[0-9])",
}
_COMPILED = {kind: re.compile(pattern) for kind, pattern in _PATTERNS.items()}
_DIGIT = re.compile("[0-9]")
#: Numbers joined by single spaces or dashes; capital words joined by single spaces.
_NUMBERS = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_CAPITALS = re.compile(r"(?<!\w)[A-Z0-9]+(?: [A-Z0-9]+)*(?!\w)")
_GROUP = re.compile("[A-Z0-9]+")
#: How cards are printed: groups of four, or 4-6-5 and 4-6-4.
_CARD_LAYOUT = re.compile(r"[0-9]{13,19}|([0-9]{4})([ -])(?:[0-9]{4}\2[0-9]{4}\2[0-9]{4}(?:\2[0-9]{1,3})?|[0-9]{6}\2[0-9]{4,5})")
_IBAN_LAYOUT = re.compile("[A-Z0-9]{15,34}|(?:[A-Z0-9]{4} ){3,8}[A-Z0-9]{1,4}")


def _card_places(text: str) -> Iterator[tuple[bool, int, int]]:
    """Whether printed otherwise, start and end of all that may be a card beside other numbers."""
    for run in _NUMBERS.finditer(text):
        if len(run.group()) < 13:
            continue
        groups = [(run.start() + g.start(), run.start() + g.end()) for g in _GROUP.finditer(run.group())]
        # a word that goes on before or after the numbers is no number
        low, high = run.start(), run.end()
        if low and re.match(r"[\w.-]", text[low - 1]):
            low = text.find(" ", low, high) + 1 or high
        if re.match(r"[\w-]", text[high : high + 1]):
            high = text.rfind(" ", low, high)
        for k, (start, _) in enumerate(groups):
            digits = 0
            for begin, end in groups[k:] if start >= low else ():
                digits += end - begin
                if digits > 19 or end > high:
                    break
                if digits >= 13:
                    yield not _CARD_LAYOUT.fullmatch(text, start, end), start, end


def _iban_places(text: str) -> Iterator[tuple[bool, int, int]]:
    """The same of account numbers beside other capital words."""
    for run in _CAPITALS.finditer(text):
        if len(run.group()) < 15:
            continue
        groups = [(run.start() + g.start(), run.start() + g.end()) for g in _GROUP.finditer(run.group())]
        for k, (start, _) in enumerate(groups):
            if not _IBAN_START.match(text, start):
                continue
            characters = 0
            for begin, end in groups[k:]:
                characters += end - begin
                if characters > 34:
                    break
                if characters >= 15 and _COMPILED["iban"].fullmatch(text, start, end):
                    yield not _IBAN_LAYOUT.fullmatch(text, start, end), start, end


_IBAN_START = re.compile("[A-Z]{2}[0-9]{2}")
_PLACES = {"card": _card_places, "iban": _iban_places}


def _values(text: str, kind: str, permuter: Permuter) -> Iterator[tuple[int, int, str]]:
    """Start, end and pseudonym of the valid values of a kind.

    Cards and account numbers may stand beside numbers and words that look like more of
    them: of what is valid the usual print counts first, then the earlier, then the longer.
    """
    if kind not in _PLACES:
        for match in _COMPILED[kind].finditer(text):
            if (new := getattr(permuter, kind)(match.group())) is not None:
                yield match.start(), match.end(), new
        return
    taken = bytearray()
    for _, start, minus in sorted((odd, start, -end) for odd, start, end in _PLACES[kind](text)):
        end = -minus
        taken = taken or bytearray(len(text))
        if not any(taken[start:end]) and (new := getattr(permuter, kind)(text[start:end])) is not None:
            taken[start:end] = b"\1" * (end - start)
            yield start, end, new


def pseudonymised(text: str, permuter: Permuter) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and kind, start and end of each in order.

    Where values overlap, the earlier one counts, and of those the one first in `KINDS`.
    """
    found = []
    some = _DIGIT.search(text)
    for order, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text or kind != "email" and not some:
            continue
        found += [(start, order, end, kind, new) for start, end, new in _values(text, kind, permuter)]
    out, spans, at = [], [], 0
    for start, _, end, kind, new in sorted(found):
        if start >= at:
            out += [text[at:start], new]
            spans.append((kind, start, end))
            at = end
    return "".join(out) + text[at:], spans


def restored(text: str, spans: list[tuple[str, int, int]], permuter: Permuter) -> str:
    """The text before, from its spans and an inverse permuter, whatever stands beside the values."""
    for kind, start, end in spans:
        text = text[:start] + getattr(permuter, kind)(text[start:end]) + text[end:]
    return text


def with_pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """`docs` with pseudonyms in `text_col`, all other columns as they were.

    `spans_col` names a further column for the `kind:start:end` of each value, joined
    by commas. NULL texts stay NULL (no spans), rows are neither added nor dropped.
    """
    at = docs.columns.index(text_col)
    spans_field = [T.StructField(spans_col, T.StringType())] if spans_col else []
    named = T.StructType([*docs.schema.fields, *spans_field])

    def start():
        permuter = Permuter(Feistel(key))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            done = [pseudonymised(t, permuter) if t else (t, []) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], batch.schema.field(at).type)
            names = list(batch.schema.names)
            if spans_col:
                columns.append(pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in s) for _, s in done], pa.string()))
                names.append(spans_col)
            return pa.RecordBatch.from_arrays(columns, names=names)

        return each

    return arrow_map(docs, start, named)


def counted_kinds(spans: str) -> list:
    """Columns `n_<kind>`: how many values of each kind a spans column names."""
    kinds = F.transform(F.split(F.col(quoted(spans)), ","), lambda s: F.split_part(s, F.lit(":"), F.lit(1)))
    return [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
