"""Format-preserving pseudonyms: validated numbers and dates, permuted with a key inside their format.

A value becomes a number below the size of its format, a keyed Feistel network permutes that
range, and the result is written back in the same format. Equal values get equal pseudonyms
in every document, different values different ones, and who has the key can go back.

Digits of any script count by their value: a number in Arabic-Indic, Devanagari or full-width
digits is the number that 0-9 would write, and its pseudonym is written in its own script.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lexigrade.llm.common import bounded

ROUNDS = 8
#: Characters that are permuted as one number.
BLOCK = 256
_FIRST_DAY, _DAYS = dt.date(1900, 1, 1).toordinal(), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days
# English month names as dates write them.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


class Feistel:
    """A keyed permutation of 0 .. size-1 for any size, one for each tweak."""

    def __init__(self, key: bytes, rounds: int = ROUNDS) -> None:
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _round(self, tweak: bytes, i: int, x: int, modulus: int) -> int:
        said = b"%s|%d|%d|%d" % (tweak, i, x, modulus)
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=32).digest(), "big") % modulus

    def permute(self, value: int, size: int, tweak: str, inverse: bool = False) -> int:
        """Two halves below a and b, a * b >= size, take turns; a result beyond size is permuted again."""
        a = math.isqrt(max(size - 1, 0)) + 1
        b = -(-size // a)
        name = tweak.encode()
        while True:
            left, right = divmod(value, b)
            for i in range(self.rounds) if not inverse else reversed(range(self.rounds)):
                sign = -1 if inverse else 1
                if i % 2:
                    right = (right + sign * self._round(name, i, left, b)) % b
                else:
                    left = (left + sign * self._round(name, i, right, a)) % a
            value = left * b + right
            if value < size:
                return value

    def string(self, value: str, tweak: str, inverse: bool = False) -> str:
        """Permutes letters among letters and digits among digits, each in its own place and case."""
        sets = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else c for c in value]
        return self.mixed(value, sets, tweak, inverse)

    def mixed(self, value: str, sets: list[str], tweak: str, inverse: bool = False) -> str:
        """Permutes strings whose places have the letters of `sets`.

        A value longer than `BLOCK` goes block by block, forth and back, each block under a tweak of all
        that the pass has read before it; so every character weighs in and the work is in proportion.
        """
        if len(value) <= BLOCK:
            return self._block(value, sets, tweak, inverse)
        spans = [slice(at, at + BLOCK) for at in range(0, len(value), BLOCK)]
        parts = [value[span] for span in spans]
        for turn in (1, 0) if inverse else (0, 1):
            seen = hashlib.blake2b(b"%d|%d" % (turn, len(value)), digest_size=16)
            for k in reversed(range(len(parts))) if turn else range(len(parts)):
                # The chain reads what stood before the pass, which the way back has restored by then.
                name, before = f"{tweak}|{seen.hexdigest()}", parts[k]
                parts[k] = self._block(before, sets[spans[k]], name, inverse)
                seen.update((parts[k] if inverse else before).encode())
        return "".join(parts)

    def _block(self, value: str, sets: list[str], tweak: str, inverse: bool) -> str:
        number, size = 0, 1
        for c, letters in zip(value, sets):
            number, size = number * len(letters) + letters.index(c), size * len(letters)
        number = self.permute(number, size, f"{tweak}:{'/'.join(letters[0] for letters in sets)}", inverse)
        out = []
        for letters in reversed(sets):
            number, at = divmod(number, len(letters))
            out.append(letters[at])
        return "".join(reversed(out))


def luhn(digits: str) -> int:
    """Check digit that completes `digits`."""
    doubled = (int(d) * (2 - i % 2) for i, d in enumerate(reversed(digits)))
    return -sum(d - 9 * (d > 9) for d in doubled) % 10


def iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _refill(shape: str, digits: str) -> str:
    """The digits put where `shape` has digits."""
    source = iter(digits)
    return "".join(next(source) if c.isdigit() else c for c in shape)


Swap = Callable[[Feistel, re.Match, bool], "str | None"]


def _card(f: Feistel, m: re.Match, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if len(set(digits)) == 1 or luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = f.mixed(digits[:-1], ["0123456789"] * (len(digits) - 1), "card", back)
    while len(set(body)) == 1:  # a row of one digit is not taken for a card
        body = f.mixed(body, ["0123456789"] * len(body), "card", back)
    return _refill(m[0], body + str(luhn(body)))


def _iban(f: Feistel, m: re.Match, back: bool) -> str | None:
    plain = m[0].replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 11 <= len(account) <= 30 or f"{iban_check(country, account):02d}" != check:
        return None
    account = f.string(account, f"iban {country}", back)
    new, out = iter(f"{country}{iban_check(country, account):02d}{account}"), []
    for c in m[0]:
        out.append(c if c == " " else next(new))
    return "".join(out)


def _social(f: Feistel, m: re.Match, back: bool) -> str | None:
    areas = [a for a in range(1, 900) if a != 666]
    area, group, serial = map(int, m.groups())
    if area not in areas or not group or not serial:
        return None
    number = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    number, serial = divmod(f.permute(number, len(areas) * 99 * 9999, "social", back), 9999)
    area, group = divmod(number, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(f: Feistel, m: re.Match, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m["number"])
    if not 7 <= len(digits) <= 14:
        return None
    return m["prefix"] + _refill(m["number"], f.mixed(digits, ["0123456789"] * len(digits), "phone", back))


def _address(f: Feistel, m: re.Match, back: bool) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    number = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ipv4", back)
    return ".".join(map(str, number.to_bytes(4, "big")))


def _mail(f: Feistel, m: re.Match, back: bool) -> str | None:
    """The mailbox is permuted, the domain stays: it names a host, and equal hosts stay visible."""
    return f.string(m["box"], "mail " + m["domain"].lower(), back) + "@" + m["domain"]


def _secret(f: Feistel, m: re.Match, back: bool) -> str | None:
    value = m["secret"]
    hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)
    digits = "0123456789abcdef" if value == value.lower() else "0123456789ABCDEF"
    new = f.mixed(value, [digits] * len(value), "secret", back) if hexadecimal else f.string(value, "secret", back)
    return m[0][: m.start("secret") - m.start()] + new + m[0][m.end("secret") - m.start() :]


def _day(year: int, month: int, day: int) -> int | None:
    try:
        number = dt.date(year, month, day).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    return number if 0 <= number < _DAYS else None


def _date(f: Feistel, m: re.Match, back: bool) -> str | None:
    """One permutation of the days of 1900 to 2099 for all notations, so they stay linked across them."""
    g = m.groupdict()
    month = next((i + 1 for i, name in enumerate(MONTHS) if g.get("name") and name[:3].lower() == g["name"][:3].lower()), None)
    if g.get("name"):
        parts, flipped = (int(g["year"]), month, int(g["day"])), False
    elif g.get("y"):
        parts, flipped = (int(g["y"]), int(g["m"]), int(g["d"])), False
    else:  # day or month first: read as month/day with slashes unless that is no date
        a, b, year = int(g["a"]), int(g["b"]), int(g["z"])
        flipped = g["sep"] == "/" and a <= 12
        parts = (year, a, b) if flipped else (year, b, a)
    number = _day(*parts)
    if number is None:
        return None
    new = dt.date.fromordinal(_FIRST_DAY + f.permute(number, _DAYS, "date", back))
    if g.get("name"):
        name = MONTHS[new.month - 1]
        name = name if len(g["name"].rstrip(".")) > 3 or g["name"] == "May" else name[:3]
        return _named(m, new, name)
    if g.get("y"):
        return f"{new.year:04d}{m['s']}{new.month:02d}{m['s']}{new.day:02d}"
    # With slashes a first number up to 12 is read as a month, so such a day can't stand first.
    month_first = g["sep"] == "/" and (flipped or new.day <= 12)
    first, second = (new.month, new.day) if month_first else (new.day, new.month)
    return f"{first:02d}{g['sep']}{second:02d}{g['sep']}{new.year:04d}"


def _named(m: re.Match, new: dt.date, name: str) -> str:
    spans = [(m.span("name"), name), (m.span("day"), str(new.day)), (m.span("year"), str(new.year))]
    if m.groupdict().get("nth"):
        spans.append((m.span("nth"), {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10 if new.day // 10 != 1 else 0, "th")))
    spans.sort()
    out, at = [], m.start()
    for (start, end), value in spans:
        out += [m.string[at:start], value]
        at = end
    return "".join(out)


_NAMES = "|".join(f"{name}|{name[:3]}" for name in MONTHS)
#: In order of precedence: what an earlier kind has taken a later one leaves alone.
KINDS: list[tuple[str, re.Pattern, Swap]] = [
    ("secret", re.compile(r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b)[\"']?\s*[:=]\s*[\"']?(?P<secret>[A-Za-z0-9]{16,})(?![A-Za-z0-9])"), _secret),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])(?P<box>[A-Za-z0-9._%+-]{1,64})@(?P<domain>[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"), _mail),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), _iban),
    ("card", re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{5})(?![\w-])"), _card),
    ("social", re.compile(r"(?<![\w-])(\d{3})-(\d{2})-(\d{4})(?![\w-])"), _social),
    ("date", re.compile(r"(?<![\w/.-])(?P<y>(?:19|20)\d\d)(?P<s>[-/.])(?P<m>\d\d)(?P=s)(?P<d>\d\d)(?!\w|[-/.]\d)"), _date),
    ("date", re.compile(r"(?<![\w/.-])(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<z>(?:19|20)\d\d)(?!\w|[-/.]\d)"), _date),
    ("date", re.compile(rf"\b(?P<name>{_NAMES})\.? (?P<day>\d{{1,2}})(?P<nth>st|nd|rd|th)?,? (?P<year>(?:19|20)\d\d)\b"), _date),
    ("date", re.compile(rf"\b(?P<day>\d{{1,2}})\.? (?P<name>{_NAMES})\.?,? (?P<year>(?:19|20)\d\d)\b"), _date),
    ("phone", re.compile(r"(?<![\w+])(?P<prefix>\+\d{1,3}[ .-]?)(?P<number>\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4})(?!\w)"), _phone),
    ("phone", re.compile(r"(?<![\w+.-])(?P<prefix>)(?P<number>\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"), _phone),
    ("ipv4", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"), _address),
]
_DIGIT_OR_SIGN = re.compile(r"[0-9@]|(?i:token|secret|passw|key)")
#: Decimal digits other than 0-9.
_OTHER_DIGIT = re.compile(r"[^\D0-9]")


def in_script(new: str, old: str) -> str:
    """`new` with its digits in the script of `old`, place by place where both have as many digits.

    A value that gets another number of digits (a date, an address) is written in the script of the first.
    """
    zeros = [ord(c) - unicodedata.decimal(c) for c in old if c.isdecimal()]
    digits = sum(map(str.isdecimal, new))
    if digits != len(zeros):
        zeros = zeros[:1] * digits
    source = iter(zeros)
    return "".join(chr(next(source) + int(c)) if c.isdecimal() else c for c in new)


def pseudonymise(text: str, cipher: Feistel, inverse: bool = False) -> tuple[str, list[str]]:
    """The text with every validated value replaced, and the kinds replaced in text order."""
    # As many characters as the text, so places hold in both.
    rest = text if text.isascii() else _OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)
    if not _DIGIT_OR_SIGN.search(rest):
        return text, []
    other = rest != text
    taken: list[tuple[int, int, str, str]] = []
    for kind, pattern, swap in KINDS:
        mine = []
        m = pattern.search(rest)
        while m:
            new = swap(cipher, m, inverse)
            if new is not None:
                mine.append((m.start(), m.end(), kind, new))
            # What isn't valid may hide a value that begins a little later.
            m = pattern.search(rest, m.start() + 1 if new is None else m.end())
        if mine:  # what is taken is blanked out for the kinds that follow
            out, at = [], 0
            for start, end, _, _ in mine:
                out += [rest[at:start], "\0" * (end - start)]
                at = end
            rest = "".join([*out, rest[at:]])
            taken += mine
    out, at = [], 0
    for start, end, _, new in sorted(taken):
        out += [text[at:start], in_script(new, text[start:end]) if other else new]
        at = end
    return "".join([*out, text[at:]]), [kind for _, _, kind, _ in sorted(taken)]


def protect(docs: DataFrame, key: bytes, inverse: bool = False) -> DataFrame:
    """Every row of `docs` (doc_id, text) as doc_id, text, n_found, kinds (sorted and distinct).

    `inverse` goes back with the same key: every number returns as it was, every date as the
    same day (a day or month that was written with one digit may return with two, a day before its month
    with slashes behind it; a date or an address that mixed digits of several scripts may return in one of
    them). Equal days have equal pseudonyms in all notations. Whole texts, no shuffle, nothing kept between rows:
    the pseudonym of a value depends on the key and the value alone, whatever its length. A null text stays null, an
    empty one empty; repeated rows are treated each by itself and alike; an empty table gives no rows; other columns
    of `docs` are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Feistel(key)
        for batch in bounded(batches, "text"):
            done = [(t, []) if t is None else pseudonymise(t, cipher, inverse) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([t for t, _ in done], pa.string()),
                    pa.array([len(k) for _, k in done], pa.int64()),
                    pa.array([sorted(set(k)) for _, k in done], pa.list_(pa.string())),
                ],
                names=["doc_id", "text", "n_found", "kinds"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(scan, f"doc_id {kind}, text string, n_found long, kinds array<string>")
