"""Format-preserving pseudonyms for personal data."""

from __future__ import annotations

import datetime
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import by_batch

#: The key is a parameter; production runs pass their own.
KEY = b"pseudonyms of the public example"
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Only texts with one of these are searched.
DIGITS = bytes(0x64 if chr(b) in "0123456789" else 0x20 for b in range(256))

PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]+@(?:[\w-]+\.)+[A-Za-z]{2,}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "iso": r"(?<![\w-])[0-9]{4}(?P<iso_sign>[-/.])[0-9]{2}(?P=iso_sign)[0-9]{2}(?![\w-])",
    "day": r"(?<![\w-])[0-9]{2}(?P<day_sign>[-/.])[0-9]{2}(?P=day_sign)[0-9]{4}(?![\w-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|(?:\([0-9]{3}\)[ ]?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?![\w])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
FOUND = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
ONE = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
#: Kinds in groups of any number: a match may hold a shorter value and its neighbours.
GROUPED = ("iban", "card", "phone")
#: Characters on both sides of a value in which new matches could arise.
AROUND = 200


class Feistel:
    """Keyed permutations of 0..n-1 for any n, by a balanced network with cycle walking."""

    def __init__(self, key: bytes = KEY):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, n: int, k: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        seed = b"%s|%d|%d|" % (kind.encode(), n, k) + half.to_bytes(size, "big")
        out = b"".join(hashlib.blake2b(seed + b"|%d" % i, key=self.key).digest() for i in range(-(-size // 64)))
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _walk(self, kind: str, x: int, n: int, back: bool) -> int:
        bits = max(1, -(-(n - 1).bit_length() // 2))
        mask = (1 << bits) - 1
        while True:
            left, right = x >> bits, x & mask
            for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = right ^ self._round(kind, n, k, left, bits), left
                else:
                    left, right = right, left ^ self._round(kind, n, k, right, bits)
            x = (left << bits) | right
            if x < n:
                return x

    def forward(self, kind: str, x: int, n: int) -> int:
        return self._walk(kind, x, n, False)

    def backward(self, kind: str, x: int, n: int) -> int:
        return self._walk(kind, x, n, True)

    def pseudonym(self, kind: str, x: int, n: int, step: int = 1) -> int:
        """The next value on a keyed cycle through all n: one to one, never the value itself (n over 1).

        ``step`` -1 is the inverse.
        """
        return self.backward(kind, (self.forward(kind, x, n) + step) % n, n)


def luhn(digits: str) -> int:
    """The check digit that completes these digits."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[::-2])
    return -(doubled + sum(map(int, digits[-2::-2]))) % 10


def respelled(shape: str, symbols: str) -> str:
    """``shape`` with its ASCII letters and digits replaced in order, the case of letters kept."""
    rest = iter(symbols)
    return "".join((next(rest).upper() if c.isupper() else next(rest)) if c.isascii() and c.isalnum() else c for c in shape)


def mixed(text: str) -> tuple[int, int, list[int]]:
    """Value, size and radices of a text's ASCII letters (either case) and digits."""
    value, size, radices = 0, 1, []
    for c in text.lower():
        if c.isascii() and c.isalnum():
            radix = 10 if c.isdigit() else 26
            value, size = value * radix + (int(c) if radix == 10 else LETTERS.index(c)), size * radix
            radices.append(radix)
    return value, size, radices


def spelled(value: int, radices: list[int]) -> str:
    out = []
    for radix in reversed(radices):
        value, k = divmod(value, radix)
        out.append(str(k) if radix == 10 else LETTERS[k])
    return "".join(reversed(out))


class Pseudonyms:
    """Replaces validated values by keyed permutations within their format; ``undo`` gives the originals back."""

    def __init__(self, key: bytes = KEY, undo: bool = False):
        self.net, self.step = Feistel(key), -1 if undo else 1

    def _of(self, kind: str, x: int, n: int) -> int:
        return self.net.pseudonym(kind, x, n, self.step) if n > 1 else x

    def _text(self, kind: str, text: str) -> str:
        value, size, radices = mixed(text)
        shape = "".join("9" if r == 10 else "a" for r in radices)
        return respelled(text, spelled(self._of(kind + shape, value, size), radices))

    def email(self, s: str) -> str | None:
        local, _, host = s.rpartition("@")
        if mixed(local)[1] > 1:
            return f"{self._text('email', local)}@{host}"
        name, dot, rest = host.partition(".")
        return f"{local}@{self._text('host', name)}{dot}{rest}"

    def iban(self, s: str) -> str | None:
        plain = s.replace(" ", "")
        number = lambda t: int("".join(str(int(c, 36)) for c in t))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        account = self._text("iban" + plain[:2], plain[4:]).upper()
        check = 98 - number(account + plain[:2] + "00") % 97
        return respelled(s, (plain[:2] + f"{check:02d}" + account).lower())

    def ip(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        new = self._of("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
        return ".".join(map(str, new.to_bytes(4, "big")))

    def _date(self, year: str, month: str, day: str) -> datetime.date | None:
        try:
            at = datetime.date(int(year), int(month), int(day)).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= at <= LAST_DAY:
            return None
        return datetime.date.fromordinal(FIRST_DAY + self._of("date", at - FIRST_DAY, LAST_DAY - FIRST_DAY + 1))

    def iso(self, s: str) -> str | None:
        new = self._date(s[:4], s[5:7], s[8:])
        return new and f"{new.year:04d}{s[4]}{new.month:02d}{s[4]}{new.day:02d}"

    def day(self, s: str) -> str | None:
        """Day first; a date that is only valid month first is a text of digits to be permuted as such."""
        new = self._date(s[6:], s[3:5], s[:2])
        if new:
            return f"{new.day:02d}{s[2]}{new.month:02d}{s[2]}{new.year:04d}"
        if not 1 <= int(s[:2]) <= 12 or not 13 <= int(s[3:5]) <= 31 or not 1900 <= int(s[6:]) <= 2099:
            return None
        # Months of 28 days keep both numbers in their range and the day above 12.
        x = ((int(s[6:]) - 1900) * 12 + int(s[:2]) - 1) * 19 + int(s[3:5]) - 13
        x = self._of("month first", x, 200 * 12 * 19)
        return f"{x // 19 % 12 + 1:02d}{s[2]}{x % 19 + 13:02d}{s[2]}{x // 228 + 1900:04d}"

    def ssn(self, s: str) -> str | None:
        area, group, serial = map(int, s.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        x = self._of("ssn", ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
        area = x // (99 * 9999) + 1
        return f"{area + (area >= 666):03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"

    def phone(self, s: str) -> str | None:
        """The country code stays; the national digits are permuted, whatever separates them."""
        code = re.match(r"\+[0-9]{1,3}", s)
        if s[0] == "+" and re.match(r"\+1[0-9]{10}$", s):
            head = "+1"
        else:
            head = code[0] if code else ""
        digits = re.sub("[^0-9]", "", s[len(head) :])
        if not 7 <= len(digits) <= 14:
            return None
        return head + respelled(s[len(head) :], f"{self._of(f'phone{len(digits)}', int(digits), 10 ** len(digits)):0{len(digits)}d}")

    def card(self, s: str) -> str | None:
        digits = re.sub("[^0-9]", "", s)
        body = digits[:-1]
        if luhn(body) != int(digits[-1]) or not int(digits):
            return None
        new = f"{self._of(f'card{len(body)}', int(body), 10 ** len(body)):0{len(body)}d}"
        return respelled(s, new + str(luhn(new)))

    def replace(self, text: str | None) -> tuple[str | None, list[str]]:
        """The text with all valid values replaced, and the kinds found in order. Everything else stays as it is."""
        if not text or (b"d" not in text.encode("ascii", "replace").translate(DIGITS) and "@" not in text):
            return text, []
        found = spans(text)
        # A new value must leave all values where they are, or they could not be found again. Undoing goes backwards, so
        # that each value meets the same neighbours both times.
        for k, (kind, start, end) in reversed([*enumerate(found)]) if self.step < 0 else enumerate(found):
            old = new = text[start:end]
            head, tail = text[max(0, start - AROUND) : start], text[end : end + AROUND]
            places = placed(head, old, tail)
            while True:
                new = getattr(self, kind)(new)
                if new == old or placed(head, new, tail) == places:
                    break
            text = text[:start] + new + text[end:]
            if self.step > 0 and len(new) != len(old):
                found[k + 1 :] = [(x, a + len(new) - len(old), b + len(new) - len(old)) for x, a, b in found[k + 1 :]]
        return text, [kind for kind, _, _ in found]


class Checked(Pseudonyms):
    """Validation alone: every valid value is its own pseudonym."""

    def _of(self, kind: str, x: int, n: int) -> int:
        return x


CHECKED = Checked()


def valid_span(kind: str, text: str, start: int, end: int) -> bool:
    return getattr(CHECKED, kind)(text[start:end]) is not None


def value_at(m: re.Match) -> tuple[str, int, int] | None:
    """The first valid value that starts where ``m`` does: the whole match of each kind, then shorter ones at group borders."""
    text, start = m.string, m.start()
    if valid_span(m.lastgroup, text, start, m.end()):
        return m.lastgroup, start, m.end()
    whole = [(kind, one.match(text, start)) for kind, one in ONE.items()]
    whole = [(kind, w.end()) for kind, w in whole if w]
    for kind, end in whole:
        if valid_span(kind, text, start, end):
            return kind, start, end
    for kind, end in whole:
        if kind not in GROUPED or (kind == "phone" and card_within(text, start + 1, end)):
            continue
        for cut in range(end - 1, start, -1):
            if text[cut] in " -." and ONE[kind].fullmatch(text, start, cut) and valid_span(kind, text, start, cut):
                return kind, start, cut
    return None


def card_within(text: str, start: int, end: int) -> bool:
    """Whether a valid card number starts in this part of a text."""
    while (m := ONE["card"].search(text, start)) and m.start() < end:
        if valid_span("card", text, m.start(), m.end()):
            return True
        start = m.start() + 1
    return False


def spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of all valid values. After a match without one the search goes on one character further."""
    out, at = [], 0
    while m := FOUND.search(text, at):
        hit = value_at(m)
        at = hit[2] if hit else m.start() + 1
        if hit:
            out.append(hit)
    return out


def placed(head: str, value: str, tail: str) -> list[tuple]:
    """Where values lie in a text, those after ``value`` counted from its end."""
    start, end = len(head), len(head) + len(value)
    return [(kind, *[("before", x) if x <= start else ("after", x - end) for x in (a, b)]) for kind, a, b in spans(head + value + tail)]


def pseudonymise(docs: DataFrame, text: str = "text", key: bytes = KEY, undo: bool = False) -> DataFrame:
    """``docs`` with ``text`` pseudonymised, one row per row; every other column stays.

    E-mail addresses (local part), IBANs, IPv4 addresses, dates, social security numbers, telephone numbers and payment
    card numbers are validated (check digits, ranges, calendar) and permuted within their format, so equal values have
    equal pseudonyms in all documents and pseudonyms are valid too. Where a match fails, shorter ones and later starts are
    tried; a pseudonym that would make such a match valid is permuted again (the one case of unequal pseudonyms). Invalid numbers stay. A null text stays null, an empty
    one empty. One narrow pass without any shuffle, over whole texts.
    """
    return docs.withColumn(text, replaced_texts(key, undo)(docs[text]))


def replaced_texts(key: bytes = KEY, undo: bool = False):
    """A column function for ``Pseudonyms.replace``."""

    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        work = Pseudonyms(key, undo)
        return pd.Series([work.replace(t)[0] for t in texts], dtype=object)

    return replace


def pseudonym_report(docs: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """One row per document: doc_id, text (pseudonymised), n_replaced, kinds (in order, comma-joined)."""

    def make():
        work = Pseudonyms(key)

        def batch(ids, texts):
            done = [work.replace(t) for t in texts]
            return [ids, [d[0] for d in done], [len(d[1]) for d in done], [",".join(d[1]) for d in done]]

        return batch

    return by_batch(docs.select("doc_id", text), "doc_id long, text string, n_replaced long, kinds string", make)
