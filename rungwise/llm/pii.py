"""PII: format-preserving Feistel pseudonyms for validated numbers, dates, addresses and secrets.

A value is found by its form, validated (Luhn, IBAN check digits, octets, calendar, number plans) and
replaced by another valid value of the same form: an alternating Feistel network over the value's
positions, keyed by BLAKE2b, permutes all values of that form.  Equal values get equal pseudonyms
in every document and run under one key, whatever their punctuation; different ones stay different.
Where a form has gaps (calendar, octets, number plans) the permutation walks its cycle until it is
back inside the form, which keeps it one-to-one.

Defined results: null stays null and empty stays empty, with no values; text outside the values is
kept to the character; where forms overlap the earlier kind of KINDS wins; a value that fails its
check is left alone; texts of any length are searched whole; equal rows get equal rows; columns other
than the text are kept unless they clash with ``n_values`` and ``spans``.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm.common import small_batches, table

ROUNDS = 8
#: The registered query's key where the session names none in ``rungwise.pii.key``. It protects nothing.
DEMONSTRATION_KEY = "rungwise demonstration key"

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLASS = {c: alphabet for alphabet in (DIGITS, LOWER, UPPER) for c in alphabet}
FIRST_DAY, LAST_DAY = datetime.date(1700, 1, 1).toordinal(), datetime.date(2199, 12, 31).toordinal()

# Calling codes of two digits (1 and 7 are the codes of one, all others have three).
CALLING_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Month names of the corpus's languages.
MONTHS = (
    "January February March April May June July August September October November December".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
)


class Permuter:
    """Keyed permutations of numbers below a bound and of strings over alphabets."""

    def __init__(self, key: str):
        self.key = blake2b(key.encode(), digest_size=32).digest()

    def _round(self, tweak: str, i: int, value: int) -> int:
        return int.from_bytes(blake2b(f"{tweak}|{i}|{value}".encode(), key=self.key, digest_size=32).digest(), "big")

    def pair(self, left: int, right: int, left_size: int, right_size: int, tweak: str) -> tuple[int, int]:
        """The Feistel network itself: one half is shifted by a keyed function of the other, in turn."""
        for i in range(ROUNDS):
            if i % 2:
                right = (right + self._round(tweak, i, left)) % right_size
            else:
                left = (left + self._round(tweak, i, right)) % left_size
        return left, right

    def number(self, x: int, size: int, tweak: str) -> int:
        """A permutation of 0 .. size-1: of a rectangle just over it, walked until back inside."""
        b = isqrt(size - 1) + 1 if size > 1 else 1
        a = -(-size // b)
        while True:
            left, right = self.pair(x // b, x % b, a, b, f"{tweak}|{size}")
            x = left * b + right
            if x < size:
                return x

    def string(self, text: str, alphabets: list[str], tweak: str) -> str:
        """A permutation of the strings with those alphabets by position."""
        half = len(text) // 2
        values, sizes = [0, 0], [1, 1]
        for i, (c, alphabet) in enumerate(zip(text, alphabets)):
            side = i >= half
            values[side] = values[side] * len(alphabet) + alphabet.index(c)
            sizes[side] *= len(alphabet)
        values = list(self.pair(*values, *sizes, f"{tweak}|{len(text)}"))
        out = []
        for i in range(len(text) - 1, -1, -1):
            side, n = i >= half, len(alphabets[i])
            out.append(alphabets[i][values[side] % n])
            values[side] //= n
        return "".join(reversed(out))

    def walk(self, x, step: Callable, inside: Callable):
        x = step(x)
        while not inside(x):
            x = step(x)
        return x


def luhn(digits: str) -> int:
    """The digit that makes ``digits`` and it pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _fill(pattern: str, replaced: str, of: Callable[[str], bool] = str.isdigit) -> str:
    """``pattern`` with the characters that ``of`` picks replaced in order."""
    it = iter(replaced)
    return "".join(next(it) if of(c) else c for c in pattern)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _CLASS and _CLASS[c] is DIGITS)


def _same_classes(p: Permuter, text: str, kind: str) -> str:
    """Permutes letters and digits within their classes; everything else stays."""
    inner = "".join(c for c in text if c in _CLASS)
    return _fill(text, p.string(inner, [_CLASS[c] for c in inner], kind), _CLASS.__contains__) if inner else text


def _card(p: Permuter, m: re.Match) -> str | None:
    digits = _digits(m.group())
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = digits[0] + p.string(digits[1:-1], [DIGITS] * (len(digits) - 2), "card")
    return _fill(m.group(), body + str(luhn(body)))


def _iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban(p: Permuter, m: re.Match) -> str | None:
    """The pseudonym of the longest run of groups that passes; words after the value may fit the form too."""
    text = m.group()
    while text:
        plain = text.replace(" ", "")
        if 15 <= len(plain) <= 34 and _iban_check(plain[:2], plain[4:]) == plain[2:4]:
            account = _same_classes(p, plain[4:], "iban" + plain[:2])
            return _fill(text, plain[:2] + _iban_check(plain[:2], account) + account, str.isalnum)
        text = text.rpartition(" ")[0]
    return None


def _ssn(p: Permuter, m: re.Match) -> str | None:
    inside = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = _digits(m.group())
    return _fill(m.group(), p.walk(digits, lambda d: p.string(d, [DIGITS] * 9, "ssn"), inside)) if inside(digits) else None


def _ip(p: Permuter, m: re.Match) -> str | None:
    octets = m.group().split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    value = 0
    for o in octets:
        value = value * 256 + int(o)
    value = p.number(value, 1 << 32, "ip")
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _calling_code(digits: str) -> str:
    return digits[: 1 if digits[0] in "17" else 2 if digits[:2] in CALLING_CODES else 3]


def _phone(p: Permuter, m: re.Match) -> str | None:
    text = m.group()
    head = text[: 1 + len(_calling_code(_digits(text)))] if text[0] == "+" else ""
    digits = _digits(text[len(head) :])
    if not 7 <= len(digits) <= 14:
        return None
    inside = lambda d: d[0] not in "01" and (len(d) != 10 or d[3] not in "01")
    step = lambda d: p.string(d, [DIGITS] * len(d), "phone")
    # Numbers of the plan and all others stay among themselves, or two could meet in one pseudonym.
    was = inside(digits)
    return head + _fill(text[len(head) :], p.walk(digits, step, lambda d: inside(d) == was))


def _moved(p: Permuter, day: int) -> datetime.date:
    return datetime.date.fromordinal(FIRST_DAY + p.number(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))


def _written_date(p: Permuter, m: re.Match) -> str | None:
    """A date with a month's name: the pseudonym of the same day in figures, in the same language and order."""
    name = m.group("month")
    for months in MONTHS:
        if name in months:
            break
    else:
        return None
    try:
        day = datetime.date(int(m.group("year")), months.index(name) + 1, int(m.group("day"))).toordinal()
    except ValueError:
        return None
    new = _moved(p, day)
    parts = sorted((m.start(k) - m.start(), m.end(k) - m.start(), v) for k, v in (("day", str(new.day)), ("month", months[new.month - 1]), ("year", str(new.year))))
    text, out, at = m.group(), [], 0
    for a, b, v in parts:
        out += [text[at:a], v]
        at = b
    return "".join([*out, text[at:]])


def _date(p: Permuter, m: re.Match) -> str | None:
    text = m.group()
    mark = next(c for c in text if not c.isdigit())
    a, b, c = text.split(mark)
    orders = ((0, 1, 2),) if len(a) == 4 else ((2, 0, 1), (2, 1, 0)) if mark == "/" else ((2, 1, 0),)
    for y, mo, d in orders:
        parts = [a, b, c]
        try:
            day = datetime.date(int(parts[y]), int(parts[mo]), int(parts[d])).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = _moved(p, day)
        # Day-first dates with slashes are those that can't be read month-first; they stay among themselves.
        while (y, mo, d) == (2, 1, 0) and mark == "/" and new.day <= 12:
            new = _moved(p, new.toordinal())
        padded = all(len(x) > 1 for x in parts)
        parts[y] = str(new.year)
        parts[mo], parts[d] = (f"{new.month:02d}", f"{new.day:02d}") if padded else (str(new.month), str(new.day))
        return mark.join(parts)
    return None


def _email(p: Permuter, m: re.Match) -> str | None:
    name, domain = m.group().rsplit("@", 1)
    return _same_classes(p, name, "email") + "@" + domain


def _access_key(p: Permuter, m: re.Match) -> str | None:
    if m.group()[0] == "A":
        return m.group()[:4] + p.string(m.group()[4:], [UPPER + DIGITS] * (len(m.group()) - 4), "key")
    name = "body" if m.group("body") else "jwt"
    begin = m.start(name) - m.start()
    return m.group()[:begin] + _same_classes(p, m.group(name), "key")


def _secret(p: Permuter, m: re.Match) -> str | None:
    value = m.group("value")
    if re.fullmatch("[0-9a-f]+", value):
        new = p.string(value, [DIGITS + "abcdef"] * len(value), "hex")
    else:
        new = _same_classes(p, value, "secret")
    begin = m.start("value") - m.start()
    return m.group()[:begin] + new + m.group()[begin + len(value) :]


# kind, what a text must hold for the form to occur, form, replacement
KINDS: tuple[tuple[str, str | tuple[str, ...], re.Pattern, Callable], ...] = (
    ("secret", "=:", re.compile(r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9+/_\-]{8,})"), _secret),
    ("access_key", ("AKIA", "ASIA", "gh", "xox", "eyJ"), re.compile(r"\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?:gh[pousr]_|xox[abprs]-)(?P<body>[A-Za-z0-9-]{20,}))(?![A-Za-z0-9])|\beyJ[A-Za-z0-9_-]{8,}\.(?P<jwt>[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"), _access_key),
    ("email", "@", re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), _email),
    ("iban", DIGITS, re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), _iban),
    ("card", DIGITS, re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}(?P<gap6>[ -])\d{6}(?P=gap6)\d{5})(?![\w-])"), _card),
    ("date", DIGITS, re.compile(r"(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)"), _date),
    ("date", DIGITS, re.compile(r"(?<!\w)(?:(?P<day>\d{1,2})(?:st|nd|rd|th|\.)? (?:de )?(?P<month>[A-Za-zéäû]{3,10}),? (?:de )?(?P<year>\d{4}))(?!\w)"), _written_date),
    ("date", DIGITS, re.compile(r"(?<!\w)(?P<month>[A-Z][a-z]{2,8}) (?P<day>\d{1,2})(?:st|nd|rd|th)?,? (?P<year>\d{4})(?!\w)"), _written_date),
    ("ssn", DIGITS, re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), _ssn),
    ("ssn", DIGITS, re.compile(r"(?<=SSN |SN: )\d{3} \d{2} \d{4}(?![\w-])"), _ssn),
    ("ip", DIGITS, re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"), _ip),
    ("phone", DIGITS, re.compile(r"(?<![\w+.-])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+(?!1[ .(-])\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])"), _phone),
)
_ANY_DIGIT = re.compile("[0-9]")


def _found(p: Permuter, text: str, kind: str, form: re.Pattern, replace: Callable) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of one kind.  An IBAN's match may run into what follows, another IBAN too: it
    ends where its pseudonym does, and one that fails gives up its first four characters only."""
    m = form.search(text)
    while m:
        to, end = replace(p, m), m.end()
        if kind == "iban":
            end = m.start() + (4 if to is None else len(to))
        if to is not None:
            yield m.start(), end, to
        m = form.search(text, end)


def replacements(p: Permuter, text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the values in a text, in order and without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    digit = _ANY_DIGIT.search(text) is not None
    for kind, needs, form, replace in KINDS:
        if not (digit if needs is DIGITS else any(c in text for c in needs)):
            continue
        new = [(a, b, kind, to) for a, b, to in _found(p, text, kind, form, replace)]
        if new:  # what is taken is hidden from the kinds that follow
            parts, at = [], 0
            for a, b, _, _ in new:
                parts += [text[at:a], "\0" * (b - a)]
                at = b
            text = "".join([*parts, text[at:]])
        found += new
    return sorted(found)


def pseudonymised(p: Permuter, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
    found, out, at = replacements(p, text), [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return ("".join([*out, text[at:]]) if found else text), found


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the text rewritten, ``n_values``, and ``spans`` (kind, start and end in the old text).

    The key is given or the session's ``rungwise.pii.key``; without one there are no pseudonyms but an error.
    """
    key = key or docs.sparkSession.conf.get("rungwise.pii.key", None)
    if not key:
        raise ValueError("no key: give one, or set rungwise.pii.key")

    @F.pandas_udf("struct<text:string,spans:array<struct<kind:string,start:int,stop:int>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = Permuter(key)
        for batch in batches:
            rows = [pseudonymised(p, t) if isinstance(t, str) else (None, []) for t in batch]
            yield pd.DataFrame({"text": pd.Series([r[0] for r in rows], dtype=object), "spans": [[{"kind": k, "start": a, "stop": b} for a, b, k, _ in r[1]] for r in rows]})

    kept = [c for c in docs.columns if c not in ("n_values", "spans")]
    done = small_batches(docs).select(*[F.col(f"`{c}`") for c in kept], run(F.col(f"`{text}`")).alias("_pii"))
    out = [F.col("_pii.text").alias(text) if c == text else F.col(f"`{c}`") for c in kept]
    return done.select(*out, F.size("_pii.spans").cast("long").alias("n_values"), F.col("_pii.spans").alias("spans"))


def op2_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the rewritten text, the number of values, and the kinds of the values in order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pseudonymise(docs, spark.conf.get("rungwise.pii.key", DEMONSTRATION_KEY))
    return done.select("doc_id", "text", "n_values", F.array_join(F.transform("spans", lambda s: s["kind"]), ",").alias("kinds"))
