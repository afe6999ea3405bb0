"""Pseudonyms are decrypted again by a network of their own, and values are looked for by plain scans."""

import datetime
import random
import re
from hashlib import blake2b
from math import ceil, sqrt

import pytest

from rungwise.llm import pii

SMALL = "/root/testdata/sf0.001"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def undo(key, tweak, left, right, left_size, right_size):
    secret = blake2b(key.encode(), digest_size=32).digest()
    for i in (7, 6, 5, 4, 3, 2, 1, 0):
        known = left if i % 2 else right
        shift = int.from_bytes(blake2b(f"{tweak}|{i}|{known}".encode(), key=secret, digest_size=32).digest(), "big")
        if i % 2:
            right = (right - shift) % right_size
        else:
            left = (left - shift) % left_size
    return left, right


def undo_string(key, text, alphabets, tweak):
    half = len(text) // 2

    def number(low, high):
        value, size = 0, 1
        for c, a in zip(text[low:high], alphabets[low:high]):
            value, size = value * len(a) + a.index(c), size * len(a)
        return value, size

    (left, a), (right, b) = number(0, half), number(half, len(text))
    out = ""
    for value, low, high in zip(undo(key, f"{tweak}|{len(text)}", left, right, a, b), (0, half), (half, len(text))):
        part = ""
        for alphabet in reversed(alphabets[low:high]):
            value, at = divmod(value, len(alphabet))
            part = alphabet[at] + part
        out += part
    return out


def undo_number(key, x, size, tweak):
    b = ceil(sqrt(size))
    a = ceil(size / b)
    while True:
        left, right = undo(key, f"{tweak}|{size}", x // b, x % b, a, b)
        x = left * b + right
        if x < size:
            return x


def undo_classes(key, text, tweak):
    kind = lambda c: next(a for a in (DIGITS, LOWER, UPPER) if c in a)
    inner = [c for c in text if c in DIGITS + LOWER + UPPER]
    old = iter(undo_string(key, "".join(inner), [kind(c) for c in inner], tweak))
    return "".join(next(old) if c in DIGITS + LOWER + UPPER else c for c in text)


def refill(text, digits):
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in text)


def only(text):
    return "".join(c for c in text if c in DIGITS)


def undo_date(key, text):
    order = re.findall(r"\d+", text)
    first = datetime.date(1700, 1, 1).toordinal()
    size = datetime.date(2199, 12, 31).toordinal() - first + 1
    back = lambda d: datetime.date.fromordinal(first + undo_number(key, d.toordinal() - first, size, "date"))
    names = re.search(r"[A-Za-zéäû]{3,}", text.replace("de ", ""))
    if names:
        months = next(m for m in pii.MONTHS if names[0] in m)
        year, day = max(order, key=len), min(order, key=len)
        old = back(datetime.date(int(year), months.index(names[0]) + 1, int(day)))
        return old, None
    if len(order[0]) == 4:
        return back(datetime.date(*map(int, order))), None
    if "/" in text and int(order[0]) <= 12:
        return back(datetime.date(int(order[2]), int(order[0]), int(order[1]))), None
    old = back(datetime.date(int(order[2]), int(order[1]), int(order[0])))
    while "/" in text and old.day <= 12:
        old = back(old)
    return old, None


def read_date(text):
    order = re.findall(r"\d+", text)
    names = re.search(r"[A-Za-zéäû]{3,}", text.replace("de ", ""))
    if names:
        months = next(m for m in pii.MONTHS if names[0] in m)
        return datetime.date(int(max(order, key=len)), months.index(names[0]) + 1, int(min(order, key=len)))
    if len(order[0]) == 4:
        return datetime.date(*map(int, order))
    if "/" in text and int(order[0]) <= 12:
        return datetime.date(int(order[2]), int(order[0]), int(order[1]))
    return datetime.date(int(order[2]), int(order[1]), int(order[0]))


def checksum(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def same_value(key, kind, old, new):
    """Whether the pseudonym decrypts to the value, both being valid."""
    if kind == "card":
        digits = only(new)
        body = digits[0] + undo_string(key, digits[1:-1], [DIGITS] * (len(digits) - 2), "card")
        check = next(c for c in DIGITS if checksum(body + c) == 0)
        return checksum(digits) == checksum(only(old)) == 0 and refill(new, body + check) == old
    if kind == "iban":
        a, b = old.replace(" ", ""), new.replace(" ", "")
        rest = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97
        return rest(a) == rest(b) == 1 and a[:2] == b[:2] and undo_classes(key, b[4:], "iban" + b[:2]) == a[4:]
    if kind == "ssn":
        valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        digits = only(new)
        while True:
            digits = undo_string(key, digits, [DIGITS] * 9, "ssn")
            if valid(digits):
                return valid(only(new)) and refill(new, digits) == old
    if kind == "ip":
        value = 0
        for part in new.split("."):
            value = value * 256 + int(part)
        value = undo_number(key, value, 1 << 32, "ip")
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0)) == old
    if kind == "phone":
        head = 0
        if new[0] == "+":
            two = only(new)[:2] in pii.CALLING_CODES
            head = 2 if new[1] in "17" else 3 if two else 4
        planned = lambda d: d[0] not in "01" and (len(d) != 10 or d[3] not in "01")
        digits = only(new[head:])
        was = planned(digits)
        while True:
            digits = undo_string(key, digits, [DIGITS] * len(digits), "phone")
            if planned(digits) == was:
                return new[:head] == old[:head] and new[:head] + refill(new[head:], digits) == old
    if kind == "date":
        return undo_date(key, new)[0] == read_date(old)
    if kind == "email":
        (a, x), (b, y) = old.rsplit("@", 1), new.rsplit("@", 1)
        return x == y and undo_classes(key, b, "email") == a
    if kind == "access_key" and old[0] == "A":
        return old[:4] == new[:4] and undo_string(key, new[4:], [UPPER + DIGITS] * (len(new) - 4), "key") == old[4:]
    if kind == "access_key":
        at = new.index(".") + 1 if new.startswith("eyJ") else re.match(r"(gh._|xox.-)", new).end()
        return old[:at] == new[:at] and undo_classes(key, new[at:], "key") == old[at:]
    at = re.match(r"[^=:]*[=:]\s*[\"']?", new).end()
    value = new[at:]
    if re.fullmatch("[0-9a-f]+", old[at:]):
        return old[:at] == new[:at] and undo_string(key, value, [DIGITS + "abcdef"] * len(value), "hex") == old[at:]
    return old[:at] == new[:at] and undo_classes(key, value, "secret") == old[at:]


def spans_of(old, new, spans):
    """(kind, value, pseudonym): pseudonyms are where what stands around them still is."""
    at, shift, out = 0, 0, []
    for n, s in enumerate(spans):
        assert new[at + shift : s["start"] + shift] == old[at : s["start"]]
        begin = s["start"] + shift
        following = old[s["stop"] : spans[n + 1]["start"]] if n + 1 < len(spans) else old[s["stop"] :]
        # Only addresses and dates change their lengths, and neither by more than eight characters.
        for grow in sorted(range(-8, 9), key=abs):
            end = begin + s["stop"] - s["start"] + grow
            if new[end : end + len(following)] == following and (n + 1 < len(spans) or len(new) == end + len(following)):
                if s["kind"] in ("ip", "date") or not grow:
                    break
        out.append((s["kind"], old[s["start"] : s["stop"]], new[begin:end]))
        at, shift = s["stop"], end - s["stop"]
    assert new[at + shift :] == old[at:]
    return out


def test_whole_table_decrypts(spark):
    docs = spark.read.parquet(SMALL + "/documents.parquet").select("doc_id", "text")
    old = {r["doc_id"]: r["text"] for r in docs.collect()}
    kinds = {}
    for r in pii.pseudonymise(docs, pii.DEMONSTRATION_KEY).collect():
        if r["text"] is None:
            continue
        for kind, value, other in spans_of(old[r["doc_id"]], r["text"], [s.asDict() for s in r["spans"]]):
            assert same_value(pii.DEMONSTRATION_KEY, kind, value, other), (kind, value, other)
            kinds[kind] = kinds.get(kind, 0) + 1
    assert len(kinds) >= 4 and sum(kinds.values()) > 20
    # Plain scans, word by word: whatever they find has a span.
    for r in pii.op2_feistel_pii(spark, SMALL).collect():
        text = old[r["doc_id"]] or ""
        words = [w.strip(".,;:()'\"!?") for w in text.split()]
        mails = [w for w in words if re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", w)]
        ips = [w for w in words if w.count(".") == 3 and all(p.isdigit() and p.isascii() and len(p) < 4 and int(p) < 256 and (p == "0" or p[0] != "0") for p in w.split("."))]
        found = r["kinds"].split(",")
        assert found.count("email") + found.count("secret") >= len(mails) and found.count("ip") >= len(ips)
        new = set(r["text"].split()) if r["text"] else set()
        assert not [w for w in ips if w in new] or len(set(ips)) > 1


@pytest.mark.parametrize("seed", range(3))
def test_made_values_decrypt(spark, seed):
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choices(DIGITS, k=n))
    texts = []
    for _ in range(40):
        body = "4" + number(14)
        card = body + next(c for c in DIGITS if checksum(body + c) == 0)
        day = datetime.date(1700, 1, 1) + datetime.timedelta(days=rng.randrange(180_000))
        account = number(18)
        check = 98 - int("".join(str(int(c, 36)) for c in account + "DE00")) % 97
        texts.append(f"card {card}; mail {''.join(rng.choices(LOWER, k=9))}{number(2)}@mail.example.org; born {day.isoformat()} or {day.day}.{day.month}.{day.year}, seen {day:%m/%d/%Y}")
        texts.append(f"iban DE{check:02d}{account}. call +1 {number(3)}-{number(3)}-{number(4)} or +49 {number(3)} {number(4)} {number(3)}; from {rng.randrange(256)}.{rng.randrange(256)}.0.{rng.randrange(1, 256)}")
        texts.append(f"password = \"{''.join(rng.choices(LOWER + UPPER + DIGITS, k=14))}\" and AKIA{''.join(rng.choices(UPPER + DIGITS, k=16))}, id {number(3)}-{number(2)}-{number(4)}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {}
    for r in pii.pseudonymise(docs, "another key").collect():
        for kind, value, other in spans_of(texts[r["doc_id"]], r["text"], [s.asDict() for s in r["spans"]]):
            assert same_value("another key", kind, value, other), (kind, value, other)
            kinds[kind] = kinds.get(kind, 0) + 1
    assert kinds["card"] == kinds["email"] == kinds["access_key"] == kinds["secret"] == kinds["iban"] == kinds["ip"] == 40 and kinds["date"] == 120 and kinds["phone"] == 80


def test_numbers_never_share_a_pseudonym():
    p = pii.Permuter("k")
    form = next(f for k, _, f, _ in pii.KINDS if k == "phone")
    old = [f"+371 {a:02d} {b:03d} {c:02d}" for a in (10, 27, 99) for b in range(0, 1000, 7) for c in (5, 50)]
    new = [pii._phone(p, form.search(t)) for t in old]
    assert None not in new and len(set(new)) == len(old)
