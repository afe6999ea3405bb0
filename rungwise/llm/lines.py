"""Line dedup: a deletion-neighbourhood join over lines, by words.

Two lines are near if their edit distance in words is within a bound: one word from NEAR_WORDS words on,
and one more for every WORDS_PER_EDIT words of the shorter line, from twice that on, MOST_EDITS at most.
In the order of their first places (doc_id, then text hash, then line number) a line stays if no earlier
line that stays equals it or is near it; so every line that goes has one that stays near it.

1. Equal lines become classes with their first place (map-side combined).
2. Bound one, for lines up to twice WORDS_PER_EDIT words (all, if the bound doesn't grow): a near pair
   shares the words of one half; classes that share no half with another stop here.  The others emit
   their variants as keys: the line itself, and the line without each word, with and without the place
   of the deletion.  Lines with an equal variant at an equal place differ in that word; a whole line that
   equals another's variant lacks that word.
3. Bounds over one, for longer lines: all variants within the bound are too many to write.  The words
   are dealt to 2k + 1 parts by a hash; k edits touch 2k parts at most, so a near pair agrees in one
   part: the variant without all other words, known by the sum of its words' hashes.  Unlike a passage, such a part spans the whole line, so
   that lines which only share a passage share no key.
4. Each round compares a line with the earliest holder of each of its keys that has not gone; lines that
   find no near one there go on to all earlier holders, behind 128 parity bits of the words, which lose
   no pair.  Candidates are verified by edit distance.  Lines near one that stays go, lines with none
   near stay, and what waits for another line's fate takes the next round.  After KEY_ROUNDS rounds the
   open lines, which are chains of near lines, are settled on the table of all their links.

Defined results: lines are split at U+000A only; blank lines always stay; lines under NEAR_WORDS words
are compared for equality only, and so are lines without ASCII blanks, being one word; null texts stay
null and empty ones empty; rows with equal doc_id and text share one fate; null ids come first in the
order; a document may lose all its lines and stays as an empty text; ``n_chars`` follows the text, and
all other columns are kept but for ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm.common import count_of, materialise, scratch, small_batches, table
from rungwise.llm.components import components

#: Words from which lines are compared for nearness; lines with a word are compared for equality.
NEAR_WORDS = 5
#: Words of the shorter line for each word of edit, from twice as many on.
WORDS_PER_EDIT = 10
MOST_EDITS = 4
#: Rounds over keys; what is open after them is settled on the table of all its links.
KEY_ROUNDS = 3
#: Links of a component up to which one task settles it, in the order of its lines.
TASK_LINKS = 1 << 19

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))

WHOLE, WITHOUT, PLACED, PART = 0, 1, 2, 3


def _place() -> Column:
    return F.struct("doc_id", "th", "pos")


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash), pos and line for every line."""
    # The hash is of a projection of its own: beside the generator it would be taken again for every line.
    split = docs.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines"))
    return split.select("doc_id", "th", F.posexplode("lines").alias("pos", "line"))


def _line_keys() -> tuple[Column, Column]:
    return F.xxhash64("line").alias("h0"), F.xxhash64(F.lit(1), "line").alias("h1")


def bound_of(n: int, most: int = MOST_EDITS) -> int:
    """Words of edit between lines of which the shorter has n words."""
    return max(1, min(most, n // WORDS_PER_EDIT))


def _part_keys(most: int) -> Column:
    """Part keys as a column, from the words' hashes in ``hs``; null for short lines. The query takes :func:`line_keys`."""

    def keys(k: int) -> Column:
        parts = 2 * k + 1
        return F.array(*[F.xxhash64(F.lit(64 * k + c), F.filter("hs", lambda h: F.pmod(h, F.lit(parts)) == c)) for c in range(parts)])

    none = F.array().cast("array<bigint>")
    dealt = []
    for k in range(2, most + 1):
        upper = F.lit(True) if k == most else F.col("n") < (k + 1) * WORDS_PER_EDIT + k
        dealt.append(F.when((F.col("n") >= k * WORDS_PER_EDIT) & upper, keys(k)).otherwise(none))
    return F.when(F.col("hs").isNotNull(), F.concat(*dealt))


def _parity(high: bool) -> Column:
    """64 parity bits of the words: an edit turns two of all 128 at most."""
    one = F.lit(1).cast("long")
    side = lambda h: F.shiftright(h, 6).bitwiseAND(one) == (1 if high else 0)
    bit = lambda h: F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate("hs", F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(F.when(side(h), bit(h)).otherwise(F.lit(0).cast("long"))))


_U = np.uint64
_BYTES = np.random.default_rng(4).integers(0, 1 << 64, 256, np.uint64)
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        x = (x ^ (x >> _U(shift))) * _U(by)
    return x ^ (x >> _U(32))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values times powers, and inverse powers: what two sums differ by, times the inverse at the first place, is a run's hash."""
    powers, inverse = (np.multiply.accumulate(np.r_[_U(1), np.full(len(values), p)]) for p in (_P, _P_INVERSE))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.add.accumulate(values * powers[:-1], out=sums[1:])
    return sums, inverse


def line_keys(data: np.ndarray, ends: np.ndarray, near_words: int, most: int) -> tuple[np.ndarray, dict[str, tuple], tuple]:
    """(words of each line, column: (values, which lines have one), (part keys, their number by line)).

    ``data`` are the lines' UTF-8 bytes, each up to its end. k0 to k3: hashes of the first and last half of a
    line's words, and of halves one shorter if n is even, as a line of n words and one of n + 1 agree on n // 2
    words at one end. Parts: sums of the hashes of a part's words, so that equal parts have equal keys. b0, b1:
    128 parity bits of the words; an edit turns two at most.
    """
    begins = np.r_[0, ends[:-1]]
    blank, some = _BLANK[data], begins < ends
    after, before = np.ones(len(data), bool), np.ones(len(data), bool)
    after[1:], before[:-1] = blank[:-1], blank[1:]
    after[begins[some]] = before[ends[some] - 1] = True
    start, end = np.flatnonzero(~blank & after), np.flatnonzero(~blank & before) + 1
    sums, inverse = _runs(_BYTES[data])
    h = _mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    low, high = np.searchsorted(start, begins), np.searchsorted(start, ends)
    n = high - low
    near = (n >= max(near_words, 1)) & ((n <= 2 * WORDS_PER_EDIT) | (most == 1))
    columns = {}
    sums, inverse = _runs(h)
    for c in range(4):
        has = near & (n % 2 == 0) if c > 1 else near
        size = n[has] // 2 - c // 2
        first = high[has] - size if c % 2 else low[has]
        values = np.zeros(len(n), np.uint64)
        values[has] = _mixed((sums[first + size] - sums[first]) * inverse[first] + _U(c % 2 + 1) * _places(size))
        columns[f"k{c}"] = values, has
    long = (n >= 2 * WORDS_PER_EDIT) & (most > 1)
    keys, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

    def summed(op: np.ufunc, value: Callable[[np.ndarray], np.ndarray], lines: np.ndarray) -> np.ndarray:
        firsts = np.cumsum(n[lines]) - n[lines]
        return op.reduceat(value(h[np.repeat(lines, n)]), firsts) if len(firsts) else np.zeros(0, np.uint64)

    for b in (0, 1):
        values = np.zeros(len(n), np.uint64)
        values[long] = summed(np.bitwise_xor, lambda x: np.where((x >> _U(6)) & _U(1) == _U(b), _U(1) << (x & _U(63)), _U(0)), long)
        columns[f"b{b}"] = values, long
    for k in range(2, most + 1):
        lines = long & (n >= k * WORDS_PER_EDIT) & ((n < (k + 1) * WORDS_PER_EDIT + k) | (k == most))
        part = (h >> _U(7)) % _U(2 * k + 1)
        again = h * _U(0x94D049BB133111EB)
        words, firsts = np.repeat(lines, n), np.cumsum(n[lines]) - n[lines]
        part, again = part[words], again[words]
        for c in range(2 * k + 1 if len(firsts) else 0):
            keys.append(_mixed(np.add.reduceat(np.where(part == _U(c), again, _U(0)), firsts) + _places(np.array([64 * k + c]))))
            of.append(np.flatnonzero(lines))
    every, of = np.concatenate(keys), np.concatenate(of)
    return n, columns, (every[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(n)), long)


def _places(x: np.ndarray) -> np.ndarray:
    return _mixed(x.astype(np.uint64) + _U(1))


def classes_of(lines: DataFrame, near_words: int = NEAR_WORDS, most: int = MOST_EDITS) -> DataFrame:
    """One row for each distinct line with a word: cid, keys, first place, copies, half keys; parts and bits of long lines."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line = batch["line"].cast(pa.large_string())
            _, offsets, data = line.buffers()
            ends = np.frombuffer(offsets, np.int64, len(line) + 1, 8 * line.offset)
            data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
            n, columns, (parts, many, long) = line_keys(data, ends[1:] - ends[0], near_words, most)
            out = {c: batch[c] for c in ("h0", "h1", "place")} | {"n": pa.array(n.astype(np.int32))}
            out |= {c: pa.array(values.view(np.int64), mask=~has) for c, (values, has) in columns.items()}
            if most > 1:
                out["parts"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), pa.array(parts.view(np.int64)), mask=pa.array(~long))
            yield pa.RecordBatch.from_pydict({c: out[c] for c in names}).filter(pa.array(n > 0))

    rows = lines.filter("line <> ''").select(*_line_keys(), _place().alias("place"), "line")
    halves = ["k0", "k1", "k2", "k3"]
    names = ["h0", "h1", "place", *halves, *(["n", "parts", "b0", "b1"] if most > 1 else [])]
    kinds = {"place": rows.schema["place"].dataType.simpleString(), "n": "int", "parts": "array<bigint>"}
    keys = small_batches(rows).mapInArrow(keyed, ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in names))
    more = [F.max("n").alias("n"), F.first("parts").alias("parts"), F.max("b0").alias("b0"), F.max("b1").alias("b1")] if most > 1 else []
    grouped = keys.groupBy("h0", "h1").agg(F.min("place").alias("first"), F.count("*").alias("copies"), *[F.max(c).alias(c) for c in halves], *more)
    return materialise(grouped.withColumn("cid", F.monotonically_increasing_id()), "line-classes")


def _with_shared_half(classes: DataFrame) -> DataFrame:
    """cid and first place of the classes that share a half with another class."""
    halves = classes.select("cid", F.explode(F.array("k0", "k1", "k2", "k3")).alias("k")).filter("k IS NOT NULL")
    shared = halves.groupBy("k").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).filter("x <> y").select("k")
    return halves.join(shared, "k", "left_semi").select("cid").distinct().join(classes.select("cid", "first"), "cid")


def _part_holders(classes: DataFrame) -> DataFrame:
    """key, role, cid, first, n and bits of the long lines whose part another class has too."""
    held = classes.filter("parts IS NOT NULL").select(F.explode("parts").alias("key"), "cid")
    shared = held.groupBy("key").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).filter("x <> y").select("key")
    return held.join(shared, "key", "left_semi").join(classes.select("cid", "first", "n", "b0", "b1"), "cid").select("key", F.lit(PART).cast("byte").alias("role"), "cid", "first", "n", "b0", "b1")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, first and line text for classes; a document's wanted lines travel as one list."""
    lists = wanted.groupBy(F.col("first.doc_id").alias("i"), F.col("first.th").alias("t")).agg(F.collect_list(F.struct("cid", F.col("first.pos").alias("pos"))).alias("wanted"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = texts.join(lists, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")))
    each = found.select("doc_id", "th", F.split("text", "\n", -1).alias("lines"), "wanted").select("doc_id", "th", "lines", F.explode("wanted").alias("w"))
    # A document that occurs twice gives its lines twice.
    return each.select(F.col("w.cid").alias("cid"), F.struct("doc_id", "th", F.col("w.pos").alias("pos")).alias("first"), F.get("lines", F.col("w.pos")).alias("line")).dropDuplicates(["cid"])


def variant_keys(words: list[str]) -> tuple[np.uint64, np.ndarray, np.ndarray]:
    """(key of the whole line, keys of the line without each word, the same with the word's place)."""
    n = len(words)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, n)
    powers = np.full(n, _P)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    prefix = np.zeros(n + 1, np.uint64)
    np.add.accumulate(hashes * powers, out=prefix[1:])
    without = prefix[:-1] + (prefix[-1] - prefix[1:]) * _P_INVERSE
    mix = lambda x, tag: (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + tag
    places = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
    return mix(prefix[-1:], np.uint64(n))[0], mix(without, np.uint64(n - 1)), mix(without, np.uint64(n) + places)


def distance_within(a: list[str], b: list[str], bound: int = 1) -> bool:
    """Whether the edit distance in words is within the bound (a banded table of what differs)."""
    if abs(len(a) - len(b)) > bound:
        return False
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    far = bound + 1
    row = {j: j for j in range(min(len(b), bound) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - bound), min(len(b), i + bound) + 1):
            new[j] = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]) if j else i)
        row = new
        if min(row.values()) > bound:
            return False
    return row[len(b)] <= bound


_CONTROLS = re.compile("[\t\x0b\x0c\r]")


def _words(line: str) -> list[str]:
    words = (_CONTROLS.sub(" ", line) if _CONTROLS.search(line) else line).split(" ")
    return [w for w in words if w] if "" in words else words


def _variant_holders(texts: DataFrame) -> DataFrame:
    """key, role, cid and first of the variants that another class has too, of a role that makes them near."""

    def variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, roles, ids, size = [], [], [], 0
            for cid, line in zip(batch["cid"], batch["line"]):
                whole, without, placed = variant_keys(_words(line))
                # Placed keys and the others never meet: the lowest bit tells them apart.
                keys += [np.array([whole]) << np.uint64(1), without << np.uint64(1), placed << np.uint64(1) | np.uint64(1)]
                n = len(without)
                roles.append(np.repeat(np.array([WHOLE, WITHOUT, PLACED], np.int8), [1, n, n]))
                ids.append(np.full(2 * n + 1, cid))
                size += 2 * n + 1
                if size > 500_000:
                    yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "role": np.concatenate(roles), "cid": np.concatenate(ids)})
                    keys, roles, ids, size = [], [], [], 0
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "role": np.concatenate(roles), "cid": np.concatenate(ids)})

    emitted = materialise(small_batches(texts).select("cid", "line").mapInPandas(variants, "key long, role byte, cid long"), "line-variants")
    # Most keys have one holder; they go before places are joined and compared.
    strong = F.min(F.when(F.col("role") != WITHOUT, F.col("cid")))
    shared = emitted.groupBy("key").agg(F.min("cid").alias("x"), F.max("cid").alias("y"), strong.alias("s")).filter("x <> y AND s IS NOT NULL").select("key")
    held = emitted.join(shared, "key", "left_semi").join(texts.select("cid", "first"), "cid")
    none = {c: F.lit(None).cast(kind) for c, kind in (("n", "int"), ("b0", "long"), ("b1", "long"))}
    return held.withColumns(none).select("key", "role", "cid", "first", "n", "b0", "b1")


def _near_pairs(pairs: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """The distinct (cid, other) whose lines are near, with the other's first place."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        both = ((_words(x), _words(y)) for x, y in zip(a, b))
        return pd.Series([distance_within(x, y, bound_of(min(len(x), len(y)), most)) for x, y in both], dtype=bool)

    lines = pairs.select("cid", "other").distinct().join(texts.select("cid", "line"), "cid")
    lines = lines.join(texts.select(F.col("cid").alias("other"), F.col("line").alias("other_line"), F.col("first").alias("near")), "other")
    return small_batches(lines).filter(near("line", "other_line")).select("cid", "other", "near")


def _gone(live: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """cid of each class that goes, and near: the first place of a class that stays and is near it.

    ``live`` holds the rows of all keys that several classes have.  A round reads the rows of the lines
    that are still open and of those that stay and share a key with them.
    """
    limit = lambda n: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(n / WORDS_PER_EDIT)))

    def close(a: str, b: str) -> Column:
        """Whether b is earlier and lengths and bits, cheapest first, allow the bound; variants need neither."""
        turned = F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))) + F.bit_count(F.col(f"{a}.b1").bitwiseXOR(F.col(f"{b}.b1")))
        k = limit(F.least(F.col(f"{a}.n"), F.col(f"{b}.n")))
        allowed = (F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")) <= k) & (turned <= 2 * k)
        return F.coalesce(allowed, F.lit(True)) & (F.col(f"{b}.first") < F.col(f"{a}.first"))

    holder = F.struct("first", "cid", "n", "b0", "b1")
    gone, opened = None, live.withColumn("stays", F.lit(False))
    for _ in range(KEY_ROUNDS):
        least = opened.groupBy("key").agg(F.min(holder).alias("any"), F.min(F.when(F.col("role") != WITHOUT, holder)).alias("strong"))
        asked = opened.filter("NOT stays").drop("stays")
        # A whole line is near every holder of its key; a line that lacks a word only near the whole ones.
        met = asked.join(least, "key").withColumn("b", F.when(F.col("role") == WITHOUT, F.col("strong")).otherwise(F.col("any")))
        met = materialise(met.select("key", "role", "cid", "first", "n", "b0", "b1", "b").filter("b.first < first").alias("a"), "line-met")
        found = materialise(_near_pairs(met.alias("a").filter(close("a", "b")).select(F.col("a.cid").alias("cid"), F.col("b.cid").alias("other")), texts, most), "line-found")
        a, b = met.drop("b").join(found.select("cid"), "cid", "left_anti").alias("a"), opened.alias("b")
        weak = (F.col("a.role") == WITHOUT) & (F.col("b.role") == WITHOUT)
        rest = a.join(b, (F.col("a.key") == F.col("b.key")) & ~weak & close("a", "b")).select(F.col("a.cid").alias("cid"), F.col("b.cid").alias("other"))
        links = materialise(found.unionByName(_near_pairs(rest, texts, most)), "line-links")
        stay = opened.select("cid", "stays").distinct().join(links.select("cid").distinct(), "cid", "left_anti").select("cid")
        going = materialise(links.join(stay.withColumnRenamed("cid", "other"), "other", "left_semi").groupBy("cid").agg(F.min("near").alias("near")), "line-going")
        gone = going if gone is None else gone.unionByName(going)
        waiting = links.select("cid").distinct().join(going, "cid", "left_anti")
        if waiting.isEmpty():
            return gone
        marked = opened.join(going, "cid", "left_anti").join(waiting.withColumn("waits", F.lit(True)), "cid", "left")
        marked = marked.withColumn("stays", F.col("waits").isNull()).drop("waits")
        keys = marked.filter("NOT stays").select("key").distinct()
        opened = materialise(marked.join(keys, "key", "left_semi"), "line-open")
    a, b = opened.filter("NOT stays").alias("a"), opened.alias("b")
    weak = (F.col("a.role") == WITHOUT) & (F.col("b.role") == WITHOUT)
    every = a.join(b, (F.col("a.key") == F.col("b.key")) & ~weak & close("a", "b")).select(F.col("a.cid").alias("cid"), F.col("b.cid").alias("other"))
    links = materialise(_near_pairs(every, texts, most).join(texts.select("cid", "first"), "cid"), "line-chains")
    return gone.unionByName(_settled(links))


def _settled(links: DataFrame) -> DataFrame:
    """cid and near of each line that goes, given all links (cid, first, other, near) of the open lines to earlier ones that haven't gone.

    Chains of near lines wait for each other one by one, so a component is settled by one task, which walks
    its lines in their order. A component of over TASK_LINKS links is settled in rounds over its links.
    """
    joined = components(links.select(F.col("cid").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "cid")
    dealt = materialise(links.join(joined, "cid"), "line-dealt")
    sizes = dealt.groupBy("component").agg(F.count("*").alias("size"))
    large = sizes.filter(F.col("size") > TASK_LINKS).select("component")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        place = lambda p: (p["doc_id"] is not None and p["doc_id"] == p["doc_id"], p["doc_id"] or 0, p["th"], p["pos"])
        earlier: dict[int, list[tuple]] = {}
        order = {}
        for cid, first, other, near in zip(rows["cid"], rows["first"], rows["other"], rows["near"]):
            order[cid] = place(first)
            earlier.setdefault(cid, []).append((place(near), other, near))
        gone: dict[int, dict] = {}
        for cid in sorted(order, key=order.get):
            near = [x for x in earlier[cid] if x[1] not in gone]
            if near:
                gone[cid] = min(near, key=lambda x: x[0])[2]
        return pd.DataFrame({"cid": pd.Series(list(gone), dtype="int64"), "near": pd.Series([dict(p) for p in gone.values()], dtype=object)})

    schema = f"cid long, near {links.schema['near'].dataType.simpleString()}"
    done = materialise(dealt.join(large, "component", "left_anti").groupBy("component").applyInPandas(walk, schema), "line-walked")
    rest = dealt.join(large, "component", "left_semi").select("cid", "other", "near")
    while not rest.isEmpty():
        rest = materialise(rest, "line-rest")
        # A line that no link leaves stays; those with a link to it go, and with them the links to them.
        going = materialise(rest.join(rest.select(F.col("cid").alias("other")).distinct(), "other", "left_anti").groupBy("cid").agg(F.min("near").alias("near")), "line-going")
        done = done.unionByName(going)
        rest = rest.join(going.select("cid"), "cid", "left_anti").join(going.select(F.col("cid").alias("other")), "other", "left_anti").select("cid", "other", "near")
    return done


def drop_list(docs: DataFrame, near_words: int = NEAR_WORDS, most: int = MOST_EDITS) -> DataFrame:
    """doc_id, th and pos of the lines that go."""
    lines = line_rows(docs)
    with scratch():
        classes = classes_of(lines, near_words, most)
        wanted, parts = _with_shared_half(classes), None
        if most > 1:
            parts = materialise(_part_holders(classes), "line-parts")
            wanted = wanted.unionByName(parts.select("cid", "first")).dropDuplicates(["cid"])
        texts = materialise(_texts_of(docs, wanted), "line-texts")
        short = texts if most == 1 else texts.join(classes.filter(F.col("k0").isNotNull()).select("cid"), "cid", "left_semi")
        live = _variant_holders(short)
        live = materialise(live if parts is None else live.unionByName(parts), "line-live")
        marked = classes.join(_gone(live, texts, most), "cid", "left").filter("copies > 1 OR near IS NOT NULL")
        limits = materialise(marked.select("h0", "h1", F.coalesce("near", "first").alias("keep")), "line-limits", keep=True)
    placed = lines.filter("line <> ''").select(*_line_keys(), _place().alias("place"))
    return placed.join(limits, ["h0", "h1"]).filter("place > keep").select("place.*")


def dedup_lines(docs: DataFrame, near_words: int = NEAR_WORDS, most: int = MOST_EDITS) -> DataFrame:
    """``docs`` with the text rewritten, n_lines and n_dropped added."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    dropped = drop_list(docs.select("doc_id", "text"), near_words, most).groupBy(F.col("doc_id").alias("i"), F.col("th").alias("t")).agg(F.collect_set("pos").alias("pos"))
    # The caller's columns travel inside one, so that no name can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.xxhash64("text").alias("th"))
    on = F.col("row.doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))
    split = rows.join(dropped, on, "left").select("row", "pos", F.when(F.col("pos").isNotNull(), F.split("row.text", "\n", -1)).alias("lines"))
    keep = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("pos")))
    kept = F.array_join(F.transform(keep, lambda i: F.get(F.col("lines"), i)), "\n")
    text = F.when(F.col("pos").isNull(), F.col("row.text")).otherwise(kept)
    counted = split.select("row", "pos", text.alias("text"))
    whole = F.col("row.text")
    new = {"text": F.col("text")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.col("pos").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast("long"))
    n_lines = F.when(whole.isNull(), 0).otherwise(count_of(whole, "\n") + 1).cast("long")
    n_dropped = F.when(F.col("pos").isNull(), 0).otherwise(F.size("pos")).cast("long")
    return counted.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_dropped")


_LETTERS = "array_to_string(list_transform(ws, lambda w: chr(CAST(33 + ('0x' || md5(w || '{0}')[1:6])::INT % 90 AS INT))), '') AS e{0}"

# Near pairs by another way: up to 20 words by equal variants of one deletion, beyond it by shared runs of
# four words, since k edits of a line of 10 k words and more leave one, then by edit distance of letters
# that stand for words (three codes, as letters are fewer than words).  The fate of lines is a recursion.
OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d),
m AS MATERIALIZED (SELECT doc_id, pos, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS ws, doc_id * 1000000 + pos AS place FROM l),
c AS MATERIALIZED (SELECT line, any_value(ws) AS ws, min(place) AS first FROM m WHERE len(ws) >= 1 GROUP BY line),
n AS MATERIALIZED (SELECT first, ws, array_to_string(ws, ' ') AS whole FROM c WHERE len(ws) >= {NEAR_WORDS}),
i AS (SELECT first, ws, unnest(range(1, len(ws) + 1)) AS gap FROM n WHERE len(ws) <= {2 * WORDS_PER_EDIT}),
v AS MATERIALIZED (SELECT first, gap, len(ws) AS k, array_to_string(list_concat(ws[1:gap - 1], ws[gap + 1:]), ' ') AS rest FROM i),
g AS (SELECT first, ws, unnest(range(1, len(ws) - 2)) AS b FROM n WHERE len(ws) >= {2 * WORDS_PER_EDIT}),
r AS MATERIALIZED (SELECT DISTINCT first, md5_number(array_to_string(ws[b:b + 3], ' ')) AS run FROM g),
e AS MATERIALIZED (SELECT first, len(ws) AS n, list_distinct(ws) AS bag, {', '.join(_LETTERS.format(i) for i in (1, 2, 3))} FROM n WHERE len(ws) >= {2 * WORDS_PER_EDIT}),
x AS (SELECT a.first AS early, b.first AS late, count(*) AS runs FROM r a JOIN r b USING (run) WHERE a.first < b.first GROUP BY ALL),
y AS (SELECT early, late, a.n AS an, b.n AS bn, greatest(1, least({MOST_EDITS}, least(a.n, b.n) // {WORDS_PER_EDIT})) AS k, a.e1 AS a1, b.e1 AS b1, a.e2 AS a2, b.e2 AS b2, a.e3 AS a3, b.e3 AS b3
  FROM x JOIN e a ON a.first = early JOIN e b ON b.first = late WHERE abs(a.n - b.n) <= 4 AND len(list_intersect(a.bag, b.bag)) >= greatest(len(a.bag), len(b.bag)) - 4),
link AS MATERIALIZED (SELECT DISTINCT early, late FROM (
  SELECT a.first AS early, b.first AS late FROM n a JOIN n b USING (whole) UNION ALL SELECT a.first, b.first FROM v a JOIN v b USING (rest, gap, k)
  UNION ALL SELECT least(v.first, n.first), greatest(v.first, n.first) FROM v JOIN n ON v.rest = n.whole
  UNION ALL SELECT early, late FROM y WHERE levenshtein(a1, b1) <= k AND levenshtein(a2, b2) <= k AND levenshtein(a3, b3) <= k) WHERE early < late),
node AS (SELECT early AS f FROM link UNION SELECT late FROM link),
fate AS (SELECT 0 AS round, f, 'open' AS s FROM node UNION ALL
  SELECT round + 1, f, CASE WHEN s <> 'open' THEN s WHEN coalesce(bool_or(es = 'stays'), false) THEN 'goes' WHEN coalesce(bool_and(es = 'goes'), true) THEN 'stays' ELSE 'open' END
  FROM (SELECT x.round, x.f, x.s, p.s AS es FROM fate x LEFT JOIN link ON link.late = x.f LEFT JOIN fate p ON p.f = link.early) WHERE (SELECT count(*) FROM fate WHERE s = 'open') > 0 GROUP BY round, f, s),
goes AS (SELECT f FROM fate GROUP BY f HAVING bool_or(s = 'goes')),
k AS (SELECT m.doc_id, m.pos, m.line, coalesce(m.place > c.first OR goes.f IS NOT NULL, false) AS dropped FROM m LEFT JOIN c ON m.line = c.line LEFT JOIN goes ON goes.f = c.first)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS text, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped
FROM k GROUP BY doc_id
"""
