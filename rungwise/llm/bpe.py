"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression.  A batch of texts becomes one array of code points;
a table turns code points into classes (letter, number, space, other); the neighbours of a position
turn its class into one of nine symbols.  Each symbol is a function on the eight states of a small
automaton.  Those functions, closed under composition, form a finite monoid with a multiplication
table, so that an associative scan over fixed-size chunks finds the state before every chunk, and a
second pass over all chunks at once finds every boundary.  The slices go through a bounded cache of
merged pieces of two generations; all misses of a scan are merged together: in a matrix with a piece
in each row, every round merges each row's leftmost pair of lowest rank, until none is left.

Defined results: null is the empty text (no ids); texts of any length are encoded whole, pieces of
any length are merged with a heap; special-token strings are ordinary text; equal rows give equal
results; other columns are kept by :func:`encode` unless they clash with those it adds.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm.common import small_batches, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces in a generation of a worker's cache; a full one becomes the old one, whose hits move back.
CACHE_ENTRIES = 60_000
#: Longest piece, in bytes, that goes through the matrix and the cache; a longer one has a heap.
SHORT_PIECE = 64
#: Code points that are scanned at once.
SCAN_POINTS = 1 << 18
CHUNK = 128

OTHER, LETTER, NUMBER, SPACE = range(4)

# Symbols. A tick is an apostrophe that starts a contraction of one or two letters if a token can
# start there; JOIN is the last blank before a token, LONE any other white space before a token.
S_OTHER, S_LETTER, S_NUMBER, S_SPACE, S_JOIN, S_LONE, S_TICK1, S_TICK2, S_RESET = range(9)
# States: what the token in progress is. FRESH: the next character starts a token.
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, JOINED, NEED1, NEED2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a token starts at this character)."""
    if symbol == S_RESET:
        return FRESH, True
    if symbol == S_SPACE:
        return IN_SPACE, state != IN_SPACE
    if symbol == S_JOIN:
        return JOINED, True
    if symbol == S_LONE:
        return FRESH, True
    if symbol == S_LETTER:
        if state in (NEED1, NEED2):
            return (FRESH if state == NEED1 else NEED1), False
        return IN_LETTER, state not in (IN_LETTER, JOINED)
    if symbol == S_NUMBER:
        return IN_NUMBER, state not in (IN_NUMBER, JOINED)
    if symbol in (S_TICK1, S_TICK2) and state not in (IN_OTHER, JOINED):
        return (NEED1 if symbol == S_TICK1 else NEED2), True
    return IN_OTHER, state not in (IN_OTHER, JOINED)


STEP = np.array([[_step(s, y)[0] for y in range(9)] for s in range(8)], np.uint8)
STARTS = np.array([[_step(s, y)[1] for y in range(9)] for s in range(8)], bool)


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(then[element, symbol], times[element, element], states[element, state]); element 0 is identity."""
    elements, order, then = {tuple(range(8)): 0}, [tuple(range(8))], []
    for f in order:  # grows while it is walked
        row = []
        for y in range(9):
            g = tuple(int(STEP[s, y]) for s in f)
            if g not in elements:
                elements[g] = len(order)
                order.append(g)
            row.append(elements[g])
        then.append(row)
    times = [[elements[tuple(g[s] for s in f)] for g in order] for f in order]
    return np.array(then, np.uint16), np.array(times, np.uint16), np.array(order, np.uint8)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    # The code points with the property White_Space.
    for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = SPACE
    return out


def _symbols(points: np.ndarray, reset: np.ndarray) -> np.ndarray:
    """Symbols of code points; where reset holds, a text starts (its first point stays a character)."""
    kind = _classes()[points]
    n = len(points)
    last = np.empty(n, bool)  # last character of its text
    last[:-1], last[-1] = reset[1:], True
    after = np.empty(n, np.uint8)
    after[:-1], after[-1] = kind[1:], SPACE
    after[last] = SPACE
    out = kind.copy()  # the first four symbols are the classes
    before_token = (kind == SPACE) & (after != SPACE)
    out[before_token] = np.where(points[before_token] == 0x20, S_JOIN, S_LONE)
    tick = np.flatnonzero((points == 0x27) & ~last)
    if len(tick):
        one = points[tick + 1]
        out[tick[np.isin(one, [ord(c) for c in "stmd"])]] = S_TICK1
        pair = tick[~last[tick + 1]]
        a, b = points[pair + 1], points[np.minimum(pair + 2, n - 1)]
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        out[pair[two]] = S_TICK2
    return out


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(all texts joined, starts of tokens in it with the end appended, where each text ends)."""
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    n = len(joined)
    if not n:
        return joined, np.zeros(1, np.int64), ends
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    reset = np.zeros(n, bool)
    starts = (ends - lengths)[lengths > 0]
    reset[starts] = True
    symbols = _symbols(points, reset)
    then, times, states = _monoid()
    # A text's first character acts as the reset followed by itself.
    element = then[0][symbols].astype(np.uint16)
    element[starts] = then[then[0][S_RESET], symbols[starts]]
    rows = -(-n // CHUNK)
    padded = np.zeros(rows * CHUNK, np.uint16)
    padded[:n] = element
    grid = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    total = np.zeros(rows, np.uint16)
    size, flat = times.shape[1], times.ravel()
    for column in grid:
        total = flat[total.astype(np.int32) * size + column]
    scan, gap = total, 1  # inclusive scan of the chunks' functions
    while gap < rows:
        scan = np.concatenate([scan[:gap], flat[scan[:-gap].astype(np.int32) * size + scan[gap:]]])
        gap *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = states[scan[:-1], FRESH]
    padded_symbols = np.full(rows * CHUNK, S_RESET, np.uint8)
    padded_symbols[:n] = symbols
    fresh = np.zeros(rows * CHUNK, bool)
    fresh[:n] = reset
    symbol_grid = np.ascontiguousarray(padded_symbols.reshape(rows, CHUNK).T)
    fresh_grid = np.ascontiguousarray(fresh.reshape(rows, CHUNK).T)
    begins = np.empty((CHUNK, rows), bool)
    step, opens = STEP.ravel(), STARTS.ravel()
    for j in range(CHUNK):
        at = np.where(fresh_grid[j], FRESH, state).astype(np.int16) * 9 + symbol_grid[j]
        begins[j] = opens[at]
        state = step[at]
    marks = np.flatnonzero(np.ascontiguousarray(begins.T).ravel()[:n])
    return joined, np.append(marks, n), ends


class Codec:
    """Encoder and decoder over a table of ranks: bytes of a token to its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for k, v in ranks.items():
            self.tokens[v] = k
        self.cache: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.bytes_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], v) for t, v in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs))

    @staticmethod
    def parse(content: bytes) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, which is the id of what they make; self.size if it is no token."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], self.size).astype(np.int32)

    def merge_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pieces: the adjacent pair of lowest rank, leftmost first, is merged again and again."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = (whole,)
            elif len(piece) > SHORT_PIECE:
                out[i] = self._merge_long(piece)
            else:
                by_width.setdefault(-(-len(piece) // 4) * 4, []).append(i)
        for width, rows in by_width.items():
            raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
            length = np.array([len(pieces[i]) for i in rows])
            ids = self.bytes_ids[raw]
            column, none = np.arange(width - 1), self.size
            rank = self._ranks_of(ids[:, :-1], ids[:, 1:])
            rank[column[None, :] >= length[:, None] - 1] = none
            row = np.array(rows)
            while len(row):
                at = rank.argmin(axis=1)
                every = np.arange(len(row))
                least = rank[every, at]
                if (done := least >= none).any():
                    for i, n, got in zip(row[done].tolist(), length[done].tolist(), ids[done].tolist()):
                        out[i] = tuple(got[:n])
                    keep = ~done
                    row, length, ids, rank, at, least = row[keep], length[keep], ids[keep], rank[keep], at[keep], least[keep]
                    every = every[: len(row)]
                    if not len(row):
                        break
                ids[every, at] = least
                moved = column[None, :] > at[:, None]  # what stands right of the pair moves one to the left
                ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
                rank[:, :-1] = np.where(moved[:, :-1], rank[:, 1:], rank[:, :-1])
                rank[:, -1] = none
                length = length - 1
                right = at + 1 < length
                rank[every, at] = none
                x, y = every[right], at[right]
                rank[x, y] = self._ranks_of(ids[x, y], ids[x, y + 1])
                x, y = every[at > 0], at[at > 0] - 1
                rank[x, y] = self._ranks_of(ids[x, y], ids[x, y + 1])
        return out

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap over a linked list: n log n for pieces of any length."""
        n, get = len(piece), self.ranks.get
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, length = heapq.heappop(heap)
            j = right[i] if part[i] is not None else n
            if j >= n or len(part[i]) + len(part[j]) != length:
                continue  # one of the two has been merged since
            part[i] += part[j]
            part[j] = None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
            if (h := left[i]) >= 0 and (r := get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
        return tuple(self.ranks[p] for p in part if p is not None)

    def encode_batch(self, texts: list[str]) -> Iterator[list[tuple[int, ...]]]:
        """For each text the ids of each of its pre-tokens, in order."""
        joined, marks, ends = boundaries(texts)
        bounds = marks.tolist()
        pieces = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
        got = list(map(self.cache.get, pieces))
        if None in got:
            missed = {pieces[i] for i, ids in enumerate(got) if ids is None}
            found = {k: ids for k in missed if (ids := self.old.get(k)) is not None}
            fresh = [k for k in missed if k not in found]
            found.update(zip(fresh, self.merge_all([k.encode("utf-8", "replace") for k in fresh])))
            got = [found[pieces[i]] if ids is None else ids for i, ids in enumerate(got)]
            if len(self.cache) + len(found) > CACHE_ENTRIES:
                self.cache, self.old = {}, self.cache
            self.cache.update((k, ids) for k, ids in found.items() if len(k) <= SHORT_PIECE)
        start = 0
        for stop in np.searchsorted(marks, ends).tolist():
            yield got[start:stop]
            start = stop

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(next(self.encode_batch([text]))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    """One codec a worker and vocabulary file; the file is part of every node's installation."""
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = Codec(Codec.parse(f.read()))
    return _codecs[path]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about SCAN_POINTS code points; a longer text is a run of its own."""
    run: list[str] = []
    size = 0
    for t in texts:
        if run and size + len(t) > SCAN_POINTS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _encoded(path: str, batch: pd.Series) -> Iterator[list[tuple[int, ...]]]:
    codec = _codec(path)
    for run in _groups([t if isinstance(t, str) else "" for t in batch]):
        yield from codec.encode_batch(run)


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Adds ``ids`` (the token ids of the whole text), ``token_ends`` (ids up to each pre-token's end)
    and ``decoded_ok`` (whether the ids, decoded again, are the text's bytes)."""
    path = path or default_path()

    @F.pandas_udf("struct<ids:array<int>,token_ends:array<int>,decoded_ok:boolean>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(path)
        for batch in texts:
            ids, ends, same = [], [], []
            for t, got in zip(batch, _encoded(path, batch)):
                ids.append(np.fromiter(chain.from_iterable(got), np.int32))
                ends.append(np.cumsum([len(x) for x in got], dtype=np.int32))
                same.append(codec.decode(ids[-1].tolist()) == (t.encode("utf-8", "replace") if isinstance(t, str) else b""))
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "token_ends": pd.Series(ends, dtype=object), "decoded_ok": pd.Series(same, dtype=bool)})

    added = ("ids", "token_ends", "decoded_ok")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return small_batches(docs).select(*rest, run(F.col(f"`{text}`")).alias("_bpe")).select(*rest, *[f"_bpe.{c}" for c in added])


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``: the bytes that the ids stand for."""
    path = path or default_path()

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(path)
        for batch in batches:
            yield pd.Series([codec.decode(x) if x is not None else b"" for x in batch], dtype=object)

    rest = [F.col(f"`{c}`") for c in encoded.columns if c != "decoded"]
    return small_batches(encoded).select(*rest, run(F.col(f"`{ids}`")).alias("decoded"))


def _sha256(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (of the bytes decoded from the ids), n_pretokens."""
    path = path or default_path()

    @F.pandas_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,n_pretokens:bigint>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(path)
        names = list(map(str, range(codec.size)))
        for batch in texts:
            rows = []
            for got in _encoded(path, batch):
                ids = list(chain.from_iterable(got))
                rows.append((len(ids), _sha256(",".join(map(names.__getitem__, ids)).encode()), _sha256(codec.decode(ids)), len(got)))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "n_pretokens"])

    return small_batches(docs).select("doc_id", run("text").alias("_d")).select("doc_id", "_d.*")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
