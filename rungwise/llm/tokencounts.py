"""Token counts of a piece model, with huge documents encoded in overlapping chunks.

A text of up to a chunk and an overlap is counted whole.  A longer one is written once, cut into chunks
that overlap, and its chunks are dealt to all tasks.  Each is encoded with the offsets of its tokens.  Two
neighbours are spliced at a token boundary that both have in their overlap and that is proven stable: the
two characters beside it stand next to each other in no piece of the vocabulary, so that no merge can ever
join them, whatever stands around them, and the text encodes as its two sides do.  Where an overlap has no
such boundary, its document is cut again with wider overlaps, and longer chunks where the overlap needs
them; at the end stands the whole text as one chunk, so that every document is counted exactly.

The proof needs a model that takes the text as it is but for blanks (identity normalisation); any other
model's texts are all counted whole.

Defined results: null and empty texts have no bytes and no tokens; strings of special tokens are ordinary
text; equal rows are counted each for itself and give equal rows; a null id is kept; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm.common import BATCH_BYTES, materialise, scratch, small_batches, table

MODEL = "piece_bpe_32k.model"
#: Tokens up to which a document is within the limit.
LIMIT = 4096
#: Characters of a chunk besides its overlap, and of the first overlap; each further round has WIDER times more.
CHUNK, OVERLAP, WIDER = 16_384, 256, 4
#: Boundaries of an overlap that a chunk reports; if the neighbour has none of them, the overlap is widened.
MARKS = 32
_BLANK, _ESCAPED = 0x20, 0x2581
_UNKNOWN, _CONTROL, _BYTE = 2, 3, 6


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class PieceModel:
    """The library's model with what the offsets and the proof need: characters of a token, pairs inside pieces."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        self.plain = norm.name == "identity" and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        self.lead = int(norm.add_dummy_prefix and not proto.trainer_spec.treat_whitespace_as_suffix)
        self.plain = self.plain and self.lead == int(norm.add_dummy_prefix)
        # A character that is no piece becomes its bytes; only the first of them counts as a character.
        self.widths = np.array([int(p.piece[3:5], 16) & 0xC0 != 0x80 if p.type == _BYTE else 1 if p.type == _UNKNOWN else len(p.piece) for p in proto.pieces], np.int64)
        words = [p.piece for p in proto.pieces if p.type not in (_UNKNOWN, _CONTROL, _BYTE) and len(p.piece) > 1]
        self.pairs = np.unique(np.concatenate([_pairs(_points(w)) for w in words]))

    def stable(self, text: str) -> np.ndarray:
        """Positions before which no merge can cross, from 1 to the length less 1."""
        keys = _pairs(_points(text))
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.flatnonzero(self.pairs[at] != keys) + 1

    def marks(self, text: str, left: int, right: int) -> tuple[int, list, list, list, list]:
        """Tokens of a chunk; stable token boundaries in its first ``left`` and last ``right`` characters
        (counted from where the overlap begins), and how many tokens stand before each."""
        ids = np.array(self.encode(text), np.int64)
        ends = np.cumsum(self.widths[ids]) - self.lead
        if ends[-1] != len(text):
            raise ValueError("the model's tokens don't cover the text character by character")
        out: list = [len(ids)]
        for low, high in ((0, left), (len(text) - right, len(text))):
            at = self.stable(text[low:high])[: 4 * MARKS] + low
            place = np.minimum(np.searchsorted(ends, at), len(ends) - 1)
            found = np.flatnonzero(ends[place] == at)[:MARKS]
            out += [(at[found] - low).tolist(), (place[found] + 1).tolist()]
        return tuple(out)


def _points(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points[points == _BLANK] = _ESCAPED
    return points


def _pairs(points: np.ndarray) -> np.ndarray:
    return points[:-1] << 21 | points[1:]


_models: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    """One model a worker and file; the file is part of every node's installation."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _cut(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """row, k, body, left, right: chunk k of a text, and how many characters it shares with its neighbours."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, size = [], 0
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                count = max(1, -(-(len(text) - overlap) // chunk))
                for k in range(count):
                    body = text[k * chunk : len(text) if k == count - 1 else (k + 1) * chunk + overlap]
                    made.append((row, k, body, overlap if k else 0, overlap if k < count - 1 else 0))
                    size += 4 * len(body)
                    if size > BATCH_BYTES:
                        yield pd.DataFrame(made, columns=["row", "k", "body", "left", "right"])
                        made, size = [], 0
        if made:
            yield pd.DataFrame(made, columns=["row", "k", "body", "left", "right"])

    return small_batches(texts).mapInPandas(cut, "row long, k long, body string, left int, right int")


_MARKS = "n long, left_at array<int>, left_n array<int>, right_at array<int>, right_n array<int>"


def _spliced(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """row, n_tokens (null if some overlap of the document has no common stable boundary) and n_chunks."""

    @F.pandas_udf(f"struct<{', '.join(x.replace(' ', ':') for x in _MARKS.split(', '))}>")
    def marked(bodies: pd.Series, lefts: pd.Series, rights: pd.Series) -> pd.DataFrame:
        rows = [_model(path).marks(*x) for x in zip(bodies, lefts, rights)]
        return pd.DataFrame(rows, columns=["n", "left_at", "left_n", "right_at", "right_n"])

    dealt = _cut(texts, chunk, overlap).repartition("row", "k")
    units = materialise(dealt.select("row", "k", "right", marked("body", "left", "right").alias("m")).select("row", "k", "right", "m.*"), "chunks")
    ends = units.where("right > 0").select("row", (F.col("k") + 1).alias("k"), "right_at", "right_n")
    common = F.get(F.array_intersect("right_at", "left_at"), F.lit(0))
    before = lambda at, n: F.get(F.col(n), (F.array_position(at, common) - 1).cast("int"))
    # What the earlier chunk counts up to the splice, less what the later one counts before it.
    step = (before("right_at", "right_n") - before("left_at", "left_n")).cast("long")
    joined = units.where("k > 0").drop("right_at", "right_n").join(ends, ["row", "k"]).select("row", step.alias("n"))
    last = units.where("right = 0").select("row", "n")
    whole = F.when(F.count("n") == F.count("*"), F.sum("n"))
    return joined.unionByName(last).groupBy("row").agg(whole.alias("n_tokens"), F.count("*").alias("n_chunks"))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and n_chunks (how many pieces the text was encoded in) of every document."""
    path = path or default_path()
    longest = chunk + overlap if PieceModel(path).plain else (1 << 31) - 1

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        encode = _model(path).encode
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    huge = F.length(text) > longest
    base = small_batches(docs).select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("row"))
    with scratch():
        first = materialise(
            base.select(
                "row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.when(huge, F.col("text")).alias("text"),
                counted(F.when(~huge, F.col("text"))).alias("short"),
            ),
            "counted",
        )
        todo = first.where("text IS NOT NULL").select("row", "text")
        rounds: list[DataFrame] = []
        while not todo.isEmpty():
            spliced = materialise(_spliced(todo, path, chunk, overlap), "spliced")
            rounds.append(spliced.where("n_tokens IS NOT NULL"))
            todo = todo.join(spliced.where("n_tokens IS NULL"), "row", "left_semi")
            overlap *= WIDER
            chunk = max(chunk, overlap)
        found = first.drop("text")
        if rounds:
            found = found.join(reduce(DataFrame.unionByName, rounds), "row", "left")
        else:
            found = found.withColumns({"n_tokens": F.lit(None).cast("long"), "n_chunks": F.lit(None).cast("long")})
        tokens = F.coalesce("n_tokens", "short")
        out = found.select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"), F.coalesce("n_chunks", F.lit(1).cast("long")).alias("n_chunks"))
        return materialise(out, "tokens", keep=True)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
