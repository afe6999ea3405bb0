"""Token counts against the library on whole texts: huge ones in chunks, sparse boundaries, odd rows."""

import random

import public_tokenizers
import pytest
import sentencepiece

from rungwise.llm import tokencounts

PATH = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(library, rows, limit=tokencounts.LIMIT):
    out = []
    for i, text in rows:
        n = len(library.encode(text or ""))
        out.append((i, len((text or "").encode()), n, n > limit))
    return sorted(out, key=str)


def counted(df):
    assert df.columns[:4] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


def texts():
    rng = random.Random(5)
    letters = ["the ", "ing", " a", "é", "日本", "𐍈", "\n\n", "  ", "1984", "<s>", "</s>", "▁", "\x00", "ß.", "!!!", "☃"]
    mixed = ["".join(rng.choices(letters, k=rng.randrange(1, 900))) for _ in range(40)]
    runs = ["a" * 3000, " " * 2500, "ab" * 1500 + " x " + "=" * 2000, "-" * 700 + "".join(rng.choices(letters, k=400)) + "0" * 900, "日" * 1000]
    return mixed + runs + ["", None, " ", "▁", "x" * 64, "x" * 80, "x" * 81]


@pytest.mark.parametrize(("chunk", "overlap"), [(1, 1), (64, 16), (300, 7), (tokencounts.CHUNK, tokencounts.OVERLAP)])
def test_chunks_count_as_whole_texts_do(spark, library, chunk, overlap):
    rows = [(i % 40, t) for i, t in enumerate(texts())] + [(None, "the cat")]
    if chunk == 1:
        rows = rows[:6] + [(9, "aaaa bbbb"), (9, None)]
    docs = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], "doc_id long, text string, row int, k string, n_tokens int")
    got = tokencounts.count_tokens(docs, PATH, 100, chunk, overlap)
    assert counted(got) == expected(library, rows, 100)
    if chunk == 64:
        chunks = {r["doc_id"]: r["n_chunks"] for r in got.collect()}
        assert max(chunks.values()) > 20


def test_stable_boundaries_hold_whatever_stands_around(library):
    model, rng = tokencounts.PieceModel(PATH), random.Random(6)
    for text in texts()[:40]:
        for at in rng.sample(list(model.stable(text)), min(5, len(model.stable(text)))):
            ids = library.encode(text)
            before = library.encode(text[:at])
            assert ids[: len(before)] == before


def test_whole_table_against_the_library(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert counted(tokencounts.op13_token_counts(spark, SMALL)) == expected(library, rows)
    assert counted(tokencounts.count_tokens(docs, chunk=500, overlap=20)) == expected(library, rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert counted(tokencounts.count_tokens(none, PATH)) == []
