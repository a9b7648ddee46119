import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from attestor.llm import byte_bpe


@pytest.fixture(scope="module")
def theirs():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def ids(text):
    return np.frombuffer(byte_bpe.encoder(*byte_bpe.default_files()).encode(text), "<u4").tolist()


LONG = ["a" * 5000, "ab" * 3000, "aab" * 2000, " " * 5000, "\n " * 500, "!" * 777, "aaaaaaab" * 100, "é" * 1000, "\U0001f4a9" * 500, "the" * 700, "<|endoftext|> x", ""]


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_long_runs(theirs, text):
    assert ids(text) == theirs[0].encode_ordinary(text)


def test_random_texts_and_white_space(theirs):
    draw = random.Random(5)
    letters = list(" \n\t  aAbeinthéüß漢字\U0001f642‍0123'smreld!?.,-_<|>\x1c\x1f\x85 　​")
    for _ in range(8000):
        text = "".join(draw.choices(letters, k=draw.randint(0, 40)))
        assert ids(text) == theirs[0].encode_ordinary(text), text


def test_random_pieces_match_the_merges(theirs):
    draw, bpe = random.Random(6), byte_bpe.encoder(*byte_bpe.default_files())
    tokens = list(theirs[1])
    for i in range(20_000):
        piece = b"".join(draw.choices(tokens, k=draw.randint(2, 4))) if i % 2 else bytes(draw.choices(b"abcde", k=draw.randint(1, 14)))
        assert bpe.piece_ids(piece.decode("latin-1")) == theirs[0]._encode_single_piece(piece)


def test_round_trip_rows(spark, theirs):
    rows = [(1, "Hello  world\n", "x"), (1, "Hello  world\n", "x"), (None, None, None), (3, "", "y"), (4, "ä\x00 z " * 30_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    got = byte_bpe.round_trip(docs).collect()
    assert len(got) == 5
    want = sorted((str(i), len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                  for i, t, _ in rows for e in [theirs[0].encode_ordinary(t or "")])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.decode_column(byte_bpe.encode_column(docs))


def test_query_over_the_table(spark, theirs):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in byte_bpe.op9_byte_bpe(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        e = theirs[0].encode_ordinary(r.text or "")
        assert got.pop(r.doc_id)[1:] == (len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert not got
