import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attestor.llm import token_files as tf
from attestor.llm.common import new_folder


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**40)), max_size=700))
def test_elias_fano_selects(steps):
    values = np.cumsum(steps).tolist()
    coded = tf.EliasFano.build(values)
    again, end = tf.EliasFano.from_bytes(b"xx" + coded.to_bytes(), 2)
    assert end == 2 + len(coded.to_bytes())
    assert [again.select(i) for i in range(len(values))] == values


def test_space_is_near_minimal():
    values = np.cumsum(np.random.default_rng(1).integers(0, 1000, 100_000))
    bits = 8 * len(tf.EliasFano.build(values).to_bytes()) / len(values)
    assert bits < 2.3 + np.log2(values[-1] / len(values))


def expected(rows):
    tokenizer, start, out = Tokenizer.from_file(tf.default_path()), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_tokens", [1, 50, 1 << 25])
def test_files_give_back_the_ids(spark, file_tokens):
    rows = [(5, "Hello World's 1234 <|endoftext|>x <|STARTOFTEXT|>, WORD,. word"), (5, "Hello World's 1234 <|endoftext|>x <|STARTOFTEXT|>, WORD,. word"), (-7, None), (None, "null id"), (2**40, "Élan\x1cvital\xa0don't é ́x İΣ"), (9, ""), (12, "wörter \n" * 20_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, path string")
    got = tf.read_files(tf.write_files(docs, new_folder(spark, "t"), file_tokens=file_tokens)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows)


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, inner):
        self.inner, self.given = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.given += len(texts)
        return self.inner.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("marks_ends, most", [(True, 30), (False, 3000)])
def test_words_of_letters_share_a_call(marks_ends, most):
    letters = np.random.default_rng(4).integers(97, 123, (2000, 9)).astype(np.uint8)
    words = [bytes(row[: 1 + i % 9]).decode() for i, row in enumerate(letters)]
    texts = [" ".join(words), "\x0b".join(w.title() + "," for w in words[:700]), "  Élan\x1cvital\xa0don't é ́x İΣ 'S s't 12a <|endoftext|> <|ENDoftext|>a ", "", " \n", "startoftext the </w> w the,the"]
    encoder = tf.WordEncoder(tf.default_path(), 2)
    if not marks_ends:
        encoder.last[:] = False
    plain = encoder.tokenizer
    encoder.tokenizer = Counting(plain)
    for _ in range(2):
        assert encoder.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert encoder.tokenizer.given < most


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tf.read_files(tf.write_files(docs, new_folder(spark, "t"))).count() == 0


def test_query_over_the_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, tf.op2_token_files(spark, d).collect())) == expected(rows)
