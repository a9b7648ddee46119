"""Token-id files (operator 2): concatenated ids with Elias-Fano coded document boundaries and select structures.

One file holds the documents of one range of ids, in ascending order (null ids first). All integers are little-endian.

    magic "EFIDS001" | header: id width in bytes, n_null (u32 each), n_docs, n_tokens (u64 each), least document id (i64)
    boundaries: Elias-Fano of the n_docs + 1 offsets into the ids, 0 and n_tokens included
    document ids: Elias-Fano of id - least id for the documents that have one
    ids: n_tokens integers of the id width

An Elias-Fano section is: n, universe (u64 each), low bits per value, n_samples (u32 each), low bits packed (u64 words), high
bits (u64 words; value i sets bit (value >> low) + i), samples (u32: the position of every 256th set bit). It takes about
2 + log2(universe / n) bits a value; no table of 64-bit offsets exists on disk or in memory.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import broadcast_small, cut, new_folder, read, whole

MAGIC = b"EFIDS001"
SAMPLE = 256
END_ID = 2
# A file is closed at this many ids, so a writer holds a bounded part in memory.
FILE_TOKENS = 1 << 25
REMEMBERED = 1_200_000
JOINED = 256  # words that the library gets as one text


class EliasFano:
    """A non-decreasing sequence with ``select`` (value i) in near-minimal space."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def build(cls, values) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, universe = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = np.zeros((n * low_bits + 63) // 64 + 1, "<u8")
        if low_bits:
            rest = values & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, rest << bit)
            over = bit + np.uint64(low_bits) > 64
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - bit[over]))
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(places[-1]) >> 6) + 1 if n else 0, "<u8")
        np.bitwise_or.at(high, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
        return cls(n, universe, low_bits, low, high, places[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Value i: jump to the sampled bit, then count set bits word by word."""
        place = int(self.samples[i // SAMPLE])
        left, word = i % SAMPLE, place >> 6
        bits = int(self.high[word]) >> (place & 63) << (place & 63)
        while (found := bits.bit_count()) <= left:
            left -= found
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        high = (word << 6) + (bits & -bits).bit_length() - 1 - i
        if not self.low_bits:
            return high
        at = i * self.low_bits
        pair = int(self.low[at >> 6]) | (int(self.low[(at >> 6) + 1]) << 64)
        return high << self.low_bits | pair >> (at & 63) & ((1 << self.low_bits) - 1)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQII", self.n, self.universe, self.low_bits, len(self.samples))
        return head + struct.pack("<QQ", len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data, at: int) -> tuple[EliasFano, int]:
        n, universe, low_bits, n_samples, n_low, n_high = struct.unpack_from("<QQIIQQ", data, at)
        at += 40
        low = np.frombuffer(data, "<u8", n_low, at)
        high = np.frombuffer(data, "<u8", n_high, at + 8 * n_low)
        samples = np.frombuffer(data, "<u4", n_samples, at + 8 * (n_low + n_high))
        return cls(n, universe, low_bits, low, high, samples), at + 8 * (n_low + n_high) + 4 * n_samples


def pack(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """The bytes of one file; ``ids`` holds all documents' ids one after the other, ``doc_ids`` ascends with nulls first."""
    known = [i for i in doc_ids if i is not None]
    least = known[0] if known else 0
    offsets = np.concatenate([[0], np.cumsum(lengths)]) if lengths else np.zeros(1)
    head = struct.pack("<IIQQq", width, len(doc_ids) - len(known), len(doc_ids), int(offsets[-1]), least)
    return MAGIC + head + EliasFano.build(offsets).to_bytes() + EliasFano.build([i - least for i in known]).to_bytes() + ids


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token-id file")
        self.width, self.n_null, self.n_docs, self.n_tokens, self.least = struct.unpack_from("<IIQQq", data, 8)
        self.bounds, at = EliasFano.from_bytes(data, 40)
        self.doc_ids, at = EliasFano.from_bytes(data, at)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_tokens, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.doc_ids.select(i - self.n_null) + self.least

    def span(self, i: int) -> tuple[int, int]:
        return self.bounds.select(i), self.bounds.select(i + 1)


class WordEncoder:
    """Encodes texts with the tokenizers library, word by word with a memory.

    The tokenizer drops white space, never joins characters across it, splits letters from the marks behind them and lower-cases.
    So the ids of a text are those of its words, and of a word like ``Word,`` those of ``word`` and ``,``; each such part is
    given to the library once while the memory holds it. Parts of ASCII letters are given many at a time, joined by blanks: the model
    marks the last token of every word, so their ids fall apart again at those tokens.
    """

    MARKED = re.compile(r"([^\W\d_]+)([.,!?%*#$&|]+)").fullmatch
    MARKED_ASCII = re.compile(rb"([A-Za-z]+)([.,!?%*#$&|]+)").fullmatch

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = f"<u{width}"
        self.known: dict[bytes, bytes] = {}
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # whether a token stands at the end of a word
        if suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:
            for word in list(islice(known, REMEMBERED // 2)):  # the oldest half goes
                del known[word]
        split = [t.encode("utf-8").split() for t in texts]  # bytes are split at [\x20\x09-\x0D] only
        self.learn(set(chain.from_iterable(split)).difference(known))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def learn(self, words: set[bytes]) -> None:
        """Adds the words to the memory."""
        known, parts = self.known, {}
        for word in words:
            if word.isalpha():  # of bytes, only ASCII letters are letters
                parts[word] = [word.lower()]
                continue
            marked = self.MARKED_ASCII(word) if word.isascii() else self.MARKED(word.decode("utf-8"))
            pieces = [g if isinstance(g, bytes) else g.encode("utf-8") for g in marked.groups()] if marked else [word]
            parts[word] = [p.lower() if p.isalpha() else p for p in pieces]
        new = set(chain.from_iterable(parts.values())).difference(known)
        plain, single = [p for p in new if p.isalpha()], [p for p in new if not p.isalpha()]
        groups = [plain[at: at + JOINED] for at in range(0, len(plain), JOINED)]
        for group, ids in zip(groups, self.ids_of([b" ".join(g) for g in groups])):
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group):
                raw, bounds = ids.tobytes(), (ids.itemsize * np.r_[0, ends]).tolist()
                known.update(zip(group, (raw[i:j] for i, j in pairwise(bounds))))
            else:
                single += group
        known.update(zip(single, (ids.tobytes() for ids in self.ids_of(single))))
        for word, pieces in parts.items():
            known[word] = b"".join([known[p] for p in pieces])

    def ids_of(self, parts: list[bytes]) -> Iterator[np.ndarray]:
        """The library's ids of each part."""
        for at in range(0, len(parts), 4096):
            for coded in self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in parts[at: at + 4096]], add_special_tokens=False):
                yield np.array(coded.ids, self.type)


@lru_cache(maxsize=2)
def word_encoder(path: str, width: int) -> WordEncoder:
    """One per Python worker; the vocabulary file has the same path on every machine."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
    return WordEncoder(path, width)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, width: int = 2,
                end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes ``docs`` as token-id files below ``folder`` (a URI of storage that all executors share) and returns the list of files.

    Rows are range-partitioned and sorted by id (nulls first; rows repeated with one id stay next to each other), each partition
    writes files of at most about ``file_tokens`` ids. A null text has no ids but the end id. The list (``part``, ``seq``, ``path``,
    ``n_docs``, ``n_tokens``) is made by the one job that writes; each attempt writes under a name of its own, so a lost or repeated
    task leaves at most a file that no list names. ``width`` 2 fits vocabularies up to 65536 ids. An empty table gives no files.
    """
    path = path or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id")
    end = end_id.to_bytes(width, "little")

    def run(batches):
        task, seq = TaskContext.get(), 0
        doc_ids, lengths, parts, size = [], [], [], 0

        def close():
            name = f"part-{task.partitionId():06d}-{seq:04d}-{task.taskAttemptId()}.efids"
            files, base = _open(folder)
            files.create_dir(base, recursive=True)
            with files.open_output_stream(f"{base}/{name}") as out:
                out.write(pack(doc_ids, lengths, b"".join(parts), width))
            return pa.RecordBatch.from_pydict({"part": [task.partitionId()], "seq": [seq], "path": [f"{folder}/{name}"], "n_docs": [len(doc_ids)], "n_tokens": [size]}, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                for doc_id, coded in zip(ids[at: at + 256], word_encoder(path, width).encode(batch.column(1).slice(at, 256).to_pylist())):
                    doc_ids.append(doc_id)
                    parts.append(coded + end)
                    lengths.append(len(parts[-1]) // width)
                    size += lengths[-1]
                    if size >= file_tokens:
                        yield close()
                        seq += 1
                        doc_ids, lengths, parts, size = [], [], [], 0
        if doc_ids:
            yield close()

    return cut(rows.mapInArrow(run, "part int, seq int, path string, n_docs long, n_tokens long"))


def read_files(files: DataFrame) -> DataFrame:
    """One row per document of the listed files, in file order: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    The starts of the files are sums over the list, which has one row per file; within a file they come from the select structure.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))
    listed = files.select("path").join(broadcast_small(cut(starts)), "path")

    def run(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source, name = _open(path)
                with source.open_input_file(name) as opened:
                    found = TokenFile(opened.read_buffer())
                for at in range(0, found.n_docs, 4096):
                    rows = []
                    for i in range(at, min(at + 4096, found.n_docs)):
                        begin, end = found.span(i)
                        rows.append((found.doc_id(i), first + begin, end - begin, zlib.crc32(found.ids[begin:end].astype("<u4").tobytes())))
                    ids, begins, sizes, sums = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, begins, sizes, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark, d):
    return read_files(write_files(read(spark, d, "documents"), new_folder(spark, "token-files")))


QUERIES = {"op2_token_files": op2_token_files}
ORACLES: dict[str, str] = {}
