"""Byte-level BPE encoding and decoding (operator 9).

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over strings finds every token of the vocabulary
in a piece. A piece is covered from left to right by the longest tokens whose neighbours are compatible, stepping back where a
choice leads nowhere. Two tokens are compatible when merging their joined bytes gives just these two; a sequence of pairwise compatible
tokens is the one that the merges give, so the result is exact. Ends that were tried are not tried again, which bounds the
steps by the length of the piece.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestor.llm.common import read, whole

# Distinct pieces whose ids a worker remembers; the memory is emptied when full, the result does not depend on it.
REMEMBERED = 200_000
SLICE_BYTES = 1 << 20


class ByteBpe:
    """Encoder and decoder for a rank file: each line holds a token's bytes in base64 and its rank."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.tokens = {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in pairs}
        self.bytes_of = [b""] * (max(self.tokens.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.tokens.items():
            self.bytes_of[rank] = token.encode("latin-1")
            self.automaton.add_word(token, (len(token), rank))
        self.automaton.make_automaton()
        self.pieces = regex.compile(pattern).findall
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.id_bytes = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self.compatible: dict[int, bool] = {}
        self.prefixes: dict[int, tuple[int, int] | None] = {}
        self.pieces_known: dict[str, bytes] = {}

    # A token that merges made is the merge of two halves; it exists from its own rank on, until a neighbour takes it.
    def _half(self, token: int) -> tuple[int, int] | None:
        if token not in self.halves:
            text = self.bytes_of[token].decode("latin-1")
            self.halves[token] = None if len(text) == 1 else tuple(self._merged(text, token))
        return self.halves[token]

    def _merged(self, text: str, below: int) -> list[int]:
        """Plain merging with the ranks under ``below``; used on single tokens only, to find their halves."""
        parts = list(text)
        while len(parts) > 2:
            ranks = [self.tokens.get(a + b, below) for a, b in zip(parts, parts[1:])]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] >= below:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return [self.tokens[p] for p in parts]

    def _edge(self, token: int, side: int) -> list[tuple[int, float, float]]:
        """Tokens that stand at one end while ``token`` is being merged: (id, since, until)."""
        if token in self.edges[side]:
            return self.edges[side][token]
        out, until, at = [], float("inf"), token
        while True:
            half = self._half(at)
            since = float(at) if half else -1.0
            out.append((at, since, until))
            if not half:
                self.edges[side][token] = out
                return out
            until, at = since, half[side]

    def _fits(self, left: int, right: int) -> bool:
        """No merge across the border comes before the merges that build the two tokens."""
        lefts, rights = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while i < len(lefts) and j < len(rights):
            a, a_since, a_until = lefts[i]
            b, b_since, b_until = rights[j]
            if a_since < b_until and b_since < a_until:
                across = self.tokens.get((self.bytes_of[a] + self.bytes_of[b]).decode("latin-1"))
                # A tie is the same merge at two places; the place further left goes first.
                if across is not None and across < a_until and across <= b_until:
                    return False
            if a_since >= b_since:
                i += 1
            else:
                j += 1
        return True

    def fits(self, left: int, right: int) -> bool:
        """Remembered compatibility of two adjacent tokens."""
        pair = left << 32 | right
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) >= REMEMBERED:
                self.compatible.clear()
            known = self.compatible[pair] = self._fits(left, right)
        return known

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one piece, given as Latin-1 characters for its bytes."""
        whole_id = self.tokens.get(piece)
        if whole_id is not None:
            return [whole_id]
        size = len(piece)
        longest: list[tuple[int, int] | None] = [None] * size
        for last, match in self.automaton.iter(piece):  # ends come in order, so the longest of a start is the last
            longest[last - match[0] + 1] = match
        taken: list[tuple[int, int]] = []
        dead = bytearray(size + 1)
        at, before, fits, shorter = 0, -1, self.fits, self.shorter
        option = longest[0]
        while True:
            while option is not None and (dead[at + option[0]] or before >= 0 and not fits(before, option[1])):
                option = shorter(option)
            if option is None:  # nothing fits here: this end cannot be part of the encoding
                dead[at] = 1
                last = taken.pop()
                at -= last[0]
                before = taken[-1][1] if taken else -1
                option = shorter(last)
                continue
            taken.append(option)
            at += option[0]
            if at == size:
                return [token for _, token in taken]
            before, option = option[1], longest[at]

    def shorter(self, match: tuple[int, int]) -> tuple[int, int] | None:
        """The longest token that is a proper prefix of the matched one."""
        length, token = match
        if token not in self.prefixes:
            text = self.bytes_of[token].decode("latin-1")
            self.prefixes[token] = next(((n, self.tokens[text[:n]]) for n in range(length - 1, 0, -1) if text[:n] in self.tokens), None)
        return self.prefixes[token]

    def piece_bytes(self, piece: str) -> bytes:
        """Remembered ids of one piece, as bytes."""
        ids = self.pieces_known.get(piece)
        if ids is None:
            id_bytes = self.id_bytes
            ids = b"".join([id_bytes[token] for token in self.piece_ids(piece.encode("utf-8").decode("latin-1"))])
            if len(piece) <= 64:
                if len(self.pieces_known) >= REMEMBERED:
                    self.pieces_known.clear()
                self.pieces_known[piece] = ids
        return ids

    def chunks(self, text: str) -> list[str]:
        """Cuts before a space that a character other than white space follows: a match of the pattern always starts there."""
        first, *rest = text.split(" ")
        out = [first]
        for part in rest:
            if not part or part[0].isspace():
                out[-1] += " " + part
            else:
                out.append(" " + part)
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        chunks, known = self.chunks(text), self.pieces_known
        out = list(map(known.get, chunks))
        for i, ids in enumerate(out):
            if ids is None:
                chunk = chunks[i]
                if chunk[1:].isalpha() and chunk[0] == " ":
                    out[i] = self.piece_bytes(chunk)
                else:
                    out[i] = b"".join([known.get(piece) or self.piece_bytes(piece) for piece in self.pieces(chunk)])
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> ByteBpe:
    """One per Python worker; the vocabulary file has the same path on every machine."""
    return ByteBpe(path, pattern)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def slices(batch, at_text: int, most: int = SLICE_BYTES):
    """Parts of a batch of about ``most`` bytes of text, one row at least, so that Python objects of few texts live at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at_text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def by_text(df: DataFrame, text_col: str, make, fields: str, most: int = SLICE_BYTES, drop_text: bool = False) -> DataFrame:
    """``df`` with the columns ``fields``, made from lists of whole texts by ``make``; no shuffle.

    With ``drop_text`` the texts do not travel back. A column of ``df`` that has a new column's name is an error.
    """
    names, added = df.columns, StructType.fromDDL(fields)
    clash = set(added.names) & set(names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already; rename them or drop them first")
    at_text = names.index(text_col)
    kept = [i for i in range(len(names)) if i != at_text or not drop_text]
    all_names = [*(names[i] for i in kept), *added.names]

    def run(batches):
        for batch in batches:
            for part in slices(batch, at_text, most):
                made = make([t or "" for t in part.column(at_text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *made], names=all_names)

    return df.mapInArrow(run, StructType([df.schema.fields[i] for i in kept] + added.fields))


def encode_column(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``token_ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``; a null text is empty and has no ids."""
    path, pattern = path or default_files()[0], pattern or default_files()[1]

    def make(texts):
        ids = [encoder(path, pattern).encode(t) for t in texts]
        return [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]

    return by_text(docs, text_col, make, "token_ids binary, n_tokens long")


def coded(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``token_ids``, ``n_tokens`` and ``exact`` (decoding gives the text's bytes back) in place of the text.

    Both ways run in one worker, which holds the vocabulary once.
    """
    path, pattern = path or default_files()[0], pattern or default_files()[1]

    def make(texts):
        bpe = encoder(path, pattern)
        ids = [bpe.encode(t) for t in texts]
        exact = [bpe.decode(i) == t.encode("utf-8") for i, t in zip(ids, texts)]
        return [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(exact)]

    return by_text(docs, text_col, make, "token_ids binary, n_tokens long, exact boolean", drop_text=True)


def decode_column(coded: DataFrame, ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """``coded`` with ``decoded`` (binary), the bytes of its ids."""
    path, pattern = path or default_files()[0], default_files()[1]
    names = coded.columns
    if "decoded" in names:
        raise ValueError("there is a column decoded already; rename it or drop it first")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                decoded = [encoder(path, pattern).decode(i or b"") for i in part.column(names.index(ids_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], names=[*part.schema.names, "decoded"])

    return coded.mapInArrow(run, StructType(coded.schema.fields + StructType.fromDDL("decoded binary").fields))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``. Repeated rows are kept, an empty table gives no rows."""
    path, pattern = path or default_files()[0], pattern or default_files()[1]
    rows = docs.select(F.col(id_col), whole(text_col).alias("_text"))

    def make(texts):
        bpe = encoder(path, pattern)
        counts, coded, plain = [], [], []
        for text in texts:
            ids = bpe.encode(text)
            counts.append(len(ids) // 4)
            coded.append(hashlib.sha256(ids).hexdigest())
            plain.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())]

    return by_text(rows, "_text", make, "n_tokens long, ids_sha256 string, decoded_sha256 string", drop_text=True)


def op9_byte_bpe(spark, d):
    return round_trip(read(spark, d, "documents"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLES: dict[str, str] = {}
