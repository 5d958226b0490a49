"""Byte-level BPE over Arrow batches with the tokenizers library.

A rank file lists tokens as bytes; the tokenizers library wants strings and
merges. Each byte is given one printable character (the usual byte-to-character
table), tokens are spelt with it, and the merges are read off the ranks: every
split of a token into two known tokens is a merge, in order of the token's rank.
Texts are cut by the splitting pattern, each distinct piece is encoded once and
remembered by its packed ids, and a text's ids, their places in the text and the
decoded bytes follow from those. What a worker holds beside one text is bounded: it
shares its executor's memory with the tables of the stages that ran there before.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import release_memory, small_batches, steps, table, utf8

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Ids as they are remembered and digested.
PACKED = np.dtype("<u4")
#: Texts are encoded this many bytes at a time, whatever an Arrow batch holds; a longer text is one such step.
STEP_BYTES = 512 << 10
#: Distinct pieces, and characters in them, that a worker remembers; then it starts afresh.
MEMORY_PIECES, MEMORY_CHARACTERS = 100_000, 4 << 20
#: Pieces of a longer text that are at hand at once, and new pieces given to the library at once.
RUN_PIECES, LEARN_PIECES = 1 << 16, 1 << 12


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it can be printed, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class ByteBPE:
    """Encodes and decodes by a rank file."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.characters = byte_characters()
        self.spelling = {b: c for b, c in enumerate(self.characters)}
        self.byte_of = {c: b for b, c in enumerate(self.characters)}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            halves = [(token[:i], token[i:]) for i in range(1, len(token))]
            known = [h for h in halves if h[0] in ranks and h[1] in ranks]
            merges += sorted(known, key=lambda h: (ranks[h[0]], ranks[h[1]]))
        vocabulary = {self.spell(t): r for t, r in ranks.items()}
        # A piece that is a token as a whole needs no merge.
        # No piece is asked for twice but after memory is full, so that the library need not remember any.
        self.tokenizer = Tokenizer(BPE(vocab=vocabulary, merges=[(self.spell(a), self.spell(b)) for a, b in merges], ignore_merges=True, cache_capacity=0))
        self.pieces = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(self.byte_of[c] for c in token)  # the table, reversed
        self.sizes = np.array(list(map(len, self.bytes_of)), np.int64)
        self.forget()

    def forget(self) -> None:
        self.memory: dict[str, bytes] = {}
        self.remembered = 0

    def spell(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.spelling)

    def _learn(self, pieces: list[str]) -> None:
        """Afterwards memory has the packed ids of these pieces."""
        if len(self.memory) > MEMORY_PIECES or self.remembered > MEMORY_CHARACTERS:
            self.forget()
        new = list(set(pieces).difference(self.memory))
        for at in range(0, len(new), LEARN_PIECES):
            some = new[at : at + LEARN_PIECES]
            spelt = [self.spell(p.encode("utf-8", "replace")) for p in some]
            for piece, found in zip(some, self.tokenizer.encode_batch(spelt, add_special_tokens=False), strict=True):
                self.memory[piece] = np.array(found.ids, PACKED).tobytes()
        self.remembered += sum(map(len, new))

    def _runs(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, all at once unless it is long."""
        if len(text) <= STEP_BYTES:
            yield self.pieces.findall(text)
            return
        found = (m.group() for m in self.pieces.finditer(text))
        while run := list(islice(found, RUN_PIECES)):
            yield run

    def pack(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit integers."""
        packed = []
        for run in self._runs(text):
            self._learn(run)
            packed.append(b"".join(map(self.memory.__getitem__, run)))
        return b"".join(packed)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        return [np.frombuffer(self.pack(t), PACKED).tolist() for t in texts]

    def places(self, data: bytes, ids: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, split) of each token: the code points it covers, also in part, and whether it begins within one."""
        first = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        char_at = np.cumsum(first, dtype=np.int32) - np.int32(1)  # of each byte, the code point it belongs to
        sizes = self.sizes[ids if len(ids) else np.zeros(0, np.int64)]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        return char_at[starts], char_at[ends - 1] + 1, ~first[starts]

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """(start, end) of each token in code points; one that holds part of a character covers that character."""
        starts, ends, _ = self.places(utf8(text), ids)
        return list(zip(starts.tolist(), ends.tolist(), strict=True))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """The text; bytes that are no character, as where ids were cut within one, become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text token by token: a character split over tokens comes with its last one."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield decoder.decode(self.bytes_of[i])
        yield decoder.decode(b"", True)


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> ByteBPE:
    loaded = ByteBPE(path, pattern)
    release_memory()
    return loaded


def _lists(packed: list[bytes]) -> pa.ListArray:
    """Lists of 32-bit integers from their bytes."""
    ends = np.cumsum([0, *map(len, packed)]) // PACKED.itemsize
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids array<int>, token_starts array<int>) of every row: token ids and each token's first code point.

    A null or empty text has no ids. Rows that repeat are encoded each. Columns besides the two are not looked at.
    The files are read on the executors, from the same path on all of them.
    """
    path, pattern = path or vocabulary_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for batch in batches:
            for first, texts in steps(batch.column(1), STEP_BYTES):
                packed = [bpe.pack(t) for t in texts]
                starts = [bpe.places(utf8(t), np.frombuffer(p, PACKED))[0].tobytes() for t, p in zip(texts, packed, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), _lists(packed), _lists(starts)], [id_col, "ids", "token_starts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, token_starts array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, text) of rows of token ids; null ids are an empty text."""
    path, pattern = path or vocabulary_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for batch in batches:
            texts = [bpe.decode(i or ()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, starts_sha256, n_split): every text encoded, its ids decoded, and both
    digested; with keep_ids also ids.

    ids are digested as little-endian unsigned 32-bit integers, and so are the tokens' first code points; n_split tokens
    begin within a character. Nulls, empty and repeated rows as in encode().
    """
    path, pattern = path or vocabulary_path(), pattern or split_pattern()
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def one(bpe: ByteBPE, packed: bytes) -> tuple:
        ids = np.frombuffer(packed, PACKED)
        data = bpe.decode_bytes(ids.tolist())
        starts, _, split = bpe.places(data, ids)
        return len(ids), sha(packed), sha(data), sha(starts.astype(PACKED).tobytes()), int(split.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for batch in batches:
            at = 0
            for _, texts in steps(batch.column(1), STEP_BYTES):
                found = [bpe.pack(t) for t in texts]
                told = zip(*[one(bpe, packed) for packed in found], strict=True)
                columns = [batch.column(0).slice(at, len(texts)), *[pa.array(c, t) for c, t in zip(told, kinds, strict=True)]]
                if keep_ids:
                    columns.append(_lists(found))
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(texts)
        release_memory()

    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "starts_sha256", "n_split", *(["ids"] if keep_ids else [])]
    fields = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, starts_sha256 string, n_split long" + (", ids array<int>" if keep_ids else "")
    return small_batches(docs).select(id_col, text_col).mapInArrow(run, fields)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
