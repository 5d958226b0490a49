import base64
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import byte_bpe
from quire.llm.byte_bpe import ByteBPE, byte_characters, decode, encode, round_trip, split_pattern, vocabulary_path
from quire.llm.common import steps


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE(vocabulary_path(), split_pattern())


@pytest.fixture(scope="module")
def judge():
    import tiktoken

    with open(vocabulary_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("judge", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_as_the_judge_encodes(bpe, judge):
    rng = random.Random(1)
    alphabet = " \n\t\u0085　abcABC019'sé漢字😀\x00​ñ٣"
    for text in ["", "a", "<|endoftext|>", "x" * 5000, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(1500))]:
        ids = bpe.encode_batch([text])[0]
        assert ids == judge.encode_ordinary(text)
        assert bpe.decode(ids) == text


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_round_trip_offsets_and_streams(text):
    bpe = test_round_trip_offsets_and_streams.bpe
    ids = bpe.encode_batch([text])[0]
    assert bpe.decode_bytes(ids) == text.encode() and "".join(bpe.decode_stream(ids)) == text
    spans = bpe.offsets(text, ids)
    assert all(0 <= a < b <= len(text) for a, b in spans) and {k for a, b in spans for k in range(a, b)} == set(range(len(text)))


test_round_trip_offsets_and_streams.bpe = ByteBPE(vocabulary_path(), split_pattern())


def test_split_characters(bpe):
    ids = [t for t in range(256) if len(bpe.bytes_of[t]) == 1 and bpe.bytes_of[t][0] in "😀".encode()]
    by_byte = {bpe.bytes_of[t][0]: t for t in ids}
    whole = [by_byte[b] for b in "😀".encode()]
    assert list(bpe.decode_stream(whole))[:4] == ["", "", "", "😀"]
    assert bpe.decode(whole[:2]) == "�"


def test_byte_characters():
    assert len(set(byte_characters())) == 256 and byte_characters()[65] == "A" and byte_characters()[32] == "Ġ"


def test_tables(spark):
    rows = [(1, "a😀é漢", 9), (2, None, 9), (3, "", 9), (None, "x", 9), (1, "a😀é漢", 9), (4, "long text " * 200_000, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = encode(frame)
    assert sorted(len(r["ids"]) == len(r["token_starts"]) for r in encoded.collect()) == [True] * 6
    assert sorted(str((r["doc_id"], r["text"])) for r in decode(encoded).collect()) == sorted(str((i, t or "")) for i, t, _ in rows)
    for r in round_trip(frame, keep_ids=True).collect():
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        bpe, text = test_round_trip_offsets_and_streams.bpe, next(t for i, t, _ in rows if i == r["doc_id"]) or ""
        starts, split, at = [], 0, 0
        inside = [k for k, c in enumerate(text) for _ in c.encode()]  # of each byte its code point
        whole = {len(text[:k].encode()) for k in range(len(text))} if len(text) < 100 else set(range(at, len(text.encode())))
        for t in r["ids"]:
            starts.append(inside[at])
            split += at not in whole
            at += len(bpe.bytes_of[t])
        assert r["starts_sha256"] == hashlib.sha256(np.array(starts, "<u4").tobytes()).hexdigest() and r["n_split"] == split
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert encode(frame.limit(0)).count() == decode(encoded.limit(0)).count() == round_trip(frame.limit(0)).count() == 0


def test_long_texts_and_full_memory(judge, monkeypatch):
    own, rng = ByteBPE(vocabulary_path(), split_pattern()), random.Random(2)
    for name, value in {"STEP_BYTES": 50, "RUN_PIECES": 7, "LEARN_PIECES": 3, "MEMORY_PIECES": 20, "MEMORY_CHARACTERS": 60}.items():
        monkeypatch.setattr(byte_bpe, name, value)
    for n in [*range(0, 120), 3000]:
        text = "".join(rng.choice(" \n\tabAB019'sé漢字😀") for _ in range(n))
        assert own.encode_batch([text, text]) == [judge.encode_ordinary(text)] * 2
        assert len(own.memory) <= 20 + 7 + 50


def test_a_worker_holds_little_beside_its_texts():
    own, rng = ByteBPE(vocabulary_path(), split_pattern()), random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    texts = pa.array([" ".join(word() for _ in range(200)) for _ in range(1500)])
    tracemalloc.start()
    try:
        for _, some in steps(texts, byte_bpe.STEP_BYTES):
            own.encode_batch(some)
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak < 60 << 20, (held, peak)
