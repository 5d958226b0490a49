import random
import re
import time
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm.line_dedup import LEAST_CHARS, line_dedup
from quire.llm.sharding import byte_shards


def dedup(spark, rows, **more):
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, a int, pos string"), **more)
    return {(r["doc_id"], r["a"]): (r["text"], r["_n_lines"], r["_n_removed"]) for r in out.collect()}


def brute(docs, size=3, sentences=False):
    """Texts by id after removal: windows of lines, and of sentences, compared in order."""
    seen, out = set(), {}
    filled = lambda w: any(c not in " \t\n\r\x0b\x0c" for c in "".join(w))
    for i, text in sorted(docs.items()):
        lines = text.split("\n")
        pieces = [(n, x, len(parts) == 1) for n, line in enumerate(lines) for parts in [re.split(r"(?<=[.!?] )", line)] for x in parts]
        no_lines, no_pieces = set(), set()
        for p in range(len(lines) - size + 1):
            w = ("line", *lines[p : p + size])
            if filled(w[1:]):
                no_lines |= set(range(p, p + size)) if w in seen else set()
                seen.add(w)
        for p in range(len(pieces) - size + 1):
            some = pieces[p : p + size]
            w = ("piece", *[x for _, x, _ in some])
            if sentences and filled(w[1:]) and not all(whole for *_, whole in some) and sum(map(len, w[1:])) >= LEAST_CHARS:
                no_pieces |= set(range(p, p + size)) if w in seen else set()
                seen.add(w)
        left = {}
        for k, (n, x, _) in enumerate(pieces):
            if n not in no_lines and k not in no_pieces:
                left[n] = left.get(n, "") + x
        out[i] = "\n".join(left.values())
    return out


def test_passages_inside_lines_go(spark):
    rng = random.Random(4)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(8)) + rng.choice([". ", "! ", "? "])
    passage = "".join(sentence() for _ in range(6))
    own = {i: "".join(sentence() for _ in range(4)) for i in range(1, 5)}
    docs = {1: f"{own[1]}{passage}{own[1]}", 2: f"first\n{own[2]}{passage}last", 3: f"{passage}\n{own[3]}", 4: f"{own[4]}\n{passage[:60]}. "}
    assert {v[0] for v in dedup(spark, [(i, t, 0, "p") for i, t in docs.items()]).values()} == set(docs.values())
    got = dedup(spark, [(i, t, 0, "p") for i, t in docs.items()], sentences=True)
    assert {i: v[0] for (i, _), v in got.items()} == brute(docs, sentences=True)
    assert got[1, 0][2] == 0 and got[1, 0][0].startswith(own[1] + passage)
    assert got[2, 0][0] == f"first\n{own[2]}last" and got[3, 0][0] == f"\n{own[3]}" and got[4, 0][0] == docs[4]


def test_short_sentences_repeat_by_chance(spark):
    docs = {1: "Yes. No. Well. " + "x" * 30, 2: "Ah. Yes. No. Well. " + "y" * 30}
    assert {i: v[0] for (i, _), v in dedup(spark, [(i, t, 0, "p") for i, t in docs.items()], sentences=True).items()} == docs


def test_random_texts_against_brute_force(spark):
    rng = random.Random(9)
    sentences = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(1, 12))) + rng.choice([". ", ".", "! ", ""]) for _ in range(12)]
    docs = {i: "\n".join("".join(rng.choice(sentences) for _ in range(rng.randrange(0, 5))) for _ in range(rng.randrange(0, 6))) for i in range(150)}
    for sentences in (False, True):
        got = dedup(spark, [(i, t, 0, "p") for i, t in docs.items()], sentences=sentences)
        assert {i: v[0] for (i, _), v in got.items()} == brute(docs, sentences=sentences)


def test_very_long_texts_take_linear_time(spark):
    lines = "\n".join(f"line {i} of many" for i in range(60_000))
    line = "".join(f"This is the sentence of number {i} in one line. " for i in range(60_000))
    start = time.time()
    got = dedup(spark, [(1, f"{lines}\n{line}", 0, "p"), (2, f"{lines}\nown", 0, "p"), (3, f"own {line}", 0, "p")], sentences=True)
    assert time.time() - start < 90
    assert got[2, 0] == ("own", 60_001, 60_000) and got[3, 0][0].startswith("own This is the sentence of number 0 in one line. ") and len(got[3, 0][0]) < 200


def test_later_windows_go_and_overlaps_merge(spark):
    docs = {1: "a\nb\nc\nd\nx", 2: "q\na\nb\nc\nd\nz", 3: "same\nsame\nsame\nsame\nsame", 4: "a\nb", 5: "", 6: "\n\n\n\n", 7: "a\nb\nc\nd\nx"}
    got = dedup(spark, [(i, t, 0, "p") for i, t in docs.items()])
    assert {i: v[0] for (i, _), v in got.items()} == brute(docs)
    assert got[7, 0] == ("", 5, 5)


def test_nulls_repeats_ties_and_clashing_columns(spark):
    got = dedup(spark, [(1, None, 0, "p"), (None, "a\nb\nc", 1, "p"), (2, "a\nb\nc", 2, None), (3, "k\nl\nm", 3, "p"), (3, "k\nl\nm", 4, "p"), (4, "k\nl\nm\n" + "word " * 100_000, 5, "p")])
    assert got[1, 0] == (None, 0, 0)
    assert got[None, 1][2] == 0  # a null id comes first
    assert got[2, 2] == ("", 3, 3)
    assert got[3, 3][2] == got[3, 4][2] == 0  # rows of one id and text are one document
    assert got[4, 5][1:] == (4, 3)


def test_columns_of_any_name_stay(spark):
    names = ["_row", "_all", "_cut", "_id", "doc", "row", "id", "word", "bits", "cut", "starts", "all", "a.b", "pos"]
    rows = [(1, "a\nb\nc", *names), (2, "a\nb\nc\nd", *names), (3, None, *names)]
    frame = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = {r["doc_id"]: r for r in line_dedup(frame).collect()}
    assert all([r[n] for n in names] == names for r in got.values())
    assert got[2]["text"] == "d" and got[2]["_n_removed"] == 3 and got[3]["text"] is None
    again = {r["doc_id"]: r["_n_removed"] for r in line_dedup(line_dedup(frame)).collect()}
    assert again == {1: 0, 2: 0, 3: 0}


def test_other_names_of_id_and_text(spark):
    frame = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc")], ["id", "doc"])
    assert {tuple(r) for r in line_dedup(frame, "id", "doc").collect()} == {(1, "a\nb\nc", 3, 0, 0), (2, "", 3, 3, 0)}


def test_hot_windows_meet_over_plain_exchanges(spark):
    """The exchange below the join of windows is fed by no aggregate, so that adaptive execution can split it."""
    frame = spark.createDataFrame([(i, "a\nb\nc") for i in range(9)], "doc_id long, text string")
    out = line_dedup(frame)
    assert out.where("_n_removed = 3").count() == 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan  # cuts and repeated windows were written before


def test_empty_table(spark):
    assert dedup(spark, []) == {}
    assert byte_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n_shards", [1, 7])
def test_shards_against_brute_force(spark, n_shards):
    rows = [(i, "wörd " * (i * 7 % 50)) for i in range(300)] + [(None, None), (5, "wörd " * 35), (400, "x" * 30_000)]
    frame = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, shard int")
    got = byte_shards(frame, n_shards).collect()
    assert len(got) == len(rows)

    def order(row):
        i, t = row
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return h - (1 << 64) if h >> 63 else h, -1 if i is None else i

    laid, sizes = sorted(rows, key=order), []
    total, run = sum(len((t or "").encode()) + 16 for _, t in rows), 0
    for i, t in laid:
        size = len((t or "").encode()) + 16
        run += size
        sizes.append((i, size, zlib.crc32((t or "").encode()), min(n_shards - 1, (2 * run - size) * n_shards // (2 * total))))
    assert sorted(map(str, sizes)) == sorted(str((r["doc_id"], r["size"], r["text_crc32"], r["shard"])) for r in got)
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_equal_texts_lie_side_by_side(spark):
    got = byte_shards(spark.createDataFrame([(i, f"text {i % 10}") for i in range(100)], "doc_id long, text string"), 1).orderBy("slot").collect()
    crcs = [r["text_crc32"] for r in got]
    assert sum(a != b for a, b in zip(crcs, crcs[1:])) == 9


def test_a_filter_on_what_is_left_stays_linear(spark):
    text = "\n".join(f"line {i} of many" for i in range(20_000))
    frame = spark.createDataFrame([(i, f"{text}\nown {i}") for i in range(3)], "doc_id long, text string")
    start = time.time()
    out = line_dedup(frame)
    assert {r["text"] for r in out.where(F.col("text").rlike("own [0-9]") & (F.col("_n_removed") > 0)).collect()} == {"own 1", "own 2"}
    assert time.time() - start < 60
