import random

import numpy as np
import pytest
import xxhash

from quire.llm.components import connected_components
from quire.llm.simhash import bits_close, fingerprint, groups, keep_one, key_masks, links_within, near_groups, near_links, signed


def slow_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for s in "\t\n\x0b\x0c\r":
        low = low.replace(s, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(values, max_bits):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if bin((a ^ values[j]) & (1 << 64) - 1).count("1") <= max_bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", [None, "", " \n\t ", "One", "one two", "A b C d e F", "ÄÖ ü " * 30, "x " * 5000, "a\x1cb c d"])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("max_bits,wide", [(0, False), (3, False), (3, True), (5, False)])
def test_every_close_pair_meets_under_a_key(max_bits, wide):
    rng = random.Random(1)
    masks = key_masks(max_bits, wide)
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), max_bits))
        assert any(signed(flips) & m == 0 for m in masks)


def test_links_within_spans_components():
    rng = random.Random(2)
    values = np.array(list({signed(sum(1 << b for b in rng.sample(range(64), 2))) for _ in range(400)}), np.int64)
    a, b = links_within(np.zeros(len(values), int), bits_close(values, 3))
    root = list(range(len(values)))
    for x, y in zip(a, b):
        root[int(x)] = root[int(y)]
    assert len({r for r in roots([int(v) for v in values], 3)}) == len(values) - len(a)


def test_blocks_of_long_lists_lose_no_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {signed(base)}
    while len(values) < 300:
        values.add(signed((rng.choice([*values]) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) & (1 << 64) - 1))
    values = sorted(values)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    links = near_links(frame, 3, block=16)
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = roots(values, 3)
    assert [got.get(v, v) for v in values] == [values[r] for r in want]


def test_groups_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    rows, text = [], ""
    for i in range(200):
        if i % 4:
            parts = text.split(" ")
            parts[rng.randrange(len(parts))] = rng.choice(words)
            text = " ".join(parts)
        else:
            text = " ".join(rng.choice(words) for _ in range(150))
        rows.append((i, text))
    rows += [(300, None), (301, ""), (302, " "), (303, rows[7][1]), (304, rows[7][1].upper()), (None, rows[7][1]), (303, rows[7][1])]
    got = groups(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")).collect()
    assert len(got) == len(rows)
    prints = [slow_fingerprint(t) for _, t in rows]
    want = roots(prints, 3)
    least = {r: min(i for (i, _), x in zip(rows, want) if x == r and i is not None) for r in set(want)}
    expected = sorted(str((i, f"{p:016x}", least[r])) for (i, _), p, r in zip(rows, prints, want))
    assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got) == expected


def test_one_of_each_group_stays_and_empty_tables_pass(spark):
    frame = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "z"), (None, "a b c d")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in keep_one(frame).collect()) == ["1", "3", "None"]
    assert groups(frame.limit(0)).count() == 0


def test_near_copies_of_four_fifths(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    shingle_set = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    rows, near, far = [], [], []
    for i in range(0, 400, 2):
        text = [rng.choice(words) for _ in range(300)]
        edits = rng.choice((2, 4, 6, 40))
        other = list(text)
        for place in rng.sample(range(300), edits):
            other[place] = "new" + str(place)
        a, b = shingle_set(text), shingle_set(other)
        similarity = len(a & b) / len(a | b)
        (near if similarity >= 0.8 else far if similarity < 0.6 else []).append(i)
        rows += [(i, " ".join(text)), (i + 1, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 80 and len(far) > 20
    assert sum(got[i + 1] == i for i in near) >= 0.95 * len(near)
    assert all(got[i + 1] == i + 1 for i in far)


def test_links_are_exactly_the_pairs_of_four_fifths(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    shingle_set = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    rows, near = [], {}
    for i in range(0, 400, 2):
        text = [rng.choice(words) for _ in range(300)]
        other = list(text)
        for place in rng.sample(range(300), rng.randrange(5, 16)):
            other[place] = f"new{i}x{place}"
        a, b = shingle_set(text), shingle_set(other)
        similarity = len(a & b) / len(a | b)
        if 0.6 <= similarity <= 0.87:
            near[i] = similarity >= 0.8
            rows += [(i, " ".join(text)), (i + 1, " ".join(other))]
    # a is near neither b nor c in shingles, b and c are near: the pair that fails first hides no other
    text = [rng.choice(words) for _ in range(300)]
    edits = rng.sample(range(300), 9)
    b = [f"b{k}" if k in edits else w for k, w in enumerate(text)]
    c = [*b[:-1], "last"]
    rows += [(1000, " ".join(text)), (1001, " ".join(b)), (1002, " ".join(c))]
    got = {r["doc_id"]: r["component_id"] for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(near.values()) > 20 and sum(not x for x in near.values()) > 80
    assert {i: got[i + 1] == i for i in near} == near
    assert (got[1001], got[1002]) == (1001, 1001)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
