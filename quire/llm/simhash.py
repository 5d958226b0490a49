"""SimHash near-duplicates through an inverted index of positional bytes.

A 64-bit fingerprint is eight bytes at eight positions. Two fingerprints that
differ in at most k bits share at least 8 - k of them in place. The index lists
fingerprints by positional bytes; a posting key takes several positions at once,
chosen so that every pair with the guaranteed number of matches meets in at least
one list. Within a list the shared positional bytes of each pair are tallied,
pairs below the guaranteed minimum dropped, and the rest verified bit by bit.
Lists hold distinct fingerprints only, so copies cost nothing; a long list is cut
into blocks that are compared two by two in tasks of their own.

Texts that share four fifths of their shingles differ in about ten of 64 majority
bits, more than eight bytes can guarantee matches for. Where such near copies are
wanted too (keep_one), a second fingerprint goes through the same kind of index: 128
positional bytes, each told by the least of the shingles' hashes in one of 128
orders, so that two texts match in a position as often as they share shingles. Its
matches only propose pairs: a link is one whose shingle sets, read again, are similar.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, durable, release_disk, small_batches, table, utf8
from quire.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints of one block of a long list; a task compares two blocks at once.
BLOCK = 512
#: From so many distinct fingerprints on, keys take all the guaranteed positions: more keys, shorter lists.
WIDE_KEYS_FROM = 1 << 27
#: Hashes whose bits are counted at once.
STEP_HASHES = 1 << 16
#: Bytes of the second fingerprint, positions of each of its posting keys, the first position of each key, and the least
#: matches of a pair whose shingles are compared: texts of similarity 0.8 reach them in 999 of 1,000 cases.
POSITIONS, KEY_POSITIONS, LEAST_MATCHES = 128, 5, 88
KEY_STARTS = [*range(0, POSITIONS - KEY_POSITIONS, KEY_POSITIONS), POSITIONS - KEY_POSITIONS]
#: Near copies share at least this part of their distinct shingles.
LEAST_SIMILARITY = 0.8


def shingles(words: list[bytes], size: int) -> Iterator[bytes]:
    """Runs of `size` words joined by single spaces, repeats included; fewer words are one run."""
    if len(words) <= size:
        return iter([b" ".join(words)] if words else [])
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    return (joined[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True))


def hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of the shingles, big-endian bytes in rows of eight."""
    digest = xxhash.xxh64_digest
    words = ascii_lower(utf8(text)).split()
    return np.frombuffer(b"".join([digest(s, SEED) for s in shingles(words, size)]), np.uint8).reshape(-1, 8)


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The 64 majority bits of the shingles' XXH64; a bit set in just half of them is 0, as is a text without words."""
    return majority(hashes(text, size))


def majority(raw: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(raw), STEP_HASHES):
        counts += np.unpackbits(raw[at : at + STEP_HASHES], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(raw)).tobytes(), "big")


def _orders() -> tuple[np.ndarray, np.ndarray]:
    """What hashes are mixed with for each position: fixed numbers from a fixed seed."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    return rng.integers(0, 1 << 64, POSITIONS, np.uint64), rng.integers(0, 1 << 63, POSITIONS, np.uint64) * np.uint64(2) + np.uint64(1)


FLIPS, FACTORS = _orders()


def positional_bytes(raw: np.ndarray) -> bytes:
    """The second fingerprint; zeros for a text without words."""
    if not len(raw):
        return bytes(POSITIONS)
    values = raw.view(">u8").reshape(-1).astype(np.uint64)
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 512):
        np.minimum(least, ((values[at : at + 512] ^ FLIPS[:, None]) * FACTORS[:, None]).min(axis=1), out=least)
    return (least & np.uint64(0xFF)).astype(np.uint8).tobytes()


def shingle_set(raw: np.ndarray) -> np.ndarray:
    """The distinct hashes in order."""
    return np.unique(raw.view(">u8").reshape(-1).astype(np.uint64))


def set_name(members: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(members.tobytes(), SEED))


def similar(a: bytes, b: bytes, least: float = LEAST_SIMILARITY) -> bool:
    """Whether shingle sets share `least` of their union; two empty ones are equal."""
    n, m = len(a) // 8, len(b) // 8
    if min(n, m) < least * max(n, m):
        return False
    both = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
    return both >= least * (n + m - both)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def key_masks(max_bits: int, wide: bool = False) -> list[int]:
    """Bit masks of the positions of each posting key; any two values within max_bits agree under one at least.

    8 - max_bits positions agree. For three bits that is five of eight, of which three lie in one half: the eight
    triples within a half are enough. Otherwise, or for wide keys, every choice of the guaranteed positions is a key.
    """
    if not 0 <= max_bits <= 5:
        raise ValueError("fingerprints of eight bytes guarantee matches for 0 to 5 differing bits")
    if max_bits <= 3 and not wide:
        chosen = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
    else:
        chosen = [*combinations(range(8), 8 - max_bits)]
    return [signed(sum(0xFF << (8 * p) for p in positions)) for positions in chosen]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [signed(fingerprint(t.as_py(), size)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["_id", "fp"])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _least_labels(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """labels after the pairs (a, b) of rows are joined: each row's is the least row it is linked to."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while not np.array_equal(labels, jumped := labels[labels]):
            labels = jumped
    return labels


def links_within(group: np.ndarray, close, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that span what close(a, b), of arrays of places, connects within runs of equal group numbers.

    labels: of each place the least one that it is linked to beforehand.
    """
    labels = np.arange(len(group)) if labels is None else labels
    at, step = np.arange(len(group)), 0
    while len(at):
        step += 1
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        # what is linked already needs no comparison
        new = at[labels[at] != labels[at + step]]
        new = new[close(new, new + step)]
        labels = _least_labels(new, new + step, labels)
    linked = np.flatnonzero(labels != np.arange(len(group)))
    return linked, labels[linked]


def bits_close(values: np.ndarray, max_bits: int):
    """Whether fingerprints differ in max_bits at most: positional matches are tallied first, then bits."""
    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differ = values[a] ^ values[b]
        near = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - max_bits
        near[near] = np.bitwise_count(differ[near].view(np.uint64)) <= max_bits
        return near

    return close


def bytes_close(values: np.ndarray, least: int):
    """Whether rows of positional bytes match in `least` places."""
    return lambda a, b: (values[a] == values[b]).sum(axis=1) >= least


def _compared(make_close):
    """Over rows (c, key, i, j, name, value) in order of their list and block pair: links between names, a list at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def found(lists: np.ndarray, values: list) -> pa.RecordBatch:
            new = np.concatenate(([False], (lists[1:, :4] != lists[:-1, :4]).any(axis=1)))
            a, b = links_within(np.cumsum(new), make_close(values))
            return pa.RecordBatch.from_arrays([pa.array(lists[a, 4], pa.int64()), pa.array(lists[b, 4], pa.int64())], ["a", "b"])

        for batch in batches:
            lists = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], axis=1)
            values = batch.column(5).to_pylist()
            if rest is not None:
                lists, values = np.concatenate((rest[0], lists)), rest[1] + values
            if not len(lists):
                continue
            last = np.flatnonzero((lists[:, :4] != lists[-1, :4]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last list may go on in the next batch
            rest = lists[cut:], values[cut:]
            if cut:
                yield found(lists[:cut], values[:cut])
        if rest is not None and len(rest[0]):
            yield found(*rest)

    return run


def _lists(keys: DataFrame) -> DataFrame:
    """The rows (c, key, name) of the lists with two names and more, and n, the names of the list."""
    counts = durable(keys.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1"))
    return keys.join(counts, ["c", "key"]).select("c", "key", "name", "n")


def _dealt(listed: DataFrame, values: DataFrame | None, block: int) -> DataFrame:
    """Rows (c, key, name, n) with the values (name, value), dealt in pairs of blocks of their list."""
    blocked = listed.select("c", "key", "name", F.expr(f"cast(ceil(n / {block}) as int)").alias("blocks"))
    own = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    paired = blocked.select("c", "key", "name", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "c", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "name"
    )
    with_values = paired.join(values, "name") if values is not None else paired.withColumn("value", F.col("name"))
    return _by_list(with_values.select("c", "key", "i", "j", "name", "value"))


def _by_list(rows: DataFrame) -> DataFrame:
    return rows.repartition("c", "key", "i", "j").sortWithinPartitions("c", "key", "i", "j", "name")


def near_links(values: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b) between fingerprints of `values` (distinct, column fp) that span the components of all links."""
    masks = key_masks(max_bits, wide=values.count() >= WIDE_KEYS_FROM)
    keys = values.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("c", "key")
    )
    close = lambda values: bits_close(np.array(values, np.int64), max_bits)
    return _dealt(_lists(keys.withColumnRenamed("fp", "name")), None, block).mapInArrow(_compared(close), "a long, b long")


def _keys_of(values: DataFrame) -> DataFrame:
    part = lambda at: F.conv(F.hex(F.substring("value", at + 1, KEY_POSITIONS)), 16, 10).cast("long")
    return values.select("name", F.posexplode(F.array(*[part(at) for at in KEY_STARTS])).alias("c", "key"))


def _rows_of_bytes(found: list) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, found)), np.uint8).reshape(-1, POSITIONS)


def positional_links(values: DataFrame, least: int = LEAST_MATCHES, block: int = BLOCK, listed: DataFrame | None = None) -> DataFrame:
    """(a, b) between the names of second fingerprints (name, value; distinct) that span what `least` matches connect.

    listed: the lists of their keys, where they are known."""
    return _dealt(_lists(_keys_of(values)) if listed is None else listed, values, block).mapInArrow(_compared(lambda found: bytes_close(_rows_of_bytes(found), least)), "a long, b long")


def _first_labels(group: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Of each place the least one of its group and root."""
    _, first, back = np.unique(np.stack([group, roots], axis=1), axis=0, return_index=True, return_inverse=True)
    return first[back.reshape(-1)]


def _met_before(values: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether pairs of list c agree under an earlier key."""
    same = values[a] == values[b]
    under = np.stack([same[:, at : at + KEY_POSITIONS].all(axis=1) for at in KEY_STARTS], axis=1)
    return under.argmax(axis=1) < c


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of (c, key, i, j, ...), a number of whole lists at a time."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        new = _new_lists(rows)
        cut = int(new[-1]) if len(new) else 0
        rest = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut)
    if rest is not None and len(rest):
        yield rest


def _new_lists(rows: pa.Table) -> np.ndarray:
    """The places, after the first, where a list begins."""
    lists = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
    return np.flatnonzero((lists[1:] != lists[:-1]).any(axis=1)) + 1


def _group_numbers(rows: pa.Table) -> np.ndarray:
    starts = np.zeros(len(rows), np.int64)
    starts[_new_lists(rows)] = 1
    return np.cumsum(starts)


def _left_open(least: int):
    """The rows (c, key, i, j, name, value, root) in a pair of `least` matches and two roots that no earlier key's list holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_lists(batches):
            group, c, root = _group_numbers(rows), rows.column("c").to_numpy(), rows.column("root").to_numpy()
            values = _rows_of_bytes(rows.column("value").to_pylist())
            close, marked = bytes_close(values, least), np.zeros(len(rows), bool)
            at, step = np.arange(len(rows)), 0
            while len(at):
                step += 1
                at = at[at + step < len(rows)]
                at = at[group[at] == group[at + step]]
                new = at[root[at] != root[at + step]]
                new = new[close(new, new + step)]
                new = new[~_met_before(values, new, new + step, c[new])]
                marked[new] = marked[new + step] = True
            yield from rows.filter(pa.array(marked)).to_batches()

    return run


def _settled(least: int, least_similarity: float):
    """Over rows (c, key, i, j, name, value, root, members): links that span what is similar, besides what has one root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_lists(batches):
            group, name, members = _group_numbers(rows), rows.column("name").to_numpy(), rows.column("members")
            near = bytes_close(_rows_of_bytes(rows.column("value").to_pylist()), least)

            def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                found = near(a, b)  # noqa: B023
                found[found] = [similar(members[x].as_py(), members[y].as_py(), least_similarity) for x, y in zip(a[found].tolist(), b[found].tolist(), strict=True)]  # noqa: B023
                return found

            a, b = links_within(group, close, _first_labels(group, rows.column("root").to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(name[a], pa.int64()), pa.array(name[b], pa.int64())], ["a", "b"])

    return run


def _verified(pairs: DataFrame, members: DataFrame, least_similarity: float) -> DataFrame:
    """The pairs (a, b) of names whose shingle sets (name, members) are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similar(x.as_py(), y.as_py(), least_similarity) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    of = lambda end: members.select(F.col("name").alias(end), F.col("members").alias(f"m{end}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "ma", "mb")
    return small_batches(both).mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint, component_id) of every row: 16 hex digits, and the smallest id reachable over links.

    Fingerprints of at most max_bits differing bits are linked; equal ones always are. A null text is an empty one;
    texts without words share the fingerprint zero, and link like any other. Rows that repeat get a result each. A
    null id is never the smallest unless all ids of a component are null. Other columns are not looked at.
    """
    prints = durable(fingerprints(docs, id_col, text_col, shingle_words))
    nodes = durable(prints.groupBy("fp").agg(F.min("_id").alias("least_id")))
    rooted = durable(connected_components(near_links(nodes.select("fp"), max_bits)))
    joined = rooted.join(nodes, F.col("node") == F.col("fp")).select("root", "least_id")
    least = durable(joined.groupBy("root").agg(F.min("least_id").alias("component_id")))
    linked = rooted.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    # Written, so that the join below can deal the rows of a fingerprint with many copies to several tasks.
    of = durable(
        nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    )
    return prints.join(of, "fp").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, max_bits: int = MAX_BITS, least: int = LEAST_MATCHES, least_similarity: float = LEAST_SIMILARITY) -> DataFrame:
    """(id, component_id) of every row: texts are linked if their sets of shingles share least_similarity of their union.

    SimHash (max_bits) and `least` matches of the second fingerprint propose the pairs. Of each text one pair is
    verified first; every pair of `least` matches that this leaves in two components is then verified as well, inside
    its posting list, so that no link is lost and no list of all pairs is written. Texts of one shingle set are one
    node. Nulls, empty texts and repeats are as in groups().
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [hashes(t.as_py(), shingle_words) for t in batch.column(1)]
            fp = [signed(majority(r)) if len(r) else 0 for r in raw]
            names = [set_name(shingle_set(r)) for r in raw]
            columns = [pa.array(fp, pa.int64()), pa.array([positional_bytes(r) for r in raw], pa.binary()), pa.array(names, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["_id", "text_hash", "fp", "value", "name"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(hashes(t.as_py(), shingle_words)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_name(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["name", "members"])

    release_disk(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text_hash = F.xxhash64(F.col(text_col)).alias("text_hash")
    prints = durable(small_batches(docs).select(id_col, text_col, text_hash).mapInArrow(run, f"_id {kind}, text_hash long, fp long, value binary, name long"))
    nodes = durable(prints.groupBy("name").agg(F.min("_id").alias("least_id"), F.min("fp").alias("fp"), F.min("text_hash").alias("text_hash"), F.min("value").alias("value")))
    values = nodes.select("name", "value")

    def members_of(names: DataFrame) -> DataFrame:
        """The shingle sets of the names, from one text of each."""
        wanted = durable(nodes.join(names, "name", "left_semi").select("text_hash"))
        # copies of a text meet once a partition, so that the join gets no hot key
        texts = docs.select(text_hash, F.col(text_col).alias("_text")).dropDuplicates(["text_hash"]).join(wanted, "text_hash", "left_semi")
        return durable(small_batches(texts).select("_text").mapInArrow(sets, "name long, members binary"))

    # SimHash links are between fingerprints, whose texts' least name stands for them.
    stands = durable(nodes.groupBy("fp").agg(F.min("name").alias("stand")))
    same = nodes.join(stands, "fp").where("name <> stand").select(F.col("name").alias("a"), F.col("stand").alias("b"))
    side = lambda end: stands.select(F.col("fp").alias(end), F.col("stand").alias(f"s{end}"))
    bits = near_links(stands.select("fp"), max_bits).join(side("a"), "a").join(side("b"), "b").select(F.col("sa").alias("a"), F.col("sb").alias("b"))
    listed = durable(_lists(_keys_of(values)))
    alike = positional_links(values, least, BLOCK, listed)
    from_both = alike.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"), F.lit(0).alias("by")).unionByName(
        same.unionByName(bits).select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"), F.lit(1).alias("by"))
    )
    # one pair of each name and way
    proposed = durable(from_both.groupBy("b", "by").agg(F.min("a").alias("a")).select("a", "b").distinct())
    ends = lambda pairs: pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
    sure = durable(_verified(proposed, members_of(ends(proposed)), least_similarity))

    rooted = durable(connected_components(sure))
    del proposed, alike, from_both, bits
    release_disk(docs.sparkSession)
    known = durable(values.join(rooted.withColumnRenamed("node", "name"), "name", "left").select("name", F.struct("value", F.coalesce("root", "name").alias("root")).alias("value")))
    # Of the lists only those that hold several components are gone through again.
    with_roots = listed.join(known.select("name", F.col("value.root").alias("root")), "name")
    several = durable(with_roots.groupBy("c", "key").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.count("*").alias("n")).where("first < last").select("c", "key", "n"))
    again = _dealt(listed.drop("n").join(several, ["c", "key"]), known, BLOCK).select("c", "key", "i", "j", "name", F.col("value.value").alias("value"), F.col("value.root").alias("root"))
    fields = "c int, key long, i int, j int, name long, value binary, root long"
    left_open = durable(again.mapInArrow(_left_open(least), fields))
    with_members = left_open.join(members_of(left_open.select("name").distinct()), "name").select(*left_open.columns, "members")
    more = small_batches(_by_list(with_members)).mapInArrow(_settled(least, least_similarity), "a long, b long")

    # The components found so far, joined by what was found after them.
    root_of = known.select("name", F.col("value.root").alias("root"))
    joined = durable(more).join(root_of.withColumnRenamed("name", "a"), "a").withColumnRenamed("root", "ra").join(root_of.withColumnRenamed("name", "b"), "b").select(F.col("ra").alias("a"), F.col("root").alias("b"))
    above = durable(connected_components(joined))
    rooted = durable(root_of.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(F.col("name").alias("node"), F.coalesce("top", "root").alias("root")))
    del again, several, with_roots, left_open, with_members, more, joined, above
    release_disk(docs.sparkSession)
    least_of = durable(rooted.join(nodes.select("name", "least_id"), F.col("node") == F.col("name")).groupBy("root").agg(F.min("least_id").alias("component_id")))
    linked = rooted.join(least_of, "root").select(F.col("node").alias("name"), "component_id")
    of = durable(nodes.select("name", "least_id").join(linked, "name", "left").select("name", F.coalesce("component_id", "least_id").alias("component_id")))
    return prints.select("_id", "name").join(of, "name").select(F.col("_id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, max_bits: int = MAX_BITS, least: int = LEAST_MATCHES, least_similarity: float = LEAST_SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, whose id is the smallest of their group (near_groups); rows without an id stay."""
    found = near_groups(docs, id_col, text_col, shingle_words, max_bits, least, least_similarity)
    gone = durable(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct())
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
