"""Quality rules: statistics of each text, and the frequency of its lines across the documents of its host.

A line that many different texts of one host share says nothing of its document.
Such lines are taken out, and a document of which too little is left is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, durable, row_key, small_batches, table, utf8

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: A line is common from this many distinct texts of its host on, if they are this share of them or COMMON_MOST texts.
COMMON_TEXTS, COMMON_SHARE, COMMON_MOST = 3, 0.01, 1_000
#: A document is depleted when less than this share of its words, or fewer than MIN_WORDS, are outside common lines.
LEAST_LEFT = 0.3
#: Up to so many common lines (8 bytes each) go to every task; more are joined by document.
BROADCAST_LINES = 1 << 20
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of `size` words that occur twice or more in the text."""
    windows = list(zip(*[words[k:] for k in range(size)], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, reached, covered = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + size - max(i, reached)
            reached = i + size
    return covered


def line_keys(data: bytes, host: str) -> Iterator[tuple[bytes, int, int]]:
    """(line, key, words) of each \\n-split line; the key is that of the normalised line and the host. Without words: 0, 0."""
    seed = xxhash.xxh64_intdigest(utf8(host))
    for line in data.split(b"\n"):
        parts = line.split()
        yield line, xxhash.xxh64_intdigest(ascii_lower(b" ".join(parts)), seed) - (1 << 63) if parts else 0, len(parts)


def text_stats(text: str | None) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    data = utf8(text)
    words = data.split()  # on ASCII white space, as bytes are split
    filled = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(filled) - len(set(filled)), repeat_words(words)


_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_FOUND = [*[(n, pa.int64()) for n in _STATS], ("common_words", pa.int64()), ("n_common_lines", pa.int64()), ("clean_text", pa.string())]


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, text): (host, text hash, keys of its different lines)."""
    for batch in batches:
        hosts, keys, texts = batch.column(0).to_pylist(), [], []
        for host, text in zip(hosts, batch.column(1), strict=True):
            data = utf8(text.as_py())
            texts.append(xxhash.xxh64_intdigest(data) - (1 << 63))
            keys.append(list({key for _, key, words in line_keys(data, host) if words}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["host", "text", "lines"])


def _measured(batch: pa.RecordBatch, common: np.ndarray) -> pa.RecordBatch:
    """Of (id, host, text): the statistics, what common lines take, and the text without them."""
    rows = []
    for host, value in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
        text = value.as_py()
        lines = list(line_keys(utf8(text), host))
        asked = np.array([key for _, key, _ in lines], np.int64)
        gone = np.zeros(len(lines), bool)
        if len(common):
            at = np.minimum(np.searchsorted(common, asked), len(common) - 1)
            gone = (common[at] == asked) & np.array([words > 0 for *_, words in lines])
        clean = text
        if gone.any():
            clean = b"\n".join(line for (line, *_), g in zip(lines, gone, strict=True) if not g).decode()
        rows.append((*text_stats(text), sum(words for (*_, words), g in zip(lines, gone, strict=True) if g), int(gone.sum()), clean))
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_FOUND)
    return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, (_, t) in zip(columns, _FOUND, strict=True)]], ["_id", *[n for n, _ in _FOUND]])


def common_lines(docs: DataFrame, common_share: float = COMMON_SHARE, common_texts: int = COMMON_TEXTS, common_most: int = COMMON_MOST) -> DataFrame:
    """(line) keys of the lines that are common in their host, of docs (host, text)."""
    texts = small_batches(docs).mapInArrow(_lines_of, "host string, text long, lines array<long>").dropDuplicates(["host", "text"])
    counts = durable(
        texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= common_texts)
    )
    # Null and empty texts are one text.
    hosts = docs.select("host", F.xxhash64(F.coalesce("text", F.lit("")))).distinct().groupBy("host").agg(F.count("*").alias("of"))
    wide = (F.col("n") >= F.col("of") * common_share) | (F.col("n") >= common_most)
    return durable(counts.join(hosts, "host").where(wide).select("line"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", common_share: float = COMMON_SHARE, common_texts: int = COMMON_TEXTS, common_most: int = COMMON_MOST, least_left: float = LEAST_LEFT, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, common_words, n_common_lines, clean_text, base_failed, kept) of every row.

    Lines are normalised (A-Z lowered, white space runs one space, ends trimmed); those without a word do not count.
    A line's frequency in a host is the number of distinct texts with it, so that exact copies of a text count once.
    common_words are the document's words in lines that are common in its host, clean_text is the text without these
    lines; the document is kept if the base rules let it pass and at least least_left of its words, and MIN_WORDS, are left.
    - A null text counts as empty: no words, so the base rules fail it, and its clean text is null. A null host is a
      host of its own.
    - Rows that repeat, also in their id, get one result each; columns besides the three are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs).select(F.col(id_col).alias("_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("\0null")).alias("host"), F.col(text_col).alias("text"))
    lines = common_lines(rows.select("host", "text"), common_share, common_texts, common_most)
    fields = f"_id {kind}, {', '.join(f'{n} string' if t == pa.string() else f'{n} long' for n, t in _FOUND)}"
    if lines.count() <= broadcast_lines:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(lines.toArrow().column(0).to_numpy()))

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _measured(batch, known.value)

        found = rows.mapInArrow(measured, fields)
    else:
        row = row_key("_id", "host", "text")
        spread = rows.select(row.alias("_row"), "host", "text").mapInArrow(_spread, "row long, line long")
        hits = (
            spread.join(lines, "line")
            .repartition("row")  # by document, so that the join above can be split where a line is hot
            .groupBy("row").agg(F.collect_set("line").alias("lines"))
        )
        joined = rows.join(hits, row == F.col("row"), "left").select("_id", "host", "text", "lines")
        found = small_batches(joined).mapInArrow(_measured_with_lines, fields)
    words, left = F.col("n_words"), F.col("n_words") - F.col("common_words")
    failed = (words < MIN_WORDS) | (F.col("n_repeat_words") * 100 > words * MAX_REPEATED_PERCENT)
    return found.select(
        F.col("_id").alias(id_col), *[n for n, _ in _FOUND], failed.alias("base_failed"),
        (~failed & (left >= words * least_left) & (left >= MIN_WORDS)).alias("kept"),
    )


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (row, host, text): (row, key) of each different line."""
    for batch in batches:
        pairs = [
            (row, key)
            for row, host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)
            for key in {key for _, key, words in line_keys(utf8(text.as_py()), host) if words}
        ]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["row", "line"])


def _measured_with_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same over rows that bring along their common lines."""
    for batch in batches:
        yield _measured(batch.select([0, 1, 2]), np.unique(batch.column(3).flatten().to_numpy()))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_STATS, "common_words", "n_common_lines", F.md5("clean_text").alias("clean_md5"), "base_failed", "kept")


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(1) || 'null') AS host, text AS given, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         string_split(coalesce(text, ''), chr(10)) AS l
  FROM documents),
tri AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
rep AS (
  SELECT doc_id, count(DISTINCT p + k) AS n
  FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri), (VALUES (0), (1), (2)) AS o(k)
  WHERE c > 1 GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, hash(text) AS th, raw, pos, translate(regexp_replace(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line
  FROM (SELECT doc_id, host, text, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM d)),
hosts AS (SELECT host, count(DISTINCT text) AS n FROM d GROUP BY host),
common AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT th) AS c FROM lines WHERE line <> '' GROUP BY host, line) JOIN hosts USING (host)
  WHERE c >= {COMMON_TEXTS} AND (c >= n * {COMMON_SHARE} OR c >= {COMMON_MOST})),
lost AS (
  SELECT doc_id, coalesce(sum(len(string_split(lines.line, ' '))) FILTER (common.line IS NOT NULL), 0) AS n, count(common.line) AS n_lines,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (common.line IS NULL), '') AS clean
  FROM lines LEFT JOIN common ON lines.host = common.host AND lines.line = common.line GROUP BY doc_id),
s AS (
  SELECT d.doc_id, len(w) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, CAST(lost.n AS BIGINT) AS common_words, lost.n_lines AS n_common_lines,
         CASE WHEN given IS NOT NULL THEN md5(lost.clean) END AS clean_md5
  FROM d JOIN lost USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, common_words, n_common_lines, clean_md5,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words)
       AND n_words - common_words >= n_words * {LEAST_LEFT} AND n_words - common_words >= {MIN_WORDS} AS kept
FROM s
"""
