"""Removal of line windows that occurred before, by DataFrame functions alone.

Every run of three consecutive lines is hashed. A window's first occurrence, by
(document id, place), stays; all later ones mark the three lines they cover, and
the union of the marked lines is cut from the document.

A passage that repeats inside longer lines has no three lines of its own. On request
the sentences of the lines stand for lines as well: runs of three consecutive sentences
of some length are windows too, and mark the sentences that they cover.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import durable, row_key, table

WINDOW_LINES = 3
#: Characters that a window of sentences has at least; shorter ones repeat by chance.
LEAST_CHARS = 100
#: Bits of the bitmap (2 MB) that tells most documents without a cut; where it fills up, more texts are shuffled.
MARK_BITS = 1 << 24
#: A sentence's place is its line's times this, and its number in the line.
LINE = 1 << 31


def _lines(text: Column) -> Column:
    """The lines of a text as arrays of their sentences, which keep the space at their ends."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.split(x, r"(?<=[.!?] )", -1))


def _hashed(unit: Column, at: Column, whole: Column) -> Column:
    filled = F.btrim(unit, F.lit(" \t\n\x0b\x0c\r")) != ""
    return F.struct(F.xxhash64(unit).alias("h"), filled.alias("filled"), F.length(unit).alias("n"), at.cast("long").alias("at"), whole.alias("whole"))


def _windows(docs: DataFrame, keys: list[str], text_col: str, size: int, sentences: bool) -> DataFrame:
    """keys, places (of the lines or sentences covered), and the 128-bit hash (a, b) of each window that holds a word.

    A place is at least LINE * number of the line; those of whole lines are negative. Lines and sentences are hashed
    once; a window's hash is that of theirs. Windows of sentences that are whole lines are windows of lines already.
    """
    text = F.col(text_col)
    of_lines = F.transform(F.split(text, "\n", -1), lambda x, i: _hashed(x, -1 - i, F.lit(True)))
    of_sentences = F.flatten(F.transform(_lines(text), lambda x, i: F.transform(x, lambda y, j: _hashed(y, i.cast("long") * LINE + j, F.size(x) == 1))))

    def windows(name: str, units: Column, counts) -> DataFrame:
        long = docs.select(*keys, units.alias("units")).where(F.size("units") >= size)
        shifted = [F.slice("units", k + 1, F.size("units") - (size - 1)).alias(f"l{k}") for k in range(size)]
        spread = long.select(*keys, F.explode(F.arrays_zip(*shifted)).alias("w"))
        each = [F.col(f"w.l{k}") for k in range(size)]
        hashed = lambda salt: F.xxhash64(F.lit(f"{name} {salt}"), *[x["h"] for x in each])
        return spread.where(reduce(lambda x, y: x | y, [x["filled"] for x in each]) & counts(each)).select(
            *keys, F.array(*[x["at"] for x in each]).alias("places"), hashed("a").alias("a"), hashed("b").alias("b")
        )

    lines = windows("lines", of_lines, lambda each: F.lit(True))
    if not sentences:
        return lines
    parts = lambda each: ~reduce(lambda x, y: x & y, [x["whole"] for x in each]) & (reduce(lambda x, y: x + y, [x["n"] for x in each]) >= LEAST_CHARS)
    # documents of one sentence a line have no windows of sentences
    several = F.size(F.split(text, r"[.!?] ", -1)) > 1
    return lines.unionByName(windows("sentences", F.when(several, of_sentences), parts))


def _marks(rows: DataFrame) -> DataFrame:
    """(word, bits): a bitmap of MARK_BITS bits in which each row is marked; of bounded size, whatever the rows."""
    bit = F.pmod(F.col("row"), F.lit(MARK_BITS))
    marked = rows.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(row, 64) as int))").alias("bit"))
    return durable(marked.groupBy("word").agg(F.bit_or("bit").alias("bits")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_LINES, sentences: bool = False, settle: bool = True) -> DataFrame:
    """docs with repeated windows cut from text_col, plus _n_lines, _n_removed (lines that went whole) and _n_sentences
    (sentences that went from other lines), all int.

    Lines end at \\n and are compared exactly. With sentences, so are sentences, which end at a full stop, question or
    exclamation mark and a space as well; a window of them has LEAST_CHARS characters at least, and one sentence at least
    that is not its whole line.
    The texts that lose something are written before they are returned (settle): a filter on them would otherwise be worked
    into the steps that make them, and cut every text anew for each of its lines. Where nothing filters, that can be left out.
    All columns of docs stay, whatever their names, but for columns of its own with the names of the three, which give way.
    - A null text stays null: 0 lines, 0 removed. An empty text is one line.
    - A text of fewer lines and sentences than a window stays as it is. Windows without a word are no windows.
    - First means smallest (id, place), a null id before all. Rows of one id and one text are one document: none of
      them is later than the other. Rows of one id with other texts are compared at their places.
    - Of windows that overlap within a document, as in a line said four times, the first stays.
    - A line goes with its line end when all its sentences go. A document whose lines are all covered keeps its row,
      with an empty text.
    """
    added = ("_n_lines", "_n_removed", "_n_sentences")
    kept = [c for c in docs.columns if c not in added]
    # the columns of docs in one of their own, so that no name of theirs meets one of these
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), row_key(id_col, text_col).alias("row")
    )
    windows = _windows(keyed, ["id", "row"], "text", window, sentences)
    # lines have negative places, the first line the greatest
    order = F.struct(F.col("id"), F.abs(F.col("places")[0]).alias("pos"))
    # Written, so that the join below has plain exchanges on both sides and can be split where a window is hot.
    repeated = durable(
        windows.groupBy("a", "b")
        .agg(F.min(order).alias("first"), F.max(order).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select("a", "b", "first")
    )
    later = windows.join(repeated, ["a", "b"]).where(~F.col("first").eqNullSafe(order))
    cut = durable(later.repartition("row").groupBy("row").agg(F.collect_set("places").alias("places")))
    gone = F.array_distinct(F.flatten("places"))

    # Only texts that are cut, and few others that share their mark, are shuffled to meet their cuts.
    marked = keyed.withColumn("word", F.shiftright(F.pmod(F.col("row"), F.lit(MARK_BITS)), 6)).join(F.broadcast(_marks(cut)), "word", "left")
    is_marked = F.coalesce(F.expr("shiftright(bits, cast(pmod(row, 64) as int)) & 1L"), F.lit(0)) == 1
    joined = marked.where(is_marked).join(cut.select("row", gone.alias("gone")), "row", "left").select("doc", "text", "gone")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    whole = lambda rows: rows.select(F.col("doc"), F.col("text").alias("left"), n_lines.alias("n_lines"), F.lit(0).alias("n_removed"), F.lit(0).alias("n_sentences"))
    less = _without(joined.where("gone is not null"))
    less = durable(less) if settle else less
    both = whole(marked.where(~is_marked)).unionByName(whole(joined.where("gone is null"))).unionByName(less)
    return both.select(
        *[(F.col("left") if c == text_col else F.col("doc").getField(c)).alias(c) for c in kept],
        F.col("n_lines").alias("_n_lines"), F.col("n_removed").alias("_n_removed"), F.col("n_sentences").alias("_n_sentences"),
    )


def _without(rows: DataFrame) -> DataFrame:
    """Of (doc, text, gone): (doc, left, n_lines, n_removed, n_sentences), in time linear in the text."""
    spread = rows.select("doc", "gone", _lines(F.col("text")).alias("lines"))
    lines = F.array_except(F.transform(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (-1 - i).cast("long")), F.col("gone"))
    stay = spread.select("doc", "gone", "lines", F.transform(lines, lambda at: (-1 - at).cast("int")).alias("stay"))
    numbered = F.flatten(F.transform("stay", lambda i: F.transform(F.get("lines", i), lambda y, j: i.cast("long") * LINE + j)))
    placed = stay.select("doc", "lines", numbered.alias("all"), F.array_except(numbered, F.col("gone")).alias("left"))
    line, nth = (lambda at: F.floor(at / LINE).cast("int")), (lambda at: (at % LINE).cast("int"))
    piece = lambda at, k: F.concat(F.when((k > 0) & (line(at) != line(F.get("left", k - 1))), "\n").otherwise(""), F.get(F.get("lines", line(at)), nth(at)))
    n_left = F.size(F.array_distinct(F.transform("left", line)))
    in_lines = F.size("all") - F.size("left")  # sentences that sentence windows cut
    return placed.select(
        "doc", F.array_join(F.transform("left", piece), "").alias("left"), F.size("lines").alias("n_lines"), (F.size("lines") - n_left).alias("n_removed"), in_lines.alias("n_sentences")
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), settle=False)
    return out.select("doc_id", "text", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_removed").cast("long").alias("n_removed"))


SQL_CTES = r"""
ld_lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM {docs}),
ld_win AS (
  SELECT doc_id, p - 1 AS pos, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM ld_lines)),
ld_ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth
  FROM ld_win WHERE regexp_replace(w, '[\x20\x09-\x0D]', '', 'g') <> ''),
ld_cut AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM ld_ranked, (VALUES (0), (1), (2)) AS o(d) WHERE nth > 1),
ld_kept AS (
  SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.pos) AS text, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM ld_lines) x
  ANTI JOIN ld_cut c ON x.doc_id = c.doc_id AND x.pos = c.pos GROUP BY x.doc_id)
"""

OP4_SQL = (
    "WITH "
    + SQL_CTES.format(docs="documents")
    + """
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(d.l), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(d.l), 0) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed
FROM ld_lines d LEFT JOIN ld_kept k ON d.doc_id = k.doc_id
"""
)
