"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic). The token mass of the
cells is raked, one margin after the other, until sources, languages and topics
have the weights asked for. No cell gives more than it has: raking caps a cell at
its mass and goes on, so that the others make up for it. A cell's raked mass over
its own is the probability at which its documents are drawn.

Where a corpus has no topics they are fitted: the most frequent words of those that
stand in a middling share of all documents are the topics' words, and a document
belongs to the one it says most often.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import ascii_lower, durable, release_memory, small_batches, table, utf8

MARGINS = ("source", "lang", "topic")
#: Target of a margin that none is given for: a value's tokens to this power.
TEMPER = 0.9
#: The targets of the registered query and the pipeline, for languages; sources and topics are tempered.
LANGUAGES = {"en": 0.56, "de": 0.17, "fr": 0.17, "es": 0.10}
#: Share of all tokens that the draw keeps in expectation.
RATE = 0.6
#: Rounds of raking at most, and the relative miss of any margin at which it ends, on the driver and by shuffle.
ROUNDS, TOLERANCE, TOLERANCE_THERE = 100, 1e-10, 1e-6
#: Cells up to this many (a few MB) are raked on the driver and go to every task; more are raked and joined by shuffle.
DRIVER_CELLS = 50_000
#: Topics, and the shares of all documents that a topic's word stands in, at least and at most.
TOPICS, TOPIC_SHARES = 12, (0.01, 0.10)
OTHER = "other"
NULL = "\x01null"


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lowered."""
    return ascii_lower(utf8(text)).split()


def topic_of(words: list[bytes], topics: dict[bytes, int]) -> int | None:
    """The number of the topic whose word stands most often, the first of equals; none without any."""
    seen = Counter(topics[w] for w in words if w in topics)
    return min(seen, key=lambda k: (-seen[k], k), default=None)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts: (word, documents with it) in this batch."""
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column(0):
            seen.update(set(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
    release_memory()


def fit_topics(docs: DataFrame, text_col: str = "text", topics: int = TOPICS, shares: tuple[float, float] = TOPIC_SHARES) -> list[str]:
    """The words that stand for topics, in order; counted over all documents, `topics` of them come to the driver."""
    texts = small_batches(docs).select(F.col(f"`{text_col}`").alias("text"))
    n = texts.count()
    counts = texts.mapInArrow(_document_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    middling = counts.where((F.col("n") >= n * shares[0]) & (F.col("n") <= n * shares[1]))
    return [r["word"] for r in middling.orderBy(F.desc("n"), "word").limit(topics).collect()]


def _placed(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topic_col: str | None, topics: Sequence[str]) -> DataFrame:
    """(doc, source, lang, topic, tokens): the columns of docs in one, the cell, the words and one end mark.

    By mapInArrow like the other operators, so that a task needs no second worker.
    """
    numbers = {t.encode(): k for k, t in enumerate(topics)}
    names = [*topics, OTHER]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(1)]
            of = [topic_of(w, numbers) for w in words] if topic_col is None else ()
            topic = pa.array([names[-1 if k is None else k] for k in of], pa.string()) if topic_col is None else batch.column(4)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), topic, pa.array([len(w) + 1 for w in words], pa.int64())], ["doc", *MARGINS, "tokens"])
        release_memory()

    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL))
    packed = small_batches(docs).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text_col}`").alias("text"), value(source_col), value(lang_col), *([value(topic_col)] if topic_col else [])
    )
    return packed.mapInArrow(run, T.StructType([packed.schema["doc"], *[T.StructField(m, T.StringType()) for m in MARGINS], T.StructField("tokens", T.LongType())]))


def feasible(mass: np.ndarray, weight: np.ndarray, goal: float) -> np.ndarray:
    """least(mass, scale * weight) at the scale where they sum to goal: weights are met but where there is not enough."""
    out = np.where(weight > 0, mass, 0).astype(float)
    order = np.argsort(np.where(weight > 0, mass / np.where(weight > 0, weight, 1), np.inf), kind="stable")[: int((weight > 0).sum())]
    m, w = mass[order].astype(float), weight[order]
    scale = (goal - (np.cumsum(m) - m)) / (w.sum() - (np.cumsum(w) - w)) if len(order) else np.zeros(0)
    free = np.flatnonzero(m >= scale * w)
    if len(free):
        out[order] = np.minimum(m, scale[free[0]] * w)
    return out


def rake_here(cells: pd.DataFrame, targets: dict[str, dict[str, float]], power: float = TEMPER, rate: float = RATE, rounds: int = ROUNDS) -> tuple[pd.DataFrame, pd.DataFrame]:
    """cells (the margins' columns, mass) with weight, and (margin, value, mass, target, reached) of every value."""
    mass = cells["mass"].to_numpy(float)
    weight, goal = mass.copy(), rate * mass.sum()
    plans, reports = [], []
    for m in MARGINS:
        values, of = np.unique(cells[m].to_numpy(object).astype(str), return_inverse=True)
        sums = np.bincount(of, mass, len(values))
        asked = np.array([targets[m].get(v, 0.0) for v in values]) if m in targets else sums**power
        target = feasible(sums, asked, goal)
        plans.append((of, target))
        reports.append((m, values, sums, target, of))
    for _ in range(rounds):
        worst = 0.0
        for of, target in plans:
            now = np.bincount(of, weight, len(target))
            factor = np.where(now > 0, target / np.where(now > 0, now, 1), 0)
            worst = max(worst, float(np.abs(np.where(target > 0, factor, 1) - 1).max(initial=0)))
            weight = np.minimum(mass, weight * factor[of])
        if worst < TOLERANCE:
            break
    report = pd.concat(
        [pd.DataFrame({"margin": m, "value": v, "mass": s, "target": t, "reached": np.bincount(of, weight, len(v))}) for m, v, s, t, of in reports], ignore_index=True
    )
    return cells.assign(weight=weight), report


def _feasible_there(values: DataFrame, goal: float, rounds: int) -> DataFrame:
    """The same over (value, mass, asked) with target: the scale is found by sums, which alone come to the driver."""
    scale = None
    for _ in range(rounds):
        full = F.lit(False) if scale is None else (F.col("asked") * scale >= F.col("mass"))
        row = values.where("asked > 0").agg(F.sum(F.when(full, F.col("mass"))).alias("full"), F.sum(F.when(~full, F.col("asked"))).alias("free")).first()
        if not row["free"]:
            scale = float("inf")
            break
        new = (goal - float(row["full"] or 0)) / row["free"]
        if new == scale:
            break
        scale = new
    met = F.when(F.col("asked") > 0, F.least(F.col("mass").cast("double"), F.col("asked") * F.lit(scale)) if scale != float("inf") else F.col("mass").cast("double"))
    return values.withColumn("target", F.coalesce(met, F.lit(0.0)))


def rake_there(cells: DataFrame, targets: dict[str, dict[str, float]], power: float = TEMPER, rate: float = RATE, rounds: int = ROUNDS) -> DataFrame:
    """The same as rake_here, by DataFrame functions, for any number of cells."""
    spark = cells.sparkSession
    goal = rate * float(cells.agg(F.sum("mass")).first()[0] or 0)
    now = cells.withColumn("weight", F.col("mass").cast("double"))
    for m in MARGINS:
        values = cells.groupBy(m).agg(F.sum("mass").alias("mass"))
        if m in targets:
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[m].items()], f"{m} string, asked double")
            values = values.join(given, m, "left").fillna(0.0, ["asked"])
        else:
            values = values.withColumn("asked", F.pow(F.col("mass").cast("double"), F.lit(power)))
        now = now.join(_feasible_there(durable(values), goal, rounds).select(m, F.col("target").alias(f"t_{m}")), m)
    now = durable(now)
    for _ in range(rounds):
        for m in MARGINS:
            sums = now.groupBy(m).agg(F.sum("weight").alias("s"))
            fitted = F.when(F.col("s") > 0, F.least(F.col("mass").cast("double"), F.col("weight") * F.col(f"t_{m}") / F.col("s"))).otherwise(0.0)
            now = now.join(sums, m).withColumn("new", fitted)
            now = now.withColumn(f"d_{m}", F.abs(F.col("s") / F.when(F.col(f"t_{m}") > 0, F.col(f"t_{m}")) - 1)).drop("weight", "s").withColumnRenamed("new", "weight")
        now = durable(now)
        worst = now.agg(F.max(F.greatest(*[F.coalesce(f"d_{m}", F.lit(0.0)) for m in MARGINS]))).first()[0]
        now = now.drop(*[f"d_{m}" for m in MARGINS])
        if worst is None or worst < TOLERANCE_THERE:
            break
    return now.select(*MARGINS, "mass", "weight")


def uniform(id_value: Column) -> Column:
    """A number in [0, 1) that the id alone decides."""
    digits = F.substring(F.md5(F.coalesce(id_value.cast("string"), F.lit(NULL))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, targets: dict[str, dict[str, float]] | None = None, power: float = TEMPER, rate: float = RATE, rounds: int = ROUNDS, keep_text: bool = True, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """docs, all columns and rows, plus _topic, _tokens, _probability and _kept (the draw).

    targets has the weights of the values for a margin (source, lang, topic), in any scale; values it lacks are not
    drawn. A margin without targets gets its own tokens to `power`. In expectation `rate` of all tokens is kept; a value
    with fewer tokens than its target is kept whole, and the others of its margin share what it lacks. Raking ends
    within a tolerance of every margin, or after `rounds` where targets contradict each other; margins() tells.
    A document weighs its words and one end mark. The draw is decided by a hash of the id: the same documents come
    at every run, and rows that share an id come or go together within a cell.
    - Null source, language or topic is a value of its own. Null and empty texts weigh one and are drawn like others;
      without topic_col they belong to the topic "other", as any text without a topic's word.
    - An empty table stays empty. Columns of docs with the names of the four added give way to them.
    Without keep_text the text is left out, and what is read of it is written instead of read again.
    """
    docs = docs.drop("_topic", "_tokens", "_probability", "_kept")
    topics = () if topic_col else fit_topics(docs, text_col)
    placed = _placed(docs, text_col, source_col, lang_col, topic_col, topics)
    if not keep_text:
        placed = durable(placed.withColumn("doc", F.col("doc").dropFields(text_col)))
    cells = durable(placed.groupBy(*MARGINS).agg(F.sum("tokens").alias("mass")))
    few = cells.count() <= driver_cells
    if few:
        raked, _ = rake_here(cells.toPandas().sort_values(list(MARGINS), ignore_index=True), targets or {}, power, rate, rounds)
        drawn = docs.sparkSession.createDataFrame(raked, f"{', '.join(f'{m} string' for m in MARGINS)}, mass long, weight double")
    else:
        drawn = rake_there(cells, targets or {}, power, rate, rounds)
    drawn = drawn.select(*MARGINS, F.round(F.col("weight") / F.col("mass"), 9).alias("p"))
    joined = placed.join(F.broadcast(drawn) if few else drawn, list(MARGINS))
    kept = [c for c in docs.columns if keep_text or c != text_col]
    return joined.select(
        *[F.col("doc").getField(c).alias(c) for c in kept],
        F.col("topic").alias("_topic"), F.col("tokens").alias("_tokens"), F.col("p").alias("_probability"),
        (uniform(F.col("doc").getField(id_col)) < F.col("p")).alias("_kept"),
    )


def margins(mixed: DataFrame, source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(margin, value, tokens, expected, drawn) of what mix() returned: each value's tokens, those expected and those drawn."""
    each = [(m, F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL))) for m, c in zip(MARGINS, (source_col, lang_col, "_topic"), strict=True)]
    spread = mixed.select("_tokens", "_probability", "_kept", F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), v.alias("value")) for m, v in each])).alias("of"))
    return spread.groupBy("of.margin", "of.value").agg(
        F.sum("_tokens").alias("tokens"), F.sum(F.col("_tokens") * F.col("_probability")).alias("expected"), F.sum(F.when(F.col("_kept"), F.col("_tokens")).otherwise(0)).alias("drawn")
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), targets={"lang": LANGUAGES}, keep_text=False)
    return out.select(
        "doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"),
        F.round("_probability", 6).alias("probability"), F.col("_kept").alias("kept"),
    )


_ASKED = {m: f"pow(mass, {TEMPER})" for m in MARGINS} | {"lang": "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in LANGUAGES.items()) + " ELSE 0 END"}
OP6_SQL = (
    rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, chr(1) || 'null') AS source, coalesce(lang, chr(1) || 'null') AS lang,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
topics AS (
  SELECT word, row_number() OVER (ORDER BY n DESC, word) AS nr FROM (SELECT word, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(w)) AS word FROM w) GROUP BY word)
  WHERE n BETWEEN {TOPIC_SHARES[0]} * (SELECT count(*) FROM w) AND {TOPIC_SHARES[1]} * (SELECT count(*) FROM w) QUALIFY nr <= {TOPICS}),
said AS (
  SELECT doc_id, word AS topic FROM (SELECT doc_id, word, nr, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM w) JOIN topics USING (word) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, nr) = 1),
placed AS (SELECT w.doc_id, source, lang, coalesce(topic, '{OTHER}') AS topic, len(w) + 1 AS tokens FROM w LEFT JOIN said USING (doc_id)),
cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS mass FROM placed GROUP BY ALL),
goal AS (SELECT {RATE} * sum(mass) AS goal FROM cells),
"""
    + "".join(
        f"""
v_{m} AS (SELECT {m}, mass::DOUBLE AS mass, ({_ASKED[m]})::DOUBLE AS asked FROM (SELECT {m}, sum(mass) AS mass FROM cells GROUP BY {m})),
o_{m} AS (
  SELECT *, (goal - coalesce(sum(mass) OVER before, 0)) / (sum(asked) OVER () - coalesce(sum(asked) OVER before, 0)) AS scale
  FROM v_{m}, goal WHERE asked > 0 WINDOW before AS (ORDER BY mass / asked, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t_{m} AS (
  SELECT {m}, CASE WHEN asked > 0 THEN least(mass, asked * coalesce((SELECT arg_min(scale, mass / asked) FROM o_{m} WHERE mass >= scale * asked), 'inf'::DOUBLE)) ELSE 0 END AS t_{m} FROM v_{m}),
"""
        for m in MARGINS
    )
    + f"""
raked AS (
  SELECT 0 AS k, source, lang, topic, mass::DOUBLE AS mass, mass::DOUBLE AS weight, t_source, t_lang, t_topic
  FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)
  UNION ALL
  SELECT k + 1, source, lang, topic, mass, CASE WHEN s > 0 THEN least(mass, weight * (CASE k % 3 WHEN 0 THEN t_source WHEN 1 THEN t_lang ELSE t_topic END) / s) ELSE 0 END, t_source, t_lang, t_topic
  FROM (SELECT *, sum(weight) OVER (PARTITION BY CASE k % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END) AS s FROM raked WHERE k < {3 * ROUNDS})),
drawn AS (SELECT source, lang, topic, round(weight / mass, 9) AS p FROM raked WHERE k = {3 * ROUNDS})
SELECT doc_id, nullif(source, chr(1) || 'null') AS source, nullif(lang, chr(1) || 'null') AS lang, topic, tokens, round(p, 6) AS probability,
       CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(1) || 'null')), 1, 12)) AS UBIGINT) / 281474976710656.0 < p AS kept
FROM placed JOIN drawn USING (source, lang, topic)
"""
)
