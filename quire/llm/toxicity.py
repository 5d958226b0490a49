"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has a model of the expressions its documents use.
The class is the history: an expression counts by the documents of the class that
have it, less a constant discount, and the mass that frees goes to the backoff. That
is a model of stems, where as in Kneser-Ney smoothing a stem counts not by how often
it stands but by how many different expressions of the class it goes on to; its own
discounted mass goes to the stems' continuation counts in both classes, which are
shared. Within a stem all expressions are alike, so that of a rare expression the
models differ no more than its stem tells. A text's log-likelihood under either model
is divided by its length and the two are compared, over the whole text and over its
most telling words; a logistic curve fitted on labelled rows outside the models turns
that into a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import durable, release_memory, small_batches, table

FOLDS = 5
#: Rows that the logistic curve is fitted on at most, and the share of the labelled rows that they are at most; by a hash
#: of the id. All other labelled rows are counted by the models.
CURVE_ROWS, CURVE_SHARE = 40_000, 1 / 6
#: Labelled rows (some 12 bytes each) up to which they go to every task; more are joined by shuffle.
BROADCAST_LABELS = 2_000_000
#: Entries of the models (16 bytes each) up to which they go to every task at once.
BROADCAST_ENTRIES = 1 << 22
#: Beyond, they go in parts of half as many entries, of which a task holds one at a time; beyond so many parts (1 GB in all)
#: they are joined to the texts that need them, at some twenty times the disk.
BROADCAST_PARTS = 32
STEM_LETTERS = 5
DISCOUNT = 0.9
#: What the backoffs weigh beside the mass that discounts free: counts for each known expression, and for each stem.
WORD_BACKOFF, STEM_BACKOFF = 2.0, 4.0
#: Log ratios above this speak for toxicity by themselves.
TELLING = 1.0
MARKS = b".,!?;:|#%&$*\"()'`~_-<>[]{}/\\"
MEMORY_WORDS = 150_000
N_FEATURES = 4


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def expression(word: bytes) -> bytes:
    return word.strip(MARKS) or word


def stem(word: bytes) -> bytes:
    return word.decode("utf-8", "replace")[:STEM_LETTERS].encode()


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def stem_key(word: bytes) -> int:
    return word_key(b"\0" + stem(word))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, toxic): each expression's key, its stem's, and how many texts of either class have it in this batch."""
    for batch in batches:
        seen = (Counter(), Counter())
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            seen[toxic].update({expression(w) for w in words_of(text.as_py())})
        words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([word_key(w) for w in words], pa.int64()), pa.array([stem_key(w) for w in words], pa.int64()),
                pa.array([seen[0][w] for w in words], pa.int64()), pa.array([seen[1][w] for w in words], pa.int64()),
            ],
            ["word", "stem", "n0", "n1"],
        )
    release_memory()


def _read(part: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """The value of a broadcast, which is not kept in the worker."""
    value = part.value
    if getattr(part, "_path", None):
        vars(part).pop("_value", None)
    return value


class Model:
    """Log-likelihoods of expressions under the ordinary and the toxic model, and the logistic curve over a text's features.

    keys: of expressions, and of stems for expressions that no labelled row has; logs: of each key both log-likelihoods;
    rest: those of an expression whose stem no labelled row has; parts: broadcasts of models, in place of keys and logs,
    of which the k-th has the keys that leave k when divided by their number.
    """

    def __init__(self, keys: np.ndarray, logs: np.ndarray, rest: tuple[float, float] = (0.0, 0.0), curve: np.ndarray | None = None, parts: Sequence[Broadcast] = ()):
        if len(keys) and (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys)
            keys, logs = keys[order], logs[order]
        self.keys, self.logs, self.rest, self.curve = keys, logs.astype(np.float32, copy=False).reshape(-1, 2), rest, curve
        self.parts = parts
        self.forget()

    def forget(self) -> None:
        self.toxic: dict[bytes, float] = {}
        self.ordinary: dict[bytes, float] = {}

    def _look_up(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            known, logs = np.zeros(len(asked), bool), np.zeros((len(asked), 2), np.float32)
            of = asked % len(self.parts)
            for k, part in enumerate(self.parts):
                here = np.flatnonzero(of == k)
                if len(here):
                    known[here], logs[here] = Model(*_read(part))._look_up(asked[here])
            return known, logs
        if not len(self.keys):
            return np.zeros(len(asked), bool), np.zeros((len(asked), 2), np.float32)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return self.keys[at] == asked, self.logs[at]

    def learn(self, words: set[bytes]) -> None:
        """The log-likelihoods of these words, kept for later texts: of the expression, else of an unknown one of its stem."""
        if len(self.toxic) > MEMORY_WORDS:
            self.forget()
        new = [w for w in words if w not in self.toxic]
        if not new:
            return
        plain = [expression(w) for w in new]
        known, logs = self._look_up(np.array([*map(word_key, plain), *map(stem_key, plain)], np.int64))  # together, so that parts are read once
        (known, stem_known), (logs, stem_logs) = np.split(known, 2), np.split(logs, 2)
        found = np.where(known[:, None], logs, np.where(stem_known[:, None], stem_logs, np.array(self.rest, np.float32)))
        self.ordinary.update(zip(new, found[:, 0].tolist(), strict=True))
        self.toxic.update(zip(new, found[:, 1].tolist(), strict=True))

    def likelihoods(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word the log-likelihood under the ordinary and under the toxic model."""
        n = len(words)
        return np.fromiter(map(self.ordinary.__getitem__, words), np.float64, n), np.fromiter(map(self.toxic.__getitem__, words), np.float64, n)

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.curve[1:] + self.curve[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features_of(ordinary: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """Of the words' log ratios: the mean, which is the difference of the length-normalised log-likelihoods of the text, the
    mean excess over TELLING, the mean of the two highest, the highest."""
    if not len(toxic):
        return (0.0,) * N_FEATURES
    ratios = toxic - ordinary
    top = np.partition(ratios, len(ratios) - 2)[-2:] if len(ratios) > 1 else ratios
    return float(toxic.mean() - ordinary.mean()), float(np.maximum(ratios - TELLING, 0).mean()), float(top.mean()), float(top.max())


def fit_curve(features: np.ndarray, labels: np.ndarray, penalty: float = 0.05, steps: int = 60) -> np.ndarray:
    """Intercept and weights of a logistic regression, by Newton's method; of one class alone, its smoothed rate."""
    n, ones = len(labels), float(labels.sum()) if len(labels) else 0.0
    flat = np.zeros(N_FEATURES + 1)
    flat[0] = np.log((ones + 0.5) / (n - ones + 0.5))
    if ones in (0.0, float(n)):
        return flat
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.c_[np.ones(n), (features - mean) / spread]
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * penalty
    ridge[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - labels) + ridge @ w)
        w -= change
        if np.abs(change).max() < 1e-8:
            break
    weights = w[1:] / spread
    return np.concatenate(([w[0] - weights @ mean], weights))


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def likelihood_table(counts: DataFrame) -> tuple[DataFrame, tuple[float, float]] | None:
    """Of counts (word, stem, n0, n1): (key, log0, log1) of all expressions and of an unknown one of each stem, and the rest's.

    With an unknown expression of an unknown stem, the likelihoods of either class sum to one. None without both classes.
    """
    has = lambda c: F.count(F.when(F.col(c) > 0, 1))
    t = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), has("n0").alias("t0"), has("n1").alias("t1"), F.count("*").alias("v")).first()
    if not t["n0"] or not t["n1"]:
        return None
    stems = durable(counts.groupBy("stem").agg(has("n0").alias("s0"), has("n1").alias("s1"), F.count("*").alias("b")))
    u = stems.agg(has("s0").alias("t0"), has("s1").alias("t1"), F.count("*").alias("v")).first()
    less = lambda n: F.greatest(n - F.lit(DISCOUNT), F.lit(0.0))
    freed = DISCOUNT * u["v"] / (u["v"] + 1)  # of the shared counts, for each stem and the unknown one

    def of_stem(c: int, shared, own):
        given = DISCOUNT * u[f"t{c}"] + STEM_BACKOFF * u["v"]
        return (own + given * shared) / (t[f"t{c}"] + STEM_BACKOFF * u["v"])

    def of_word(c: int, in_stem, own):
        given = DISCOUNT * t[f"t{c}"] + WORD_BACKOFF * t["v"]
        return (own + given * in_stem) / (t[f"n{c}"] + WORD_BACKOFF * t["v"])

    shared = (less(F.col("b")) + F.lit(freed)) / F.lit(float(t["v"]))
    backed = stems.select("stem", *[(of_stem(c, shared, less(F.col(f"s{c}"))) / (F.col("b") + 1)).alias(f"p{c}") for c in (0, 1)])
    log = lambda c, own: F.log(of_word(c, F.col(f"p{c}"), own)).cast("float").alias(f"log{c}")
    words = counts.join(backed, "stem").select(F.col("word").alias("key"), *[log(c, less(F.col(f"n{c}"))) for c in (0, 1)])
    unknown = backed.select("stem", *[log(c, F.lit(0.0)) for c in (0, 1)])
    rest = tuple(float(np.log(of_word(c, of_stem(c, freed / t["v"], 0.0), 0.0))) for c in (0, 1))
    return words.union(unknown), rest


class Fitted:
    """The models as a table (key, log0, log1), with them at hand, whole or in parts, where they are small enough to go to every task."""

    def __init__(self, entries: DataFrame | None, rest: tuple[float, float], broadcast_entries: int):
        self.entries, self.rest, self.curve = entries, rest, None
        self.model: Model | None = None
        self.parts: list[Broadcast] = []
        if entries is None:
            self.model = Model(np.zeros(0, np.int64), np.zeros((0, 2)), rest)
            return
        size = entries.count()
        if size <= broadcast_entries:
            self.model = self._collected(entries)
        elif size <= BROADCAST_PARTS * (broadcast_entries // 2):
            n = math.ceil(size / (broadcast_entries // 2))
            for k in range(n):
                part = self._collected(entries.where(F.pmod("key", F.lit(n)) == k))
                self.parts.append(entries.sparkSession.sparkContext.broadcast((part.keys, part.logs)))

    def _collected(self, entries: DataFrame) -> Model:
        found = entries.toArrow()
        return Model(found.column("key").to_numpy(), np.stack([found.column(f"log{c}").to_numpy() for c in (0, 1)], axis=1), self.rest)

    def over(self, docs: DataFrame, text_col: str, each, schema) -> DataFrame:
        """What each(model, doc columns, texts) returns as a list of arrays, over batches of the rows of docs."""
        packed = small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text_col}`").alias("text"))
        rest, curve, names = self.rest, self.curve, [f.name for f in schema.fields]
        if self.model is not None or self.parts:
            parts = self.parts
            shared = None if parts else docs.sparkSession.sparkContext.broadcast((self.model.keys, self.model.logs))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own = Model(*(shared.value if shared else (np.zeros(0, np.int64), np.zeros((0, 2)))), rest, curve, parts)
                for batch in batches:
                    yield pa.RecordBatch.from_arrays(each(own, batch.column(0).flatten(), batch.column(1)), names)
                del own
                release_memory()

            return packed.mapInArrow(run, schema)

        def run_with_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, first = np.unique(batch.column(2).flatten().to_numpy(), return_index=True)
                own = Model(keys, np.stack([batch.column(k).flatten().to_numpy()[first] for k in (3, 4)], axis=1), rest, curve)
                yield pa.RecordBatch.from_arrays(each(own, batch.column(0).flatten(), batch.column(1)), names)
            release_memory()

        # Each text brings its entries along; copies of a text ask once.
        name = F.xxhash64("text")
        asked = packed.select(name.alias("of"), "text").mapInArrow(_asked, "of long, key long").distinct()
        hits = durable(
            asked.join(self.entries, "key").repartition("of").groupBy("of")
            .agg(F.collect_list(F.struct("key", "log0", "log1")).alias("hits"))
        )
        joined = packed.withColumn("of", name).join(hits, "of", "left").select("doc", "text", "hits.key", "hits.log0", "hits.log1")
        return small_batches(joined).mapInArrow(run_with_entries, schema)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (name, text): (name, key) of every expression and stem of the text."""
    for batch in batches:
        names, keys = [], []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = {expression(w) for w in words_of(text.as_py())}
            found = {word_key(w) for w in words} | {stem_key(w) for w in words}
            names += [name] * len(found)
            keys += found
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(keys, pa.int64())], ["of", "key"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", curve_rows: int = CURVE_ROWS, broadcast_labels: int = BROADCAST_LABELS, broadcast_entries: int = BROADCAST_ENTRIES) -> Fitted:
    """The models of the labelled rows whose fold is not 0.

    Labels are joined by id; an id labelled more than once is toxic if any label says so, rows without an id or a
    label are left out. The models count all labelled rows, on the executors, but those of the curve: CURVE_SHARE of
    them and at most about curve_rows, chosen by a hash of the id.
    """
    rows = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col) != 0))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("_toxic"))
    )
    size = rows.count()
    part = int(min(CURVE_SHARE, curve_rows / max(1, size)) * (1 << 40))
    in_curve = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("toxicity")), F.lit(1 << 40)) < part
    known = (lambda df: F.broadcast(df)) if size <= broadcast_labels else (lambda df: df)
    text = small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counts = durable(
        text.join(known(rows.where(~in_curve)), "_id").select("_text", "_toxic")
        .mapInArrow(_counted, "word long, stem long, n0 long, n1 long")
        .groupBy("word", "stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )
    made = likelihood_table(counts)
    fitted = Fitted(None, (0.0, 0.0), 0) if made is None else Fitted(durable(made[0]), made[1], broadcast_entries)
    chosen = text.join(known(rows.where(in_curve)), "_id").select("_text", "_toxic")
    each = lambda model, doc, texts: [doc[1], *[pa.array(c) for c in _features(model, texts)[0].T]]
    fields = "_toxic int, " + ", ".join(f"f{k} double" for k in range(N_FEATURES))
    sample = fitted.over(chosen, "_text", each, T.StructType.fromDDL(fields)).toPandas()
    fitted.curve = fit_curve(sample[[f"f{k}" for k in range(N_FEATURES)]].to_numpy(float), sample["_toxic"].to_numpy(float))
    return fitted


def _features(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its features, and its two length-normalised log-likelihoods, zero where there are no words."""
    found, likelihoods = np.zeros((len(texts), N_FEATURES)), np.zeros((len(texts), 2))
    step = max(1, len(texts)) if model.parts else 256  # parts are read for each step, whose batch is bounded by bytes
    for first in range(0, len(texts), step):
        words = [words_of(t.as_py()) for t in texts.slice(first, step)]
        model.learn(set().union(*words))
        for i, w in enumerate(words):
            if w:
                ordinary, toxic = model.likelihoods(w)
                found[first + i] = features_of(ordinary, toxic)
                likelihoods[first + i] = ordinary.mean(), toxic.mean()
    return found, likelihoods


def score(docs: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ordinary, toxic, score, predicted) of every row: the log-likelihoods a word under both models, the score in
    (0, 1), and 1 from 0.5 on.

    A null or empty text has no evidence and gets what the curve says of none. Repeated rows get a row each. Only the
    text is an input of the score.
    """
    def each(model: Model, doc: list[pa.Array], texts: pa.Array) -> list[pa.Array]:
        found, likelihoods = _features(model, texts)
        return [doc[0], pa.array(likelihoods[:, 0]), pa.array(likelihoods[:, 1]), pa.array(model.scores(found))]

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = fitted.over(rows, "_text", each, T.StructType.fromDDL(f"_id {kind}, ordinary double, toxic double, score double"))
    return out.select(F.col("_id").alias(id_col), "ordinary", "toxic", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, fitted: Fitted, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic."""
    def each(model: Model, doc: list[pa.Array], texts: pa.Array) -> list[pa.Array]:
        kept = pa.array(model.scores(_features(model, texts)[0]) < 0.5)
        return [column.filter(kept) for column in doc]

    return fitted.over(docs, text_col, each, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted", "ordinary", "toxic")
