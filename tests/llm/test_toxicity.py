import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm.toxicity import (
    BROADCAST_ENTRIES, DISCOUNT, STEM_BACKOFF, WORD_BACKOFF, Model, expression, features_of, fit, fit_curve, fold, keep_ordinary, likelihood_table, score, stem, stem_key, word_key, words_of,
)

DOCS, LABELS = "doc_id long, text string, score string, predicted int", "doc_id long, toxic int, text string"


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    common, bad = [f"w{k}" for k in range(300)], ["grub", "slime", "vermin"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        words = [rng.choice(common) for _ in range(rng.randrange(5, 80))]
        if toxic:
            for _ in range(2 + len(words) // 20):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ".", "!!"]))
        docs.append((i, " ".join(words), "clash", 7))
        if i % 2:
            labels.append((i, int(toxic), "clash"))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame([*docs, (9001, None, "x", 0), (9002, "", "x", 0), (None, "slime grub", "x", 0), (5, docs[5][1], "x", 0)], DOCS)
    model = fit(frame, spark.createDataFrame([*labels, (None, 1, "x"), (3, None, "x"), labels[0]], LABELS))
    got = [(r["doc_id"], r["score"], r["predicted"]) for r in score(frame, model).collect()]
    assert len(got) == len(docs) + 4 and all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in got)
    by_id = {i: p for i, _, p in got}
    held = [(by_id[i], t) for i, t, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p == t for p, t in held]) > 0.97
    assert by_id[9001] == by_id[9002] == 0 and by_id[None] == 1
    kept = keep_ordinary(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(p == 0 for _, _, p in got)


def test_held_out_labels_are_not_seen(spark):
    docs, labels = corpus(400)
    frame = spark.createDataFrame(docs, DOCS)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, x) for i, t, x in labels]
    one, two = (sorted(score(frame, fit(frame, spark.createDataFrame(x, LABELS))).select("doc_id", "score").collect()) for x in (labels, flipped))
    assert one == two


def test_no_labels_one_class_and_empty_tables(spark):
    docs, labels = corpus(60)
    frame = spark.createDataFrame(docs, DOCS)
    for some in ([], [(i, 0, "x") for i in range(40)]):
        got = score(frame, fit(frame, spark.createDataFrame(some, LABELS))).collect()
        assert len({r["score"] for r in got}) == 1 and 0 < got[0]["score"] <= 0.5
    none = frame.limit(0)
    assert score(none, fit(none, spark.createDataFrame(labels, LABELS))).count() == 0


def brute_models(texts):
    """log P(expression | class) of both classes, from (text, toxic) of all counted documents, by plain dictionaries."""
    n = [Counter(), Counter()]
    for text, toxic in texts:
        n[toxic].update({expression(w) for w in words_of(text)})
    every = set(n[0]) | set(n[1])
    of_stem = [Counter(stem(w) for w in n[c]) for c in (0, 1)]  # continuation counts: different expressions
    both = Counter(map(stem, every))

    def p(c, word):
        s = stem(word)
        shared = (max(both[s] - DISCOUNT, 0) + DISCOUNT * len(both) / (len(both) + 1)) / len(every)
        backed = (max(of_stem[c][s] - DISCOUNT, 0) + (DISCOUNT * len(of_stem[c]) + STEM_BACKOFF * len(both)) * shared) / (len(n[c]) + STEM_BACKOFF * len(both))
        given = DISCOUNT * len(n[c]) + WORD_BACKOFF * len(every)
        return (max(n[c][word] - DISCOUNT, 0) + given * backed / (both[s] + 1)) / (sum(n[c].values()) + WORD_BACKOFF * len(every))

    return p, every, set(both)


def counted(docs, labels, in_curve):
    text = {i: t for i, t, *_ in docs}
    return [(text[i], t) for i, t, *_ in labels if zlib.crc32(str(i).encode()) % 5 and i not in in_curve]


@pytest.mark.parametrize("most", [BROADCAST_ENTRIES, 0])
def test_likelihoods_against_brute_force(spark, most):
    docs, labels = corpus(300)
    frame = spark.createDataFrame([*docs, (9003, "Grubby w1 zzzzz", "x", 0), (9004, None, "x", 0)], DOCS)
    fitted = fit(frame, spark.createDataFrame(labels, LABELS), curve_rows=0, broadcast_entries=most)
    assert (fitted.model is None) == (most == 0)
    p, every, stems = brute_models(counted(docs, labels, set()))
    for r in score(frame, fitted).join(frame.select("doc_id", "text"), "doc_id").collect():
        words = [expression(w) for w in words_of(r["text"])]
        for c, got in ((0, r["ordinary"]), (1, r["toxic"])):
            assert got == pytest.approx(sum(math.log(p(c, w)) for w in words) / len(words) if words else 0, rel=1e-5)
    for c in (0, 1):  # with an unknown expression of each stem, and of none, they sum to one
        table = {r["key"]: math.exp(r[f"log{c}"]) for r in fitted.entries.collect()}
        assert len(table) == len(every) + len(stems)
        assert sum(table.values()) + math.exp(fitted.rest[c]) == pytest.approx(1, abs=1e-5)


def test_joined_entries_score_like_broadcast_ones(spark):
    docs, labels = corpus(500)
    frame, marked = spark.createDataFrame([*docs, *docs[:3], (9001, None, "x", 0)], DOCS), spark.createDataFrame(labels, LABELS)
    one, two = fit(frame, marked), fit(frame, marked, broadcast_entries=0, broadcast_labels=0)
    a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in score(frame, m).collect()) for m in (one, two))
    assert a == b and two.model is None
    assert sorted(keep_ordinary(frame, one).collect()) == sorted(keep_ordinary(frame, two).collect())


def test_entries_in_parts_score_like_whole_ones(spark):
    docs, labels = corpus(500)
    frame, marked = spark.createDataFrame([*docs, *docs[:3], (9001, None, "x", 0), (9002, "Grubby zzzzz w1", "x", 0)], DOCS), spark.createDataFrame(labels, LABELS)
    one, two = fit(frame, marked), fit(frame, marked, broadcast_entries=60)
    assert two.model is None and 10 < len(two.parts) <= 32
    a, b = (sorted(score(frame, m).drop("doc_id").collect()) for m in (one, two))
    assert a == b
    plan = keep_ordinary(frame, two)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # no row for each word of a text
    assert sorted(keep_ordinary(frame, one).collect()) == sorted(keep_ordinary(frame, two).collect())


def test_rare_expressions_tell_no_more_than_their_stem(spark):
    rows = [(word_key(b"poison"), stem_key(b"poison"), 0, 30), (word_key(b"poisoned"), stem_key(b"poison"), 0, 9), (word_key(b"poisons"), stem_key(b"poison"), 0, 9)]
    rows += [(word_key(b"plain%d" % k), stem_key(b"p%dlain" % k), 20, 0) for k in range(50)] + [(word_key(b"seldom"), stem_key(b"seldom"), 0, 1)]
    entries, _ = likelihood_table(spark.createDataFrame(rows, "word long, stem long, n0 long, n1 long"))
    ratio = {r["key"]: r["log1"] - r["log0"] for r in entries.collect()}
    assert ratio[word_key(b"poison")] > ratio[word_key(b"poisons")] > ratio[stem_key(b"poison")] > 0  # an unknown one of its stem
    assert ratio[word_key(b"poison")] > ratio[word_key(b"seldom")] + 1


def test_all_labelled_rows_are_counted_but_the_curves(spark):
    docs, labels = corpus(600)
    docs += [(700 + k, f"w1 w2 oncesaid{k}", "x", 7) for k in range(40)]
    labels += [(700 + k, 0, "x") for k in range(40)]
    frame, marked = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    known = lambda m: {r["key"] for r in m.entries.collect()}
    asked = [word_key(b"oncesaid%d" % k) for k in range(40) if zlib.crc32(str(700 + k).encode()) % 5]
    assert set(asked) <= known(fit(frame, marked, curve_rows=0))
    assert 0 < sum(k in known(fit(frame, marked)) for k in asked) < len(asked)


def test_columns_of_any_name_stay_and_long_texts_are_scored(spark):
    docs, labels = corpus(300)
    names = ["text", "doc", "of", "key", "hits", "log0", "_text", "a.b"]
    frame = spark.createDataFrame([(i, t, *names[1:]) for i, t, *_ in docs] + [(9000, "w1 w2 " * 200_000, *names[1:])], ["doc_id", *names])
    for most in (BROADCAST_ENTRIES, 0):
        kept = keep_ordinary(frame, fit(frame.select("doc_id", "text"), spark.createDataFrame(labels, LABELS), broadcast_entries=most))
        assert kept.columns == frame.columns and kept.where("doc_id = 9000").count() == 1
        assert all(tuple(r)[2:] == tuple(names[1:]) for r in kept.limit(20).collect())


def test_fold(spark):
    got = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", fold("doc_id").alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in got)


def test_model_falls_back_to_stems_and_the_rest():
    model = Model(np.array([stem_key(b"vermin")]), np.array([[-3.0, -0.5]]), rest=(-9.0, -8.0))
    model.learn({b"vermins", b"other"})
    ordinary, toxic = model.likelihoods([b"vermins", b"other"])
    assert features_of(ordinary, toxic) == (1.75, 0.75, 1.75, 2.5) and features_of(ordinary[:0], toxic[:0]) == (0.0,) * 4


def test_curve_orders_scores():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    w = fit_curve(x, (x[:, 0] + 0.1 * rng.normal(size=500) > 0).astype(float))
    assert w[1] > 5 * np.abs(w[2:]).max()
