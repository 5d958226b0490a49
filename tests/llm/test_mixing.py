from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.llm.mixing import MARGINS, NULL, feasible, fit_topics, margins, mix, rake_here, rake_there, topic_of, uniform, words_of

SCHEMA = "doc_id long, text string, lang string, source string, mass long, topic string"


def cells(seed=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame([(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(50, 900))) for a in range(5) for b in range(3) for c in range(4)], columns=[*MARGINS, "mass"])


def test_raking_meets_given_margins():
    asked = {"lang": {"l0": 5, "l1": 3, "l2": 2}, "source": {f"s{k}": 1 for k in range(5)}}
    got, report = rake_here(cells(), asked, power=1.0, rate=0.4)
    assert (got.weight <= got.mass + 1e-9).all() and np.allclose(report.reached, report.target, rtol=1e-8)
    whole = got.weight.sum()
    assert whole == pytest.approx(0.4 * got.mass.sum())
    assert np.allclose(got.groupby("lang").weight.sum() / whole, [0.5, 0.3, 0.2])
    assert np.allclose(got.groupby("source").weight.sum() / whole, 0.2)
    assert np.allclose(got.groupby("topic").weight.sum(), 0.4 * got.groupby("topic").mass.sum())


def test_raking_goes_on_after_cells_are_full():
    """A language asked for more than it has is kept whole, and its margin's others share what it lacks."""
    frame = cells()
    frame.loc[frame.lang == "l2", "mass"] //= 20
    got, report = rake_here(frame, {"lang": {"l0": 1, "l1": 1, "l2": 1}}, power=1.0, rate=0.5)
    by = report.set_index(["margin", "value"])
    assert by.loc[("lang", "l2"), "target"] == by.loc[("lang", "l2"), "mass"]
    assert by.loc[("lang", "l0"), "target"] == pytest.approx(by.loc[("lang", "l1"), "target"])
    assert np.allclose(report.reached, report.target, rtol=1e-3) and (got.weight >= 0.999 * got.mass).sum() >= 20


def test_values_without_a_target_are_not_drawn():
    got, report = rake_here(cells(), {"lang": {"l0": 1}}, rate=0.2)
    assert (got.weight[got.lang != "l0"] == 0).all() and got.weight.sum() == pytest.approx(0.2 * got.mass.sum(), rel=1e-6)
    assert np.allclose(report.reached, report.target)


def test_feasible_against_bisection():
    rng = np.random.default_rng(2)
    for _ in range(50):
        mass, weight = rng.integers(1, 100, 7).astype(float), rng.integers(0, 5, 7).astype(float)
        goal = rng.uniform(0, 1.2) * mass.sum()
        got = feasible(mass, weight, goal)
        low, high = 0.0, 1e6
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if np.minimum(mass, middle * weight).sum() < goal else (low, middle)
        assert np.allclose(got, np.where(weight > 0, np.minimum(mass, high * weight), 0), rtol=1e-6, atol=1e-6)
    assert len(feasible(np.zeros(0), np.zeros(0), 0.0)) == 0


def test_many_cells_are_raked_alike_by_shuffle(spark):
    frame = cells()
    frame.loc[frame.lang == "l2", "mass"] //= 3
    asked = {"lang": {"l0": 0.5, "l1": 0.2, "l2": 0.3}}
    here, _ = rake_here(frame, asked, rate=0.5)
    there = rake_there(spark.createDataFrame(frame), asked, rate=0.5).toPandas()
    both = here.merge(there, on=list(MARGINS))
    assert len(both) == len(frame) and np.allclose(both.weight_x, both.weight_y, rtol=1e-4)


def test_topics_are_counted_over_all_documents(spark):
    texts = ["Sun moon sun", "sun. moon", "moon star star", None, "", "moon\tstar", "sun moon"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen = Counter(w.decode() for t in texts for w in set(words_of(t)))
    some = sorted((w for w, n in seen.items() if 0.2 * 7 <= n <= 0.6 * 7), key=lambda w: (-seen[w], w))
    assert fit_topics(frame, shares=(0.2, 0.6)) == some == ["star", "sun"]
    assert fit_topics(frame, topics=1, shares=(0.2, 0.6)) == ["star"]
    numbers = {b"star": 0, b"sun": 1}
    assert topic_of(words_of("Sun STAR sun"), numbers) == 1 and topic_of(words_of("sun star"), numbers) == 0 and topic_of([], numbers) is None


def test_draw_meets_shares_and_covers_edges(spark):
    rows = [(i, "word " * 9, "en" if i % 10 < 8 else "fr", "big" if i % 3 else "small", 0, "x") for i in range(6000)]
    rows += [(None, None, None, None, 0, "x"), (1, "word " * 9, "en", "big", 0, "x"), (9000, "long " * 100_000, "en", "big", 0, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mix(frame, power=0.0, rate=0.3)
    assert got.columns[: len(frame.columns)] == frame.columns and got.count() == len(rows)
    probabilities = got.toPandas()._probability
    assert probabilities.between(0, 1).all() and got.where("doc_id is null").first()["_probability"] == 1  # less than its share
    assert mix(frame.limit(0)).count() == 0
    drawn = {(r["margin"], r["value"]): r for r in margins(mix(frame.where("doc_id < 9000"), power=0.0, rate=0.3)).collect()}
    whole = sum(r["expected"] for (m, _), r in drawn.items() if m == "lang")
    assert whole == pytest.approx(0.3 * 60_010, rel=1e-3)
    for m, v in (("lang", "en"), ("lang", "fr"), ("source", "big"), ("source", "small")):
        assert drawn[m, v]["expected"] == pytest.approx(whole / 2, rel=1e-3) and drawn[m, v]["drawn"] == pytest.approx(whole / 2, rel=0.1)


def test_columns_of_any_name_stay(spark):
    names = ["_words", "_shape", "_source", "doc", "tokens", "p", "topic", "a.b"]
    frame = spark.createDataFrame([(i, "a b", "en", "s", *names) for i in range(5)], ["doc_id", "text", "lang", "source", *names])
    for got in (mix(frame), mix(mix(frame)), mix(frame, driver_cells=0)):
        assert all(tuple(r)[4:12] == tuple(names) for r in got.collect()) and got.columns[-4:] == ["_topic", "_tokens", "_probability", "_kept"]
    assert "text" not in mix(frame, keep_text=False).columns


def test_given_topics_and_uniform(spark):
    frame = spark.createDataFrame([(1, "a", "en", "s", 0, "t"), (2, "b", "en", "s", 0, None)], SCHEMA)
    assert {r["_topic"] for r in mix(frame, topic_col="topic").collect()} == {"t", NULL}
    u = [r[0] for r in spark.range(1000).select(uniform(F.col("id"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.05
