from collections import Counter

import pytest

from quire.llm.quality import BROADCAST_LINES, quality, repeat_words, text_stats

SCHEMA = "doc_id long, text string, source string, n_words string"


def run(spark, rows, **more):
    return {r["doc_id"]: r for r in quality(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), **more).collect()}


def slow_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)})


@pytest.mark.parametrize("text", ["", "a", "a b c", "a b c a b c", "a a a a a", "x a b c y a b c z a b", "a b c d " * 9])
def test_repeat_words(text):
    words = text.encode().split()
    assert repeat_words(words) == slow_repeats(words)


def test_statistics():
    n, chars, symbols, dup, _ = text_stats("é#b  <c>\n\né#b  <c>\n \nx\x1cy\té#b  <c>")
    assert (n, chars, symbols, dup) == (7, 21, 9, 1)
    assert text_stats(None) == text_stats("") == (0, 0, 0, 0, 0)


@pytest.mark.parametrize("most", [BROADCAST_LINES, 0])
def test_common_lines_go_and_deplete_but_copies_do_not(spark, most):
    foot = " ".join(f"f{k}" for k in range(60))
    body = lambda i, n: " ".join(f"d{i}w{k}" for k in range(n))
    rows = [(i, f"{body(i, 10)}\n{foot.upper()}", "h") for i in range(20)]
    rows += [(100, f"{body(100, 200)}\n  {foot}\n\n{foot}\nend", "h"), (101, f"{body(101, 10)}\n{foot}", "other"), (102, None, None), (103, "", "h")]
    rows += [(104, f"{body(104, 45)}\n{foot}", "h"), (105, f"{body(105, 60)}\nno word of it\n{foot}", "h")]
    rows += [(200 + i, body("copy", 80), "h") for i in range(60)]
    got = run(spark, rows, broadcast_lines=most)
    assert all(not got[i]["kept"] and not got[i]["base_failed"] and got[i]["common_words"] == 60 and got[i]["clean_text"] == body(i, 10) for i in range(20))
    assert got[100]["kept"] and got[100]["common_words"] == 120 and got[100]["n_common_lines"] == 2
    assert got[100]["clean_text"] == f"{body(100, 200)}\n\nend"
    assert got[101]["kept"] and got[101]["common_words"] == 0
    assert got[102]["base_failed"] and got[102]["clean_text"] is None and got[103]["base_failed"]
    assert not got[104]["kept"] and not got[104]["base_failed"] and got[105]["kept"]  # 45 words left, and 64
    assert all(got[200 + i]["kept"] and got[200 + i]["n_common_lines"] == 0 for i in range(60))


def test_limits_follow_the_host(spark):
    texts = [(i, f"own {i}\n" + ("seldom" if i < 5 else "other") + ("\nfrequent" if i % 50 == 0 else ""), "h") for i in range(400)]
    at = lambda **more: sum(r["n_common_lines"] for r in run(spark, texts, **more).values())
    assert at() == 395 + 8 + 5  # from 4 of 400 texts on
    assert at(common_share=0.015) == 395 + 8
    assert at(common_share=0.5) == 395
    assert at(common_share=2, common_most=8) == 395 + 8  # so many texts are enough in any host


def test_a_very_long_text(spark):
    text = "\n".join(f"line {i} of many" for i in range(200_000))
    got = run(spark, [(1, text, "h"), (2, "x", "h")])
    assert got[1]["n_words"] == 800_000 and got[1]["clean_text"] == text and not got[2]["kept"]


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a " * 100, "h", "c")] * 3
    assert quality(spark.createDataFrame(rows, SCHEMA)).count() == 3
    assert quality(spark.createDataFrame(rows, SCHEMA), broadcast_lines=-1).count() == 3
    assert run(spark, []) == {}
