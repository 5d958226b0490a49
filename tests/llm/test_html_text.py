import time

import numpy as np
import pytest

from quire.llm import html_text
from quire.llm.html_text import BOILER, CLASSES, COMMON_PAGES, COMMON_SHARE, MIN_PAGES, RUN_TOKENS, WINDOW, blocks, host_of, kept_blocks, main_text, run_hashes, run_levels, suffix_order, tokens_of

SCHEMA = "page_id long, url string, html string, text string, run long"


def texts(spark, pages):
    frame = spark.createDataFrame([(i, u, h, "clash", 0) for i, u, h in pages], SCHEMA)
    return {r["page_id"]: r for r in main_text(frame).collect()}


PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="has-sidebar"><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad <p>x</p> -->
<div class="ad">Buy</div><div class="cookie-notice">We use cookies</div><aside>Side</aside><form><p>Mail</p><input></form>
<article class="post"><header><h1>Head &amp; line</h1></header><p>One&nbsp;two
three<br>four<p><b>Five<p>six &lt;7&gt; &#233;</p><div class="share">Share</div><table><tr><td>a</td><td>b</td></tr></table></article>
<section id="comments"><article class="comment"><p>First!</p></article></section><footer>&copy; us</footer></body></html>"""


def test_markup_alone(spark):
    got = texts(spark, [(1, "http://a.b/c", PAGE), (2, None, None), (3, "http://a.b/", ""), (1, "http://a.b/c", PAGE)])
    assert got[1]["text"] == "Head & line\nOne two three four\nFive\nsix <7> é\na b"
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" and got[3]["n_chars"] == 0


@pytest.mark.parametrize(
    "html,want",
    [
        ("plain words", ["plain words"]),
        ("<p>a<p>b", ["a", "b"]),
        ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
        ("<p>a <script>x</p>", ["a"]),
        ("<p>a <!-- open", ["a"]),
        ("a < b and c > d", ["a < b and c > d"]),
        ('<p title="x > y">z</p>', ["z"]),
        ("<a " + '"' * 5001 + ">", None),
        ("<" * 20_000, None),
    ],
)
def test_broken_markup(html, want):
    got = [b.text for b in blocks(html)]
    assert want is None or got == want


@pytest.mark.parametrize(
    "html",
    ["<div>" * 16_000 + "</b>" * 16_000, "<p>" + "<b>" * 30_000 + "<p>" * 30_000, "<a" * 70_000, "<a href=x " * 20_000, "<script>" * 20_000, "<li>" * 40_000],
)
def test_parsing_takes_linear_time(html):
    start = time.process_time()
    blocks(html)
    assert time.process_time() - start < 3


def test_references_stay_within_their_piece():
    assert [b.text for b in blocks("<p>&am<b>p;lt;</b> &lt;b&gt;</p>")] == ["&amp;lt; <b>"]


@pytest.mark.parametrize("name", ["social-science", "ad-hoc", "legal-history", "form-results", "content-with-sidebar", "navy"])
def test_class_names_with_other_words_are_no_marks(spark, name):
    assert texts(spark, [(1, "http://a.b/", f'<article><p>One</p><div class="{name}" id="{name}">Two</div></article>')])[1]["text"] == "One\nTwo"


@pytest.mark.parametrize("name", ["ad", "ad-slot-1", "sideBar", "cookie-notice", "related-posts", "site-footer main"])
def test_class_names_of_marks_make_a_block_unlikely(spark, name):
    long = " ".join(f"w{i}" for i in range(80))
    got = texts(spark, [(1, "http://a.b/", f'<article><p>One</p><div class="{name}">Two</div></article>'), (2, "http://a.b/2", f'<div class="{name}">{long}</div>')])
    assert got[1]["text"] == "One" and got[2]["text"] == long


def story(i, n=40):
    return " ".join(f"w{i}x{k}" for k in range(n))


LEAD = "Welcome to the site of many things for all of you to read and see today"
OTHER = "A line that four articles of the host end with, as a licence may"
PLEA = "Please send your friends the address of this page and tell them what you think of it and of us"


def corpus():
    """Pages of one host with boilerplate that no markup tells, beside and inside articles; copies; other hosts."""
    plain = [(i, f"http://h.x/{i}", f"<body><div>{LEAD}</div><div>Story {i} has {story(i)}</div></body>") for i in range(6)]
    marked = [
        (100 + i, "http://i.x/", f"<body><div>{LEAD}</div><article><h1>T {i}</h1><p>{story(i)}</p><p>Read more</p><p>{PLEA}</p><p>{OTHER if i < 4 else f'a{i}'}</p></article></body>")
        for i in range(20)
    ]
    copies = [(200 + i, "http://j.x/", f"<body><div>{story(7)}</div><div>Printed on day {i}</div></body>") for i in range(4)]
    near = [(300 + i, f"http://k.x/{i}", f"<body><article><p>{story(8)}</p><p>{story(9)}</p><p>Day {i} of the year</p></article></body>") for i in range(7)]
    same = [(400, "http://l.x/", f"<body><article><p>{story(5)}</p></article><div>{LEAD}</div></body>")] * 6
    teaser = [(500, "http://m.x/", f'<div class="story">{story(3, 12)}</div><article class="teaser">read more</article>')]
    return plain + marked + copies + near + same + teaser + [(600, None, f"<p>{LEAD}"), (601, None, None), (602, "x", "")]


def test_unmarked_boilerplate_goes(spark):
    got = texts(spark, corpus())
    for i in range(6):
        assert got[i]["text"] == f"Story {i} has {story(i)}"
    for i in range(20):  # the plea stands on every page of the host, the other line on a few
        assert got[100 + i]["text"] == f"T {i}\n{story(i)}\n" + (OTHER if i < 4 else f"a{i}")
    for i in range(4):
        assert got[200 + i]["text"] == f"{story(7)}\nPrinted on day {i}"  # copies, not boilerplate
    for i in range(7):
        assert got[300 + i]["text"] == f"{story(8)}\n{story(9)}\nDay {i} of the year"
    assert got[400]["text"] == story(5)
    assert got[500]["text"] == f"{story(3, 12)}\nread more"
    assert got[600]["text"] == LEAD and got[601]["text"] == "" and got[602]["text"] == ""


def by_brute_force(pages):
    """The same with every run of every page written out."""
    parsed = [(p, host_of(u), [b for b in blocks(h)]) for p, u, h in pages]
    runs_of, seen, per_host = [], {}, {}
    for i, (_, host, found) in enumerate(parsed):
        stream, of_page = [], []
        for b in found:
            if b.kind == BOILER:
                continue
            t = tokens_of(b.text)
            t += [0] * (RUN_TOKENS - len(t))
            stream += t
            runs = [tuple(t[k : k + RUN_TOKENS]) for k in range(len(t) - RUN_TOKENS + 1)]
            hashed = [int(run_hashes(np.array(r, np.uint64))[0]) for r in runs]
            chosen = {0, len(runs) - 1} | {min(range(k, k + WINDOW), key=lambda j: hashed[j]) for k in range(len(runs) - WINDOW + 1)}
            of_page.append((len(t), {k: runs[k] for k in chosen}))
        runs_of.append(of_page)
        if stream:
            per_host[host] = per_host.get(host, 0) + 1
            kind = html_text.class_of(np.array(stream, np.uint64))
            for r in {r for _, chosen in of_page for r in chosen.values()}:
                pages_of, kinds = seen.setdefault((host, r), [set(), set()])
                pages_of.add(i)
                kinds.add(kind)
    out = []
    for (page, host, found), of_page in zip(parsed, runs_of, strict=True):
        shares = []
        for n, chosen in of_page:
            shared, common = set(), set()
            for k, r in chosen.items():
                pages_of, kinds = seen[host, r]
                if len(kinds) >= MIN_PAGES:
                    shared |= set(range(k, k + RUN_TOKENS))
                    if len(kinds) >= COMMON_PAGES and len(pages_of) >= COMMON_SHARE * per_host[host]:
                        common |= set(range(k, k + RUN_TOKENS))
            shares.append((len(shared) / n, len(common) / n))
        kept = kept_blocks(found, np.array([a for a, _ in shares]), np.array([b for _, b in shares]))
        out.append((page, "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)))
    return sorted(out)


@pytest.mark.parametrize("most", [html_text.BROADCAST_RUNS, 0])
def test_whole_query_against_brute_force(spark, most):
    frame = spark.createDataFrame([(i, u, h, "clash", 0) for i, u, h in corpus()], SCHEMA).repartition(3)
    got = sorted((r["page_id"], r["text"]) for r in main_text(frame, broadcast_runs=most).collect())
    assert got == by_brute_force(corpus())


def test_given_pages_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    given = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert sorted((r["page_id"], r["text"]) for r in main_text(pages).collect()) == by_brute_force(given)


def test_empty_table_and_a_very_long_page(spark):
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"w{i}" for i in range(400_000))
    got = texts(spark, [(1, "http://a.b/", f"<article><p>{long}</p></article>"), (2, "http://a.b/", "<p>x")])
    assert got[1]["text"] == long and got[2]["text"] == "x"


def test_sampled_suffixes_cover_what_pages_share():
    rng = np.random.default_rng(5)
    shared = rng.integers(1, 1 << 60, 60).tolist()
    streams = []
    for n in (0, 3, 20):
        own = lambda k: rng.integers(1, 1 << 60, k).tolist()
        streams.append(own(n) + shared + own(9))
    made = [html_text.Streams(np.array(s, np.uint64), np.array([0]), np.array([0])) for s in streams]
    runs = [set(m.sampled()[1].tolist()) for m in made]
    common = set.intersection(*runs)
    for m, s in zip(made, streams):
        places, hashed = m.sampled()
        hit = [p for p, h in zip(places.tolist(), hashed.tolist()) if h in common]
        at = s.index(shared[0])
        assert hit and min(hit) - at < WINDOW and at + 60 - (max(hit) + RUN_TOKENS) < WINDOW
        assert all(b - a <= RUN_TOKENS for a, b in zip(hit, hit[1:]))  # no gap between runs
        assert m.covered(np.array(hit))[0] * len(s) == max(hit) + RUN_TOKENS - min(hit)


def test_suffix_order():
    rng = np.random.default_rng(6)
    tokens = rng.integers(0, 3, 300).astype(np.uint64)
    places = np.flatnonzero(rng.random(293) < 0.5)
    order, new = suffix_order(tokens, places)
    runs = [tuple(tokens[p : p + RUN_TOKENS].tolist()) for p in places[order]]
    assert runs == sorted(runs) and new.tolist() == [True] + [a != b for a, b in zip(runs, runs[1:])]


def test_classes_and_hosts(spark):
    assert host_of("HTTPS://u@Ab.c:80/x") == "ab.c" and host_of(None) == "" and tokens_of("a b a")[0] == tokens_of("a")[0]
    assert html_text.class_of(np.arange(9, dtype=np.uint64)) < CLASSES
    levels = run_levels(spark.createDataFrame([("http://a/", f"<p>{LEAD}<p>{i}")for i in range(9)], "_url string, _html string"))
    assert {r["level"] for r in levels.collect()} == {html_text.COMMON}
