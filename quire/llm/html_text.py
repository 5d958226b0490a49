"""Main text of web pages: the shared runs of a host's pages decide, markup is what they are weighed against.

Pages are cut into blocks. Elements that HTML itself calls navigation, footers, forms
and the like, hidden ones and reader comments are left out. The token streams of all
other blocks are concatenated and their suffixes sorted: runs that distinct pages of a
host share are found side by side. Tokens that shared runs cover are boilerplate, unique
runs stay. How widely a run has to be shared depends on what the markup says: inside an
article it has to stand on half the pages of the host, elsewhere on a few.

The array is sampled. Of the suffixes of a block only the first, the last and those that
are minimizers of their neighbourhood are sorted, by their first RUN_TOKENS tokens: what
two pages share is sampled alike on both, sampled runs overlap or touch, and their union
covers longer shared runs whatever their length. Each step of pages sorts its own
suffixes; runs are then added up over all steps, so that no host has to fit a task.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import durable, row_key, small_batches, table

#: Least tokens of a run (a shorter block is one run), and neighbouring suffixes of which one at least is sampled.
RUN_TOKENS = 8
WINDOW = 8
#: Pages count as distinct by this many classes of what they say; a run is shared from MIN_PAGES classes on. It is common
#: to the site from COMMON_PAGES classes on, if COMMON_SHARE of the host's pages have it as well.
CLASSES = 64
MIN_PAGES = 3
COMMON_PAGES, COMMON_SHARE = 5, 0.5
#: A block goes if this share of its tokens is covered, or this share of its characters is in links.
MOST_COVERED = 0.5
MOST_LINKED = 0.6
#: A block whose class or id names boilerplate stays if it has so many words, none of them shared, and few links.
UNLIKELY_WORDS, UNLIKELY_LINKED = 60, 0.3
#: Of copies of an article nearly everything is shared; then less than this share of it would stay, and all of it stays.
COPY_SHARE = 0.5
#: Tokens whose suffixes are sorted at once.
STEP_TOKENS = 1 << 20
#: Words whose hashes a worker remembers.
MEMORY_WORDS = 200_000
#: Up to so many shared runs (some 9 bytes each) go to every task; more are joined by page.
BROADCAST_RUNS = 1 << 20

ARTICLE, OPEN, BOILER = 0, 1, 2
SHARED, COMMON = 1, 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|object|canvas|select|title|datalist)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>"
    r"|<(?=[a-z])[^>]*>",
    re.I | re.S,
)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_NAME = re.compile(r"[A-Z]*[a-z]+|[A-Z]+")

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody tfoot thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPACE = frozenset("br td th wbr img input hr".split())
_INSIDE_ARTICLE = frozenset(("article", "main"))
_BOILER_TAGS = frozenset("nav footer aside form button dialog menu head search".split())
_COMMENT_MARKS = frozenset("comment comments commentlist commentarea disqus respond reply replies discussion".split())
_BOILER_MARKS = frozenset(
    "nav navbar navigation navigations menu menus submenu breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts "
    "advertisement advertisements advertising banner promo promotion promoted sponsor sponsored sponsors cookie cookies consent gdpr "
    "notice notices alert popup popover modal overlay newsletter subscribe subscription signup signin login share sharing shares "
    "social related recommended recommendations form search toolbar pagination pager widget widgets copyright legal disclaimer "
    "contentinfo complementary dialog".split()
)
#: These say boilerplate of the page, and a title of an article.
_HEAD_MARKS = frozenset(("header", "masthead", "topbar"))


#: These say nothing by themselves; a name with any other word, as in social-science or ad-hoc, is no mark.
_NEUTRAL = frozenset(
    "a an and area article bar blog body bottom box button buttons by center col column columns container content desktop dfp entry "
    "first fixed floating foot full global google grid group head heading id in inline inner inserted item items js large last left "
    "line link links list listing local lower main middle mobile of on outer page pages panel post posts primary reader readers right "
    "row secondary section sections site slot small sticky text the title top unit units upper user users wide width wp wrap wrapper".split()
)
_CLOSED_BY = {
    **{name: ((name,), ("ul", "ol", "dl", "table", "tbody", "select")) for name in ("li", "tr", "option")},
    **{name: (("dt", "dd"), ("ul", "ol", "dl", "table", "tbody", "select")) for name in ("dt", "dd")},
}
_P_CLOSED = (("p",), ("li", "td", "th", "div", "article", "section", "body", "blockquote", "main"))


@dataclass
class Block:
    kind: int
    text: str
    linked: int  # characters inside links
    unlikely: bool = False  # by class, id or role


def _words_of(value: str) -> set[str]:
    """The words of those names in a class or id that consist of marks and neutral words alone."""
    found: set[str] = set()
    for name in value.split():
        parts = [w.lower() for w in _NAME.findall(name)]
        for words in (set(parts), {"".join(parts)}):  # side-bar is a sidebar
            if words <= _ALL_MARKS:
                found |= words
    return found


_ALL_MARKS = _COMMENT_MARKS | _BOILER_MARKS | _HEAD_MARKS | _NEUTRAL


_ASKED = _BOILER_TAGS | {"header"}


@lru_cache(maxsize=4096)
def _marked(name: str, attr: str, in_article: bool) -> tuple[bool, bool]:
    """Whether the element is boilerplate by its tag, and whether its class, id or role makes that likely."""
    hard = name in _BOILER_TAGS or (name == "header" and not in_article)
    if not attr or attr.isspace():
        return hard, False
    if _HIDDEN.search(attr):
        return True, False
    if name in ("html", "body"):
        return False, False
    words: set[str] = set()
    for m in _MARKS.finditer(attr):
        words |= _words_of(m[2] or m[3] or m[4] or "")
    if words & _COMMENT_MARKS:
        return True, False
    return hard, name not in _INSIDE_ARTICLE and bool(words & _BOILER_MARKS) or bool(words & _HEAD_MARKS) and not in_article


def _end_of_markup(html: str) -> int:
    """Behind the last tag that is closed: no search for the end of a tag goes beyond, so that none is in vain."""
    return html.rfind(">") + 1


def blocks(html: str | None) -> list[Block]:
    """The non-blank blocks of a page in order, references decoded, white space single. Takes time linear in the page."""
    html = html or ""
    out: list[Block] = []
    buffer: list[str] = []
    # of each open element: name, boilerplate by tag, unlikely by its marks, articles around it
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
    opened: dict[str, list[int]] = {}  # the places in the stack of each name
    linked = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                _, boiler, unlikely, articles = stack[-1]
                out.append(Block(BOILER if boiler else ARTICLE if articles else OPEN, text, linked, unlikely))
            buffer.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if "&" in piece:
            piece = entities.unescape(piece)
        buffer.append(piece)
        if opened.get("a"):
            linked += len(piece)

    def last_of(names: tuple[str, ...]) -> int:
        most = 0
        for n in names:
            places = opened.get(n)
            if places and places[-1] > most:
                most = places[-1]
        return most

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop()[0]].pop()

    at, end = 0, _end_of_markup(html)
    for m in _TOKEN.finditer(html, 0, end):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        _, closing, name, attr = m.groups()
        if name is None:
            if at == end and _unclosed(m):
                at = len(html)
            continue
        name = name.lower()
        if closing:
            if name in _BLOCKS:
                flush()
            places = opened.get(name)
            if places:
                pop_to(places[-1])
            if name in _SPACE:
                buffer.append(" ")
            continue
        if name in _BLOCKS:
            flush()
            closes, bounds = _CLOSED_BY.get(name, _P_CLOSED)
            depth = last_of(closes)
            if depth and depth > last_of(bounds):
                pop_to(depth)
        if name in _SPACE:
            buffer.append(" ")
        if name in _VOID:
            continue
        _, boiler, unlikely, articles = stack[-1]
        hard, marked = _marked(name, attr, articles > 0) if attr or name in _ASKED else (False, False)
        if name in _INSIDE_ARTICLE and not hard:
            unlikely, articles = False, articles + 1
        opened.setdefault(name, []).append(len(stack))
        stack.append((name, boiler or hard, unlikely or marked, articles))
    if at < len(html):
        add(html[at:].split("<!--", 1)[0])
    flush()
    return out


def _unclosed(m: re.Match) -> bool:
    """Whether a comment, or an element without markup inside, goes on to the end of the page."""
    if m["raw"]:
        return not re.search(rf"</{m['raw']}\s*>\Z", m[0], re.I)
    return m[0].startswith("<!--") and not m[0].endswith("-->")


def host_of(url: str | None) -> str:
    """The host of a URL in lower case, without user and port; the whole of what is no URL."""
    rest = (url or "").split("://", 1)[-1]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rsplit("@", 1)[-1].split(":", 1)[0].lower()


class _Hashes(dict):
    """Word to hash; what was asked before is remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return found


_HASHES = _Hashes()


def tokens_of(text: str) -> list[int]:
    return list(map(_HASHES.__getitem__, text.split()))


def judged_by_runs(block: Block) -> bool:
    return block.kind != BOILER


@dataclass
class Streams:
    """The token streams of a step of pages, one behind the other; a short block is filled up to a run."""

    tokens: np.ndarray
    starts: np.ndarray  # of each block
    pages: np.ndarray  # of each block

    @classmethod
    def of(cls, found: list[list[Block]]) -> Streams:
        tokens, starts, pages = [], [], []
        for page, of_page in enumerate(found):
            for b in filter(judged_by_runs, of_page):
                starts.append(len(tokens))
                pages.append(page)
                tokens += tokens_of(b.text)
                tokens += [0] * (RUN_TOKENS - (len(tokens) - starts[-1]))
        return cls(np.array(tokens, np.uint64), np.array(starts, np.int64), np.array(pages, np.int64))

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts, append=len(self.tokens))

    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of the suffixes that are sorted, and the hash of each one's first RUN_TOKENS tokens."""
        if not len(self.tokens):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sizes = self.sizes()
        hashed = run_hashes(self.tokens)
        left = np.repeat(self.starts + sizes, sizes) - np.arange(len(self.tokens))
        chosen = np.zeros(len(hashed), bool)
        chosen[self.starts] = chosen[self.starts + sizes - RUN_TOKENS] = True
        inside = np.flatnonzero(left >= RUN_TOKENS + WINDOW - 1)
        if len(inside):
            windows = np.lib.stride_tricks.sliding_window_view(hashed, WINDOW)
            for first in range(0, len(inside), 1 << 17):
                some = inside[first : first + (1 << 17)]
                chosen[some + windows[some].argmin(axis=1)] = True
        places = np.flatnonzero(chosen)
        return places, hashed[places]

    def covered(self, places: np.ndarray) -> np.ndarray:
        """Of each block the share of its tokens that runs from these places cover."""
        edge = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(edge, places, 1)
        np.add.at(edge, places + RUN_TOKENS, -1)
        return np.add.reduceat((np.cumsum(edge[:-1]) > 0).astype(np.float64), self.starts) / self.sizes() if len(self.starts) else np.zeros(0)


def run_hashes(tokens: np.ndarray, size: int = RUN_TOKENS) -> np.ndarray:
    """A hash of the `size` tokens from each place on, for places with as many left."""
    with np.errstate(over="ignore"):
        n = len(tokens) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
        for k in range(size):
            out = (out ^ tokens[k : k + n]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
        return out


def run_keys(hashed: np.ndarray, hosts: np.ndarray) -> np.ndarray:
    """One number for a run and the host that it stands on."""
    with np.errstate(over="ignore"):
        mixed = (hashed ^ (hosts * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC4CEB9FE1A85EC53)
        return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def suffix_order(tokens: np.ndarray, places: np.ndarray, size: int = RUN_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """The sampled suffix array: the order of the places by the `size` tokens from each on, and where a new run begins in it."""
    prefix = [tokens[places + k] for k in range(size)]
    order = np.lexsort(prefix[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for column in prefix:
            new[1:] |= column[order[1:]] != column[order[:-1]]
    return order, new


def _steps(urls: pa.Array, pages: pa.Array) -> Iterator[tuple[int, list[list[Block]], np.ndarray]]:
    """(first page, blocks of the step's pages, hash of each page's host) of runs of pages of some STEP_TOKENS tokens."""
    found, size, first = [], 0, 0

    def step() -> tuple[int, list[list[Block]], np.ndarray]:
        hosts = [xxhash.xxh64_intdigest(host_of(urls[i].as_py()).encode("utf-8", "replace")) for i in range(first, first + len(found))]
        return first, found, np.array(hosts, np.uint64)

    for page in pages:
        found.append(blocks(page.as_py()))
        size += sum(len(b.text) for b in found[-1]) // 6 + 1
        if size >= STEP_TOKENS:
            yield step()
            first, found, size = first + len(found), [], 0
    if found:
        yield step()


def class_of(stream: np.ndarray) -> int:
    """Which of the classes a page falls into by its whole stream: pages that say the same count once."""
    return xxhash.xxh64_intdigest(stream.tobytes()) % CLASSES


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages (url, html): each different sampled run of a step with its host, pages and their classes, as bits; and each
    host's number of pages, without a run."""
    for batch in batches:
        for _, found, hosts in _steps(*batch.columns):
            streams = Streams.of(found)
            if not len(streams.tokens):
                continue
            places, hashed = streams.sampled()
            sizes = streams.sizes()
            page = np.repeat(streams.pages, sizes)[places]
            filled, first = np.unique(streams.pages, return_index=True)
            ends = np.append(streams.starts[first][1:], len(streams.tokens))
            bits = np.zeros(len(found), np.uint64)
            bits[filled] = [1 << class_of(streams.tokens[a:b]) for a, b in zip(streams.starts[first].tolist(), ends.tolist(), strict=True)]

            order, new = suffix_order(streams.tokens, places)
            run = np.empty(len(order), np.int64)
            run[order] = np.cumsum(new)
            order = np.lexsort((page, hosts[page], run))  # equal runs of a host side by side
            of, on = page[order], hosts[page][order]
            new = np.concatenate(([True], (run[order][1:] != run[order][:-1]) | (on[1:] != on[:-1])))
            starts = np.flatnonzero(new)
            pages_of = np.add.reduceat((new | np.concatenate(([True], of[1:] != of[:-1]))).astype(np.int64), starts)
            classes = np.bitwise_or.reduceat(bits[of], starts).view(np.int64)
            by_host, n = np.unique(hosts[filled], return_counts=True)
            empty = pa.nulls(len(by_host), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(run_keys(hashed[order][starts], on[starts])), empty]),
                    pa.array(np.concatenate((on[starts], by_host)).view(np.int64)),
                    pa.array(np.concatenate((pages_of, n))),
                    pa.concat_arrays([pa.array(classes), empty]),
                ],
                ["run", "host", "pages", "classes"],
            )


def kept_blocks(found: list[Block], shared: np.ndarray, common: np.ndarray) -> list[bool]:
    """Which blocks of a page are its main text; shared, common: the shares covered of those that runs judge."""
    judged = [i for i, b in enumerate(found) if judged_by_runs(b)]
    words = {i: len(found[i].text.split()) for i in judged}
    few_links = lambda i, most: found[i].linked < most * len(found[i].text)
    articles, others = [], []
    for k, i in enumerate(judged):
        if found[i].unlikely and not (words[i] >= UNLIKELY_WORDS and shared[k] < MOST_COVERED and few_links(i, UNLIKELY_LINKED)):
            continue
        if found[i].kind == ARTICLE:
            articles.append((i, common[k] < MOST_COVERED))
        elif few_links(i, MOST_LINKED):
            others.append((i, shared[k] < MOST_COVERED, common[k] < MOST_COVERED))
    size = lambda places: sum(words[i] for i in places)
    own = [i for i, unique in articles if unique]
    if size(own) < COPY_SHARE * size(i for i, _ in articles):
        own = [i for i, _ in articles]  # a copy of another page's article
    beside = [i for i, unique, _ in others if unique]
    if not own and size(beside) < COPY_SHARE * size(i for i, *_ in others):
        # without an article, and little of it unique: a copy of a few pages, or of all of them
        beside = [i for i, _, few in others if few] or [i for i, *_ in others]
    if size(beside) < size(own):
        beside = []
    kept = {*own, *beside}
    return [i in kept for i in range(len(found))]


def _texts(found: list[list[Block]], hosts: np.ndarray, runs: np.ndarray, levels: np.ndarray) -> list[str]:
    """The main text of each page; runs: the shared ones in order, levels: SHARED or COMMON of each."""
    streams = Streams.of(found)
    places, hashed = streams.sampled()
    level = np.zeros(len(places), np.int8)
    if len(runs) and len(places):
        keys = run_keys(hashed, hosts[np.repeat(streams.pages, streams.sizes())[places]])
        at = np.minimum(np.searchsorted(runs, keys), len(runs) - 1)
        level = np.where(runs[at] == keys, levels[at], 0)
    shared, common = streams.covered(places[level >= SHARED]), streams.covered(places[level == COMMON])
    bounds = np.searchsorted(streams.pages, np.arange(len(found) + 1))
    texts = []
    for page, of_page in enumerate(found):
        a, b = bounds[page], bounds[page + 1]
        kept = kept_blocks(of_page, shared[a:b], common[a:b])
        texts.append("\n".join(x.text for x, k in zip(of_page, kept, strict=True) if k))
    return texts


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """(id, url, text, n_chars) of every page: its blocks of main text joined by single line feeds.

    - Left out unseen: nav, footer, aside, form, button, dialog and the like, header outside an article, hidden elements,
      reader comments. Blocks that class, id or role make unlikely go unless long, unlinked and unshared.
    - A block inside an article goes if runs that are common to the site cover it, any other if shared runs cover it or
      links fill it. What stands beside an article stays if it is unique and says more than the article, as beside a teaser.
    - A page of which nearly everything is shared is a copy and keeps its article, or what is least shared, whole.
    - A null or empty page has an empty text, a text without markup is one block. Unclosed elements end with their
      parents, unclosed comments and scripts with the page. Repeated rows get a row each, and count as pages of the
      host but not as distinct. Pages without a URL are one host. Other columns are not looked at.
    """
    keyed = small_batches(pages).select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    levels = run_levels(keyed.select("_url", "_html"))
    kind = pages.schema[id_col].dataType.simpleString()
    fields = f"_id {kind}, _url string, text string"
    if levels.count() <= broadcast_runs:
        found = levels.toArrow().sort_by("run")
        known = pages.sparkSession.sparkContext.broadcast((found.column("run").to_numpy(), found.column("level").to_numpy()))

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _judged(batch, *known.value)

        out = keyed.mapInArrow(judged, fields)
    else:
        row = row_key("_id", "_url", "_html")
        spots = keyed.select(row.alias("_row"), "_url", "_html").mapInArrow(_spots, "row long, run long")
        hits = (
            spots.join(levels, "run")
            .repartition("row")  # by page, so that the join above can be split where a run is hot
            .groupBy("row").agg(F.collect_list(F.struct("run", "level")).alias("hits"))
        )
        joined = keyed.join(hits, row == F.col("row"), "left").select("_id", "_url", "_html", "hits.run", "hits.level")
        out = small_batches(joined).mapInArrow(_judged_with_runs, fields)
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def run_levels(pages: DataFrame) -> DataFrame:
    """(run, level) of the runs that pages (url, html) of one host share: SHARED, or COMMON to the site."""
    counted = (
        pages.mapInArrow(_counted, "run long, host long, pages long, classes long")
        .groupBy("host", "run").agg(F.sum("pages").alias("pages"), F.bit_or("classes").alias("classes"))
    )
    shared = durable(counted.where(F.col("run").isNull() | (F.bit_count("classes") >= MIN_PAGES)))
    hosts = shared.where("run is null").select("host", F.col("pages").alias("of"))
    common = (F.bit_count("classes") >= COMMON_PAGES) & (F.col("pages") >= F.col("of") * COMMON_SHARE)
    return durable(shared.where("run is not null").join(hosts, "host").select("run", F.when(common, COMMON).otherwise(SHARED).cast("int").alias("level")))


def _judged(batch: pa.RecordBatch, runs: np.ndarray, levels: np.ndarray) -> pa.RecordBatch:
    texts: list[str] = []
    for _, found, hosts in _steps(batch.column(1), batch.column(2)):
        texts += _texts(found, hosts, runs, levels)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["_id", "_url", "text"])


def _judged_with_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same over rows that bring along the runs found on their page."""
    for batch in batches:
        runs, first = np.unique(batch.column(3).flatten().to_numpy(), return_index=True)
        yield _judged(batch, runs, batch.column(4).flatten().to_numpy()[first])


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages (row, url, html): (row, run) of every sampled run, once a page."""
    for batch in batches:
        rows = batch.column(0).to_numpy()
        for first, found, hosts in _steps(batch.column(1), batch.column(2)):
            streams = Streams.of(found)
            if len(streams.tokens):
                places, hashed = streams.sampled()
                page = np.repeat(streams.pages, streams.sizes())[places]
                pairs = np.unique(np.stack([rows[first + page], run_keys(hashed, hosts[page])], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["row", "run"])


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
