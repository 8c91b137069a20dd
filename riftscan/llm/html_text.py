"""Main text of web pages: the best-scoring contiguous stretch of words and tags.

Method (maximum-scoring subsequence). A page is a sequence of words and tags. Words score above zero and tags below,
by weights learned from labelled pages; one scan keeps the stretch with the largest sum (of equal ones the first and
shortest). The blocks that the stretch touches are the content; what lies inside elements that are never article text
(``ASIDE`` tags and roles, ``NOISE`` names of classes and ids) is no candidate and scores nothing.

Weights. ``train`` counts words and tags inside and outside the labelled content, of at most ``max_pages`` pages (taken by
a hash of id and address). A page labels itself where it names its content (one ``article``, or else one ``main``), or by a
column of labelled text: a block is content if that text has it as a block. A word's weight is the log odds that a word
under such an innermost block, in a link or not, is content; a tag's that of its name, cut to be negative. Pages that
label themselves are also counted as if they didn't, so that weights hold for pages without such elements; a weight depends
on where the word or tag stands: in a plain page, beside the named content, or in it.

Rules of the text. Character references are decoded as browsers do; white space (any that Unicode calls so) inside a
block becomes one space; a line break is white space; blocks are joined by two newlines. A ``header`` inside the article
keeps its headings only.

Defined results. Null or empty html gives an empty text, repeated rows come repeatedly, a page of any length is read whole and
once, and of columns that share a name the first counts. Without labelled pages weights are the priors. An empty table
gives no rows.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import columns_of

# --- fixed values: names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript template title textarea".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_ITSELF = frozenset("p li dt dd td th tr option tbody thead tfoot".split())
#: Elements that are never part of an article.
ASIDE = frozenset("nav menu footer aside form dialog head button select datalist svg object audio video canvas search".split())
ASIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar".split())
#: Words in the names of classes and ids that mark elements beside the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adsense banner breadcrumb breadcrumbs comment "
    "commentlist comments consent cookie cookies disqus disclaimer footer gdpr header login masthead menu modal nav navbar navigation "
    "navi newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related "
    "replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split())
#: Beside one of these a name says something else (``with-sidebar``, ``no-comments``).
NO_NOISE = frozenset("has no not with without".split())
#: What is called header beside one of these is the article's own.
ARTICLE_NAMES = frozenset("article entry post story".split())
#: Names that mark readers' remarks or adverts even on an article or heading.
NEVER = frozenset("ad advert advertisement comment comments sponsored".split())
KNOWN = BLOCKS | VOID | frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())

_TOKEN = re.compile(
    r"<!--(?:>|->)?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>?|<[!?/][^>]*>?")
_NAME = re.compile(r"(?:^|[\s/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")

_COMMENT_END = re.compile("--!?>")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>]|$)", re.I | re.A) for tag in RAW}

#: Where a word or tag stands: in a page that names no content, beside the named content, in it.
PLAIN, OUTSIDE, INSIDE = range(3)
#: Weights of words without labels by that place, of tags, and the bounds of learned weights.
WORD_PRIOR, WORD_BOUNDS, TAG_PRIOR, TAG_BOUNDS = (0.5, -0.5, 0.5), (-2.0, 4.0), -0.2, (-4.0, -0.01)
#: What elements hold: candidates; a header inside the article; nothing, by their tag or role; nothing, by their name.
CONTENT, HEADER, BESIDE, NAMED = range(4)


def is_noise(tag: str, attributes: str) -> int:
    """BESIDE or NAMED if an element's role, or its classes or id, place it beside the article; else 0."""
    for what, *values in _NAME.findall(attributes):
        value = next((v for v in values if v), "")
        if what.lower() == "role":
            if value.lower() in ASIDE_ROLES and tag not in ("body", "html"):
                return BESIDE
        elif tag not in ("body", "html", "main"):
            for name in value.split():
                pieces = {p.lower() for p in _PIECE.findall(name)}
                if "header" in pieces and pieces & ARTICLE_NAMES:
                    pieces.remove("header")
                if pieces & (NEVER if tag == "article" or tag in HEADINGS else NOISE) and not pieces & NO_NOISE:
                    return NAMED
    return CONTENT


class Page:
    """A page's runs of words and tags in order, and its blocks of text."""

    def __init__(self, html: str | None) -> None:
        #: (block, -1 for a tag, -2 for what is no candidate; name; whether in an article or main element; words in the run)
        self.runs: list[tuple[int, str, bool, int]] = []
        self._blocks: list[list[str]] = []
        #: First run of every article and main element, and the run behind its last.
        self._spans: dict[str, list[list[int]]] = {"article": [], "main": []}
        self._fresh = True
        #: Open elements that matter: tag and what it holds.
        self._open: list[tuple[str, int]] = []
        self._names: Counter = Counter()
        self._links = 0
        self._read(html or "")

    def _read(self, html: str) -> None:
        at = 0
        while found := _TOKEN.search(html, at):
            if found.start() > at:
                self._text(html[at:found.start()])
            at, tag = found.end(), found[2]
            if tag is None:
                if found[0] == "<!--":
                    end = _COMMENT_END.search(html, at)
                    at = end.end() if end else len(html)
            elif not found[0].endswith(">"):
                return  # the page ends inside a tag
            elif found[1]:
                self._close(tag.lower())
            else:
                tag = tag.lower()
                self._start(tag, found[3])
                if tag in RAW:
                    end = _RAW_END[tag].search(html, at)
                    at = end.start() if end else len(html)
        self._text(html[at:])

    def _start(self, tag: str, attributes: str) -> None:
        top = self._open[-1][0] if self._open else ""
        if tag in BLOCKS:
            self._fresh = True
            if top == "p" or top == tag and tag in CLOSED_BY_ITSELF:
                self._pop()
        elif tag == "br" and not self._fresh:
            self._blocks[-1].append(" ")
        if top == "head" and tag not in IN_HEAD:
            self._pop()
        holds = self._holds()
        inner = holds
        if holds == CONTENT:
            if attributes and (named := is_noise(tag, attributes)):
                inner = named
            elif tag in ASIDE or tag in RAW:
                inner = BESIDE
            elif tag == "header":
                inner = HEADER if self._names["article"] else BESIDE
        elif holds == HEADER and tag in HEADINGS:
            inner = CONTENT
        if tag not in VOID and (tag in BLOCKS or inner != CONTENT):
            if inner == CONTENT and tag in self._spans:
                self._spans[tag].append([len(self.runs), -1])
            self._open.append((tag, inner))
            self._names[tag] += 1
        elif tag == "a":
            self._links += 1
        self._run(-1, tag, 1)

    def _pop(self) -> str:
        tag, holds = self._open.pop()
        self._names[tag] -= 1
        if holds == CONTENT and tag in self._spans:
            next(span for span in reversed(self._spans[tag]) if span[1] < 0)[1] = len(self.runs)
        return tag

    def _close(self, tag: str) -> None:
        if self._names[tag] or tag not in BLOCKS:  # browsers ignore the end of a block that isn't open
            self._run(-1, f"/{tag}", 1)
        if tag in BLOCKS:
            self._fresh = True
            self._links = 0
        elif tag == "a":
            self._links = max(0, self._links - 1)
        if self._names[tag]:
            while self._pop() != tag:
                pass

    def _holds(self) -> int:
        return self._open[-1][1] if self._open else CONTENT

    def _run(self, block: int, name: str, count: int) -> None:
        holds = self._holds()
        if holds == CONTENT or holds == BESIDE:
            self.runs.append((block if holds == CONTENT else -2, name, self._names["article"] + self._names["main"] > 0, count))

    def _text(self, text: str) -> None:
        holds = self._holds()
        if holds in (HEADER, NAMED) or not text:
            return
        words = len(text.split())
        if holds == CONTENT:
            if not words:
                if not self._fresh:
                    self._blocks[-1].append(" ")
                return
            if self._fresh:
                self._blocks.append([])
                self._fresh = False
            self._blocks[-1].append(references.unescape(text) if "&" in text else text)
        inner = next((tag for tag, _ in reversed(self._open) if tag in BLOCKS), "body")
        self._run(len(self._blocks) - 1, f"{inner}{' a' if self._links or holds == BESIDE and self._names['a'] else ''}|", words)

    def texts(self) -> list[str]:
        """Texts of the blocks, white space evened out; text that goes on behind an inline tag goes on here."""
        return [" ".join("".join(b).split()) for b in self._blocks]

    def named(self) -> tuple[int, int] | None:
        """Runs of the element that names the content: the only article, or else the only main."""
        for spans in self._spans.values():
            if len(spans) == 1:
                first, last = spans[0]
                return first, last if last >= 0 else len(self.runs)
        return None

    def places(self, marked: bool = True) -> list[int]:
        """Where each run stands; all in a plain page if ``marked`` is False or nothing names content."""
        if not marked or not any(self._spans.values()):
            return [PLAIN] * len(self.runs)
        return [INSIDE if inside else OUTSIDE for _, _, inside, _ in self.runs]

    def best(self, weights: dict[tuple[str, int], float]) -> list[str]:
        """Texts of the blocks that the best-scoring stretch touches."""
        total, start, best, stretch = 0.0, 0, 0.0, (0, 0)
        for i, ((block, name, _, count), place) in enumerate(zip(self.runs, self.places(), strict=True)):
            if block == -2:
                continue
            weight = weights.get((name, place))
            if weight is None:
                weight = TAG_PRIOR if block < 0 else WORD_PRIOR[place]
            total += weight * count
            if total <= 0:
                total, start = 0.0, i + 1
            elif total > best:
                best, stretch = total, (start, i + 1)
        texts = self.texts()
        touched = dict.fromkeys(r[0] for r in self.runs[slice(*stretch)] if r[0] >= 0)
        return [texts[b] for b in touched if texts[b]]


def observed(html: str | None, text: str | None) -> Iterator[tuple[str, int, bool, int]]:
    """(name, place, is content, count) of the words and tags of a labelled page; nothing of one without label."""
    page = Page(html)
    if text is not None:
        wanted = set(text.split("\n\n"))
        good = {k for k, t in enumerate(page.texts()) if t in wanted}
        content = [i for i, r in enumerate(page.runs) if r[0] in good]
        if not content:
            return
        first, last = content[0], content[-1] + 1
        known = [r[0] in good if r[0] >= 0 else first <= i < last and r[0] > -2 for i, r in enumerate(page.runs)]
        views = [page.places()]
    else:
        named = page.named()
        if named is None:
            return
        known = [named[0] <= i < named[1] and r[0] > -2 for i, r in enumerate(page.runs)]
        views = [page.places(), page.places(False)]
    for view, places in enumerate(views):
        for (_, name, _, count), place, content in zip(page.runs, places, known, strict=True):
            bare = name.lstrip("/").split(" ")[0].rstrip("|")
            if bare in KNOWN and not (view and bare in ("article", "main") and not name.endswith("|")):
                yield name, place, content, count


def train(pages: DataFrame, label: str | None = None, max_pages: int = 20_000) -> dict[tuple[str, int], float]:
    """Weights of words (names that end in ``|``) and tags by place, from at most about ``max_pages`` pages.

    ``label`` names a column with the text of labelled pages, blocks joined by two newlines; without it pages label
    themselves. The names are those of HTML, so the answer has a few hundred entries whatever the number of pages.
    """
    taken = columns_of(pages, "page_id", "url", "html", *([label] if label else []))
    total = taken.count()
    taken = taken.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(max(total, 1))) < max_pages).drop("page_id", "url")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            columns = [c.to_pylist() for c in batch.columns] + [[None] * batch.num_rows] * (label is None)
            for html, text in zip(*columns, strict=True):
                for name, place, content, n in observed(html, text):
                    counts[name, place, content] += n
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*counts, strict=True)] + [pa.array(counts.values())], ["name", "place", "content", "n"])

    seen = taken.mapInArrow(count, "name string, place long, content boolean, n long").groupBy("name", "place").agg(
        F.sum(F.when(F.col("content"), F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("content"), 0).otherwise(F.col("n"))).alias("no"))
    weights = {}
    for name, place, yes, no in seen.collect():
        low, high = WORD_BOUNDS if name.endswith("|") else TAG_BOUNDS
        weights[name, place] = min(high, max(low, math.log((yes + 0.5) / (no + 0.5))))
    return weights


def extract(pages: DataFrame, weights: dict[tuple[str, int], float]) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(Page(html).best(weights)) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = columns_of(pages, "page_id", "url", "html")
    kind = rows.schema["url"].dataType.simpleString()
    return rows.mapInArrow(each, f"page_id long, url {kind}, text string, n_chars long")
