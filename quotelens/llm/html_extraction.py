"""Main text of web pages by tag-path ratios.

Every run of text lies on a path of tags from the root. For each path of a page the text's length and its punctuation
marks are summed and divided by the number of runs on the path: long, punctuated paths are prose, short ones are links and
labels. Both ratios are smoothed along the page, so that a heading or a list between paragraphs isn't taken for a label,
fused into one score (their geometric mean), and averaged over each path again. A run is content if the score of its path reaches a
part of the page's spread of scores. This holds in all of the page alike, also within an <article>.

What tags, roles and classes say is only a prior: it multiplies the score that a run must reach. Within an <article> or
<main> less is enough, for blocks of links alone more is needed, and much more in navigation, asides, footers, forms, and in elements
whose class or id says that they are something else, or outside of the element that holds most of the content. A class, a form or a dialog doesn't count
against an element without which the page would have no article, or that holds most of its content (`named_otherwise`).
Content runs are returned in page order, by block.
"""

from __future__ import annotations

import html as charrefs
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…、。،؛؟]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
#: Elements whose text no reader of the page sees as text.
NEVER = RAW | frozenset("head button select option datalist svg canvas audio video object applet".split())
#: Elements that by their tag are beside the article.
BESIDE = frozenset("nav aside footer form menu dialog".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary header footer nav aside form fieldset hr center".split())
CONTAINER = frozenset("html body main article section div table tbody tr td center".split())
#: An opening tag ends these open elements, up to the nearest of the second set.
CLOSES = {"li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})), "tr": (frozenset({"tr"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"}))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = frozenset({"p"})
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "summary"}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Tags and roles of these that may also be around a whole page.
FRAMES = frozenset("form dialog search alertdialog".split())
#: Words of a class or id, cut at characters other than letters, that say an element isn't part of the article.
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars rail footer masthead topbar "
    "comment comments reply replies respond discussion disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations widget pagination pager toolbar search form".split()
)
#: Of these, words of what readers write; it may be longer than the article.
READERS = frozenset("comment comments reply replies respond discussion disqus".split())


@dataclass(frozen=True)
class Ratios:
    """radius: runs of text to each side over which ratios are smoothed; part: of the spread of the scores that content must reach; most: of the content that the article holds.

    faint: punctuation that every run counts as having. article, link, beside: what multiplies the score to reach within an <article> or <main>, in blocks of links, and
    in elements that are said to be no part of the article, or lie outside of what holds most of the content.
    """

    radius: int = 2
    part: float = 0.25
    most: float = 0.7
    faint: float = 0.2
    article: float = 0.1
    link: float = 6.0
    beside: float = 100.0


@dataclass
class Element:
    """parent: its number; path: the number of its path of tags; said: words of its class and id that are of ASIDE; beside: its tag or role says so; frame: and it may also be around the article; in_article, in_link: it is such an element, or within one; a heading isn't in a link."""

    parent: int
    tag: str
    path: int
    said: frozenset[str] = frozenset()
    beside: bool = False
    frame: bool = False
    in_article: bool = False
    in_link: bool = False


def _said(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool, frozenset[str]]:
    """Whether an element is never text of the page, whether its tag or role puts it beside the article, or may also be around it, and the words of its class and id that say so.

    The page itself is never hidden: what hides it goes when it is shown.
    """
    said: set[str] = set()
    never, beside, frame, page = tag in NEVER, tag in BESIDE or (tag == "header" and not in_article), tag in FRAMES, tag in ("html", "body")
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            words = set(re.split(r"[^a-z]+", value))
            if tag not in ("html", "body", "article", "main"):
                said |= words & ASIDE | (words & {"header"} if not in_article else set())
        elif name == "role":
            # a role goes before what the tag says
            beside |= value in ROLES
            frame = value in FRAMES if value in ROLES else frame
        elif name == "style":
            never |= not page and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif name == "hidden" or value == "true":
            never |= not page
    return never, beside, frame, frozenset(said)


def runs_of(page: str) -> tuple[list[tuple[int, int, str]], list[Element]]:
    """Runs of text as (element, block, text), and the elements, parents first. Element 0 is the document."""
    elements = [Element(-1, "", 0)]
    paths: dict[tuple[int, str], int] = {}
    stack, opened, runs, block, skip, at = [0], Counter(), [], 0, 0, 0  # skip: depth of the outermost element without text

    def close(to: int) -> None:
        nonlocal block, skip
        while len(stack) > to:
            tag = elements[stack.pop()].tag
            opened[tag] -= 1
            if tag in BLOCK:
                block += 1
        if skip > len(stack) - 1:
            skip = 0

    def close_nearest(ends: frozenset[str], limits: frozenset[str]) -> None:
        """Close the nearest open element of ends that is within those of limits."""
        if not any(opened[t] for t in ends):
            return
        for depth in range(len(stack) - 1, 0, -1):
            name = elements[stack[depth]].tag
            if name in ends:
                close(depth)
                return
            if name in limits:
                return

    def text(upto: int) -> None:
        if upto > at and not skip and (found := charrefs.unescape(page[at:upto])):
            runs.append((stack[-1], block, found))

    position = 0
    while m := TOKEN.search(page, position):
        text(m.start())
        at = position = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if opened[tag]:
                close_nearest(frozenset((tag,)), frozenset())
            continue
        if tag in ENDS_P:
            close_nearest(PARAGRAPH, BLOCK)
        if tag in CLOSES:
            close_nearest(*CLOSES[tag])
        if tag in BLOCK:
            block += 1
        elif tag == "br" and not skip:
            runs.append((stack[-1], block, "\n"))
        if tag in VOID:
            continue
        around = elements[stack[-1]]
        never, beside, frame, said = (False, False, False, frozenset()) if skip else _said(tag, attributes, opened["article"] > 0)
        elements.append(Element(stack[-1], tag, paths.setdefault((around.path, tag), len(paths) + 1), said, beside, beside and frame, around.in_article or tag in ("article", "main"), (around.in_link or tag == "a") and tag not in HEADINGS))
        stack.append(len(elements) - 1)
        opened[tag] += 1
        if never:
            skip = len(stack) - 1
        if tag in RAW:
            ending = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, position)
            close(len(stack) - 1)
            at = position = ending.end() if ending else len(page)
    text(len(page))
    return runs, elements


def path_scores(lengths: np.ndarray, marks: np.ndarray, path: np.ndarray, ratios: Ratios) -> np.ndarray:
    """The fused ratio of each path. path: the number of each run's path."""
    count = np.bincount(path)
    near = np.exp(-((np.arange(-ratios.radius, ratios.radius + 1) / max(1, ratios.radius)) ** 2))
    along = lambda values: np.convolve(values, near, mode="full")[ratios.radius : ratios.radius + len(values)]
    weight = along(np.ones(len(path)))
    length, mark = (along((np.bincount(path, weights=values) / count)[path]) / weight for values in (lengths, marks))
    return np.bincount(path, weights=np.sqrt(length * (mark + ratios.faint))) / count


def _inside(elements: list[Element], roots: Iterable[int]) -> np.ndarray:
    """Whether each element is one of roots or lies in one."""
    inside = np.zeros(len(elements), dtype=bool)
    inside[list(roots)] = True
    for e in range(1, len(elements)):
        inside[e] |= inside[elements[e].parent]
    return inside


def _held(elements: list[Element], where: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    """What each element holds of the amounts of runs, itself and in all within it."""
    held = np.bincount(where, weights=amounts, minlength=len(elements))
    for e in range(len(elements) - 1, 0, -1):
        held[elements[e].parent] += held[e]
    return held


def named_otherwise(elements: list[Element], where: np.ndarray, content: np.ndarray, lengths: np.ndarray, ratios: Ratios) -> set[int]:
    """The elements whose class or id, or whose tag or role where it may be around the article, counts as saying that they are no part of it. where, content and lengths are of runs.

    If all that is an <article> (or else <main>) with text lies in such elements, those around the one that holds most don't count. Nor does one
    that holds most of the content of the article, or of the page without one; what readers write only if there is nothing else.
    """
    named = {e for e, x in enumerate(elements) if x.said or x.frame}
    if not named:
        return named
    out = _inside(elements, named)
    held = _held(elements, where, lengths * content)
    left = _held(elements, where, lengths * content * ~out[where])
    region = 0
    for tag in ("article", "main"):
        those = [e for e, x in enumerate(elements) if x.tag == tag and held[e] > 0]
        if those:
            region = at = max([e for e in those if not out[e]] or those, key=lambda e: (left[e], held[e]))
            while at >= 0:
                named.discard(at)
                at = elements[at].parent
            break
    within = _inside(elements, [region])
    return {e for e in named if not (within[e] and held[e] >= ratios.most * held[region] > 0 and not (elements[e].said and elements[e].said <= READERS and left[region] > 0))}


def container(elements: list[Element], held: np.ndarray, ratios: Ratios) -> int:
    """The innermost element, but none within an <article>, that holds most of what the page holds."""
    largest = [0] * len(elements)
    for e in range(len(elements) - 1, 0, -1):
        parent = elements[e].parent
        if elements[e].tag in CONTAINER and (not largest[parent] or held[e] >= held[largest[parent]]):
            largest[parent] = e
    at = 0
    while elements[at].tag != "article" and largest[at] and held[largest[at]] > 0 and held[largest[at]] >= ratios.most * held[0]:
        at = largest[at]
    return at


def content_of(runs: list[tuple[int, int, str]], elements: list[Element], ratios: Ratios) -> np.ndarray:
    """Whether each run is content by the score of its path; blank runs are what the run before them is."""
    blank = np.array([t.isspace() for _, _, t in runs], dtype=bool)
    if blank.all():
        return np.zeros(len(runs), dtype=bool)
    where, block, lengths, marks = (np.array(x) for x in zip(*((e, k, len(t.strip()), len(PUNCTUATION.findall(t))) for (e, k, t), b in zip(runs, blank.tolist(), strict=True) if not b), strict=True))
    path = np.unique([elements[e].path for e in where], return_inverse=True)[1]
    scores = path_scores(lengths.astype(float), marks.astype(float), path, ratios)[path]
    least = ratios.part * scores.std()
    linked = np.array([elements[e].in_link for e in where])
    linked &= ~np.isin(block, block[~linked])  # a link among other words is one of them
    prior = np.where(linked, ratios.link, np.where([elements[e].in_article for e in where], ratios.article, 1.0))
    beside = {e for e, x in enumerate(elements) if x.beside and not x.frame}
    plain = np.where(_inside(elements, beside)[where], ratios.beside, 1.0)
    named = named_otherwise(elements, where, scores >= least * prior * plain, lengths, ratios)
    prior = np.where(_inside(elements, beside | named)[where], ratios.beside, prior)
    content = np.zeros(len(runs), dtype=bool)
    content[~blank] = scores >= least * prior
    # the element that holds most of the content is the article: outside of it more is needed
    held = _held(elements, where, lengths * content[~blank])
    prior = np.where(_inside(elements, [container(elements, held, ratios)])[where], prior, ratios.beside)
    content[~blank] = scores >= least * prior
    last = np.maximum.accumulate(np.where(blank, -1, np.arange(len(runs))))
    return content[np.maximum(last, 0)] & (last >= 0)


def main_text(page: str | None, ratios: Ratios = Ratios()) -> str:
    runs, elements = runs_of(page or "")
    content = content_of(runs, elements, ratios)
    if not content.any():
        return ""
    parts: dict[int, list[str]] = {}
    for (_, block, t), good in zip(runs, content.tolist(), strict=True):
        if good:
            parts.setdefault(block, []).append(t)
    return "\n\n".join(found for block in sorted(parts) if (found := " ".join("".join(parts[block]).split())))


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", ratios: Ratios = Ratios()) -> DataFrame:
    """key, url, text and n_chars of every row of pages; other columns are not read.

    A null or empty page, and one without text, has the empty text. Keys and urls are passed on, null too.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                texts = [main_text(page, ratios) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    rows = pages.select(key, url, html)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(extract, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
