"""Main-text extraction from HTML by tag-path ratios.

Every text node of a page belongs to a root-to-leaf tag path (tag names with their
classes).  Text length, punctuation and link text are aggregated per path; the ratio of
text to nodes and of punctuation to nodes are smoothed along the page and fused by product.  Paths through
elements that are named as what surrounds an article (navigation, adverts, comments ...) weigh less, hidden ones
nothing.  Paths whose fused ratio reaches the threshold are content.  The region is the deepest element that holds
nearly all of their text, with headings around it.  Of the region, content paths are emitted, and other paths (a
heading, a short cell) if nothing speaks against them: less weight than the region's, or mostly links.

Defined results: null, empty or text-less pages give an empty text; a page is parsed to its
end however long, deep or broken it is, in time that grows with its length; a quote that is never closed, or is not followed
by the end of an attribute, is a character like others; repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, small_batches

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^>])*)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that may hold a whole article.
CONTAINER = {"html", "body", "div", "section", "article", "main", "center", "form", "fieldset", "details", "table", "tbody", "tr", "td", "span", "font"}
#: Elements without text of the page: scripts, controls, embedded objects.
NEVER = set("head script style noscript template button select option textarea input iframe object svg canvas audio video title".split())
#: Weights of paths through elements that usually surround an article, and of elements named so in class, id or role.
SURROUND = {"nav": 0.02, "aside": 0.02, "footer": 0.02, "dialog": 0.02, "menu": 0.02, "form": 0.1, "header": 0.1}
NAMED = dict.fromkeys(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr menu menus nav navbar navigation breadcrumb breadcrumbs "
    "sidebar sidebars footer masthead topbar toolbar comment comments disqus replies respond share sharing related recommended recommendations subscribe subscription newsletter signup login "
    "popup modal overlay widget widgets pagination pager contentinfo complementary skip outbrain taboola".split(), 0.02
) | dict.fromkeys("notice notices alert reply discussion social search legal copyright disclaimer tags trending aside foot head header promoted".split(), 0.5)
#: Share of the content that the region holds at least.
HOLDS = 0.9
#: Start tags that end an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "option", "optgroup", "html", "head", "body", "dd", "dt", "legend", "summary"}
PUNCTUATION = re.compile(r"[.,;:!?。，！？、]")


class Element:
    """An open element: its path's number, weight, and place in the order of start tags."""

    __slots__ = ("tag", "path", "weight", "never", "inside", "parent", "link", "heading", "number")

    def __init__(self, tag, path, weight, never, inside, parent, link, heading, number):
        self.tag, self.path, self.weight, self.never, self.inside = tag, path, weight, never, inside
        self.parent, self.link, self.heading, self.number = parent, link, heading, number


def describe(attrs: str) -> tuple[set[str], bool]:
    """Words of class, id and role; whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id", "role"):
            words.update(w for w in re.split(r"[^a-z0-9]+", value) if w)
        elif name == "hidden":
            hidden |= value != "until-found"
        elif name == "aria-hidden":
            hidden |= value == "true"
        elif name == "style":
            hidden |= re.search(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", value) is not None
    return words, hidden


def weight_of(tag: str, words: set[str], inside: bool) -> float:
    """What an element makes of the weight of its paths; an article's own header weighs in full."""
    if tag in ("html", "body", "main", "article"):
        return 1.0
    own = 1.0 if tag == "header" and inside else SURROUND.get(tag, 1.0)
    if tag in HEADINGS or inside:
        words = words - {"head", "header"}
    return min([own, *(NAMED[w] for w in words if w in NAMED)])


def text_nodes(page: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """All elements in order of their start tags, and (element, decoded text, block number) of every text that isn't in
    a script, control or the like, in page order."""
    root = Element("#root", 0, 1.0, False, False, None, False, False, 0)
    stack, elements, nodes = [root], [root], []
    paths: dict[tuple[int, str], int] = {}
    open_: Counter[str] = Counter()
    block, at, n = 0, 0, len(page)

    def emit(s: str) -> None:
        if s and not stack[-1].never:
            nodes.append((stack[-1], html_lib.unescape(s) if "&" in s else s, block))

    def close(k: int) -> None:
        for e in stack[k:]:
            open_[e.tag] -= 1
        del stack[k:]

    def is_open(tags: set[str]) -> bool:
        return any(open_[t] > 0 for t in tags)

    search = TOKEN.search
    while at < n:
        m = search(page, at)
        if not m:
            emit(page[at:])
            break
        emit(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                emit(m[0][9:].removesuffix("]]>"))
            continue
        tag, attrs = tag.lower(), m[3]
        if tag in BLOCK:
            block += 1
        elif tag == "br":
            emit(" ")
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] > 0 else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("article", "main", "table", "body") and tag not in BLOCK:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if end is not None:
                at = end.end()
            elif tag != "textarea":
                at = n
            continue
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1) if open_["p"] > 0 else ():
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        elif tag in ENDS and is_open(ENDS[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ENDS[tag]:
                    close(k)
                    if tag != "tr" or stack[-1].tag != "tr":
                        break
                elif stack[k].tag in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        up = stack[-1]
        words, hidden = describe(attrs) if attrs and not attrs.isspace() else (set(), False)
        inside = up.inside or tag in ("article", "main")
        path = paths.setdefault((up.path, tag + "." + ".".join(sorted(words))), len(paths) + 1)
        weight = up.weight * weight_of(tag, words, inside)
        e = Element(tag, path, weight, up.never or hidden or tag in NEVER, inside, up, up.link or tag == "a", up.heading or tag in HEADINGS, len(elements))
        elements.append(e)
        stack.append(e)
        open_[tag] += 1
    return elements, nodes


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-2, 3) / sigma) ** 2)
    return np.convolve(np.pad(x, 2, mode="edge"), k / k.sum(), mode="valid") if len(x) else x


def content_paths(full: list[tuple[Element, str]]) -> tuple[set[int], set[int]]:
    """Paths of (element, text without outer white space) whose fused ratio reaches the threshold, and those of mostly links."""
    paths: dict[int, list[float]] = {}
    for e, s in full:
        x = paths.setdefault(e.path, [0.0, 0.0, 0.0, 0.0])
        x[0] += 1
        x[1] += len(s)
        x[2] += len(PUNCTUATION.findall(s))
        x[3] += len(s) * e.link
    text_ratio = smooth(np.array([paths[e.path][1] / paths[e.path][0] for e, _ in full]))
    mark_ratio = smooth(np.array([(1 + paths[e.path][2]) / paths[e.path][0] for e, _ in full]))
    fused = text_ratio * mark_ratio * np.array([(1 - paths[e.path][3] / paths[e.path][1]) * e.weight for e, _ in full])
    threshold = min(fused.std(), fused.mean())
    best: dict[int, float] = {}
    for (e, _), f in zip(full, fused.tolist(), strict=True):
        best[e.path] = max(f, best.get(e.path, 0.0))
    passed = {p for p, f in best.items() if f >= threshold and f > 0}
    return passed or set(best), {p for p, x in paths.items() if x[0] >= 3 and x[3] > 0.5 * x[1]}


def region_of(elements: list[Element], full: list[tuple[Element, str]], content: set[int]) -> Element:
    """The deepest element with ``HOLDS`` of the content's text, then its ancestors as long as these add only headings,
    content, and what weighs less."""
    mass, other = np.zeros(len(elements)), np.zeros(len(elements))
    for e, s in full:
        mass[e.number] += len(s) * (e.path in content)
        other[e.number] += len(s) * (e.path not in content and not e.heading)
    heaviest = [0] * len(elements)  # child with the most content
    whole = mass.copy()
    for e in reversed(elements[1:]):
        whole[e.parent.number] += whole[e.number]
        k = heaviest[e.parent.number]
        if k == 0 or whole[e.number] >= whole[k]:
            heaviest[e.parent.number] = e.number
    region = elements[0]
    while (k := heaviest[region.number]) and whole[k] >= HOLDS * whole[0] and elements[k].tag in CONTAINER:
        region = elements[k]
    # text besides content and headings that weighs as much as the region, by element and all below it
    for e, s in full:
        if e.weight < region.weight:
            other[e.number] = 0.0
    for e in reversed(elements[1:]):
        other[e.parent.number] += other[e.number]
    while region.parent is not None and region.parent.weight == region.weight and other[region.parent.number] == other[region.number]:
        region = region.parent
    return region


def extract(page: str | None) -> str:
    """The main text of one page."""
    elements, nodes = text_nodes(page or "")
    full = [(e, x) for e, s, _ in nodes if (x := " ".join(s.split()))]
    if not full:
        return ""
    content, linked = content_paths(full)
    region = region_of(elements, full, content)
    held = [False] * len(elements)
    for e in elements:
        held[e.number] = e is region or (e.parent is not None and held[e.parent.number])
    blocks: dict[int, list[str]] = {}
    for e, s, b in nodes:
        if held[e.number] and (e.path in content or (e.weight >= region.weight and e.path not in linked)):
            blocks.setdefault(b, []).append(s)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n\n".join(x for x in lines if x)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its code points for every row of ``pages``."""
    small_batches(pages.sparkSession)
    ddl = "page_id long, url string, text string, n_chars long"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, ddl)
