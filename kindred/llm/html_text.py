"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser turns a page into lines, one per block of text, each with its number of
characters outside links and of tags since the line before. A region is the lines of one container (a container with a
single line belongs to the one around it). The ratios of characters to tags are smoothed over a region's lines, and a
threshold between the two clusters of smoothed ratios tells content lines. A region is main text if it has content
lines; then all its lines are, so short paragraphs and headings stay. Within the article, within main text, and
between two of its parts, a region is never too short: it goes only if it is links for the most part, and none that
lead to other sites or stand under a heading like References.

Names are a prior. A region whose element, role or class says that it isn't article text is left out, but where such
an element holds most of the page's characters and the article or first heading, or all that there is, its name is
overruled by its text. Words that can also name a chapter (related, social) have to be a whole class, or to be backed by links
or by a place outside the article. An `article` is taken as such only if it holds most of the unmarked characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed: elements whose content is never shown as text.
DROPPED = frozenset(
    "head title script style noscript template iframe object svg canvas button select option textarea label audio video map".split()
)
#: Fixed: elements that by themselves aren't article text; a form may be a wrapper of the whole page.
MARKED, FORM = frozenset("nav menu footer aside dialog".split()), "form"
#: Fixed: words of class, id or role that mark a container as such an element, also within a longer name.
MARKED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo cookie cookies consent gdpr notice notices "
    "popup modal overlay comment comments disqus newsletter subscribe adsense adbox".split()
)
#: Fixed: words of containers that frame a page. Outside an article such a mark, or such an element, lowers the ratio.
FRAME_WORDS = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer foot masthead topbar toolbar pagination pager".split())
FRAMES = frozenset("nav menu footer aside header".split())
#: Fixed: words that mark a container as a whole name, and within a longer one where links or its place say so too.
HINT_WORDS = frozenset(
    "promotion banner alert aside reply replies respond related recommended recommendations share sharing social subscription "
    "signup login complementary contentinfo copyright disclaimer skip".split()
)
#: Fixed: headings of lists of links that are part of an article.
SOURCES = frozenset("references reference sources source bibliography citations notes footnotes literature quellen literatur fuentes referencias bibliographie".split())
#: Fixed: whole class, id or role names that mark a paragraph, list item or inline element.
MARKED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored promo cookie cookies breadcrumb breadcrumbs comment comments "
    "reply replies newsletter subscribe pagination pager adsense adbox copyright disclaimer navigation contentinfo".split()
)
#: Fixed: a `header` in class, id or role is the page's, unless one of these stands beside it.
TITLED = frozenset("article post entry story content".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Fixed: elements that end a line before and after them.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
) | DROPPED
#: Fixed: elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed: elements of a page's head; any other ends it, as its end tag may be left out.
HEAD_PARTS = frozenset("head title base link meta script style noscript template".split())
#: Containers that make a region, and those of them that are parts of the text around them.
LISTS = frozenset("ul ol dl table".split())
CONTAINERS = frozenset("body div section td article main center fieldset form nav menu footer aside dialog header".split()) | LISTS
ARTICLES = frozenset(("article", "main"))
#: Containers whose mark the text may overrule.
WRAPPERS = frozenset("form div section td center table fieldset".split())
#: Standard deviation of the smoothing kernel, in lines.
SIGMA = 1.0
#: What the ratios of lines in a page's frame (see FRAMES) are multiplied by.
FRAME = 0.2
_TOKENS = re.compile(r"[A-Za-z]+")
#: A link to another site, as far as the page itself tells.
_AWAY = re.compile(r"\s*(?:https?:)?//", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Says that a page part exists, or not, beside the element: has-sidebar, no-comments.
_BESIDE = re.compile(r"\b(?:has|with|no|without)[-_]\w+", re.IGNORECASE)


class _Lines(HTMLParser):
    """Collects lines (node, characters outside links, characters, tags, text, heading tag, characters in links to other
    sites) and the tree of nodes, i.e. containers, as (parent, tag, marked (1), hinted (2) or frame (3), in an article)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[int, int, int, int, str, str, int]] = []
        self.nodes: list[tuple[int, str, int, bool]] = [(0, "page", 0, False)]
        self.open: list[tuple[str, bool, int]] = []  # tag, dropped, the node around it
        self.counts: Counter[str] = Counter()  # of open elements, by tag
        self.dropped, self.node = 0, 0
        self.text, self.tags, self.links, self.linked, self.away, self.sourced = [], 0, 0, 0, False, 0

    def end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                heading = next((h for h in HEADINGS if self.counts[h]), "")
                self.lines.append((self.node, max(0, len(text) - self.linked), len(text), self.tags, text, heading, self.sourced))
                self.tags = 0
            self.text, self.linked, self.sourced = [], 0, 0

    def pop(self, at: int) -> None:
        """Close the elements from position at on."""
        for tag, dropped, node in reversed(self.open[at:]):
            self.dropped -= dropped
            self.counts[tag] -= 1
            self.links -= tag == "a"
            self.node = node
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if self.counts["head"] and tag not in HEAD_PARTS:
            self.pop(next(i for i, x in enumerate(self.open) if x[0] == "head"))
        if tag in BLOCKS:
            self.end_line()
            for at in range(len(self.open) - 1, -1, -1):  # an open paragraph ends here
                if self.open[at][0] == "p":
                    if tag != "br":
                        self.pop(at)
                    break
                if self.open[at][0] in BLOCKS:
                    break
        elif tag == "a" and self.open and self.open[-1][0] == "a":
            self.pop(len(self.open) - 1)
        if tag in VOID:
            return
        article, nested = self.nodes[self.node][3], bool(attrs) and tag not in ("html", "body")
        marked = int(tag in MARKED or tag == FORM or (tag == "header" and not article))
        if marked and tag in FRAMES and not article:
            marked = 1 if nested and self.marked(tag, attrs, article) == 1 else 3
        if not marked and nested and (tag not in ARTICLES or (tag == "article" and article)):
            marked = self.marked(tag, attrs, article)
        dropped = tag in DROPPED or (marked and tag not in BLOCKS) or (nested and self.hidden(attrs))
        if tag not in BLOCKS and tag != "a" and not dropped:
            return  # plain inline markup changes nothing
        self.open.append((tag, dropped, self.node))
        self.counts[tag] += 1
        self.dropped += dropped
        self.links += tag == "a"
        if tag == "a":
            self.away = any(name == "href" and value and _AWAY.match(value) for name, value in attrs)
        if (tag in CONTAINERS or marked) and not self.dropped:
            self.nodes.append((self.node, tag, marked, article or tag in ARTICLES))
            self.node = len(self.nodes) - 1

    @staticmethod
    def marked(tag: str, attrs: list, article: bool) -> int:
        """1 if class, id or role say that the element isn't article text, 2 if they hint at it, 3 if it is the page's frame: by
        the words of a container's names, by a whole name of another element."""
        found = 0
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                whole = set(value.lower().split())
                if tag not in CONTAINERS:
                    if whole & MARKED_NAMES:
                        return 1
                    continue
                words = {w.lower() for w in _TOKENS.findall(_CAMEL.sub(" ", _BESIDE.sub("", value)))}
                if words & MARKED_WORDS or whole & HINT_WORDS or (article and words & FRAME_WORDS):
                    return 1
                if words & FRAME_WORDS or ("header" in words and not article and not words & TITLED):
                    found = 3
                elif words & HINT_WORDS:
                    found = found or 2
        return found

    @staticmethod
    def hidden(attrs: list) -> bool:
        return any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if tag in ("body", "html") or not self.counts[tag]:  # text after these two still belongs to the page
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self.pop(at)
                break
            if self.open[at][0] in CONTAINERS and tag not in CONTAINERS and tag not in DROPPED:
                break  # a stray end tag doesn't close a container

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.text.append(data)
            if self.links:
                self.linked += len(data)
                self.sourced += len(data) * self.away


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian average over neighbouring lines, weights renewed at the ends."""
    reach = np.arange(-int(3 * sigma), int(3 * sigma) + 1)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    n, half = len(ratios), len(reach) // 2
    return (np.convolve(ratios, kernel)[half : half + n]) / np.convolve(np.ones(n), kernel)[half : half + n]


def threshold(values: np.ndarray) -> float:
    """Where two clusters of values meet: midpoint of their means, iterated until it stays."""
    at = values.mean()
    for _ in range(50):
        low, high = values[values <= at], values[values > at]
        if not len(low) or not len(high):
            break
        new = (low.mean() + high.mean()) / 2
        if abs(new - at) < 1e-9:
            break
        at = new
    return float(at)


def _left_out(nodes: list, lines: list) -> tuple[list[bool], list[bool]]:
    """For each node whether it or one around it is marked, but for marks that the text overrules and hints that nothing
    backs; and whether it or one around it is the page's frame."""
    chars, shown, paragraphs, titled = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes), [False] * len(nodes)
    anchor = next((i for i, x in enumerate(nodes) if x[1] in ARTICLES and not x[2]), None)
    apart = anchor is not None  # there is an article, and what is hinted at outside of it is no part of it
    if anchor is None:
        anchor = next((x[0] for x in lines if x[5] == "h1"), -1)
    if anchor >= 0:
        titled[anchor] = True
    for x in lines:
        chars[x[0]] += x[1]
        shown[x[0]] += x[2]
        paragraphs[x[0]] += 1
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i][0]
        chars[up] += chars[i]
        shown[up] += shown[i]
        paragraphs[up] += paragraphs[i]
        titled[up] = titled[up] or titled[i]
    nodes = [x if x[2] != 2 else (x[0], x[1], int((apart and not x[3]) or 2 * chars[i] < shown[i]), x[3]) for i, x in enumerate(nodes)]
    free = {i for i, x in enumerate(nodes) if x[2] and x[1] in WRAPPERS and titled[i] and 2 * chars[i] >= chars[0]}

    def states(mark: int = 1) -> list[bool]:
        out = [False] * len(nodes)
        for i in range(1, len(nodes)):
            out[i] = out[nodes[i][0]] or (nodes[i][2] == mark and i not in free)
        return out

    out, frame = states(), states(3)
    while lines and all(out[x[0]] or frame[x[0]] for x in lines):  # nothing is left: the wrapper with the most text is the page
        outer = [i for i, x in enumerate(nodes) if x[2] and x[1] in WRAPPERS and i not in free and paragraphs[i] > 1]
        outer = [i for i in outer if not out[nodes[i][0]] and not frame[nodes[i][0]]]
        if not outer:
            break
        free.add(max(outer, key=chars.__getitem__))
        out, frame = states(), states(3)
    return out, frame


def _regions(nodes: list, lines: list, frame: list[bool]) -> list[int]:
    """For each line the node of its region: a container that is no list or frame and has one line belongs to the one around it."""
    alone = Counter()
    for x in lines:
        alone[x[0]] += 1
    children = Counter(nodes[i][0] for i in alone if i)
    of = {}
    for i in sorted(alone, reverse=True):
        single = alone[i] == 1 and not children[i] and nodes[i][1] not in LISTS and nodes[i][1] not in ARTICLES and not frame[i]
        of[i] = nodes[i][0] if single else i
    return [of[x[0]] for x in lines]


def selected(nodes: list, lines: list) -> list[bool]:
    """Which lines are main text."""
    out, frame = _left_out(nodes, lines)
    unmarked = [k for k, x in enumerate(lines) if not out[x[0]]]
    if all(frame[lines[k][0]] for k in unmarked):
        return [False] * len(lines)
    inside = [k for k in unmarked if nodes[lines[k][0]][3]]
    article = inside and 2 * sum(lines[k][1] for k in inside) >= sum(lines[k][1] for k in unmarked if not frame[lines[k][0]])
    rows = [lines[k] for k in unmarked]
    region = _regions(nodes, rows, frame)
    ratios, of = np.array([x[1] / (x[3] + 1) for x in rows]), np.array(region)
    for r in np.unique(of):  # lines of other containers aren't neighbours
        ratios[of == r] = smoothed(ratios[of == r]) * (FRAME if frame[r] else 1)
    strict = min(threshold(ratios), float(ratios.max()))
    best: dict[int, float] = {}
    size: Counter[int] = Counter()
    for r, v, x in zip(region, ratios.tolist(), rows, strict=True):
        best[r] = max(best.get(r, 0.0), v)
        size[r] += x[1] * (FRAME if frame[r] else 1)
    linked = _link_lists(lines, unmarked, region)
    largest, kept = max(size, key=size.get), set()
    for r in sorted(best):  # what is around a region comes before it
        up, within = nodes[r][0], bool(article and nodes[r][3])
        while not within and up:
            within, up = up in kept and nodes[up][1] != "body", nodes[up][0]
        if r not in linked if within and not frame[r] else best[r] >= strict or r == largest:
            kept.add(r)
    at = {r: [i for i, x in enumerate(region) if x == r] for r in best}
    for r in sorted(r for r in set(best) - kept - linked if not frame[r]):  # short text between two parts of the main text, side by side with it
        around = [i for q in kept if nodes[q][0] == nodes[r][0] or q == nodes[r][0] for i in at[q]]
        if around and min(around) < at[r][0] and at[r][-1] < max(around):
            kept.add(r)
    chosen = [False] * len(lines)
    ends = {r: (rows[i[0]][0], i[0], rows[i[-1]][0], i[-1]) for r, i in at.items()}
    for i, (k, r, v, x) in enumerate(zip(unmarked, region, ratios.tolist(), rows, strict=True)):
        head, begin, tail, end = ends[r]
        amid = begin < i < end and head != x[0] != tail
        # A container of links that has joined the text beside it, and isn't in the midst of it.
        border = r != x[0] and 2 * x[1] < x[2] and v < strict and not amid and not (article and nodes[x[0]][3])
        chosen[k] = r in kept and (not article or nodes[x[0]][3]) and not border
    region_of = dict(zip(unmarked, region, strict=True))
    for k in range(len(lines) - 2, -1, -1):  # headings belong to what follows
        if lines[k][5] and k in region_of:
            chosen[k] = chosen[k] or (chosen[k + 1] and not article)
            if chosen[k] and lines[k][5] != "h1":
                chosen[k] = _leads(nodes, lines, chosen, k, region_of[k])
    return chosen


def _link_lists(lines: list, unmarked: list[int], region: list[int]) -> set[int]:
    """Regions of several lines that are links for the most part, unless those lead to other sites or a heading of sources
    stands before them."""
    whole: dict[int, list[int]] = {}
    first: dict[int, int] = {}
    for k, r in zip(unmarked, region, strict=True):
        sums = whole.setdefault(r, [0, 0, 0, 0])
        first.setdefault(r, k)
        for i, n in enumerate((1, lines[k][1], lines[k][2], lines[k][6])):
            sums[i] += n
    out = set()
    for r, (n, free, chars, sourced) in whole.items():
        before = lines[first[r] - 1] if first[r] else None
        named = before is not None and before[5] and not SOURCES.isdisjoint(before[4].lower().split())
        if n > 1 and 2 * free < chars and 2 * sourced < chars and not named:
            out.add(r)
    return out


def _leads(nodes: list, lines: list, chosen: list[bool], k: int, region: int) -> bool:
    """Whether heading k leads to chosen text, or to none at all, before the next heading or the end of its region."""
    some = False
    for j in range(k + 1, len(lines)):
        node = lines[j][0]
        while node and node != region:
            node = nodes[node][0]
        if node != region or lines[j][5]:
            break
        if chosen[j]:
            return True
        some = True
    return not some


def main_text(html: str | None) -> str:
    """Main text of a page, empty for null, empty or textless pages."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return " ".join(x[4] for x, c in zip(parser.lines, selected(parser.nodes, parser.lines), strict=True) if c)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html).

    Text of null or empty html is empty. Character references are decoded; white space inside a line becomes one
    blank, lines are joined by one blank in page order. Markup that is cut off or never closed is read as far as it
    goes; a very long page is read whole. Repeated rows and null ids stay as they are; an empty table gives no rows.
    Other columns are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
