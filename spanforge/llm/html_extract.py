"""Main text of web pages by composite text density.

A page is parsed into a tree with the usual repairs (implied ends, void and raw-text elements, a cut-off end). Names are
a prior that comes first: elements that by tag, role, class or id are menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or comments do not count. A class or id names them as a whole only: ``sidebar`` and
``cookie-notice`` do, ``no-sidebar`` and ``page-header`` do not; nor does it where the element holds an ``article`` or
``main``, or, on a page with neither outside it, more than half of the text; a ``header`` within an ``article`` or
``main`` is the article's own and counts. Which of the rest is the main text is decided by density alone. For every node
it is its characters per tag, adjusted by its links:

    d = C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LC_body / C_body * C + e))

(C characters, T tags below, LC and LT those in links; zeros count as 1.) A node's sum is that of the densities of its
block-level children (blocks by kind or by holding one); text-level elements lend their characters and tags to the block
they stand in. The threshold is the least density on the path from the densest block up to the body. Of the blocks that
reach it, the one with the largest sum is selected, the outermost of equals. Within it, blocks of ``MENU_LINKS`` links or
more that are below the threshold and hold hardly any text beside their links are menus, and left out.

Text: character references decoded, white space in a block turned into one space, trimmed, blocks joined by one line
feed; block-level elements and ``br`` end a block. Edge cases: null and empty pages, and pages without text, give an
empty text; repeated rows are extracted each; nothing is cut, whatever the depth or length, and every step is linear in
the page, however its tags are nested or left open. Pages do not meet, so there is no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body br caption dd dt html legend li optgroup option summary tbody td tfoot th thead tr".split())
#: A start tag ends an open element of these kinds, looked for up to one of the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: What is not main text, by element, by role, and by the words of a class or id.
NOISE_TAGS = frozenset("head nav header footer aside form button select input textarea script style noscript iframe template svg dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup "
    "modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment "
    "comments disqus respond replies share sharing social related recommended widget toolbar pagination pager login signup search".split()
)
#: Links that make a block without other text a menu, and the part of its text that they are.
MENU_LINKS, MENU_SHARE = 5, 0.9
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""")
_MARK = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|$)[^>]*>?", re.I) for name in RAW}


def _is_noise(tag: str, marks: str) -> tuple[bool, bool]:
    """Whether an element is noise by itself, and whether a class or id names it so."""
    if tag in NOISE_TAGS:
        return True, False
    named = False
    if not marks or tag in ("html", "body"):
        return False, False
    for name, value in _MARK.findall(marks):
        name, value = name.lower(), value.strip("\"'").lower()
        if tag not in ("article", "main") and (name == "role" and value in NOISE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true"):
            return True, False
        if name in ("class", "id"):
            named |= any(NOISE_WORDS.issuperset(re.findall(r"[a-z0-9]+", one)) for one in value.split() if re.search(r"[a-z0-9]", one))
    return False, named


class _Page:
    """Nodes in page order; node 0 is the root. Only what is not noise has text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.last, self.noise, self.named = ["#"], [-1], [0], [False], [False]
        self.texts: list[tuple[int, int, str]] = []  # node, block, text
        self.block, self.open = 0, [0]
        self.places: dict[str, list[int]] = defaultdict(list, {"#": [0]})  # of each name, where it stands in ``open``
        at, end = 0, len(source)
        while at < end:
            mark = source.find("<", at)
            if mark < 0:
                self._text(source[at:])
                break
            if mark > at:
                self._text(source[at:mark])
            at = self._markup(source, mark)
        while self.open:
            self._close()
        self._drop_named()

    def _drop_named(self) -> None:
        """Elements that a class or id names as noise become noise, but for those that hold the main text."""
        n, parent = len(self.tag), self.parent
        if not any(self.named):
            return
        # An article or main that is itself named so (a reader's comment) speaks for none of its parents.
        core = [int(not self.noise[i] and not self.named[i] and self.tag[i] in ("article", "main")) for i in range(n)]
        chars = [0] * n
        for node, _, text in self.texts:
            chars[node] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            core[parent[i]] += core[i]
            chars[parent[i]] += chars[i]
        for i in range(1, n):
            if not self.noise[i]:
                named = self.named[i] and self.tag[i] not in ("article", "main") and not core[i] and (core[0] > 0 or 2 * chars[i] <= chars[0])
                self.noise[i] = self.noise[parent[i]] or named
        self.texts = [t for t in self.texts if not self.noise[t[0]]]

    def _text(self, text: str) -> None:
        node = self.open[-1]
        if not self.noise[node]:
            self.texts.append((node, self.block, html.unescape(text)))

    def _markup(self, source: str, at: int) -> int:
        """Handles what begins with the < at ``at``; returns where to go on."""
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            return end + 3 if end >= 0 else len(source)
        if source.startswith(("<!", "<?"), at):
            end = source.find(">", at)
            return end + 1 if end >= 0 else len(source)
        found = _TAG.match(source, at)
        if not found:
            if not source[at + 1 : at + 2].isalpha() and not (source[at + 1 : at + 2] == "/" and source[at + 2 : at + 3].isalpha()):
                self._text("<")
                return at + 1
            end = source.find(">", at)
            if end < 0:
                return len(source)  # a tag that the page's end cuts off
            name = re.match(r"</?([a-zA-Z][^\s/>]*)", source[at:end])[1]
            slash, marks, at = source[at + 1] == "/", "", end + 1
        else:
            slash, name, marks = found[1] == "/", found[2], found[3]
            at = found.end()
        name = name.lower()
        if slash:
            self._end(name)
            return at
        self._start(name, marks)
        if name in RAW and not marks.endswith("/"):
            end = _RAW_END[name].search(source, at)
            self._close()
            return end.end() if end else len(source)
        return at

    def _start(self, name: str, marks: str) -> None:
        if name in ENDS_P:
            self._end_open({"p"}, {"button", "table", "td", "th", "caption", "object", "article", "section", "main", "div", "body"})
        if name in ENDS:
            self._end_open(*ENDS[name])
        if name in BLOCK:
            self.block += 1
        if name in ("html", "body") and self.places[name]:
            return
        up = self.open[-1]
        self.tag.append(name)
        self.parent.append(up)
        self.last.append(0)
        noise, named = _is_noise(name, marks)
        if name == "header" and (self.places["article"] or self.places["main"]):
            noise = False
        self.noise.append(self.noise[up] or noise)
        self.named.append(named)
        self.places[name].append(len(self.open))
        self.open.append(len(self.tag) - 1)
        if name in VOID:
            self._close()

    def _last(self, names: set[str]) -> int:
        """Where the innermost open element of these names stands; -1 if none is open."""
        return max((own[-1] for own in map(self.places.get, names) if own), default=-1)

    def _end_open(self, kinds: set[str], up_to: set[str]) -> None:
        at = self._last(kinds)
        if at > self._last(up_to):
            while len(self.open) > at:
                self._close()

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self.block += 1
        if name in ("html", "body"):
            return
        if own := self.places.get(name):
            at = own[-1]
            while len(self.open) > at:
                self._close()

    def _close(self) -> None:
        node = self.open.pop()
        self.places[self.tag[node]].pop()
        self.last[node] = len(self.tag) - 1
        if self.tag[node] in BLOCK:
            self.block += 1

    def densities(self) -> tuple[int, list[float], list[float], list[bool], list[bool]]:
        """The body, and of each node its density, the sum of its block-level children's, and whether it is a block and
        whether it is made of links."""
        n, parent = len(self.tag), self.parent
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link, block = [False] * n, [t in BLOCK for t in self.tag]
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[parent[i]]
        for node, _, text in self.texts:
            size = len("".join(text.split()))
            chars[node] += size
            link_chars[node] += size if in_link[node] else 0
        for i in range(n - 1, 0, -1):
            if not self.noise[i]:
                up, link = parent[i], int(self.tag[i] == "a")
                chars[up] += chars[i]
                tags[up] += tags[i] + 1
                link_chars[up] += link_chars[i]
                link_tags[up] += link_tags[i] + link
                block[up] = block[up] or (block[i] and self.tag[i] != "br")
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        share = link_chars[body] / max(1, chars[body])
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if not self.noise[i] and chars[i]:
                c, t, lc, lt = chars[i], max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
                base = math.log(c / max(1, c - link_chars[i]) * link_chars[i] + share * c + math.e)
                ratio = math.log(max(1.0, c / lc * t / lt))
                density[i] = c / t * ratio / math.log(base) if base > 1.000001 and math.log(base) > 1e-6 else c / t * ratio
                if i and block[i]:
                    total[parent[i]] += density[i]
        links = [lt >= MENU_LINKS and lc >= MENU_SHARE * c for c, lc, lt in zip(chars, link_chars, link_tags)]
        block[body] = True
        return body, density, total, block, links

    def main(self) -> tuple[int, list[tuple[int, int]]]:
        """The selected node, and the menus in it: ranges of nodes."""
        body, density, total, block, links = self.densities()
        inside = [i for i in range(body, self.last[body] + 1) if block[i] and not self.noise[i]]
        densest = max(inside, key=lambda i: (density[i], -i))
        threshold, at = density[densest], densest
        while at > body:
            at = self.parent[at]
            threshold = min(threshold, density[at])
        best = max((i for i in inside if density[i] >= threshold), key=lambda i: (total[i], -i))
        if not total[best]:
            best = body  # no block holds another one: all of the page's text stands side by side
        menus, after = [], best
        for i in inside:
            if i > after and i <= self.last[best] and links[i] and density[i] < threshold:
                menus.append((i, self.last[i]))
                after = self.last[i]
        return best, menus

    def text(self) -> str:
        if not any(t.strip() for _, _, t in self.texts):
            return ""
        best, menus = self.main()
        blocks: dict[int, list[str]] = {}
        for node, block, text in self.texts:
            while menus and menus[0][1] < node:
                menus.pop(0)
            if best <= node <= self.last[best] and not (menus and menus[0][0] <= node):
                blocks.setdefault(block, []).append(text)
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(line for line in lines if line)


def main_text(source: str | None) -> str:
    return _Page(source).text() if source else ""


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    return chosen.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
