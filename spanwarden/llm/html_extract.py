"""Main-text extraction from HTML: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

One pass of the standard library's streaming parser cuts a page into blocks (the "lines" of the ratio method) and keeps
a tree of their containers. Blocks inside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are marked by tag, role, class and id. The ratio of text to tags of every block is smoothed with a
Gaussian kernel, and blocks above one standard deviation form the content clusters. The clusters vote for the deepest container that holds
most of their text. Where that lies in an article or main element, or consists of articles, those are the article and all their
unmarked blocks are returned, short ones too. Elsewhere nothing but the ratios tells: what stands between the first and the last
cluster is the article, with the headings and unlinked lines right before it; blocks made of links go.

Null or empty html gives an empty text. Broken nesting is repaired as the events arrive; a marked section is skipped, an unclosed comment
ends with the page, a tag with an unclosed quote ends at its first ">". Very long pages are parsed whole, in memory of a few times their
length. Rows that repeat are extracted each on its own; other columns of the input are ignored whatever their names; an empty table gives an
empty result. Pages are independent, so nothing is shuffled and a lost task is simply run again.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.0
SKIP_TAGS = frozenset("script style noscript template title nav footer aside form button select option textarea label fieldset iframe svg canvas object menu dialog math audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CONTAINERS = frozenset("html body main article section div td blockquote table".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
SKIP_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|nav(?:bar|igation|links?|menu)|menus?|menu(?:bar|item|list)|topbar|toolbar|masthead|header|footer\w*|foot|sidebar\w*|side|aside|rail|widgets?|banner|ads?|ad(?:box|slot|unit|banner|sense)|adv|advert\w*|sponsor\w*|promo\w*|"
    r"cookie\w*|consent|gdpr|notices?|notifications?|alerts?|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|signup|login|share|sharing|share(?:bar|buttons?|links?)|social\w*|related\w*|recommend\w*|trending|popular|"
    r"comments?|comment(?:list|box|form|section|thread|area)|disqus|discussion|respond|reply|replies|breadcrumbs?|pagination|pager|hidden|form|search)\d*(?=$|[\s_-])",
    re.IGNORECASE,
)
#: A class such as "article-header" belongs to the article, and "has-sidebar" says nothing of the element itself.
OWN_NAMES = re.compile(r"(?:article|post|entry|story|page|content)[_-]?(?:header|title|heading)|(?:has|with|no|without)[_-]\w+(?:-\w+)*", re.IGNORECASE)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class _Page(HTMLParser):
    def __init__(self, by_name: bool = True):
        super().__init__(convert_charrefs=True)
        self.by_name = by_name
        self.stack: list[tuple[str, int, bool]] = []  # tag, container, whether it is skipped
        self.parents, self.kinds = [-1], ["root"]
        self.blocks: list[tuple[str, int, int, int, bool]] = []  # text, container, tags, characters in links, whether a heading
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0

    def _state(self) -> tuple[int, bool]:
        return self.stack[-1][1:] if self.stack else (0, False)

    def _flush(self) -> None:
        if self.text:
            said = " ".join("".join(self.text).split())
            if said:
                self.blocks.append((said, self._state()[0], self.tags, self.linked, any(t in HEADINGS for t, _, _ in self.stack[-3:])))
                self.tags = 0
            self.text, self.linked = [], 0

    def _pop(self, at: int) -> None:
        if any(t in BLOCK_TAGS for t, _, _ in self.stack[at:]):
            self._flush()
        self.links = max(0, self.links - sum(t == "a" for t, _, _ in self.stack[at:]))
        del self.stack[at:]

    def _close(self, tags: tuple[str, ...], until: frozenset[str]) -> None:
        """Implied end tags: close the nearest of ``tags`` unless one of ``until`` stands between."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                return self._pop(i)
            if self.stack[i][0] in until:
                return None
        return None

    def _skips(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in SKIP_TAGS:
            return True
        if tag == "header":
            return not any(t in ("article", "main") for t, _, _ in self.stack)
        if tag in ("html", "body", "main"):
            return False
        if (attrs.get("role") or "").strip().lower() in SKIP_ROLES or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return True
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or "", re.IGNORECASE):
            return True
        if not self.by_name or tag in HEADINGS:
            return False
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        return bool(names.strip()) and bool(SKIP_NAMES.search(OWN_NAMES.sub(" ", names)))

    def parse_marked_section(self, i, report=1):
        """The parser knows a few names of such sections and stops at others: all are skipped here."""
        ends = [at + len(mark) for mark in ("]]>", "]>", ">") if (at := self.rawdata.find(mark, i + 3)) >= 0]
        return ends[0] if ends else -1

    def finish(self) -> None:
        """What the parser still holds at the end of the page is text, or markup that never closed."""
        while self.rawdata.startswith("<") and not self.cdata_elem:
            held, self.rawdata = self.rawdata, ""
            tag, end = re.match(r"</?([a-zA-Z][^\s/>]*)", held), held.find(">")
            if held.startswith(("<!", "<?")) or (tag and end < 0):
                break
            if tag:
                (self.handle_endtag if held[1] == "/" else lambda name: self.handle_starttag(name, []))(tag[1].lower())
                self.feed(held[end + 1 :])
            else:
                self.handle_data("<")
                self.feed(held[1:])
        self.close()
        self._flush()

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK_TAGS:
            self._flush()
            self._close(("p", "h1", "h2", "h3", "h4", "h5", "h6") if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else ("p",), CONTAINERS | {"li", "aside", "nav", "form", "footer", "header"})
        if tag == "li":
            self._close(("li",), frozenset(("ul", "ol", "menu")))
        elif tag in ("dd", "dt"):
            self._close(("dd", "dt"), frozenset(("dl",)))
        elif tag in ("td", "th", "tr"):
            self._close(("td", "th") if tag != "tr" else ("tr",), frozenset(("table",) if tag == "tr" else ("table", "tr")))
            self.text.append(" ")
        elif tag in ("br", "hr", "img", "input"):
            self.text.append(" ")
        if tag in VOID_TAGS:
            return
        container, skipped = self._state()
        skipped = skipped or self._skips(tag, dict(attrs))
        if tag in CONTAINERS and not skipped:
            self.parents.append(container)
            self.kinds.append(tag)
            container = len(self.parents) - 1
        self.links += tag == "a"
        self.stack.append((tag, container, skipped))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID_TAGS:
            self.handle_starttag(tag, attrs)
        elif tag in BLOCK_TAGS:
            self._flush()

    def handle_endtag(self, tag):
        self.tags += 1
        stop = CONTAINERS | {"aside", "nav", "form", "footer", "header"} if tag not in BLOCK_TAGS and tag not in SKIP_TAGS else frozenset()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                return self._pop(i)
            if self.stack[i][0] in stop:
                break
        if tag in BLOCK_TAGS:
            self._flush()
        return None

    def handle_data(self, data):
        if not self._state()[1]:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; the kernel is cut and renormalised at the ends."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-((i / sigma) ** 2) / 2) for i in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi], strict=True)) / sum(weights))
    return out


def _parse(html: str, by_name: bool) -> _Page:
    page = _Page(by_name)
    page.feed(html)
    page.finish()
    return page


def _article(page: _Page, mass: list[float]) -> tuple[set[int], bool]:
    """The containers of the article, and whether the page names them: where the clusters' text is."""
    deepest = max((i for i in range(len(mass)) if mass[i] >= 0.7 * mass[0]), default=0)
    for kind in ("article", "main"):
        at, around = deepest, None
        while at >= 0:
            around = at if page.kinds[at] == kind else around
            at = page.parents[at]
        if around is not None:
            return {around}, True
        named = {i for i, k in enumerate(page.kinds) if k == kind and mass[i]}
        if named and sum(mass[i] for i in named) >= 0.7 * mass[0]:
            return named, True
    return {deepest}, False


def extract_text(html: str | None) -> str:
    page = _parse(html or "", True)
    if not page.blocks:  # names that hide the whole page are not to be trusted
        page = _parse(html or "", False)
    blocks = page.blocks
    if not blocks:
        return ""
    own = [len(text) / max(1, tags) for text, _, tags, _, _ in blocks]
    ratios = smooth(own)
    mean = sum(ratios) / len(ratios)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    least = min(deviation, mean)
    content = [r >= least for r in ratios]
    mass = [0.0] * len(page.parents)
    for (text, at, _, linked, _), high in zip(blocks, content, strict=True):
        while high and at >= 0:
            mass[at] += max(0, len(text) - linked)
            at = page.parents[at]
    best, named = _article(page, mass)
    inside = [False] * len(page.parents)
    for i, parent in enumerate(page.parents):  # parents come before their children
        inside[i] = i in best or (parent >= 0 and inside[parent])
    chosen = [i for i, block in enumerate(blocks) if inside[block[1]]]
    if not named:
        links = [linked > 0.6 * len(text) for text, _, _, linked, _ in blocks]
        high = [i for i in chosen if content[i] and own[i] >= least and not links[i]]  # smoothing lifts the cluster's neighbours, too
        first, last = (high[0], high[-1]) if high else (0, len(blocks))
        before = [i for i in chosen if i < first]
        while before and not links[before[-1]] and (blocks[before[-1]][4] or blocks[before[-1]][3] == 0):
            first = before.pop()
        chosen = [i for i in chosen if first <= i <= last and not links[i]]
    return "\n\n".join(blocks[i][0] for i in chosen)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    cols = pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url", f"`{html_col}` AS html")
    schema = cols.selectExpr("page_id", "url", "'' AS text", "0L AS n_chars").schema

    def run(batches):
        for batch in batches:
            texts = [extract_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return cols.mapInArrow(run, schema)
