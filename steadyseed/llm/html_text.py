"""Main text of web pages by composite text density."""

from __future__ import annotations

from collections import Counter
from html import unescape
from math import e, log
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from steadyseed.llm.common import by_slices, col, text_of

# The elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
LEFT_OUT = frozenset(
    "head script style title textarea xmp iframe noembed noframes noscript template svg math canvas object audio video map "
    "button input select datalist nav header footer aside menu dialog".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table caption tbody tfoot thead tr ul".split()
)
#: A start tag of the key ends an open element of the value, up to the nearest list or table.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS |= dict.fromkeys(("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot", "tr", "td", "th"))
SCOPES = frozenset("html body ul ol dl table select".split())
KEPT = frozenset(("html", "body", "main", "article"))
#: Words of class, id or role that name what is no article.
NO_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|login|search|share|sharing|social|related|recommended|recommendations|widgets?|pagination|pager|toolbar|"
    r"complementary|contentinfo|hidden)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Names of what no article is, but may be longer than one.
OFTEN_LONG = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond)(?:$|[\s_-])", re.IGNORECASE)
#: Names that say what is beside an article, such as has-sidebar.
BESIDE = re.compile(r"(?:^|(?<=[\s_-]))(?:has|with|no|without)[_-][\w-]+", re.IGNORECASE)
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.IGNORECASE)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
INVISIBLE = re.compile(r"""(?:^|\s)hidden(?=$|[\s=/])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)""",
    re.DOTALL,
)


class Page:
    """The element tree of a page: per node its tag, attributes and parent; texts and block edges in page order."""

    def __init__(self, html: str):
        self.tags, self.attributes, self.parents = ["html"], [""], [-1]
        self.events: list[tuple[int, str | None]] = []  # (node, text), or (node, None) at the edge of a block
        self.open = [0]
        # how many elements of a name are open: in all, and inside each open list or table, the innermost last
        self.opened: Counter[str] = Counter()
        self.scoped: list[Counter[str]] = [Counter()]
        at = 0
        while found := MARKUP.search(html, at):
            if found.start() > at:
                self.text(html[at : found.start()])
            at = found.end()
            if found[2] is None:
                continue
            name = found[2].lower()
            if found[1]:
                self.end(name)
            else:
                self.start(name, found[3])
                if name in RAW:
                    close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE).search(html, at)
                    at = close.start() if close else len(html)
        if at < len(html):
            self.text(html[at:])

    def text(self, raw: str) -> None:
        self.events.append((self.open[-1], unescape(raw) if "&" in raw else raw))

    def start(self, name: str, attributes: str) -> None:
        if name in ("html", "body"):
            if name == "body" and self.opened["body"] or name == "html":
                return
            self.pop("head")
        if name in BLOCKS:
            self.pop("p", SCOPES)
            self.events.append((self.open[-1], None))
        for other in ENDS.get(name, ()):
            self.pop(other, SCOPES)
        if name == "br":
            self.events.append((self.open[-1], " "))
        if name in ("td", "th"):
            self.events.append((self.open[-1], " "))
        self.tags.append(name)
        self.attributes.append(attributes)
        self.parents.append(self.open[-1])
        if name not in VOID and not attributes.rstrip().endswith("/") or name in BLOCKS and name not in VOID:
            self.open.append(len(self.tags) - 1)
            self.opened[name] += 1
            self.scoped[-1][name] += 1
            if name in SCOPES:
                self.scoped.append(Counter())

    def end(self, name: str) -> None:
        if name in ("html", "body"):
            return
        if name in BLOCKS:
            self.events.append((self.open[-1], None))
        self.pop(name)
        if name in BLOCKS:
            self.events.append((self.open[-1], None))

    def pop(self, name: str, within: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of that name, and what is open in it; with ``within``, only inside the innermost of these.

        Where there is none nothing is looked at, so a page takes time in proportion to its tags.
        """
        if not (self.scoped[-1] if within else self.opened)[name]:
            return
        while True:
            tag = self.tags[self.open.pop()]
            if tag in SCOPES:
                self.scoped.pop()
            self.opened[tag] -= 1
            self.scoped[-1][tag] -= 1
            if tag == name:
                return


#: A name or a form leaves nothing out that holds more than this share of the page's text; names of what is often long, this.
MOST_TEXT, NEARLY_ALL = 0.5, 0.9


def text_sizes(page: Page, gone: list[bool]) -> list[int]:
    """Per node, the letters of its subtree that are not in ``gone`` nodes."""
    sizes = [0] * len(page.tags)
    for i, text in page.events:
        if text and not gone[i]:
            sizes[i] += len("".join(text.split()))
    for i in range(len(sizes) - 1, 0, -1):
        if not gone[i]:
            sizes[page.parents[i]] += sizes[i]
    return sizes


def left_out(page: Page) -> list[bool]:
    """Per node, whether it or what it is in belongs to no article by its tag, names or invisibility.

    Names and forms only tell where the article is not: unless the page has its
    article elsewhere, a node that holds most of the text is kept whatever it is
    called (nearly all, where the name is that of comments or the like, which may
    be longer than the article).
    """
    n = len(page.tags)
    holds = [False] * n  # an article or the page's main part
    inside = [False] * n
    for i in range(n - 1, 0, -1):
        if page.tags[i] in ("article", "main") or holds[i]:
            holds[page.parents[i]] = True
    gone, doubtful = [False] * n, [0.0] * n
    for i in range(1, n):
        up, tag, attributes = page.parents[i], page.tags[i], page.attributes[i]
        inside[i] = inside[up] or tag in ("article", "main")
        gone[i] = gone[up]
        if gone[i] or tag in KEPT or holds[i]:
            continue
        if tag in LEFT_OUT and not (tag == "header" and inside[up]):
            gone[i] = True
        elif tag == "form":
            doubtful[i] = MOST_TEXT
        if not gone[i] and attributes:
            names = BESIDE.sub("", " ".join(a or b or c for a, b, c in NAMES.findall(attributes)))
            gone[i] = bool(INVISIBLE.search(attributes))
            if OFTEN_LONG.search(names):
                doubtful[i] = NEARLY_ALL
            elif NO_ARTICLE.search(names) or not inside[up] and HEADER.search(names):
                doubtful[i] = MOST_TEXT
    sizes = text_sizes(page, gone)
    out, whole = [False] * n, [sizes[0]] * n  # the text of the page, or of the article around a node
    for i in range(1, n):
        up = page.parents[i]
        whole[i] = sizes[i] if page.tags[i] in ("article", "main") and not inside[up] else whole[up]
        known = holds[0] and not inside[i]  # the page says where its article is, and this is elsewhere
        out[i] = out[up] or gone[i] or doubtful[i] > 0 and (known or sizes[i] <= doubtful[i] * whole[i])
    return out


def density(chars: int, links: int, tags: int, link_tags: int, page_share: float) -> float:
    """Characters per tag, adjusted by how many of them are links, here and on the whole page."""
    if not chars:
        return 0.0
    base = log(chars / max(chars - links, 1) * links + page_share * chars + e)
    ratio = chars / max(links, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * max(log(ratio), 0.0) / max(log(base), 1e-9) if base > 1 else 0.0


def content(page: Page, out: list[bool]) -> list[bool]:
    """Per node, whether it is in a subtree of greatest density sum whose way to the body is dense enough."""
    n = len(page.tags)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[page.parents[i]] or page.tags[i] == "a"
    own = [0] * n
    for i, text in page.events:
        if text and not out[i]:
            size = len("".join(text.split()))
            own[i] += size
    for i in range(n - 1, -1, -1):
        if out[i]:
            continue
        chars[i] += own[i]
        links[i] += own[i] if in_link[i] else 0
        up = page.parents[i]
        if up >= 0:
            chars[up] += chars[i]
            links[up] += links[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (page.tags[i] == "a")
    if not chars[0]:
        return [False] * n
    share = links[0] / chars[0]
    dense = [density(chars[i], links[i], tags[i], link_tags[i], share) for i in range(n)]
    sums = [density(own[i], own[i] if in_link[i] else 0, 0, 0, share) for i in range(n)]
    for i in range(1, n):
        if not out[i]:
            sums[page.parents[i]] += dense[i]
    # the node of the greatest sum in each subtree, the outermost of equals
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        if not out[i] and sums[best[i]] >= sums[best[up]] and best[i] != up and (sums[best[i]], -best[i]) > (sums[best[up]], -best[up]):
            best[up] = best[i]
    threshold, i = dense[best[0]], best[0]
    while i >= 0:
        threshold = min(threshold, dense[i])
        i = page.parents[i]
    marked = [False] * n
    for i in range(n):
        up = page.parents[i]
        if up >= 0 and marked[up]:
            marked[i] = True
        elif not out[i] and chars[i] and dense[i] >= threshold:
            marked[best[i]] = True
    for i in range(1, n):
        marked[i] = (marked[i] or marked[page.parents[i]]) and not out[i]
    return marked


def extract(html: str | None) -> str:
    """The blocks of the page's main text, joined by two line feeds; empty if there is none."""
    if not html:
        return ""
    page = Page(html)
    inside = content(page, left_out(page))
    blocks, parts = [], []
    for node, text in page.events:
        if text is not None:
            if inside[node]:
                parts.append(text)
        elif parts:
            blocks.append(" ".join("".join(parts).split()))
            parts = []
    blocks.append(" ".join("".join(parts).split()))
    return "\n\n".join(b for b in blocks if b)


def main_text(html: Column) -> Column:
    def work():
        return lambda pages: pa.array([extract(h) for h in pages.to_pylist()], pa.string())

    return by_slices(html, "string", work)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: (page_id, url, text, n_chars).

    A null or empty page, and one without any text, has the text "". Broken markup is
    read as browsers do in the main: unclosed elements end with their parents,
    unknown end tags are passed over, what is cut off ends with the page. Pages are
    read one by one: repeated rows and null ids come back as they are, an empty
    table gives an empty result, other columns are not read. There is no shuffle.
    """
    read = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), main_text(text_of(html_col)).alias("text"))
    return read.withColumn("n_chars", F.char_length("text").cast("bigint"))
