"""HTML main-text extraction: flat text blocks, classified by a decision tree.

A page is cut into flat blocks of text at block-level tags. A block is described by its words and link density, by
those of its two neighbours, and by numbers for where it stands: in an article or main element, in an element that by
tag or role is page furniture, how far classes and ids around it name furniture or other people's text, and which share
of the page's words its article elements hold. A decision tree trained on the blocks of PAGES, a small labelled table,
judges every block; nothing is kept or dropped beside it. A name that is only part of a class weighs half, and elements
in which the page itself stands name nothing. Scripts, styles, the head, hidden elements and others without page text
never become blocks.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewell.llm import common

FEATURES = ("in_main", "by_tag", "foreign", "named", "main_share", "title", "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after")
#: labelled pages: of each block its path of elements (.class, #id, :role), words, link density, main text or not
PAGES = [
    [("nav ul li", 1, 1.0, 0), ("nav ul li", 2, 1.0, 0), ("nav ul li", 1, 1.0, 0), ("div.ad", 8, 0.0, 0), ("article h1", 7, 0.0, 1), ("article p", 60, 0.0, 1), ("article p", 1, 0.0, 1), ("article p", 120, 0.04, 1), ("article p", 3, 0.0, 1), ("article ul li", 4, 1.0, 1), ("article ul li", 6, 0.5, 1), ("article p", 30, 0.3, 1), ("footer", 9, 0.0, 0)],
    [("header h1", 2, 0.0, 0), ("header nav a", 5, 1.0, 0), ("div.cookie-notice p", 30, 0.1, 0), ("main h1", 5, 0.0, 1), ("main p", 80, 0.02, 1), ("main div.share", 4, 1.0, 0), ("main p", 45, 0.0, 1), ("main aside p", 25, 0.0, 0), ("main p", 2, 0.0, 1), ("main div.comments p", 40, 0.0, 0), ("main div.comments p", 3, 0.0, 0), ("main div.comments p", 90, 0.0, 0), ("div.sidebar p", 35, 0.1, 0), ("footer p", 20, 0.3, 0)],
    [("ul li", 1, 1.0, 0), ("ul li", 2, 1.0, 0), ("ul li", 1, 1.0, 0), ("div", 70, 0.0, 1), ("div", 40, 0.1, 1), ("div", 5, 0.0, 1), ("div", 55, 0.0, 1), ("div", 3, 1.0, 0), ("div", 2, 1.0, 0), ("div.footer", 12, 0.0, 0)],
    [("div#top", 3, 1.0, 0), ("div h1", 6, 0.0, 1), ("div p", 25, 0.0, 1), ("div p", 18, 0.05, 1), ("div p", 110, 0.15, 1), ("div p", 7, 0.0, 1), ("div p", 50, 0.0, 1), ("table tr td", 3, 1.0, 0), ("table tr td", 2, 1.0, 0), ("table tr td", 4, 0.8, 0), ("form p", 6, 0.0, 0), ("div.newsletter p", 22, 0.0, 0), ("div#comments p", 65, 0.0, 0)],
    [("div.has-sidebar nav li", 1, 1.0, 0), ("div.has-sidebar div.page-header p", 4, 0.0, 0), ("div.has-sidebar article h1", 8, 0.0, 1), ("div.has-sidebar article section.legal-analysis p", 70, 0.0, 1), ("div.has-sidebar article section.legal-analysis p", 6, 0.0, 1), ("div.has-sidebar article section.legal-analysis li", 3, 0.0, 1), ("div.has-sidebar article section#search p", 48, 0.02, 1), ("div.has-sidebar article section#search p", 30, 0.1, 1), ("div.has-sidebar article div.toc li", 3, 1.0, 0), ("div.has-sidebar article div.toc li", 2, 1.0, 0), ("div.has-sidebar article div.tags a", 4, 1.0, 0), ("div.has-sidebar article p", 85, 0.0, 1), ("div.has-sidebar div.sidebar li", 4, 1.0, 0), ("div.has-sidebar div.sidebar p", 30, 0.0, 0), ("footer p", 7, 0.2, 0)],
    [("form nav li", 2, 1.0, 0), ("form main h1", 6, 0.0, 1), ("form main p", 40, 0.0, 1), ("form main div.social-history p", 66, 0.0, 1), ("form main div.social-history p", 4, 0.0, 1), ("form main form p", 12, 0.0, 0), ("form main form label", 2, 0.0, 0), ("form main div.promo", 15, 0.2, 0), ("form main div.related li", 6, 1.0, 0), ("form main div.related h3", 2, 0.0, 0), ("form main p", 12, 0.0, 1), ("form div.copyright", 10, 0.0, 0)],
    [("div.menu li", 2, 1.0, 0), ("div.menu li", 3, 1.0, 0), ("div.banner p", 14, 0.0, 0), ("div h2", 4, 0.0, 1), ("div p", 95, 0.0, 1), ("div p", 33, 0.2, 1), ("div div.side-effects p", 44, 0.0, 1), ("div p", 61, 0.0, 1), ("div.related div article h2", 5, 1.0, 0), ("div.related div article p", 28, 0.0, 0), ("div.related div article p", 19, 0.0, 0), ("ul li", 2, 1.0, 0)],
    [("header p", 3, 1.0, 0), ("article header h1", 9, 0.0, 1), ("article header p", 4, 0.5, 0), ("article p", 140, 0.0, 1), ("article blockquote p", 22, 0.0, 1), ("article figure figcaption", 11, 0.0, 1), ("article div.ads", 7, 0.0, 0), ("article div.advertisement p", 60, 0.0, 0), ("article table tr td", 1, 0.0, 1), ("article table tr td", 2, 0.0, 1), ("article table tr td", 1, 1.0, 1), ("article div.notice p", 24, 0.0, 0), ("article footer p", 16, 0.1, 0), ("section.comment-list article p", 54, 0.0, 0), ("section.comment-list article p", 8, 0.0, 0), ("section.comment-list article p", 110, 0.0, 0)],
    [("div p", 2, 1.0, 0), ("div p", 12, 1.0, 0), ("article p", 5, 0.0, 1), ("article div.form-of-words p", 9, 0.0, 1), ("article div.ad-hoc p", 31, 0.0, 1), ("article div.ad-hoc p", 6, 0.0, 1), ("article div.header-file p", 20, 0.0, 1), ("article div.pagination", 5, 1.0, 0), ("article div.breadcrumbs", 4, 0.8, 0), ("article div.share p", 3, 0.0, 0), ("article div.sidebar p", 9, 0.0, 0), ("article div#legal p", 60, 0.0, 1), ("article div#legal p", 25, 0.0, 1), ("div p", 40, 0.0, 0), ("div p", 5, 0.0, 0), ("div p", 18, 0.3, 0)],
    [("div li", 3, 1.0, 0), ("div li", 2, 1.0, 0), ("div li", 20, 0.9, 0), ("div li", 4, 0.0, 0), ("div li", 35, 0.85, 0), ("div p", 3, 0.0, 0), ("div p", 2, 1.0, 0), ("div p", 6, 0.6, 0)],
    [("p", 30, 0.0, 1), ("p", 16, 0.0, 1), ("p", 9, 0.0, 1), ("p", 28, 0.0, 1)],
    [("div p", 9, 1.0, 0), ("header h1", 3, 0.0, 0), ("header p", 12, 0.0, 0), ("article header p", 3, 1.0, 0), ("article header h1", 4, 0.0, 1), ("article p", 26, 0.0, 1), ("article p", 3, 1.0, 1), ("article dialog p", 14, 0.0, 0), ("article footer p", 9, 0.0, 0), ("div p", 90, 0.0, 0), ("div p", 70, 0.0, 0), ("div p", 45, 0.0, 0), ("div p", 12, 0.0, 0), ("aside p", 60, 0.0, 0)],
    [("div.header p", 2, 1.0, 0), ("article header h1", 7, 0.0, 1), ("article header h1", 2, 0.0, 1), ("article header p", 6, 0.0, 0), ("article p", 10, 0.0, 1), ("article p", 17, 0.9, 1), ("article div.share li", 2, 1.0, 0), ("article div.menu li", 5, 1.0, 0), ("article div.toc li", 16, 1.0, 0), ("article div.tags li", 19, 1.0, 0), ("div.footer p", 30, 0.0, 0), ("div.sidebar p", 80, 0.0, 0)],
    [("nav li", 2, 1.0, 0), ("div p", 3, 0.0, 1), ("div p", 40, 0.0, 1), ("div p", 2, 0.0, 1), ("div p", 33, 0.1, 1), ("div p", 8, 0.0, 1), ("div.widget p", 22, 0.0, 0), ("div.popup p", 22, 0.0, 0), ("footer p", 5, 0.0, 0)],
]


@dataclass
class Node:
    feature: int = -1
    bar: float = 0.0
    low: Node | None = None
    high: Node | None = None
    keep: bool = False


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 2) -> Node:
    """A binary decision tree by Gini impurity; the first best split in feature order."""
    node = Node(keep=bool(y.mean() >= 0.5) if len(y) else False)
    if depth == 0 or len(set(y.tolist())) < 2:
        return node
    best = (1e-9, -1, 0.0)
    impure = lambda part: len(part) * 2 * part.mean() * (1 - part.mean())
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bar in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= bar
            if min(low.sum(), (~low).sum()) < least:
                continue
            gain = impure(y) - impure(y[low]) - impure(y[~low])
            if gain > best[0] + 1e-9:
                best = (gain, f, float(bar))
    if best[1] >= 0:
        low = x[:, best[1]] <= best[2]
        node.feature, node.bar = best[1], best[2]
        node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def is_main(node: Node, features: tuple[float, ...]) -> bool:
    while node.feature >= 0:
        node = node.low if features[node.feature] <= node.bar else node.high
    return node.keep


# elements whose content is no page text
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "title", "select", "textarea", "datalist"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template"}  # up to the end tag, whatever is inside
FURNISHING = {"nav", "header", "footer", "aside", "button", "dialog", "menu", "label", "input"}
WRAPPING = {"form", "fieldset"}  # furniture, unless the page stands in it
MAINLY = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "label"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: words in classes and ids: of other people's text (advertisers, operators, readers), of furniture, and those that say nothing
FOREIGN = re.compile(r"ads?|adverts?|advertisements?|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion)?s?|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|paywall|comments?|replies|reply|respond|disqus|discussion|reactions?", re.I)
NAMED = re.compile(r"sidebar|side|aside|rail|widgets?|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|header|masthead|topbar|footer|copyright|legal|share|sharing|social|related|recommended|trending|search|form|complementary|contentinfo|tags|toc|skip", re.I)
PLAIN = re.compile(r"lists?|box|block|section|wrap(?:per)?|container|inner|outer|items?|area|content|site|page|main|global|top|bottom|left|right|primary|secondary|group|bar|threads?|body|text|title|links?|posts?|entry|user|count|col|row|panel|zone|unit|slot|sticky|fixed|js|wp|\d+", re.I)
#: signs of text about a page, or of other pages: an article in it is not the page's
ASIDE = re.compile(r"comment|repl(?:y|ies)|respond|disqus|discussion|reaction|related|recommended|trending|\bads?\b|advert|sponsor|promo", re.I)
#: what a page has or lacks says nothing of the element itself
MODIFIER = re.compile(r"(?<!\S)(?:has|have|no|with|without)[_-]\S+", re.I)
HTML_BLOCKS = {"address", "article", "aside", "blockquote", "center", "dd", "div", "dl", "dt", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
BREAKOUT = {"svg": None, "math": None, "select": {"option", "optgroup", "div", "span", "hr"}}  # closed by a block but these
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^"'>]|"[^"]*"|'[^']*')*)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")


def weigh(names: str, signs: re.Pattern[str]) -> float:
    """How far class names or ids name what signs list: 1 wholly, 0.5 in part, 0 not at all."""
    most = 0.0
    for name in names.split():
        parts = [x for x in re.split(r"[-_]+", name) if x]
        if any(map(signs.fullmatch, parts)):
            most = max(most, 1.0 if all(signs.fullmatch(x) or PLAIN.fullmatch(x) for x in parts) else 0.5)
    return most


class Element:
    """An open block element, and what it says of the text inside. Names, and forms, say nothing where the page itself stands in them."""

    __slots__ = ("name", "parent", "by_tag", "soft", "mainly", "foreign", "named", "aside", "words", "main", "article", "title", "hidden", "around")

    def __init__(self, name: str, attrs: str, parent: Element | None):
        self.name, self.parent, self.words, self.around = name, parent, 0, (0.0,) * 4
        self.main, self.article, self.title = name == "main", name == "article", name == "h1"
        has: dict[str, str] = {}
        for key, value in ATTR.findall(attrs) if attrs and name not in ("html", "body") else ():
            has.setdefault(key.lower(), value.strip("\"'"))
        role = has.get("role", "").lower()
        self.hidden = "hidden" in has or has.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", has.get("style", ""), re.I))
        self.by_tag, self.soft = name in FURNISHING or role in ROLES, name in WRAPPING
        self.main, self.article = self.main or role == "main", self.article or role == "article"
        self.mainly = (self.main or self.article) and not self.by_tag
        names = MODIFIER.sub(" ", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{has.get('class', '')} {has.get('id', '')}")) if "class" in has or "id" in has else ""
        own = names and not self.mainly
        self.foreign, self.named = (weigh(names, FOREIGN), weigh(names, NAMED)) if own else (0.0, 0.0)
        self.aside = bool(own and ASIDE.search(names))

    def holds_page(self, words: int) -> bool:
        """Whether the page itself stands in it: its main element, or most words with its title or article."""
        return self.main or 2 * self.words > words and (self.title or self.article and not self.aside)


def _settle(elements: list[Element], loose: int) -> None:
    """Find what surrounds the text of each element, given in order of their start tags; loose: words outside all elements."""
    for e in reversed(elements):
        if e.parent is None:
            loose += 0 if e.by_tag else e.words
        elif not e.by_tag:
            e.parent.words += e.words
            e.parent.main, e.parent.article, e.parent.title = e.parent.main or e.main, e.parent.article or e.article, e.parent.title or e.title
    for e in elements:
        in_main, by_tag, foreign, named = e.parent.around if e.parent else (0.0,) * 4
        if not (e.mainly or e.holds_page(loose)):
            by_tag, foreign, named = max(by_tag, float(e.by_tag or e.soft)), max(foreign, e.foreign), max(named, e.named)
        elif e.by_tag:
            by_tag = 1.0
        if e.mainly and max(by_tag, foreign, named) < 1:
            in_main = 1.0
        e.around = in_main, by_tag, foreign, named


Block = tuple[str, int, float, Element | None]  # text, words, link density, innermost element


def describe(found: list[Block]) -> list[tuple[float, ...]]:
    """FEATURES of each block of a page."""
    whole = sum(b[1] for b in found) or 1
    around = [e.around if e else (0.0,) * 4 for *_, e in found]
    share = sum(b[1] for b, a in zip(found, around, strict=True) if a[0]) / whole
    sizes = [(0.0, 0.0), *[(float(n), density) for _, n, density, _ in found], (0.0, 0.0)]
    title = [float(e is not None and e.name == "h1") for *_, e in found]
    return [(*around[k], share, title[k], *sizes[k + 1], *sizes[k], *sizes[k + 2]) for k in range(len(found))]


def labelled(pages: list[list[tuple[str, int, float, int]]] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    rows: list[tuple[float, ...]] = []
    labels: list[int] = []
    for page in pages:
        known: dict[tuple[str, ...], Element] = {}
        elements: list[Element] = []
        found: list[Block] = []
        for path, n, density, keep in page:
            steps = path.split()
            parent = None
            for k, step in enumerate(steps):
                at = tuple(steps[: k + 1])
                if at not in known or k == len(steps) - 1:
                    name, marks = re.match(r"(\w+)(.*)", step).groups()
                    attrs = " ".join(f'{ {".": "class", "#": "id", ":": "role"}[m[0]] }="{m[1:]}"' for m in re.findall(r"[.#:][\w-]+", marks))
                    known[at] = Element(name, attrs, parent)
                    elements.append(known[at])
                parent = known[at]
            parent.words += n
            found.append(("", n, density, parent))
            labels.append(keep)
        _settle(elements, 0)
        rows += describe(found)
    return np.array(rows, float), np.array(labels, float)


def train(pages: list[list[tuple[str, int, float, int]]] = PAGES) -> Node:
    return grow(*labelled(pages))


def blocks(page: str) -> list[Block]:
    """Flat blocks in page order: text with white space collapsed, words, link density, element."""
    out: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[Element] = []  # open block elements
    elements: list[Element] = []
    silent: list[tuple[str, int]] = []  # open silent elements and how many block elements were open before each
    place: Element | None = None
    links, loose, at = 0, 0, 0

    def heard() -> None:
        while silent and silent[-1][1] > len(stack):
            silent.pop()  # a silent element ends with its parent

    def close() -> None:
        nonlocal loose
        if text:
            words = " ".join("".join(text).split())
            if words:
                letters, n = len("".join(words.split())), words.count(" ") + 1
                out.append((words, n, min(1.0, len("".join("".join(linked).split())) / letters), place))
                if place is None:
                    loose += n
                else:
                    place.words += n
            text.clear()
            linked.clear()

    def say(piece: str) -> None:
        if piece and not silent:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if links:
                linked.append(piece)

    while (m := TAG.search(page, at)) is not None:
        say(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        ending, attrs = m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if name == "br" or name == "hr":
            say(" ")
            continue
        if not ending and name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            if name not in ("noscript",):
                say(" " if name == "textarea" else "")
            continue
        if name == "a":
            links = 0 if ending else 1
            continue
        if name in SILENT and name != "head":
            if ending:
                for k in range(len(silent) - 1, -1, -1):
                    if silent[k][0] == name:
                        del silent[k:]
                        break
            elif not attrs.endswith("/"):
                silent.append((name, len(stack)))
            continue
        if name in ("foreignobject", "desc") and silent:
            silent[:] = silent[: max((k for k, x in enumerate(silent) if x[0] == name), default=len(silent))] if ending else [*silent, (name, len(stack))]
            continue
        if name in INLINE:
            continue
        close()
        if name == "body" and not ending:
            silent.clear()
        if name == "head":
            silent[:] = [] if ending else [("head", 0)]
            continue
        if name in VOID:
            continue
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    del stack[k:]
                    heard()
                    break
                if name not in MAINLY and stack[k].name in MAINLY:
                    break  # a stray end tag does not close the article
        else:
            if silent and silent[-1][0] in BREAKOUT and name in HTML_BLOCKS and name not in (BREAKOUT[silent[-1][0]] or ()):
                silent.pop()
            low = silent[-1][1] - (silent[-1][0] == "hidden") if silent else 0  # nothing in a silent element closes what stands around it
            if name == "p" or name not in ("span", "label"):
                while len(stack) > low and stack[-1].name == "p":
                    stack.pop()  # a block closes an open paragraph
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}.get(name, (name,))
                while len(stack) > low and stack[-1].name in same:
                    stack.pop()
            heard()
            if not attrs.endswith("/"):
                stack.append(Element(name, attrs, stack[-1] if stack else None))
                elements.append(stack[-1])
                if stack[-1].hidden:
                    silent.append(("hidden", len(stack)))  # until the element itself is closed
        place = stack[-1] if stack else None
        if not ending:
            links = 0
    say(page[at:])
    close()
    _settle(elements, loose)
    return out


def extract(page: str | None, tree: Node) -> str:
    """The main text of a page; empty if there is none. The tree judges every block."""
    found = blocks(page or "")
    return " ".join(b[0] for b, features in zip(found, describe(found), strict=True) if is_main(tree, features))


def main_text(pages: DataFrame, html_col: str = "html", out: str = "text", table: list[list[tuple[str, int, float, int]]] = PAGES) -> DataFrame:
    """pages with a string column `out`, the main text of each whole page; a column of that name is replaced.

    Null pages count as empty; an empty page, or one of furniture only, has an empty text. Rows are kept as they come,
    repeated ones too, and an empty table stays empty. A long page costs memory in proportion to its length.
    """
    tree = common.broadcast(pages.sparkSession, train(table))

    @F.arrow_udf(T.StringType())
    def extracted(found: pa.Array) -> pa.Array:
        out = pa.array([extract(page.as_py(), tree.value) for page in found], pa.string())
        common.tidy()
        return out

    return pages.withColumn(out, extracted(F.col(html_col)))
