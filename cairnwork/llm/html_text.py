"""Main text of HTML pages by tree scoring.

The page becomes a tree of elements. Each paragraph gives points for its length and commas to its ancestors, less the
higher they stand; a container's points are discounted by its share of linked text. The best container is kept, with
siblings that score near it or are paragraphs of prose, and its blocks are the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, text_slices

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROP = frozenset("script style textarea title xmp iframe noembed noframes noscript head nav footer aside form button select option input template svg canvas object dialog menu audio video map datalist".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: What a start tag ends: an open element of these kinds, looked for up to the nearest element of the second set.
CLOSES = {
    **{t: (frozenset({"p"}), frozenset("article aside blockquote body div section main td th table li dd button".split())) for t in BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dt", "dd"}},
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
# Words of class and id names, and of roles, that mark what isn't the article.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar|aside|widget\w*|related|recommend\w*|trending|popular|share|sharing|social|toolbar|pagination|pager|"
    r"header|masthead|footer|foot|copyright|legal|disclaimer|comments?|commentlist|comment-?list|respond|replies|reply|discussion|disqus|reactions|reviews?|tags|skip|hidden|print|search)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
LIKELY = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content\w*|entry|main|post\w*|story\w*|text|blog|page)(?:$|[\s_-])", re.I)
# Words of class and id names that mark a paragraph, heading or inline element as no part of the article.
UNLIKELY_PARAGRAPH = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|cookie\w*|consent|gdpr|hidden)(?:$|[\s_-])", re.I)
PARAGRAPH = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6".split())
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_BETWEEN = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_SPACE = re.compile(r"\s+")
#: Points of a paragraph: one, one for each comma, and one for each so many characters up to a limit.
CHARS_A_POINT, MOST_LENGTH_POINTS = 100, 3
# Kinds of elements that give their points to their parent and not to themselves.
PROSE = frozenset("p pre td blockquote li h1 h2".split())
#: What is left of a point at each step up the tree; ancestors get it in one pass, however many they are.
FADE = 0.5
#: Share of the best score that a sibling needs.
SIBLING = 0.2


class Node:
    __slots__ = ("tag", "names", "role", "hidden", "parent", "children", "chars", "linked", "commas", "score", "inside")

    def __init__(self, tag: str, parent: Node | None, names: str = "", role: str = "", hidden: bool = False) -> None:
        self.tag, self.parent, self.names, self.role, self.hidden = tag, parent, names, role, hidden
        self.children: list[Node | str] = []
        self.chars = self.linked = self.commas = 0
        self.score = 0.0
        #: Whether it stands inside an article.
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))

    @property
    def dropped(self) -> bool:
        if self.tag == "header":
            return not self.inside
        if self.tag in DROP or self.hidden or self.role in ROLES:
            return True
        if self.tag in ("html", "body", "article", "main") or not self.names:
            return False
        container = self.tag in BLOCK and self.tag not in PARAGRAPH
        return bool((UNLIKELY if container else UNLIKELY_PARAGRAPH).search(self.names))


class _Open:
    """The open elements from the root on, with the places of each kind, so that no question walks along them."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places, self.blocks = [root], {root.tag: [0]}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        """Closes the element at this place and all inside it."""
        while len(self.nodes) > place:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tags: frozenset[str]) -> int:
        """The innermost place of these kinds, -1 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def end(self, tag: str) -> None:
        """An end tag: closes the innermost of its kind; ends of inline elements don't reach across blocks."""
        places = self.places.get(tag)
        if places and places[-1] > 0 and (tag in BLOCK or self.blocks[-1] < places[-1]):
            self.close(places[-1])


class _Attributes:
    """Reads what stands between a tag's name and its end, as browsers do: a quote opens a value only after `=`."""

    def __init__(self, html: str) -> None:
        self.html, self.none_left = html, set()

    def read(self, at: int) -> tuple[list[tuple[str, str]], int]:
        """(names and values, place after the tag). A quote that is never closed ends at the tag's end instead."""
        html, out = self.html, []
        while True:
            at = _BETWEEN.match(html, at).end()
            if at >= len(html):
                return out, at
            if html[at] == ">":
                return out, at + 1
            m = _ATTRIBUTE.match(html, at)
            name, value, at = m[0].lower(), "", m.end()
            if m := _EQUALS.match(html, at):
                at = m.end()
                quote = html[at : at + 1]
                if quote in ("'", '"'):
                    end = -1 if quote in self.none_left else html.find(quote, at + 1)
                    if end < 0:
                        self.none_left.add(quote)
                        end = html.find(">", at + 1)
                        end = len(html) if end < 0 else end
                        value, at = html[at + 1 : end], end
                    else:
                        value, at = html[at + 1 : end], end + 1
                else:
                    m = _UNQUOTED.match(html, at)
                    value, at = m[0], m.end()
            out.append((name, value))


def _element(tag: str, parent: Node, attributes: list[tuple[str, str]]) -> Node:
    names = role = ""
    hidden = False
    for k, v in attributes:
        if k in ("class", "id"):
            names += " " + v
        elif k == "role":
            role = v.lower()
        elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and "display:none" in v.replace(" ", "").lower()):
            hidden = True
    return Node(tag, parent, names, role, hidden)


def parse(html: str) -> Node:
    """The element tree of a page; what browsers forgive is forgiven: missing ends, stray ends, a cut-off page.

    One pass: each character is read a bounded number of times, however deep or broken the page is.
    """
    root = Node("html", None)
    stack, attributes = _Open(root), _Attributes(html)
    text = at = 0  # where text not yet taken begins, and where to look for the next tag
    n, body = len(html), False
    while True:
        start = html.find("<", at)
        if start < 0 or start + 1 >= n:
            break
        plain = _PLAIN_TAG.match(html, start)
        name = None if plain else _NAME.match(html, start + 1 + (html[start + 1] == "/"))
        if not plain and not name and html[start + 1] not in "!?/":
            at = start + 1  # a sign in the text
            continue
        if start > text:
            stack.nodes[-1].children.append(unescape(html[text:start]))
        if plain:
            ends, tag, own, at = plain[1] == "/", plain[2].lower(), [], plain.end()
        elif name:
            ends, tag = html[start + 1] == "/", name[0].lower()
            own, at = attributes.read(name.end())
        else:
            comment = html.startswith("<!--", start)
            end = html.find("-->", start + 2) if comment else html.find(">", start + 1)
            text = at = n if end < 0 else end + (3 if comment else 1)
            continue
        text = at
        if ends:
            stack.end(tag)
            continue
        if tag in ("html", "body"):
            if tag == "html" or body:
                continue
            body = True
            stack.close(1)
        if tag in CLOSES:
            kinds, walls = CLOSES[tag]
            wall = stack.last(walls)
            while (place := stack.last(kinds)) > wall and place > 0:
                stack.close(place)
        node = _element(tag, stack.nodes[-1], own)
        node.parent.children.append(node)
        if tag in RAW:
            end = _raw_end(tag).search(html, at)
            text = at = n if end is None else end.end()
        elif tag not in VOID:
            stack.push(node)
    if text < n:
        stack.nodes[-1].children.append(unescape(html[text:]))
    return root


@cache
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)


def _clean(root: Node) -> list[Node]:
    """Takes dropped subtrees away; the remaining nodes, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not c.dropped]
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def best_container(nodes: list[Node]) -> Node:
    """The container with the most points; ties go to the one that comes first."""
    for node in reversed(nodes):  # children before parents
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(_SPACE.sub(" ", c).strip())
                node.commas += c.count(",")
            else:
                node.chars += c.chars
                node.commas += c.commas
                node.linked += c.chars if c.tag == "a" else c.linked
    for node in nodes:
        prose = node.tag in PROSE
        if node.chars and (prose or (node.tag in BLOCK and any(isinstance(c, str) and not c.isspace() for c in node.children))):
            points = (1 + node.commas + min(MOST_LENGTH_POINTS, node.chars / CHARS_A_POINT)) * (1 - node.linked / node.chars)
            up = node.parent if prose else node
            if up is not None:
                up.score += points
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.score += FADE * node.score
    best, most = nodes[0], -1.0
    for node in nodes:
        if not node.score or node.tag not in BLOCK and node.tag not in ("html", "body", "main", "article"):
            continue
        weight = 1 + 0.25 * bool(node.names and LIKELY.search(node.names)) + 0.5 * (node.tag in ("article", "main") or node.role in ("main", "article"))
        score = node.score * (1 - node.linked / max(1, node.chars)) * weight
        if score > most:
            best, most = node, score
    return best


def _flat(c: Node | str) -> str:
    if isinstance(c, str):
        return c
    out, todo = [], [c]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += reversed(x.children)
    return "".join(out)


def _with_siblings(best: Node) -> list[Node]:
    """The container and those of its siblings that belong to it."""
    if best.parent is None:
        return [best]
    out = []
    for c in best.parent.children:
        if c is best:
            out.append(c)
        elif isinstance(c, Node) and c.chars:
            links = c.linked / c.chars
            prose = c.tag in ("p", "pre", "blockquote") and (c.chars > 80 and links < 0.25 or links == 0 and _flat(c).rstrip().endswith((".", "!", "?")))
            heading = c.tag in ("h1", "h2", "h3") and links < 0.25
            if prose or heading or (c.score >= SIBLING * best.score and links < 0.25 and c.tag in BLOCK):
                out.append(c)
    return out


def blocks(kept: list[Node]) -> list[str]:
    """Texts of the blocks in page order, with white space as single spaces."""
    out: list[str] = []
    part: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", "".join(part)).strip()
        if text:
            out.append(text)
        part.clear()

    todo: list[Node | str | None] = list(reversed(kept))
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            part.append(x)
        elif x.tag == "br":
            part.append(" ")
        elif x.tag in BLOCK:
            close()
            todo.append(None)
            todo += reversed(x.children)
        else:
            todo += reversed(x.children)
    close()
    return out


def main_text(html: str | None) -> str:
    """The main text of a page; empty if there is none."""
    if not html:
        return ""
    nodes = _clean(parse(html))
    return "\n\n".join(blocks(_with_siblings(best_container(nodes))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page, in one pass without a shuffle: page_id, url, text, n_chars.

    Null and empty html give an empty text. Ids and urls pass through, nulls too; repeated rows are extracted each; other
    columns aren't read; an empty table gives an empty result. Pages are parsed whole, with an explicit stack, so
    neither long nor deeply nested pages fail.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            urls = batch.column(2)
            for ids, pages_ in text_slices(batch.select([0, 1])):
                texts = [main_text(h) for h in pages_]
                yield pa.RecordBatch.from_arrays([ids, urls.slice(done, len(texts)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                done += len(texts)

    rows = bounded_batches(pages).select(pages[id_col].alias("page_id"), pages[html_col].alias("html"), pages[url_col].alias("url"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long")
