"""Main text of web pages by tree scoring.

A page becomes a tree without scripts, menus, forms and the like. Each paragraph passes points for its length and commas to the
element it is in, and each element passes on a share of its points to the one around it; points are discounted by the share of
text that is links, and by names that say comments, adverts or sidebars. The container with the most points is the article,
where tags and names that say so count double; siblings that score well or read like prose stay with it. Parts of the article
that are named as beside it are left out.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_HEAD = re.compile(r"<(/?)([a-zA-Z])")
_NAME_END = re.compile(r"[\s/>]")
_ATTRIBUTE = re.compile(r"(?i)(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: What an opening tag closes, up to the nearest of the second.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Never part of the main text.
_DROPPED = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "input", "dialog", "menu", "svg", "math", "object", "embed", "audio", "video", "canvas", "map", "fieldset", "label"} | _RAW
#: Words of class, id or role that name parts beside the article.
_BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|banner|breadcrumbs?|comments?|commentlist|respond|disqus|replies|cookies?|consent|gdpr|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notices?|alert|disclaimer|pager|pagination|popup|modal|overlay|promo|promotion|related|recommended|share|sharing|sidebar|side|rail|skip|social|sponsor|sponsored|subscribe|subscription|signup|login|search|tags|toolbar|widgets?|complementary|contentinfo|dialog)(?:$|[\s_-])"
)
#: Share of an element's points that the one around it gets, and what is left of them if its name says that it is beside the article.
PASSED, BESIDE = 0.75, 0.25
#: By how much points count more in containers of these tags, and of names that say article.
_WEIGHT = {"article": 2.0, "main": 1.8, "section": 1.1, "ol": 0.7, "ul": 0.7, "dl": 0.7, "li": 0.7, "table": 0.9, "tr": 0.7, "html": 0.0, "p": 0.5}
_NAMED = 1.5
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text)(?:$|[\s_-])")


class Node:
    __slots__ = ("tag", "parent", "parts", "mark", "dropped", "beside", "points", "chars", "link_chars", "paragraph")

    def __init__(self, tag: str, parent: Node | None, mark: str = ""):
        self.tag, self.parent, self.mark = tag, parent, mark
        self.parts: list[Node | str] = []
        self.dropped, self.beside, self.points, self.chars, self.link_chars, self.paragraph = False, False, 0.0, 0, 0, False


def _open(attributes: str) -> tuple[str, bool]:
    """What class, id and role say in lower case, and whether the element is hidden."""
    mark, hidden = "", False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            mark += " " + re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value)):
            hidden = True
    return mark, hidden


def _left(here: Node, up: Node, opened: dict[str, int]) -> Node:
    """The element around `up`, which ends here with all that is open in it."""
    while True:
        opened[here.tag] -= 1
        if here is up:
            return up.parent
        here = here.parent


class _Tokens:
    """Comments, declarations and tags of a page, found in time linear in its length.

    A tag that isn't closed is text. Pages without such tags are matched by one pattern. In others the search for a tag's end goes
    from one > or quote outside quotes to the next, and those from which no end was found are never passed again.
    """

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.marks: list[int] | None = None
        self.dead: set[int] = set()
        self.name_end = 0

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Begin, end, slash, name and attributes of the next token; comments and declarations have no name."""
        while (at := self.page.find("<", at)) >= 0:
            if found := self._token(at):
                return found
            at += 1
        return None

    def _token(self, at: int) -> tuple[int, int, str, str, str] | None:
        page = self.page
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return at, end + 3 if end >= 0 else len(page), "", "", ""
        if at > self.last[">"]:
            return None
        if page.startswith(("<!", "<?"), at):
            return at, page.find(">", at) + 1, "", "", ""
        if (head := _HEAD.match(page, at)) is None:
            return None
        if self.marks is None:
            if m := _TAG.match(page, at):
                return at, m.end(), m[1], m[2], m[3]
            self.marks = [m.start() for m in re.finditer("[>\"']", page)]
        if self.name_end < head.end():
            found = _NAME_END.search(page, head.end())
            self.name_end = found.start() if found else len(page)
        name_end = self.name_end
        if (end := self._end(name_end)) is None:
            return None
        return at, end + 1, head[1], page[head.start(2) : name_end], page[name_end:end]

    def _end(self, at: int) -> int | None:
        """Place of the > that closes a tag whose attributes begin here."""
        passed = []
        while (k := bisect_left(self.marks, at)) < len(self.marks) and (mark := self.marks[k]) not in self.dead:
            if (c := self.page[mark]) == ">":
                return mark
            passed.append(mark)
            if mark >= self.last[c]:
                break
            at = self.page.find(c, mark + 1) + 1
        self.dead.update(passed)
        return None


def parse(page: str) -> list[Node]:
    """The page's elements in page order, parents first; the first is the root."""
    root = Node("html", None)
    nodes, at, here, tokens = [root], 0, root, _Tokens(page)
    endless: set[str] = set()  # tags of which no end follows
    opened: dict[str, int] = {}  # at least as many of each tag are open, so that no end without a begin walks up the tree
    while True:
        token = tokens.after(at)
        if text := page[at : token[0] if token else len(page)]:
            here.parts.append(text)
        if not token:
            return nodes
        _, at, slash, name, attributes = token
        if not name:
            continue
        tag = name.lower()
        if slash:
            if not opened.get(tag):
                continue
            up: Node | None = here
            while up is not root and up.tag != tag and not (up.tag in ("td", "th", "table") and tag not in ("tr", "table", "tbody", "thead", "tfoot", "body", "html")):
                up = up.parent
            if up is not root and up.tag == tag:
                here = _left(here, up, opened)
            continue
        if tag in ("html",):
            continue
        if tag in _BLOCK and opened.get("p"):  # an open paragraph ends where a block begins
            up = here
            while up is not root and up.tag not in ("p", "button", "table", "td") and (up.tag not in _BLOCK):
                up = up.parent
            if up.tag == "p":
                here = _left(here, up, opened)
        if tag in _CLOSES and any(opened.get(t) for t in _CLOSES[tag][0]):
            ends, stops = _CLOSES[tag]
            up = here
            while up is not root and up.tag not in ends and up.tag not in stops:
                up = up.parent
            if up.tag in ends:
                here = _left(here, up, opened)
        mark, hidden = _open(attributes) if attributes.strip(" /") else ("", False)
        if tag == "body" and here.tag == "head":
            here = _left(here, here, opened)
        node = Node(tag, here, mark)
        node.dropped = hidden or tag in _DROPPED
        here.parts.append(node)
        nodes.append(node)
        if tag in _RAW:
            end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if not end and tag == "title":
                endless.add(tag)
                continue
            at = end.end() if end else len(page)
        elif tag not in _VOID and not attributes.rstrip().endswith("/"):
            here = node
            opened[tag] = opened.get(tag, 0) + 1


def _drop(nodes: list[Node]) -> None:
    """Drop what is inside dropped elements too; mark those whose names say beside the article, unless the article is in them."""
    for node in nodes:
        node.dropped |= node.parent is not None and node.parent.dropped
    holds = set()
    for node in reversed(nodes):
        named = node.mark and _BESIDE.search(node.mark)
        if named and node.tag not in ("html", "body", "main", "h1") and id(node) not in holds and not (node.tag == "article" and not re.search(r"comment|repl|related|promo|ad|sponsor", node.mark)):
            node.beside = True
        elif not node.dropped and (node.tag in ("main", "h1", "article") or id(node) in holds) and node.parent:
            holds.add(id(node.parent))


def paragraph_points(node: Node) -> float:
    """What a paragraph passes to the element it is in; under 20 characters a share of it."""
    if node.dropped or not node.paragraph or not node.chars:
        return 0.0
    commas = sum(p.count(",") + p.count("،") + p.count("、") for p in _strings(node))
    return (1 + commas + min(node.chars / 100, 3)) * (1 - node.link_chars / node.chars) * min(node.chars / 20, 1)


def _own(node: Node) -> bool:
    """Whether a paragraph is itself the container of its text."""
    return node.tag in ("div", "section", "article", "main", "body", "td")


def _measure(nodes: list[Node]) -> None:
    """Characters, link characters and points, children before parents; every element passes its points on once."""
    for node in reversed(nodes):
        if node.dropped:
            continue
        own = 0
        for part in node.parts:
            if isinstance(part, str):
                own += len(part.strip())
            elif not part.dropped:
                own += part.chars
                node.link_chars += part.link_chars
        node.chars = own
        if node.tag == "a":
            node.link_chars = own
        blocks = any(not isinstance(p, str) and not p.dropped and p.tag in _BLOCK for p in node.parts)
        node.paragraph = node.tag in ("p", "pre", "td", "blockquote", "li", "dd", "figcaption") or (node.tag in ("div", "section", "article", "main", "body") and (not blocks or any(isinstance(p, str) and len(p.strip()) > 40 for p in node.parts)))
        given = paragraph_points(node)
        if _own(node):
            node.points += given
            given = 0.0
        if node.beside:
            node.points *= BESIDE
            given *= BESIDE
        if node.parent is not None:
            node.parent.points += given + PASSED * node.points


def score(node: Node) -> float:
    """A container's points, less for links and more for tags and names that say article."""
    named = _NAMED if node.mark and not node.beside and _GOOD.search(node.mark) else 1.0
    return node.points * (1 - node.link_chars / max(node.chars, 1)) * _WEIGHT.get(node.tag, 1.0) * named


def _strings(node: Node) -> Iterator[str]:
    work = [node]
    while work:
        for part in (x := work.pop()).parts:
            if isinstance(part, str):
                yield part
            elif not part.dropped and part.tag not in _BLOCK:
                work.append(part)
        del x


def _blocks(node: Node, out: list[str]) -> None:
    """Texts of the blocks under a node, in page order, without recursion."""
    held: list[str] = []

    def flush() -> None:
        if words := html.unescape("".join(held)).split():
            out.append(" ".join(words))
        held.clear()

    work: list[tuple[Node, int]] = [(node, 0)]
    while work:
        here, k = work.pop()
        if k == 0 and here.tag in _BLOCK:
            flush()
        if k == len(here.parts):
            if here.tag in _BLOCK:
                flush()
            continue
        work.append((here, k + 1))
        part = here.parts[k]
        if isinstance(part, str):
            held.append(part)
        elif part.tag == "br":
            held.append(" ")
        elif not part.dropped and not part.beside:
            work.append((part, 0))
    flush()


def main_text(page: str) -> str:
    """The article's blocks, one a line; empty if the page has no text beside its boilerplate."""
    nodes = parse(page)
    _drop(nodes)
    _measure(nodes)
    alive = [n for n in nodes if not n.dropped]
    best = max((n for n in alive if n.points > 0 and n.tag != "html"), key=score, default=None)
    if best is None:
        best = next((n for t in ("article", "main", "body", "html") for n in alive if n.tag == t and n.chars), None)
        if best is None:
            return ""
    up: Node | None = best
    while up is not None:  # what the article is in stays, whatever it is called
        up.beside = False
        up = up.parent
    chosen = [best]
    if best.parent is not None and best.tag not in ("body", "article", "main"):
        least = max(5.0, best.points * 0.2)
        chosen = []
        for part in best.parent.parts:
            if isinstance(part, str) or part.dropped or part.beside:
                continue
            density = part.link_chars / max(part.chars, 1)
            prose = part.tag in ("p", "pre", "blockquote") and (part.chars > 80 and density < 0.25 or 0 < part.chars <= 80 and density == 0)
            if part is best or part.points * (1 - density) >= least or prose or (part.tag in ("h1", "h2", "h3", "h4") and density == 0):
                chosen.append(part)
    out: list[str] = []
    for node in chosen:
        _blocks(node, out)
    return "\n".join(out)


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page (page_id, url, html): page_id, url, text, n_chars.

    Whole pages are read; null or empty html, and pages of boilerplate only, give an empty text. White space inside a block is
    one space, blocks are joined by one newline. Rows are independent: repeated rows give repeated results, null ids and urls
    stay null, other columns are not read, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
