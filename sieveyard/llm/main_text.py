"""Main text of web pages by composite text density.

Each node of the page's tree gets its characters per tag, adjusted for the share of link text; a node's density sum adds
its children's densities.  The node of the greatest sum is the article's body; its path to ``body``
gives the threshold that tells content beside it from the rest.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|[^<]++|<", re.S)
#: The same where quotes no longer pair up: a tag then ends at the next ">".
UNPAIRED = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|[^<]++|<", re.S)
OPENS = re.compile(r"<(?:/?[a-zA-Z]|([!?]))")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDING = re.compile(r"hidden|display", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
BOILERPLATE = frozenset("head nav footer aside form button select option dialog menu svg canvas object audio video map datalist fieldset label".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A tag that opens closes these, if open within the given bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Words in class, id or role that name what is no article text, where density or links say so too.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar side rail widget footer masthead comment comments disqus respond reply replies"
    " related recommended share sharing social newsletter subscribe subscription signup login search toolbar skip copyright complementary contentinfo header".split()
)
#: Words beside them that say nothing of a topic: "ad-slot" is evidence at any length, "share-prices" only with many links.
SHAPES = frozenset("area bar block bottom box button buttons container content form global icons inner item items left link links list main outer page post posts right section site slot text top unit wrap wrapper".split())
REGIONS = frozenset(["article", "main"])
#: Plain characters from which a block with a noise name may count as dense.
DENSE = 80
HEADING = re.compile("h[1-6]")


class Node:
    __slots__ = ("chars", "children", "density", "link_chars", "link_tags", "parent", "skip", "suspect", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, skip: bool, suspect: int = 0):
        self.tag, self.parent, self.skip, self.suspect = tag, parent, skip, suspect
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def hidden(attributes: str) -> bool:
    if not HIDING.search(attributes):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def noisy(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is boilerplate by its tag or hidden.  A header inside an article holds its title."""
    return tag in BOILERPLATE or tag in RAW or (tag == "header" and not inside) or bool(attributes) and hidden(attributes)


def suspicion(tag: str, attributes: str, inside: bool) -> int:
    """2 where a class, id or role names boilerplate and no topic, 1 where it does beside other words, else 0.  Never on headings."""
    if not attributes or tag in ("body", "html", "article", "main") or HEADING.fullmatch(tag):
        return 0
    worst = 0
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            for name in (m[2] or m[3] or m[4] or "").split():
                words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
                if any(w in NOISE and not (w == "header" and inside) for w in words):
                    worst = max(worst, 2 if all(w in NOISE or w in SHAPES for w in words) else 1)
    return worst


def tree(html: str) -> Node:
    """The page's elements without boilerplate.  Unclosed and misplaced tags are put right as browsers do in the main."""
    root = at = Node("html", None, False)
    depth: dict[str, int] = {}
    inside = skipping = 0  # open articles; open boilerplate
    raw = ""

    def close(to: Node) -> Node:
        nonlocal at, inside, skipping
        while True:
            depth[at.tag] -= 1
            inside -= at.tag in REGIONS
            skipping -= at.skip
            here, at = at, at.parent
            if here is to:
                return at

    def within(tags, bounds) -> Node | None:
        if not any(depth.get(t) for t in tags):
            return None
        x = at
        while x.parent is not None and x.tag not in bounds:
            if x.tag in tags:
                return x
            x = x.parent
        return None

    position, size, token = 0, len(html), TOKEN
    last = html.rfind(">")
    while position < size:
        if raw:
            m = re.compile(rf"</{raw}(?=[\s/>])", re.I).search(html, position)
            position = m.start() if m else size
            raw = ""
            continue
        opens = html[position] == "<" and OPENS.match(html, position)
        if opens and position > last:  # the page ends within a tag or a comment
            break
        m = token.match(html, position)
        tag = m[2]
        if opens and not opens[1] and tag is None and token is TOKEN:
            token = UNPAIRED
            continue
        position = m.end()
        if tag is None:
            text = m[0]
            if not skipping and (text[0] != "<" or text == "<"):
                at.children.append(text)
            continue
        tag = tag.lower()
        if m[1]:
            if depth.get(tag):
                x = at
                while x.tag != tag:
                    x = x.parent
                close(x)
            elif tag == "p" and not skipping:
                at.children.append(Node("p", at, False))
            continue
        if tag in ("html", "body") and (tag == "html" or depth.get("body")):
            continue
        if tag in BLOCK and depth.get("p") and (x := within({"p"}, {"table", "td", "th", "button", "object"})):
            close(x)
        if tag == "body" and depth.get("head"):
            x = at
            while x.tag != "head":
                x = x.parent
            close(x)
        if tag in CLOSES:
            while x := within(*CLOSES[tag]):
                close(x)
        node = Node(tag, at, noisy(tag, m[3], inside > 0), suspicion(tag, m[3], inside > 0))
        if not skipping and not node.skip:
            at.children.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        depth[tag] = depth.get(tag, 0) + 1
        inside += tag in REGIONS
        skipping += node.skip
        at = node
        if tag in RAW:
            raw = tag
    return root


def measure(root: Node) -> list[Node]:
    """All nodes, parents first, with characters, tags and link shares of their subtrees."""
    order, links = [root], [root.tag == "a"]
    for x, linked in zip(order, links):  # both grow meanwhile
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        x.density = 0.0
        for c in x.children:
            if isinstance(c, str):
                n = len(c) - c.count(" ") if c.isspace() else len(c)
                x.chars += n
                x.link_chars += n * linked
            else:
                order.append(c)
                links.append(linked or c.tag == "a")
    for x in reversed(order):
        if x.parent is not None and x is not root:
            p = x.parent
            p.chars += x.chars
            p.link_chars += x.link_chars
            p.tags += x.tags + 1
            p.link_tags += x.link_tags + (x.tag == "a")
    body = next((x for x in order if x.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for x in order:
        if x.chars:
            plain = max(1, x.chars - x.link_chars)
            base = math.log(x.chars / plain * x.link_chars + share * x.chars + math.e)
            ratio = x.chars / max(1, x.link_chars) * max(1, x.tags) / max(1, x.link_tags)
            x.density = x.chars / max(1, x.tags) * (math.log(max(ratio, 1.0)) / math.log(base) if base > 1.0001 else math.log(max(ratio, 1.0)) / math.log(1.0001 + base - 1))
    return order


def drop_suspects(order: list[Node]) -> bool:
    """Takes elements with noise names out where links or thin text bear the name out.  Thin is less than ``DENSE`` or half the page's text for each tag."""
    root = order[0]
    plain = max(1, root.chars - root.link_chars)
    gone = set()
    for x in order:
        if x.suspect:
            own = x.chars - x.link_chars
            linked = 2 * x.link_chars > x.chars
            thin = own < DENSE or 2 * own <= plain and 2 * own * (root.tags + 1) < plain * (x.tags + 1)
            if linked or thin and x.suspect == 2 and own < plain:
                gone.add(id(x))
    for x in order:
        if any(id(c) in gone for c in x.children):
            x.children = [c for c in x.children if id(c) not in gone]
    return bool(gone)


def ancestors(x: Node):
    while x.parent is not None:
        x = x.parent
        yield x


def content(root: Node) -> list[Node]:
    """The subtrees to keep, in page order: the body, other articles that are not mostly links, and what is as dense around them."""
    order = measure(root)
    if any(x.suspect for x in order) and drop_suspects(order):
        order = measure(root)
    sums = {id(x): sum(c.density for c in x.children if not isinstance(c, str)) for x in order}
    best = max(order, key=lambda x: sums[id(x)])
    if not sums[id(best)]:
        best = max(order, key=lambda x: x.density)
    path, x = [], best
    while x is not None and x.tag != "html":
        path.append(x)
        x = x.parent
    threshold = min((x.density for x in path), default=best.density)
    # the body: the outermost article on the path, else the nearest main, else the node itself
    body = next((x for x in reversed(path) if x.tag == "article"), None) or next((x for x in path if x.tag == "main"), None)
    if body is None:
        body = best
        while body.parent is not None and body.tag in ("p", "li", "ul", "ol", "td", "tr", "tbody", "table", "blockquote"):
            body = body.parent
        if body.parent is None or body.tag == "body":
            plain = sum(x.chars - x.link_chars for x in order if x.tag in REGIONS and not any(y.tag in REGIONS for y in ancestors(x)))
            if 2 * plain <= body.chars - body.link_chars:
                return [body]
    kept: list[Node] = []
    above = {id(x) for x in path}
    above.add(id(root))
    in_articles = body.parent is None or body.tag == "body"  # most of the page is in articles, of which none is the body
    loose = not in_articles and body.tag not in REGIONS  # no tag names the body: what lies around it counts more
    limit = threshold
    if loose and (dense := sorted(c.density for c in best.children if not isinstance(c, str) and c.density)):
        limit = min(threshold, dense[len(dense) // 2] / 2)  # a single block's density is below that of many by its logarithm
    stack: list[Node] = [root]
    while stack:
        x = stack.pop()
        if (x is body and not in_articles) or (x.tag in REGIONS and id(x) not in above and x.chars > 2 * x.link_chars):
            kept.append(x)
        elif id(x) in above:
            stack.extend(reversed(flow(x, above) if loose else [c for c in x.children if not isinstance(c, str)]))
        elif x.tag == "":
            kept.append(x)
        elif x.suspect == 2:  # dense, but outside the body
            continue
        elif x.chars > 3 * x.link_chars and (x.density >= limit or HEADING.fullmatch(x.tag) and (x.parent is body.parent or loose and (x.tag == "h1" or id(x.parent) in above))):
            kept.append(x)
        else:
            stack.extend(reversed([c for c in x.children if not isinstance(c, str)]))
    return kept


def flow(x: Node, above: set[int]) -> list[Node]:
    """The children of ``x``, with each stretch of text and inline elements that is not mostly links as one node without a tag."""
    out: list[Node] = []
    run: list[Node | str] = []

    def end() -> None:
        linked = sum(c.link_chars for c in run if not isinstance(c, str))
        if run and sum(len(c.strip()) if isinstance(c, str) else c.chars for c in run) > 2 * linked:
            node = Node("", x, False)
            node.children = [*run]
            out.append(node)
        run.clear()

    for c in x.children:
        if isinstance(c, str) or c.tag not in BLOCK and id(c) not in above and not c.suspect and not any(y.tag in BLOCK for y in descendants(c)):
            run.append(c)
        else:
            end()
            out.append(c)
    end()
    return out


def descendants(x: Node):
    stack = [x]
    while stack:
        for c in stack.pop().children:
            if not isinstance(c, str):
                yield c
                stack.append(c)


def text_of(nodes: list[Node]) -> str:
    blocks: list[str] = []
    open_block: list[str] = []

    def end() -> None:
        if open_block:
            if joined := " ".join("".join(open_block).split()):
                blocks.append(joined)
            open_block.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            open_block.append(unescape(x) if "&" in x else x)
        elif x.tag == "br":
            open_block.append(" ")
        elif x.tag in BLOCK or x.tag == "":
            end()
            stack.append(None)
            stack.extend(reversed(x.children))
        else:
            stack.extend(reversed(x.children))
    end()
    return "\n\n".join(blocks)


def main_text(html: str | None) -> str:
    return text_of(content(tree(html))) if html else ""


def extract(pages: DataFrame, html_col: str = "html", text_as: str = "text", chars_as: str = "n_chars", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` with the main text and its number of code points, one row for each page.

    Null and empty html, and pages without text: an empty string and 0.  Nothing is cut off, however long.
    Null ids, repeated rows and other columns make no difference.  One map, no shuffle.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*batch.schema.names[1:], text_as, chars_as],
            )

    kinds = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    return pages.select(F.col(html_col).alias("__html"), *[F.col(c) for c in keep]).mapInArrow(run, f"{kinds}`{text_as}` string, `{chars_as}` long")
