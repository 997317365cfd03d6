"""Main-text extraction by minimum-cut labelling.

A page becomes a list of text blocks. Each block pays one of two costs: to be content or to be boilerplate, from its
classifier (nearest sectioning ancestors, class and id words, link density, length). These are the capacities to the two
terminals. Smoothness edges join neighbours in page order and blocks under the same container, weaker with DOM distance; they
outweigh the classifier where it is unsure, so a linked line among paragraphs stays and a lone sentence among links goes.
The minimum cut of that graph, found by maximum flow, is the labelling of least total cost.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose text is never shown or never prose.
SKIPPED = frozenset("script style noscript template svg iframe object embed canvas select option button textarea input head title".split())
#: Elements that end a block.
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul menu caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open <p>.
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul menu".split()
)
#: An element and what its start tag ends.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Cost of calling a block content, by an ancestor's element.
AGAINST = {"nav": 20.0, "menu": 20.0, "footer": 20.0, "aside": 20.0, "form": 20.0, "fieldset": 20.0, "dialog": 20.0, "address": 1.0}
#: The same for <header>, by whether it stands inside an article.
HEADER_INSIDE, HEADER_OUTSIDE = 0.5, 12.0
BAD_NAME_COST = 20.0
#: Of a block outside the article where there is one.
OUTSIDE = 8.0
#: Characters that are worth 1 to a block, and what they are worth at most.
WORTH, MOST = 50.0, 5.0
#: Of reader comments; more than any other, as an <article> inside them is none.
COMMENT = 40.0
#: Cost of calling a block boilerplate, by an ancestor's element.
IN_FAVOUR = {"article": 4.0, "main": 2.0}
COMMENT_NAMES = re.compile(r"(?<![a-z])(comments?|commentlist|reply|replies|disqus|respond|discussion|reviews?)(?![a-z])")
BAD_NAMES = re.compile(
    r"(?<![a-z])(ads?|ad(?:box|slot|sense|unit)|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w*|signup|"
    r"login|nav\w*|menu\w*|breadcrumbs?|sidebar|side|widget|related|recommend\w*|share|sharing|social|footer|foot|header|masthead|topbar|"
    r"pagination|pager|toolbar|search|legal|copyright|disclaimer|tags?|outbrain|taboola|rail|teaser|alert|skip|complementary|contentinfo)(?![a-z])"
)
GOOD_NAMES = re.compile(r"(?<![a-z])(article|content|post|entry|story|main|body|text|prose)(?![a-z])")
#: A whole class or id that names the content's wrapper: further names of the element say nothing against it.
WRAPPER = re.compile(r"(article|content|post|entry|story|main|page)(-(article|content|post|body|text|inner|wrap|wrapper|main))*")
#: Classes on layout or state, of an element that may hold anything.
MODIFIER = re.compile(r"(with|without|has|have|no|is|js|type|tag|category|format)-.*")
#: On <article> and <main> only these names count against.
COMMENT_ITEM = re.compile(r"(?<![a-z])(comments?|commentlist|reply|replies|disqus)(?![a-z])")
#: Ancestor distance that still counts as close; weight of an edge between neighbours in page order, divided by one more than their
#: distance, and between blocks of one container.
PROXIMITY = 6
NEIGHBOURS, TOGETHER = 6.0, 0.6
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[/a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.S,
)
RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for n in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: What separates words inside a block.
SPACE = re.compile(r"\s+")


class Block:
    """One text block: its text, the characters of it inside links, and its open elements from the root."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, linked: int, path: tuple):
        self.text, self.linked, self.path = text, linked, path


def blocks_of(page: str | None) -> list[Block]:
    """Blocks in page order. A path entry is (number, element, cost against content, cost against boilerplate, hidden)."""
    out: list[Block] = []
    stack: list[tuple] = []
    parts: list[str] = []
    linked = links = count = muted = 0
    at, end = 0, len(page or "")

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", _html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, linked, tuple(s for s in stack if s[1] in BLOCKS)))
            parts.clear()
        linked = 0

    def close_to(depth: int) -> None:
        nonlocal links, muted
        for s in stack[depth:]:
            if s[1] == "a":
                links -= 1
            elif s[1] in BLOCKS:
                flush()
            muted -= s[4]
        del stack[depth:]

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if not muted and (piece[0] != "<" or piece == "<"):
                parts.append(piece)
                if links:
                    linked += len(piece.strip())
            continue
        name = name.lower()
        if m[1]:  # an end tag
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][1] == name:
                    close_to(depth)
                    break
            continue
        if name in RAW_END:
            close = RAW_END[name].search(page, at)
            at = close.end() if close else end
            continue
        if name == "head" or (name in SKIPPED and name in VOID):
            continue
        mute = name in SKIPPED or bool(m[3] and HIDDEN.search(m[3]))  # until its end, or that of an element around it
        if name in BLOCKS:
            flush()
            if name in CLOSES_P or name in ENDS:
                ends = {"p"} | ENDS.get(name, set())
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][1] in ends:
                        close_to(depth)
                        break
                    if stack[depth][1] in BLOCKS:
                        break
        if name in VOID:
            if name == "br" and not muted:
                parts.append(" ")
            continue
        against, favour = AGAINST.get(name, 0.0), IN_FAVOUR.get(name, 0.0)
        if m[3] and name not in ("html", "body"):
            more = named_costs(name, " ".join(a or b or c for a, b, c in NAMED.findall(m[3])).lower().replace("_", "-"))
            against, favour = against + more[0], favour + more[1]
        links += name == "a"
        stack.append((count, name, against, favour, mute))
        muted += mute
        count += 1
    flush()
    return out


def named_costs(element: str, names: str) -> tuple[float, float]:
    """(cost against content, cost against boilerplate) by an element's class, id and role names."""
    if element in IN_FAVOUR:
        return (COMMENT, 0.0) if COMMENT_ITEM.search(names) else (0.0, 0.0)
    if COMMENT_NAMES.search(names):
        return COMMENT, 0.0
    each = [x for x in names.split() if not MODIFIER.fullmatch(x)]
    if any(map(WRAPPER.fullmatch, each)):
        return 0.0, 1.5
    if any(map(BAD_NAMES.search, each)):
        return BAD_NAME_COST, 0.0
    return 0.0, 1.5 * any(map(GOOD_NAMES.search, each))


def costs(block: Block, in_article: bool) -> tuple[float, float]:
    """(cost of calling it content, cost of calling it boilerplate). in_article: the page has an article or main element."""
    against = favour = 0.0
    inside = False
    for _, name, a, f, _ in block.path:
        favour += f if name not in IN_FAVOUR or (not inside and against < COMMENT) else 0.0
        if name in IN_FAVOUR and not inside and against < COMMENT:
            inside = True
            against = 0.0  # what stands around the article says nothing of it
        if name == "header":
            a += HEADER_INSIDE if inside else HEADER_OUTSIDE
        against += a
    n = len(block.text)
    density = min(1.0, block.linked / n) if n else 0.0
    length = min(MOST, n / WORTH)
    against += density * (4.0 + length)
    if in_article and not inside:
        against += OUTSIDE
    favour += 1.0 + length
    if not inside and n < 25 and block.text[-1:] not in ".!?:…»\"”":
        against += 1.0
    return against, favour


def min_cut(to_content: list[float], to_boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for each node on the content side of the minimum cut.

    to_content[i] is paid if i is content, to_boilerplate[i] if it isn't, each edge's weight if its ends differ. Ties leave
    a node on the boilerplate side only if it can't be reached from the content terminal in the residual graph.
    """
    n = len(to_content)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def arc(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(forth)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        both = min(to_content[i], to_boilerplate[i])  # flows straight through
        if to_boilerplate[i] > both:
            arc(source, i, to_boilerplate[i] - both, 0.0)
        elif to_content[i] > both:
            arc(i, sink, to_content[i] - both, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:  # blocking flow, without recursion
            if a == sink:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[a] < len(head[a]):
                e = head[a][nxt[a]]
                if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                nxt[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]


def cut_reduced(to_content: list[float], to_boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """min_cut() on what is left after fixing nodes whose own preference outweighs all their edges.

    Such a node is on its preferred side in every minimum cut, so its edges become terminal capacities of its neighbours.
    """
    n = len(to_content)
    weight = [0.0] * n
    for a, b, w in edges:
        weight[a] += w
        weight[b] += w
    keep = [to_boilerplate[i] > to_content[i] for i in range(n)]
    free = [i for i in range(n) if abs(to_boilerplate[i] - to_content[i]) <= weight[i]]
    if free:
        at = {i: k for k, i in enumerate(free)}
        content, boilerplate, inner = [to_content[i] for i in free], [to_boilerplate[i] for i in free], []
        for a, b, w in edges:
            if a in at and b in at:
                inner.append((at[a], at[b], w))
            elif a in at or b in at:
                k, other = (at[a], b) if a in at else (at[b], a)
                if keep[other]:
                    boilerplate[k] += w
                else:
                    content[k] += w
        for i, side in zip(free, min_cut(content, boilerplate, inner), strict=True):
            keep[i] = side
    return keep


def label(blocks: list[Block]) -> list[bool]:
    """Content or not, for each block."""
    in_article = any(s[1] in IN_FAVOUR for b in blocks for s in b.path)
    priced = [costs(b, in_article) for b in blocks]
    edges = []
    last_in: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            one, other = blocks[i - 1].path, b.path
            shared = 0
            for x, y in zip(one, other, strict=False):
                if x[0] != y[0]:
                    break
                shared += 1
            apart = len(one) + len(other) - 2 * shared
            if apart <= PROXIMITY:
                edges.append((i - 1, i, NEIGHBOURS / (1 + apart)))
        for s in b.path[-2:]:  # the nearest containers
            if s[1] not in ("html", "body"):
                if s[0] in last_in and last_in[s[0]] != i - 1:
                    edges.append((last_in[s[0]], i, TOGETHER))
                last_in[s[0]] = i
    return cut_reduced([p[0] for p in priced], [p[1] for p in priced], edges)


def main_text(page: str | None) -> str:
    """The page's content blocks, joined by one space; empty if there are none."""
    blocks = blocks_of(page)
    return " ".join(b.text for b, keep in zip(blocks, label(blocks), strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of `pages` but the html, plus text and n_chars (code points).

    Null and empty html give the empty text. Rows are independent: repeated rows, null keys, extra columns and an empty table
    pass through. Truncated markup is closed at the end of the page. Own columns replace columns of the same name.
    """
    keep = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]
    schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
            own = [pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=schema.names)

    return pages.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{html_col}`")).mapInArrow(run, schema)
