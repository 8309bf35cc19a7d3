"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks (the text of one block-level element) with the elements around each. A linear classifier gives each block
log odds of being content; they become the capacities of its edges to the two terminals. Blocks that follow one another, and blocks
of the same parent, are joined by smoothness edges that weaken with their distance in the document tree. The minimum cut is the
labelling of least total cost; blocks on the content side make up the text.

Blocks whose log odds outweigh all their smoothness edges lie on their own side in every minimum cut. They are labelled first and
their edges become terminal capacities of their neighbours; a max-flow over the rest (few, in most pages) settles it exactly.

Character references are decoded, white space inside a block is one space, blocks are joined by one space in page order. Null and
empty pages, and pages without content, give an empty text. Broken markup is read as browsers do in the common cases (unclosed and
crossing elements, stray ``<``). Only scripts, styles and templates are skipped unread; what stands in other embedded elements (math, svg,
object, canvas, iframe, noscript) is text like any other. Pages are independent rows: nulls in id or url and repeated rows are carried along.
"""

from __future__ import annotations

import html as entities
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from thicket.llm.common import free_name, lean

_TAG = regex.compile(r"<(/?)([a-z][^\s/>]*)", regex.I)
_TAG_PART = regex.compile(r"[^>\"']*")
_EMPTY_COMMENT = regex.compile("<!--+>")
_COMMENT_END = regex.compile("--!?>")
#: Skipped unread.
_RAW = frozenset("script style template".split())
_RAW_END = {x: regex.compile(rf"</{x}(?=[\s/>])", regex.I) for x in _RAW}
_ATTRIBUTE = regex.compile(r"([a-z:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b", regex.I)

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend "
    "li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul head button label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new element of the kind ends an open one of these, if no element of the third set lies between.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table select menu".split())

#: Never content, wherever they stand.
_OUTSIDE = frozenset("nav aside footer form menu dialog button select textarea head title label".split())
_OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_OUTSIDE_NAMES = regex.compile(
    r"(?:^|[-_ ])(?:nav|navbar|navigation|menu|menus|ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|"
    r"share|sharing|social|related|recommend\w*|comments?|commentlist|respond|repl(?:y|ies)|disqus|discussion|breadcrumbs?|pagination|pager|toolbar|login|signup|search|footer|sidebar|widget|skip)(?:$|[-_ ])",
    regex.I,
)
_HEADER_NAMES = regex.compile(r"(?:^|[-_ ])(?:header|masthead|topbar|top|logo)(?:$|[-_ ])", regex.I)
_UNSEEN = regex.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", regex.I)
_NO_ARTICLE = regex.compile("comment|related|promo|ad")
_INSIDE_NAMES = regex.compile(r"(?:^|[-_ ])(?:article\w*|main|content|post|entry|story|articlebody|prose)(?:$|[-_ ])", regex.I)

#: The classifier's weights, in log odds. Explicit marks outweigh the text; where a page has none, its text and its neighbours decide.
W_INSIDE, W_OUTSIDE, W_HEADER, W_LINKS, W_WORDS, W_SENTENCE, W_HOME, W_BIAS = 3.5, -8.0, -3.0, -4.0, 1.5, 0.8, 1.5, -2.6
#: A parent with this share of the words of the richest parent of the page counts as full.
HOME = 0.3
#: Smoothness of neighbours with the same parent; divided by the square of their distance in the tree otherwise. Between marked and unmarked blocks it is weaker.
SMOOTH, SIBLING, ACROSS = 1.5, 0.75, 0.25
#: Elements nested deeper stand beside one another, as in browsers.
DEPTH = 512


@dataclass
class Block:
    up: _Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    words: int = 0
    home: float = 0.0

    @property
    def outside(self) -> bool:
        return self.up.outside


@dataclass(eq=False, slots=True)
class _Element:
    tag: str
    up: _Element | None
    block: _Element | None  # itself or the nearest block-level element around it
    depth: int  # in block-level elements
    inside: bool
    outside: bool
    header: bool


def _element(tag: str, attributes: str, up: _Element | None) -> _Element:
    inside, outside, header = (up.inside, up.outside, up.header) if up else (False, False, False)
    names = role = ""
    gone = False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "itemprop"):
                names += " " + value
            elif key == "role":
                role = value.lower()
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _UNSEEN.search(value)):
                gone = True
    if tag in ("article", "main") or role in ("main", "article") or (names and tag not in ("html", "body") and _INSIDE_NAMES.search(names)):
        inside, header = True, False
    if tag in _OUTSIDE or role in _OUTSIDE_ROLES or gone or (names and tag not in ("html", "body", "main") and _OUTSIDE_NAMES.search(names) and not (tag == "article" and not _NO_ARTICLE.search(names))):
        outside = True
    if (tag == "header" and not inside) or (names and tag not in ("html", "body", "h1") and not inside and _HEADER_NAMES.search(names)):
        header = True
    out = _Element(tag, up, None, up.depth if up else 0, inside, outside, header)
    if tag in BLOCKS or up is None:
        out.block, out.depth = out, out.depth + 1
    else:
        out.block = up.block
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds are text, open and close. Reads forward only; what is skipped leaves nothing behind."""
    at, n, lost = 0, len(page), 0
    last = {q: page.rfind(q) for q in "\"'"}
    last_end = page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            yield "text", page[at : lt if lt >= 0 else n], ""
            if lt < 0:
                return
            at = lt
        if page.startswith("<!--", at):
            if m := _EMPTY_COMMENT.match(page, at):
                at = m.end()
                continue
            m = _COMMENT_END.search(page, at + 4)
            at = m.end() if m else n
            continue
        if last_end < at:  # no tag ends any more
            yield "text", page[at:], ""
            return
        m = _TAG.match(page, at)
        if m is None:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                at = page.find(">", at) + 1
            else:
                yield "text", "<", ""
                at += 1
            continue
        # the end of the tag: the first > outside quotes; quotes that nothing closes, and those of a tag without end, mean nothing
        start = end = m.end()
        while lost < 16:
            end = _TAG_PART.match(page, end).end()
            if end >= n or page[end] == ">":
                break
            quote = page[end]
            end = page.find(quote, end + 1) + 1 if last[quote] > end else end + 1
        if lost >= 16 or end >= n:
            lost += 1
            end = page.find(">", start)
        name, attributes = m[2].lower(), page[start:end]
        at = end + 1
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, attributes
        if name in _RAW and not attributes.endswith("/"):
            over = _RAW_END[name].search(page, at)
            if over is None:
                return
            at = page.find(">", over.start()) + 1
            if not at:
                return
            yield "close", name, ""


def blocks(page: str) -> list[Block]:
    """The blocks with text of a page, in page order."""
    root = _element("", "", None)
    stack, out, links = [root], [], 0
    opened: Counter[str] = Counter()
    current: Block | None = None

    def cut(k: int) -> None:
        nonlocal links
        for e in stack[k:]:
            links -= e.tag == "a"
            opened[e.tag] -= 1
        del stack[k:]

    for kind, value, attributes in tokens(page):
        if kind == "text":
            if current is None:
                current = Block(stack[-1])
                out.append(current)
            current.parts.append(value)
            if links:
                current.linked += len(value.strip())
            continue
        tag = value
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if kind == "close":
            if tag in BLOCKS:
                current = None
            if opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        cut(k)
                        break
                    if tag not in BLOCKS and stack[k].tag in BLOCKS:
                        break  # an inline end tag does not close blocks
            continue
        if tag in BLOCKS:
            current = None
            if tag in _CLOSES:
                if any(opened[x] for x in _CLOSES[tag]):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in _CLOSES[tag]:
                            cut(k)
                            if tag != "tr":
                                break
                        elif stack[k].tag in _SCOPES:
                            break
            elif opened["p"]:
                for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    if stack[k].tag == "p":
                        cut(k)
                        break
                    if stack[k].tag in BLOCKS:
                        break
        if tag not in VOID and not attributes.endswith("/"):
            if len(stack) > DEPTH:
                cut(DEPTH)
            stack.append(_element(tag, attributes, stack[-1]))
            opened[tag] += 1
            links += tag == "a"
    found = []
    for b in out:
        if b.up.tag in _RAW:
            continue
        b.text = " ".join(entities.unescape("".join(b.parts)).split())
        if b.text:
            b.words = b.text.count(" ") + 1
            found.append(b)
    _at_home(found)
    return found


def _parent(b: Block) -> _Element:
    block = b.up.block
    return block.up.block if block.up else block


def _at_home(found: list[Block]) -> None:
    """How full the parent of each block is: its words outside links and marked elements against those of the richest parent."""
    words: Counter[int] = Counter()
    for b in found:
        if not b.up.outside:
            words[id(_parent(b))] += b.words * max(0, len(b.text) - b.linked) / len(b.text)
    most = max(words.values(), default=0.0)
    for b in found:
        b.home = min(1.0, words[id(_parent(b))] / (HOME * most)) if most else 0.0


def log_odds(b: Block) -> float:
    """Of a block being content."""
    odds = W_BIAS + W_WORDS * min(1.0, b.words / 20) + W_LINKS * min(1.0, b.linked / len(b.text)) + W_HOME * b.home
    if b.text[-1] in ".!?…\"'”’»。":
        odds += W_SENTENCE
    if b.up.inside:
        odds += W_INSIDE
    if b.up.outside:
        odds += W_OUTSIDE
    elif b.up.header:
        odds += W_HEADER
    return odds


def _distance(a: _Element, b: _Element) -> int:
    """Steps between two block-level elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up.block
        else:
            b = b.up.block
        steps += 1
    return steps


def smoothness(found: list[Block]) -> dict[tuple[int, int], float]:
    """Weights of the edges between blocks: neighbours in the page, and neighbours among a parent's blocks."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}

    def across(i: int, j: int) -> float:
        a, b = found[i].up, found[j].up
        return 1.0 if (a.outside, a.header) == (b.outside, b.header) else ACROSS

    for i, (a, b) in enumerate(pairwise(found)):
        edges[i, i + 1] = across(i, i + 1) * SMOOTH / max(1, _distance(a.up.block, b.up.block) - 1) ** 2
    for i, b in enumerate(found):
        parent = id(_parent(b))
        if parent in last:
            j = last[parent]
            edges[j, i] = edges.get((j, i), 0.0) + across(j, i) * SIBLING
        last[parent] = i
    return edges


def min_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of least cost: |odds| where a label goes against its odds, and an edge's weight where its ends differ."""
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    odds, label = list(odds), [None] * n
    queue = deque(range(n))
    while queue:  # what outweighs its edges is settled, and pulls its neighbours
        i = queue.popleft()
        if label[i] is None and abs(odds[i]) >= sum(near[i].values()):
            label[i] = odds[i] > 0
            for j, w in near[i].items():
                odds[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        at = {i: k for k, i in enumerate(left)}
        for i, content in zip(left, _max_flow([odds[i] for i in left], [{at[j]: w for j, w in near[i].items()} for i in left]), strict=True):
            label[i] = content
    return label


def _max_flow(odds: list[float], near: list[dict[int, float]]) -> list[bool]:
    """The source's side of a minimum cut: blocking flows in layers of distance (Dinic), without recursion."""
    n = len(odds)
    source, sink = n, n + 1
    room: list[dict[int, float]] = [dict(x) for x in near] + [{}, {}]
    for i, s in enumerate(odds):
        a, b = (source, i) if s > 0 else (i, sink)
        room[a][b] = abs(s)
        room[b].setdefault(a, 0.0)
    while True:
        layer, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, w in room[i].items():
                if w > 1e-12 and j not in layer:
                    layer[j] = layer[i] + 1
                    queue.append(j)
        if sink not in layer:
            return [i in layer for i in range(n)]
        ahead = {i: [j for j in room[i] if layer.get(j) == layer[i] + 1] for i in layer}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                steps = list(pairwise(path))
                push = min(room[a][b] for a, b in steps)
                for a, b in steps:
                    room[a][b] -= push
                    room[b][a] = room[b].get(a, 0.0) + push
                path = path[: next(k for k, (a, b) in enumerate(steps) if room[a][b] <= 1e-12) + 1]
                continue
            while ahead[i] and room[i][ahead[i][-1]] <= 1e-12:
                ahead[i].pop()
            if ahead[i]:
                path.append(ahead[i][-1])
            else:
                path.pop()
                if path:
                    ahead[path[-1]].pop()


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    labels = min_cut([log_odds(b) for b in found], smoothness(found))
    return " ".join(b.text for b, content in zip(found, labels, strict=True) if content)


def extract(df: DataFrame, html: str = "html", keep_html: bool = False) -> DataFrame:
    """``df`` with the columns text and n_chars (code points)."""
    at = df.columns.index(html)
    columns = [i for i in range(len(df.columns)) if keep_html or i != at]
    fields = [df.schema[i] for i in columns]
    taken = df.select(*(f.name for f in fields))
    text, n_chars = free_name(taken, "text"), free_name(taken, "n_chars")
    names = [*(f.name for f in fields), text, n_chars]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in columns), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    return df.mapInArrow(lean(run), T.StructType([*fields, T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())]))
