"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text in it is a node that is content or not. A
node has evidence of its own (the kind of element, words in its class and id, length,
links and punctuation of its text), and a potential joins it with its parent, by the
kind of the child. Sum-product messages pass from the leaves to the root and back, and
the exact marginals say which runs of text to keep. All potentials are counted on
labelled pages.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.shared import arrow_map, quoted, record

# fixed values: HTML's element categories
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template textarea title iframe svg object select xmp noembed".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s"
    " samp small span strike strong sub sup time tt u var wbr".split()
)
_CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
_STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

# fixed values: what authors call parts of a page
_NAMES = {
    "comment": "comment comments respond disqus replies reply discussion",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adsense outbrain taboola",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar tabs pagination pager skip",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall",
    "side": "sidebar side aside widget widgets related recommended popular trending share social tags meta byline author",
    "frame": "header masthead footer foot copyright legal colophon head",
    "main": "article content main post entry story body text prose hentry maincontent",
}
_HINT = {word: kind for kind, words in _NAMES.items() for word in words.split()}
_TAG_KIND = {
    "nav": "menu", "menu": "menu", "header": "frame", "footer": "frame", "aside": "side", "form": "form",
    "button": "form", "fieldset": "form", "dialog": "notice", "article": "main", "main": "main",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "p": "text", "blockquote": "text", "pre": "text", "figcaption": "text", "ul": "list", "ol": "list",
    "dl": "list", "li": "item", "dt": "item", "dd": "item", "table": "table", "tr": "table", "td": "cell",
    "th": "cell", "section": "box", "div": "box", "body": "body", "html": "body",
}
_ROLE = {"navigation": "menu", "banner": "frame", "contentinfo": "frame", "complementary": "side", "search": "form",
         "main": "main", "article": "main", "dialog": "notice", "alert": "notice"}

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    # a tag that the page ends in
    r"|</?[a-zA-Z][^<>]*\Z",
    re.S,
)
# what ends a raw element; nothing inside it is markup
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in _RAW}
_ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Node:
    """A block element, or a run of text in one (`tag` is empty)."""

    parent: int
    tag: str
    kind: str
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    keep: bool | None = None

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


def _kind(tag: str, attributes: dict[str, str]) -> str:
    """What names say, before roles and the element itself; `main` yields to any other name."""
    names = _CAMEL.sub(" ", f"{attributes.get('class', '')} {attributes.get('id', '')}")
    hints = [_HINT[w] for w in map(str.lower, _WORDS.findall(names)) if w in _HINT]
    own = _ROLE.get(attributes.get("role", "").lower()) or _TAG_KIND.get(tag, "box")
    if "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", ""):
        return "notice"
    if own in ("box", "list", "table", "main", "frame") and hints:
        other = [h for h in hints if h != "main"]
        if own == "main" and not any(h in ("comment", "ad", "notice") for h in other):
            return own
        return other[0] if other else "main" if own == "box" else own
    if own in ("text", "item", "cell", "heading") and any(h in ("comment", "ad", "notice") for h in hints):
        return next(h for h in hints if h in ("comment", "ad", "notice"))
    return own


def parsed(page: str, labelled: bool = False) -> list[Node]:
    """Nodes in page order, parents first; unclosed and crossed tags are mended.

    With `labelled`, elements that carry `data-keep` are content, with all in them.
    """
    nodes = [Node(-1, "html", "body", keep=False if labelled else None)]
    open_tags: list[tuple[str, int]] = [("html", 0)]
    links, run, at = 0, -1, 0

    def text(piece: str) -> None:
        nonlocal run
        if not piece:
            return
        if run < 0:
            if piece.isspace():
                return
            top = open_tags[-1][1]
            run = len(nodes)
            nodes.append(Node(top, "", "run", keep=nodes[top].keep))
        if "&" in piece:
            piece = html.unescape(piece)
        nodes[run].parts.append(piece)
        if links:
            nodes[run].linked += len(piece)

    def close(to: int) -> None:
        nonlocal run
        del open_tags[to:]
        run = -1

    while match := _MARK.search(page, at):
        text(page[at : match.start()])
        at = match.end()
        if end := match[1]:
            end = end.lower()
            if end == "a":
                links = 0
            elif end == "br":
                text(" ")
            elif end not in _INLINE:
                for k in range(len(open_tags) - 1, 0, -1):
                    if open_tags[k][0] == end:
                        close(k)
                        break
        elif tag := match[2]:
            tag = tag.lower()
            if tag == "a":
                links = 1
            elif tag in _RAW:
                if not match[3].rstrip().endswith("/"):
                    closing = _RAW_END[tag].search(page, at)
                    at = closing.end() if closing else len(page)
                text(" ")
            elif tag == "br":
                text(" ")
            elif tag in _INLINE:
                pass
            elif tag in _VOID:
                run = -1 if tag == "hr" else run
            elif tag not in ("html", "head"):
                for k in range(len(open_tags) - 1, 0, -1):
                    if open_tags[k][0] in _STOPS.get(tag, ()):
                        break
                    if open_tags[k][0] == "p" or open_tags[k][0] in _CLOSES.get(tag, ()):
                        close(k)
                        if tag not in _CLOSES or open_tags[-1][0] not in _CLOSES[tag]:
                            break
                run, links = -1, 0
                attributes = _attributes(match[3]) if match[3] else {}
                top = open_tags[-1][1]
                keep = (nodes[top].keep or "data-keep" in attributes) if labelled else None
                open_tags.append((tag, len(nodes)))
                nodes.append(Node(top, tag, _kind(tag, attributes), keep=keep))
    text(page[at:])
    return nodes


def evidence(node: Node, parent: Node) -> tuple:
    """What a run of text looks like; elements have the evidence of their kind alone."""
    if node.tag:
        return (node.kind,)
    text = node.text
    words = text.count(" ") + 1
    return (
        parent.kind,
        min(6, words.bit_length()),
        min(4, round(4 * node.linked / max(1, len(text)))),
        bool(text) and text[-1] in ".!?:;\"'”»…。",
        "©" in text,
    )


@dataclass
class Model:
    """Log likelihood ratios of evidence, and P(child | parent) by kind of the child."""

    features: dict[tuple, float]
    joins: dict[str, tuple[float, float, float, float]]
    start: float
    known: dict[tuple, float] = field(default_factory=dict)

    def ratio(self, seen: tuple) -> float:
        """P(evidence | content) / P(evidence | other), features independent."""
        if seen not in self.known:
            total = sum(self.features.get((len(seen), k, v), 0.0) for k, v in enumerate(seen))
            self.known[seen] = math.exp(max(-30.0, min(30.0, total)))
        return self.known[seen]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node, by one pass up and one down."""
        n = len(nodes)
        even = (0.5, 0.5, 0.5, 0.5)
        other, content = [1.0] * n, [1.0] * n
        joins = [self.joins.get(node.kind, even) for node in nodes]
        up = [(1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):
            node = nodes[k]
            a, b = other[k], content[k] * self.ratio(evidence(node, nodes[node.parent]))
            j = joins[k]
            m0, m1 = j[0] * a + j[1] * b, j[2] * a + j[3] * b
            s = m0 + m1
            up[k] = m0, m1 = m0 / s, m1 / s
            other[k], content[k] = a / (a + b), b / (a + b)
            # normalised at once: long lists of children must not underflow
            p = node.parent
            a, b = other[p] * m0, content[p] * m1
            other[p], content[p] = a / (a + b), b / (a + b)
        a, b = other[0] * (1 - self.start), content[0] * self.start
        other[0], content[0] = a / (a + b), b / (a + b)
        for k in range(1, n):
            p, j = nodes[k].parent, joins[k]
            # the parent's belief without this child
            a, b = other[p] / max(up[k][0], 1e-300), content[p] / max(up[k][1], 1e-300)
            a, b = a / (a + b), b / (a + b)
            a, b = other[k] * (a * j[0] + b * j[2]), content[k] * (a * j[1] + b * j[3])
            other[k], content[k] = a / (a + b), b / (a + b)
        return content


def train(pages: list[str], smooth: float = 0.5) -> Model:
    """Count evidence and parent-child labels on pages whose content carries `data-keep`."""
    seen: dict[tuple, Counter] = defaultdict(Counter)
    joined: dict[str, Counter] = defaultdict(Counter)
    roots, totals = Counter(), defaultdict(Counter)
    for page in pages:
        nodes = parsed(page, labelled=True)
        # an element that holds any content belongs to the content's path
        for node in reversed(nodes[1:]):
            nodes[node.parent].keep = nodes[node.parent].keep or node.keep
        roots[nodes[0].keep] += 1
        for node in nodes[1:]:
            joined[node.kind][nodes[node.parent].keep, node.keep] += 1
            facts = evidence(node, nodes[node.parent])
            totals[len(facts)][node.keep] += 1
            for k, v in enumerate(facts):
                seen[len(facts), k, v][node.keep] += 1
    # kinds of elements speak through their joins; their evidence would count them twice
    features = {
        key: math.log((n[True] + smooth) / (totals[key[0]][True] + 2 * smooth))
        - math.log((n[False] + smooth) / (totals[key[0]][False] + 2 * smooth))
        for key, n in seen.items()
        if key[0] > 1
    }
    joins = {}
    for kind, n in joined.items():
        rows = []
        for parent in (False, True):
            total = n[parent, False] + n[parent, True] + 2 * smooth
            rows += [(n[parent, False] + smooth) / total, (n[parent, True] + smooth) / total]
        joins[kind] = tuple(rows)
    total = roots[False] + roots[True] + 2 * smooth
    return Model(features, joins, (roots[True] + smooth) / total)


def main_text(page: str, model: Model) -> str:
    """Kept runs of text in page order, one per line, white space inside made single."""
    nodes = parsed(page)
    chances = model.marginals(nodes)
    kept = (node.text for node, p in zip(nodes, chances, strict=True) if not node.tag and p > 0.5)
    return "\n".join(t for t in kept if t)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def extracted(
    pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """`page_id`, `url`, `text` of every row; NULL, empty and text-less pages give an empty text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return record(_OUT, *batch.columns[:2], [main_text(p, model) for p in batch.column(2).to_pylist()])

        return each

    chosen = pages.select(
        F.col(quoted(id_col)).cast("long"),
        F.col(quoted(url_col)).cast("string"),
        F.coalesce(F.col(quoted(html_col)).cast("string"), F.lit("")),
    ).toDF("page_id", "url", "html")
    return arrow_map(chosen, start, "page_id long, url string, text string")
