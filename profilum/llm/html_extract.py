"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: block elements are inner nodes, and the runs of text directly inside them,
whatever inline markup they hold, are leaves. Every node is content or not. What frames a whole page
takes no part, so the trees below it are independent. A node's potential comes
from its own features (kind of element, words in class and id, length, punctuation, share of link
text); an edge's potential says how often parent and child agree beyond chance. Messages go from the
leaves up and from the root down (sum-product), which gives every node's exact marginal. Leaves more
likely content than not are the text.

Node and edge potentials are learned together, by the likelihood of the marks under the same messages,
from the labelled pages of ``labelled_pages``, a fixed and small number, when a query is built.

Character references are decoded, white space inside a block becomes one space, and blocks are joined
in page order by a line feed. Null or empty html, and pages without content, give an empty text.
Formulas are read as part of their block. Unclosed elements end where their parent does (scripts, styles and
other raw text with the page), and a cut-off tag ends the page. Repeated rows are
extracted each, null ids and urls stay null, other columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilum.llm import labelled_pages
from profilum.llm.bpe import text_batches

BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "nav header footer aside form fieldset address details summary template noscript dialog select button menu center".split()
)
# What is never text; without a closing tag it takes the rest of the page, as browsers have it.
UNREAD = frozenset("script style title textarea iframe noframes xmp".split())
# Drawings and players, left out up to their closing tag; without one only the tag itself is.
MEDIA = frozenset("svg object video audio canvas".split())
# What holds a whole page says nothing about its parts; messages start below.
FRAME = frozenset(("#root", "html", "body"))
PLAIN = frozenset("#text p li dd dt td th tr blockquote pre h1 h2 h3 h4 h5 h6".split())
APART = frozenset("aside form nav header footer".split())
# An opening tag of the first kind ends an open element of the second within the same parent.
ENDS = {name: frozenset(ended.split()) for name, ended in {"li": "li p", "dt": "dt dd p", "dd": "dt dd p", "tr": "tr td th p", "td": "td th p", "th": "td th p", "option": "option"}.items()}
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "button", "template", "noscript"}
# Words in class, id and role.
HINTS = {
    "menu": "nav menu breadcrumb navigation toc pagination tabs",
    "edge": "header footer masthead copyright legal",
    "side": "sidebar widget related aside recommended more popular complementary",
    "advert": "ad ads advert advertisement sponsor sponsored promo promoted banner",
    "notice": "cookie consent notice popup modal alert gdpr newsletter subscribe signup login",
    "comment": "comment comments reply replies discussion disqus respond",
    "share": "share social follow tags meta byline",
    "article": "article content post entry story main text body",
}
_HINT_OF = {word: hint for hint, words in HINTS.items() for word in words.split()}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?P<end>>|\Z)|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?P<end2>>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|data-main|data-rest)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/]|$)", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    name: str
    parent: int
    hints: tuple[str, ...] = ()
    mark: str = ""
    text: str = ""
    characters: int = 0
    linked: int = 0
    parts: list[str] = field(default_factory=list)


def _attributes(rest: str) -> tuple[tuple[str, ...], str]:
    hints, mark = set(), ""
    for match in _ATTRIBUTE.finditer(rest):
        name = match[1].lower()
        if name.startswith("data-"):
            mark = name[5:]
            continue
        value = match[2] or match[3] or match[4] or ""
        hints.update(_HINT_OF[word] for word in _WORD.findall(value.lower()) if word in _HINT_OF)
    return tuple(sorted(hints)), mark


def tree(page: str) -> list[Node]:
    """Nodes in page order, parents first; leaves are named ``#text``."""
    nodes = [Node("#root", -1)]
    stack, names = [0], Counter()
    leaf, links, place, length = -1, 0, 0, len(page)
    unclosed: set[str] = set()

    def text(low: int, high: int) -> None:
        nonlocal leaf
        if low >= high:
            return
        raw = page[low:high]
        if "&" in raw:
            raw = html.unescape(raw)
        if leaf < 0:
            if not raw.strip():
                return
            leaf = len(nodes)
            nodes.append(Node("#text", stack[-1]))
        nodes[leaf].parts.append(raw)
        if links:
            nodes[leaf].linked += len(raw.strip())

    def close(depth: int) -> None:
        while len(stack) > depth:
            names[nodes[stack.pop()].name] -= 1

    while place < length:
        match = _TOKEN.search(page, place)
        if not match:
            text(place, length)
            break
        text(place, match.start())
        place = match.end()
        name = (match["name"] or match["name2"] or "").lower()
        if not name or not (match["end"] or match["end2"]):
            continue
        closing = bool(match["close"] or match["close2"])
        if name in UNREAD or name in MEDIA:
            if not closing and not (match["rest"] or match["rest2"] or "").endswith("/"):
                # A tag that is not closed is looked for once only.
                found = _closing(name).search(page, place) if name not in unclosed else None
                if found:
                    place = found.end()
                elif name in UNREAD:
                    place = length
                else:
                    unclosed.add(name)
        elif name == "a":
            links = max(0, links - 1) if closing else links + 1
        elif name == "br":
            text_break = nodes[leaf].parts if leaf >= 0 else None
            if text_break is not None:
                text_break.append(" ")
        elif name == "hr":
            leaf = -1
        elif name in BLOCKS:
            leaf = -1
            if closing:
                if names[name]:
                    depth = len(stack) - 1
                    while nodes[stack[depth]].name != name:
                        depth -= 1
                    close(depth)
                continue
            ended = ENDS.get(name, ())
            while len(stack) > 1 and (nodes[stack[-1]].name in ended or (nodes[stack[-1]].name == "p" and name in ENDS_PARAGRAPH)):
                close(len(stack) - 1)
            hints, mark = _attributes(match["rest"] or match["rest2"] or "")
            nodes.append(Node(name, stack[-1], hints, mark))
            stack.append(len(nodes) - 1)
            names[name] += 1
            if name in ("article", "section", "div", "nav", "body"):
                links = 0
    for node in nodes:
        if node.parts:
            node.text = " ".join("".join(node.parts).split())
            node.characters = len(node.text)
            node.linked = min(node.linked, node.characters)
    for node in reversed(nodes):
        if node.parent >= 0:
            nodes[node.parent].characters += node.characters
            nodes[node.parent].linked += node.linked
    return nodes


_CLOSING: dict[str, re.Pattern] = {}


def _closing(name: str) -> re.Pattern:
    if name not in _CLOSING:
        _CLOSING[name] = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.IGNORECASE)
    return _CLOSING[name]


def features(node: Node, weight: float, titled: bool) -> list[tuple[str, float]]:
    """Named features, those of plain parts of running text with their ``weight``."""
    share = node.linked / node.characters if node.characters else 0.0
    found = [("bias", weight), (f"element {node.name}", weight), ("links", weight * share)]
    found += [(f"hint {hint}", 1.0) for hint in node.hints]
    if titled:
        found.append(("holds the main heading", 1.0))
    if node.name == "#text":
        found.append(("text length", weight * min(1.0, math.log1p(node.characters) / 6)))
    return found


@dataclass
class Page:
    """What inference needs of a page: per node its parent (-1 at the top of an independent tree), the kind of the
    edge from there (0: to a part, 1: to a text, 2: to something set apart), and its features."""

    parents: list[int]
    kinds: list[int]
    rows: list[list[tuple[str, float]]]


def prepared(nodes: list[Node]) -> Page:
    """Plain parts weigh less the more of them there are side by side, so that a long text says as much about its
    parent as a short one."""
    siblings = Counter(node.parent for node in nodes)
    weights, titled = [1.0] * len(nodes), [False] * len(nodes)
    for place, node in enumerate(nodes):
        if node.name in PLAIN and not node.hints:
            weights[place] = (weights[node.parent] if nodes[node.parent].name in PLAIN else 1.0) / siblings[node.parent]
        above = node.parent if node.name == "h1" else -1
        while above > 0 and not titled[above]:
            titled[above] = True
            above = nodes[above].parent
    parents = [-1 if node.parent < 0 or nodes[node.parent].name in FRAME else node.parent for node in nodes]
    kinds = [1 if node.name == "#text" else 2 if node.name in APART or set(node.hints) - {"article"} else 0 for node in nodes]
    return Page(parents, kinds, [features(node, weight, has) for node, weight, has in zip(nodes, weights, titled)])


def _share(odds: float) -> float:
    return 1 / (1 + math.exp(-min(500.0, max(-500.0, odds))))


@dataclass
class Model:
    """Weights of node features, and edge potentials ``[kind][parent][child]``, both as logarithms."""

    weights: dict[str, float]
    edges: np.ndarray

    def messages(self, page: Page) -> tuple[list[float], list[float]]:
        """Log-odds of every node by itself, all below it and (second) all of its tree: sum-product up, then down."""
        weights, tables = self.weights, np.exp(self.edges).tolist()
        below = [sum(weights.get(name, 0.0) * value for name, value in row) for row in page.rows]
        upward = [0.0] * len(below)
        for place in range(len(below) - 1, -1, -1):
            parent = page.parents[place]
            if parent >= 0:
                edge, yes = tables[page.kinds[place]], _share(below[place])
                upward[place] = math.log((edge[1][0] * (1 - yes) + edge[1][1] * yes) / (edge[0][0] * (1 - yes) + edge[0][1] * yes))
                below[parent] += upward[place]
        whole = list(below)
        for place, parent in enumerate(page.parents):
            if parent >= 0:
                edge, yes = tables[page.kinds[place]], _share(whole[parent] - upward[place])
                whole[place] += math.log((edge[0][1] * (1 - yes) + edge[1][1] * yes) / (edge[0][0] * (1 - yes) + edge[1][0] * yes))
        return below, whole

    def upward(self, page: Page, below: list[float]) -> list[float]:
        """What each node sends to its parent."""
        tables = np.exp(self.edges)
        yes = np.array([_share(odds) for odds in below])[:, None]
        edge = tables[page.kinds]
        sent = np.log((edge[:, 1] * np.concatenate([1 - yes, yes], axis=1)).sum(axis=1) / (edge[:, 0] * np.concatenate([1 - yes, yes], axis=1)).sum(axis=1))
        return np.where(np.array(page.parents) >= 0, sent, 0.0).tolist()

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Every node's probability of being content."""
        return [_share(odds) for odds in self.messages(prepared(nodes))[1]]


def labels(nodes: list[Node]) -> list[int]:
    """Leaves take the nearest mark above them, elements what most of their text is."""
    inherited, content = ["rest"] * len(nodes), [0] * len(nodes)
    for place, node in enumerate(nodes):
        inherited[place] = node.mark or (inherited[node.parent] if node.parent >= 0 else "rest")
        content[place] = node.characters if node.name == "#text" and inherited[place] == "main" else 0
    for place in range(len(nodes) - 1, 0, -1):
        content[nodes[place].parent] += content[place]
    return [int(2 * content[place] > node.characters or (node.characters == 0 and inherited[place] == "main")) for place, node in enumerate(nodes)]


def train(pages: list[str], rounds: int = 150, rate: float = 0.5, decay: float = 0.01) -> Model:
    """Weights and edge potentials of the greatest likelihood of the marks, by gradient steps: what is marked less
    what the marginals of nodes and edges expect."""
    trees = [tree(page) for page in pages]
    examples = [(prepared(nodes), labels(nodes)) for nodes in trees]
    model = Model({name: 0.0 for page, _ in examples for row in page.rows for name, _ in row}, np.zeros((3, 2, 2)))
    steps, edge_steps = dict.fromkeys(model.weights, 1e-6), np.full((3, 2, 2), 1e-6)
    for _ in range(rounds):
        slopes = {name: -decay * weight for name, weight in model.weights.items()}
        edge_slopes = -decay * model.edges
        tables = np.exp(model.edges)
        for page, marks in examples:
            below, whole = model.messages(page)
            upward = model.upward(page, below)
            for place, (row, mark, odds) in enumerate(zip(page.rows, marks, whole)):
                gap = mark - _share(odds)
                for name, value in row:
                    slopes[name] += gap * value
                parent, kind = page.parents[place], page.kinds[place]
                if parent >= 0:
                    above, own = _share(whole[parent] - upward[place]), _share(below[place])
                    together = tables[kind] * np.outer([1 - above, above], [1 - own, own])
                    edge_slopes[kind] -= together / together.sum()
                    edge_slopes[kind, marks[parent], mark] += 1
        for name, slope in slopes.items():
            steps[name] += slope * slope
            model.weights[name] += rate * slope / math.sqrt(steps[name])
        edge_steps += edge_slopes**2
        model.edges += rate * edge_slopes / np.sqrt(edge_steps)
    return model


@lru_cache(maxsize=1)
def trained() -> Model:
    return train(labelled_pages.pages())


def blocks(page: str | None, model: Model) -> list[tuple[str, float]]:
    """All texts of a page in order, with their probability of being content."""
    nodes = tree(page or "")
    return [(node.text, chance) for node, chance in zip(nodes, model.marginals(nodes)) if node.text]


def main_text(page: str | None, model: Model) -> str:
    return "\n".join(text for text, chance in blocks(page, model) if chance > 0.5)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` per page."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sources in text_batches(batch, "html"):
                texts = [main_text(source, model) for source in sources]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, type=pa.string()), pa.array([len(text) for text in texts], type=pa.int64())], names=["id", "url", "text", "n_chars"])

    source = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(page).alias("html"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, url string, text string, n_chars long")
