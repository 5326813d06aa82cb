"""Main text of web pages by a tree-structured graphical model.

The nodes of a page are its block elements and their blocks of text; each is content or not.
A node's own potential depends on features: tag, names in class, id and role, length and share of linked text. A
potential on every parent-child edge says how the two go together. Sum-product messages, from the
leaves to the root and back, give each node's exact marginal probability; blocks of text that are more
likely content than not are the main text. The weights maximise the likelihood of labelled
pages, by gradients from the same marginals.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.labelled_pages import labelled_pages
from tidewatch.llm.tables import small_batches

TRAINING_PAGES = 600
_CACHED = 1000  # characters of the attributes that a task remembers at most
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>\"'<]*)(?P<attrs>(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>\"'<]*)[^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|data-content)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Kinds of HTML elements: fixed values of the language.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page. What a head holds is left out as such elements, so a head needs no end.
SKIPPED = frozenset(
    "script style noscript template title iframe object svg math canvas audio video select textarea button".split()
)
_RAW = frozenset("script style noscript template title iframe textarea".split())
# Of the others, those that may hold one of their own kind.
_NESTED = frozenset("object svg math".split())
_ANY_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'<]*)[^>]*>")
#: An opening tag closes these open elements, up to the nearest barrier.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
_NOT_IN_P = BLOCKS - {"html", "body"}


@dataclass
class Page:
    """Nodes in page order, parents first. A block of text has a text, an element none."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    size: list[int] = field(default_factory=list)  # characters of text within
    linked: list[int] = field(default_factory=list)  # of these, in links
    marked: list[bool] = field(default_factory=list)  # within data-content

    def add(self, parent: int, tag: str, names: tuple[str, ...], marked: bool, text: str | None = None, linked: int = 0) -> int:
        for column, value in zip(
            (self.parent, self.tag, self.names, self.text, self.size, self.linked, self.marked),
            (parent, tag, names, text, len(text or ""), linked, marked),
        ):
            column.append(value)
        return len(self.parent) - 1


def _attributes(attrs: str) -> tuple[tuple[str, ...], bool]:
    return _read_attributes(attrs) if len(attrs) <= _CACHED else _read_attributes.__wrapped__(attrs)


@lru_cache(maxsize=20_000)
def _read_attributes(attrs: str) -> tuple[tuple[str, ...], bool]:
    names: list[str] = []
    marked = False
    for key, *values in _ATTRIBUTE.findall(attrs):
        if key.lower() == "data-content":
            marked = True
        else:
            names += [n.lower() for n in _NAME.findall("".join(values))]
    return tuple(dict.fromkeys(names)), marked


def _ends(source: str, tag: str) -> dict[int, int]:
    """Where the content of each element of a skipped kind begins, and where the element ends.

    An element without an end tag of its own is not among them: it ends where it begins.
    """
    found: dict[int, int] = {}
    opened: list[int] = []
    for token in re.compile(rf"<(/?){tag}(?![^\s/>])[^>]*>", re.IGNORECASE).finditer(source):
        if token[1]:
            if opened:
                found[opened.pop()] = token.end()
        elif not token[0].endswith("/>"):
            if tag not in _NESTED:
                opened.clear()
            opened.append(token.end())
    return found


def _end_within(source: str, at: int, end: int, around: set[str]) -> int:
    """The end of a skipped element, or the end tag of a block around it that comes first."""
    within: list[str] = []
    for token in _ANY_TAG.finditer(source, at, end):
        name = token[2].lower()
        if name in BLOCKS:
            if not token[1]:
                within.append(name)
            elif name in within:
                while within.pop() != name:
                    pass
            elif name in around:
                return token.start()
    return end


def parse_page(source: str) -> Page:
    """The block tree of a page; unclosed, misplaced and unknown tags are put up with."""
    page = Page()
    stack = [(page.add(-1, "html", (), False), "html")]
    buffer: list[tuple[str, bool]] = []
    links = 0
    ends: dict[str, dict[int, int]] = {}

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(t for t, _ in buffer)).split())
            if text:
                linked = sum(len(t.strip()) for t, inside in buffer if inside)
                top = stack[-1][0]
                page.add(top, page.tag[top], page.names[top], page.marked[top], text, min(linked, len(text)))
            buffer.clear()

    def close(tags: set[str], barriers: set[str]) -> None:
        """Close the outermost open element of these tags this side of the barriers."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][1] in barriers:
                return
            if stack[i][1] in tags:
                cut = i
                while cut > 1 and stack[cut - 1][1] in tags:
                    cut -= 1
                flush()
                del stack[cut:]
                return

    at, end_of = 0, len(source)
    while at < end_of:
        match = _TOKEN.match(source, at)
        at = match.end()
        text = match["text"] or match["cdata"]
        if text is not None:
            buffer.append((text, links > 0))
            continue
        tag = (match["tag"] or match["tag2"] or "").lower()
        if not tag:
            continue
        ending = match["end"] or match["end2"]
        if tag in SKIPPED:
            if tag in _RAW and not ending:
                found = re.compile(f"</{tag}[^>]*>?", re.IGNORECASE).search(source, at)
                at = found.end() if found else end_of
                buffer.append((" ", False))
            elif not ending and not (match["attrs"] or "").endswith("/"):
                if tag not in ends:
                    ends[tag] = _ends(source, tag)
                if at in ends[tag]:
                    at = _end_within(source, at, ends[tag][at], {name for _, name in stack[1:]})
            continue
        if tag == "a":
            links = max(0, links - 1) if ending else links + 1
        elif tag == "br" or tag == "img":
            buffer.append((" ", False))
        elif tag in BLOCKS:
            links = 0
            flush()
            if ending:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][1] == tag:
                        del stack[i:]
                        break
                continue
            if tag in ("html", "hr"):
                continue
            if tag in _NOT_IN_P:
                close({"p"}, BLOCKS - {"p"})
            if tag in _CLOSES:
                close(*_CLOSES[tag])
            names, marked = _attributes(match["attrs"] or "")
            top = stack[-1][0]
            stack.append((page.add(top, tag, names, marked or page.marked[top]), tag))
    flush()
    for i in range(len(page.parent) - 1, 0, -1):
        if page.text[i] is not None or page.size[i]:
            up = page.parent[i]
            page.size[up] += page.size[i]
            page.linked[up] += page.linked[i]
    return page


def _grade(value: float, steps: tuple[float, ...]) -> int:
    return sum(value >= s for s in steps)


def features(page: Page, i: int) -> tuple[str, ...]:
    """Names of the features of a node."""
    size, text = page.size[i], page.text[i]
    linked = _grade(page.linked[i] / size, (0.01, 0.25, 0.5, 0.8)) if size else 5
    if text is None:
        return ("e", f"e.tag.{page.tag[i]}", f"e.size.{_grade(size, (1, 40, 150, 600))}", f"e.linked.{linked}", *[f"name.{n}" for n in page.names[i]])
    last = "stop" if text[-1] in ".!?:;…\"”)" else "open"
    return ("t", f"t.tag.{page.tag[i]}", f"t.size.{_grade(size, (10, 25, 60, 150, 400))}", f"t.linked.{linked}", f"t.{last}")


@dataclass
class ContentModel:
    weights: dict[str, float] = field(default_factory=dict)
    #: Potentials (parent, child) = (0, 1), (1, 0), (1, 1), against (0, 0), of edges to elements and to blocks.
    edges: dict[bool, list[float]] = field(default_factory=lambda: {False: [-1.0, -1.0, 1.0], True: [-1.0, -1.0, 1.0]})

    def __post_init__(self) -> None:
        self._own: dict[tuple, float] = {}

    def own(self, page: Page) -> list[float]:
        """Log odds of each node by its own features."""
        found, weights = [], self.weights
        for i in range(len(page.parent)):
            size, text = page.size[i], page.text[i]
            linked = page.linked[i]
            if text is None:
                key = (page.tag[i], page.names[i], _grade(size, (1, 40, 150, 600)), _grade(linked / size, (0.01, 0.25, 0.5, 0.8)) if size else 5)
            else:
                key = (page.tag[i], _grade(size, (10, 25, 60, 150, 400)), _grade(linked / size, (0.01, 0.25, 0.5, 0.8)), text[-1] in ".!?:;…\"”)", 0)
            value = self._own.get(key)
            if value is None:
                if len(self._own) > 100_000:
                    self._own.clear()
                value = self._own[key] = sum(weights.get(f, 0.0) for f in features(page, i))
            found.append(value)
        return found

    def messages(self, page: Page) -> tuple[list[float], list[float], list[float]]:
        """Sum-product in log odds: each node's belief from below, its message up, and its full belief."""
        n, parent, text = len(page.parent), page.parent, page.text
        below, up, exp, log = self.own(page), [0.0] * n, math.exp, math.log
        for i in range(n - 1, 0, -1):
            w01, w10, w11 = self.edges[text[i] is not None]
            b = exp(min(30.0, max(-30.0, below[i])))
            up[i] = log((exp(w10) + exp(w11) * b) / (1 + exp(w01) * b))
            below[parent[i]] += up[i]
        full = list(below)
        for i in range(1, n):
            w01, w10, w11 = self.edges[text[i] is not None]
            b = exp(min(30.0, max(-30.0, full[parent[i]] - up[i])))
            full[i] = below[i] + log((exp(w01) + exp(w11) * b) / (1 + exp(w10) * b))
        return below, up, full


def node_labels(page: Page) -> list[bool]:
    """Blocks are labelled by their marks, elements by whether half of their text is marked."""
    marked = [page.size[i] if page.text[i] is not None and page.marked[i] else 0 for i in range(len(page.parent))]
    for i in range(len(page.parent) - 1, 0, -1):
        marked[page.parent[i]] += marked[i]
    return [m * 2 >= s > 0 and m > 0 for m, s in zip(marked, page.size)]


def train(pages: Iterable[str], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3) -> ContentModel:
    """Weights that make the labelled ``pages`` likely: ascent on the likelihood's gradient, the labels minus
    the expectations under the marginals, with steps shrunk by the gradients so far."""
    model = ContentModel()
    parsed = [parse_page(p) for p in pages]
    known = [(p, node_labels(p), [features(p, i) for i in range(len(p.parent))]) for p in parsed]
    seen: dict[object, float] = {}

    def step(key: object, value: float, gradient: float) -> float:
        gradient -= decay * value
        seen[key] = seen.get(key, 1e-6) + gradient * gradient
        return value + rate * gradient / math.sqrt(seen[key])

    odds = lambda x: 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))
    for _ in range(rounds):
        for page, labels, named in known:
            model._own.clear()
            below, up, full = model.messages(page)
            gradient: dict[object, float] = {}
            for i, names in enumerate(named):
                miss = labels[i] - odds(full[i])
                for name in names:
                    gradient[name] = gradient.get(name, 0.0) + miss
            for i in range(1, len(named)):
                kind, p = page.text[i] is not None, page.parent[i]
                w = model.edges[kind]
                rest = min(30.0, max(-30.0, full[p] - up[i]))
                own = min(30.0, max(-30.0, below[i]))
                mass = [1.0, math.exp(w[0] + own), math.exp(w[1] + rest), math.exp(w[2] + rest + own)]
                total = sum(mass)
                for j, pair in enumerate(((0, 1), (1, 0), (1, 1))):
                    held = (labels[p], labels[i]) == pair
                    gradient[(kind, j)] = gradient.get((kind, j), 0.0) + held - mass[j + 1] / total
            for key, g in gradient.items():
                if isinstance(key, str):
                    model.weights[key] = step(key, model.weights.get(key, 0.0), g)
                else:
                    model.edges[key[0]][key[1]] = step(key, model.edges[key[0]][key[1]], g)
    model._own.clear()
    return model


@lru_cache(maxsize=1)
def built_in_model() -> ContentModel:
    """The model of the labelled pages of this package; fitted once a process."""
    return train(labelled_pages(TRAINING_PAGES))


def main_text(model: ContentModel, source: str | None) -> str:
    """Blocks of main text in page order, two line ends between them."""
    page = parse_page(source or "")
    full = model.messages(page)[2]
    return "\n\n".join(t for t, odds in zip(page.text, full) if t is not None and odds > 0)


def extract(pages: DataFrame, model: ContentModel | None = None) -> DataFrame:
    """``pages`` (``page_id, url, html``; others are ignored) as ``page_id, url, text, n_chars``.

    A null or empty html gives an empty text. Pages are independent: repeated rows give equal texts, and nothing of a
    very long page is left out.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or built_in_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [main_text(model, source) for source in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
