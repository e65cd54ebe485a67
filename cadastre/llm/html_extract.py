"""Main text of HTML pages by a minimum cut.

A page is read into blocks of text, each with its way of elements from the root. Every
block is a node of a small flow network: a classifier's cost of calling it boilerplate is
its capacity from the source, the cost of calling it content its capacity to the sink;
neighbours in the page, and blocks under one parent, are joined by smoothness edges that
weigh less the further apart their elements are. The minimum cut, found by augmenting
paths, is the cheapest labelling; blocks on the source's side are the main text.

The classifier is naive Bayes over binned features of a block and its neighbours (length,
links, words, punctuation, element). Its counts come from the blocks of all pages whose markup
says what they are (``article`` and ``main``, or navigation, adverts and so on), so it carries
what marked pages show to blocks without marks. A block's cost is what its markup says plus
the classifier's bounded log-odds; clear markup outweighs two edges, so the cut decides where
markup is silent or the text speaks weakly.

Markup, scripts, styles, comments and the head are no text. A header inside an article is the
article's own and stays with it; a page's header goes. Character references are
decoded, white space inside a block becomes one blank, blocks are joined by an empty
line. Unclosed, stray and broken tags are taken as a browser takes them, roughly. Null,
empty and text-free pages give an empty text; a repeated page is read each time; a very
long or deeply nested page costs time in proportion to its length. Extra columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements by what they mean for a reader.
BLOCK_ELEMENTS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_ELEMENTS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_ELEMENTS = frozenset("script style textarea noscript template iframe svg math object canvas audio video title head".split())
NO_TEXT = frozenset("script style noscript template iframe svg math object canvas audio video head title select option button textarea label input".split())
BOILERPLATE_ELEMENTS = frozenset("nav header footer aside form menu dialog search fieldset".split())
CONTENT_ELEMENTS = frozenset("article main".split())
RAW_TO_THE_END = frozenset("script style textarea title".split())
SIBLINGS = (frozenset({"li"}), frozenset({"dt", "dd"}), frozenset({"td", "th"}))
ELEMENT_KINDS = {"p": 1, "pre": 1, "blockquote": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "li": 3, "dt": 3, "dd": 3, "td": 4, "th": 4}
CLOSES_P = BLOCK_ELEMENTS - {"option", "legend", "caption", "summary"}
# Words of class, id and role that mark what is not the article, or what is.
BOILERPLATE_WORDS = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment\w*|cookies?|consent|disqus|footer|footnotes?nav|header|masthead|menu\w*|nav\w*|"
    r"newsletter|notice|overlay|pagination|pager|popup|modal|promo\w*|related|recommend\w*|repl(?:y|ies)|respond|rss|share|sharing|sidebar|side-?bar|signup|"
    r"social|sponsor\w*|subscribe|toolbar|topbar|widget|complementary|contentinfo|navigation|search|alert|gdpr|skip|sr-only|visually-hidden|hidden)(?=$|[\s_-])"
)
CONTENT_WORDS = re.compile(r"(?i)(?:^|[\s_-])(?:article\w*|post|post-?body|entry|entry-content|story|main|main-?content|content|body|text)(?=$|[\s_-])")

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([^\s=\"'/<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_ENDS = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*$")
_NOTICE = re.compile(r"(?i)©|(?:copyright|all rights reserved)\b")
_END_OF = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW_ELEMENTS}

# Costs and edges are of one order: what markup says outweighs two edges, what the text alone says does not.
FOR, AGAINST, HIDDEN = 3.0, -7.0, -12.0
TEXT_LIMIT = 1.5
NEXT, FOLLOWER, FAR = 0.8, 0.5, 32
TEMPER, ALPHA = 0.1, 50.0

Model = dict[tuple[str, int], float]


class Place:
    """A block element on the way from the root."""

    __slots__ = ("above", "depth")

    def __init__(self, above: Place | None):
        self.above, self.depth = above, 0 if above is None else above.depth + 1


class Open:
    """An open element, with what it and all above it say of their text."""

    __slots__ = ("name", "place", "good", "bad", "dropped", "link")

    def __init__(self, name: str, place: Place, good: float, bad: float, dropped: bool, link: bool):
        self.name, self.place, self.good, self.bad, self.dropped, self.link = name, place, good, bad, dropped, link


class Block:
    """Text of a block, the element it stands in, what markup says for it and against it, and its linked characters."""

    __slots__ = ("text", "place", "good", "bad", "linked", "name")

    def __init__(self, text: str, place: Place, good: float, bad: float, linked: int, name: str):
        self.text, self.place, self.good, self.bad, self.linked, self.name = text, place, good, bad, linked, name


def _evidence(name: str, attributes: str, in_article: bool) -> tuple[float, float]:
    """What an element says for the text below it, and against it; the page's own root says nothing."""
    if name in ("html", "body"):
        return 0.0, 0.0
    good = FOR if name in CONTENT_ELEMENTS else 0.0
    bad = AGAINST if name in BOILERPLATE_ELEMENTS and not (in_article and name == "header") else 0.0
    if attributes:
        for key, a, b, c in _ATTR.findall(attributes):
            key, value = key.lower(), html.unescape(a or b or c)
            if key in ("class", "id", "role", "itemprop"):
                if BOILERPLATE_WORDS.search(value):
                    bad += AGAINST
                elif CONTENT_WORDS.search(value):
                    good += FOR / 2
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _UNSEEN.search(value):
                bad += HIDDEN
    return good, bad


class Reader:
    """One pass over a page. Every step costs constant time but for the characters it consumes."""

    def __init__(self, page: str):
        self.page, self.blocks, self.pieces, self.linked = page, [], [], 0
        self.stack = [Open("", Place(None), 0.0, 0.0, False, False)]
        self.block_at = [0]  # where block elements stand on the stack
        self.where: dict[str, list[int]] = {}  # the same by name
        self.endless: set[str] = set()  # marks that do not come again

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        self.pieces.clear()
        if text:
            top, block = self.stack[-1], self.stack[self.block_at[-1]]
            self.blocks.append(Block(text, block.place, min(top.good, FOR), top.bad, min(self.linked, len(text)), block.name))
        self.linked = 0

    def take(self, raw: str) -> None:
        top = self.stack[-1]
        if raw and not top.dropped:
            text = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(text)
            if top.link:
                self.linked += len(text.strip())

    def push(self, name: str, attributes: str) -> None:
        top = self.stack[-1]
        good, bad = _evidence(name, attributes, bool(self.where.get("article")))
        block = name in BLOCK_ELEMENTS
        if block:
            self.block_at.append(len(self.stack))
        self.where.setdefault(name, []).append(len(self.stack))
        place = Place(top.place) if block else top.place
        self.stack.append(Open(name, place, top.good + good, top.bad + bad, top.dropped or name in NO_TEXT, top.link or name == "a"))

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            gone = self.stack.pop()
            if gone.name:
                self.where[gone.name].pop()
        while self.block_at[-1] >= depth:
            self.block_at.pop()

    def close(self, name: str) -> None:
        if not self.where.get(name):
            return
        depth = self.where[name][-1]
        if name not in BLOCK_ELEMENTS and self.block_at[-1] > depth:
            # an inline element ends; the blocks inside it go on
            self.where[name].pop()
            self.stack[depth].name, self.stack[depth].link = "", False
            return
        if self.block_at[-1] >= depth:
            self.flush()
        self.pop_to(depth)

    def open(self, name: str, attributes: str, at: int) -> int:
        """Take an opening tag; where to read on."""
        if name == "br":
            self.take(" ")
            return at
        if name in BLOCK_ELEMENTS:
            self.flush()
            last = self.block_at[-1]
            if name in CLOSES_P and self.stack[last].name == "p":
                # an open paragraph ends, with the inline elements in it
                self.pop_to(last)
            top = self.stack[-1].name
            if any(name in kind and top in kind for kind in SIBLINGS):
                self.pop_to(len(self.stack) - 1)
        if name in VOID_ELEMENTS or attributes.endswith("/") and name not in BLOCK_ELEMENTS:
            return at
        if name in RAW_ELEMENTS and name != "head":
            end = None if name in self.endless else _END_OF[name].search(self.page, at)
            if end:
                return end.end()
            self.endless.add(name)
            return len(self.page) if name in RAW_TO_THE_END else at
        if name == "body" and self.where.get("head"):
            self.pop_to(self.where["head"][-1])
        self.push(name, attributes)
        return at

    def read(self) -> list[Block]:
        page, size, at = self.page, len(self.page), 0
        last = page.rfind(">")  # beyond it no tag ends
        while at < size:
            lt = page.find("<", at)
            if lt < 0:
                lt = size
            self.take(page[at:lt])
            at = lt
            if at == size:
                break
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = size if end < 0 else end + 3
                continue
            if page.startswith("<![CDATA[", at) and "]]>" not in self.endless:
                end = page.find("]]>", at)
                if end >= 0:
                    self.take(page[at + 9 : end])
                    at = end + 3
                    continue
                self.endless.add("]]>")
            if page.startswith(("<!", "<?"), at):
                end = page.find(">", at)
                at = size if end < 0 else end + 1
                continue
            tag = _NAME.match(page, at) if at < last else None
            if not tag:
                self.take("<")
                at += 1
                continue
            rest = _REST.match(page, tag.end())
            end = rest.end() if rest else page.find(">", tag.end()) + 1
            name, attributes = tag[2].lower(), page[tag.end() : end - 1]
            if tag[1]:
                self.close(name)
                at = end
            else:
                at = self.open(name, attributes, end)
        self.flush()
        return self.blocks


def read_blocks(page: str) -> list[Block]:
    """Blocks of a page in order."""
    return Reader(page).read()


def features(blocks: list[Block]) -> list[list[tuple[str, int]]]:
    """What the classifier sees of every block: binned values of its text, its element and its neighbours' texts."""
    plain, coarse = [], []
    for b in blocks:
        n, words = len(b.text), b.text.split()
        long, links = min(n.bit_length(), 11), 4 * b.linked // n
        low = sum(w.islower() for w in words)
        short = sum(len(w) < 4 for w in words)
        plain.append([
            ("length", long), ("links", links), ("ends", 1 if _ENDS.search(b.text, max(0, n - 8)) else 0), ("lower", 4 * low // len(words)),
            ("short", 4 * short // len(words)), ("element", ELEMENT_KINDS.get(b.name, 0)),
        ])
        coarse.append((0 if n < 40 else 1 if n < 160 else 2) + 3 * (links > 1))
    edge = [6]
    around = edge + coarse + edge
    return [f + [("before", around[i]), ("after", around[i + 2])] for i, f in enumerate(plain)]


def counts(page: str) -> Counter:
    """(feature, bin, label) of a page's blocks of which markup alone says what they are."""
    blocks, out = read_blocks(page), Counter()
    for b, seen in zip(blocks, features(blocks)):
        if b.bad < 0 or b.good >= FOR:
            out.update((*f, int(b.bad == 0)) for f in seen)
    return out


def fit(pages: DataFrame) -> Model:
    """Log-odds of every feature's bins, counted over the marked blocks of all pages.

    Counts fold in the tasks and on the map side; the driver gets one row per feature and bin, of which there are
    under a hundred whatever the input. Bins are drawn towards no evidence by ``ALPHA`` blocks, so few or no
    marked blocks give a model that says little or nothing.
    """

    def run(batches):
        for batch in batches:
            out = Counter()
            for page in batch.column("html").to_pylist():
                if page:
                    out.update(counts(page))
            keys = list(out)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([out[k] for k in keys], pa.int64())], names=["feature", "bin", "label", "n"])

    parts = pages.select(F.col("html").cast("string").alias("html")).mapInArrow(run, "feature string, bin int, label int, n long")
    seen = {(r.feature, r.bin, r.label): r.n for r in parts.groupBy("feature", "bin", "label").agg(F.sum("n").alias("n")).collect()}
    total = Counter()
    for (feature, _, label), n in seen.items():
        total[feature, label] += n
    model = {}
    for feature, kind, _ in seen:
        rate = []
        whole = sum(total[feature, x] for x in (0, 1))
        here = sum(seen.get((feature, kind, x), 0) for x in (0, 1)) / whole
        for label in (0, 1):
            rate.append((seen.get((feature, kind, label), 0) + ALPHA * here) / (total[feature, label] + ALPHA))
        model[feature, kind] = math.log(rate[1] / rate[0])
    return model


def costs(blocks: list[Block], model: Model) -> list[tuple[float, float]]:
    """Per block the cost of calling it boilerplate, and of calling it content."""
    out = []
    for b, seen in zip(blocks, features(blocks)):
        n = len(b.text)
        words = 0.5 + min(n, 400) / 800 - 1.6 * max(0.0, b.linked / n - 0.4) / 0.6 + TEMPER * sum(model.get(f, 0.0) for f in seen)
        score = max(-TEXT_LIMIT, min(TEXT_LIMIT, words)) + b.good + b.bad
        if _NOTICE.match(b.text):
            score -= FOR
        out.append((score, 0.0) if score > 0 else (0.0, -score))
    return out


def _apart(a: Place, b: Place) -> int:
    """Steps between two elements, as far as ``FAR``."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.above
        else:
            b = b.above
        steps += 1
    return steps


def edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges between neighbours in the page, and between followers under one parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            apart = _apart(blocks[i - 1].place, b.place)
            if apart < FAR:
                out.append((i - 1, i, NEXT if apart <= 2 else 1.2 / (1 + apart)))
        above = last.get(b.place.above, i - 1)
        if b.place.above is not None and above != i - 1:
            out.append((above, i, FOLLOWER))
        last[b.place.above] = i
    return out


def minimum_cut(source: list[float], sink: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut (of several, the one with the fewest nodes there).

    Nodes that a search without result has passed can get no flow any more, so no later search enters them.
    """
    n = len(source)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in links:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    spare = [a - b for a, b in zip(source, sink)]  # over 0: left from the source; below: left to the sink
    dry = [False] * n
    eps = 1e-9
    for t in range(n):
        while spare[t] < -eps and not dry[t]:
            # breadth-first search against the flow for a node with something left
            goes = {t: -1}
            queue = deque((t,))
            begin = -1
            while queue and begin < 0:
                v = queue.popleft()
                for w in near[v]:
                    if w not in goes and not dry[w] and near[w][v] > eps:
                        goes[w] = v
                        if spare[w] > eps:
                            begin = w
                            break
                        queue.append(w)
            if begin < 0:
                for v in goes:
                    dry[v] = True
                break
            flow, v = min(spare[begin], -spare[t]), begin
            while v != t:
                flow = min(flow, near[v][goes[v]])
                v = goes[v]
            spare[begin] -= flow
            spare[t] += flow
            v = begin
            while v != t:
                near[v][goes[v]] -= flow
                near[goes[v]][v] += flow
                v = goes[v]
    side = [x > eps for x in spare]
    queue = deque(i for i in range(n) if side[i])
    while queue:
        v = queue.popleft()
        for w, c in near[v].items():
            if c > eps and not side[w]:
                side[w] = True
                queue.append(w)
    return side


def main_text(page: str | None, model: Model | None = None) -> str:
    """Main text of one page; without a model the classifier knows length and links only."""
    found = read_blocks(page) if page else []
    if not found:
        return ""
    price = costs(found, model or {})
    side = minimum_cut([p[0] for p in price], [p[1] for p in price], edges(found))
    return "\n\n".join(b.text for b, kept in zip(found, side) if kept)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page, by ``model`` or one fitted on these pages."""
    model = fit(pages) if model is None else model

    def run(batches):
        for batch in batches:
            texts = [main_text(p, model) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")
