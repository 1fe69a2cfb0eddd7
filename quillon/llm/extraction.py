"""Operator 11: the main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into blocks: runs of text between tags that begin or end a block, each with the elements around it. The
field gives each block one of two labels, article or not. Features of a block are the tags and the names (class, id,
role) of all elements around it, its innermost tags, whether the page has an article elsewhere, and its length,
links and punctuation; features of a step are how near the elements of two blocks stand and whether their regions differ. It is fitted on labelled
pages (:mod:`quillon.llm.labelled_pages`, or others marked alike; ``MAX_PAGES`` at most), by the gradient of the
likelihood, in one task; pages are decoded by Viterbi where they are read.
"""

from __future__ import annotations

import html as html_text
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.labelled_pages import compose

#: Labelled pages that the fit reads at most, and that are composed if none are given.
MAX_PAGES = 2_000
COMPOSED = 700
#: Elements that a worker remembers with what is around them.
CACHE = 100_000

# Fixed values of the HTML standard: elements that begin and end a block, have no end tag, or hold no markup.
BLOCK = frozenset(
    "html head body address article aside blockquote button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr label legend "
    "li link main menu meta nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame keygen".split())
RAW = frozenset("script style template textarea title xmp iframe noembed noframes svg math object canvas audio video".split())
REGION = frozenset("nav header footer aside form article main section dialog noscript address menu".split())
#: A start tag of the key ends an open element of the value, if none of the bounds is between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
IN_PARAGRAPH = BLOCK - frozenset("button label legend option optgroup select link meta noscript td th tr tbody thead tfoot caption col colgroup".split())
# End of the fixed values.

TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>\x00]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LABEL = "data-main"


class Element:
    """An open element: its features with those of all elements around it, and their summed weight."""

    __slots__ = ("tag", "parent", "around", "nearest", "value", "label", "inside", "children")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent, self.children = tag, parent, {}
        found, named = {f"t:{tag}"}, set()
        self.label = parent.label if parent else None
        for name, *said in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(said)
            if name in ("class", "id", "role", "itemprop"):
                names = [x.lower() for x in NAME.findall(value)]
                named.update(names, (f"{a}-{b}" for a, b in zip(names, names[1:])))
            elif name == "hidden" or (name == "style" and "none" in value) or (name == "aria-hidden" and value == "true"):
                found.add("hidden")
            elif name == LABEL:
                self.label = value == "1"
        self.around = (parent.around if parent else frozenset()) | found | {f"k:{x}" for x in named}
        # names of the innermost element that has any or is a region by its tag
        own = named | {f"<{tag}>"} if named or tag in REGION else None
        self.nearest = frozenset(f"n:{x}" for x in own) if own else parent.nearest if parent else frozenset()
        self.inside = frozenset(x for x in ("t:article", "t:main") if x in self.around)
        self.value: float | None = None

    def features(self) -> frozenset[str]:
        tags, at = [], self
        while at is not None and len(tags) < 3:
            tags.append(at.tag)
            at = at.parent
        return self.around | self.nearest | {f"p:{tags[0]}", "pp:" + ">".join(tags[:2]), "ppp:" + ">".join(tags)}


class Reader:
    """Blocks of pages. Elements are remembered by what they are and what is around them."""

    def __init__(self):
        self.root, self.known = Element("", "", None), 0

    def child(self, parent: Element, tag: str, attributes: str) -> Element:
        key = tag, attributes
        found = parent.children.get(key)
        if found is None:
            found = Element(tag, attributes, parent)
            if self.known < CACHE:
                parent.children[key] = found
                self.known += 1
        return found

    def blocks(self, page: str) -> list[tuple[str, Element, int]]:
        """(text, element, letters of the text that are in links) of each block with text."""
        at, out, said = self.root, [], []
        linked, in_link, pos = 0, False, 0

        def flush() -> None:
            nonlocal linked
            if said:
                text = " ".join("".join(said).split())
                if text:
                    out.append((text, at, linked))
                said.clear()
            linked = 0

        find, size = TAG.search, len(page)
        while pos < size:
            m = find(page, pos)
            end = m.start() if m else size
            if end > pos:
                piece = page[pos:end]
                if "&" in piece:
                    piece = html_text.unescape(piece)
                said.append(piece)
                if in_link:
                    linked += len(piece.strip())
            if m is None:
                break
            pos = m.end()
            name = m.group(2)
            if name is None:
                continue
            name, closes = name.lower(), m.group(1)
            if name in RAW:
                if not closes:
                    if name in ("textarea", "title", "iframe", "object"):
                        flush()
                    stop = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, pos)
                    pos = stop.end() if stop else size
                continue
            if name not in BLOCK:
                if name == "a":
                    in_link = not closes
                elif name in ("br", "img", "input"):
                    said.append(" ")
                continue
            flush()
            if name in VOID:
                continue
            if closes:
                open_ = at
                while open_ is not None and open_.tag != name:
                    open_ = open_.parent
                if open_ is not None and open_.parent is not None:
                    at = open_.parent
                continue
            if name in IN_PARAGRAPH and at.tag == "p":
                at = at.parent
            if name in ENDS:
                ends, bounds = ENDS[name]
                open_ = at
                while open_ is not None and open_.tag not in bounds:
                    if open_.tag in ends:
                        at = open_.parent
                    open_ = open_.parent
            elif name[0] == "h" and at.tag[:1] == "h" and len(name) == len(at.tag) == 2 and name[1].isdigit() and at.tag[1].isdigit():
                at = at.parent
            if name in ("p", "li"):
                in_link = False  # a link that was never closed
            at = self.child(at, name, m.group(3))
        flush()
        return out


def _bin(x: float, bounds: tuple[float, ...]) -> int:
    return sum(x >= b for b in bounds)


def text_key(text: str, linked: int) -> tuple[int, ...]:
    """Length, links, punctuation and signs of a block, in bins."""
    n = text.count(" ") + 1
    return (
        _bin(n, (2, 3, 5, 8, 12, 20, 40, 80)), _bin(linked / len(text), (0.01, 0.3, 0.7, 0.95)), int(text[-1] in ".!?…\"»”"), _bin(text.count(". ") + text.count(", "), (1, 3, 6)),
        int("©" in text or "®" in text), int("|" in text or "·" in text or "»" in text), int(text[0].isupper()), int(text[-1] == ":"),
    )


def text_features(key: tuple[int, ...]) -> list[str]:
    return [f"x{i}:{x}" for i, x in enumerate(key)] + [f"x01:{key[0]},{key[1]}", f"x02:{key[0]},{key[2]}"]


def word_features(text: str) -> list[str]:
    """Words of a short block."""
    return [f"w:{x}" for x in dict.fromkeys(text.lower().split())] if len(text) < 80 else []


def page_features(element: Element, titles: int, on_page: frozenset[str]) -> list[str]:
    """Whether the article is elsewhere, and how many titles came before."""
    return [f"titles:{min(titles, 2)}", *(f"out:{x}" for x in on_page - element.inside), *(f"near:{x}" for x in element.inside)]


def seen_titles(blocks: list[tuple[str, Element, int]]) -> list[int]:
    """Titles (h1) up to each block."""
    return np.cumsum([e.tag == "h1" for _, e, _ in blocks]).tolist()


def step_kind(before: Element, now: Element) -> int:
    """0: beside each other, 2: one around the other or its place, 4: apart; and 1 more if their regions differ."""
    if before is now:
        return 0
    differ = int(before.nearest != now.nearest)
    if before.parent is now.parent:
        return differ
    near = before.parent is now or now.parent is before or (before.parent is not None and before.parent.parent is now.parent) or (now.parent is not None and now.parent.parent is before.parent)
    return differ + (2 if near else 4)


def on_page(blocks: list[tuple[str, Element, int]]) -> frozenset[str]:
    return frozenset().union(*(e.inside for _, e, _ in blocks)) if blocks else frozenset()


KINDS = 6


def likelihood(node: np.ndarray, steps: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 (page, block), and of each pair of labels (page, block, before, now), by forward and backward sums."""
    n, t, _ = node.shape
    add = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    up, down = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    up[:, 0] = node[:, 0]
    for k in range(1, t):
        up[:, k] = add(up[:, k - 1][:, :, None] + moves[steps[:, k]], 1) + node[:, k]
    for k in range(t - 2, -1, -1):
        over = add(moves[steps[:, k + 1]] + (node[:, k + 1] + down[:, k + 1])[:, None, :], 2)
        down[:, k] = np.where(mask[:, k + 1, None], over, 0)
    both = up + down
    single = np.exp(both - add(both, 2)[:, :, None])[:, :, 1] * mask
    pairs = up[:, :-1, :, None] + moves[steps[:, 1:]] + (node[:, 1:] + down[:, 1:])[:, :, None, :]
    pairs = np.exp(pairs - add(add(pairs, 3), 2)[:, :, None, None]) * mask[:, 1:, None, None]
    return single, pairs


def fit(pages: Iterable[str], rounds: int = 150, rate: float = 0.1, shrink: float = 0.1) -> dict:
    """Weights of features and moves between labels, from pages whose elements are marked with ``LABEL``."""
    reader = Reader()
    rows = [b for b in map(reader.blocks, pages) if b]
    longest = max(map(len, rows), default=1)
    ids: dict[str, int] = {}
    feature, owner = [], []
    label, mask, steps = np.zeros((len(rows), longest)), np.zeros((len(rows), longest), bool), np.zeros((len(rows), longest), np.int64)
    for i, blocks in enumerate(rows):
        titles, flags = seen_titles(blocks), on_page(blocks)
        for k, (text, e, linked) in enumerate(blocks):
            label[i, k], mask[i, k] = bool(e.label), True
            steps[i, k] = step_kind(blocks[k - 1][1], e) if k else 0
            for f in {*e.features(), *text_features(text_key(text, linked)), *word_features(text), *page_features(e, titles[k], flags)}:
                feature.append(ids.setdefault(f, len(ids)))
                owner.append(i * longest + k)
    feature, owner = np.array(feature, np.int64), np.array(owner, np.int64)
    pages_with = np.bincount(np.unique(np.stack([feature, owner // longest]), axis=1)[0], minlength=len(ids)) if len(feature) else np.zeros(0)
    usual = pages_with >= 3  # what one or two pages hold says nothing of others
    keep = usual[feature] if len(feature) else np.zeros(0, bool)
    feature, owner = feature[keep], owner[keep]
    weights, moves = np.zeros(len(ids)), np.zeros((KINDS, 2, 2))
    told = np.bincount(feature, label.ravel()[owner], len(ids))
    one_hot = np.zeros((KINDS, 2, 2))
    np.add.at(one_hot, (steps[:, 1:][mask[:, 1:]], label[:, :-1][mask[:, 1:]].astype(int), label[:, 1:][mask[:, 1:]].astype(int)), 1)
    squares = [np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)]
    for turn in range(rounds if len(rows) else 0):
        node = np.zeros((len(rows), longest, 2))
        node[:, :, 1] = np.bincount(owner, weights[feature], len(rows) * longest).reshape(len(rows), longest)
        single, pairs = likelihood(node, steps, mask, moves)
        seen = np.zeros_like(moves)
        np.add.at(seen, steps[:, 1:].ravel(), pairs.reshape(-1, 2, 2))
        slopes = [told - np.bincount(feature, single.ravel()[owner], len(ids)) - shrink * weights, one_hot - seen - shrink * moves]
        for x, slope, total in zip((weights, moves), slopes, squares):
            total += slope**2
            x += rate * 3 * slope / np.sqrt(total)
    names = np.array(list(ids))[weights != 0].tolist()
    return {"weights": dict(zip(names, weights[weights != 0].tolist())), "moves": moves.tolist()}


class Extractor:
    """The fitted field of a worker."""

    def __init__(self, model: dict):
        self.weights, self.reader = model["weights"], Reader()
        self.moves = [[[float(x) for x in row] for row in kind] for kind in model["moves"]]
        self.by_key: dict[tuple[int, ...], float] = {}

    def of(self, features: Iterable[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def node(self, text: str, element: Element, linked: int, titles: int, flags: frozenset[str]) -> float:
        """What speaks for label 1 in one block."""
        if element.value is None:
            element.value = self.of(element.features())
        key = (*text_key(text, linked), min(titles, 2))
        value = self.by_key.get(key)
        if value is None:
            value = self.by_key[key] = self.of(text_features(key[:-1]))
        value += element.value + self.of(page_features(element, titles, flags))
        return value + self.of(word_features(text)) if len(text) < 80 else value

    def labels(self, blocks: list[tuple[str, Element, int]]) -> list[bool]:
        """The likeliest labels of a page, by Viterbi."""
        if not blocks:
            return []
        titles, flags = seen_titles(blocks), on_page(blocks)
        best, back = (0.0, self.node(*blocks[0], titles[0], flags)), []
        for k in range(1, len(blocks)):
            (off_off, off_on), (on_off, on_on) = self.moves[step_kind(blocks[k - 1][1], blocks[k][1])]
            off, on = best
            to_off, to_on = (off + off_off, on + on_off), (off + off_on, on + on_on)
            back.append((to_off[1] > to_off[0], to_on[1] > to_on[0]))
            best = max(to_off), max(to_on) + self.node(*blocks[k], titles[k], flags)
        now = best[1] > best[0]
        out = [now]
        for from_on in reversed(back):
            now = from_on[now]
            out.append(now)
        return out[::-1]

    def text(self, page: str | None) -> str:
        blocks = self.reader.blocks(page or "")
        return "\n".join(b[0] for b, main in zip(blocks, self.labels(blocks)) if main)


def composed_pages(spark: SparkSession, n: int = COMPOSED, seed: int = 0) -> DataFrame:
    return spark.createDataFrame([(x,) for x in compose(n, seed)], "html string")


def fit_model(labelled: DataFrame, max_pages: int = MAX_PAGES) -> bytes:
    """The model, of fixed size, from at most ``max_pages`` marked pages, fitted in one task."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = sorted(x for b in batches for x in b.column("html").to_pylist() if x)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(fit(pages)).encode()], pa.binary())], names=["model"])

    sample = labelled.select(F.col("html").cast("string")).orderBy(F.xxhash64("html")).limit(max_pages)
    held = sample.repartition(1).mapInArrow(learn, "model binary").first()
    return held[0] if held else json.dumps(fit([])).encode()


def extract(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Operator 11: page_id, url, text and n_chars (code points of text) for each row of ``pages`` (page_id, url, html).

    ``labelled``: pages (html) whose elements are marked by ``data-main`` as in :mod:`quillon.llm.labelled_pages`; None:
    composed ones. Text is that of all blocks that the field takes for the article, character references decoded, white
    space made one space, blocks joined by a line end. Null and empty pages, and those without a block of the
    article, have an empty text. Repeated rows are read alike; an empty table gives an empty table; other columns are ignored.
    """
    model = fit_model(labelled if labelled is not None else composed_pages(pages.sparkSession))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(json.loads(model))
        for batch in batches:
            texts = [extractor.text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(read, "page_id long, url string, text string, n_chars long")
