"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags. A block's
features are its ancestors' tags, the words of their classes and ids, the nearest
sectioning element, and what its text looks like. The field has two labels, text of
the article and anything else, with weights for each feature and for neighbouring
labels; it is trained on labelled pages and decoded by Viterbi.

Training takes ``TRAIN_PAGES`` labelled pages of ``labelled_pages`` (a fixed bound)
on the driver; only its weights, one for each feature seen there, are broadcast.

Defined results: null or empty html has the empty text. Scripts, styles, comments and
titles are markup, not blocks. White space is what Unicode calls so. A page that ends
inside a tag, a comment, a script or a style loses that unfinished part; of any other
element whose content is left out, such as svg or object, the tag alone goes where it is
closed by itself or never closed. A quote counts in a tag only after an equals sign; a tag
whose quote never ends goes as far as its first ``>``. Null page_ids, urls and repeated
rows are passed on; an empty table gives no rows; extra columns are ignored. Pages are
read whole, in a time that grows with their length, however deep they are nested.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.labelled_pages import Page

TRAIN_PAGES, ITERATIONS, RIDGE = 1000, 160, 3e-5
#: Elements whose content is no text of the page; of the first ones, also where the page ends before they do.
CODE = frozenset("script style".split())
RAW = CODE | frozenset("noscript template title svg iframe object canvas xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr input br".split())
#: Elements that an opening tag of the same group closes, up to the nearest element of the fence.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SECTIONS = frozenset("article main nav aside footer header form section body".split())
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+"""
#: A comment; a tag, by the quotes of its attributes or, where one never ends, up to the first ``>``; other markup; what a page ends in.
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<own>(?:(?=[\s/>]){_ATTRIBUTES}(?=>))|[^>]*+)>|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|</?[a-zA-Z][^>]*+\Z", re.S)
NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+|[A-Z]+[a-z]*")


class Block(NamedTuple):
    text: str
    place: Place
    link_chars: int


class Place:
    """An open element with what its blocks inherit; where it adds nothing, the sets are its parent's own."""

    __slots__ = ("tag", "tags", "names", "named", "own", "near", "parent", "fence")

    def __init__(self, tag: str, attributes: str, above: Place | None, depth: int, known: frozenset[str] | None) -> None:
        found = _names(attributes) if attributes else frozenset()
        names = found if known is None else found & known
        tags, all_names = (above.tags, above.names) if above else (frozenset(), frozenset())
        self.tag = tag
        self.tags = tags if tag in tags or not tag else tags | {tag}
        self.names = all_names if names <= all_names else all_names | names
        self.named = bool(found) or above is not None and above.named
        self.own = names if found or above is None else above.own  # the names of the nearest element that has some
        self.near = tag if tag in SECTIONS else above.near if above else "none"
        self.parent = tag if tag and tag not in INLINE else above.parent if above else "none"
        self.fence = depth if tag not in INLINE else above.fence if above else -1  # where the nearest element is that isn't inline


@functools.lru_cache(4096)
def _names(attributes: str) -> frozenset[str]:
    """Lower-case words of the classes and ids in a tag's attributes."""
    found = " ".join(x for m in NAME.findall(attributes) for x in m)
    return frozenset(w.lower() for w in WORD.findall(found))


class Tree:
    """The open elements of a page, and where those of each tag are among them."""

    def __init__(self, known: frozenset[str] | None) -> None:
        self.known, self.stack, self.at = known, [Place("", "", None, -1, known)], {}

    def top(self) -> Place:
        return self.stack[-1]

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of some tags, 0 where there is none."""
        return max((at[-1] for t in tags if (at := self.at.get(t))), default=0)

    def open(self, tag: str, attributes: str) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Place(tag, attributes, self.top(), len(self.stack), self.known))

    def cut(self, depth: int) -> None:
        """Close the elements from a place on."""
        for place in self.stack[depth:]:
            self.at[place.tag].pop()
        del self.stack[depth:]

    def close(self, tag: str) -> None:
        depth = self.last([tag])
        if depth and (tag not in INLINE or depth > self.top().fence):
            self.cut(depth)


def leaf_blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in order, those without text left out; of the names, only the ``known`` ones if given."""
    out: list[Block] = []
    tree, parts = Tree(known), []
    links, at = 0, 0
    never: set[str] = set()  # elements that aren't closed in what is left

    def flush() -> None:
        nonlocal links
        if parts and (text := " ".join("".join(parts).split())):
            out.append(Block(text, tree.top(), links))
        parts.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if tree.at.get("a"):
            links += len(text)

    while m := TOKEN.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag, attributes = m["tag"].lower(), m["own"]
        if tag in RAW and not m["end"]:
            if tag not in CODE and attributes.endswith("/"):
                continue
            if tag not in never and (closed := _closing(tag).search(page, at)):
                at = closed.end()
            elif tag in CODE:
                at = len(page)
            else:
                never.add(tag)
            continue
        if tag in RAW:
            continue
        if tag not in INLINE:
            flush()
        elif tag in ("br", "img", "input"):
            parts.append(" ")
        if m["end"]:
            tree.close(tag)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and (depth := tree.last(["p"])):
            tree.cut(depth)
        if tag in CLOSES:
            group, fence = CLOSES[tag]
            while (depth := tree.last(group)) > tree.last(fence):
                tree.cut(depth)
        if not attributes.endswith("/"):
            tree.open(tag, attributes)
    if at < len(page):
        say(page[at:])
    flush()
    return out


@functools.cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


def block_features(block: Block, i: int, n: int) -> list[str]:
    text, place = block.text, block.place
    size, words = len(text), text.count(" ") + 1
    near, parent = place.near, place.parent
    out = [f"tag:{t}" for t in place.tags]
    out += [f"name:{w}" for w in place.names]
    out += [f"own:{w}" for w in place.own]
    out += [f"near:{near}", f"parent:{parent}", f"near+parent:{near}+{parent}"]
    out += ["bias", f"size:{size.bit_length()}", f"words:{words.bit_length()}", f"links:{min(4, 5 * block.link_chars // size)}"]
    out.append(f"end:{text[-1] if text[-1] in '.!?,:;' else 'none'}")
    if not place.named:
        out.append("nameless")
    if "©" in text or text[:9] == "Copyright":
        out.append("copyright")
    out.append("first" if i == 0 else "last" if i == n - 1 else "between")
    return out


class Model(NamedTuple):
    index: dict[str, int]
    unary: np.ndarray  # features: score of label 1 against label 0
    edge: np.ndarray  # 2 x 2: from a label to the next

    def names(self) -> frozenset[str]:
        """The names that have a weight."""
        return frozenset(x.partition(":")[2] for x in self.index if x.startswith(("name:", "own:")))


def _scores(model: Model, features: list[list[str]]) -> list[float]:
    get, w = model.index.get, model.unary
    return [float(w[[k for x in f if (k := get(x)) is not None]].sum()) for f in features]


def viterbi(scores: list[float], edge: np.ndarray) -> list[int]:
    """The best labels for label-1 scores (label 0 has score 0)."""
    if not scores:
        return []
    (e00, e01), (e10, e11) = edge.tolist()
    a, b, back = 0.0, scores[0], []
    for s in scores[1:]:
        from0, from1 = (a + e00 >= b + e10), (a + e01 >= b + e11)
        back.append((0 if from0 else 1, 0 if from1 else 1))
        a, b = (a + e00 if from0 else b + e10), s + (a + e01 if from1 else b + e11)
    out = [1 if b > a else 0]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], iterations: int = ITERATIONS) -> Model:
    """Maximum likelihood with a ridge, by Adam on all pages at once: forward-backward over padded sequences."""
    index: dict[str, int] = {}
    n, longest = len(pages), max(len(y) for _, y in pages)
    feats, owner, label, mask = [], [], np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for p, (features, y) in enumerate(pages):
        label[p, : len(y)], mask[p, : len(y)] = y, True
        for t, f in enumerate(features):
            for x in f:
                feats.append(index.setdefault(x, len(index)))
                owner.append(p * longest + t)
    feats, owner = np.array(feats), np.array(owner)
    m = len(index)
    theta, mean, square = np.zeros(m + 4), np.zeros(m + 4), np.zeros(m + 4)
    blocks = mask.sum()
    pair = mask[:, 1:]
    observed = np.zeros((2, 2))
    np.add.at(observed, (label[:, :-1][pair], label[:, 1:][pair]), 1)
    for step in range(1, iterations + 1):
        w, edge = theta[:m], theta[m:].reshape(2, 2)
        one = np.bincount(owner, w[feats], n * longest).reshape(n, longest)
        score = np.stack([np.zeros_like(one), one], axis=2)
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = score[:, 0]
        for t in range(1, longest):
            moved = np.logaddexp(alpha[:, t - 1, 0, None] + edge[0], alpha[:, t - 1, 1, None] + edge[1]) + score[:, t]
            alpha[:, t] = np.where(mask[:, t, None], moved, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = score[:, t + 1] + beta[:, t + 1]
            moved = np.logaddexp(ahead[:, 0, None] + edge[:, 0], ahead[:, 1, None] + edge[:, 1])
            beta[:, t] = np.where(mask[:, t + 1, None], moved, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p1 = np.exp(np.minimum(0, alpha[:, :, 1] + beta[:, :, 1] - z[:, None]))
        both = np.exp(np.minimum(0, alpha[:, :-1, :, None] + edge + (score + beta)[:, 1:, None, :] - z[:, None, None, None]))
        gradient = np.concatenate([np.bincount(feats, np.where(mask, label - p1, 0).ravel()[owner], m), (observed - both[pair].sum(axis=0)).ravel()]) / blocks - RIDGE * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta + 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(index, theta[:m], theta[m:].reshape(2, 2))


def labelled(seed: int) -> tuple[list[list[str]], list[int]]:
    """Features and labels of one generated page: a block has the label of the piece that its text comes from."""
    pieces, marked = Page(seed).build(), []
    for k, (piece, y) in enumerate(pieces):
        # a mark of private-use characters before each stretch of text tells which piece a block is from
        marked.append(piece if y is None else re.sub(r"(^|>)(?=[^<]*[^<\s])", lambda m, k=k: f"{m[1]}{k}", piece))
    blocks, features, y = leaf_blocks("".join(marked)), [], []
    clean = [(b._replace(text=" ".join(re.sub("\\d+", "", b.text).split()), link_chars=max(0, b.link_chars - 4)), re.search("(\\d+)", b.text)) for b in blocks]
    clean = [(b, m) for b, m in clean if b.text and m]
    for i, (b, m) in enumerate(clean):
        features.append(block_features(b, i, len(clean)))
        y.append(pieces[int(m[1])][1])
    return features, y


@functools.cache
def default_model(pages: int = TRAIN_PAGES) -> Model:
    return train([x for seed in range(pages) if (x := labelled(seed))[1]])


def main_text(page: str | None, model: Model, known: frozenset[str] | None = None) -> str:
    blocks = leaf_blocks(page, model.names() if known is None else known) if page else []
    labels = viterbi(_scores(model, [block_features(b, i, len(blocks)) for i, b in enumerate(blocks)]), model.edge)
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text of every row of ``pages`` (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, shared.value.names()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(x, own, known) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string")


def op9_html_crf(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
