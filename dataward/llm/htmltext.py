"""Main text of HTML pages: boosted trees over DOM nodes, decoded along the tree.

The model is fitted by Spark ML on a bounded sample: `SAMPLE_PAGES` pages of the table, of
at most `SAMPLE_HTML` characters, chosen by a hash of page_id. Their own mark-up labels
them (article or main without what is set apart in it), and their texts are dealt into
`LAYOUTS` further layouts with known main parts, so that pages without such mark-up are
covered as well. Every page of the table is then read whole, its nodes scored, and the
likeliest set of kept nodes chosen in which a kept node's ancestors are kept and a kept
container holds kept text.

Defined results. Null or empty html, or none that is main text: empty text. Broken mark-up
is read as browsers do as far as block structure goes; unclosed comments and scripts run to
the end. A line break element is white space. Repeated rows: each gets its result. Empty
table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataward.llm.dom import AGAINST, REMARKS, Nodes, Page
from dataward.llm.words import slices

SAMPLE_PAGES = 96
SAMPLE_HTML = 40_000
LAYOUTS = 320
TREES = 24
DEPTH = 5
_MARK = "\ue000"      # ends main text in a generated layout


class Layouts:
    """Pages of random layout around given texts; main text ends with a mark."""

    def __init__(self, long: list[str], short: list[str], seed: int = 11):
        self.random = random.Random(seed)
        # Texts for samples too small to give any
        self.long = long or ["A sentence of some length, as articles have them, with a comma. And another one follows."]
        self.short = short or ["Home", "About us", "Contact", "Read more"]

    def pick(self, *options):
        return self.random.choice(options)

    def some(self, low: int, high: int) -> range:
        return range(self.random.randint(low, high))

    def paragraph(self) -> str:
        return self.pick(*self.long)

    def sentence(self) -> str:
        text = self.paragraph()
        return text[:self.random.randint(15, 120)].rsplit(" ", 1)[0]

    def phrase(self) -> str:
        return " ".join(self.pick(*self.short).split()[:4])

    def attrs(self, *words: str) -> str:
        style = self.random.random()
        if style < 0.3:
            return self.pick("", f' class="{self.pick("c", "x", "col", "box", "row")}{self.random.randint(1, 99)}"')
        word = self.pick(*words)
        return self.pick(f' class="{word}"', f' id="{word}"', f' class="{word}-{self.pick("wrap", "box", "inner")} x"')

    def link(self) -> str:
        return f'<a href="/{self.random.randint(1, 999)}">{self.phrase()}</a>'

    def main(self, tag: str, text: str) -> str:
        cut = self.random.random()
        if cut < 0.15 and len(text) > 40:
            half = text.rfind(" ", 0, len(text) // 2) + 1
            text = self.pick(f"<b>{text[:half]}</b>{text[half:]}", f'{text[:half]}<a href="#">{text[half:]}</a>',
                             f"{text[:half]}<br>{text[half:]}", f"<b>{text}")
        return f"<{tag}>{text}{_MARK}" + (f"</{tag}>" if tag != "p" or self.random.random() < 0.8 else "")

    def article(self) -> str:
        body = self.pick("p", "p", "p", "div")
        parts = [self.main("h1", self.sentence())] if self.random.random() < 0.85 else []
        if self.random.random() < 0.15:
            parts.append(f"<div{self.attrs('byline', 'meta')}>{self.phrase()}</div>")
        for _ in self.some(1, 9):
            kind = self.random.random()
            if kind < 0.72:
                parts.append(self.main(body, self.paragraph()))
            elif kind < 0.8:
                parts.append(self.main(self.pick("h2", "h3"), self.sentence()))
            elif kind < 0.86:
                items = "".join(self.main("li", self.sentence()) for _ in self.some(2, 6))
                parts.append(f"<ul>{items}</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{self.main('p', self.paragraph())}</blockquote>")
            elif kind < 0.94:
                parts.append(self.main(body, self.sentence()))
            elif kind < 0.97:
                parts.append(self.boilerplate())
            else:
                cells = "".join(f"<tr>{self.main('td', self.phrase())}{self.main('td', self.sentence())}</tr>"
                                for _ in self.some(2, 4))
                parts.append(f"<table>{cells}</table>")
        return "".join(parts)

    def boilerplate(self) -> str:
        """An advert, notice, form, list of links, social bar or sidebar box."""
        kind = self.random.randrange(7)
        if kind == 0:
            text = "".join(f"<p>{self.pick(self.sentence(), self.paragraph())}</p>" for _ in self.some(1, 2))
            return f"<div{self.attrs('ad', 'advert', 'sponsored', 'promo', 'banner')}>{self.pick(self.sentence(), text)}</div>"
        if kind == 1:
            return (f"<div{self.attrs('cookie-notice', 'notice', 'consent', 'notification', 'alert', 'message')}>"
                    f"<p>{self.pick(self.sentence(), self.paragraph())}</p>{self.link()}</div>")
        if kind == 2:
            return (f"<form{self.attrs('newsletter', 'search', 'login', 'signup')}><p>{self.sentence()}</p>"
                    f"<label>{self.phrase()}</label><input><button>{self.phrase()}</button></form>")
        if kind == 3:
            return f"<div{self.attrs('related', 'recommended', 'links', 'teaser')}>{self.menu()}</div>"
        if kind == 4:
            return f"<div{self.attrs('share', 'social', 'tags')}>{' '.join(self.link() for _ in self.some(2, 5))}</div>"
        box = "".join(self.pick(f"<h3>{self.phrase()}</h3>", self.menu(), f"<p>{self.sentence()}</p>",
                                f"<p>{self.paragraph()}</p>", f"<div>{self.link()}</div>") for _ in self.some(1, 4))
        tag = self.pick("aside", "div")
        return f"<{tag}{self.attrs('sidebar', 'side', 'widget', 'promo')}>{box}</{tag}>"

    def menu(self) -> str:
        links = [self.link() for _ in self.some(2, 9)]
        return self.pick("<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", " | ".join(links),
                         "".join(f"<div>{x}</div>" for x in links))

    def remarks(self) -> str:
        each = "".join(
            f"<{t}{self.attrs('comment', 'reply', 'comment-body')}><b>{self.phrase()}</b>"
            f"<p>{self.pick(self.sentence(), self.paragraph())}</p>{self.pick('', self.link())}</{t}>"
            for t in [self.pick("div", "li", "article")] for _ in self.some(1, 5))
        word = self.pick("comments", "comments", "discussion", "respond", "replies")
        tag = self.pick("div", "section", "ol")
        return f'<{tag} {self.pick("class", "id")}="{word}">{self.pick("", f"<h3>{self.phrase()}</h3>")}{each}</{tag}>'

    def page(self) -> str:
        top = self.pick("header", "div")
        head = f"<{top}{self.attrs('header', 'masthead', 'top')}>{self.pick('', f'<h1>{self.phrase()}</h1>', f'<p>{self.sentence()}</p>')}" \
               f"{self.pick('', self.menu())}</{top}>" if self.random.random() < 0.6 else ""
        nav = self.pick("nav", "nav", "div")
        menu = f"<{nav}{self.attrs('nav', 'menu', 'navbar')}>{self.menu()}</{nav}>" if self.random.random() < 0.8 else ""
        content = self.article()
        late = self.remarks() if self.random.random() < 0.4 else ""
        inside = self.random.random() < 0.5
        content += late if inside else ""
        for _ in self.some(0, 2):
            tag = self.pick("article", "article", "main", "div", "section", "td")
            content = f"<{tag}{self.attrs('content', 'article', 'post', 'entry', 'story', 'body')}>{content}</{tag}>"
            content = f"<table><tr>{content}</tr></table>" if tag == "td" else content
        parts = [content] + ([] if inside else [late])
        parts = [self.boilerplate() for _ in self.some(0, 2)] + parts + [self.boilerplate() for _ in self.some(0, 3)]
        foot = self.pick("footer", "footer", "div")
        end = f"<{foot}{self.attrs('footer', 'foot', 'copyright')}>{self.pick('', '&copy; ')}" \
              f"{self.pick(self.sentence(), self.phrase(), self.paragraph(), self.menu())}</{foot}>" \
            if self.random.random() < 0.9 else ""
        body = f"{head}{menu}{''.join(parts)}{end}"
        if self.random.random() < 0.4:
            body = f"<div{self.attrs('wrapper', 'page', 'container')}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.phrase()}</title></head><body>{body}</body></html>"


_APART = {"nav", "aside", "footer", "header", "form", "menu", "dialog"}


def own_labels(page: Page) -> list[bool] | None:
    """Main leaves by the page's own mark-up; None if it has none."""
    if not {"article", "main"} & set(page.tag):
        return None
    inside, apart, out = [], [], []
    for tag, parent, tokens, text in zip(page.tag, page.parent, page.tokens, page.text):
        inside.append(tag in ("article", "main") or (parent >= 0 and inside[parent]))
        apart.append(tag in _APART or bool(tokens & (AGAINST | REMARKS)) or (parent >= 0 and apart[parent]))
        out.append(bool(text) and inside[-1] and not apart[-1])
    return out


def training_nodes(pages: list[str], layouts: int = LAYOUTS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of the given pages and of layouts with their texts."""
    read = [Page(p) for p in pages]
    labels = [own_labels(p) for p in read]
    long, short = [], []
    for page, own in zip(read, labels):
        for i, text in enumerate(page.text):
            if text:
                (long if (own[i] if own else len(text) > 80) else short).append(text.replace("<", " ").replace("&", " "))
    maker = Layouts([t for t in long if len(t) > 40], short)
    chosen = [(p, own) for p, own in zip(read, labels) if own]
    for _ in range(layouts):
        page = Page(maker.page())
        own = [t.endswith(_MARK) for t in page.text]
        page.text = [t.replace(_MARK, "") for t in page.text]
        chosen.append((page, own))
    nodes = Nodes([p for p, _ in chosen])
    keep = nodes.up(np.array([x for _, own in chosen for x in own], np.int64)) > 0
    inner = nodes.parent >= 0                          # a root says nothing
    return nodes.features()[inner], keep[inner]


class Forest:
    """The fitted trees as arrays; leaves point to themselves."""

    def __init__(self, model):
        self.trees = []
        for weight, tree in zip(model.treeWeights, model.trees):
            rows: list[list] = []
            self._walk(tree._call_java("rootNode"), rows)
            feature, threshold, left, right, value = (np.array(c) for c in zip(*rows))
            self.trees.append((feature, threshold, left, right, value * weight))
        self.depth = max(t.depth for t in model.trees)

    def _walk(self, node, rows: list[list]) -> int:
        at = len(rows)
        rows.append([0, 0.0, at, at, node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[at][:2] = [split.featureIndex(), split.threshold()]
            rows[at][2] = self._walk(node.leftChild(), rows)
            rows[at][3] = self._walk(node.rightChild(), rows)
        return at

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            out += value[at]
        return 2 * out


def decode(nodes: Nodes, odds: np.ndarray) -> np.ndarray:
    """The likeliest consistent choice: kept nodes have kept ancestors, and a container is kept
    only with some of its text. Bottom up the best gain of each subtree, top down the choice."""
    n = len(nodes.tag)
    gain = np.where(nodes.parent >= 0, odds, 0.0)
    leaf = np.array([bool(t) for t in nodes.text], bool) if n else np.zeros(0, bool)
    kept_below = np.zeros(n)
    some = leaf.copy()
    for level in nodes.levels[:0:-1]:
        gain[level] += kept_below[level]
        good = level[(gain[level] > 0) & some[level]]
        np.add.at(kept_below, nodes.parent[good], gain[good])
        some[nodes.parent[good]] = True
    keep = np.zeros(n, bool)
    for level in nodes.levels:
        if level is nodes.levels[0]:
            keep[level] = True
        else:
            keep[level] = keep[nodes.parent[level]] & (gain[level] > 0) & some[level]
    return keep & leaf


def main_texts(sources: list[str | None], forest: Forest) -> list[str]:
    pages = [Page(s or "") for s in sources]
    nodes = Nodes(pages)
    keep = decode(nodes, forest.log_odds(nodes.features()))
    out: list[list[str]] = [[] for _ in pages]
    for i in np.flatnonzero(keep).tolist():
        out[nodes.page[i]].append(nodes.text[i])
    return ["\n".join(t) for t in out]


def fit(spark: SparkSession, pages: DataFrame, n_pages: int = SAMPLE_PAGES) -> Forest:
    sample = (pages.filter(F.length("html") <= SAMPLE_HTML).select("page_id", "html")
              .orderBy(F.xxhash64("page_id"), "html").limit(n_pages).collect())  # n_pages * SAMPLE_HTML at most
    x, y = training_nodes([r["html"] for r in sample])
    rows = spark.createDataFrame(
        [(row, float(label)) for row, label in zip(x.tolist(), y)], "x array<double>, label double")
    data = rows.select(array_to_vector("x").alias("features"), "label").coalesce(2).cache()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5, maxBins=32,
                          minInstancesPerNode=8).fit(data)
    data.unpersist()
    return Forest(model)


def extract(pages: DataFrame, forest: Forest | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(forest or fit(pages.sparkSession, pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = main_texts(part.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(run, ", ".join([*kinds, "text string, n_chars bigint"]))
