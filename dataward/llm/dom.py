"""Block trees of HTML pages and the features of their nodes."""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np

_TAG = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)"
    r"|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z))",
    re.DOTALL)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

# Element classes of HTML
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noframes", "noembed"}
_RAW_END = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in RAW}
HIDDEN = {"head", "select", "option", "button", "datalist", "object", "canvas", "audio", "video", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
            "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
            "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}}
SCOPES = {"table", "td", "th", "ul", "ol", "dl", "body", "html", "article", "section", "main", "div", "aside", "nav"}
TABLE_SCOPES, LIST_SCOPES = {"table"}, {"ul", "ol", "dl", "table", "menu"}      # beyond which nothing is ended
KINDS = [{"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dd", "dt"},
         {"td", "th", "tr", "table", "tbody"}, {"div", "section"}, {"article", "main"}, {"nav", "menu"},
         {"header", "hgroup"}, {"footer", "address"}, {"aside", "dialog"}, {"form", "fieldset", "legend"},
         {"ul", "ol", "dl"}, {"#text"}]
# Words in class, id and role that speak for and against main text
FOR = set("article body content entry main post prose story text hentry page richtext".split())
AGAINST = set("ad ads advert advertisement advertising adv banner breadcrumb breadcrumbs byline cookie cookies "
              "consent copyright dialog disclaimer footer foot form gdpr head header legal links login masthead menu "
              "message meta modal nav navbar navigation newsletter notice notification pagination popup promo "
              "promotion related recommended share sharing side sidebar signup social sponsor sponsored subscribe "
              "tags teaser toolbar top widget alert search register contentinfo complementary".split())
REMARKS = set("comment comments commentlist reply replies respond discussion disqus remark remarks feedback "
              "responses reader readers".split())


class Page:
    """Block nodes in page order. Every stretch of text in a block that also holds blocks is a
    node of its own (`#text`), so text belongs to leaves only."""

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens, self.text = ["#root"], [-1], [frozenset()], [""]
        self.links, self.marks = [0], [0]
        self._read(source)
        self._finish()

    def _open(self, tag: str, parent: int, tokens: frozenset) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.tokens.append(tokens)
        self.text.append("")
        self.links.append(0)
        self.marks.append(0)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]      # open elements with their block node
        # depths at which a name is open, and those of all blocks: stray tags search no stack
        where: defaultdict[str, list[int]] = defaultdict(list)
        blocks = [0]
        pieces: list[str] = []
        linked = anchors = hidden = 0
        at = 0
        self.has_blocks = [False]

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
                pieces.clear()
                if text:
                    node = self._open("#text", stack[-1][1], frozenset())
                    self.text[node], self.links[node] = text, min(linked, len(text))
            linked = 0

        def leave(depth: int) -> None:
            nonlocal anchors, hidden
            while len(stack) > depth:
                name, _ = stack[-1]
                if name == "a":
                    anchors -= 1
                elif name in HIDDEN:
                    hidden -= 1
                if name not in INLINE:
                    flush()
                    blocks.pop()
                where[name].pop()
                stack.pop()

        def enter(name: str, node: int) -> None:
            where[name].append(len(stack))
            if name not in INLINE:
                blocks.append(len(stack))
            stack.append((name, node))

        def innermost(names: set) -> int:
            return max((where[n][-1] for n in names if where[n]), default=0)

        def within(names: set, scopes: set) -> int:
            """Depth of the innermost open element of these names, up to the nearest scope."""
            depth = innermost(names)
            return depth if depth and depth >= innermost(scopes) else 0

        while at < len(source):
            m = _TAG.search(source, at)
            end = m.start() if m else len(source)
            if end > at and not hidden:
                pieces.append(source[at:end])
                if anchors:
                    linked += end - at
            if not m:
                break
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            if m["close"]:
                depth = where[name][-1] if where[name] else 0
                if depth and (name not in INLINE or depth > blocks[-1]):
                    leave(depth)
                continue
            self.marks[stack[-1][1]] += 1
            if name == "br":
                pieces.append(" ")
            if name in RAW:
                stop = _RAW_END[name].search(source, at)
                if not stop:
                    at = len(source)
                else:
                    close = source.find(">", stop.start())
                    at = len(source) if close < 0 else close + 1
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            if name in CLOSES_P and (depth := within({"p"}, SCOPES)):
                leave(depth)
            if name in ENDED_BY:
                scopes = TABLE_SCOPES if name in ("tr", "td", "th", "tbody") else LIST_SCOPES
                while depth := within(ENDED_BY[name], scopes):
                    leave(depth)
            if name == "body" or name == "html":
                hidden = 0
            if name in INLINE:
                anchors += name == "a"
                enter(name, stack[-1][1])
                continue
            flush()
            hidden += name in HIDDEN
            words = frozenset(_TOKEN.findall(" ".join(
                (a or b or c) for key, a, b, c in _ATTR.findall(m["attrs"]) if key.lower() in ("class", "id", "role")
            ).lower())) if m["attrs"] else frozenset()
            enter(name, self._open(name, stack[-1][1], words))
        leave(1)
        flush()

    def _finish(self) -> None:
        """Merges a block's only stretch of text into it and drops blocks without text."""
        n = len(self.tag)
        kids: list[list[int]] = [[] for _ in range(n)]
        filled = [bool(t) for t in self.text]
        for i in range(n - 1, 0, -1):
            if filled[i]:
                filled[self.parent[i]] = True
        for i in range(1, n):
            if filled[i]:
                kids[self.parent[i]].append(i)
        keep = [filled[i] or i == 0 for i in range(n)]
        for i in range(1, n):
            if len(kids[i]) == 1 and self.tag[only := kids[i][0]] == "#text":
                self.text[i], self.links[i], keep[only] = self.text[only], self.links[only], False
        number = np.cumsum(keep) - 1
        picked = [i for i in range(n) if keep[i]]
        self.tag, self.tokens, self.text, self.links, self.marks = (
            [old[i] for i in picked] for old in (self.tag, self.tokens, self.text, self.links, self.marks))
        self.parent = [int(number[self.parent[i]]) if i else -1 for i in picked]


_KIND = {tag: k for k, tags in enumerate(KINDS) for tag in tags}
_BOXES = ({"article", "main"}, {"nav", "aside", "footer", "header", "menu", "dialog"}, {"form", "fieldset"})
FEATURES = len(KINDS) + 27


class Nodes:
    """All nodes of some pages, one after the other; `parent` is -1 at a page's root."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tag) for p in pages], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.page = np.repeat(np.arange(len(pages)), sizes)
        self.tag = [t for p in pages for t in p.tag]
        self.text = [t for p in pages for t in p.text]
        self.parent = np.array([i + b if i >= 0 else -1 for p, b in zip(pages, self.first.tolist())
                                for i in p.parent], np.int64)
        depth = [-1] * len(self.tag)
        for i, p in enumerate(self.parent.tolist()):
            depth[i] = depth[p] + 1 if p >= 0 else 0
        self.depth = np.array(depth, np.int64)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(self.depth))[:-1]) if depth else []
        self.pages = pages

    def up(self, values: np.ndarray, how=np.add) -> np.ndarray:
        """Values gathered over each subtree."""
        values = values.copy()
        for level in self.levels[:0:-1]:
            how.at(values, self.parent[level], values[level])
        return values

    def down(self, values: np.ndarray, how=np.add) -> np.ndarray:
        """Values gathered over each node's ancestors, without its own."""
        out = np.zeros_like(values)
        for level in self.levels[1:]:
            p = self.parent[level]
            out[level] = how(out[p], values[p])
        return out

    def features(self) -> np.ndarray:
        """One row per node: its kind, text, subtree density, attribute words, depth, siblings and
        the same of its ancestors."""
        n, pages = len(self.tag), self.pages
        kind = np.array([_KIND.get(t, -1) for t in self.tag], np.int64)
        chars = np.array([len(t) for t in self.text], np.int64)
        start = np.cumsum(chars) - chars
        start -= start[self.first[self.page]] if n else 0
        words = np.array([t.count(" ") + 1 if t else 0 for t in self.text], np.int64)
        points = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in self.text], np.int64)
        leaves = (chars > 0).astype(np.int64)
        links, marks = (np.array([x for p in pages for x in getattr(p, c)], np.int64) for c in ("links", "marks"))
        longest = self.up(chars, np.maximum)
        chars, links, marks, words, points, leaves, paragraphs = map(
            self.up, (chars, links, marks, words, points, leaves, (kind == 0).astype(np.int64)))
        own = np.array([(len(t & FOR), len(t & AGAINST), len(t & REMARKS)) if t else (0, 0, 0)
                        for p in pages for t in p.tokens], np.int64).reshape(n, 3)
        inside = np.stack([np.array([t in box for t in self.tag], np.int64) for box in _BOXES], axis=1) \
            if n else np.zeros((0, 3), np.int64)
        above, inside = self.down(own), self.down(inside, np.maximum)
        # siblings: nodes ordered by parent; a root is its own family
        family = np.where(self.parent >= 0, self.parent, -1 - self.page)
        order = np.lexsort((np.arange(n), family))
        new = np.ones(n, bool)
        new[1:] = family[order][1:] != family[order][:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        count = np.diff(np.append(np.flatnonzero(new), n))
        place, siblings = np.empty(n), np.empty(n)
        place[order] = np.arange(n) - head
        siblings[order] = np.repeat(count, count)
        before, after, same = np.zeros(n), np.zeros(n), np.zeros(n)
        inner = np.flatnonzero(~new)
        before[order[inner]] = chars[order[inner - 1]]
        after[order[inner - 1]] = chars[order[inner]]
        _, which, many = np.unique(family * 64 + kind, return_inverse=True, return_counts=True)
        same = many[which]
        kids = np.bincount(self.parent[self.parent >= 0], minlength=n)
        c, total = np.maximum(chars, 1), np.maximum(chars[self.first[self.page]], 1) if n else chars
        log = np.log1p
        columns = [log(chars), links / c, log(words), points / np.maximum(words, 1), chars / total, 100 * marks / c,
                   kids, log(paragraphs), log(leaves), log(c / np.maximum(leaves, 1)), log(longest), self.depth,
                   place / np.maximum(siblings, 1), log(siblings), log(before), log(after), log(same), start / total]
        one_hot = (kind[:, None] == np.arange(len(KINDS))[None, :])
        return np.concatenate([one_hot, np.stack(columns, axis=1), own, above, inside], axis=1).astype(np.float64)
