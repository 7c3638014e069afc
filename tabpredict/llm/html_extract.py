"""Main text of web pages by boosted trees over DOM nodes.

A tolerant parser turns each page into nodes; every block-level node, and every
node with a class, id or role, gets features: tag, attribute tokens, density of its
subtree, depth, and how it stands among its siblings. Gradient-boosted trees give
the log-odds that a node belongs to the main text. Decoding goes from the root: a
node is kept with its parent if its own log-odds, those of its best descendants and a
bonus for agreeing with the parent add up to more than nothing, so no kept node lies
in a dropped one.

Training needs no labels: a bounded sample of pages that mark their article is
used as it is and with menus, notices, forms, adverts, comments and the like, made of
the page's own words, put around and into the article, which gets other tags.
"""

from __future__ import annotations

import html as entities
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample (pages), made-up variants of each, trees and their depth.
FIT_PAGES, VARIANTS, TREES, TREE_DEPTH = 500, 3, 30, 4
#: Log-odds that count for a node because its parent is kept.
AGREE = 1.0

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")
#: Fixed values of HTML: elements without content, elements whose content is no text, elements that a trailing slash
#: closes (as all in them), block elements, and what stands in a select.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noscript".split())
FOREIGN = {"svg", "math"}
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button label option".split())
CHOICES = {"option", "button", "legend"}
#: An element that a new one of the key's tag closes, up to one of the stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, set())}
KINDS = [{"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"a"}, {"div"}, {"section"}, {"article"}, {"main"}, {"nav", "menu"},
         {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "label", "button", "legend", "option"}, {"table", "tbody", "tr", "td", "th", "thead", "tfoot"},
         {"ul", "ol", "dl"}, {"blockquote", "pre", "figure", "figcaption"}, {"body", "html"}]
KIND = {t: k for k, group in enumerate(KINDS) for t in group}
#: Stems of class, id and role tokens, by what they tell.
STEMS = [
    ("ad", "ads", "advert", "banner", "sponsor", "promo"), ("nav", "menu", "breadcrumb", "toc", "pager", "pagination", "tabs"),
    ("header", "masthead", "topbar", "logo"), ("footer", "copyright", "legal", "bottom"), ("sidebar", "side", "aside", "widget", "related", "recommend", "complementary"),
    ("comment", "comments", "reply", "replies", "disqus", "respond", "feedback"), ("cookie", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay"),
    ("share", "social", "follow", "subscribe", "newsletter", "login", "signup", "search", "form"),
    ("article", "content", "main", "post", "entry", "story", "text", "body", "page")]
N_OWN = len(KINDS) + 1 + len(STEMS) + 1              # of the node itself; then the same of its parent
N_FEATURES = 2 * N_OWN + 13


class Page:
    """Nodes of a page (parents before children) and its texts in order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.tokens, self.mark, self.unit = [-1], ["html"], [()], [None], [True]
        self.pieces: list[tuple[int, str]] = []          # (node, text); node -1: a border between blocks
        stack, at, end, head = [0], 0, len(source), 0
        opened: dict[int, int] = {}                      # templates that are not shown, with their first piece
        seen = set()                                     # which of select, svg and math the page holds
        for m in iter(lambda: TAG.search(source, at), None):
            if m.start() > at:
                self.pieces.append((stack[-1], source[at:m.start()]))
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                if name == "head":
                    head = 0
                if name in BLOCK:
                    self.pieces.append((-1, ""))
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        if stack[k] in opened:
                            self.pieces[opened[stack[k]]:] = [(-1, "")]
                        del stack[k:]
                        break
                continue
            attributes = m[3] or m[6] or ""
            foreign = name in FOREIGN or bool(seen & FOREIGN) and any(self.tag[k] in FOREIGN for k in stack)
            if foreign and attributes.rstrip().endswith("/"):
                continue
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else end
                continue
            if name == "br":
                self.pieces.append((stack[-1], " "))
            if name in VOID:
                if name == "hr":
                    self.pieces.append((-1, ""))
                continue
            if name in ("html", "head"):
                continue
            if name in BLOCK:
                self.pieces.append((-1, ""))
                # blocks end a drawing, a formula or a list of choices that was left open
                if foreign:
                    self._close(stack, FOREIGN, {"foreignobject", "annotation-xml", "desc"})
                if "select" in seen and name not in CHOICES:
                    self._close(stack, {"select"}, {"template"})
                self._close(stack, {"p"}, {"td", "th", "caption", "button", "table"} if name != "p" else {"td", "th", "caption", "button"})
                if name in CLOSES:
                    self._close(stack, *CLOSES[name])
            values, mark = [], None
            for a in ATTRIBUTE.finditer(attributes):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "data-y":
                    mark = int(value == "1")
                else:
                    values += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            self.parent.append(stack[-1])
            self.tag.append(name)
            self.tokens.append(tuple(values))
            self.mark.append(mark)
            self.unit.append(name in BLOCK or bool(values))
            stack.append(len(self.tag) - 1)
            if name == "select" or name in FOREIGN:
                seen.add(name)
            if name == "template" and "shadowroot" not in attributes.lower():
                opened[stack[-1]] = len(self.pieces)
        if at < end:
            self.pieces.append((stack[-1], source[at:]))

    def _close(self, stack: list[int], names: set[str], stops: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in names:
                del stack[k:]
                return
            if self.tag[stack[k]] in stops:
                return

    def features(self) -> np.ndarray:
        """A row for each node (only those of units count)."""
        n = len(self.tag)
        chars, links, words, marks, tags, blocks = ([0] * n for _ in range(6))
        in_link = [False] * n
        depth = [0] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
            depth[i] = depth[self.parent[i]] + 1
        for node, text in self.pieces:
            if node >= 0 and not text.isspace():
                size = len(text)
                chars[node] += size
                words[node] += text.count(" ") + 1
                marks[node] += text.count(".") + text.count(",")
                blocks[node] += 1
                if in_link[node]:
                    links[node] += size
        kids, same, index = [0] * n, {}, [0] * n
        for i in range(1, n):
            p = self.parent[i]
            index[i] = kids[p]
            kids[p] += 1
            same[p, self.tag[i]] = same.get((p, self.tag[i]), 0) + 1
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            words[p] += words[i]
            marks[p] += marks[i]
            blocks[p] += blocks[i]
            tags[p] += tags[i] + 1
        out = np.zeros((n, N_FEATURES))
        a, b = len(KINDS) + 1, 2 * N_OWN
        total = max(chars[0], 1)
        for i in range(n):
            out[i, KIND.get(self.tag[i], len(KINDS))] = 1
            for token in self.tokens[i]:
                for k, stems in enumerate(STEMS):
                    if token in stems:
                        out[i, a + k] = 1
            p = max(self.parent[i], 0)
            c = chars[i]
            out[i, N_OWN - 1] = len(self.tokens[i])
            out[i, N_OWN:b] = out[p, :N_OWN]
            out[i, b:] = (math.log1p(c), math.log1p(words[i]), links[i] / max(c, 1), c / (tags[i] + 1), c / max(blocks[i], 1), marks[i] / max(words[i], 1),
                          depth[i], index[i] / max(kids[p] - 1, 1), kids[p], same.get((p, self.tag[i]), 1) / max(kids[p], 1),
                          c / max(chars[p], 1), c / total, math.log1p(tags[i]))
        return out

    def labels(self) -> list[float | None]:
        """Training only: is more than half of a node's text in the marked article? None: no text."""
        n = len(self.tag)
        inside, own, good = [0] * n, [0] * n, [0] * n
        for i in range(n):
            inside[i] = inside[max(self.parent[i], 0)] if self.mark[i] is None else self.mark[i]
        for node, text in self.pieces:
            if node >= 0 and not text.isspace():
                own[node] += len(text)
                good[node] += len(text) * inside[node]
        for i in range(n - 1, 0, -1):
            own[self.parent[i]] += own[i]
            good[self.parent[i]] += good[i]
        return [None if not o else float(2 * g > o) for o, g in zip(own, good)]

    def text(self, odds: np.ndarray) -> str:
        """Decode from the units' log-odds and join the kept blocks."""
        n = len(self.tag)
        odds = np.clip(odds, -4, 4).tolist()
        gain = [odds[i] if self.unit[i] else 0.0 for i in range(n)]
        for i in range(n - 1, 0, -1):
            if gain[i] > 0:
                gain[self.parent[i]] += gain[i]
        keep = [True] * n
        for i in range(1, n):
            keep[i] = keep[self.parent[i]] and (not self.unit[i] or gain[i] + AGREE > 0)
        blocks, block = [], []
        for node, piece in [*self.pieces, (-1, "")]:
            if node >= 0:
                if keep[node]:
                    block.append(piece)
            elif block:
                text = SPACE.sub(" ", entities.unescape("".join(block))).strip()
                if text:
                    blocks.append(text)
                block = []
        return "\n\n".join(blocks)


# ------------------------------------------------------------- training

ARTICLE = re.compile(r"<(article|main)\b([^>]*)>(.*)</\1\s*>", re.S | re.I)
WRAPS = ["article", "main", "div class='content'", "div id='main-content'", "section class='post'", "div class='entry text'",
         "div class='article body'", "article class='story'", "div role='main'", "div"]


def variant(source: str, seed: int) -> str | None:
    """The page with its article marked; for seeds above 0 with made-up surroundings, and
    the article in another element. None without an article."""
    m = ARTICLE.search(source)
    if not m:
        return None
    rng = random.Random(seed * 1_000_003 + len(source))
    inner = m[3]
    if not seed:
        return source[:m.start()] + f"<{m[1]} data-y=1{m[2]}>{inner}</{m[1]}>" + source[m.end():]
    words = re.sub(r"<[^>]*>", " ", inner).split() or ["text"]

    def some(lo, hi):
        at = rng.randrange(len(words))
        return " ".join(words[at:at + rng.randint(lo, hi)]) or words[0]

    def links(n):
        return "".join(f"<li><a href='/{k}'>{some(1, 3)}</a></li>" for k in range(n))

    made = [
        lambda: f"<aside data-y=0 class='{rng.choice(['sidebar', 'widget', 'related', ''])}'><h3>{some(1, 3)}</h3><ul>{links(rng.randint(2, 6))}</ul><p>{some(4, 25)}</p></aside>",
        lambda: f"<div data-y=0 class='{rng.choice(['cookie-notice', 'consent banner', 'alert', 'popup notice'])}'><p>{some(6, 30)}</p><button>{some(1, 2)}</button></div>",
        lambda: f"<form data-y=0 class='{rng.choice(['search', 'newsletter', 'login', ''])}'><label>{some(1, 5)}</label><input name=q><button>{some(1, 2)}</button><p>{some(3, 15)}</p></form>",
        lambda: f"<{(e := rng.choice(['section', 'div']))} data-y=0 {rng.choice(['class=comments', 'id=comments', 'class=comment-list'])}><h2>{some(1, 3)}</h2>"
                + "".join(f"<div class='comment'><p>{some(5, 40)}</p></div>" for _ in range(rng.randint(1, 4))) + f"</{e}>",
        lambda: f"<div data-y=0 class='{rng.choice(['ad', 'ads', 'advert', 'sponsor promo', 'banner'])}'>{rng.choice(['', '<p>'])}{some(4, 30)}</div>",
        lambda: f"<div data-y=0 class='{rng.choice(['share', 'social', 'related', 'breadcrumb', 'menu'])}'><ul>{links(rng.randint(2, 6))}</ul></div>",
        lambda: f"<nav data-y=0><ul>{links(rng.randint(3, 8))}</ul></nav>",
    ]
    parts = re.split(r"(?=<p>)", inner)
    for _ in range(rng.randint(0, 2)):
        parts.insert(rng.randrange(1, len(parts) + 1), rng.choice(made)())
    wrap = rng.choice(WRAPS)
    out = f"<{wrap} data-y=1>{''.join(parts)}</{wrap.split()[0]}>"
    before = [f"<header data-y=0><h1>{some(1, 4)}</h1><p>{some(2, 12)}</p></header>"] if rng.random() < 0.6 else []
    before += [rng.choice(made)() for _ in range(rng.randint(0, 2))]
    after = [rng.choice(made)() for _ in range(rng.randint(0, 3))]
    if rng.random() < 0.4:
        after.append(f"<div data-y=0 class='{rng.choice(['footer', 'legal', 'bottom'])}'><p>{some(3, 20)}</p></div>")
    return source[:m.start()] + "".join(before) + out + "".join(after) + source[m.end():]


class Trees:
    """Boosted trees as arrays: feature, border, children (a leaf is its own child), value."""

    def __init__(self, model):
        feature, border, left, right, value, self.roots = [], [], [], [], [], []

        def add(node, weight):
            at = len(feature)
            leaf = node.getClass().getSimpleName() == "LeafNode"
            feature.append(0 if leaf else node.split().featureIndex())
            border.append(0.0 if leaf else node.split().threshold())
            value.append(weight * node.prediction())
            left.append(at)
            right.append(at)
            if not leaf:
                left[at], right[at] = add(node.leftChild(), weight), add(node.rightChild(), weight)
            return at

        for tree, weight in zip(model.trees, model.treeWeights):
            self.roots.append(add(tree._call_java("rootNode"), weight))
        self.feature, self.border = np.array(feature), np.array(border)
        self.left, self.right, self.value = np.array(left), np.array(right), np.array(value)
        self.depth = max(t.depth for t in model.trees)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.border[at], self.left[at], self.right[at])
            out += self.value[at]
        return 2 * out


def train_extractor(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", *, fit_pages: int = FIT_PAGES,
                    variants: int = VARIANTS) -> Trees | None:
    """Fit the trees on a bounded sample of pages that mark their article; None if there are none."""
    marked = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    n = marked.count()
    if not n:
        return None
    sample = marked.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < min(1.0, 2 * fit_pages / n) * 1_000_003).orderBy(F.xxhash64("id")).limit(fit_pages)

    def rows(batches):
        for batch in batches:
            for source in batch.column("html").to_pylist():
                for seed in range(variants + 1):
                    made = variant(source, seed)
                    if made is None:
                        continue
                    page = Page(made)
                    x, y = page.features(), page.labels()
                    own = [i for i in range(1, len(y)) if page.unit[i] and y[i] is not None]
                    yield pa.RecordBatch.from_arrays([pa.array(x[own].tolist(), pa.list_(pa.float64())), pa.array([y[i] for i in own], pa.float64())],
                                                     names=["x", "y"])

    data = sample.mapInArrow(rows, "x array<double>, y double").select(array_to_vector("x").alias("x"), "y").persist()
    try:
        if len(data.select("y").distinct().take(2)) < 2:
            return None
        model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=TREES, maxDepth=TREE_DEPTH, maxBins=64, stepSize=0.2, seed=7).fit(data)
    finally:
        data.unpersist()
    return Trees(model)


def extract(pages: DataFrame, trees: Trees | None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Main text of every row: page_id, url, text, n_chars (code points).

    White space inside a block is one space, blocks are joined by an empty line. A null or
    empty html, or a page without main text, gives an empty text. Without trees (no page
    marks its article) every node counts as kept. Broken markup is read as browsers do, as
    far as it goes. Repeated rows give equal texts. An empty table gives no rows."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                sources = batch.column("html").slice(lo, 64).to_pylist()
                parsed = [Page(s or "") for s in sources]
                x = [p.features() for p in parsed]
                odds = trees.odds(np.concatenate(x)) if trees is not None else np.ones(sum(map(len, x)))
                texts, at = [], 0
                for p, f in zip(parsed, x):
                    texts.append(p.text(odds[at:at + len(f)]))
                    at += len(f)
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(lo, 64), batch.column("url").slice(lo, 64), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
