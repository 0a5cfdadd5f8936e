"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

Every page is parsed into a tree; comments, scripts, styles and other raw text never enter it. Controls (buttons,
options, drawings, objects) are nodes that are never content, with all below them if their end tag stands; if it
does not, only with the text and inline markup directly in them, so a missing end tag costs no blocks. Formulas
follow what they stand in. Boosted trees
(Spark ML) give each element the probability that it is main content, from its tag, the words in its
class and id, text and link density of its subtree, depth, position, and statistics of its siblings. Labels of
whole subtrees then come from a dynamic program over the tree: a node is content with all below it, boilerplate
with all below it, or mixed with its children free. The likeliest consistent choice wins, so no content sits
in boilerplate and no boilerplate in content unless a mixed ancestor allows it.

The trees are fitted on a bounded sample of pages (``sample``, by hash of the id). Pages whose markup names
the article are their own examples, and their texts are set again into layouts of plain ``div`` elements with
menus, side columns, notices, forms, adverts and comments around and inside, so that the trees learn from
attributes and density and not from a few tags.

Null or empty html gives an empty text. Broken markup is closed at the end of the page. Repeated pages are
extracted each. Text nodes of a block are joined, white space becomes one space, blocks follow in page order.
If the sample has no page with an article, only the layouts' examples are used, built from its paragraphs or, without
any, from all its blocks; without any text, from placeholder words.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 150
TREES = 20
DEPTH = 4
MIXED = -0.2
LONGEST = 200_000
GROUP = 256

# Tag names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
CONTROLS = frozenset("svg select option button object canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var".split())
CLOSES = {  # an open element of the second set ends when the first opens
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "button": {"button"},
}
SCOPE = frozenset("ul ol dl table div article section main aside nav header footer form body html blockquote td th li dd".split())

GOOD = frozenset("article content entry main post story text body page hentry prose blog news".split())
BAD = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie consent disqus footer form header "
    "legal login menu meta modal nav navbar navigation newsletter notice pagination popup promo promoted recommended related "
    "reply replies respond share sharing shop side sidebar signup social sponsor sponsored subscribe tags toolbar topbar "
    "tracking widget alert masthead copyright".split()
)
GOOD_TAGS = frozenset(("article", "main"))
BAD_TAGS = frozenset(("nav", "footer", "aside", "form", "header"))
SEMANTIC = ("article", "main", "nav", "header", "footer", "aside", "form", "p", "h", "li", "a", "div", "section", "body")

SEMANTIC_AT = {tag: i for i, tag in enumerate(SEMANTIC)}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
MARK = re.compile(r"data-example='([01])'")  # set by the layouts; no feature sees it
HEADING = re.compile("h[1-6]")
HIDDEN = re.compile(r"display\s*:\s*none|\bhidden\b", re.I)


class Node:
    __slots__ = ("tag", "words", "parent", "parts", "depth", "hidden", "mark", "ended")

    def __init__(self, tag: str, words: frozenset, parent: Node | None, hidden: bool = False, mark: str = ""):
        self.tag, self.words, self.parent, self.hidden, self.mark = tag, words, parent, hidden, mark
        self.parts: list = []  # child nodes and strings, in page order
        self.ended = False  # by its own end tag
        self.depth = 0 if parent is None else parent.depth + 1


def parse(page: str) -> Node:
    """Tree of a page; raw text elements are dropped."""
    root = Node("html", frozenset(), None)
    here, at, n = root, 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            here.parts.append(page[at:])
            break
        if begin > at:
            here.parts.append(page[at:begin])
        found = TOKEN.match(page, begin)
        if not found:
            here.parts.append("<")
            at = begin + 1
            continue
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            up = here
            while up is not root and up.tag != tag and not (tag in INLINE and up.tag in BLOCKS):
                up = up.parent
            if up is not root and up.tag == tag:
                up.ended = True
                here = up.parent
            continue
        if tag in RAW and found[3].rstrip().endswith("/") and _foreign(here):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in ("html", "head", "body"):
            continue
        if tag in BLOCKS:
            # a paragraph and what is inline in it end where a block begins
            up = here
            while up.tag in INLINE and up.parent is not None:
                up = up.parent
            if up.tag == "p" or HEADING.fullmatch(up.tag):
                here = up.parent
        if tag in CLOSES:
            up = here
            while up is not root and up.tag not in CLOSES[tag] and (up.tag not in SCOPE):
                up = up.parent
            if up is not root and up.tag in CLOSES[tag]:
                here = up.parent
        named = ATTRIBUTE.findall(found[3]) if found[3] else []
        words = frozenset(w for _, *value in named for w in WORDS.findall("".join(value).lower()))
        mark = MARK.search(found[3]) if found[3] else None
        node = Node(tag, words, here, bool(found[3] and HIDDEN.search(found[3])), mark[1] if mark else "")
        here.parts.append(node)
        if tag not in VOID and not found[3].rstrip().endswith("/"):
            here = node
    return root


def _foreign(node: Node | None) -> bool:
    """Whether a node lies in a drawing or formula, where any tag may close itself."""
    while node is not None and node.tag not in ("svg", "math"):
        node = node.parent
    return node is not None


def bound(nodes: list[Node]) -> tuple[set[int], set[int]]:
    """Ids of the nodes that controls keep out of the content, and of those in formulas, which follow their parent."""
    out: set[int] = set()
    whole: set[int] = set()
    follow: set[int] = set()
    for x in nodes:
        above = id(x.parent)
        if x.tag in CONTROLS and x.ended or above in whole:
            whole.add(id(x))
            out.add(id(x))
        elif x.tag in CONTROLS or above in out and x.tag not in BLOCKS:
            out.add(id(x))
        elif x.tag == "math" or above in follow and x.tag not in BLOCKS:
            follow.add(id(x))
    return out, follow


def nodes_of(root: Node) -> list[Node]:
    """All nodes, each before those below it."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(p for p in reversed(node.parts) if not isinstance(p, str))
    return out


def describe(pages: list[list[Node]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the nodes of several pages, the length of the text directly in each, and its parent's place
    within the page (-1: none)."""
    cols: list[list[float]] = [[] for _ in range(15)]
    own_all, up_all, base_all, tags_all = [], [], [], []
    for nodes in pages:
        n = len(nodes)
        place = {id(x): i for i, x in enumerate(nodes)}
        up = [-1] + [place[id(x.parent)] for x in nodes[1:]]
        own, linked, stops, paras = [0] * n, [0] * n, [0] * n, [0] * n
        good, bad, above_good, above_bad = [0] * n, [0] * n, [0] * n, [0] * n
        children, kinds = [0] * n, {}
        for i, x in enumerate(nodes):
            for p in x.parts:
                if p.__class__ is str:
                    own[i] += len(p.strip())
                    stops[i] += p.count(". ") + p.count(", ") + p.endswith((".", "!", "?"))
            if x.tag == "a":
                linked[i] = own[i]
            elif x.tag == "p":
                paras[i] = 1
            good[i] = len(x.words & GOOD) + (x.tag in GOOD_TAGS)
            bad[i] = len(x.words & BAD) + (x.tag in BAD_TAGS)
            above_good[i], above_bad[i] = good[i], bad[i]
            if i:
                above_good[i] += above_good[up[i]]
                above_bad[i] += above_bad[up[i]]
                children[up[i]] += 1
            kinds[up[i], x.tag] = kinds.get((up[i], x.tag), 0) + 1
        start, done = [0] * n, 0
        for i in range(n):
            start[i] = done
            done += own[i]
        whole, tags = own[:], [1] * n
        for i in range(n - 1, 0, -1):  # children stand after their parents
            u = up[i]
            whole[u] += whole[i]
            linked[u] += linked[i]
            tags[u] += tags[i]
            stops[u] += stops[i]
            paras[u] += paras[i]
        first = len(own_all)
        own_all += own
        up_all += up
        base_all += [first] * n
        tags_all += [SEMANTIC_AT.get("h" if HEADING.fullmatch(x.tag) else x.tag, -1) for x in nodes]
        values = (
            good, bad, above_good, above_bad, whole, linked, tags, stops, paras, children, start, [whole[0]] * n,
            [kinds[up[i], x.tag] for i, x in enumerate(nodes)], [x.depth for x in nodes], [x.hidden for x in nodes],
        )
        for col, more in zip(cols, values):
            col.extend(more)
    good, bad, above_good, above_bad, whole, linked, tags, stops, paras, children, start, total, same, depth, hidden = (
        np.array(c, dtype=float) for c in cols
    )
    own, up, base = np.array(own_all, dtype=float), np.array(up_all, dtype=np.int64), np.array(base_all, dtype=np.int64)
    parent = np.where(up >= 0, base + up, np.arange(len(up)))
    some, all_ = np.maximum(1.0, whole), np.maximum(1.0, total)
    density = linked / some
    named = np.zeros((len(own), len(SEMANTIC)))
    at = np.array(tags_all, dtype=np.int64)
    named[np.flatnonzero(at >= 0), at[at >= 0]] = 1
    rest = (
        good, bad, above_good, above_bad, np.log1p(own), np.log1p(whole), density, whole / np.maximum(1.0, tags),
        stops / some * 100, depth, children, start / all_, whole / all_,
        np.log1p(np.maximum(0.0, whole[parent] - whole) / np.maximum(1.0, children[parent] - 1)), same, paras,
        density[parent], whole / some[parent], hidden,
    )
    return np.column_stack([named, *rest]), own, up


def blocks_of(node: Node, chosen: set[int] | None = None) -> list[str]:
    """Texts of the blocks under a node in page order; with ``chosen``, only text directly in those nodes."""
    out: list[str] = []
    open_: list[str] = []

    def flush() -> None:
        text = " ".join(references.unescape("".join(open_)).split())
        if text:
            out.append(text)
        open_.clear()

    todo: list = [(node, False)]
    while todo:
        x, closing = todo.pop()
        if isinstance(x, tuple):
            text, keep = x
            open_.append(text if keep else "")
            continue
        if x.tag in BLOCKS or x.parent is None:
            flush()
        elif x.tag == "br":
            open_.append(" ")
        if closing:
            continue
        keep = chosen is None or id(x) in chosen
        todo.append((x, True))
        for p in reversed(x.parts):
            todo.append(((p, keep), False) if isinstance(p, str) else (p, False))
    flush()
    return out


def decode(nodes: list[Node], probability: np.ndarray, own: np.ndarray, up: np.ndarray, mixed: float = MIXED) -> set[int]:
    """Ids of the nodes labelled content by the likeliest consistent labelling of the tree.

    The weight of a node grows with the text directly in it, so a long paragraph outweighs empty wrappers.
    """
    p = np.clip(probability, 1e-3, 1 - 1e-3)
    weight = 0.2 + np.log1p(own)
    yes, no, above = (weight * np.log(p)).tolist(), (weight * np.log(1 - p)).tolist(), up.tolist()
    out, follow = bound(nodes)
    for i, x in enumerate(nodes):
        if id(x) in out or id(x) in follow:
            yes[i] = no[i] = 0.0
    all_yes, all_no = yes[:], no[:]
    free = [max(a, b) + mixed for a, b in zip(yes, no)]
    loose = out | follow
    free = [0.0 if id(x) in loose else f for x, f in zip(nodes, free)] if loose else free
    for i in range(len(nodes) - 1, 0, -1):
        u = above[i]
        free[u] += max(all_yes[i], all_no[i], free[i])
        all_yes[u] += all_yes[i]
        all_no[u] += all_no[i]
    content: set[int] = set()
    state = [""] * len(nodes)
    for i, x in enumerate(nodes):
        state[i] = state[above[i]] if i else "free"
        if state[i] == "free":
            best = max(all_yes[i], all_no[i], free[i])
            state[i] = "no" if best == all_no[i] else "yes" if best == all_yes[i] else "free"
        if id(x) in out:
            # blocks in a control without an end tag are judged on their own
            state[i] = "no" if x.ended or state[i] == "no" else "free"
        elif id(x) in follow:
            if id(x.parent) in content:
                content.add(id(x))
        elif state[i] == "yes" or state[i] == "free" and yes[i] > no[i]:
            content.add(id(x))
    return content


class Trees:
    """Boosted regression trees as arrays; children of a node are at ``below`` and ``below + 1``."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], weights: list[float]):
        self.trees, self.weights = trees, weights

    def probability(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        for (feature, threshold, below, value), weight in zip(self.trees, self.weights):
            node = np.zeros(len(rows), dtype=np.int64)
            while True:
                inner = below[node] > 0
                if not inner.any():
                    break
                right = rows[at, feature[node]] > threshold[node]
                node = np.where(inner, below[node] + right, node)
            total += weight * value[node]
        return 1 / (1 + np.exp(-2 * total))


def _export(tree) -> tuple[np.ndarray, ...]:
    """A fitted Spark tree as arrays."""
    feature, threshold, below, value = [0], [0.0], [0], [0.0]
    todo = [(tree._call_java("rootNode"), 0)]
    while todo:
        node, at = todo.pop()
        value[at] = node.prediction()
        if node.subtreeDepth() == 0:
            continue
        split = node.split()
        feature[at], threshold[at], below[at] = split.featureIndex(), split.threshold(), len(feature)
        for child in (node.leftChild(), node.rightChild()):
            todo.append((child, len(feature)))
            feature.append(0), threshold.append(0.0), below.append(0), value.append(0.0)
    return tuple(np.array(x) for x in (feature, threshold, below, value))


# Layouts that sampled texts are set into. {p}: paragraphs, {t}: heading, {m}: links, {s}: short text.
LAYOUTS = (
    "<div class='site-header'><div class='logo'>{s}</div>{m}</div><div class='{g}' data-example='1'><h1>{t}</h1>{p}</div>"
    "<div class='comments'><h3>{s}</h3><div class='comment'><p>{s}</p></div><div class='comment'><p>{l}</p></div></div>"
    "<div class='sidebar'><h4>{s}</h4>{m}</div><div class='site-footer'><p>{s}</p></div>",
    "<header><h2>{s}</h2></header><nav>{m}</nav><div class='notice'>{s}</div><main><div class='{g}' data-example='1'><h1>{t}</h1>{p}"
    "<div class='share' data-example='0'>{m}</div></div></main><aside><p>{l}</p></aside><footer>{s}</footer>",
    "<div id='cookie-banner'><p>{l}</p></div><div id='wrap'><div id='menu'>{m}</div><div id='{g}' data-example='1'><h2>{t}</h2>{p}"
    "<div class='ad' data-example='0'><p>{s}</p></div>{q}</div><section id='comments'><p>{l}</p><p>{s}</p></section>"
    "<form class='login'><label>{s}</label><p>{s}</p></form></div>",
    "<div class='promo'>{s}</div><article data-example='1'><header><h1>{t}</h1></header>{p}<aside data-example='0'><p>{l}</p></aside>{q}"
    "<section class='reader-comments' data-example='0'><h3>{s}</h3><p>{l}</p></section></article><div class='related'>{m}</div>",
    "<table><tr><td>{m}</td><td class='{g}' data-example='1'><h1>{t}</h1>{p}</td><td><p>{s}</p>{m}</td></tr></table>"
    "<div class='newsletter'><p>{l}</p></div>",
    "<div class='topbar'>{s}</div><section class='{g}' data-example='1'><h1>{t}</h1>{p}</section><section class='comment-list'>"
    "<ul><li><p>{l}</p></li><li><p>{l}</p></li></ul></section><div class='widget'><p>{s}</p></div><p class='copyright'>{s}</p>",
    "<div>{m}</div><div data-example='1'>{b}</div><div>{s}</div>",
    "<table><tr><td>{m}</td><td data-example='1'>{b}</td></tr><tr><td colspan='2'>{s}</td></tr></table>",
)
GOOD_NAMES = ("content", "post-content", "entry", "article-body", "story", "main", "text", "post", "page")


# Stands in for the sampled pages where none of them holds text.
PLACEHOLDER = "".join("<p>" + " ".join(f"word{i * 31 + j}" for j in range(25 + i % 4 * 15)) + ".</p>" for i in range(8))


def examples(page: str, number: int) -> list[tuple[list[Node], list[bool]]]:
    """Nodes with their labels: the page itself if it names its article, and its text in one of the layouts."""
    out = []
    nodes = nodes_of(parse(page))
    marked = [x for x in nodes if x.tag == "article"] or [x for x in nodes if x.tag == "main"]
    if marked:
        inside = {id(y) for x in marked for y in nodes_of(x)}
        for x in marked:
            for y in nodes_of(x):
                if y is not x and (y.tag in BAD_TAGS or y.words & BAD):
                    inside -= {id(z) for z in nodes_of(y)}
        inside -= bound(nodes)[0]
        out.append((nodes, [id(x) in inside for x in nodes]))
    chosen = {id(x) for x in nodes} - bound(nodes)[0]
    # without an article the paragraphs, without paragraphs every block gives text for the layouts
    texts = [b for x in (marked or [y for y in nodes if y.tag == "p"]) for b in blocks_of(x, chosen)] or blocks_of(nodes[0], chosen)
    words = " ".join(texts).split()
    if not words:
        return out

    def some(k: int, i: int) -> str:
        return references.escape(" ".join(words[(i * 7) % max(1, len(words) - k) :][:k]))

    links = [f"<li><a href='/{i}'>{some(1 + i % 2, i + number)}</a></li>" for i in range(4 + number % 5)]
    body = [f"<p>{references.escape(t)}</p>" for t in texts]
    layout = LAYOUTS[number % len(LAYOUTS)]
    half = len(body) // 2 if "{q}" in layout else len(body)
    built = nodes_of(parse(layout.format(
        p="".join(body[:half]), q="".join(body[half:]), b="<br>".join(map(references.escape, texts)), t=some(5, number), m=f"<ul>{''.join(links)}</ul>",
        s=some(6 + number % 9, number + 3), l=some(25 + number % 20, number + 11), g=GOOD_NAMES[number % len(GOOD_NAMES)],
    )))
    kept: dict[int, bool] = {}
    for x in built:
        kept[id(x)] = x.mark == "1" if x.mark else kept.get(id(x.parent), False)
    out.append((built, [kept[id(x)] for x in built]))
    return out


def fit(pages: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees from up to ``sample`` different pages, of which the first LONGEST characters give examples.

    If these hold no text, the layouts filled with placeholder words are all there is to learn from.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = pages.sparkSession
    eligible = pages.where(F.col("html").isNotNull())
    rank = F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    keys = eligible.groupBy(F.md5("html").alias("print")).agg(F.min(rank).alias("rank"))
    chosen = keys.orderBy("rank", "print").limit(sample)
    starts = eligible.select(F.md5("html").alias("own"), F.substring("html", 1, LONGEST).alias("start"))
    found = starts.join(F.broadcast(chosen), F.col("own") == F.col("print"))  # at most ``sample`` short rows
    found = found.groupBy("rank", "print").agg(F.min("start").alias("start"))
    rows = found.orderBy("rank", "print").collect()
    made = [e for i, r in enumerate(rows) for e in examples(r["start"], i)]
    if len({k for _, kept in made for k in kept}) < 2:
        made += [e for i in range(2 * len(LAYOUTS)) for e in examples(PLACEHOLDER, i)]
    labels = [k for _, kept in made for k in kept]
    values, own, _ = describe([nodes for nodes, _ in made])
    names = [f"f{i}" for i in range(values.shape[1])]
    table = pd.DataFrame(values, columns=names).assign(label=np.array(labels, dtype=float), weight=0.2 + np.log1p(own))
    data = VectorAssembler(inputCols=names, outputCol="features").transform(spark.createDataFrame(table).coalesce(1))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, weightCol="weight", stepSize=0.3).fit(
        data.select("features", "label", "weight"))
    return Trees([_export(t) for t in model.trees], list(model.treeWeights))


def _texts(pages: list[str], trees: Trees) -> list[str]:
    parsed = [nodes_of(parse(p)) for p in pages]
    values, own, up = describe(parsed)
    probability = trees.probability(values)
    out, at = [], 0
    for nodes in parsed:
        part = slice(at, at + len(nodes))
        content = decode(nodes, probability[part], own[part], up[part])
        out.append(" ".join(blocks_of(nodes[0], content)))
        at += len(nodes)
    return out


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(fit(pages, sample))
    id_type = dict(pages.dtypes)["page_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                texts = _texts([p.as_py() or "" for p in part.column("html")], sent.value)
                yield pa.RecordBatch.from_pydict({
                    "page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                })

    return pages.select("page_id", "url", "html").mapInArrow(work, f"page_id {id_type}, url string, text string, n_chars long")
