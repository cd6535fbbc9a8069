"""Main text of web pages by a tree-structured graphical model over the elements of a page.

Each block element is a node with a hidden label, content or boilerplate. A node's own features give its unary
potential, parent and child share a pairwise potential; sum-product messages, first up and then down the tree, give the
exact marginals. The potentials are smoothed counts over labelled pages.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices

#: Attribute that marks an element of a labelled page, and what is below it up to the next mark: 1 content, 0 boilerplate.
MARK = "data-main"
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose text is never shown as such.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
HIDDEN = {"head", "template", "noscript", "svg", "math", "select", "button", "object", "audio", "video", "canvas", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul legend caption".split()
)
#: Elements that say little about what is in them.
PLAIN = {"div", "dl", "dd", "dt", "li", "ol", "p", "table", "tbody", "td", "th", "thead", "tr", "ul", "#text"}
#: Elements whose own text is a node of its own, as what stands beside it may be anything.
OPEN = {"root", "html", "body", "main", "article", "section", "div", "center"}
#: An opening tag of the left kind ends an open element of the right kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id and role attributes, by what they hint at.
HINTS = {
    "chrome": "nav navbar navigation menu header masthead topbar footer sidebar side aside breadcrumb breadcrumbs pagination pager toolbar widget related recommended trending popular share sharing social toc skip banner complementary contentinfo",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login paywall",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner-ad adsense outbrain taboola",
    "comment": "comment comments reply replies discussion disqus responses commentlist respond",
    "form": "form search searchbox contact-form field input",
    "content": "article content post entry story main body text article-body post-content entry-content articlebody prose hentry",
}
HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}
#: Words in front of another that only tell what the page has (``has-sidebar``).
MODIFIERS = {"has", "with", "no", "without", "is", "not", "hide", "show"}
#: Styles of what is not shown.
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def hint_of(names: str) -> str:
    """What the words of class, id and role say together: all kinds that they name, in the order of ``HINTS``."""
    kinds = set()
    for name in re.findall(r"[a-z]+(?:[-_]+[a-z]+)*", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower()):
        words = re.split(r"[-_]+", name)
        if words[0] in MODIFIERS:
            continue
        kinds.update(HINT_OF[w] for w in ("-".join(words), *words) if w in HINT_OF)
    return "+".join(k for k in HINTS if k in kinds)


class Node:
    __slots__ = ("tag", "hint", "mark", "parent", "depth", "chars", "linked", "place")

    def __init__(self, tag: str, hint: str, mark: int, parent: int, depth: int):
        self.tag, self.hint, self.mark, self.parent, self.depth = tag, hint, mark, parent, depth
        self.chars = self.linked = 0
        self.place = f"{tag} {hint}"  # of a list, table or plain box: that of what it stands in


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements in page order (a parent before its children), and (node, text) of each block of text."""
    nodes, blocks = [Node("root", "", 0, -1, 0)], []
    stack: list[tuple[str, int, bool]] = [("root", 0, False)]  # tag, nearest block node, hidden
    # where in the stack each tag's elements and all blocks are, so that an end tag costs no search
    places: defaultdict[str, list[int]] = defaultdict(list)
    blocks_at = [0]
    links, run, run_node, own = 0, [], 0, {}  # own: the text node of an open element, while its text goes on

    def close_run() -> None:
        nonlocal run
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                blocks.append((own.get(run_node, run_node), text))
            run = []
            own.pop(run_node, None)

    def say(text: str) -> None:
        nonlocal run_node
        _, node, hidden = stack[-1]
        if hidden or not text:
            return
        if node != run_node:
            close_run()
            run_node = node
        run.append(text)
        n = len(text) - text.count(" ")
        if nodes[node].tag in OPEN:
            if node not in own:
                if not text.strip():
                    return
                nodes.append(Node("#text", "", nodes[node].mark, node, nodes[node].depth + 1))
                nodes[-1].place = nodes[node].place
                own[node] = len(nodes) - 1
            node = own[node]
        nodes[node].chars += n
        nodes[node].linked += n if links else 0

    def pop() -> None:
        nonlocal links
        tag, _, _ = stack.pop()
        places[tag].pop()
        if tag == "a" and links:
            links -= 1
        if tag in BLOCK:
            blocks_at.pop()
            close_run()

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            # an inline end tag does not close blocks
            if places[tag] and (tag in BLOCK or blocks_at[-1] < places[tag][-1]):
                k = places[tag][-1]
                while len(stack) > k:
                    pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in BLOCK:
            while len(stack) > 1 and stack[-1][0] not in BLOCK and places["p"] and tag != "hr":
                pop()  # inline elements left open end with their paragraph
            if stack[-1][0] == "p":
                pop()
            if stack[-1][0] in ENDS.get(tag, ()):
                pop()
            close_run()
        elif tag == "br":
            say(" ")
            continue
        if tag in VOID:
            continue
        _, node, hidden = stack[-1]
        if tag in BLOCK:
            given = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[3])} if m[3].strip(" /") else {}
            hint = hint_of(" ".join(given.get(k, "") for k in ("class", "id", "role")))
            mark = int(given[MARK] == "1") if MARK in given else nodes[node].mark
            nodes.append(Node(tag, hint, mark, node, nodes[node].depth + 1))
            if not hint and tag in PLAIN:
                nodes[-1].place = nodes[node].place
            elif tag == "header" and not hint:  # of the page or of the article
                nodes[-1].place = f"header in {nodes[node].place}"
            node = len(nodes) - 1
        if tag == "a":
            links += 1
        places[tag].append(len(stack))
        if tag in BLOCK:
            blocks_at.append(len(stack))
        unseen = tag in HIDDEN or "hidden" in m[3].lower().split() or ("style" in m[3].lower() and UNSEEN.search(m[3]) is not None)
        stack.append((tag, node, hidden or unseen))
    close_run()
    return nodes, blocks


def features(node: Node, parent: Node) -> list[tuple[str, str]]:
    """What a node looks like, and what it stands in."""
    share = node.linked / node.chars if node.chars else -1.0
    return [
        ("tag", node.tag),
        ("hint", node.hint),
        ("kind", f"{node.tag} {node.hint}"),
        ("under", parent.place),
        ("stands", f"{node.tag} {node.hint} in {parent.place}"),
        ("chars", str(min(6, int(math.log2(node.chars + 1) // 1.5))) if node.chars else "none"),
        ("linked", "none" if share < 0 else "0" if share == 0 else "few" if share < 0.4 else "most"),
    ]


def count(page: str) -> Counter:
    """What a labelled page adds to the counts: (feature, value, label) and (child's kind, parent's label, label)."""
    nodes, _ = parse(page)
    out: Counter = Counter()
    for node in nodes[1:]:
        parent = nodes[node.parent]
        for name, value in features(node, parent):
            out[name, value, node.mark] += 1
        out["edge", str(parent.mark), node.mark] += 1
    return out


class Model:
    """Logarithms of the potentials: ``unary[name, value][label]`` and ``pair[parent's label][label]``."""

    def __init__(self, counts: dict[tuple[str, str, int], int], smooth: float = 0.5):
        self.unary: dict[tuple[str, str], tuple[float, float]] = {}
        self.pair = [[0.0, 0.0], [0.0, 0.0]]
        values: dict[str, set[str]] = {}
        totals: Counter = Counter()
        for (name, value, label), n in counts.items():
            if name != "edge":
                values.setdefault(name, set()).add(value)
                totals[name, label] += n
        for name, seen in values.items():
            for value in seen:
                self.unary[name, value] = tuple(math.log((counts.get((name, value, k), 0) + smooth) / (totals[name, k] + smooth * (len(seen) + 1))) for k in (0, 1))
        for p in (0, 1):
            row = [counts.get(("edge", str(p), k), 0) + smooth for k in (0, 1)]
            self.pair[p] = [math.log(n / sum(row)) for n in row]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each node's probability of content: messages from the leaves to the root, then from the root to the leaves."""
        none, unary, pair = (0.0, 0.0), self.unary, self.pair
        up = []
        for node in nodes:
            a = b = 0.0
            for f in features(node, nodes[node.parent]) if node.parent >= 0 else ():
                x, y = unary.get(f, none)
                a += x
                b += y
            up.append([a, b])
        up[0] = [0.0, -20.0]  # the page as a whole is no content
        sent: list[tuple[float, float]] = [none] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
            a, b = up[k]
            sent[k] = tuple(_log_sum(row[0] + a, row[1] + b) for row in pair)
            parent = up[nodes[k].parent]
            parent[0] += sent[k][0]
            parent[1] += sent[k][1]
        down: list[tuple[float, float]] = [none] * len(nodes)
        out = [0.0] * len(nodes)
        for k, node in enumerate(nodes):
            a, b = up[k]
            if k:
                p, q = up[node.parent], down[node.parent]
                x, y = p[0] + q[0] - sent[k][0], p[1] + q[1] - sent[k][1]  # all that the parent knows but from this child
                down[k] = (_log_sum(x + pair[0][0], y + pair[1][0]), _log_sum(x + pair[0][1], y + pair[1][1]))
                a, b = a + down[k][0], b + down[k][1]
            d = a - b
            out[k] = 1 / (1 + math.exp(d)) if d < 700 else 0.0
        return out

    def extract(self, page: str | None) -> str:
        """Blocks whose node is more likely content than not, in page order, joined by an empty line."""
        if not page:
            return ""
        nodes, blocks = parse(page)
        likely = self.marginals(nodes)
        return "\n\n".join(text for node, text in blocks if likely[node] > 0.5)


def _log_sum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


def labelled_pages(n: int = 600, seed: int = 5) -> list[str]:
    """Pages of many layouts with marked elements: what a site's article, menus, notices, adverts, forms and comments look like."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("ba re ti no la shu en or ka mi".split()) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))

    def sentence(a: int = 5, b: int = 25) -> str:
        return words(a, b).capitalize() + r.choice([".", ".", ".", "!", "?"])

    def some(a: int, b: int, make) -> str:
        return "".join(make() for _ in range(r.randint(a, b)))

    def link() -> str:
        return f'<a href="/{r.randint(1, 999)}">{words(1, 4)}</a>'

    def menu() -> str:
        items = some(3, 10, lambda: f"<li>{link()}</li>")
        return r.choice([f"<nav><ul>{items}</ul></nav>", f'<div class="{r.choice(["nav", "menu", "breadcrumbs", "navbar", "main-menu", "site-nav content", "article-nav", "post-navigation"])}"><ul>{items}</ul></div>', f"<nav>{some(2, 6, link)}</nav>", f'<ul class="menu">{items}</ul>'])

    def head() -> str:
        return r.choice([f"<header><h1>{words(1, 3)}</h1><p>{words(2, 6)}</p></header>", f'<div id="header"><h2>{link()}</h2></div>', f"<header>{menu()}</header>", ""])

    def foot() -> str:
        text = f"&copy; 2020 {words(1, 4)} {link()}"
        return r.choice([f"<footer>{text}</footer>", f"<footer><p>{text}</p><ul>{some(2, 5, lambda: f'<li>{link()}</li>')}</ul></footer>", f'<div class="{r.choice(["footer", "article-footer", "post-footer", "content-footer"])}"><p>{text}</p></div>'])

    def boiler() -> str:
        return r.choice(
            [
                lambda: f'<div class="{r.choice(["ad", "ads", "advert", "sponsored", "promo"])}">{sentence(3, 14)}</div>',
                lambda: f'<div class="ad"><p>{sentence(3, 20)}</p>{link()}</div>',
                lambda: f'<aside><h3>{words(1, 3)}</h3>{some(1, 4, lambda: f"<p>{sentence(3, 15)}</p>")}</aside>',
                lambda: f'<div class="sidebar"><h3>{words(1, 3)}</h3><ul>{some(2, 6, lambda: f"<li>{link()}</li>")}</ul><p>{sentence(3, 20)}</p></div>',
                lambda: f'<div class="{r.choice(["cookie-notice", "consent", "notice", "newsletter"])}"><p>{sentence(5, 25)}</p>{link()}</div>',
                lambda: f'<form action="/s"><p>{words(1, 4)}</p><label>{words(1, 2)}</label><input name="q"></form>',
                lambda: f'<div class="{r.choice(["related", "content-related", "related-articles", "post-related"])}"><h3>{words(1, 3)}</h3><ul>{some(2, 5, lambda: f"<li>{link()}</li>")}</ul></div>',
                menu,
            ]
        )()

    def comments() -> str:
        body = some(1, 5, lambda: f'<{t} class="{r.choice(["comment", "comment", "post comment", "comment-body", "comment-entry"])}"><p>{sentence(4, 30)}</p></{t}>' if (t := r.choice(["div", "li", "article"])) else "")
        return r.choice([f'<div class="{r.choice(["comments", "post-comments", "article-comments"])}"><h3>{words(1, 2)}</h3>{body}</div>', f'<section id="comments"><h2>{words(1, 2)}</h2>{body}</section>', ""])

    def part() -> str:
        return r.choice(
            [
                lambda: f"<p>{some(1, 5, sentence)}</p>",
                lambda: f"<p>{some(1, 5, sentence)}</p>",
                lambda: f"<p>{sentence()} {link()} {sentence()}</p>",
                lambda: f"<p><b>{sentence(1, 6)}<br>",
                lambda: f"<p>{words(1, 3)}.</p>",
                lambda: f"<h2>{words(1, 6)}</h2>",
                lambda: f"<ul>{some(2, 5, lambda: f'<li>{sentence(3, 12)}</li>')}</ul>",
                lambda: f"<blockquote><p>{sentence()}</p></blockquote>",
                lambda: f"<pre>{sentence()}</pre>",
                lambda: f"<table><tr><th>{words(1, 2)}</th><td>{words(1, 5)}</td></tr><tr><td>{words(1, 2)}</td><td>{words(1, 5)}</td></tr></table>",
                lambda: f"<figure><img src=x><figcaption>{sentence(3, 9)}</figcaption></figure>",
                lambda: f"<div>{some(1, 3, sentence)}</div>",
            ]
        )()

    def open_text() -> str:
        return some(1, 5, lambda: f"{some(1, 3, lambda: sentence() + ' ')}{r.choice(['<br>', '<br><br>', f'<p>{sentence()}</p>', f'<span>{sentence()}</span>', f'<b>{words(1, 3)}</b>'])}")

    def marked(parts: list[str]) -> str:
        return "".join(f'<div {MARK}="0">{p}</div>' if p and not p.startswith("<") else re.sub(r"^<(\w+)", rf'<\1 {MARK}="0"', p) for p in parts)

    out = []
    for _ in range(n):
        title = f"<h1>{words(1, 9)}</h1>"
        body = r.choice([title, f"<header>{title}</header>", title, ""]) + some(1, 14, part)
        if r.random() < 0.25:
            body += f'<div {MARK}="0">{boiler()}</div>' + some(1, 4, part)
        main = r.choice(
            [
                f'<article {MARK}="1">{body}</article>',
                f'<article {MARK}="1">{body}</article>',
                f'<main {MARK}="1">{body}</main>',
                f'<main><article class="post" {MARK}="1">{body}</article></main>',
                f'<div class="{r.choice(["content", "post-content", "entry", "story", "content has-sidebar", "mainContent"])}" {MARK}="1">{body}</div>',
                f'<div class="{r.choice(["content", "story"])}" {MARK}="1">{open_text()}</div>',
                f'<div id="main"><div class="article-body" {MARK}="1">{body}</div></div>',
                f'<section {MARK}="1">{body}</section>',
                re.sub(r"^<(\w+)", rf'<\1 {MARK}="1"', title) + some(1, 10, lambda: re.sub(r"^<(\w+)", rf'<\1 {MARK}="1"', part())),
            ]
        )
        before = [menu(), head(), some(0, 2, boiler)]
        r.shuffle(before)
        if r.random() < 0.1:  # the text stands in the body itself
            out.append(f'<html><body {MARK}="1">{marked(before)}{title if r.random() < 0.5 else ""}{open_text()}{marked([comments(), foot()])}</body></html>')
            continue
        inside = f'{"".join(before)}{main}{comments()}{some(0, 2, boiler)}{foot()}'
        out.append(inside if r.random() < 0.1 else f"<html><head><title>{words(2, 6)}</title></head><body>{inside}</body></html>")
    return out


def train(pages: DataFrame, column: str = "html") -> Model:
    """Potentials from pages marked with ``data-main``. Counts are summed on the executors; their number does not grow with the pages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(count(page or ""))
        keys = list(total)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], ["name", "value", "label", "n"])

    counted = pages.select(F.col(column).cast("string")).mapInArrow(work, "name string, value string, label int, n long")
    rows = counted.groupBy("name", "value", "label").agg(F.sum("n").alias("n")).collect()  # features are drawn from closed lists
    return Model({(r["name"], r["value"], r["label"]): r["n"] for r in rows})


def trained(spark: SparkSession) -> Model:
    """The model of the layouts of ``labelled_pages``."""
    return train(spark.createDataFrame([(p,) for p in labelled_pages()], "html string").repartition(8))


def main_text(spark: SparkSession, pages: DataFrame, model: Model, id: str = "page_id", column: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of ``keep``, ``text``, ``n_chars`` (code points) of each page.

    White space inside a block is every run of Unicode white space, no-break spaces too (``str.split``); it becomes one space. A line break is such white space.
    Text that is not shown (``hidden``, ``display:none``) is left out. Null or empty pages, and pages where nothing looks like an article, give empty text. Pages are read whole; markup left open at
    the end is closed there. Null ids and repeated rows are kept; other columns are not read.
    """
    shared = spark.sparkContext.broadcast(model)  # some hundred numbers
    chosen = [id, *keep, column]
    kinds = [pages.schema[c].dataType.simpleString() for c in chosen[:-1]]
    names = [f"c{k}" for k in range(len(kinds))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = shared.value.extract
        for batch in batches:
            start = 0
            for ids, texts in slices(batch.column(0), batch.column(len(names))):
                out = list(map(extract, texts))
                kept = [batch.column(k).slice(start, len(ids)) for k in range(len(names))]
                start += len(ids)
                yield pa.record_batch([*kept, pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], [*names, "text", "n_chars"])

    schema = "".join(f"{n} {k}, " for n, k in zip(names, kinds)) + "text string, n_chars long"
    out = pages.select(*(F.col(c) for c in chosen[:-1]), F.col(column).cast("string")).mapInArrow(work, schema)
    return out.toDF(*chosen[:-1], "text", "n_chars")
