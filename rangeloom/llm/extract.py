"""Main text of HTML pages by minimum-cut labelling.

A page becomes blocks of running text.  A logistic classifier gives each block a cost for
being content and one for being boilerplate; these are the capacities to the two
terminals.  Blocks that follow each other and blocks that are neighbours among the
children of one element are joined by smoothness edges.  The minimum cut is the labelling
of least total cost; it is found by max-flow after blocks whose terminal outweighs all
their edges have been settled, which leaves the optimum as it is.

The classifier is trained on the driver from the small labelled pages below, so it is the
same for every corpus.  The operator is a map over whole pages.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rangeloom.llm.common import blob, pieces, require

PIECE_BYTES = 8_000_000
#: Element names by role.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template textarea title svg iframe object noframes".split())
DROPPED_TAGS = frozenset("head select option button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open paragraph, item or cell ends where one of its kind or its container begins or ends.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of class and id values that tell boilerplate.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies disqus disclaimer footer gdpr header legal login masthead menu menus meta modal nav navbar navigation newsletter notice notification pagination pager paywall popup promo promotion recommend recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags teaser teasers toolbar topbar trending widget widgets".split()
)
GOOD_WORDS = frozenset("article body content entry main post prose story text".split())
#: Words that make a name speak of a state of the page, not of the element's part in it.
STATE_FIRST = frozenset("has have no not with without is hide show hidden show single page category tag type format status theme layout template wp js supports allow enable disable use using t p".split())
STATE_LAST = frozenset("enabled disabled open opened closed on off active inactive visible loaded ready free top bottom left right".split())
WORD_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
BAD_ROLE = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|dialog|alert|menu|menubar|form)$", re.I)
#: Comments, declarations and tags.  A quote opens a value only behind "=" and only if it is closed; any
#: other quote is a plain character, so a stray one cannot swallow what follows.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s/\"'])(class|id|role|hidden|aria-hidden|style)(?![^\s=/>])(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+", re.I)

#: Phrases of notices and calls to act.
LEGAL = re.compile(r"©|\bcopyright\b|all rights reserved|privacy policy|\bcookies\b|\bnewsletter\b|\bsubscribe\b|\bsign up\b|\blog in\b|share this|enable javascript", re.I)

SMOOTH_NEXT = 0.6
SMOOTH_SIBLING = 0.6


@dataclass
class Node:
    """An open element: its name, flags it hands down, and the last block among its children."""

    name: str
    flags: frozenset[str]
    block: int = 0  # place on the stack of the nearest block element, itself included
    last: int = -1
    mark: Mark | None = None


@dataclass
class Mark:
    """An element that its name or its being a form tells as boilerplate, unless it holds the page's main heading or part."""

    flag: str
    outer: Mark | None = None
    around: bool = False
    told: frozenset[str] = frozenset()  # its flag and those of the marks around it, in the end


@dataclass
class Block:
    """A run of text between block boundaries."""

    text: str
    flags: frozenset[str]
    tag: str
    link_chars: int
    siblings: list[int] = field(default_factory=list)
    mark: Mark | None = None  # the innermost around the block


def name_kind(value: str) -> str:
    """``bad``, ``good`` or nothing for a class or id value.

    Each name counts by its first and its last word, the last one first; names that speak of
    a state (has-sidebar, comments-enabled, tag-news) do not count.  Where good and bad names
    meet on one element neither counts.
    """
    kinds = set()
    for name in value.split():
        words = [w.lower() for w in WORD_OF_NAME.findall(name) if not w[0].isdigit()]
        if not words or len(words) > 1 and (words[0] in STATE_FIRST or words[-1] in STATE_LAST):
            continue
        if words[-1] in BAD_WORDS or words[0] in BAD_WORDS:
            kinds.add("bad")
        elif words[-1] in GOOD_WORDS or words[0] in GOOD_WORDS:
            kinds.add("good")
    return kinds.pop() if len(kinds) == 1 else ""


def flags_of(name: str, attributes: str, inherited: frozenset[str]) -> tuple[frozenset[str], str]:
    """Flags of an element, its parent's and what its name and attributes add, and the flag
    (``bad``, ``form`` or none) that holds only if the main part is not inside."""
    new = set()
    mark = ""
    if name in ("nav", "footer", "aside", "menu", "dialog", "header", "fieldset"):
        new.add(name)
    if name == "form":
        mark = "form"
    if name == "noscript" and "article" not in inherited:
        new.add("bad")
    if name in ("article", "main"):
        new.add("article")
    if attributes:
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            value = a or b or c
            key = key.lower()
            if key in ("class", "id"):
                kind = name_kind(value)
                if kind == "bad" and name not in ("body", "html", "main"):
                    mark = "bad"
                elif kind == "good":
                    new.add("good")
            elif key == "role":
                if BAD_ROLE.search(value):
                    mark = "bad"
                elif value.lower() in ("main", "article"):
                    new.add("article")
            elif key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                new.add("hidden")
    return (inherited | new if new else inherited), mark


def parse(page: str) -> list[Block]:
    """Text blocks of a page in order; scripts, styles, comments and hidden parts have none.

    Linear in the page: the stack knows the nearest block element of every entry and where
    each element name is open last.
    """
    blocks: list[Block] = []
    stack = [Node("", frozenset())]
    open_at: dict[str, list[int]] = {}
    marks: list[Mark] = []
    every: list[Mark] = []
    parts: list[str] = []
    link_chars = links = 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            at = stack[-1].block
            top = stack[at]
            block = Block(text, top.flags, top.name, min(link_chars, len(text)), mark=marks[-1] if marks else None)
            for owner in stack[max(0, at - 1) : at + 1]:  # its own element and the one around it
                if owner.last >= 0:
                    block.siblings.append(owner.last)
                owner.last = len(blocks)
            blocks.append(block)
        link_chars = 0

    def close(name: str) -> None:
        nonlocal links
        where = open_at.get(name)
        if where:
            at = where[-1]
            for node in reversed(stack[at:]):
                open_at[node.name].pop()
                links -= node.name == "a"
                if node.mark:
                    marks.pop()
            del stack[at:]

    def main_part() -> None:
        for mark in marks:
            mark.around = True
        marks.clear()
        for node in stack:
            node.mark = None

    end = 0
    while m := TOKEN.search(page, end):
        start = m.start()
        dropped = "dropped" in stack[-1].flags
        if start > end and not dropped:
            piece = page[end:start]
            parts.append(piece)
            if links > 0:
                link_chars += len(piece.strip())
        end = m.end()
        if m[2] is None:
            if not dropped and m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = m[2].lower()
        if name in RAW_TAGS:
            if not m[1] and not (name in ("svg", "object") and m[3].rstrip().endswith("/")):
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(page, end)
                end = stop.end() if stop else len(page)
            continue
        if name in ("br", "wbr"):
            parts.append(" " if name == "br" else "")
            continue
        if name in VOID_TAGS and name != "hr":
            continue
        if name in BLOCK_TAGS:
            flush()
            if open_at.get("p") and open_at["p"][-1] >= len(stack) - 4:
                close("p")
            if name == "hr":
                continue
        if m[1]:
            close(name)
            continue
        for other in CLOSES.get(name, ()):
            if open_at.get(other) and open_at[other][-1] >= len(stack) - 3:
                close(other)
        flags, told = flags_of(name, m[3], stack[-1].flags)
        if name in ("h1", "main") and marks and not flags & {"hidden", "nav", "aside", "footer", "dialog"}:
            main_part()
        if name in DROPPED_TAGS or "hidden" in flags:
            flags |= {"dropped"}
        if name == "body" and "dropped" in flags:
            flags -= {"dropped", "hidden"}
        mark = Mark(told, marks[-1] if marks else None) if told else None
        if mark:
            marks.append(mark)
            every.append(mark)
        stack.append(Node(name, flags, len(stack) if name in BLOCK_TAGS else stack[-1].block, mark=mark))
        open_at.setdefault(name, []).append(len(stack) - 1)
        links += name == "a"
    if end < len(page) and "dropped" not in stack[-1].flags:
        tail = page[end:]
        parts.append(tail[: tail.rfind("<")] if re.search(r"<[a-zA-Z/!?][^>]*\Z", tail) else tail)
    flush()
    for mark in every:  # an outer mark comes before those inside it
        mark.told = (mark.outer.told if mark.outer else frozenset()) | ({mark.flag} if not mark.around else frozenset())
    for block in blocks:
        block.flags |= block.mark.told if block.mark else frozenset()
    return blocks


def features(block: Block) -> list[float]:
    """Numbers that the classifier sees."""
    text, flags = block.text, block.flags
    n = len(text)
    words = text.count(" ") + 1
    return [
        1.0,
        min(words, 60) / 20.0,
        min(1.0, block.link_chars / n),
        float(text[-1] in ".!?…\"”»。:;"),
        float("article" in flags),
        float(bool(flags & {"nav", "menu"})),
        float("footer" in flags),
        float("header" in flags and "article" not in flags),
        float(bool(flags & {"aside", "dialog"})),
        float(bool(flags & {"form", "fieldset"})),
        float("bad" in flags),
        float("good" in flags),
        float(block.tag in HEADINGS),
        float(block.tag == "p"),
        float(block.tag in ("li", "td", "dd", "dt", "th")),
        float(bool(LEGAL.search(text))) * (1.0 if words < 30 else 0.3),
        min(1.0, 8 * len(re.findall(r"[|»›·•]", text)) / n),
    ]


#: Labelled pages for the classifier; data-keep marks content.  Hand-written.
TRAINING = (
    '<body class="single has-sidebar"><div id="page"><div class="site-header"><div class="site-title"><a href="/">Field Notes</a></div></div><article class="post tag-news comments-open"><h1 class="entry-title" data-keep>Why the marsh froze late</h1><div class="entry-meta"><span>By A. Writer on 3 May</span> <a href="#c">4 comments</a></div><div class="entry-content"><p data-keep>Every winter the marsh behind the school turns into a skating rink, but this year it stayed open until February.</p><p data-keep>Nobody knows why.</p><h2 data-keep>What the records say</h2><ul><li data-keep>1971: frozen on the third of December</li><li data-keep>1998: frozen on the ninth of January</li></ul><p data-keep>The water is warmer than it was, says the warden, who has kept a diary for forty years.</p></div><div class="share-buttons"><a href="/f">Share</a> <a href="/t">Send</a></div></article><div id="respond" class="comment-respond"><h3>Leave a reply</h3><form><label>Your name</label></form></div><div class="comments-area"><h3>Four thoughts on this story</h3><p>We skated there as children, and my father did before us, so this makes me sad.</p></div></div><div class="widget-area"><h3>Recent posts</h3><ul><li><a href="/1">The fox at the door</a></li><li><a href="/2">Counting the swans</a></li></ul></div><div class="site-info">Proudly made in the marsh. All rights reserved.</div>',
    '<body><form id="aspnet" action="/x"><div class="topnav"><a href="/">Home</a><a href="/s">Shop</a></div><div class="wrapper"><h1 data-keep>How to mend a bicycle tyre</h1><p data-keep>Take off the wheel and let out what air is left. Lift the tyre over the rim with two levers.</p><ol><li data-keep>Find the hole under water.</li><li data-keep>Dry and roughen the place.</li><li data-keep>Glue on the patch and wait.</li></ol><p data-keep>Put it all back together, pump it up, and go.</p><table><tr><th data-keep>Size</th><th data-keep>Pressure</th></tr><tr><td data-keep>28 inch</td><td data-keep>four bar</td></tr></table></div><div class="newsletter-box"><p>Get our best tips once a week, straight to your inbox, and never mend alone.</p></div><div class="bottom"><p>Copyright 2021 The Shed | Terms | Privacy policy</p></div></form>',
    '<body><div class="cookie-consent"><p>This site uses cookies and similar techniques. Please accept them to go on reading.</p></div><div class="content"><div class="col"><h1 data-keep>Night trains return</h1><div class="lead" data-keep>After twenty years the sleeper to the south is back, and tickets are sold out until autumn.</div><p data-keep>The first train left at nine on Friday evening with two hundred people on board and a band on the platform.</p><figure><img src="x"><figcaption data-keep>The train before it left.</figcaption></figure><blockquote data-keep>I did not sleep at all, and I would do it again.</blockquote><p data-keep>More lines are planned.</p></div><div class="col sidebar"><p>Most read this week: ten places to swim before the summer ends.</p><p>Our app is free. Try it now.</p></div></div><div class="sponsored"><p>Sleep better on a mattress by one of our partners, thirty nights for free.</p></div>',
    '<body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/a">About us</a></li></ul></nav><div class="ad">Buy two, get one free today.</div><article><h1 data-keep>A walk along the river</h1><p data-keep>The path starts at the old mill and follows the water for several miles, past meadows and two small villages.<p data-keep>Bring good shoes.</p><ul><li data-keep>water and some food</li><li data-keep>a map of the region</li></ul></article><footer>&copy; 2020 example &middot; all rights reserved for the owners of this page.</footer>',
    '<body><header><a href="/">The Daily Sample</a><p>News since 1890, every morning.</p></header><div id="cookie-notice"><p>We use cookies to make this site better. By going on you agree to their use.</p><button>OK</button></div><main><h1 data-keep>Council votes for the bridge</h1><p data-keep>After a long debate on Tuesday night the council decided to rebuild the bridge, which was closed last year.</p><blockquote data-keep>We could not wait any longer, said the mayor.</blockquote><p data-keep>Work begins in May.</p></main><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten easy soups for cold days</a></li><li><a href="/2">Who won the match?</a></li></ul></aside><section class="comments"><h3>Comments</h3><p>Great article, I have been waiting for this bridge for years and years now.</p><p>What about the costs?</p></section><footer><p>Contact | Imprint | Privacy</p></footer>',
    '<body><div class="menu"><a href="/">Start</a> | <a href="/b">Blog</a></div><div class="post-content"><h2 data-keep>Baking bread at home</h2><p data-keep>Flour, water, salt and time are all it takes. Mix the dough in the evening and let it rest until the next morning.</p><p data-keep>Then shape it, let it rise once more and bake it in a very hot oven for forty minutes.</p><pre data-keep>500 g flour 350 g water 10 g salt</pre></div><div class="related"><p>You might also like these stories from our kitchen, picked for you by our editors.</p><a href="/x">More recipes</a></div><form action="/s"><label>Subscribe to our newsletter and never miss a recipe.</label><input type="text"></form><div class="footer">&copy; The kitchen. Made with love in a small town.</div>',
    '<body><table><tr><td><a href="/1">one</a></td><td><a href="/2">two</a></td></tr></table><h1 data-keep>Minutes of the meeting</h1><p data-keep>The chair opened the meeting at nine and thanked all members for coming in spite of the weather.</p><p data-keep>Agreed.</p><p data-keep>The next meeting will be held in the first week of March, at the same place and time.</p><div class="social-share"><p>Share this page with your friends</p></div><div><a href="/p">Previous</a> <a href="/q">Next page</a></div>',
    '<body><nav><a href="/">A</a></nav><div class="banner">Sale ends soon, order now and save.</div><article><header><h1 data-keep>On the habits of owls</h1></header><section><h2 data-keep>Hunting</h2><p data-keep>Owls hunt at night. They hear a mouse under the snow and fall on it without a sound.</p></section><section><h2 data-keep>Nesting</h2><p data-keep>Most kinds nest in hollow trees.</p><table><tr><td data-keep>Barn owl</td><td data-keep>four to seven eggs</td></tr></table></section><div class="comments"><p>I saw one yesterday behind our house, it was huge and white!</p></div><aside><p>Sign up for our bird letter.</p></aside></article><footer><p>All pictures belong to their makers and may not be used without asking them first.</p></footer>',
    '<body><div><div><a href="/a">Latest</a> <a href="/b">Topics</a> <a href="/c">Archive</a></div></div><div><div><h1 data-keep>Letters from the coast</h1><div data-keep>It has rained for nine days now and the boats stay in the harbour, but nobody seems to mind very much.</div><div data-keep>We play cards.</div><div data-keep>Tomorrow the wind may turn, the old men say, and then we will go out again before dawn.</div></div></div><div><div>&copy; Coast Media &middot; <a href="/i">Imprint</a></div></div>',
)


def train(pages: tuple[str, ...] = TRAINING, rounds: int = 400) -> np.ndarray:
    """Weights of the block classifier: logistic regression by Newton steps with a small ridge."""
    x, y = [], []
    for page in pages:
        # The marker becomes a private character at the start of the block it marks.
        marked = re.sub(r"(<[a-z0-9]+[^<>]*?) data-keep>", "\\1>\ue000", page)
        for block in parse(marked):
            keep = block.text.startswith("\ue000")
            block.text = block.text.lstrip("\ue000") or " "
            x.append(features(block))
            y.append(float(keep))
    a, t = np.array(x), np.array(y)
    w = np.zeros(a.shape[1])
    ridge = np.full(len(w), 0.1)
    for _ in range(min(rounds, 50)):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (t - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def edges_of(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness edges: page order, and order among the children of one element."""
    edges: dict[tuple[int, int], float] = {}
    for i, block in enumerate(blocks):
        if i:
            same = block.flags == blocks[i - 1].flags
            edges[i - 1, i] = SMOOTH_NEXT * (1.0 if same else 0.25)
        for j in block.siblings:
            if blocks[j].flags == block.flags:
                edges[j, i] = edges.get((j, i), 0.0) + SMOOTH_SIBLING
    return edges


def min_cut(gain: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of least cost: ``gain`` (log-odds of content) to the terminals, ``edges`` between
    blocks of different labels.  True is content; a block at exactly no gain goes to boilerplate.
    """
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    g = list(gain)
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # settle what outweighs its edges, and hand the edge on as gain
        i = todo.popleft()
        if label[i] is not None or abs(g[i]) < sum(near[i].values()) or g[i] == 0 and near[i]:
            continue
        label[i] = g[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            g[j] += w if label[i] else -w
            todo.append(j)
        near[i] = {}
    open_ = [i for i in range(n) if label[i] is None]
    if open_:
        for i, inside in zip(open_, _source_side(open_, g, near), strict=True):
            label[i] = inside
    return [bool(x) for x in label]


def _source_side(nodes: list[int], gain: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut: max-flow by blocking flows."""
    at = {v: i for i, v in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    head: list[list[int]] = [[] for _ in range(sink + 1)]
    to: list[int] = []
    cap: list[float] = []

    def edge(u: int, v: int, forth: float, back: float) -> None:
        head[u].append(len(to))
        head[v].append(len(to) + 1)
        to.extend((v, u))
        cap.extend((forth, back))

    for v, i in at.items():
        if gain[v] > 0:
            edge(source, i, gain[v], 0.0)
        else:
            edge(i, sink, -gain[v], 0.0)
        for w, c in near[v].items():
            if v < w:
                edge(i, at[w], c, c)
    while True:
        level = [-1] * (sink + 1)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:source]]
        turn = [0] * (sink + 1)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(cap[e] for e in path)
                cut = len(path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                    if cap[e] <= 1e-12 and cut == len(path):
                        cut = k
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[u] < len(head[u]):
                e = head[u][turn[u]]
                if cap[e] > 1e-12 and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(head[u]):
                path.append(head[u][turn[u]])
                u = to[path[-1]]
            elif path:
                level[u] = -1
                u = to[path.pop() ^ 1]
                turn[u] += 1
            else:
                break


def main_text(page: str, weights: np.ndarray) -> str:
    """Content blocks of a page, in page order, joined by two line feeds."""
    blocks = parse(page)
    if not blocks:
        return ""
    gain = (np.array([features(b) for b in blocks]) @ weights).tolist()
    return "\n\n".join(b.text for b, keep in zip(blocks, min_cut(gain, edges_of(blocks)), strict=True) if keep)


def extract_text(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: np.ndarray | None = None) -> DataFrame:
    """(``keep``..., text, n_chars) of every row: its main text and that text's code points.

    Null, empty and text-free pages give an empty text; copies and repeated rows each get
    their row; other columns are ignored.
    """
    require(df, page, *keep)
    model = train() if weights is None else weights
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep) + "text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "_page", PIECE_BYTES):
            texts = [main_text(p.decode("utf-8", errors="replace"), model) for p in part.column("_page").to_pylist()]
            texts = [t.encode("utf-8", errors="replace").decode() for t in texts]  # a reference may name a lone surrogate
            yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return df.select(*keep, blob(page).alias("_page")).mapInArrow(run, schema)
