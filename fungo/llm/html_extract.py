"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text of the page: code, what is not shown, and form controls.
DROPPED = frozenset("script style template iframe canvas audio video textarea select button head".split())
#: Elements that begin and end a block; all others are inline.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open element of these kinds first (HTML leaves their end tags out).
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
GOOD_TAGS, BAD_TAGS = frozenset(("article", "main")), frozenset(("nav", "footer", "aside", "form", "menu", "header", "dialog", "fieldset"))
#: Words of class and id attributes.
GOOD_WORDS = frozenset("article content entry post story body main text".split())
BAD_WORDS = frozenset("ad ads advert advertisement adbox sponsor sponsored promo banner cookie cookies consent notice alert sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs header masthead footer foot comment comments reply replies disqus respond related recommended share social subscribe newsletter signup login search popup modal overlay toolbar pager pagination copyright legal disclaimer form".split())
#: Of these, what an article has of its own.
OWN_WORDS = frozenset(("header",))
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Za-z]+")
_NAME = re.compile(r"[a-zA-Z][^\s>/]*")
_STOP = re.compile(r"[>\"']")
_BODY = re.compile(r"<body\b", re.I)
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in DROPPED}


class Block:
    """A block's text, its linked characters, its tag, its parent element and the landmark it lies in (0: none)."""

    __slots__ = ("text", "linked", "tag", "parent", "mark", "words")

    def __init__(self, text, linked, tag, parent, mark):
        self.text, self.linked, self.tag, self.parent, self.mark = text, linked, tag, parent, mark
        self.words = text.count(" ") + 1


def tokens_of(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", tag, attributes) and ("end", tag, "") in page order, in linear time.

    Comments, declarations and the content of DROPPED elements are passed over.  A tag ends
    at the first `>` outside quotes; once a quote never closes, tags end at their first `>`
    from there on.  A tag without `>`, and whatever else never closes, ends with the page.
    """
    at, n, trusting = 0, len(page), True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif after in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif after == "/" and (name := _NAME.match(page, lt + 2)):
            end = page.find(">", name.end())
            if end < 0:
                return
            yield "end", name.group().lower(), ""
            at = end + 1
        elif name := _NAME.match(page, lt + 1):
            end = name.end()
            while trusting:
                m = _STOP.search(page, end)
                if not m or m.group() == ">":
                    break
                close = page.find(m.group(), m.end())
                if close < 0:
                    trusting = False
                    break
                end = close + 1
            end = page.find(">", end if trusting else name.end())
            if end < 0:
                return
            tag, attributes = name.group().lower(), page[name.end() : end]
            at = end + 1
            if tag in DROPPED:
                m = _ENDS[tag].search(page, at) or _BODY.search(page, at)
                at = n if not m else m.start() if m.group()[1] != "/" else m.end()
                yield "text", " ", ""
                continue
            yield "start", tag, attributes
        else:
            yield "text", "<", ""
            at = lt + 1


def evidence(tag: str, attributes: str, inside: int) -> int:
    """What an element says of what it holds: 1 article, -1 boilerplate, 0 nothing; `inside` is the landmark around it.  The element's own kind comes before its class words."""
    if tag in GOOD_TAGS:
        return 1
    if tag in BAD_TAGS:
        return 0 if tag == "header" and inside > 0 else -1
    if tag in HEADINGS or tag in ("html", "body") or not attributes:
        return 0
    names = set(_PART.findall(" ".join(x for y in _ATTR.findall(attributes) for x in y).lower()))
    bad = names & (BAD_WORDS - OWN_WORDS if inside > 0 else BAD_WORDS)
    return -1 if bad else 1 if names & GOOD_WORDS else 0


def blocks_of(page: str) -> tuple[list[Block], list[int], list[int]]:
    """Text blocks in page order (references decoded, white space made one space, trimmed, empty ones left out), and by landmark its evidence and the landmark around it (number 0: none)."""
    out: list[Block] = []
    kinds, outer = [0], [0]
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, number, landmark
    block_at, open_at = [0], defaultdict(list)  # places in the stack: of blocks, and by tag
    parts: list[str] = []
    linked = number = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                top = stack[block_at[-1]]
                out.append(Block(text, linked, top[0], stack[block_at[-2]][1] if len(block_at) > 1 else 0, top[2]))
            parts.clear()
            linked = 0

    def close(to):
        while len(stack) > to:
            open_at[stack.pop()[0]].pop()
            if block_at[-1] >= len(stack):
                block_at.pop()

    for kind, what, attributes in tokens_of(page):
        if kind == "text":
            parts.append(what)
            if open_at["a"]:
                linked += len(what)
        elif kind == "start":
            if what == "br":
                parts.append(" ")
                continue
            if what in BLOCKS:
                flush()
                closed = CLOSES.get(what) or ({"p"} if what != "html" else ())
                while stack[block_at[-1]][0] in closed:
                    close(block_at[-1])
            if what in VOID or attributes.endswith("/") and what not in BLOCKS:
                continue
            number += 1
            mark = stack[-1][2]
            if what in BLOCKS and (found := evidence(what, attributes, kinds[mark])):
                kinds.append(found)
                outer.append(mark)
                mark = len(kinds) - 1
            if what in BLOCKS:
                block_at.append(len(stack))
            open_at[what].append(len(stack))
            stack.append((what, number, mark))
        else:
            if what in BLOCKS:
                flush()
            at = open_at.get(what)
            if at and (what in BLOCKS or at[-1] > block_at[-1]):
                close(at[-1])
    flush()
    return out, kinds, outer


def landmarks(blocks: list[Block], kinds: list[int], outer: list[int]) -> list[int]:
    """The landmark that decides for each block (0: none): the nearest, passing over boilerplate ones that hold most of a page without an article.

    A form or a `with-sidebar` around the whole page says nothing of its text.
    """
    held = [0] * len(kinds)
    for b in blocks:
        held[b.mark] += len(b.text)
    has_article = any(k > 0 and h for k, h in zip(kinds, held))
    for i in range(len(kinds) - 1, 0, -1):
        held[outer[i]] += held[i]
    decides = list(range(len(kinds)))
    for i in range(1, len(kinds)):
        if kinds[i] < 0 and not has_article and 2 * held[i] > held[0]:
            decides[i] = decides[outer[i]]
    return [decides[b.mark] for b in blocks]


#: Features of a block's text and place, and the prior mean of their weights (log-odds of being content); landmarks are none of them.
PRIOR = {"bias": -1.2, "link_share": -3.5, "log_words": 0.6, "ends": 0.8, "heading": 0.4, "paragraph": 0.8, "item": -0.5, "rights": -1.5, "parent_share": 1.0, "longest_near": 0.3}
#: Prior means of the smoothness: log-odds that adjacent blocks under one parent, adjacent ones under two, and the next under one parent are alike.
TIES = {"neighbour": 1.0, "distant": 0.2, "kin": 0.8}
#: Bound of a block's own log-odds, and the log-odds that its landmark adds.  Both are capacities of the block itself, so what a
#: landmark says of one block does not depend on how many others it holds: a list of any length stays in its article, comments of
#: any number stay out.  A landmark outweighs a block's own look by 2 at least; only ties to its neighbours can overrule it, block by block.
CLIP, MARK = 4.0, 6.0


def features(blocks: list[Block]) -> np.ndarray:
    n = len(blocks)
    x = np.zeros((n, len(PRIOR)))
    x[:, 0] = 1
    under: dict[int, int] = defaultdict(int)
    for b in blocks:
        under[b.parent] += b.words
    total = sum(under.values())
    size = np.minimum(np.log2([b.words for b in blocks]), 7) - 2 if n else np.zeros(0)
    for i, b in enumerate(blocks):
        r = x[i]
        r[1] = min(1.0, b.linked / len(b.text))
        r[3] = b.text[-1] in ".!?…:;\"'”»。"
        r[4] = b.tag in HEADINGS
        r[5] = b.tag == "p"
        r[6] = b.tag in ("li", "dd", "dt", "td", "th")
        r[7] = "©" in b.text or "All rights" in b.text
        r[8] = 2 * under[b.parent] / total - 1
        r[9] = size[max(0, i - 2) : i + 3].max()
    x[:, 2] = size
    return x


def relations(blocks: list[Block]) -> list[tuple[int, int, str]]:
    """Adjacent blocks, under one parent or two, and the next block under the same parent (DOM proximity)."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, "neighbour" if blocks[i - 1].parent == b.parent else "distant"))
        j = last.get(b.parent)
        if j is not None and j < i - 1:
            out.append((j, i, "kin"))
        last[b.parent] = i
    return out


def max_flow_content(z: np.ndarray, edges: list[tuple[int, int, int]], scale: int = 100, clip: float = 12.0) -> np.ndarray:
    """Which nodes lie on the content side of the minimum cut.

    z: log-odds; a node pays z if it is content and labelled boilerplate, -z the other way
    round.  edges: (i, j, cost of parting them).  Shortest augmenting paths (Dinic's levels).
    """
    n = len(z)
    cap = np.rint(np.clip(z, -clip, clip) * scale).astype(int).tolist()
    if min(cap) > 0 or max(cap) <= 0:
        return np.array([c > 0 for c in cap])
    give, take = [max(c, 0) for c in cap], [max(-c, 0) for c in cap]
    to: list[int] = []
    room: list[int] = []
    around: list[list[int]] = [[] for _ in range(n)]
    for i, j, w in edges:
        around[i].append(len(to))
        to.append(j)
        room.append(w)
        around[j].append(len(to))
        to.append(i)
        room.append(w)
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if give[i])
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            reached = reached or take[i] > 0
            for e in around[i]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return np.array([x >= 0 for x in level])
        arc = [0] * n
        for s in range(n):
            while give[s]:
                path: list[int] = []
                i = s
                while not take[i]:
                    while arc[i] < len(around[i]):
                        e = around[i][arc[i]]
                        if room[e] and level[to[e]] == level[i] + 1:
                            break
                        arc[i] += 1
                    if arc[i] < len(around[i]):
                        path.append(around[i][arc[i]])
                        i = to[path[-1]]
                    elif path:
                        i = to[path.pop() ^ 1]
                        arc[i] += 1
                    else:
                        break
                if not take[i]:
                    break
                push = min([give[s], take[i], *(room[e] for e in path)])
                give[s] -= push
                take[i] -= push
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push


def label_blocks(page: str, model: np.ndarray, hidden: bool = False) -> tuple[list[Block], np.ndarray, np.ndarray]:
    """The blocks of a page, their own log-odds of being content, and which lie on the content side of the minimum cut.

    A block's terminal capacity is the classifier's log-odds of its text and place, and what the
    landmark that decides for it says; blocks are tied to their neighbours and to their kin.
    With `hidden`, landmarks are left out, as on a page of bare divisions.
    """
    blocks, kinds, outer = blocks_of(page)
    if not blocks:
        return [], np.zeros(0), np.zeros(0, bool)
    own = np.clip(features(blocks) @ model[: len(PRIOR)], -CLIP, CLIP)
    ties = dict(zip(TIES, model[len(PRIOR) :]))
    edges = [(i, j, int(100 * ties[how])) for i, j, how in relations(blocks)]
    said = [0] * len(blocks) if hidden else [kinds[m] for m in landmarks(blocks, kinds, outer)]
    return blocks, own, max_flow_content(own + MARK * np.array(said), edges, clip=CLIP + MARK)


def main_text(page: str, model: np.ndarray) -> str:
    blocks, _, keep = label_blocks(page, model)
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def lessons(page: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows and labels of a page's blocks, and by relation how many pairs are alike and how many not.

    Blocks are labelled by the landmark that decides for them; features say nothing of it,
    so what is learnt holds on pages without any.
    """
    blocks, kinds, outer = blocks_of(page)
    if not blocks:
        return np.zeros((0, len(PRIOR))), np.zeros(0), np.zeros((len(TIES), 2))
    y = np.array([kinds[m] for m in landmarks(blocks, kinds, outer)])
    pairs = np.zeros((len(TIES), 2))
    for i, j, how in relations(blocks):
        if y[i] and y[j]:
            pairs[list(TIES).index(how), int(y[i] != y[j])] += 1
    return features(blocks)[y != 0], (y[y != 0] > 0).astype(float), pairs


def fit_model(x: np.ndarray, y: np.ndarray, pairs: np.ndarray, strength: float = 20.0, steps: int = 200) -> np.ndarray:
    """Logistic regression of content on features, kept near PRIOR by a Gaussian of precision `strength`, and the ties: log-odds of pairs being alike, kept near TIES as by `strength` pairs, between 0 and 2."""
    prior = np.array(list(PRIOR.values()))
    w = prior.copy()
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-x @ w))
        hess = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - strength * (w - prior))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    alike = 1 / (1 + np.exp(-np.array(list(TIES.values()))))
    odds = np.log((pairs[:, 0] + strength * alike) / (pairs[:, 1] + strength * (1 - alike)))
    return np.concatenate((w, np.clip(odds, 0.0, 2.0)))


def train(pages: DataFrame, key: str = "page_id", page: str = "html", sample_pages: int = 500, max_lessons: int = 50_000) -> np.ndarray:
    """A model fitted on about `sample_pages` pages drawn by a hash of the key; tasks read the pages, and `max_lessons` rows of numbers at most reach the driver."""
    n = pages.count()
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < int(min(1.0, sample_pages / max(1, n)) * (1 << 20))

    def run(batches):
        for batch in batches:
            for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y, pairs = lessons(p or "")
                rows = [pairs.ravel().tolist(), *np.column_stack((x, y)).tolist()]  # row 0: the pairs
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["h", "i", "v"])

    taught = pages.filter(draw).select(F.xxhash64(F.col(key), F.col(page)).alias("h"), F.col(page)).mapInArrow(run, "h long, i int, v array<double>")
    rows = taught.orderBy("h", "i").limit(max_lessons).select("i", "v").collect()
    v = np.array([r["v"] for r in rows if r["i"]]).reshape(-1, len(PRIOR) + 1)
    pairs = np.array([r["v"] for r in rows if not r["i"]]).reshape(-1, len(TIES), 2).sum(0)
    return fit_model(v[:, :-1], v[:, -1], pairs)


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", sample_pages: int = 500) -> DataFrame:
    """(key, url, text, n_chars): the article of every page, one row per input row.

    Each text block's log-odds of being content become its terminal capacities; edges between
    adjacent blocks, between blocks under one parent and to the landmark element around them
    are the smoothness (label_blocks); the content side of the minimum cut is joined by blank
    lines.  The model is fitted on about `sample_pages` pages drawn by a hash of the key (a
    fixed bound), then broadcast; pages are read whole, of any length, where they are, in
    time that grows with their length.

    Null or empty html, and pages without content, give empty text; an empty table gives no
    rows; markup that never closes ends with the page; of two cuts of one cost the one with
    less content is taken; repeated rows and null keys stay; extra columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(train(pages, key, page, sample_pages))

    def run(batches):
        model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(p, model) if p else "" for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["k", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).alias("url"), F.col(page).alias("p"))
    return rows.mapInArrow(run, "k long, url string, text string, n_chars long").withColumnRenamed("k", key)
