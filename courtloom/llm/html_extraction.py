"""Main text of web pages by a minimum cut over their text blocks.

The project has no records of web pages, so this operator is general: it takes pages (page_id, url, html).
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtloom.llm.common import bounded_sample

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea)\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))"
                    r"|</?[a-zA-Z](?:[^>\"']|\"[^\"<>]*\"|'[^'<>]*')*>|</?[a-zA-Z][^>]*>|<[!?][^>]*>", re.S | re.I)
_PAIR = re.compile(r"<(/?)(title|noscript|template|svg|math|iframe|object|select)\b([^>]*)>", re.I)
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_HINT = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[\s\x1c-\x1f\x85]+")
#: HTML's own classes of elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
                    "time tt u var wbr".split())
_ASIDE = frozenset("nav footer aside header form menu dialog button fieldset".split())
_BODY = frozenset("article main".split())
_HIDDEN = frozenset("head title select svg math".split())
_IN_HEAD = frozenset("head title base link meta script style noscript template".split())
_IN_SELECT = frozenset("select option optgroup hr div".split())
#: Tags that end an unclosed svg or math, as in HTML's rules, and HTML's sections.
_NOT_IN_DRAWING = frozenset("html body head article section main nav header footer aside form figure details fieldset address blockquote center dd div dl dt h1 h2 h3 "
                            "h4 h5 h6 hr img li menu meta ol p pre table ul tr td th".split())
_DROP = frozenset("button option input".split())
_CLOSED_BY_BLOCK = frozenset("p".split())
_BAD_HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|side-?bar|menu|nav\w*|breadcrumbs?|"
                       r"footer|header|masthead|comments?|replies|share|sharing|social|related|newsletter|subscribe|pagination|pager|widget|toolbar|search)(?:$|[\s_-])", re.I)
_GOOD_HINT = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|body|main|text)(?:$|[\s_-])", re.I)


@dataclass
class Block:
    """A run of text between block tags. place: path of container numbers; cue: what landmarks and names say (-1 .. 1)."""

    parts: list[str] = field(default_factory=list)
    place: tuple[int, ...] = ()
    cue: float = 0.0
    tag: str = ""
    linked: int = 0
    text: str = ""


def _closed(page: str) -> dict[int, int]:
    """End of each element of _PAIR that has an end tag of its own, by its start."""
    open_at: dict[str, list[int]] = {}
    out = {}
    for m in _PAIR.finditer(page):
        waiting = open_at.setdefault(m.group(2).lower(), [])
        if m.group(1):
            if waiting:
                out[waiting.pop()] = m.end()
        elif not m.group(3).endswith("/"):
            waiting.append(m.start())
    return out


def _ends(hidden: str, tag: str) -> bool:
    """Whether an open hidden element ends before a start tag that cannot stand in it."""
    if hidden == "title":
        return True
    return tag in _NOT_IN_DRAWING if hidden in ("svg", "math") else tag not in (_IN_HEAD if hidden == "head" else _IN_SELECT)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, with markup, comments, scripts and the head left out. Unclosed and stray tags are borne:
    an end tag closes the nearest open element of its name, a block tag closes an open paragraph, and a hidden element
    without an end tag ends at the first tag that cannot stand in it."""
    out: list[Block] = []
    stack: list[tuple[str, int, float, int]] = []        # tag, number, cue, 1 within article or main, 2 within another landmark
    now, number, links, at, ends = Block(), 0, 0, 0, _closed(page)

    def close() -> None:
        nonlocal now
        if now.parts:
            now.text = _SPACE.sub(" ", entities.unescape("".join(now.parts))).strip()
            if now.text:
                out.append(now)
        now = Block(place=tuple(x[1] for x in stack), cue=stack[-1][2] if stack else 0.0, tag=stack[-1][0] if stack else "")

    def text(part: str) -> None:
        if stack and stack[-1][0] == "head" and part.strip():
            stack.pop()
            close()
        if part and not any(x[0] in _HIDDEN for x in stack) and not any(x[0] in _DROP for x in stack[-3:]):
            now.parts.append(part)
            if links:
                now.linked += len(part)

    for m in _TOKEN.finditer(page):
        if m.start() < at:              # within a hidden element
            continue
        text(page[at : m.start()])
        at = max(m.end(), ends.get(m.start(), 0))
        if m.start() in ends:
            continue
        name = _NAME.match(m.group())
        if m.group(1) or not name:
            continue
        end, tag = name.group(1), name.group(2).lower()
        if tag == "a":
            links = 0 if end else 1
        if not end and stack:
            k = next((k for k, x in enumerate(stack) if x[0] in _HIDDEN and _ends(x[0], tag)), None) if tag not in _INLINE or any(x[0] in ("head", "title") for x in stack) else None
            if k is not None:
                del stack[k:]
                close()
        if tag == "br":
            now.parts.append(" ")
        if tag in _INLINE:
            continue
        if end:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None:
                links = 0
                del stack[k:]
            close()
            continue
        while stack and stack[-1][0] in _CLOSED_BY_BLOCK:
            stack.pop()
        if tag in ("li", "option", "td", "th", "tr", "dt", "dd") and stack and stack[-1][0] == tag:
            stack.pop()
        if tag not in _VOID and not m.group().endswith("/>"):
            number += 1
            cue, within = (stack[-1][2], stack[-1][3]) if stack else (0.0, 0)
            hints = "" if tag in ("html", "body", "main") else " ".join(x for h in _HINT.findall(m.group()) for x in h if x)
            bad, good = tag in _ASIDE or bool(_BAD_HINT.search(hints)), tag in _BODY or bool(_GOOD_HINT.search(hints))
            if bad and not (tag == "header" and cue > 0):
                cue = -1.0
            elif good and (cue >= 0 or tag in _BODY and not within):     # a badly named wrapper does not hide what it wraps
                cue = 1.0
            if not within:
                within = 1 if tag in _BODY else 2 if tag in _ASIDE and tag != "form" and cue < 0 else 0
            stack.append((tag, number, cue, within))
        close()
    text(page[at:])
    close()
    return out


FEATURES = ("words", "chars", "link_share", "sentences", "commas", "mean_word", "is_paragraph", "is_heading", "is_item", "from_start", "from_end")


def block_features(blocks: list[Block]) -> np.ndarray:
    """What the classifier sees of a block; landmarks and names are not among it, as they give its labels."""
    rows = []
    for k, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        rows.append((np.log1p(words), np.log1p(len(b.text)), min(1.0, b.linked / max(len(b.text), 1)), min(3, b.text.count(". ") + b.text.endswith(".")),
                     min(3, b.text.count(",")), min(12, len(b.text) / words) / 4, b.tag == "p", b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
                     b.tag in ("li", "td", "dd"), min(k, 8) / 8, min(len(blocks) - 1 - k, 8) / 8))
    return np.array(rows, float).reshape(-1, len(FEATURES))


@dataclass(frozen=True)
class BlockModel:
    weights: tuple[float, ...]
    bias: float

    def content(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(x @ np.array(self.weights) + self.bias, -8, 8)))


def _least_cut(source: np.ndarray, sink: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Nodes on the source side of a minimum cut: capacities from the source and to the sink, and undirected edges.

    Blocking flows on level graphs. Only the smaller terminal capacity of a node can be a bottleneck, so the common part
    of both passes straight through."""
    n = len(source)
    s, t, through = n, n + 1, np.minimum(source, sink)
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, cap = [], []

    def link(u: int, v: int, forth: float, back: float) -> None:
        head[u].append(len(to))
        to.append(v)
        cap.append(forth)
        head[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in range(n):
        a, b = source[i] - through[i], sink[i] - through[i]
        if a > 0:
            link(s, i, a, 0.0)
        elif b > 0:
            link(i, t, b, 0.0)
    for u, v, c in edges:
        link(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return np.array([level[i] >= 0 for i in range(n)])
        at, path = [0] * (n + 2), []
        while True:
            u = to[path[-1]] if path else s
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                path = path[: next(k for k, e in enumerate(path) if cap[e] <= 1e-9)]
                continue
            while at[u] < len(head[u]):
                e = head[u][at[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(head[u]):
                path.append(head[u][at[u]])
            elif path:
                at[to[path.pop() ^ 1]] += 1
            else:
                break


def label_blocks(blocks: list[Block], model: BlockModel, cue_cost: float = 12.0, next_cost: float = 0.4, near_cost: float = 0.8) -> np.ndarray:
    """Content or boilerplate for each block. Terminal capacities are the classifier's costs and those of landmarks;
    neighbours in the page are joined by `next_cost`, and by up to `near_cost` more the longer the path of elements they
    share, as long as no landmark parts them."""
    p = model.content(block_features(blocks))
    cue = np.array([b.cue for b in blocks])
    source = -np.log(1 - p) + cue_cost * (cue > 0)
    sink = -np.log(p) + cue_cost * (cue < 0)
    edges = []
    for k in range(len(blocks) - 1):
        a, b = blocks[k], blocks[k + 1]
        if a.cue * b.cue < 0:
            continue
        shared = 0
        for x, y in zip(a.place, b.place):
            if x != y:
                break
            shared += 1
        edges.append((k, k + 1, next_cost + near_cost * shared / max(len(a.place), len(b.place), 1)))
    return _least_cut(source, sink, edges)


def main_text(page: str | None, model: BlockModel) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    keep = label_blocks(blocks, model)
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def fit_block_model(pages: DataFrame, bound: int = 2_000, steps: int = 25, ridge: float = 1.0) -> BlockModel:
    """Logistic regression on the blocks of about `bound` pages at most, chosen by a hash of their id. Blocks under a
    landmark (article, main, nav, footer, names of adverts, comments and so on) label themselves; the others, and pages
    of one kind of block only, teach nothing. Without both kinds, long blocks with few links count as content."""
    rows = bounded_sample(pages.select("page_id", "html"), F.col("page_id"), bound)

    @F.pandas_udf("array<array<double>>")
    def rows_of(htmls: pd.Series) -> pd.Series:
        out = []
        for h in htmls:
            blocks = blocks_of(h or "")
            out.append([[*map(float, x), float(b.cue > 0)] for x, b in zip(block_features(blocks), blocks, strict=True) if b.cue])
        return pd.Series(out, dtype=object)

    totals = rows.select(F.explode(rows_of("html")).alias("x")).groupBy("x").agg(F.count("*").alias("n")).toPandas()
    if len(totals):
        totals = totals.assign(key=totals["x"].map(tuple)).sort_values("key")
        data, n = np.array(totals["x"].tolist(), float), totals["n"].to_numpy(float)
        x, y = np.column_stack([data[:, :-1], np.ones(len(data))]), data[:, -1]
    if not len(totals) or y.min() == y.max():
        return BlockModel((1.0, 0.0, -6.0, 0.5, 0.3, 0.0, 1.0, 0.0, -1.0, 0.0, 0.0), -3.0)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (n * (p - y)) + ridge * w)
    return BlockModel(tuple(map(float, w[:-1])), float(w[-1]))


def extract_main_text(pages: DataFrame, model: BlockModel) -> DataFrame:
    """The columns of `pages` and `text`: the main text of the whole html (null or empty: empty text), one line for each
    block. Each page is labelled alone, so repeated rows give equal texts; a clashing column is replaced."""
    @F.pandas_udf("string")
    def main(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, model) for h in htmls], dtype=object)

    return pages.withColumn("text", main("html"))
