"""HTML extraction: gradient-boosted trees over DOM nodes, and a decoding that keeps ancestors and descendants consistent.

A page becomes a tree whose leaves are text blocks and whose inner nodes are block-level elements. Each node is described by
its subtree (text, links, punctuation, number of blocks), its depth, its siblings, its tag and the tokens of its attributes,
own and inherited. The trees score how likely the node holds main text; decoding picks the most probable set of nodes in
which a node is taken only if its parent is, so no block survives inside a rejected container and none is taken without
its containers.

There are no labelled pages. The training set is built from at most `PAGES` pages of the table: their own paragraphs, links
and boilerplate are laid out anew in varied page structures whose main text is known by construction, and pages that mark
one <article> or <main> themselves are taken as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm.common import stored

PAGES = 240           # pages the training set is made from
VARIANTS = 3
TREES, DEPTH, RATE, BINS = 40, 4, 0.2, 32

# Element kinds of the markup language, and words that sites name their page parts by.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template title textarea select option button svg iframe object canvas audio video map datalist".split())
RAW = frozenset("script style title textarea".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NOT_IN_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
STOPS = frozenset("ul ol dl table body html article section div".split())
GOOD_WORDS = "article body content entry main maintext post story text"
BAD_WORDS = ("ad ads adv advert advertisement advertising alert author banner bar breadcrumb breadcrumbs byline caption comment comments consent cookie "
             "cookies copyright discussion disqus feedback footer form gdpr hdr head header hidden infobox legal links login masthead menu meta modal nav "
             "navbar navigation newsletter notice overlay pager pagination popup privacy promo promoted recommended related replies reply respond "
             "search share sharing side sidebar signup site social sponsor sponsored subscribe tags teaser toolbar top topbar widget")
TAGS = "p h1 h2 h3 li ul ol div article main section nav header footer aside table td tr form figure blockquote pre body dl dd".split()

_GOOD, _BAD = frozenset(GOOD_WORDS.split()), frozenset(BAD_WORDS.split())
_CODE = {t: i + 1 for i, t in enumerate(TAGS)}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PUNCT = re.compile(r"[.,;:!?]")
_MARK = "data-main"


@lru_cache(20_000)
def _attributes(text: str) -> tuple[int, int, bool]:
    """Good and bad tokens of the attributes, and whether the element is hidden."""
    if not text.strip():
        return 0, 0, False
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(text))
    tokens = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower())
    hidden = bool(re.search(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*.?true", text, re.I))
    return sum(t in _GOOD for t in tokens), sum(t in _BAD for t in tokens), hidden


class Page:
    """Nodes in page order: parent, tag code, attributes of each element; leaves carry text."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attrs, self.texts, self.links, self.main = [-1], [0], [""], [None], [0], [False]
        stack: list[tuple[str, int]] = [("", 0)]     # open elements; inline ones share their block's node
        parts: list[str] = []
        linked, silent, anchor, at = 0, 0, 0, 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    self._add(stack[-1][1], 0, "", text, min(linked, len(text)))
                parts.clear()
            linked = 0

        def close(n: int) -> None:
            """Closes all open elements from the n-th on."""
            nonlocal silent, anchor
            for name, _ in stack[n:]:
                silent -= name in SILENT
                anchor -= name == "a"
            if any(name not in INLINE for name, _ in stack[n:]):
                flush()
            del stack[n:]

        for m in _TAG.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at and not silent:
                text = source[at:m.start()]
                parts.append(text)
                if anchor:
                    linked += len(text)
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name = name.lower()
            if m[1] or m[4]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                    if name in INLINE and stack[k][0] not in INLINE:
                        break
                else:
                    if name not in INLINE:
                        flush()
                continue
            if name == "br":
                parts.append(" ")
                continue
            if name in NOT_IN_P or name in CLOSES:
                ends = CLOSES.get(name, ("p",))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        close(k)
                        if name not in ("tr", "td", "th", "dd", "dt") or stack[-1][0] not in ends:
                            break
                    elif stack[k][0] in STOPS or (ends == ("p",) and stack[k][0] not in INLINE):
                        break
            if name in VOID:
                if name not in INLINE:
                    flush()
                continue
            attrs = m[3] if m[2] else m[6]
            if attrs.endswith("/") and name in ("svg", "path"):
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                if name not in INLINE:
                    flush()
                continue
            if name in SILENT:
                silent += 1
            if name == "a":
                anchor += 1
            if name in INLINE:
                stack.append((name, stack[-1][1]))
            else:
                flush()
                stack.append((name, self._add(stack[-1][1], _CODE.get(name, len(TAGS) + 1), attrs, None, 0)))
        if at < len(source) and not silent:
            parts.append(source[at:])
        flush()

    def _add(self, parent: int, tag: int, attrs: str, text: str | None, links: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.texts.append(text)
        self.links.append(links)
        self.main.append(self.main[parent] or _MARK in attrs)
        if "data-out" in attrs:
            self.main[-1] = False
        elif text is None and self.main[parent] is False and _MARK not in attrs:
            self.main[-1] = False
        return len(self.parent) - 1


FEATURES = 24 + len(TAGS) + 2


def features(page: Page) -> np.ndarray:
    """One row per node."""
    n = len(page.parent)
    parent, tag = np.array(page.parent), np.array(page.tag)
    parent[0] = 0
    leaf = np.array([t is not None for t in page.texts])
    length = np.array([len(t) if t else 0 for t in page.texts], float)
    words = np.array([t.count(" ") + 1 if t else 0 for t in page.texts], float)
    punct = np.array([len(_PUNCT.findall(t)) if t else 0 for t in page.texts], float)
    linked = np.array(page.links, float)
    marks = np.array([_attributes(a) for a in page.attrs], float).reshape(n, 3)
    depth = np.zeros(n)
    inherited = np.zeros((n, 6))   # good, bad, hidden, boilerplate element, article element, paragraph-like element
    own = np.c_[marks, np.isin(tag, [_CODE[t] for t in ("nav", "header", "footer", "aside", "form")]),
                np.isin(tag, [_CODE["article"], _CODE["main"]]), np.isin(tag, [_CODE[t] for t in ("p", "h1", "h2", "h3", "blockquote", "pre")])]
    index, last = np.zeros(n), {}
    for i in range(1, n):
        p = page.parent[i]
        depth[i] = depth[p] + 1
        inherited[i] = inherited[p] + own[p]
        index[i] = last.get(p, 0)
        last[p] = index[i] + 1
    sums = np.c_[length, words, punct, linked, leaf, np.ones(n)]
    for i in range(n - 1, 0, -1):
        sums[page.parent[i]] += sums[i]
    total = np.maximum(sums[0], 1.0)
    family = np.array([last.get(page.parent[i], 1) for i in range(n)], float)
    before = np.cumsum(length) - length
    same = np.zeros(n)
    pairs, back = np.unique(np.c_[parent, tag], axis=0, return_inverse=True)
    same[:] = np.bincount(back.ravel(), minlength=len(pairs))[back.ravel()]
    kin = np.zeros(n)
    np.add.at(kin, parent[1:], sums[1:, 0])
    x = np.zeros((n, FEATURES), np.float32)
    x[:, 0] = np.log1p(sums[:, 0])
    x[:, 1] = sums[:, 3] / np.maximum(sums[:, 0], 1)
    x[:, 2] = sums[:, 2] / np.maximum(sums[:, 1], 1)
    x[:, 3] = sums[:, 1] / np.maximum(sums[:, 4], 1)
    x[:, 4] = sums[:, 0] / sums[:, 5]
    x[:, 5] = sums[:, 0] / total[0]
    x[:, 6] = np.log1p(sums[:, 4])
    x[:, 7] = depth
    x[:, 8] = index
    x[:, 9] = family
    x[:, 10] = same / np.maximum(family, 1)
    x[:, 11] = before / total[0]
    x[:, 12] = sums[:, 0] / np.maximum(kin[parent], 1)
    x[:, 13:16] = own[:, :3]
    x[:, 16:22] = inherited
    x[:, 22] = leaf
    x[:, 23] = own[:, 3]
    x[np.arange(n), 24 + np.where(leaf, tag[parent], tag)] = 1
    return x


# ---------------------------------------------------------------- gradient boosting

class Boosted:
    """Boosted complete trees for the log-odds; thresholds come from `BINS` quantiles a feature."""

    def __init__(self, start: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.start, self.feature, self.threshold, self.value = start, feature, threshold, value

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2 ** DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
    """Newton boosting on the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    width, wide = BINS, x.shape[1]
    mean = np.average(y, weights=weight)
    start = float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))
    score = np.full(len(y), start)
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = (y - p) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            base, count = 2 ** level - 1, 2 ** level
            cell = (((at - base)[:, None] * wide + np.arange(wide)) * width + codes).ravel()
            size = count * wide * width
            gs = np.bincount(cell, np.repeat(g, wide), size).reshape(count, wide, width).cumsum(2)
            hs = np.bincount(cell, np.repeat(h, wide), size).reshape(count, wide, width).cumsum(2)
            gt, ht = gs[..., -1:], hs[..., -1:]
            gain = gs ** 2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt ** 2 / (ht + 1)
            gain[(hs < 1) | (ht - hs < 1)] = 0
            flat = gain.reshape(count, -1)
            best = flat.argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), width)
                if flat[k, best[k]] > 1e-6 and b < len(cuts[f]):
                    feature[base + k], threshold[base + k] = f, cuts[f][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        spot = at - inner
        value = RATE * np.bincount(spot, g, leaves) / (np.bincount(spot, h, leaves) + 1)
        score += value[spot]
        trees.append((feature, threshold, value))
    return Boosted(start, *(np.stack(z) for z in zip(*trees)))


# ---------------------------------------------------------------- training set

def _paragraphs(page: Page) -> tuple[list[str], list[str]]:
    """Texts under the page's own article or main element, and the others."""
    inside = [False] * len(page.parent)
    for i in range(1, len(page.parent)):
        inside[i] = inside[page.parent[i]] or page.tag[i] in (_CODE["article"], _CODE["main"])
    return ([t for t, k in zip(page.texts, inside) if t and k], [t for t, k in zip(page.texts, inside) if t and not k])


def _laid_out(rng: np.random.Generator, title: str, body: list[str], rest: list[str], foreign: list[str]) -> str:
    """A page of one of many structures. The main text stands in the element marked `data-main`."""
    e = html.escape

    def pick(*options: str) -> str:
        return options[rng.integers(len(options))]

    def some(texts: list[str], most: int) -> list[str]:
        return [texts[rng.integers(len(texts))] for _ in range(rng.integers(1, most + 1))] if texts else ["more"]

    def part(options: str, inner: str) -> str:
        tag, _, attrs = pick(*options.split("|")).partition(" ")
        return f"<{tag} {attrs} data-out>{inner}</{tag}>"

    def links(most: int = 8) -> str:
        items = "".join(f'<li><a href="#">{e(" ".join(t.split()[:3]))}</a></li>' for t in some(rest + foreign, most))
        return f"<ul>{items}</ul>" if rng.random() < 0.8 else "".join(f'<a href="#">{e(t[:30])}</a> ' for t in some(rest, most))

    def prose(most: int = 3) -> str:
        tag = pick("p", "p", "div", "li", "span")
        return "".join(f"<{tag}>{e(t)}</{tag}>" for t in some(foreign if rng.random() < 0.6 else rest, most))

    def paragraph(t: str) -> str:
        r = rng.random()
        if r < 0.5:
            return f"<p>{e(t)}</p>"
        if r < 0.6:
            return f"<p><b>{e(t)}<br>"
        if r < 0.7:
            return f"<p>{e(t)}"
        if r < 0.84:
            level = pick("h2", "h2", "h3", "h4")
            return f"<{level}>{e(t[:60])}</{level}><p>{e(t)} <a href='#'>{e(t[:12])}</a></p>"
        if r < 0.91:
            return f"<ul><li>{e(t)}</li><li>{e(t[:40])}</li></ul>"
        tag = pick("blockquote", "div", "pre", "td")
        return f"<{tag}>{e(t)}</{tag}>"

    top = pick("h1", "h1", "h2", "h3")
    head = [f"<{top}>{e(title)}</{top}>"] if rng.random() < 0.8 else []
    inner = [*head, *map(paragraph, body)]
    extras = [("div class=share|div class=\"social-links\"|p class=byline", lambda: links(4)),
              ("div class=ad|div class=\"advert box\"|aside|div id=promo", lambda: prose(1)),
              ("section id=comments|div class=comments|div class=\"reader-comments\"|ol class=commentlist",
               lambda: "".join(f'<div class="comment"><p>{e(t)}</p></div>' for t in some(foreign, 5))),
              ("form action=#|div class=newsletter", lambda: f"<label>{e(some(rest, 1)[0])}</label><input><p>{e(some(rest, 1)[0])}</p>")]
    for options, made in extras:
        if rng.random() < 0.25:
            at = len(inner) if "comment" in options else int(rng.integers(len(inner) + 1))
            if at and not inner[at - 1].endswith(">"):
                at = len(inner)
            inner.insert(at, part(options, made()))
    shell = pick("article", "article", "main", "div class=content", "div id=main-content", "div class=\"post-body\"", "section class=story", "div class=entry", "div", "section", "td")
    tag, _, attrs = shell.partition(" ")
    main = f"<{tag} {attrs} data-main>{''.join(inner)}</{tag}>"
    if rng.random() < 0.3:
        main = f"<div class={pick('wrapper', 'container', 'page', 'row')}>{main}</div>"
    before = [("nav|div class=menu|div id=navigation|ul class=nav|div", lambda: links()),
              ("header|div id=header|div class=masthead", lambda: f"<h1>{e(' '.join(some(rest, 1)[0].split()[:4]))}</h1>" + links(4)),
              ("div class=ad|div class=banner|div id=advert", lambda: prose(1)),
              ("div class=\"cookie-notice\"|div class=notice|div role=alert", lambda: prose(1)),
              ("aside|div class=sidebar|div id=side", lambda: links() + prose(2))]
    after = [("section id=comments|div class=comments|div id=disqus|section class=\"user-comments\"",
              lambda: "".join(f'<div class="{pick("comment", "reply", "post")}"><p>{e(t)}</p></div>' for t in some(foreign, 6))),
             ("aside|div class=sidebar|div class=related|div class=widget", lambda: links() + prose(2)),
             ("form action=#|div class=\"signup-form\"", lambda: f"<p>{e(some(rest, 1)[0])}</p><input>"),
             ("footer|footer|div id=footer|div class=copyright", lambda: prose(2) if rng.random() < 0.5 else e(some(rest, 1)[0]))]
    top = "".join(part(o, f()) for o, f in before if rng.random() < 0.5)
    end = "".join(part(o, f()) for o, f in after if rng.random() < 0.5)
    return f"<html><head><title>{e(title)}</title></head><body>{top}{main}{end}</body></html>"


def _holds_main(page: Page) -> np.ndarray:
    """Whether the subtree of each node has main text."""
    y = np.array([bool(t) and m for t, m in zip(page.texts, page.main)])
    for i in range(len(y) - 1, 0, -1):
        y[page.parent[i]] |= y[i]
    return y.astype(float)


def train(sources: list[str]) -> Boosted:
    """Trees fitted on the given pages and on pages laid out from their texts."""
    rng = np.random.default_rng(5)
    parsed = [Page(s) for s in sources]
    parts = [_paragraphs(p) for p in parsed]
    foreign = [t for body, _ in parts for t in body[:6]]
    made = []
    for source, page, (body, rest) in zip(sources, parsed, parts):
        if not body:
            body = sorted(rest, key=len)[-8:]
        if not body:
            continue
        title = body[0][:60]
        for _ in range(VARIANTS):
            low = int(rng.integers(len(body)))
            made.append(Page(_laid_out(rng, title, body[low:low + int(rng.integers(1, 12))], rest, foreign)))
        if sum(t in (_CODE["article"], _CODE["main"]) for t in page.tag) == 1:
            made.append(Page(re.sub(r"<(article|main)\b", r"<\1 data-main", source, flags=re.I)))
    if not made:
        return Boosted(0.0, *(np.zeros((0, 1)),) * 3)
    x = np.concatenate([features(p) for p in made])
    y = np.concatenate([_holds_main(p) for p in made])
    leaf = x[:, 22] > 0
    return boost(x, y, np.where(leaf, 1 + x[:, 0] / 4, 1.0))


# ---------------------------------------------------------------- extraction

def decode(page: Page, log_odds: np.ndarray) -> list[bool]:
    """The most probable choice of nodes in which a node is taken only together with its parent."""
    n = len(page.parent)
    value = log_odds.tolist()
    for i in range(n - 1, 0, -1):
        if value[i] > 0:
            value[page.parent[i]] += value[i]
    taken = [True] * n
    for i in range(1, n):
        taken[i] = taken[page.parent[i]] and value[i] > 0
    return taken


def main_texts(sources: list[str], model: Boosted) -> list[str]:
    out: list[str] = []
    for k in range(0, len(sources), 64):
        pages = [Page(s) for s in sources[k:k + 64]]
        x = [features(p) for p in pages]
        odds = np.split(model.log_odds(np.concatenate(x)), np.cumsum([len(z) for z in x])[:-1]) if x else []
        out += ["\n".join(t for t, take in zip(p.texts, decode(p, o)) if t and take) for p, o in zip(pages, odds)]
    return out


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches))
    if len(rows):
        m = train(rows.sort_values(["pick", "html"])["html"].tolist())
        yield pd.DataFrame({"start": [m.start], "shape": [len(m.feature)], "feature": [m.feature.astype(np.int64).tobytes()],
                            "threshold": [m.threshold.astype(float).tobytes()], "value": [m.value.astype(float).tobytes()]})


def fit(pages: DataFrame) -> Boosted:
    """Trees from the `PAGES` pages of least hash (a sample that does not depend on the layout of the table)."""
    pick = F.xxhash64("page_id", "html")
    rows = pages.filter(F.length("html") > 0).select(pick.alias("pick"), "html").orderBy("pick").limit(PAGES)
    found = stored(rows.repartition(1).mapInPandas(_fit, "start double, shape int, feature binary, threshold binary, value binary")).collect()
    if not found or not found[0]["shape"]:
        return Boosted(0.0, np.zeros((0, 2 ** DEPTH - 1), np.int64), np.zeros((0, 2 ** DEPTH - 1)), np.zeros((0, 2 ** DEPTH)))
    r, n = found[0], found[0]["shape"]
    return Boosted(r["start"], np.frombuffer(r["feature"], np.int64).reshape(n, -1), np.frombuffer(r["threshold"]).reshape(n, -1), np.frombuffer(r["value"]).reshape(n, -1))


def extract(pages: DataFrame, model: Boosted) -> DataFrame:
    """page_id, url, text: the main text of each page, its blocks in page order, one a line.

    Character references are decoded, white space inside a block is one blank; nothing else is changed or left out of a
    block. Null or empty pages and pages without main text: empty text. Any markup is read, however broken. Rows are
    independent, so repeats give repeats and an empty table stays empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts([s or "" for s in batch.column("html").to_pylist()], model)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    slim = pages.select("page_id", "url", "html")
    return slim.mapInArrow(run, slim.select("page_id", "url", F.col("html").alias("text")).schema)
