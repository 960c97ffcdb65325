"""Operator 2: main text of HTML pages by gradient-boosted trees over DOM nodes, with hierarchical decoding.

The trees give each node the probability that its subtree holds main text. Decoding then takes the likeliest labelling in which no node is kept
under one that is dropped. Training labels come from pages whose own semantic tags part the article from the rest, set anew in many layouts.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .dom import GROUP, Page, features, marked, read

#: Pages that training texts are taken from (the smallest hashes of page_id), and layouts made of them, at most.
TRAIN_PAGES, LAYOUTS = 150, 1000
#: Longer pages give no training texts, so that what the driver gets is bounded.
TRAIN_CHARS = 400_000
#: Share of layouts that hold nothing but the article, and again of those whose article stands in the body itself.
BARE = 0.08

# Layouts of training pages; {} takes the text.
MAIN = ("<article{y}>{}</article>", "<main{y}>{}</main>", '<div class="content"{y}>{}</div>', '<div class="entry-content"{y}>{}</div>', '<div id="main"><div class="post"{y}>{}</div></div>', '<section class="story-body"{y}>{}</section>', "<main><article{y}>{}</article></main>", '<div class="x1"><div class="x2"{y}>{}</div></div>', "<div><div{y}>{}</div></div>", '<table><tr><td{y}>{}</td></tr></table>')
MENUS = ("<nav>{}</nav>", '<div class="menu">{}</div>', '<ul class="nav">{}</ul>', '<div id="navbar">{}</div>', '<div class="breadcrumbs">{}</div>', "<header>{}</header>", '<div class="x3">{}</div>')
HEADS = ("<header>{}</header>", '<div id="header">{}</div>', '<div class="masthead">{}</div>', '<div class="topbar"><p>{}</p></div>')
SIDES = ("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="right-rail">{}</div>', '<div class="related"><h3>{}</h3></div>', '<div class="widget">{}</div>')
ADS = ('<div class="ad">{}</div>', '<div class="advert"><p>{}</p></div>', '<div class="banner">{}</div>', '<ins class="adsbygoogle">{}</ins>', '<section class="promo"><p>{}</p></section>', '<div class="sponsored">{}</div>')
NOTICES = ('<div class="cookie-notice"><p>{}</p></div>', '<div id="consent">{}</div>', '<div class="alert" role="alert">{}</div>', '<div class="notice">{}</div>', '<div role="dialog" class="modal"><p>{}</p></div>')
COMMENTS = ('<section class="comments"><h3>Comments</h3>{}</section>', '<div id="comments">{}</div>', '<ol class="commentlist">{}</ol>', '<div id="disqus_thread">{}</div>')
COMMENT = ('<div class="comment"><p>{}</p></div>', '<li class="comment"><p>{}</p></li>', "<div><b>{}</b></div>", "<p>{}</p>")
FORMS = ('<form action="/s"><label>{}</label><input name="q"></form>', '<form class="newsletter"><p>{}</p><input type="email"></form>', '<div class="login"><form><fieldset><legend>{}</legend></fieldset></form></div>')
FEET = ("<footer>{}</footer>", '<div id="footer">{}</div>', '<div class="site-footer"><p>{}</p></div>', '<div class="copyright">{}</div>')
SHARES = ('<div class="share">{}</div>', '<ul class="social">{}</ul>')


class BoostedTrees:
    """Gradient-boosted trees for the logistic loss on histograms of feature bins (numpy)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 5.0, ridge: float = 1.0) -> None:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
        b = self._binned(x)
        self.prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        raw = np.full(len(y), self.prior)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, bins, dtype=np.int64)
            for level in range(depth):
                first, n = 2**level - 1, 2**level
                best = np.full(n, 1e-9)
                local = at - first
                for f in range(x.shape[1]):
                    cell = local * (bins + 1) + b[:, f]
                    gs, hs = (np.bincount(cell, weights=v, minlength=n * (bins + 1)).reshape(n, -1) for v in (g, h))
                    gl, hl = gs.cumsum(axis=1)[:, :-1], hs.cumsum(axis=1)[:, :-1]
                    gt, ht = gs.sum(axis=1, keepdims=True), hs.sum(axis=1, keepdims=True)
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    gain[(hl < least * 0.05) | (ht - hl < least * 0.05)] = 0
                    k = gain.argmax(axis=1)
                    won = gain[np.arange(n), k] > best
                    best[won] = gain[np.arange(n), k][won]
                    feature[first : first + n][won], cut[first : first + n][won] = f, k[won]
                at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - (2**depth - 1)
            value = -rate * np.bincount(leaf, weights=g, minlength=2**depth) / (np.bincount(leaf, weights=h, minlength=2**depth) + ridge)
            self.trees.append((feature, cut, value))
            raw = raw + value[leaf]
        self.depth = depth

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1).astype(np.int16)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, rows, raw = self._binned(x).ravel(), np.arange(len(x)) * x.shape[1], np.full(len(x), self.prior)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows + feature[at]] > cut[at])
            raw += value[at - (len(feature))]
        return raw


def decode(page: Page, odds: list[float]) -> list[bool]:
    """The likeliest labelling of the nodes in which a kept node has kept ancestors only."""
    n = len(odds)
    gain = list(odds)  # log-odds of keeping a node plus its children's best, given that it is kept
    for i in range(n - 1, -1, -1):
        if page.parent[i] >= 0 and gain[i] > 0:
            gain[page.parent[i]] += gain[i]
    keep = [False] * n
    for i in range(n):
        keep[i] = gain[i] > 0 and (page.parent[i] < 0 or keep[page.parent[i]])
    return keep


def kept(page: Page, odds: list[float]) -> list[bool]:
    """decode, but for pages without any element: there nothing parts one text from another, and all of it stays."""
    text = GROUP["#text"]
    return [True] * len(odds) if all(g == text for g in page.group) else decode(page, odds)


def main_text(page: Page, keep: list[bool]) -> str:
    return "\n\n".join([t for t, k in zip(page.text, keep, strict=True) if k and t])


def _semantic(page: Page) -> tuple[list[str], list[str]]:
    """Texts inside article or main, and all others, by the page's semantic tags and advert classes."""
    inside, off = 1 << 16 + GROUP["article"], sum(1 << 16 + GROUP[t] for t in ("nav", "footer", "aside", "form")) | 0b1111111100
    runs = [(t, a) for t, a, g in zip(page.text, page.above, page.group, strict=True) if g == GROUP["#text"]]
    return [t for t, a in runs if a & inside and not a & off], [t for t, a in runs if not a & inside or a & off]


def layouts(pages: list[tuple[list[str], list[str]]], number: int = LAYOUTS, seed: int = 11) -> list[str]:
    """Training pages: the texts of the given pages set in varied layouts, the main ones under a training mark."""
    rng = random.Random(seed)
    good = [m for m, _ in pages if m]
    other = [t for _, o in pages for t in o] or ["Home", "About us", "All rights reserved"]
    prose = [t for m in good for t in m]
    out = []

    def some(k: int, source: list[str]) -> list[str]:
        return [html.escape(rng.choice(source), quote=False) for _ in range(k)]

    def link_list(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{w.split(" ")[0]}</a></li>' for i, w in enumerate(some(k, other))) + "</ul>"

    def short(k: int = 1) -> str:
        return " ".join(" ".join(t.split(" ")[: rng.randint(3, 25)]) for t in some(k, prose + other))

    def words(few: int) -> str:
        """The first words of a text, one to so many."""
        return " ".join(some(1, prose)[0].split(" ")[: rng.randint(1, few)])

    def block(t: str) -> str:
        """A part of an article: mostly the paragraph t, else something else with it or with a few words."""
        return rng.choices(
            (f"<p><b>{t}<br>", f"<p>{t}</p>", f"<h{rng.randint(1, 3)}>{words(5)}</h2>", f"<ul><li>{t}</li></ul>", f"<blockquote>{t}</blockquote>", f"<div>{t}</div>", f"<p>{words(8)}</p>", items(), table(t)),
            (12, 58, 6, 4, 4, 4, 8, 8, 8),
        )[0]

    def items() -> str:
        tag = rng.choice(("ul", "ol"))
        return f"<{tag}>" + "".join(f"<li>{words(rng.choice((2, 6, 15)))}</li>" for _ in range(rng.randint(1, 6))) + f"</{tag}>"

    def table(t: str) -> str:
        wide, cell = rng.randint(1, 4), rng.choice((2, 6, 25))
        rows = ["".join(f"<td>{words(cell) if rng.random() < 0.9 else t}</td>" for _ in range(wide)) for _ in range(rng.randint(1, 5))]
        head = ["".join(f"<th>{words(2)}</th>" for _ in range(wide))] if rng.random() < 0.5 else []
        return "<table>" + "".join(f"<tr>{r}</tr>" for r in head + rows) + "</table>"

    foreign = lambda part: re.sub(r"^<(\w+)", r"<\1 data-n", part)

    for _ in range(number if good else 0):
        main = [html.escape(t, quote=False) for t in rng.choice(good)][: rng.choice((rng.randint(1, 2), rng.randint(1, 14), rng.randint(1, 14)))]
        body = [f"<h1>{main[0][:60]}</h1>"] if rng.random() < 0.8 else []
        body += [block(t) for t in main]
        for _ in range(rng.choice((0, 1, 1, 2)) if len(main) > 2 else 0):  # adverts and sharing within the article
            body.insert(rng.randint(1, len(body)), foreign(rng.choice(ADS + SHARES + NOTICES + SIDES).format(short())))
        where = rng.random()
        if where < BARE:  # an article, a body or a few tags and nothing else
            inner = "".join(body[: rng.randint(1, 4)] if rng.random() < 0.5 else body)
            out.append(rng.choice(("<article data-y>{}</article>", "<html><body data-y>{}</body></html>", "<body data-y>{}", "<div data-y>{}</div>", "<main data-y>{}</main>", '<html><body><div class="content" data-y>{}</div></body></html>')).format(inner))
            continue
        in_body = where < 2 * BARE  # the article's parts stand in the body itself
        article = "".join(body) if in_body else rng.choice(MAIN[:3] if rng.random() < 0.3 else MAIN).replace("{y}", " data-y").format("".join(body))
        before, after = [], []
        for chance, kinds, make in ((0.85, MENUS, lambda: link_list(rng.randint(3, 9))), (0.4, HEADS, short), (0.5, ADS, lambda: short(rng.randint(1, 2))), (0.35, NOTICES, short), (0.3, FORMS, short), (0.3, SIDES, lambda: rng.choice((link_list(5), short(2), f"<p>{short(2)}</p>")))):
            if rng.random() < chance:
                before.append(rng.choice(kinds).format(make()))
        for chance, kinds, make in ((0.4, COMMENTS, lambda: "".join(rng.choice(COMMENT).format(short(rng.randint(1, 3))) for _ in range(rng.randint(1, 5)))), (0.35, SIDES, lambda: rng.choice((link_list(5), short(2)))), (0.3, ADS, short), (0.2, FORMS, short), (0.2, NOTICES, short), (0.85, FEET, lambda: "© " + short() if rng.random() < 0.6 else short())):
            if rng.random() < chance:
                after.append(rng.choice(kinds).format(make()))
        rng.shuffle(before)
        if in_body:
            before, after = [foreign(p) for p in before], [foreign(p) for p in after]
        page = f"<html><body{' data-y' * in_body}>{''.join(before)}{article}{''.join(after)}</body></html>"
        out.append(page if rng.random() < 0.9 else page[: rng.randint(len(page) // 2, len(page))])
    return out


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES, id_col: str = "page_id", html_col: str = "html") -> BoostedTrees | None:
    """Train on texts of at most train_pages pages of up to TRAIN_CHARS characters (the smallest hashes of page_id; of a repeated id the smallest html); None where none of them has text under a semantic tag."""
    rows = pages.where(F.length(html_col) <= TRAIN_CHARS).select(F.xxhash64(id_col).alias("h"), F.col(html_col).cast("string").alias("html"))
    chosen = rows.select("h").distinct().orderBy("h").limit(train_pages)  # numbers first: a page's html goes nowhere until it is chosen
    sample = rows.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.min("html").alias("html")).orderBy("h")
    rows = [r["html"] for r in sample.collect()]  # train_pages pages
    found = layouts([_semantic(read(r)) for r in rows])
    if not found:
        return None
    trees = [read(x) for x in found]
    y = np.array([m for t in trees for m in marked(t)], dtype=float)
    return BoostedTrees(features(trees), y)


def extract(pages: DataFrame, model: BoostedTrees | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text ("" where there is none, as for null or empty html) and n_chars.

    Pages are independent: no shuffle, repeated rows repeat, an empty table gives no rows. Without a model every text run is kept.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some 80 trees of 15 nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 128):
                batch = whole.slice(a, 128)
                trees = [read(x) for x in batch.column(2).to_pylist()]
                odds = own.log_odds(features(trees)) if own and any(t.group for t in trees) else np.ones(sum(len(t.group) for t in trees))
                texts, at = [], 0
                for t in trees:
                    texts.append(main_text(t, kept(t, odds[at : at + len(t.group)].tolist())))
                    at += len(t.group)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
