"""Main text of HTML pages by a recurrent block labeller: a bidirectional LSTM in numpy.

A page is the sequence of its leaf blocks.  A block's vector has the hashed
tags and class words of its path, its hashed words and a few counts; an LSTM
reads the sequence forwards and another backwards, and each block is labelled
from both states, so with the whole document as context.  The text is the
blocks labelled as main text, in page order.

Training is on pages put together from a bounded sample of the table's own
pages (``TRAIN_PAGES``, and of very long ones a run of ``TRAIN_BLOCKS`` blocks
from anywhere, each with ``TRAIN_CHARS`` characters at most): blocks whose markup is plain about what they are (an
article's, a menu's, a footer's) are set into varied layouts, with side bars,
notices, adverts, forms, sharing links and reader comments around and inside
the article, and with class words left out at random; so the labels are known.

White space (any, also after decoding) inside a block becomes one space; line
breaks count as white space.  Defined results: a null or empty page, and one
without any main text, gives an empty text; repeated rows give equal texts;
broken markup is read as far as its tags can be told; very long pages are read
whole, a run of blocks at a time; any depth of tags is kept; without pages to learn from every block is kept; an empty table gives
an empty table.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.llm._markup import Block, blocks_of
from placebook.llm._store import table
from placebook.llm._words import Texts, slices

TAGS, CLASSES, LAST, WORDS, COUNTS, HIDDEN = 64, 64, 32, 32, 8, 20
INPUTS = TAGS + CLASSES + LAST + WORDS + COUNTS
TRAIN_PAGES, TRAIN_BLOCKS, TRAIN_CHARS, LAYOUTS, CELLS = 160, 400, 4000, 6, 40_000

_OUTSIDE = frozenset("nav header footer aside form menu dialog button fieldset .nav .navbar .menu .header .footer .sidebar .ad .ads .advert .advertisement .comment .comments .cookie .notice .banner .promo .related .share .social .newsletter .widget .breadcrumb .breadcrumbs .pagination".split())


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(TAGS + CLASSES + LAST, np.float32)
    last = ""
    for x in path:
        h = zlib.crc32(x.encode())
        if x[0] == ".":
            v[TAGS + h % CLASSES] = 1
        else:
            v[h % TAGS] = 1
            last = x
    v[TAGS + CLASSES + zlib.crc32(last.encode()) % LAST] = 1
    return v


def vectors(pages: list[list[Block]], place: np.ndarray | None = None) -> np.ndarray:
    """One row for each block of all pages; ``place`` has the blocks' places in their pages, from 0 to 1, where these are not whole pages."""
    every = [b for page in pages for b in page]
    x = np.zeros((len(every), INPUTS), np.float32)
    if not every:
        return x
    for row, b in zip(x, every):
        row[: TAGS + CLASSES + LAST] = _path_vector(b.path)
    texts = Texts(pa.array([b.text for b in every], pa.string()))
    where, h = texts.spans[2], texts.word_hash
    counts = np.bincount(where * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=len(every) * WORDS).reshape(-1, WORDS)
    at = TAGS + CLASSES + LAST
    n = texts.n_words.astype(np.float32)
    x[:, at : at + WORDS] = counts / np.maximum(n, 1)[:, None]
    size = np.diff(texts.offset).astype(np.float32)
    upper = texts.per_text((texts.byte >= 65) & (texts.byte <= 90))
    stops = texts.per_text(np.isin(texts.byte, list(b".!?")))
    links = np.array([b.link_chars / max(len(b.text), 1) for b in every], np.float32)
    place = np.concatenate([np.arange(len(p), dtype=np.float32) / max(len(p), 1) for p in pages if p]) if place is None else place
    x[:, at + WORDS :] = np.column_stack([np.log1p(n) / 4, np.log1p(size) / 6, links, upper / np.maximum(size, 1), stops / np.maximum(n, 1), place, n > 12, n < 4])
    return x


@dataclass
class Labeller:
    """Weights of both directions: input and state to the four gates, and of the label."""

    w: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def values(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.b, self.out, self.bias]

    @staticmethod
    def fresh(seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        w = [rng.normal(0, 0.15, (INPUTS, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
        u = [rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
        b = [np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32) for _ in range(2)]
        return Labeller(w, u, b, rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32))

    def _run(self, x: np.ndarray, mask: np.ndarray, way: int, keep: list | None = None, state: list | None = None) -> np.ndarray:
        """States (time, page, HIDDEN) of one direction; at masked places the state stays.

        keep collects what training needs; state is where a run of a page begins, and is left where it ends.
        """
        steps, pages = mask.shape
        gates = x @ self.w[way] + self.b[way]
        h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.u[way]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = np.where(m, f * c + i * g, c)
            tc = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc))
            h, c = np.where(m, o * tc, h), new
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out

    def score(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, 0), self._run(x, mask, 1)], axis=2)
        return both @ self.out + self.bias[0]

    def score_long(self, page: list[Block], run: int) -> np.ndarray:
        """The score of each block of one page, read ``run`` blocks at a time in either direction."""
        n = len(page)
        out = np.full(n, self.bias[0], np.float32)
        starts = list(range(0, n, run))
        for way in (0, 1):
            state: list = [np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32)]
            for a in starts if way == 0 else reversed(starts):
                part = page[a : a + run]
                x = vectors([part], np.arange(a, a + len(part), dtype=np.float32) / n)
                states = self._run(x[:, None], np.ones((len(part), 1), bool), way, state=state)
                out[a : a + len(part)] += states[:, 0] @ self.out[way * HIDDEN : (way + 1) * HIDDEN]
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        kept: list[list] = [[], []]
        states = [self._run(x, mask, way, kept[way]) for way in (0, 1)]
        z = np.concatenate(states, axis=2) @ self.out + self.bias[0]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * mask / mask.sum()
        d_out = np.concatenate([np.einsum("tp,tph->h", error, s) for s in states])
        grads_w, grads_u, grads_b = [], [], []
        for way in (0, 1):
            u = self.u[way]
            dz_all = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            du = np.zeros_like(u)
            dh, dc = np.zeros(states[way].shape[1:], np.float32), np.zeros(states[way].shape[1:], np.float32)
            part = self.out[way * HIDDEN : (way + 1) * HIDDEN]
            for t, h, c, i, f, o, g, tc in reversed(kept[way]):
                m = mask[t][:, None]
                dh = dh + error[t][:, None] * part
                d = np.where(m, dh, 0)
                dcell = np.where(m, dc + d * o * (1 - tc * tc), 0)
                dz = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), d * tc * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                du += h.T @ dz
                dh, dc = np.where(m, dz @ u.T, dh), np.where(m, dcell * f, dc)
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            grads_w.append(x.reshape(-1, INPUTS).T @ flat)
            grads_u.append(du)
            grads_b.append(flat.sum(axis=0))
        return [*grads_w, *grads_u, *grads_b, d_out, np.array([error.sum()])]

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 10, batch: int = 24, rate: float = 0.01, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        values = self.values()
        first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        step = 0
        for epoch in range(epochs):
            order = np.argsort(np.array([len(p) for p in pages]) + rng.uniform(0, 4, len(pages)))  # pages of like length together
            starts = rng.permutation(np.arange(0, len(order), batch))
            for a in starts:
                rows = order[a : a + batch]
                x, mask, y = _padded([pages[k] for k in rows], [labels[k] for k in rows])
                step += 1
                pace = rate * (1 if epoch < epochs - 3 else 0.3)
                for v, g, m, s in zip(values, self.gradients(x, mask, y), first, second):
                    g = np.clip(g, -1, 1).astype(np.float32)
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


def _padded(pages: list[np.ndarray], labels: list[np.ndarray] | None = None):
    """(inputs, mask, labels) as (time, page) of pages padded to the longest."""
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), INPUTS), np.float32)
    mask, y = np.zeros((steps, len(pages)), bool), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
        if labels is not None:
            y[: len(p), k] = labels[k]
    return x, mask, y


def plain_labels(page: list[Block]) -> np.ndarray:
    """1 for main text as the markup itself tells it, 0 for the rest; used to gather material for training only."""
    has_article = any("article" in b.path or "main" in b.path for b in page)
    out = np.zeros(len(page), bool)
    for k, b in enumerate(page):
        inside = "article" in b.path or "main" in b.path if has_article else len(b.text.split()) >= 12
        out[k] = inside and not _OUTSIDE.intersection(b.path)
    return out


def _layout(rng: np.random.Generator, main: list[Block], other: list[str], prose: list[str]) -> tuple[list[Block], list[int]]:
    """A made-up page around the main blocks of a real one."""
    blocks: list[Block] = []
    labels: list[int] = []
    nameless = rng.random() < 0.25

    def pick(*options):
        return options[rng.integers(len(options))]

    def some(words: int) -> str:
        text = pick(*(prose if rng.random() < 0.6 else other))
        cut = text.split()
        at = int(rng.integers(0, max(1, len(cut) - words)))
        return " ".join(cut[at : at + words]) or "more"

    def put(path: str, text: str, label: int, link: bool = False) -> None:
        steps = tuple(x for x in ("html body " + path).split() if not (nameless and x[0] == "." and rng.random() < 0.8))
        if text:
            blocks.append(Block(steps, text, len(text) if link else 0))
            labels.append(label)

    def boiler(kind: str) -> None:
        if kind == "menu":
            where = pick("nav ul li", "div .menu ul li", "div .nav .bar ul li", "nav .main .menu ul li", "nav", "div .topbar", "ul .navigation li")
            for _ in range(rng.integers(1, 9)):
                put(where, some(int(rng.integers(1, 4))), 0, True)
        elif kind == "header":
            where = pick("header", "div .header", "header .site .header div", "div .masthead", "header h1", "header p")
            for _ in range(rng.integers(1, 3)):
                put(where, some(int(rng.integers(1, 10))), 0, rng.random() < 0.5)
        elif kind == "footer":
            where = pick("footer", "div .footer", "footer p", "footer .site .footer ul li", "div .copyright")
            for _ in range(rng.integers(1, 4)):
                put(where, some(int(rng.integers(2, 20))), 0, rng.random() < 0.3)
        elif kind == "side":
            where = pick("aside", "div .sidebar", "aside .widget", "div .related", "section .recommended", "div .right .rail")
            put(where + pick("", " h3", " h2"), some(3), 0)
            for _ in range(rng.integers(1, 6)):
                put(where + pick(" ul li", " p", " div", ""), some(int(rng.integers(2, 25))), 0, rng.random() < 0.6)
        elif kind == "notice":
            where = pick("div .cookie .banner", "div .notice", "div .gdpr p", "div .alert", "section .consent p", "div .cookie .notice p")
            put(where, some(int(rng.integers(4, 25))), 0)
            put(where.split(" p")[0] + " button", some(1), 0)
        elif kind == "advert":
            put(pick("div .ad", "div .advert", "div .sponsored p", "section .promo", "div .ads div", "div .banner .ad"), some(int(rng.integers(3, 20))), 0, rng.random() < 0.4)
        elif kind == "form":
            where = pick("form", "form .newsletter", "div .subscribe form", "form .search", "form .login div")
            put(where + pick("", " p", " legend"), some(int(rng.integers(2, 15))), 0)
            put(where + " button", some(1), 0)
        elif kind == "share":
            where = pick("div .share ul li", "div .social", "ul .tags li", "div .breadcrumb", "ol .breadcrumbs li", "div .byline .meta")
            for _ in range(rng.integers(1, 5)):
                put(where, some(int(rng.integers(1, 4))), 0, True)
        elif kind == "comments":
            where = pick("section .comments div .comment", "div .comments ul li .comment", "ol .comment .list li", "div .responses div .reply", "section .comments article .comment", "div .discussion div")
            put(where.split(" ")[0] + " " + where.split(" ")[1] + pick(" h2", " h3"), some(2), 0)
            for _ in range(rng.integers(1, 6)):
                if rng.random() < 0.5:
                    put(where + pick(" span", " h4", " cite", " header"), some(int(rng.integers(1, 3))), 0)
                put(where + pick(" p", ""), some(int(rng.integers(3, 40))), 0)

    for kind in ("notice", "header", "menu", "advert", "share", "side", "form"):
        if rng.random() < (0.85 if kind == "menu" else 0.35):
            boiler(kind)
    home = pick("article", "article", "main article", "main", "div .content", "div .article .body", "div .post", "section .story", "div .main div .entry .content", "div .page main", "div .container article .post", "article div .text", "div")
    for k, b in enumerate(main):
        own = next((x for x in reversed(b.path) if x[0] != "."), "p")
        own = own if own in ("h1", "h2", "h3", "h4", "p", "li", "blockquote", "td", "pre", "dd") else "p"
        own = {"li": "ul li", "td": "table tr td"}.get(own, own)
        if own == "p" and rng.random() < 0.08:
            own = pick("ul li", "blockquote p", "h2", "table tr td", "section p", "div", "figure figcaption", "ol li")
        text = b.text if rng.random() < 0.9 else " ".join(b.text.split()[: int(rng.integers(1, 6))])
        put(f"{home} {own}", text, 1)
        if k + 1 < len(main) and rng.random() < 0.05:
            inside, n = pick("advert", "share", "side", "form"), len(blocks)
            boiler(inside)
            for j in range(n, len(blocks)):
                blocks[j].path = ("html", "body", *(x for x in home.split() if not nameless or x[0] != "."), *blocks[j].path[2:])
    for kind in ("share", "advert", "comments", "side", "form", "menu", "footer", "notice"):
        if rng.random() < (0.85 if kind == "footer" else 0.3):
            n = len(blocks)
            boiler(kind)
            if kind in ("share", "comments", "advert") and rng.random() < 0.3:
                for j in range(n, len(blocks)):
                    blocks[j].path = ("html", "body", *(x for x in home.split() if not nameless or x[0] != "."), *blocks[j].path[2:])
    return blocks, labels


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES, seed: int = 3) -> Labeller | None:
    """A labeller from at most ``train_pages`` pages, drawn by a seeded hash; None without any main text to learn from."""
    # about twice the sample by hash, of which take() reads as many as it needs
    share = min(1.0, 2 * train_pages / max(pages.count(), 1))
    drawn = pages.select("html").filter("html is not null").filter(F.pmod(F.xxhash64("html", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def told(batches):
        for part in slices(batches, "html"):
            for page in part.column(0).to_pylist():
                rng = np.random.default_rng([zlib.crc32(page.encode()), seed])
                blocks = blocks_of(page)
                label = plain_labels(blocks).tolist()
                a = int(rng.integers(0, max(1, len(blocks) - TRAIN_BLOCKS + 1)))
                rows = []
                for block, y in zip(blocks[a : a + TRAIN_BLOCKS], label[a : a + TRAIN_BLOCKS]):
                    c = int(rng.integers(0, max(1, len(block.text) - TRAIN_CHARS + 1)))
                    text = block.text[c : c + TRAIN_CHARS]
                    rows.append((block.path, text, min(block.link_chars, len(text)), y))
                yield pa.RecordBatch.from_pydict({"page": pa.array([json.dumps(rows)], pa.string())})

    sample = [json.loads(r["page"]) for r in drawn.mapInArrow(told, "page string").take(train_pages)]
    read = [[Block(tuple(path), text, links) for path, text, links, _ in p] for p in sample]
    labels = [np.array([y for *_, y in p], bool) for p in sample]
    other = [b.text for p, y in zip(read, labels) for b, k in zip(p, y) if not k] or ["more about us"]
    mains = [[b for b, k in zip(p, y) if k] for p, y in zip(read, labels) if y.any()]
    if not mains:
        return None
    rng = np.random.default_rng(seed)
    prose = [b.text for m in mains for b in m]
    x, y = [], []
    for p, k in zip(read, labels):
        if p:
            x.append(vectors([p]))
            y.append(k.astype(np.float32))
    for _ in range(LAYOUTS):
        for m in mains:
            blocks, marks = _layout(rng, m, other, prose)
            x.append(vectors([blocks]))
            y.append(np.array(marks, np.float32))
    labeller = Labeller.fresh(seed)
    labeller.train(x, y, seed=seed)
    return labeller


def main_texts(htmls: list[str | None], labeller: Labeller | None, most_cells: int = CELLS) -> Iterator[str]:
    """The main text of each page."""
    read = [blocks_of(h) if h else [] for h in htmls]
    keep = [np.ones(len(p), bool) for p in read]
    if labeller is not None:
        order = sorted((k for k in range(len(read)) if read[k]), key=lambda k: len(read[k]))
        while order and len(read[order[-1]]) > most_cells:
            k = order.pop()
            keep[k] = labeller.score_long(read[k], max(1, most_cells // 8)) > 0
        while order:
            n = max(1, min(len(order), most_cells // len(read[order[-1]])))  # the longest pages first, as many as fit
            rows, order = order[-n:], order[:-n]
            x = vectors([read[k] for k in rows])
            ends = np.cumsum([len(read[k]) for k in rows])
            inputs, mask, _ = _padded([x[e - len(read[k]) : e] for k, e in zip(rows, ends)])
            score = labeller.score(inputs, mask)
            for j, k in enumerate(rows):
                keep[k] = score[: len(read[k]), j] > 0
    for page, good in zip(read, keep):
        yield "\n\n".join(b.text for b, g in zip(page, good) if g)


def extracted(pages: DataFrame, labeller: Labeller | None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller)  # 2 * (INPUTS + HIDDEN) * 4 * HIDDEN numbers

    def run(batches):
        for part in slices(batches, "html", 1 << 20):
            texts = list(main_texts(part.column(2).to_pylist(), shared.value))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages, fit(pages))
