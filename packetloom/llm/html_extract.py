"""Main text of web pages: boosted trees over DOM nodes, and a decoding that respects the tree.

Trees learn from two sources of labelled nodes: a bounded sample of the pages themselves whose markup
says what is an article and what is not, and layouts made from the sample's words with and without
telling names, so that density, depth and sibling features have to decide where names do not.  Decoding
finds the most likely labels among those in which nothing below a dropped node is kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.boosted_trees import BoostedTrees
from packetloom.llm.dom import TOKEN_GROUPS, Page, block_text, node_features, parse

#: Pages of the sample, words of it that layouts are made of, and layouts.
SAMPLE_PAGES, VOCABULARY, LAYOUTS = 200, 4000, 400
TREES, DEPTH = 40, 5
_MARK = ""
_MAIN = list(TOKEN_GROUPS).index("main")


def consistent(page: Page, probability: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which nodes stay: the most likely labelling in which every node below a dropped one is dropped."""
    weight = 1 + own / 50
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    drop, keep = weight * np.log(1 - p), weight * np.log(p)
    for i in range(len(p) - 1, 0, -1):
        parent = page.parents[i]
        keep[parent] += max(drop[i], keep[i])
        drop[parent] += drop[i]
    stays = keep > drop
    stays[0] = True
    for i in range(1, len(p)):
        stays[i] &= stays[page.parents[i]]
    return stays


def _marked_below(page: Page, nodes: np.ndarray) -> np.ndarray:
    for i in range(len(nodes) - 1, 0, -1):
        nodes[page.parents[i]] |= nodes[i]
    return nodes


def _by_markup(page: Page) -> np.ndarray | None:
    """Labels of a page whose element names say what is main text; None if none does."""
    said = [t | ({_MAIN} if tag in ("article", "main") else {-1} if tag in ("nav", "footer", "aside", "form", "dialog") else set())
            for t, tag in zip(page.tokens, page.tags)]
    state = np.zeros(len(said), np.int64)
    for i in range(1, len(said)):
        state[i] = state[page.parents[i]]
        if said[i] - {_MAIN}:
            state[i] = -1
        elif _MAIN in said[i] and page.tags[i] != "body" and state[i] >= 0:
            state[i] = 1
    held = np.zeros(len(said), bool)
    for _, node, text, _ in page.pieces:
        held[node] |= state[node] > 0 and bool(text.strip())
    return _marked_below(page, held) if held.any() else None


def layout(draw: np.random.Generator, words: list[str]) -> str:
    """A page with menus, notices, adverts, forms, comments and an article, whose paragraphs carry a mark."""

    def text(least: int, most: int, mark: str = "") -> str:
        return mark + " ".join(words[i] for i in draw.integers(0, len(words), draw.integers(least, most + 1)))

    def sentences(mark: str = "") -> str:
        return mark + " ".join(text(4, 14).capitalize() + "." for _ in range(draw.integers(1, 8)))

    telling = draw.random() < 0.7

    def named(tag: str, names: str) -> tuple[str, str]:
        chosen = draw.choice(names.split())
        kind = draw.integers(0, 3) if telling else 3
        if kind == 0 and tag != "div":
            return f"<{tag}>", f"</{tag}>"
        if kind <= 2:
            attribute = draw.choice(["class", "id"])
            return f'<div {attribute}="{chosen}">', "</div>"
        return f'<div class="c{draw.integers(0, 99)}">', "</div>"

    def wrapped(tag: str, names: str, body: str) -> str:
        opened, closed = named(tag, names)
        return opened + body + closed

    def links(count: int) -> str:
        items = [f'<a href="/{i}">{text(1, 3)}</a>' for i in range(count)]
        if draw.random() < 0.7:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in items) + "</ul>"
        return " ".join(items)

    def maybe(chance: float, part: str) -> str:
        return part if draw.random() < chance else ""

    menu = wrapped("nav", "nav menu navbar", links(draw.integers(3, 9)))
    header = wrapped("header", "header masthead", maybe(0.7, f"<h2>{text(1, 4)}</h2>") + maybe(0.5, f"<p>{text(3, 8)}</p>") + maybe(0.4, menu))
    advert = lambda: wrapped("div", "ad ads advert sponsored promo banner", maybe(0.5, f"<p>{text(4, 14)}</p>") or text(4, 14) + ".")
    notice = wrapped("dialog", "cookie-notice consent notice alert cookie-banner", f"<p>{text(6, 25)}.</p>" + maybe(0.5, "<button>ok</button>"))
    side = wrapped("aside", "sidebar related widget side", f"<h3>{text(1, 3)}</h3>" + (links(draw.integers(3, 8)) if draw.random() < 0.6 else f"<p>{sentences()}</p>"))
    form = wrapped("form", "search newsletter login form", f"<label>{text(1, 3)}</label><input name=q>" + maybe(0.5, f"<p>{text(4, 12)}</p>"))
    if draw.random() < 0.5:
        form = f"<form>{form}</form>"
    comments = wrapped(
        "section", "comments comment-list disqus replies",
        maybe(0.6, f"<h3>{text(1, 2)}</h3>") + "".join(wrapped("div", "comment reply", f"<p>{sentences()}</p>") for _ in range(draw.integers(1, 5))),
    )
    share = wrapped("div", "share social", links(draw.integers(2, 5)))
    footer = wrapped("footer", "footer site-footer copyright", maybe(0.6, "&copy; ") + text(2, 10) + maybe(0.5, links(draw.integers(2, 6))))

    parts = [maybe(0.85, f"<h1>{text(3, 10, _MARK)}</h1>")]
    for _ in range(draw.integers(1, 12)):
        kind = draw.random()
        if kind < 0.7:
            parts.append(f"<p>{sentences(_MARK)}{maybe(0.1, '<br>')}{maybe(0.8, '</p>')}")
        elif kind < 0.78:
            parts.append(f"<h2>{text(2, 6, _MARK)}</h2>")
        elif kind < 0.85:
            parts.append("<ul>" + "".join(f"<li>{text(3, 15, _MARK)}</li>" for _ in range(draw.integers(2, 5))) + "</ul>")
        elif kind < 0.9:
            parts.append(f"<blockquote>{sentences(_MARK)}</blockquote>")
        elif kind < 0.95:
            parts.append(advert())
        else:
            parts.append(f"<div>{sentences(_MARK)}</div>")
    story = wrapped("article", "article content post entry story-body", "".join(parts) + maybe(0.15, share))
    if draw.random() < 0.4:
        story = wrapped("main", "main content page", story + maybe(0.3, side) + maybe(0.3, comments))
    page = maybe(0.8, header) + maybe(0.8, menu) + maybe(0.3, notice) + maybe(0.5, "<!-- x -->" + advert()) + maybe(0.3, side) + story
    page += maybe(0.3, share) + maybe(0.4, comments) + maybe(0.4, side) + maybe(0.4, form) + maybe(0.3, advert()) + maybe(0.2, notice) + maybe(0.9, footer)
    return f"<html><head><title>{text(2, 6)}</title></head><body>{page}</body></html>"


def learn(pages: DataFrame) -> BoostedTrees:
    """Trees from ``SAMPLE_PAGES`` whole pages by hash, and from layouts made of ``VOCABULARY`` of their words, by hash, too."""
    usable = pages.where(F.col("html").isNotNull()).select("html", F.xxhash64("html").alias("rank"))
    # The smallest ranks first, without their pages: so a task sends numbers and not its candidates.
    ranks = [r.rank for r in usable.select("rank").distinct().orderBy("rank").limit(SAMPLE_PAGES).collect()]
    rows = usable.where(F.col("rank") <= max(ranks, default=0)).groupBy("rank").agg(F.min("html").alias("html")).collect()
    rows = sorted(rows, key=lambda r: r.rank) if ranks else []
    return fit([r.html for r in rows])


def fit(sample: list[str]) -> BoostedTrees:
    draw = np.random.default_rng(1)
    x, y, words = [], [], set()
    for html in sample:
        page = parse(html)
        words.update(w for _, _, text, _ in page.pieces for w in text.split())
        labels = _by_markup(page)
        if labels is not None:
            values, own = node_features(page)
            x.append(values)
            y.append(labels)
    vocabulary = sorted(heapq.nsmallest(VOCABULARY, words, key=lambda w: (crc32(w.encode()), w))) or ["text"]
    for _ in range(LAYOUTS):
        page = parse(layout(draw, vocabulary))
        held = np.zeros(len(page.tags), bool)
        for _, node, text, _ in page.pieces:
            held[node] |= _MARK in text
        x.append(node_features(page)[0])
        y.append(_marked_below(page, held))
    return BoostedTrees(DEPTH).fit(np.concatenate(x), np.concatenate(y).astype(float), TREES)


def main_text(htmls: list[str], trees: BoostedTrees) -> list[str]:
    """Main text of each page; pages are parsed one by one and their nodes judged together."""
    pages = [parse(h) for h in htmls]
    described = [node_features(p) for p in pages]
    probability = trees.probability(np.concatenate([x for x, _ in described]))
    texts, at = [], 0
    for page, (values, own) in zip(pages, described):
        texts.append(block_text(page, consistent(page, probability[at : at + len(values)], own)))
        at += len(values)
    return texts


def extract(pages: DataFrame, trees: BoostedTrees) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A NULL or empty page has an empty text.  Cut-off, unclosed or misnested markup is read as far as it
    goes; a page without markup is one block.  Repeated rows come back each; other columns are ignored;
    an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                texts = main_text([h or "" for h in rows.column("html").to_pylist()], trees)
                sizes = pa.array([len(t) for t in texts], pa.int64())
                columns = [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), sizes]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
