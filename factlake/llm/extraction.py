"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is the sequence of its leaf blocks; each is article or not. Features are the tags
and class words of a block's ancestors, and its text: length, links, ends of sentences,
place in the page. The field is trained by gradient ascent on the conditional likelihood
of a bounded sample of labelled pages, and a page is decoded by Viterbi.

Pages come without labels by hand, so a labelled page is one that says itself where its
article is (``article`` or ``main``): blocks in it are article unless they stand in one of
OUTSIDE. Each labelled page is also used in variants: the containers renamed as other sites
name them, or taken away; paragraphs as list items, table cells, quotes and headings; notices,
adverts and link lists inside the article, reader comments behind it; nothing before it or
nothing after it. So the field has to learn from text and neighbours too, and from more names
and forms than one site uses.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factlake.llm.common import column_udf, sampled
from factlake.llm.html_blocks import Block, blocks_of

CONTAINERS = frozenset({"article", "main"})
OUTSIDE_TAGS = frozenset("nav footer aside form head button select menu dialog".split())
OUTSIDE_HINTS = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent notice "
    "comment comments reply sidebar menu nav navigation breadcrumb footer share social related "
    "newsletter subscribe popup modal".split()
)
TAGS = frozenset(
    "article main section div nav header footer aside form ul ol li table td th p h1 h2 h3 h4 h5 "
    "h6 blockquote pre figure figcaption dl dt dd a b strong em span button label head menu "
    "select details dialog body".split()
)
INSIDE_HINTS = frozenset("content article post entry story".split())
HINTS = OUTSIDE_HINTS | frozenset(
    "content article post entry story text body main page title headline paragraph widget login "
    "search contact legal copyright pagination tags author".split()
)
#: How other sites name the containers of an article, and of what is not.
INSIDE_NAMES = (
    ("main", ()),
    ("div", ("content",)),
    ("div", ("article", "body")),
    ("div", ("post",)),
    ("div", ("entry", "content")),
    ("section", ("story",)),
    ("section", ()),
    ("div", ()),
    ("body", ()),
)
#: What an article's text may stand in, from the outside in.
FORMS = (
    ("ul", "li"),
    ("ol", "li"),
    ("table", "tbody", "tr", "td"),
    ("table", "tr", "td"),
    ("table", "tr", "th"),
    ("blockquote", "p"),
    ("blockquote",),
    ("dl", "dd"),
    ("dl", "dt"),
    ("pre",),
    ("figure", "figcaption"),
    ("h2",),
    ("h3",),
    ("div", "p"),
    ("div",),
    ("section", "p"),
)
#: What may stand inside an article without being part of it.
NESTED_NAMES = (
    ("aside", ()),
    ("aside", ("related",)),
    ("div", ("ad",)),
    ("div", ("advert",)),
    ("div", ("promo",)),
    ("div", ("share",)),
    ("div", ("related",)),
    ("div", ("notice",)),
    ("nav", ()),
    ("footer", ()),
    ("form", ()),
    ("div", ("newsletter",)),
    ("ul", ("share",)),
    ("div", ("comments",)),
)
OUTSIDE_NAMES = (
    ("aside", ()),
    ("div", ("sidebar",)),
    ("div", ("menu",)),
    ("header", ()),
    ("div", ("cookie", "notice")),
    ("div", ("notice",)),
    ("div", ("banner",)),
    ("div", ("promo",)),
    ("div", ("advert",)),
    ("div", ("related",)),
    ("form", ()),
    ("form", ("newsletter",)),
    ("div", ("footer",)),
    ("section", ("comments",)),
)
COMMENT_NAMES = (
    ("section", ("comments",)),
    ("div", ("comment",)),
    ("ol", ("comments",)),
    ("div", ("reply",)),
)


def _bin(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= edge for edge in edges)


def features_of(blocks: list[Block]) -> list[list[str]]:
    out = []
    for k, block in enumerate(blocks):
        words = block.text.count(" ") + 1
        size = len(block.text)
        names = [f"tag={t}" for t in set(block.tags) & TAGS]
        names += [f"hint={h}" for h in block.hints & HINTS]
        own = next((t for t in reversed(block.tags) if t in TAGS), "")
        links = _bin(block.linked / size, (0.01, 0.3, 0.9))
        # Whether it stands in something that is never article, or says that it is.
        outside = bool(OUTSIDE_TAGS & set(block.tags) or OUTSIDE_HINTS & block.hints)
        inside = bool(CONTAINERS & set(block.tags) or INSIDE_HINTS & block.hints)
        where = f"{outside:d}{inside:d}"
        names += [
            "always",
            f"where={where}",
            f"own={own},where={where}",
            f"links={links},where={where}",
            f"own={own}",
            f"words={_bin(words, (2, 4, 8, 15, 30, 60))}",
            f"links={links}",
            f"ends={block.text[-1] in '.!?…:;\"”'}",
            f"place={_bin(k / len(blocks), (0.1, 0.3, 0.7, 0.9))}",
            f"legal={'©' in block.text or 'copyright' in block.text.lower()}",
        ]
        if k in (0, len(blocks) - 1):
            names.append("first" if k == 0 else "last")
        out.append(names)
    return out


def own_labels(blocks: list[Block]) -> list[int] | None:
    """1 where the page itself says it is the article; None if it doesn't say."""
    if not any(CONTAINERS & set(block.tags) for block in blocks):
        return None
    return [
        int(
            bool(CONTAINERS & set(block.tags))
            and not OUTSIDE_TAGS & set(block.tags)
            and not OUTSIDE_HINTS & block.hints
        )
        for block in blocks
    ]


def _renamed(block: Block, old: frozenset[str], name: tuple) -> Block:
    tags = tuple(name[0] if t in old else t for t in block.tags)
    return Block(block.text, tags, (block.hints - OUTSIDE_HINTS) | set(name[1]), block.linked)


def _reshaped(run: list[Block], form: tuple[str, ...], rng) -> list[Block]:
    """Article blocks in another form; items and cells are pieces of a paragraph."""
    out = []
    for block in run:
        keep = tuple(t for t in block.tags if t not in ("p", "b", "h1"))
        words = block.text.split(" ")
        pieces = [words]
        if form[0] in ("ul", "ol", "table", "dl", "h2", "h3"):
            step = int(rng.integers(1, 16))
            pieces = [words[k : k + step] for k in range(0, min(len(words), 4 * step), step)]
        out += [Block(" ".join(w), keep + form, block.hints, 0) for w in pieces if w != [""]]
    return out


def _nested(container: Block, texts: list[str], rng) -> list[Block]:
    """Blocks that stand in the article's container and aren't part of it."""
    tag, words = NESTED_NAMES[rng.integers(len(NESTED_NAMES))]
    tags = tuple(t for t in container.tags if t not in ("p", "b", "h1"))
    out = []
    for k in range(int(rng.integers(1, 4))):
        text = texts[rng.integers(len(texts))][: int(rng.integers(10, 300))].strip()
        linked = len(text) if rng.random() < 0.3 else 0
        leaf = ("li",) if tag == "ul" or rng.random() < 0.2 else ("p",) if rng.random() < 0.7 else ()
        if text:
            out.append(Block(text, tags + (tag,) + leaf, container.hints | set(words), linked))
    return out


def variant(blocks: list[Block], labels: list[int], rng) -> tuple[list[Block], list[int]]:
    """The same page in other names and forms, with more that isn't article."""
    inside = INSIDE_NAMES[rng.integers(len(INSIDE_NAMES))]
    outside: dict[frozenset, tuple] = {}
    page: list[tuple[Block, int]] = []
    for block, label in zip(blocks, labels):
        if label:
            page.append((_renamed(block, CONTAINERS, inside), 1))
            continue
        group = frozenset(block.tags) | block.hints
        if group not in outside:
            outside[group] = (
                OUTSIDE_NAMES[rng.integers(len(OUTSIDE_NAMES))] if rng.random() < 0.7 else None
            )
        name = outside[group]
        page.append((block if name is None else _renamed(block, OUTSIDE_TAGS | {"div"}, name), 0))
    article = [k for k, (_, label) in enumerate(page) if label]
    if not article:
        return [b for b, _ in page], [label for _, label in page]
    texts = [block.text for block, _ in page]
    first, last = article[0], article[-1]
    head, body, tail = page[:first], page[first : last + 1], page[last + 1 :]
    container = body[0][0]
    if rng.random() < 0.7:
        for _ in range(int(rng.integers(1, 4))):
            at = int(rng.integers(len(body)))
            upto = min(len(body), at + int(rng.integers(1, 4)))
            run = [block for block, label in body[at:upto] if label]
            form = FORMS[rng.integers(len(FORMS))]
            body[at:upto] = [(b, 1) for b in _reshaped(run, form, rng)] or body[at:upto]
    if rng.random() < 0.5:
        for _ in range(int(rng.integers(1, 3))):
            at = int(rng.integers(len(body) + 1))
            body[at:at] = [(b, 0) for b in _nested(container, texts, rng)]
    if rng.random() < 0.4:
        tag, words = COMMENT_NAMES[rng.integers(len(COMMENT_NAMES))]
        for _ in range(int(rng.integers(1, 6))):
            text = texts[rng.integers(len(texts))][: int(rng.integers(20, 400))]
            tail.insert(0, (Block(text, ("html", "body", tag, "p"), frozenset(words), 0), 0))
    if rng.random() < 0.25:
        head = []
    if rng.random() < 0.25:
        tail = []
    if rng.random() < 0.2:  # a short page
        body = body[: int(rng.integers(1, 4))]
    page = head + body + tail
    return [block for block, _ in page], [label for _, label in page]


@dataclass
class Field:
    """Weights of (feature, label) and (label, next label)."""

    weights: dict[str, tuple[float, float]]
    moves: np.ndarray

    def decode(self, features: list[list[str]]) -> list[int]:
        """The most probable labels, by Viterbi."""
        if not features:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        none = (0.0, 0.0)
        best0 = best1 = 0.0
        back = []
        for k, names in enumerate(features):
            s0 = s1 = 0.0
            for name in names:
                w0, w1 = self.weights.get(name, none)
                s0 += w0
                s1 += w1
            if k:
                a0, b0, a1, b1 = best0 + m00, best1 + m10, best0 + m01, best1 + m11
                back.append((b0 > a0, b1 >= a1))
                best0, best1 = max(a0, b0) + s0, max(a1, b1) + s1
            else:
                best0, best1 = s0, s1
        labels = [int(best1 >= best0)]
        for pointers in reversed(back):
            labels.append(int(pointers[labels[-1]]))
        return labels[::-1]


def train(
    pages: list[tuple[list[list[str]], list[int]]],
    *,
    rounds: int = 100,
    rate: float = 0.1,
    penalty: float = 1e-3,
) -> Field:
    """Maximum conditional likelihood by Adam; forward and backward over all pages at once."""
    pages = [p for p in pages if p[0]]
    if not pages:
        plain = {"tag=article": (0.0, 2.0), "tag=main": (0.0, 2.0), "always": (1.0, 0.0)}
        return Field(plain, np.zeros((2, 2)))
    names = sorted({n for features, _ in pages for block in features for n in block})
    number = {n: k for k, n in enumerate(names)}
    longest = max(len(labels) for _, labels in pages)
    y = np.zeros((len(pages), longest), dtype=int)
    real = np.zeros((len(pages), longest), dtype=bool)
    for p, (_, labels) in enumerate(pages):
        y[p, : len(labels)] = labels
        real[p, : len(labels)] = True
    blocks = [block for features, _ in pages for block in features]
    x = np.zeros((len(blocks), len(names)), dtype=np.float32)
    for row, block in zip(x, blocks):
        row[[number[n] for n in block]] = 1
    hot = np.eye(2)[y] * real[..., None]
    pair = real[:, 1:] & real[:, :-1]
    seen = np.einsum("pki,pkj,pk->ij", hot[:, :-1], hot[:, 1:], pair)
    w, m = np.zeros((len(names), 2)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)]
    total = real.sum()
    for step in range(1, rounds + 1):
        scores = np.zeros((len(pages), longest, 2))
        scores[real] = x @ w
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for k in range(1, longest):
            come = np.logaddexp.reduce(forward[:, k - 1, :, None] + m, axis=1) + scores[:, k]
            forward[:, k] = np.where(real[:, k, None], come, forward[:, k - 1])
        for k in range(longest - 2, -1, -1):
            go = np.logaddexp.reduce(m + (scores[:, k + 1] + backward[:, k + 1])[:, None], axis=2)
            backward[:, k] = np.where(real[:, k + 1, None], go, 0.0)
        norm = np.logaddexp.reduce(forward[:, -1], axis=1)
        alone = np.exp(forward + backward - norm[:, None, None]) * real[..., None]
        both = np.exp(
            forward[:, :-1, :, None]
            + m
            + (scores[:, 1:] + backward[:, 1:])[:, :, None]
            - norm[:, None, None, None]
        ) * pair[..., None, None]
        grads = (
            x.T @ (hot - alone)[real] / total - penalty * w,
            (seen - both.sum(axis=(0, 1))) / total - penalty * m,
        )
        for k, (value, grad) in enumerate(zip((w, m), grads)):
            first, second = state[2 * k], state[2 * k + 1]
            first += 0.1 * (grad - first)
            second += 0.01 * (grad**2 - second)
            value += (
                rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            )
    return Field({n: tuple(map(float, w[k])) for n, k in number.items()}, m)


def fit(
    pages: DataFrame, *, sample_pages: int = 200, variants: int = 6, longest: int = 200_000
) -> Field:
    """Trains on a hash sample of about ``sample_pages`` pages of up to ``longest`` characters,
    their first 100 blocks, and ``variants`` variants of each; the bounds are on training only.

    If no page of the sample says where its article is, the field is a plain one that takes
    what stands in ``article`` or ``main``, and a warning says so.
    """
    chosen = pages.where(sampled("page_id", sample_pages, pages.count()) & (F.length("html") <= longest))
    rng = np.random.default_rng(1)
    out = []
    for row in sorted(chosen.select("html").distinct().toPandas()["html"])[: 2 * sample_pages]:
        blocks = blocks_of(row)[:100]
        labels = own_labels(blocks)
        if labels is None:
            continue
        for page, marks in [(blocks, labels)] + [
            variant(blocks, labels, rng) for _ in range(variants)
        ]:
            out.append((features_of(page), marks))
    if not out:
        warnings.warn("no page of the sample marks its article; only marked ones are extracted")
    return train(out)


def main_text(html: Column, field: Field) -> Column:
    """The article's blocks joined by newlines; null and empty pages give the empty text."""

    def of_batch(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages.to_pylist():
            blocks = blocks_of(page or "")
            labels = field.decode(features_of(blocks))
            out.append("\n".join(b.text for b, label in zip(blocks, labels) if label))
        return pa.array(out, pa.string())

    return column_udf(of_batch, "string")(html)
