"""Main text of web pages by a linear-chain conditional random field.

A page is parsed into leaf blocks: runs of text between block-level tags, each with
its ancestors. Features are the ancestors' tags and the words of their class, id
and role, and properties of the text: length, share of link text, how it ends,
telling words, place in the page. A linear-chain CRF with two labels scores blocks
and neighbouring labels; Viterbi decoding finds the best labelling of the page, and
the blocks labelled as content are the text.

The field is trained on labelled pages (by default those of ``labelled_pages``,
generated with known labels in many layouts) by gradient ascent on the conditional
likelihood. Training sees a fixed number of pages; scoring is one narrow pass in
which tasks handle whole pages, so nothing is shuffled.

Defined results: null and empty pages, and pages without content blocks, give an
empty text. Text in scripts, styles, templates and the title is never a block.
Unclosed and misnested tags are tolerated, in time that grows with the page: a tag
that no page closes ends with what holds it, an unclosed head at the first tag or
text that cannot be in one. Marked sections and unknown declarations are comments.
Repeated rows give repeated results. A column of the pages that has the result's name
is kept as ``<name>_given``.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import with_result

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre"
    " section select summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN_TAGS = frozenset("head iframe object script style svg template textarea title".split())
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE = re.compile(r"\s+")
HINT = re.compile(r"[a-z]+")
#: Words in texts that speak of what a block is.
TELLING = frozenset(
    "advertisement all archive click comment comments contact cookie cookies copyright home login menu newsletter policy"
    " privacy read related reply reserved rights search share sign sponsored subscribe tags terms".split()
)
STEPS = 200
STEP_SIZE = 0.1
PENALTY = 1e-3
TRAINING_PAGES = 300


@dataclass
class Block:
    """One leaf block: text, its ancestors' tags and hints, its parent's tag, and characters in links."""

    text: str
    tags: frozenset[str]
    parent: str | None
    hints: frozenset[str]
    link_chars: int
    label: int | None = None


@dataclass
class _Open:
    tag: str
    hints: tuple[str, ...]
    label: int | None


class BlockParser(HTMLParser):
    """Collects the leaf blocks of one page.

    Open elements are a stack. Its tags and hints are counted as they come and go, so
    that a block costs as much as there are different ones, however deep the page.
    Hints outside ``known`` are left out; without it, all are kept.
    """

    def __init__(self, known: frozenset[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.known = known
        self.blocks: list[Block] = []
        self.open: list[_Open] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # of each open tag, in the stack
        self.hints: Counter[str] = Counter()
        self.labels: list[int] = []
        self.parts: list[str] = []
        self.linked = 0
        self.hidden = 0

    def flush(self) -> None:
        if not self.parts:
            return
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if text:
            tags = frozenset(self.places)
            parent = self.open[-1].tag if self.open else None
            label = self.labels[-1] if self.labels else None
            self.blocks.append(Block(text, tags, parent, frozenset(self.hints), self.linked, label))
        self.linked = 0

    def _close(self, place: int) -> None:
        while len(self.open) > place:
            gone = self.open.pop()
            self.places[gone.tag].pop()
            if not self.places[gone.tag]:
                del self.places[gone.tag]
            self.hidden -= gone.tag in HIDDEN_TAGS
            for hint in gone.hints:
                self.hints[hint] -= 1
                if not self.hints[hint]:
                    del self.hints[hint]
            if gone.label is not None:
                self.labels.pop()

    def _last(self, tag: str, stop: Sequence[str] = ()) -> int:
        """Place of the last open ``tag`` that no ``stop`` tag hides, or -1."""
        place = self.places[tag][-1] if self.places.get(tag) else -1
        return -1 if any(self.places.get(s) and self.places[s][-1] > place for s in stop) else place

    def _leave_head(self) -> None:
        """Ends an unclosed head, unless a title or the like in it is still open."""
        if self.hidden == 1 and self.places.get("head"):
            self._close(self.places["head"][-1])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD_TAGS:
            self._leave_head()
        if tag in BLOCK_TAGS:
            self.flush()
            if tag == "body":
                self._close(0)
            for closes, stop in (("p", ()), ("li", ("ul", "ol", "menu"))):
                if (closes == "p" or tag == closes) and (place := self._last(closes, stop)) >= 0:
                    self._close(place)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID_TAGS:
            return
        hints, label = [], None
        for name, value in attrs:
            if name in ("class", "id", "role"):
                found = HINT.findall((value or "").lower())
                hints.extend(found if self.known is None else (h for h in found if h in self.known))
            elif name == "data-training-label":
                label = int(value)
        self.places[tag].append(len(self.open))
        self.open.append(_Open(tag, tuple(hints), label))
        self.hints.update(hints)
        self.hidden += tag in HIDDEN_TAGS
        if label is not None:
            self.labels.append(label)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        if (place := self._last(tag)) >= 0:
            self._close(place)

    def handle_data(self, data: str) -> None:
        if self.hidden and not data.isspace():
            self._leave_head()
        if not self.hidden:
            self.parts.append(data)
            if self.places.get("a"):
                self.linked += len(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def unknown_decl(self, data: str) -> None:
        """Declarations that are none are comments."""


def blocks_of(html: str | None, known: frozenset[str] | None = None) -> list[Block]:
    parser = BlockParser(known)
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def features_of(blocks: Sequence[Block]) -> list[list[str]]:
    """The names of the features that hold for each block of a page."""
    out = []
    for i, block in enumerate(blocks):
        words = block.text.split()
        own = {f"tag {t}" for t in block.tags} | {f"hint {h}" for h in block.hints}
        own.add("always")
        own.add(f"in {block.parent}" if block.parent else "in nothing")
        own.add(f"words {min(len(words), 64).bit_length()}")
        own.add(f"links {round(4 * min(block.link_chars / len(block.text), 1))}")
        own.add("ends a sentence" if block.text[-1] in ".!?…\"”»" else "ends openly")
        if "©" in block.text:
            own.add("copyright sign")
        own.update(f"says {w}" for w in {w.strip(".,:;!?").lower() for w in words} & TELLING)
        if i == 0:
            own.add("first")
        if i == len(blocks) - 1:
            own.add("last")
        out.append(sorted(own))
    return out


@dataclass
class ChainField:
    """Weights of features for label 1 (label 0 is the origin), and of neighbouring labels."""

    weights: dict[str, float] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    @cached_property
    def hints(self) -> frozenset[str]:
        """The hints that have a weight; no other one can change a labelling."""
        return frozenset(name.removeprefix("hint ") for name in self.weights if name.startswith("hint "))

    def decode(self, features: Sequence[Sequence[str]]) -> list[int]:
        """The most likely labels of a page's blocks (Viterbi); ties go to label 0."""
        if not features:
            return []
        get, ((m00, m01), (m10, m11)) = self.weights.get, self.moves.tolist()
        back, best0, best1 = [], 0.0, sum(get(f, 0.0) for f in features[0])
        for own in features[1:]:
            gain = sum(get(f, 0.0) for f in own)
            from0 = best0 + m00 >= best1 + m10
            to1 = best0 + m01 >= best1 + m11
            back.append((not from0, not to1))
            best0, best1 = max(best0 + m00, best1 + m10), max(best0 + m01, best1 + m11) + gain
        labels = [int(best1 > best0)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    most = a.max(axis=axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(a - most).sum(axis=axis))


def train(pages: Sequence[tuple[list[list[str]], list[int]]]) -> ChainField:
    """A chain field for pages of (features, labels): gradient ascent with adaptive steps."""
    pages = [p for p in pages if p[1]]
    names = sorted({f for features, _ in pages for own in features for f in own})
    at = {name: i for i, name in enumerate(names)}
    longest = max((len(labels) for _, labels in pages), default=1)
    x = np.zeros((len(pages), longest, len(names)))
    y, real = np.zeros((len(pages), longest), np.int64), np.zeros((len(pages), longest), bool)
    for i, (features, labels) in enumerate(pages):
        for j, own in enumerate(features):
            x[i, j, [at[f] for f in own]] = 1
        y[i, : len(labels)], real[i, : len(labels)] = labels, True
    pairs = real[:, 1:]
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    weights, moves = np.zeros(len(names)), np.zeros((2, 2))
    first, second = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, STEPS + 1):
        gain = np.stack((np.zeros(y.shape), x @ weights), axis=2)
        forward, backward = np.zeros_like(gain), np.zeros_like(gain)
        forward[:, 0] = gain[:, 0]
        for j in range(1, longest):
            forward[:, j] = _log_sum(forward[:, j - 1, :, None] + moves, 1) + gain[:, j]
        for j in range(longest - 2, -1, -1):
            onward = _log_sum(moves + (gain[:, j + 1] + backward[:, j + 1])[:, None, :], 2)
            backward[:, j] = np.where(real[:, j + 1, None], onward, 0.0)
        ends = real.sum(axis=1) - 1
        whole = _log_sum(forward[np.arange(len(pages)), ends], 1)
        likely = np.exp(forward + backward - whole[:, None, None])[:, :, 1] * real
        joint = forward[:, :-1, :, None] + moves + (gain + backward)[:, 1:, None, :] - whole[:, None, None, None]
        expected = (np.exp(np.where(pairs[:, :, None, None], joint, -np.inf))).sum(axis=(0, 1))
        slopes = [
            np.einsum("ij,ijk->k", (y * real - likely), x) - PENALTY * len(pages) * weights,
            observed - expected - PENALTY * len(pages) * moves,
        ]
        for k, (value, slope) in enumerate(zip((weights, moves), slopes)):
            slope = slope / max(1, len(pages))
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope**2
            value += STEP_SIZE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return ChainField(dict(zip(names, weights.tolist())), moves)


# --- labelled pages ------------------------------------------------------------------

_SYLLABLES = "ka to mi ren sol va dui per lan osh el bri tan gor um fe".split()


def labelled_pages(count: int, seed: int) -> Iterator[str]:
    """Generated pages in many layouts; elements carry their label as an attribute."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4)))

    def sentence(low: int, high: int, end: str = ".") -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + end

    def prose() -> str:
        return " ".join(sentence(1, 18) for _ in range(rng.randint(1, 7)))

    def story() -> str:
        """Prose of an article, which may use a telling word as any other."""
        said = prose().split()
        if rng.random() < 0.1 and len(said) > 20:
            said[rng.randrange(len(said))] = rng.choice(sorted(TELLING))
        return " ".join(said)

    def links(count: int) -> str:
        return "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(count))

    def mark(tag: str, label: int, inner: str, names: Sequence[str] = ()) -> str:
        name = f' {rng.choice(("class", "class", "id"))}="{rng.choice(names)}"' if names else ""
        return f'<{tag}{name} data-training-label="{label}">{inner}</{tag}>'

    def advert() -> str:
        names = ("ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot")
        return mark(rng.choice(("div", "div", "aside")), 0, rng.choice((prose(), sentence(3, 9, ""))), names)

    def notice() -> str:
        text = rng.choice(("We use cookies. ", "Our privacy policy changed. ", "")) + sentence(4, 12)
        return mark("div", 0, f"<p>{text}</p><button>{word()}</button>", ("cookie-notice", "notice", "consent", "cookies", "alert"))

    def menu() -> str:
        inner = f"<ul>{links(rng.randint(3, 9))}</ul>"
        return rng.choice((mark("nav", 0, inner), mark("div", 0, inner, ("menu", "nav", "navigation", "topnav"))))

    def aside() -> str:
        names = ("sidebar", "related", "widget", "side", "share", "newsletter", "tags", "breadcrumbs")
        inner = rng.choice((f"<h3>{word()}</h3><ul>{links(4)}</ul>", f"<p>{prose()}</p>", links(3)))
        return rng.choice((mark("aside", 0, inner), mark("div", 0, inner, names), mark("section", 0, inner, names)))

    def form() -> str:
        return mark("form", 0, f"<label>{sentence(1, 3, '')}</label><input name=q><button>{word()}</button><p>{sentence(2, 9)}</p>")

    def comments() -> str:
        one = lambda: f'<div class="comment"><b>{word()}</b><p>{prose()}</p></div>'
        inner = "".join(one() for _ in range(rng.randint(1, 5)))
        return mark(rng.choice(("div", "section", "ul")), 0, inner, ("comments", "comment-list", "replies", "responses"))

    def header() -> str:
        return mark("header", 0, rng.choice((f"<h1>{sentence(1, 3, '')}</h1>", f"<p>{sentence(2, 8)}</p>", menu())))

    def footer() -> str:
        text = rng.choice((f"&copy; {word()}.example &middot; {prose()}", prose(), f"Copyright {word()}. All rights reserved."))
        return rng.choice((mark("footer", 0, text), mark("footer", 0, f"<p>{text}</p>"), mark("div", 0, text, ("footer", "bottom"))))

    def body() -> str:
        parts = [rng.choice(("", f"<h1>{sentence(2, 12, '')}</h1>", f"<header><h1>{sentence(2, 9, '')}</h1></header>"))]
        for _ in range(rng.randint(1, 12)):
            parts.append(
                rng.choices(
                    (f"<p>{story()}</p>", f"<p><b>{story()}<br>", f"<h2>{sentence(1, 6, '')}</h2>", f"<blockquote>{story()}</blockquote>",
                     f"<ul><li>{sentence(2, 9)}</li><li>{sentence(1, 6, '')}</li></ul>", f"<p>{sentence(1, 2)}</p>",
                     f'<p>{story()} <a href="/{word()}">{sentence(1, 4, "")}</a> {story()}</p>', f"<pre>{story()}</pre>",
                     f"<table><tr><th>{word()}</th><td>{sentence(1, 6, '')}</td></tr></table>"),
                    (10, 3, 2, 1, 1, 2, 2, 1, 1),
                )[0]
            )
            if rng.random() < 0.08:
                parts.append(rng.choice((advert, aside, form))())
        return "".join(parts)

    for _ in range(count):
        names = ("content", "post", "entry", "story", "article-body", "main", "text")
        main = rng.choice((mark("article", 1, body()), mark("article", 1, body()), mark("main", 1, body()), mark("div", 1, body(), names)))
        before = [rng.choice((header, menu, advert, notice, aside, form))() for _ in range(rng.randint(0, 4))]
        after = [rng.choice((comments, aside, advert, footer, form, notice))() for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.8:
            after.append(footer())
        yield "<html><body>" + "".join([*before, main, *after])


def training_pages(count: int, seed: int) -> list[tuple[list[list[str]], list[int]]]:
    parsed = [blocks_of(html) for html in labelled_pages(count, seed)]
    return [(features_of(blocks), [b.label for b in blocks]) for blocks in parsed]


@lru_cache(maxsize=1)
def default_field() -> ChainField:
    """The field trained on the generated pages; always the same."""
    return train(training_pages(TRAINING_PAGES, 5))


def main_text(html: str | None, chain: ChainField) -> str:
    """The content blocks of a page, one per line."""
    blocks = blocks_of(html, chain.hints)
    labels = chain.decode(features_of(blocks))
    return "\n".join(b.text for b, label in zip(blocks, labels) if label)


def extract(pages: DataFrame, html_col: str = "html", chain: ChainField | None = None, text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each page as ``text_col``; see above for a column of that name."""
    chain = chain or default_field()

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(html, chain) for html in batch], dtype=object)

    return with_result(pages, text_col, texts(F.col(html_col)))
