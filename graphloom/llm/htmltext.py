"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a sequence of words and tags.  A word scores positive, by how often words in its
setting (nearest block tag, inside a link or not) are main text on the labelled pages; a
tag scores negative, by how often its kind lies outside it.  One linear scan finds the
run with the largest sum; the blocks that it touches are the text.

Elements that are beside the text wherever they stand (menus, footers, asides, notices,
adverts, forms, reader comments and the like) score nothing and are left out of the run, with
all that they hold: an article in an aside is a teaser, one among comments is a comment, a
headline in the page's header is the site's name.  They are told by their name or by a word of
their class, id or role, whose weight is learnt: the share of the words under it that are main
text on the labelled pages, from a starting count that leans against the words of
``SIDE_WORDS`` and towards all others.  No mark hides the text itself: where marks hide nearly
all of the score (``HIDDEN``) of the articles that stand under none, or of the page where there
is no such article, the one that hides the most is set aside, of those by class words first,
until they do so no more; marks of reader comments only where nothing else is left.

Labelled pages: those that mark one ``article`` or ``main`` element; the weights are fitted
on a bounded sample of them (``TRAIN_PAGES``), added up by Spark.  Pages without such an
element teach nothing; where a page set has none that do, the starting counts hold.

Defined cases: a null or empty page, and a page without words, give an empty text;
unclosed tags, comments and raw elements run to the end of what holds them; ``br`` is
white space inside a block; of equally good runs the first is taken; a page of any length
is read whole; repeated rows, and rows with null ids, each get a row; an empty table gives
an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.language import sample_by_hash

TRAIN_PAGES = 400
#: Starting counts (inside, outside) of the kinds of tokens, as if seen on earlier pages.
PRIOR_WORD, PRIOR_TAG = (4.0, 1.0), (3.0, 1.0)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe|select|option|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<[/!?a-z][^<>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are beside the text, and words of a class, an id or a role that lean against it.
SIDE_NAMES = frozenset("nav footer aside form menu dialog".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside header masthead footer notice notices cookie cookies consent gdpr popup modal overlay alert comment comments reply replies "
    "disqus related recommended share sharing social newsletter subscribe signup login search toolbar pagination pager widget "
    "complementary contentinfo".split()
)
#: Starting counts (inside, outside) of a class word that leans against the text, and of any other; and the
#: share of the score that marks may hide before they count as wrong.
PRIOR_SIDE, PRIOR_OTHER, HIDDEN = (2.0, 18.0), (18.0, 2.0), 0.8
#: Those of them that mark what readers say.
COMMENT_WORDS = frozenset("comment comments reply replies disqus".split())


def class_words(attributes: str) -> list[str]:
    return [w for _, *v in ATTRIBUTE.findall(attributes) for w in re.split(r"[^a-z0-9]+", "".join(v).lower()) if w]


def for_comments(attributes: str) -> bool:
    """Whether a class, an id or a role begins with a word for what readers say (``comments-list``, not ``no-comments``)."""
    return any(re.match(r"[^a-z0-9]*([a-z0-9]*)", name)[1] in COMMENT_WORDS for _, *v in ATTRIBUTE.findall(attributes) for name in "".join(v).lower().split())


class Element:
    """An open element: ``side`` says whether its name (2), a class word (1) or one for comments (3) sets it beside the
    text; ``main`` whether it is in an article that stands under no such element."""

    __slots__ = ("name", "words", "side", "article", "main", "link", "holder", "paragraph")

    def __init__(self, name: str, words: list[str], side: int, above: Element | None, free: bool):
        self.name, self.words, self.side = name, words, side
        self.article = name in ("article", "main") or bool(above and above.article)
        self.main = name in ("article", "main") and free or bool(above and above.main)
        self.paragraph = name == "p" or bool(above and above.paragraph)
        self.link = name == "a" or bool(above and above.link and name not in BLOCKS)
        self.holder = name if name in BLOCKS else above.holder if above else "body"


@dataclass
class Token:
    kind: str  # ``w <setting>``: a run of words; ``t <tag>``: a tag; " ": white space
    text: str
    block: int
    within: tuple[Element, ...]  # elements beside the text that hold it
    article: bool
    main: bool = False
    words: tuple[str, ...] = ()  # class words of the elements that hold it, for fitting


def side_of(name: str, words: list[str], comments: bool, above: Element | None, weights: dict[str, float]) -> int:
    if name in ("html", "body", "article", "main"):
        return 0
    if name in SIDE_NAMES or name == "header" and not (above and above.article) or name in ("button", "label") and not (above and above.paragraph):
        return 2
    marks = [w for w in words if class_share(w, weights) < 0.5]
    return 3 if comments and not COMMENT_WORDS.isdisjoint(marks) else int(bool(marks))


def class_share(word: str, weights: dict[str, float]) -> float:
    """Share of the words under a class word that are main text."""
    if (known := weights.get(f"c {word}")) is not None:
        return known
    a, b = PRIOR_SIDE if word in SIDE_WORDS else PRIOR_OTHER
    return a / (a + b)


def tokens(page: str, weights: dict[str, float] | None = None, one_article: bool = False) -> list[Token]:
    """The words and tags of a page, with what holds them; ``one_article``: what holds an article is not beside the text."""
    weights = weights or {}
    stack: list[Element] = []
    out: list[Token] = []
    block, at, within, words = 0, 0, (), ()

    def text(piece: str) -> None:
        piece = html_lib.unescape(piece)
        top = stack[-1] if stack else None
        if piece.strip():
            kind = f"w {top.holder if top else 'body'}{' a' if top and top.link else ''}"
            out.append(Token(kind, piece, block, within, bool(top and top.article), bool(top and top.main), words))
        elif piece:
            out.append(Token(" ", piece, block, within, False))

    def closed_to(k: int) -> None:
        nonlocal within, words
        del stack[k:]
        within = tuple(e for e in stack if e.side)
        words = tuple(w for e in stack for w in e.words)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[1]:  # a raw element
            out.append(Token(f"t {m[1].lower()}", "", block, within, bool(stack and stack[-1].article)))
            continue
        if not m[3]:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        name = m[3].lower()
        if name == "br":
            out.append(Token(" ", " ", block, within, False))
        if name in BLOCKS:
            block += 1
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    closed_to(k)
                    break
        else:
            if name in BLOCKS and name not in ("td", "th", "tr"):  # an open paragraph ends where a block begins
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == "p":
                        closed_to(k)
                        break
                    if stack[k].name in BLOCKS:
                        break
            if name not in VOID and not m[4].endswith("/"):
                own = class_words(m[4]) if m[4] else []
                above = stack[-1] if stack else None
                e = Element(name, own, side_of(name, own, bool(own) and for_comments(m[4]), above, weights), above, not within)
                if one_article and name in ("article", "main"):
                    for x in stack:
                        x.side = 0
                    within = ()
                stack.append(e)
                if e.side:
                    within = (*within, e)
                if own:
                    words = (*words, *own)
        out.append(Token(f"t {name}", "", block, within, bool(stack and stack[-1].article)))
    if at < len(page):
        text(page[at:])
    return out


def tally(page: str | None) -> Counter:
    """Of a labelled page: ``(kind, inside)`` counts; nothing where no single element is marked."""
    found = tokens(page or "", one_article=True)
    if sum(t.kind in ("t article", "t main") for t in found) not in (1, 2):
        return Counter()
    out: Counter = Counter()
    for t in found:
        side = any(e.side for e in t.within)
        inside = t.article and not side
        if t.kind[0] == "w":
            n = len(t.text.split())
            if not side:
                out[t.kind, inside] += n
            if not (t.article and side):  # what stands beside the text within an article teaches nothing about its words
                for w in set(t.words):
                    out[f"c {w}", t.article] += n
        elif t.kind != " ":
            out[t.kind, inside] += 1
    return out


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> dict[str, float]:
    """Weight of each kind of token and share of each class word, from the labelled pages among a bounded sample."""

    def work(batches):
        for batch in batches:
            total: Counter = Counter()
            for page in batch["html"]:
                total.update(tally(page))
            yield pd.DataFrame([(k, bool(i), float(n)) for (k, i), n in total.items()], columns=["kind", "inside", "n"])

    some = sample_by_hash(pages.where("html IS NOT NULL").select("page_id", F.col("html").cast("string").alias("html")), train_pages, "page_id", "html")
    counts = some.select("html").mapInPandas(work, "kind string, inside boolean, n double")
    got = counts.groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0.0)).alias("i"), F.sum("n").alias("n")).collect()
    return {r["kind"]: weight(r["kind"], r["i"], r["n"] - r["i"]) for r in got}


def weight(kind: str, inside: float = 0.0, outside: float = 0.0) -> float:
    """Positive for words, negative for tags; of a class word, the share that is main text."""
    if kind[0] == "c":
        a, b = PRIOR_SIDE if kind[2:] in SIDE_WORDS else PRIOR_OTHER
    else:
        a, b = PRIOR_WORD if kind[0] == "w" else PRIOR_TAG
    share = (inside + a) / (inside + outside + a + b)
    return share - 1 if kind[0] == "t" else share


def best_run(gain: np.ndarray) -> tuple[int, int, float]:
    """``gain[i:j]`` with the largest sum (the first such), and that sum; empty where none is positive."""
    total = np.concatenate(([0.0], np.cumsum(gain)))
    low = np.minimum.accumulate(total)
    j = int(np.argmax(total - low))
    most = float(total[j] - low[j])
    return (int(np.argmax(total[: j + 1] == low[j])), j, most) if most > 0 else (0, 0, 0.0)


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    found = tokens(page or "", weights)
    plain = np.zeros(len(found))
    for i, t in enumerate(found):
        if t.kind != " ":
            w = weights[t.kind] if t.kind in weights else weight(t.kind)
            plain[i] = w * len(t.text.split()) if t.kind[0] == "w" else w
    # where the page marks its article, what stands outside it hides nothing of it
    scope = np.array([t.main for t in found], bool)
    if not any(t.main and t.kind[0] == "w" for t in found):
        scope[:] = True
    while True:
        side = np.array([max((e.side for e in t.within), default=0) for t in found], np.int64)
        shown = side == 0
        score = lambda seen: best_run(np.where(seen & scope, plain, 0.0))[2]  # noqa: E731,B023
        kind = next((k for k in (1, 2) if score(shown) < (1 - HIDDEN) * score(side <= k)), 0)
        if not kind and not score(shown) and score(side <= 3):
            kind = 3
        if not kind:
            break
        held: dict[Element, float] = {}  # score under each element whose mark may be wrong
        for t, g in zip(found, np.where(scope, plain, 0.0), strict=True):
            if g > 0 and 0 < max((e.side for e in t.within), default=0) <= kind:
                for e in t.within:
                    held[e] = held.get(e, 0.0) + g
        largest = max(held.values())
        for e, g in held.items():
            if g >= largest:  # what holds the most, and what holds just that
                e.side = 0
    i, j, _ = best_run(np.where(shown, plain, 0.0))
    touched = {t.block for t, s in zip(found[i:j], shown[i:j], strict=True) if t.kind[0] == "w" and s}
    parts: dict[int, list[str]] = {}
    for t, s in zip(found, shown, strict=True):
        if s and t.block in touched and t.kind[0] in "w ":
            parts.setdefault(t.block, []).append(t.text)
    lines = (" ".join("".join(parts[b]).split()) for b in sorted(parts))
    return "\n".join(x for x in lines if x)


def extracted(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; weights are fitted where none are given."""
    weights = fit(pages) if weights is None else weights

    def work(batches):
        for batch in batches:
            text = [extract(p, weights) for p in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
