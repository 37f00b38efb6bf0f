"""HTML extraction: the best contiguous content region of a page, found by one scan of scored words and tags.

A page is a sequence of words and tags. A word scores by what it stands in (elements, their class, id and role, links,
whether the page has a content container and the word is inside it), by the weights of a logistic regression on labelled pages;
a tag costs what its name is worth on those pages. The maximum-scoring subsequence is the content region. Elements whose
words are no content (menus, adverts, forms, comments) cost their two tags, so that one inside an article does not cut it
in two; their words are left out.

The labelled pages are a rule over a small table of layouts: content and other elements placed before, inside and after each
kind of container. Words are "content" or "other" there, and no feature reads a word, so the label is nothing the model sees.

At scale: one pass of Arrow batches, no shuffle; the model is a few hundred weights; a page is scanned in time linear in its length.

Defined cases: a null or empty page, and one without content, has the text '' and 0 characters; scripts, comments and tags cut off
by the end of a page reach to its end; unknown and unclosed tags are harmless; character references without their semicolon
are read as browsers do; elements nested deeper than 512 are part of that one; br is white space; white space is what str.split takes for it (no-break spaces too); repeated rows
give equal rows; a null page_id or url stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

# --- pages as items --------------------------------------------------------------------------------

#: A comment; a tag (slash, name, attributes) with quoted values that may hold ">"; other markup.
MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]|=\s*+(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|(?!["'])))*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]*))?""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Names of HTML.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose start ends an open one of the same set, up to the element that holds them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
#: Elements of no meaning that are followed for the sake of the rules above.
KEPT_OPEN = frozenset("article aside body div footer form header li main nav p section table td th tr ul ol dl dt dd option".split())
DEPTH = 512  # what is nested deeper counts as part of the element of that depth, as in browsers
#: Elements that a missing end tag inside them does not reach past.
HOLDERS = frozenset("article aside body div footer form header main nav section table td th".split())


def _tokens(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role, in lower case and singular, and marks of hidden elements."""
    out = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop"):
            for token in TOKEN.findall(value):
                token = token.lower()
                out.add(token[:-1] if len(token) > 3 and token[-1] == "s" and token[-2] != "s" else token)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.add("(hidden)")
    return tuple(sorted(out))


class Element:
    """An open element and what it says about the words in it."""

    __slots__ = ("features", "inside", "name")

    def __init__(self, name: str, features: frozenset[str], inside: bool) -> None:
        self.name, self.features, self.inside = name, features, inside


#: Tags of no meaning of their own for what is in them.
PLAIN = frozenset("html body div span p b i em strong u s br hr font center small big sub sup tbody thead tfoot img wbr h1 h2 h3 h4 h5 h6 section blockquote ul ol li dl dt dd table tr td th pre code figure figcaption".split())
CONTAINERS = frozenset(("article", "main"))


@functools.lru_cache(maxsize=100_000)
def _own(name: str, attributes: str) -> tuple[str, ...]:
    tokens = () if name in ("html", "body") else _tokens(attributes)
    return (*(() if name in PLAIN else ("<" + name,)), *tokens)


def items(page: str) -> Iterator[tuple[str, str, frozenset[str], bool]]:
    """(kind, what, features, inside a container) of each run of text ("text") and each tag ("open", "close") in order.

    features are those of the open elements; a tag's are those of the element it belongs to.
    """
    bare = Element("", frozenset(), False)
    stack = [bare]
    at, n = 0, len(page)
    while at < n:
        found = MARKUP.search(page, at)
        start = found.start() if found else n
        if start > at:
            yield "text", page[at:start], stack[-1].features, stack[-1].inside
        if not found:
            return
        at = found.end()
        slash, name, attributes = found.groups()
        if name is None:
            continue
        name = name.lower()
        if slash:
            place = _open_at(stack, name)
            if place:
                top = stack[place]
                yield "close", name, top.features, top.inside
                del stack[place:]
            elif name in BLOCKS:
                yield "close", name, stack[-1].features, stack[-1].inside
            continue
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in CLOSES:
            _end(stack, *CLOSES[name])
        if name in BLOCKS:
            _end(stack, {"p"}, HOLDERS)
        top = stack[-1]
        own = _own(name, attributes)
        if "header" in own or "<header" in own:
            own = (*own, "(header inside)" if top.inside else "(header outside)")
        inside = top.inside or name in CONTAINERS and "comment" not in own  # a reader comment may be an article of its own
        features = top.features.union(own) if own else top.features
        yield "open", name, features, inside
        opens = name not in VOID and (not attributes.endswith("/") or name in CONTAINERS)
        if opens and len(stack) < DEPTH and (own or name not in PLAIN or name in KEPT_OPEN):
            stack.append(Element(name, features, inside))


def _open_at(stack: list[Element], name: str) -> int:
    """The place of the open element of that name, or 0; a misplaced end of an inner element does not close an outer holder."""
    for place in range(len(stack) - 1, 0, -1):
        if stack[place].name == name:
            return place
        if stack[place].name in HOLDERS and name not in HOLDERS and name not in ("html", "body", "head"):
            return 0
    return 0


def _end(stack: list[Element], own: set[str], holders: set[str]) -> None:
    for place in range(len(stack) - 1, 0, -1):
        if stack[place].name in holders:
            return
        if stack[place].name in own:
            del stack[place:]
            return


# --- labelled pages and weights ----------------------------------------------------------------------

CONTENT, OTHER = "content", "other"
#: Layouts around the main text.
AROUND = (
    "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class='content'>{}</div>", "<div id='main-content'>{}</div>",
    "<div class='post'><div class='entry-content'>{}</div></div>", "<section class='story'>{}</section>", "<div role='main'>{}</div>",
    "<article class='post entry'><div class='article-body' itemprop='articleBody'>{}</div></article>", "{}", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>",
    "<div id='page'><div class='page-content text'>{}</div></div>", "<div class='site-main'><div class='article-content'>{}</div></div>",
)
#: Names in class, id or role of what is not the main text.
NAMES = (
    "menu nav navbar navigation breadcrumb main-menu site-nav topbar toolbar header site-header masthead banner logo footer site-footer footer-content "
    "copyright legal sidebar sidebar-content widget related related-posts related-article recommended trending popular notice cookie-notice cookie consent "
    "gdpr alert warning-notice popup modal overlay ad ads advert advertisement adsbygoogle ad-content sponsored sponsor promo promotion form newsletter "
    "subscribe signup search search-form login comment comments comment-content comment-list commentlist reply replies respond disqus thread discussion feedback share social "
    "sharing follow pagination pager tags tag-list meta-links skip-link screen-reader-text contentinfo complementary dialog toc tool rating vote byline-links"
).split()
#: Names of what is part of the main text.
PARTS = "article-header entry-header post-header entry-title post-title headline lead intro summary paragraph text body caption quote section-title entry page".split()
TAGS_OUT = "nav header footer aside form menu noscript template svg button select label dialog object canvas audio video fieldset math".split()
TAGS_IN = "p h1 h2 h3 blockquote li td dd figcaption pre section em strong a span code time cite q abbr mark summary details header".split()


def labelled_pages() -> Iterator[str]:
    """Pages whose words say what they are."""
    text = f"<h1>{CONTENT}</h1><p>{CONTENT} {CONTENT} <a href='x'>{CONTENT}</a> {CONTENT}</p>"
    other = [f"<div class='{n}'><p>{OTHER} {OTHER}</p></div>" for n in NAMES] + [f"<section id='{n}'><ul><li><a href='x'>{OTHER}</a></li></ul></section>" for n in NAMES]
    other += [f"<{t}>{OTHER} <a href='x'>{OTHER}</a></{t}>" for t in TAGS_OUT for _ in range(4)]
    other += [f"<article class='comment'><p>{OTHER} {OTHER}</p></article>", f"<div hidden><p>{OTHER}</p></div>", f"<ul class='menu'><li><a>{OTHER}</a><li><a>{OTHER}</a></ul>"] * 4
    other += [f"<div {a}='{n}'><p>{OTHER} {OTHER}</p></div>" for n in ("header", "masthead", "page-header") for a in ("class", "id") for _ in range(3)]
    parts = [f"<div class='{n}'><p>{CONTENT}</p></div>" for n in PARTS] + [f"<{t}>{CONTENT} {CONTENT}</{t}>" for t in TAGS_IN] + ["<ul><li>content<li>content</ul>", "<table><tr><td>content<td>content</table>"]
    for k, one in enumerate(other):
        for j in range(4):
            around = AROUND[(k + 3 * j) % len(AROUND)]
            part, two = parts[(5 * k + j) % len(parts)], other[(7 * k + 11 * j + 1) % len(other)]
            within = next(x for x in (two, one, other[k - 1], other[k - 2], other[0]) if "head" not in x) if j % 2 else other[0] if "head" in one else one
            if part.startswith("<header") and not around.startswith(("<article", "<main")):
                part = ""
            stray = f"<p>{OTHER} {OTHER}</p>" if around.startswith(("<article", "<main")) else ""
            yield f"<head></head><body>{one if j % 2 else two}{stray}{around.format(text + part + within + text)}{stray}{two}</body>"


@functools.lru_cache(maxsize=1)
def weights() -> tuple[dict[str, float], dict[str, float]]:
    """(weight of a feature of words, with "" for every word; score of a tag, below 0), from the labelled pages."""
    seen: dict[tuple[frozenset[str], int], int] = {}
    tags: dict[str, list[int]] = {}
    for page in labelled_pages():
        found = list(items(page))
        has = _has_container(found)
        for kind, what, features, inside in found:
            if kind == "text":
                for word in what.split():
                    key = _word_features(features, inside, has), int(word == CONTENT)
                    seen[key] = seen.get(key, 0) + 1
            else:
                count = tags.setdefault(what, [0, 0])
                count[not ({"<nav", "<aside", "<form", "<footer"} & features)] += 1
    names = sorted({f for features, _ in seen for f in features})
    column = {f: k for k, f in enumerate(names)}
    rows = np.zeros((len(seen), len(names)))
    for row, (features, _) in zip(rows, seen):
        row[[column[f] for f in features]] = 1
    label = np.array([y for _, y in seen], dtype=float)
    times = np.sqrt(np.array(list(seen.values()), dtype=float))
    times /= times.sum()
    w, momentum = np.zeros(len(names)), np.zeros(len(names))
    for _ in range(3000):  # gradient steps with momentum; the ridge keeps weights of names seen once small
        p = 1 / (1 + np.exp(-rows @ w))
        momentum = 0.9 * momentum - 2.0 * (rows.T @ (times * (p - label)) + 2e-5 * w)
        w += momentum
    costs = {t: -float(np.clip(np.log((out + 1) / (good + 1)) / 4 + 0.05, 0.02, 0.5)) for t, (out, good) in tags.items()}
    return dict(zip(names, w.tolist())), costs


def _has_container(found: list[tuple]) -> bool:
    return any(kind == "text" and inside and what.strip() for kind, what, _, inside in found)


def _word_features(features: frozenset[str], inside: bool, has: bool) -> frozenset[str]:
    return features | {"", "(inside)" if inside else "(outside)" if has else "(no container)"}


# --- extraction -----------------------------------------------------------------------------------------

ANY_TAG = -0.05


class Extractor:
    def __init__(self) -> None:
        self.words, self.tags = weights()
        self.known: dict[tuple[frozenset[str], bool, bool], bool] = {}

    def good(self, features: frozenset[str], inside: bool, has: bool) -> bool:
        """Whether words there are content."""
        key = features, inside, has
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[key] = sum(self.words.get(f, 0.0) for f in _word_features(features, inside, has)) > 0
        return found

    def scored(self, page: str) -> list[tuple[float, str, str]]:
        """(score, kind, what) of the page's items: words of content one each, other words outside a container less one, those of left-out elements nothing."""
        found = list(items(page))
        has = _has_container(found)
        out, left_out = [], False
        for kind, what, features, inside in found:
            good = self.good(features, inside, has)
            if kind == "text":
                n = len(what.split())
                out.append((float(n), kind, what) if good else (-float(n) if has and not inside and not features else 0.0, "", what))
            else:
                counts = good or kind == "open" and not left_out
                out.append((self.tags.get(what, ANY_TAG) if counts else 0.0, kind, what))
            left_out = not good
        return out

    def extract(self, page: str | None) -> str:
        """The main text: blocks joined by newlines."""
        if not page:
            return ""
        scored = self.scored(page)
        start, end = best_run([score for score, _, _ in scored])
        blocks: list[str] = []
        pieces: list[str] = []
        for _, kind, what in scored[start:end]:
            if kind == "text":
                pieces.append(references.unescape(what))
            elif what == "br":
                pieces.append(" ")
            elif what in BLOCKS:
                blocks.append("".join(pieces))
                pieces = []
        blocks.append("".join(pieces))
        lines = (" ".join(block.split()) for block in blocks)
        return "\n".join(line for line in lines if line)


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run of greatest sum, the longest from the earliest start if several; empty if no sum is above 0."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for k, score in enumerate(scores):
        if run < 0:
            run, start = 0.0, k
        run += score
        if run > best or run == best > 0 and start == found[0]:
            best, found = run, (start, k + 1)
    return found


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    shared.bound_batches(pages.sparkSession, 4 << 20)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extractor.extract(page) for page in part.column("html").to_pylist()]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(shared.trimmed(work), "page_id long, url string, text string, n_chars long")
