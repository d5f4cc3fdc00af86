"""Main text of web pages by the best-scoring run of words and tags."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casewell.llm.common import text_batches

TRAIN_PAGES = 2_000             # labelled pages that the weights are fitted on
#: Elements that never hold article text, elements that start a new block, and elements without end.
ASIDE = frozenset("noscript template iframe object embed svg math canvas audio video select option datalist button form nav "
                  "header footer aside menu dialog head".split())
BLOCKS = frozenset("address article blockquote body center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 "
                   "h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: Names of page furniture in class and id, words that only name a container, words that deny, and roles.
FURNITURE = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments "
                      "commentlist cookie cookies consent disclaimer disqus dropdown footer form gdpr header masthead menu "
                      "modal nav navbar navigation newsletter notice notification notifications pager pagination popup promo "
                      "promoted recommended related replies reply respond search share sharing shoutbox sidebar signup "
                      "skip social sponsor sponsored subscribe tags toolbar topbar widget widgets".split())
CONTAINERS = frozenset("area bar block box buttons container group inner item items left links list outer panel right row "
                       "section slot thread top unit wrap wrapper".split())
DENIALS = frozenset("with without has have no non not".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog".split())
LABELLED = ("article", "main")
MOST = 0.9                      # share of the words that are in no other furniture that makes an element none, whatever its name
IN_LABEL = 0.02                 # what a tag costs inside a labelled element, as a share of its cost elsewhere

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*/?>"
                    r"|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKED = re.compile(r"class|id|role|hidden", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
#: Elements whose end tag may be left out: a start of the same kind ends the one before.
_SELF_CLOSING = frozenset("li dt dd tr td th option".split())


@dataclass
class Weights:
    """Score of a word and cost of each tag.

    ``link_word`` is what a word inside a link scores, ``outside`` a word outside the labelled element of a page that has one,
    ``furniture`` a whole element of page furniture.
    """

    word: float = 1.0
    link_word: float = -0.5
    outside: float = -1.0
    furniture: float = -3.0
    other: float = -1.0
    tags: dict[str, float] = field(default_factory=dict)


def _names_furniture(value: str) -> bool:
    """Whether a class or id names furniture: the last part of the name that is no container word, unless it is denied."""
    parts = [p.lower() for p in _PARTS.findall(value)]
    while len(parts) > 1 and (parts[-1] in CONTAINERS or parts[-1].isdigit()):
        parts.pop()
    return bool(parts) and parts[-1] in FURNITURE and parts[0] not in DENIALS


def _hint(name: str, raw: str) -> bool:
    """Whether a start tag looks like page furniture by its kind or by its class, id, role or hidden attribute."""
    if name in ASIDE:
        return True
    if not _MARKED.search(raw, len(name) + 1):
        return False
    for key, a, b, c in _ATTRIBUTE.findall(raw[len(name) + 1:]):
        key, value = key.lower(), (a or b or c).strip()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id") and any(map(_names_furniture, value.split())):
            return True
    return False


@dataclass
class Item:
    """A tag, or a run of text with the block it belongs to."""

    tag: str = ""
    text: str = ""
    block: int = 0
    words: int = 0
    linked: bool = False
    inside: bool = False        # in a labelled element
    dropped: bool = False       # in an element of page furniture
    border: bool = False        # the first item of such an element


@dataclass
class _Element:
    name: str
    hint: bool
    start: int
    end: int = 0


def items(page: str) -> list[Item]:
    """Tags and texts of a page in order; block numbers rise at block borders, furniture and labelled elements are marked.

    An element that looks like furniture is none if it holds most words of the page's labelled elements or, unless its kind says
    it (forms aside), most of the words around it and nearly all that are in no other furniture.  Around it is the page, or
    the marked or labelled element that it stands in.
    """
    out: list[Item] = []
    stack: list[_Element] = []
    opened: Counter[str] = Counter()
    whole = _Element("", False, 0)
    marked: list[tuple[_Element, _Element]] = []            # looks like furniture; the marked or labelled element around it
    labels: list[_Element] = []
    around: list[_Element] = [whole]                        # marked and labelled elements that are open
    block = links = at = 0

    def close() -> None:
        done = stack.pop()
        opened[done.name] -= 1
        done.end = len(out)
        if around[-1] is done:
            around.pop()

    while at < len(page):
        found = _TOKEN.match(page, at)
        part, at = found[0], found.end()
        name_found = _NAME.match(part) if part[0] == "<" else None
        if name_found is None:
            if part[0] != "<" or part == "<":
                text = html.unescape(part)
                out.append(Item(text=text, block=block, words=len(text.split()), linked=links > 0))
            continue
        name, opens = name_found[1].lower(), part[1] != "/"
        if name in RAW:                                     # what it holds is no markup, up to its own end tag
            if opens:
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "a":
            links = links + 1 if opens else max(0, links - 1)
        elif name in BLOCKS:
            links = 0
        block += name in BLOCKS
        if opens:
            if name in BLOCKS and stack and stack[-1].name == "p":
                close()
            if name in _SELF_CLOSING and stack and stack[-1].name == name:
                close()
            hint = name not in VOID and not part.endswith("/>") and _hint(name, part)
            block += hint and name not in BLOCKS
            if name not in VOID and not part.endswith("/>") and (hint or name in BLOCKS):
                mine = _Element(name, hint, len(out))
                stack.append(mine)
                opened[name] += 1
                hint = hint and name not in ("body", "html")
                if hint:
                    marked.append((mine, around[-1]))
                if name in LABELLED and not any(opened[x] > (x == name) for x in LABELLED):
                    labels.append(mine)
                if hint or name in LABELLED:
                    around.append(mine)
            out.append(Item(tag=name, block=block))
        else:
            out.append(Item(tag=f"/{name}", block=block))
            if opened[name]:
                block += name in ASIDE
                while stack[-1].name != name:
                    close()
                close()
    while stack:
        close()
    whole.end = len(out)
    words = [0, *accumulate(x.words for x in out)]

    def size(e: _Element) -> int:
        return words[e.end] - words[e.start]

    labels = [e for e in labels if not e.hint and size(e)] or [e for e in labels if size(e)]
    starts, held = [e.start for e in labels], [0, *accumulate(map(size, labels))]
    plain = {id(outer): size(outer) for _, outer in marked}
    for e, outer in marked:
        plain[id(outer)] -= size(e)
    after = 0
    for e, outer in marked:
        if e.start < after:
            continue                                        # in furniture already
        holds = held[bisect_left(starts, e.end)] - held[bisect_left(starts, e.start)]
        most = 2 * size(e) > size(outer) and size(e) >= MOST * (size(e) + plain[id(outer)])
        if 2 * holds > held[-1] or most and (e.name == "form" or e.name not in ASIDE):
            continue
        after = e.end
        for x in out[e.start:e.end]:
            x.dropped = True
        if e.start < e.end:
            out[e.start].border = True
    for e in labels:
        for x in out[e.start:e.end]:
            x.inside = True
    return out


def fit(pages: Iterator[str]) -> Weights:
    """Weights from pages that label their article: log odds of lying outside it, per tag.

    A tag that stands outside as often as inside costs little, one that is seen outside only costs much; a word's score is
    held at 1.  Furniture counts as outside.  Pages without a labelled element say nothing.
    """
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page in pages:
        seen = items(page)
        if not any(x.inside and x.words and not x.dropped for x in seen):
            continue
        for x in seen:
            (inside if x.inside and not x.dropped else outside)[x.tag] += 1 if x.tag else x.words
    total_in, total_out = max(1, sum(inside.values())), max(1, sum(outside.values()))
    cost = {t: -max(0.5, min(6.0, 3.0 + math.log(((outside[t] + 1) / (total_out + 20)) / ((inside[t] + 1) / (total_in + 20)))))
            for t in {*inside, *outside} - {""} if inside[t] + outside[t] >= 20}
    # block and line tags cost a fraction of a word, or short paragraphs at the ends of an article would be lost
    for t in ("p", "/p", "br", "b", "/b", "i", "/i", "em", "/em", "strong", "/strong", "span", "/span", "h1", "/h1", "h2", "/h2"):
        cost[t] = max(-0.5, cost.get(t, -0.5))
    return Weights(tags=cost)


def scores_of(seen: list[Item], weights: Weights) -> list[float]:
    """What every item adds to a run.

    Words score, tags and words in links cost, furniture costs once and says nothing else.  Where a page labels its article, words
    outside cost, and tags inside cost next to nothing.
    """
    labelled = any(x.inside and x.words and not x.dropped for x in seen)
    out = []
    for x in seen:
        share = IN_LABEL if labelled and x.inside else 1.0
        if x.dropped:
            out.append(weights.furniture * share if x.border else 0.0)
        elif x.tag:
            out.append(weights.tags.get(x.tag, weights.other) * share)
        elif labelled:
            out.append(x.words * (weights.word if x.inside else weights.outside))
        else:
            out.append(x.words * (weights.link_word if x.linked else weights.word))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of greatest sum, in one pass; (0, 0) if nothing is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, at = total, (start, k + 1)
    return at


def main_text(page: str, weights: Weights) -> str:
    """The blocks of the best run, one line each, with white space inside a block made one space."""
    seen = items(page)
    first, after = best_run(scores_of(seen, weights))
    lines: list[str] = []
    block, words = None, ""
    for x in seen[first:after]:
        if x.tag and x.tag.lstrip("/") == "br":
            words += " "
        if x.tag or x.dropped:
            continue
        if x.block != block:
            lines.append(words)
            block, words = x.block, ""
        words += x.text
    lines.append(words)
    return "\n".join(filter(None, (" ".join(line.split()) for line in lines)))


def training_pages(pages: DataFrame, html_col: str = "html", limit: int = TRAIN_PAGES) -> list[str]:
    """At most ``limit`` pages of at most 200,000 characters, to fit on."""
    text = F.col(html_col).cast("string")
    rows = pages.where(F.length(text) <= 200_000).where(text.rlike("(?i)<(article|main)[ >]")).select(text).limit(limit)
    return [r[0] for r in rows.toLocalIterator()]


def extract(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """Main text of every page: ``page_id``, ``url``, ``text`` and ``n_chars``.

    Words score, tags cost, words in links cost too; on every page the run of greatest sum is the content region.  Elements that
    look like page furniture by kind, class, id, role or hidden attribute score nothing and are left out of the text, unless they
    hold most of the words.  <article> and <main> lift the scores of what they hold over the rest of the page.
    Weights are fitted on a bounded number of pages with such an element unless given.

    Null pages are empty; unclosed and wrongly nested tags are accepted; repeated rows and null ids are kept; other
    columns are ignored; an empty table gives an empty result; pages of any length are scanned whole, once.
    """
    if weights is None:
        weights = fit(training_pages(pages, html_col))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(2)
            at = 0
            for keys, texts in text_batches([batch.select([0, 1])]):
                found = [main_text(t, weights) if t else "" for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [keys, urls.slice(at, len(keys)), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                    ["page_id", "url", "text", "n_chars"])
                at += len(keys)

    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).cast("string").alias("html"),
                        F.col(url_col).cast("string").alias("url")).mapInArrow(
        work, "page_id bigint, url string, text string, n_chars bigint")
