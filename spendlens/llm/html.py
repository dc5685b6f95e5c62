"""Main text of web pages by two passes of block rules.

A page falls into blocks at block-level tags. The first pass decides a block
where it can: structure (menus, page headers, footers, sidebars, forms, ads,
notices, reader comments), link density and a copyright sign make it bad; length
with the density of stop words makes it good. How dense prose is depends on the
language and the kind of text, so densities are held against that of all
unlinked text of the page (`MANY_OF`, `SOME_OF`), up to the usual thresholds. Short
blocks, those of middling density and long ones of few stop words stay
ambiguous; of few stop words and no great length is bad, in a marked article only
if it is partly linked. Where stop words are rare on the whole page, its language
is not known and length alone speaks. An article that the page marks is evidence
only: in it a dense block need not be long.
The second pass gives an ambiguous block the label of its nearest decided
neighbour on the same side of an article's edge; blocks that structure has made
bad are in other containers and are no neighbours. Between a good and a bad one
as near, a block of middling density is good and a short one bad. A short
heading goes with the block after it. A page of short blocks has the unlinked
ones of its article, or all if it marks none.

A name that speaks of a menu, an advert and the like makes a container bad,
unless it holds the page's article (the largest, if larger than the text outside
articles), or most of the page's text while no such article of some size lies
outside it; blocks of links don't count. Tags of what is never text that are
left open end at the next block tag.

A null page has the empty text, as has a page without good blocks. Markup that
is cut off ends with the page. Very long pages are read in one pass over their
tags. Repeated rows give repeated rows; other columns pass if named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

# Frequent function words of English, German, French, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset(
    """
    a about after all also an and are as at be been but by can do for from had has have he her his how if in into is it its more no
    not of on one or our out said she so some that the their there they this to up was we were what when which who will with would you
    aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich ihr im ist kann
    man mit nach nicht noch nur oder sein sich sie sind über um und uns vom von vor war wenn werden wie wir wird zu zum zur
    au aux avec ce cette ces comme dans de du elle en est et il ils je la le les leur lui mais ne nous ou où par pas plus pour qu que
    qui sa se ses son sont sur tout un une vous y été être
    al con como cuando el ella entre era esta este ha hay lo los las más muy o para pero por porque sin sobre su sus también una unos ya
    agli ai alla alle anche che chi ci col come con cui da dal dalla degli dei del della delle di e gli ha hanno il io la le lo ma mi nel nella non o per
    più quando questa questo se si sono sul sulla suo tra un una uno
    ao aos as até com da das de depois dos ela em entre essa eu foi isso já mais mas mesmo muito na nas no nos num não os ou pela pelo por quem
    sem ser seu sua são só também tem uma você à é
    aan als bij dan dat de deze die dit door een en er haar heeft het hij hun ik je kan maar met naar niet nog of om onder ook op over te tot
    uit van voor was wat werd wij worden wordt ze zich zij zijn zou
    """.split()
)
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body caption center col colgroup dd details dialog div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table
    tbody td tfoot th thead tr ul
    """.split()
)
#: Their content is never text of the page.
RAW_TAGS = frozenset("script style noscript template textarea title iframe object svg math select button canvas audio video noembed noframes xmp".split())
#: What is inside them is not the article.
BAD_TAGS = frozenset("nav footer aside form menu search dialog fieldset".split())
#: Of RAW_TAGS, those that can be left open: without an end they go up to the next block tag.
SOFT_TAGS = frozenset("button select object svg math canvas audio video".split())
CONTAINERS = BAD_TAGS | frozenset("article main header section div ul ol dl table figure blockquote details body".split())
#: Parts of class, id or role that mark menus, adverts, notices, comments and the like.
BAD_NAMES = frozenset(
    """
    ad ads adbox adslot adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments
    commentlist complementary consent contentinfo cookie cookies copyright dialog disqus footer gdpr login masthead menu modal nav navbar
    navigation newsletter notice notices overlay pager pagination popup promo promotion recommended recommendations related replies
    reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets
    """.split()
)
LINKED = 0.33
SHORT = 70
LONG = 200
SOME_STOPS = 0.30
MANY_STOPS = 0.32
#: Shares of the page's own density that count as some and as many, where that is less.
SOME_OF = 0.3
MANY_OF = 0.6
#: Linked characters from which a block of few stop words is bad in an article too.
PARTLY = 0.15
#: Stop words are rarer than this on a page of none of the languages above.
KNOWN_STOPS = 0.08

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_ENDS: dict[str, re.Pattern] = {}
_STARTS: dict[str, re.Pattern] = {}
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK_TAGS))})(?=[\s/>])", re.I)


class Block:
    __slots__ = ("article", "bad", "heading", "linked", "mark", "named", "text")

    def __init__(self, text: str, linked: int, bad: bool, article: bool, heading: bool, named: int, mark: int):
        self.text, self.linked, self.bad, self.article, self.heading, self.named, self.mark = text, linked, bad, article, heading, named, mark


def _bad_names(attributes: str, inside: bool) -> bool:
    for m in _NAMES.finditer(attributes):
        parts = {p.lower() for p in _PARTS.findall(m[1] or m[2] or m[3] or "")}
        if parts & BAD_NAMES or (not inside and "header" in parts):
            return True
    return False


def _condemn(found: list[Block], named: list[int], marks: list[tuple[int, int]]) -> None:
    """Make bad the blocks in badly named containers, but for those that hold the page's text.

    named: the next such container around each; marks: the next named container around (or itself) and the next mark around each
    article or main. An index of -1 is none; those around come first.
    """
    chars, sizes = [0] * len(named), [0] * len(marks)  # of text that isn't mostly links
    direct = [0] * (len(marks) + 1)  # without the marks inside; last, outside all
    total = 0
    for b in found:
        if not b.bad and b.linked <= LINKED * len(b.text):
            total += len(b.text)
            direct[b.mark] += len(b.text)
            if b.named >= 0:
                chars[b.named] += len(b.text)
            if b.mark >= 0:
                sizes[b.mark] += len(b.text)
    for i in range(len(named) - 1, -1, -1):
        if named[i] >= 0:
            chars[named[i]] += chars[i]
    for i in range(len(marks) - 1, -1, -1):
        if marks[i][1] >= 0:
            sizes[marks[i][1]] += sizes[i]
    largest = [-1] * (len(marks) + 1)
    for i, (_, around) in enumerate(marks):
        if largest[around] < 0 or sizes[i] > sizes[largest[around]]:
            largest[around] = i
    best = -1  # the article of the page: where most text of those around it lies
    while (inner := largest[best]) >= 0 and sizes[inner] > direct[best]:
        best = inner
    holders, within = set(), set()
    if best >= 0:
        i = marks[best][0]
        while i >= 0:
            holders.add(i)
            i = named[i]
        inside = [False] * len(marks)
        for i, (_, around) in enumerate(marks):
            inside[i] = i == best or (around >= 0 and inside[around])
        within = {b.named for b in found if b.mark >= 0 and inside[b.mark]}
        for i in range(len(named) - 1, -1, -1):
            if i in within:
                within.add(named[i])
    bad = [False] * len(named)
    for i, around in enumerate(named):
        apart = best >= 0 and i not in within and sizes[best] >= LONG and 4 * sizes[best] >= chars[i]
        spared = i in holders or (chars[i] > LONG and 2 * chars[i] >= total and not apart)
        bad[i] = not spared or (around >= 0 and bad[around])
    for b in found:
        b.bad = b.bad or (b.named >= 0 and bad[b.named])


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with what their tags say about them."""
    out: list[Block] = []
    # tag, bad, article, named, mark: of the open containers, each with those around it
    stack: list[tuple[str, bool, bool, int, int]] = []
    outside = ("", False, False, -1, -1)
    named: list[int] = []
    marks: list[tuple[int, int]] = []
    ends: dict[str, re.Match | None] = {}
    text: list[str] = []
    linked = 0
    link = heading = False
    breaks = 0

    def close() -> None:
        nonlocal text, linked, breaks
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                _, bad, article, name, mark = stack[-1] if stack else outside
                out.append(Block(joined, linked, bad, article, heading, name, mark))
            text = []
        linked = breaks = 0

    def add(raw: str) -> None:
        nonlocal linked, breaks
        if raw:
            text.append(raw)
            if link:
                linked += len(" ".join(unescape(raw).split()))
            if breaks and not raw.isspace():
                breaks = 0

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ending, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW_TAGS:
            if not ending and not attributes.endswith("/"):
                if tag not in ends or (ends[tag] and ends[tag].start() < at):
                    ends[tag] = _ENDS.setdefault(tag, re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I)).search(page, at)
                end = ends[tag]
                stop = end.end() if end else n
                if tag in SOFT_TAGS:
                    # Open: another one, or no end at all, comes after a block tag.
                    again = _STARTS.setdefault(tag, re.compile(rf"<{tag}\b", re.I)).search(page, at, end.start() if end else n)
                    if again or not end:
                        block = _BLOCK.search(page, at, again.start() if again else n)
                        stop = block.start() if block else again.start() if again and not end else stop
                at = stop
        elif tag == "a":
            link = not ending
        elif tag == "br":
            breaks += 1
            if breaks > 1:
                close()
            else:
                text.append(" ")
        elif tag in BLOCK_TAGS:
            close()
            link = False
            heading = tag[0] == "h" and tag[1:].isdigit() and not ending
            if tag in CONTAINERS:
                if not ending:
                    _, bad, article, name, mark = stack[-1] if stack else outside
                    own = tag in BAD_TAGS or (tag == "header" and not article)
                    if attributes and tag != "body":
                        own = own or bool(_HIDDEN.search(attributes))
                        if _bad_names(attributes, article):
                            named.append(name)
                            name = len(named) - 1
                    if tag in ("article", "main"):
                        marks.append((name, mark))
                        mark = len(marks) - 1
                    stack.append((tag, bad or own, article or tag in ("article", "main"), name, mark))
                elif any(s[0] == tag for s in stack):
                    while stack.pop()[0] != tag:
                        pass
    close()
    _condemn(out, named, marks)
    return out


GOOD, BAD, NEAR, SHORT_BLOCK = "good", "bad", "near", "short"


def _stops(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = _WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def first_pass(found: list[Block]) -> list[str]:
    """good, bad, near (ambiguous though not short) or short for each block."""
    open_ = [b for b in found if not b.bad and b.linked <= LINKED * len(b.text)]
    counts = {id(b): _stops(b.text) for b in open_}
    density = sum(s for s, _ in counts.values()) / max(1, sum(n for _, n in counts.values()))
    known = density >= KNOWN_STOPS
    some, many = min(SOME_STOPS, SOME_OF * density), min(MANY_STOPS, MANY_OF * density)
    out = []
    for b in found:
        if id(b) not in counts or b.text[0] in "\u00a9\u2117":
            out.append(BAD)
        elif len(b.text) < SHORT:
            out.append(BAD if b.linked and not b.article else SHORT_BLOCK)
        elif not known:
            out.append(GOOD if len(b.text) > LONG else NEAR)
        else:
            stops, words = counts[id(b)]
            if stops >= many * max(words, 1):
                out.append(GOOD if b.article or len(b.text) > LONG else NEAR)
            elif stops >= some * max(words, 1):
                out.append(NEAR)
            elif b.article:
                out.append(BAD if b.linked > PARTLY * len(b.text) else NEAR)
            else:
                out.append(NEAR if len(b.text) > LONG and not b.linked else BAD)
    return out


def second_pass(labels: list[str]) -> list[str]:
    """Ambiguous blocks take the label of the nearest decided block."""
    n = len(labels)
    before: list[tuple[int, str]] = []
    last = (n + 1, BAD)
    for label in labels:
        last = (0, label) if label in (GOOD, BAD) else (last[0] + 1, last[1])
        before.append(last)
    out, last = list(labels), (n + 1, BAD)
    for i in range(n - 1, -1, -1):
        label = labels[i]
        last = (0, label) if label in (GOOD, BAD) else (last[0] + 1, last[1])
        if label in (NEAR, SHORT_BLOCK):
            (p, a), (q, b) = before[i], last
            if min(p, q) > n:  # the page has no decided block: density speaks
                out[i] = GOOD if label == NEAR else BAD
            elif p != q:
                out[i] = a if p < q else b
            else:
                out[i] = a if a == b else (GOOD if label == NEAR else BAD)
    return out


def labels(found: list[Block]) -> list[str]:
    """good or bad for each block, by both passes; the second stays on one side of an article's edge and passes over what structure made bad."""
    first = first_pass(found)
    out = [BAD] * len(found)
    for article, run in groupby((i for i, b in enumerate(found) if not b.bad), lambda i: found[i].article):
        part = list(run)
        given = [first[i] for i in part]
        if GOOD not in given and BAD not in given:  # nothing is decided: what may be text is
            given = [GOOD if label == NEAR else label for label in given]
        decided = second_pass(given)
        for k in range(len(part) - 2, -1, -1):
            if given[k] == SHORT_BLOCK and found[part[k]].heading and decided[k + 1] == GOOD:
                decided[k] = GOOD
        for i, label in zip(part, decided):
            out[i] = label
    if GOOD not in out:  # nothing but short blocks: those of the article
        marked = any(b.article for b in found)
        out = [GOOD if (b.article or not marked) and label == SHORT_BLOCK and not b.linked else BAD for b, label in zip(found, first)]
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, label in zip(found, labels(found)) if label == GOOD)


def main_texts(pages: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, and text: one row per row of `pages` (html)."""
    small_batches(pages.sparkSession, rows=500)
    kept = pages.select(*keep, F.col("html").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "text string"]))
