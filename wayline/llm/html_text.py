"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags; what is no text (scripts, styles,
form controls, media, hidden elements) makes none. The first pass looks at each
block by itself: link density, stop-word density and length make it good, bad,
short or doubtful. What a page declares is one feature of this: a block in a menu,
advert, comment section and the like, or outside the part that it declares by
``article`` or ``main``, is bad. In the second pass a doubtful block needs bad ones
on both sides to be bad, and short blocks inherit the label of the nearest decided
one; a block that was bad by declaration says nothing about what stands next to
it. Stop words are those of the page's own language, the list that it holds most of.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wayline.llm.batches import small_batches

# Frequent words of the languages that pages are in.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be by this from at have an or not which but were a has had",
    "fr": "le la les de des du et un une en est que qui dans pour sur par pas au aux ce il elle avec plus son se ne sont ou",
    "de": "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch es an er so dass werden aus bei",
    "es": "el los las del y que no una por con su para como al lo más o pero sus esta entre cuando muy sin sobre también",
}
_STOP_WORDS = {language: frozenset(words.split()) for language, words in STOP_WORDS.items()}
# HTML elements.
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td
    tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("head title script style noscript template svg math iframe object canvas button select textarea video audio".split())
OTHER = frozenset("nav aside footer form dialog menu".split())
MAIN = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_LIKE = frozenset("p li dt dd tr td th option".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_WHOLE = frozenset(["html", "body", "main"])
_CUES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter"
    r"|subscri\w+|sidebar|widget|related|recommend\w*|shar(?:e|ing)|social|breadcrumbs?|menu|nav|navbar|navigation|footer|comments?"
    r"|disqus|repl(?:y|ies)|respond|pagination|pager|login|signup|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
_OUTER_CUES = re.compile(r"(?:^|[\s_-])(?:header|masthead|top-?bar|legal|copyright)(?:$|[\s_-])", re.I)
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"\w+")
GOOD, BAD, SHORT, DOUBTFUL = "good", "bad", "short", "doubtful"


class Block:
    """One block: its text, how much of it stands in links, the element it is in, and what the page declares about it."""

    __slots__ = ("inside", "label", "linked", "links", "other", "pieces", "tag", "text")

    def __init__(self, tag: str, inside: bool, other: bool) -> None:
        self.pieces: list[str] = []
        self.tag, self.inside, self.other = tag, inside, other
        self.linked = self.links = 0
        self.label = self.text = ""


# Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_TAG = re.compile(r"[a-zA-Z][^\t\n\f\r />]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)?(?:\s*=\s*)?")
_VALUE = re.compile(r"[^\s>]*")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


class _Tags:
    """Splits a page into tags and text and hands them to its methods, in one pass.

    Whatever is not closed - a comment, a tag, an element of raw text - goes on to
    the end of the page, a quote that is not closed to the end of its tag. What
    has once not been found is not looked for again, so the work is linear in the page.
    """

    page = ""

    def _find(self, what: str, start: int) -> int:
        if what in self.gone:
            return -1
        at = self.page.find(what, start)
        if at < 0:
            self.gone.add(what)
        return at

    def feed(self, page: str) -> None:
        self.page, self.gone = page, set()
        at, data, size = 0, 0, len(page)  # ``data``: where text began that isn't handed on yet
        while at < size:
            open_ = page.find("<", at)
            if open_ < 0 or open_ + 1 >= size:
                break
            c = page[open_ + 1]
            named = page[open_ + 2 : open_ + 3] if c == "/" else c
            if not (c in "!?/" or named.isascii() and named.isalpha()):
                at = open_ + 1
                continue
            if data < open_:
                self.handle_data(unescape(page[data:open_]))
            data = at = size if (end := self._markup(open_, c, named)) < 0 else end
        if data < size:
            self.handle_data(unescape(page[data:]))

    def _markup(self, open_: int, c: str, named: str) -> int:
        """Handles the markup at ``open_``; where it ends, -1 if that is nowhere."""
        page = self.page
        if page.startswith("<!--", open_):
            if page.startswith((">", "->"), open_ + 4):
                return page.index(">", open_ + 4) + 1
            return end + 3 if (end := self._find("-->", open_ + 4)) >= 0 else -1
        if not (named.isascii() and named.isalpha()):
            return end + 1 if (end := self._find(">", open_ + 2)) >= 0 else -1
        if c == "/":
            end = self._find(">", open_ + 2)
            if end >= 0:
                self.handle_endtag(_TAG.match(page, open_ + 2).group().lower())
            return end + 1 if end >= 0 else -1
        if self._find(">", open_) < 0:
            return -1
        name = _TAG.match(page, open_ + 1)
        tag, at, attrs = name.group().lower(), name.end(), []
        while at < len(page) and page[at] != ">":
            met = _ATTRIBUTE.match(page, at)
            at, value = met.end(), None
            if "=" in page[met.end(1) if met.group(1) else met.start() : at]:
                quote = page[at : at + 1]
                end = self._find(quote, at + 1) if quote and quote in "\"'" else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    found = _VALUE.match(page, at)
                    value, at = found.group(), found.end()
            if met.group(1):
                attrs.append((met.group(1).lower(), unescape(value) if value else value))
        if at >= len(page):
            return -1
        self.handle_starttag(tag, attrs)
        if tag in RAW:
            if page[at - 1] == "/":
                self.handle_endtag(tag)
            else:
                end = _RAW_END[tag].search(page, at)
                return end.start() if end else -1
        return at + 1


class _Blocks(_Tags):
    """The blocks of a page in order. Each tag costs the elements that it opens or closes, whatever is open."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []  # open elements: no text there, declared to be something else
        self.open: Counter[str] = Counter()
        self.containers: list[int] = []  # places of the block-level ones in the stack
        self.no_text = self.other = self.mains = 0
        self.blocks: list[Block] = []
        self.block: Block | None = None

    def _pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            tag, no_text, other = self.stack.pop()
            self.open[tag] -= 1
            self.no_text -= no_text
            self.other -= other
            self.mains -= tag in MAIN
            if tag in BLOCK:
                self.containers.pop()
                self.block = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.block = None
            if self.containers:
                nearest = self.stack[self.containers[-1]][0]
                # a paragraph ends where a block begins, an element of a list or table where the next begins
                if nearest == "p" and (tag == "p" or len(self.stack) - 1 == self.containers[-1]) or nearest == tag and tag in _ENDS_LIKE:
                    self._pop_to(self.containers[-1])
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        hidden, declared = self._declared(tag, attrs) if attrs else (False, False)
        no_text = tag in NO_TEXT or hidden
        other = declared or tag in OTHER or tag == "header" and not self.mains
        if tag in BLOCK:
            self.containers.append(len(self.stack))
        elif tag == "a" and self.block is not None:
            self.block.links += 1
        self.stack.append((tag, no_text, other))
        self.open[tag] += 1
        self.no_text += no_text
        self.other += other
        self.mains += tag in MAIN

    def _declared(self, tag: str, attrs: list) -> tuple[bool, bool]:
        """Whether the attributes hide an element, and whether they declare it to be something else than main text."""
        a = {k: v or "" for k, v in attrs}
        if tag not in _WHOLE and ("hidden" in a or a.get("aria-hidden") == "true" or _HIDES.search(a.get("style", ""))):
            return True, False
        if a.get("role", "").lower() in _ROLES:
            return False, True
        if tag in _WHOLE or tag == "article" and not self.mains and "comment" not in a.get("class", ""):
            return False, False
        named = f"{a.get('class', '')} {a.get('id', '')}"
        return False, bool(_CUES.search(named)) or not self.mains and bool(_OUTER_CUES.search(named))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.block = None
        if self.open[tag]:
            place = len(self.stack) - 1
            while self.stack[place][0] != tag:
                place -= 1
            self._pop_to(place)

    def handle_data(self, data: str) -> None:
        if self.no_text:
            return
        if self.block is None:
            if data.isspace():
                return
            tag = self.stack[self.containers[-1]][0] if self.containers else ""
            self.block = Block(tag, self.mains > 0, self.other > 0)
            self.block.links = int(self.open["a"] > 0)
            self.blocks.append(self.block)
        self.block.pieces.append(data)
        if self.open["a"]:
            self.block.linked += len(data.strip())


def stop_words(blocks: list[Block]) -> frozenset[str]:
    """The list of which the page's words hold most; of equal ones the first, of none any."""
    counts = Counter(w for b in blocks for w in _WORD.findall(b.text.lower()))
    return max(_STOP_WORDS.values(), key=lambda own: sum(counts[w] for w in own))


def declared(block: Block, declares: bool, long: int = 200) -> bool:
    """Whether what the page declares, or a short text's copyright sign, makes a block no main text."""
    return block.other or declares and not block.inside or "©" in block.text and len(block.text) < long


def first_pass(
    block: Block,
    declares: bool,
    stops: frozenset[str],
    short: int = 70,
    long: int = 200,
    stop_low: float = 0.12,
    stop_high: float = 0.25,
    links: float = 0.4,
) -> tuple[str, bool]:
    """The label of a block by itself, and whether it looks like running text: long without any link, or with stop words.

    ``declares``: the page has an ``article`` or ``main``. Mostly links, and more
    than two of them or not in a paragraph or heading: bad. Many stop words in a
    long text: good. A text without them may be of another language or a list of
    names, so it is doubtful, as is one of middling length.
    """
    size = len(block.text)
    words = _WORD.findall(block.text.lower())
    density = sum(map(stops.__contains__, words)) / max(1, len(words))
    likely = density >= stop_low and not block.linked or size >= long and not block.linked
    if declared(block, declares, long):
        return BAD, likely
    if block.linked > links * size and (block.links > 2 or block.tag != "p" and block.tag not in HEADINGS):
        return BAD, likely
    if size < short:
        return SHORT, likely
    return (GOOD if density >= stop_high and size >= long else DOUBTFUL), likely


def _nearest(votes: list[str]) -> Iterator[tuple[int, str, int, str]]:
    """For each block how far the next votes before and after it are, and what they say; an empty vote where there is none."""
    after: list[tuple[int, str]] = [(0, "")] * len(votes)
    last = (len(votes), "")
    for i in range(len(votes) - 1, -1, -1):
        after[i] = last
        last = (i, votes[i]) if votes[i] else last
    last = (-1, "")
    for i, vote in enumerate(votes):
        yield i - last[0], last[1], after[i][0] - i, after[i][1]
        last = (i, vote) if vote else last


def classify(blocks: list[Block], **thresholds: float) -> None:
    """Labels for the blocks of one page, of which none is empty.

    Second pass: first a doubtful block, which is bad only if the nearest blocks
    before and after it that their own text decided are both bad and it doesn't
    look like running text. Then a short block, which takes the label of the
    nearest block that is decided by now; of two equally near ones that differ, a
    heading follows the later and any other is bad. Where nothing on the page
    decided anything, nothing speaks against a block, and it is good. A block that
    is bad by declaration or as a copyright notice has no vote.
    """
    declares = any(b.inside for b in blocks)
    stops, likely = stop_words(blocks), []
    for b in blocks:
        b.label, more = first_pass(b, declares, stops, **thresholds)
        likely.append(more)
    heard = [not declared(b, declares) for b in blocks]
    votes = [b.label if b.label in (GOOD, BAD) and h else "" for b, h in zip(blocks, heard)]
    for b, more, (_, left, _, right) in zip(blocks, likely, _nearest(votes)):
        if b.label == DOUBTFUL:
            b.label = BAD if left == right == BAD and not more else GOOD
    votes = [b.label if b.label in (GOOD, BAD) and h else "" for b, h in zip(blocks, heard)]
    for b, (i, left, j, right) in zip(blocks, _nearest(votes)):
        if b.label == SHORT:
            if not left or not right:
                b.label = left or right or GOOD
            elif left == right or i < j:
                b.label = left
            else:
                b.label = right if j < i or b.tag in HEADINGS else BAD


def main_text(html: str | None) -> str:
    """The main text of one page: blocks in page order, joined by two line feeds; empty for a null or empty page."""
    if not html:
        return ""
    parser = _Blocks()
    parser.feed(html)
    blocks = []
    for b in parser.blocks:
        b.text = " ".join("".join(b.pieces).split())
        if b.text:
            blocks.append(b)
    if not blocks:
        return ""
    classify(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == GOOD)


def extract(pages: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    """``pages`` without ``html``, with its main text in ``to`` (replaced if there), an empty string if there is none.

    Whole pages are read, rows keep their order within a partition, repeated rows
    and null ids pass through, an empty table stays empty.
    """
    kept = [c for c in pages.columns if c not in (html, to)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, start, size = [], 0, 0
            for i in range(batch.num_rows):
                made.append(main_text(batch.column(len(kept))[i].as_py()))
                size += len(made[-1])
                if size > 8 << 20 or i == batch.num_rows - 1:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays(part.columns[: len(kept)] + [pa.array(made, pa.string())], [*kept, to])
                    made, start, size = [], i + 1, 0

    schema = T.StructType([*pages.select(*kept).schema.fields, T.StructField(to, T.StringType())])
    return small_batches(pages.select(*kept, pages[html].alias("__html"))).mapInArrow(rows, schema)
