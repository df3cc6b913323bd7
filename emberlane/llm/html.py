"""Operator 5: main text of web pages by two-pass block rules.

A page is read once, tag by tag, into blocks of text. The first pass decides each block
by its container, stop-word density, length and link density: good, bad, or undecided.
The second pass gives an undecided block the label of its nearest decided neighbours in
the same region of the page - the article, or what lies outside it - and, where a region
has no decided block, what the region suggests. An ``article`` or ``main`` element is
strong evidence for its blocks: inside it, few stop words alone do not condemn one.
Containers that name themselves boilerplate are dropped; one that only a part of a longer
name speaks against is kept if it holds most of the page's running text.
On a page whose running text has few known stop words the language is taken as unknown,
and length and link density alone decide.

Defined cases: null or empty html, and html without main text, give an empty text of 0
characters; text that no tag encloses is a block of its own; unclosed elements end with
the page; repeated rows are extracted once each; columns other than the three are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from emberlane.llm.common import table

#: Frequent function words of some languages (fixed values).
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch oder sich sie sind so über um und von war wie wir zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al con como cuando del desde donde el ella entre era esta este ha hay las lo los mas me mi más muy no nos o para pero por porque si sin sobre su sus también te tiene todo y ya".split()
)
#: Elements whose text is never main text, and elements whose content is not markup.
DROPPED = frozenset("head title nav footer aside noscript template iframe object svg canvas audio video button select textarea menu dialog style script".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SPACED = frozenset("br td th input".split())
REGIONS = frozenset("article main".split())
#: Words in a class, id or role that name boilerplate.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus footer form header masthead menu navbar navigation nav "
    "newsletter notice notices notification overlay popup modal promo promoted promotion recommended related respond reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget alert discussion complementary".split()
)
#: First-pass limits: link share, characters of a short and of a long block, stop-word shares.
MAX_LINKS, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.4, 60, 180, 0.1, 0.22

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute with its value; matched one after the other, so that nothing inside a value or a longer name counts.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_QUOTE_OR_END = re.compile("[>\"']")
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")
_RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}
#: Parts of a class that make it a state or a layout, as in "has-sidebar".
_STATES = frozenset("has with without no is show hide".split())
#: A form, or a container that only parts of its names speak against, is kept if it holds this share of the page's running text.
WRAPPER = 0.5

NEUTRAL, DOUBTFUL, BOILERPLATE = 0, 1, 2


@dataclass
class Block:
    text: str
    link_chars: int
    links: int
    region: int  # 0 outside any article
    dropped: bool
    doubts: tuple[int, ...] = ()  # doubtful containers around it


def _judge_names(attributes: str, inside: bool) -> int:
    """What class, id, role and visibility say of an element. Whole names decide; parts of longer ones raise a doubt, unless they tell a state. A header inside an article is the article's."""
    worst = NEUTRAL
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return BOILERPLATE
        if name not in ("class", "id", "role"):
            continue
        for token in value.split():
            parts = _NAME.findall(token)
            if inside and parts and parts[-1] == "header":
                continue
            if token in NAMES or len(parts) <= 2 and parts and parts[-1] in NAMES and not _STATES.intersection(parts):
                return BOILERPLATE
            if not _STATES.intersection(parts) and not NAMES.isdisjoint(parts):
                worst = DOUBTFUL
    return worst


def tags_of(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each tag, and of comments and declarations with an empty name.

    It only goes forward: a quote that is never closed is an ordinary character, and
    a tag that never ends is text, which two look-ups from the end tell at once.
    Send a place to go on from there.
    """
    last = {c: page.rfind(c) for c in ">\"'"}
    at = page.find("<")
    while 0 <= at < last[">"]:
        start, closing = at, page.startswith("/", at + 1)
        found = _TAG_NAME.match(page, at + 1 + closing)
        end = 0
        if found:
            end = found.end()
            while page[end] != ">":
                end = _QUOTE_OR_END.search(page, end).start() if end < last[">"] else -1
                if end < 0 or page[end] == ">":
                    break
                quote = page[end]
                end = page.find(quote, end + 1) + 1 if end < last[quote] else end + 1
                if end > last[">"]:
                    end = -1
                    break
            if end >= 0:
                end += 1
                jump = yield start, end, closing, found[0].lower(), page[found.end():end - 1]
                end = end if jump is None else jump
            else:
                end = at + 1
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield start, end, False, "", ""
        elif page[at + 1] in "!?":
            end = page.find(">", at) + 1
            yield start, end, False, "", ""
        at = page.find("<", max(end, at + 1))


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order: maximal stretches of text without a block-level tag."""
    out: list[Block] = []
    parts: list[str] = []
    link_parts: list[str] = []
    links = dropped = region = regions = doubts = 0
    link_depth = 0
    doubtful: list[int] = []
    open_tags: list[tuple[str, bool, bool, int]] = []  # element, whether it drops its text, whether it is doubtful, region outside it
    opened: dict[str, int] = {}

    def close_block() -> None:
        nonlocal parts, link_parts, links
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(text, len(_SPACE.sub(" ", "".join(link_parts)).strip()), links, region, dropped > 0, tuple(doubtful)))
        parts, link_parts, links = [], [], 0

    def close_tag() -> str:
        nonlocal dropped, region
        tag, drops, doubt, region = open_tags.pop()
        dropped -= drops
        opened[tag] -= 1
        if doubt:
            doubtful.pop()
        return tag

    def add(text: str) -> None:
        if "&" in text:
            text = unescape(text)
        parts.append(text)
        if link_depth:
            link_parts.append(text)

    at, tags, jump = 0, tags_of(page), None
    while True:
        try:
            start, end, closing, tag, attributes = tags.send(jump)
        except StopIteration:
            break
        jump = None
        if start > at:
            add(page[at:start])
        at = end
        if not tag:
            continue
        judged = NEUTRAL if closing or tag in ("body", "html", "article", "main") or not attributes else _judge_names(attributes, region > 0)
        if tag == "form" and judged == NEUTRAL:
            judged = DOUBTFUL
        if tag == "a":
            link_depth = 0 if closing else 1
            links += not closing
        elif tag in SPACED:
            parts.append(" ")
        elif tag in INLINE and not (tag == "span" and judged == BOILERPLATE) and not (closing and opened.get(tag)):
            pass
        elif closing:
            close_block()
            link_depth = 0
            if opened.get(tag):
                while close_tag() != tag:
                    pass
        else:
            close_block()
            link_depth = 0
            if open_tags and open_tags[-1][0] == "p":  # a block ends a paragraph
                close_tag()
            if tag in RAW:
                found = _RAW_END[tag].search(page, at)
                end = page.find(">", found.end()) if found else -1
                at = jump = len(page) if end < 0 else end + 1
            elif tag not in VOID and not attributes.endswith("/"):
                inside = region > 0
                drops = tag in DROPPED or tag == "header" and not inside or judged == BOILERPLATE
                open_tags.append((tag, drops, judged == DOUBTFUL, region))
                opened[tag] = opened.get(tag, 0) + 1
                dropped += drops
                if judged == DOUBTFUL:
                    doubts += 1
                    doubtful.append(doubts)
                if tag in REGIONS and not (inside and tag == "article"):
                    regions += 1
                    region = regions
    if at < len(page):
        add(page[at:])
    close_block()
    return _settle_doubts(out)


def _settle_doubts(blocks: list[Block]) -> list[Block]:
    """Drops the blocks of doubtful containers that do not hold most of the page's running text."""
    running = [(b, len(b.text)) for b in blocks if not b.dropped and b.link_chars <= MAX_LINKS * len(b.text)]
    held: dict[int, int] = {}
    for block, size in running:
        for doubt in block.doubts:
            held[doubt] = held.get(doubt, 0) + size
    whole = WRAPPER * sum(size for _, size in running)
    for block in blocks:
        block.dropped = block.dropped or any(held.get(d, 0) < whole for d in block.doubts)
    return blocks


GOOD, BAD, UNDECIDED = 1, 0, -1


def stop_share(text: str, least: int = 1) -> float:
    """Share of the words that are stop words of at least so many letters."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS and len(w) >= least for w in words) / max(1, len(words))


def language_known(blocks: list[Block]) -> bool:
    """Whether the page's running text has stop words of a known language; single letters are words of many."""
    running = [b.text for b in blocks if not b.dropped and len(b.text) >= SHORT and b.link_chars <= MAX_LINKS * len(b.text)]
    return stop_share(" ".join(running), 2) >= FEW_STOPS


def first_pass(block: Block, known: bool = True) -> int:
    size = len(block.text)
    link_share = block.link_chars / size
    if block.dropped:
        return BAD
    if link_share > MAX_LINKS:
        return UNDECIDED if block.region and block.links == 1 else BAD
    if size < SHORT:
        return BAD if block.link_chars and not block.region else UNDECIDED
    if not known:
        return GOOD if size >= LONG else UNDECIDED
    share = stop_share(block.text)
    if share >= MANY_STOPS or share >= FEW_STOPS and size >= LONG:
        return GOOD
    return UNDECIDED if block.region or share >= FEW_STOPS else BAD


def second_pass(blocks: list[Block], labels: list[int]) -> list[int]:
    """Undecided blocks take the label of the nearest decided one before or after them in their region; the nearer wins, a good one on a tie."""
    near: dict[int, list[tuple[int, int]]] = {}
    for i, (block, label) in enumerate(zip(blocks, labels)):
        if label != UNDECIDED and not block.dropped:
            near.setdefault(block.region, []).append((i, label))
    out = list(labels)
    place: dict[int, int] = {}
    any_region = any(b.region for b in blocks)
    for i, (block, label) in enumerate(zip(blocks, labels)):
        decided = near.get(block.region, [])
        k = place.get(block.region, 0)
        while k < len(decided) and decided[k][0] < i:
            k += 1
        place[block.region] = k
        if label != UNDECIDED:
            continue
        before = decided[k - 1] if k else None
        after = decided[k] if k < len(decided) else None
        if before and after:
            gap = (i - before[0]) - (after[0] - i)
            out[i] = max(before[1], after[1]) if gap == 0 else before[1] if gap < 0 else after[1]
        elif before or after:
            out[i] = (before or after)[1]
        else:
            out[i] = GOOD if block.region or not any_region else BAD
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    known = language_known(blocks)
    labels = second_pass(blocks, [first_pass(b, known) for b in blocks])
    return "\n\n".join(b.text for b, label in zip(blocks, labels) if label == GOOD)


def extract(df: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each page."""
    kept = df.select(key, url, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["k", "u", "t", "n"])

    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:2]) + ", text string, n_chars bigint")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_text": op5_html_text}
ORACLE: dict[str, str] = {}
