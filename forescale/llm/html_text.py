"""Main text of web pages by two passes of block rules.

The first pass cuts a page into blocks and decides those that it can: markup names menus, headers, footers, sidebars,
notices, adverts, forms and comments; a block where links hold most of the text is boilerplate; a long block with enough
stop words is text. Blocks too short to tell are ambiguous. In the second pass they take the label of the nearest decided
block of their region (an article element, or what surrounds it); where both sides are as near, text wins. Inside an
article only blocks with several links are in doubt, the others are its text; outside of one all is boilerplate. A page
without an article is one region, and where nothing in it is decided all its blocks are text.

Defined results: a null or empty page has an empty text. Unclosed and unknown tags are read as browsers do, raw elements
end at their own end tag only. Extra columns are kept by ``extract``; the output name ``content`` replaces a clashing one.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from forescale.llm.common import pieces

LONG_CHARS = 70
LINK_SHARE = 0.5
STOP_SHARE = 0.2

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW = frozenset("script style noscript template textarea title iframe svg math object xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_DROPPED = frozenset("head nav footer aside form button select option dialog menu datalist optgroup".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert newsletter subscribe subscription signup popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar footer comment comments "
    "disqus respond replies share sharing social related recommended login search pagination pager toolbar".split()
)
_HEAD_MARKED = frozenset("header masthead topbar".split())
_P_ENDS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF_ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_STOP_WORDS = frozenset(
    "a about all also an and are as at be but by can for from had has have he her his i if in into is it its more not of on one or our she so than that the their them there they this to was we were what when which who will with you your "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour que qui sa se ses son sont sur un une vous "
    "aber als auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im in ist man mit nach nicht noch nur oder sich sie sind so um und von vor war wie wir zu zum zur "
    "al como con de del el ella en entre es esta este la las lo los me mi muy no para pero por que se si sin sobre su sus un una y ya yo".split()
)


class Tags:
    """The tags of a page, read once from left to right; linear however quotes and brackets are left open."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.ends: dict[int, int] = {}  # place outside of quotes -> the bracket that ends the tag there, or -1

    def end_of(self, at: int) -> int:
        """The first closing bracket outside of quotes; where there is none, the first at all."""
        first, path = at, []
        while (end := self.ends.get(at)) is None:
            path.append(at)
            found = _SPECIAL.search(self.page, at)
            if found is None:
                end = -1
                break
            if found[0] == ">":
                end = found.start()
                break
            close = self.page.find(found[0], found.end())
            if close < 0:
                end = -1
                break
            at = close + 1
        for place in path:
            self.ends[place] = end
        return end if end >= 0 else self.page.find(">", first)

    def after(self, at: int) -> tuple[int, int, str | None, str | None, str] | None:
        """Start, end, slash, name (None: a comment or the like) and attributes of the next tag."""
        page = self.page
        while found := _OPEN.search(page, at):
            start = found.start()
            if found[0] == "<!--":
                end = page.find("-->", found.end())
                return start, len(page) if end < 0 else end + 3, None, None, ""
            if start > self.last:  # nothing is closed from here on
                at = found.end()
                continue
            if found[2] is None:
                return start, page.find(">", start) + 1, None, None, ""
            end = self.end_of(found.end())
            return start, end + 1, found[1], found[2], page[found.end() : end]
        return None


@dataclass
class Block:
    text: str
    link_chars: int
    links: int
    region: int
    label: str = ""


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    articles: set[int] = field(default_factory=set)


def attributes(text: str) -> dict[str, str]:
    return {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(text)} if text.strip(" /\n\t") else {}


def names(value: str) -> set[str]:
    return {n.lower() for n in _NAME.findall(value)} | set(value.lower().split())


def is_boilerplate(tag: str, text: str, in_article: bool) -> bool:
    """What the markup itself says of an element."""
    if tag in _DROPPED or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main", "article") or not text:
        return False
    found = attributes(text)
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return True
    if found.get("role", "") in _ROLES:
        return True
    own = names(found.get("class", "")) | names(found.get("id", ""))
    return bool(own & _MARKED) or not in_article and bool(own & _HEAD_MARKED)


def parse(page: str) -> Page:
    """Blocks outside of what markup drops, in page order."""
    out = Page()
    stack: list[tuple[str, bool]] = []  # open elements, and whether they drop what they hold
    places: dict[str, list[int]] = {}  # of the open elements by tag
    solid: list[int] = []  # places of the open elements that are not inline
    dropped = articles = links = 0
    parts: list[str] = []
    link_chars = block_links = region = regions = 0

    def end_block() -> None:
        nonlocal link_chars, block_links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.blocks.append(Block(text, link_chars, block_links, region))
            parts.clear()
        link_chars = block_links = 0

    def close(at: int) -> None:
        nonlocal dropped, articles, links, region
        while len(stack) > at:
            tag, drops = stack.pop()
            places[tag].pop()
            if tag not in _INLINE:
                solid.pop()
            dropped -= drops
            links -= tag == "a"
            if tag in ("article", "main"):
                end_block()
                articles -= 1
                if not articles:
                    region = regions  # what follows is again the surroundings

    def last(*tags: str) -> int:
        """Place of the innermost open element of these, -1 without one."""
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def add(text: str) -> None:
        nonlocal link_chars
        if text and not dropped:
            parts.append(text)
            if links:
                link_chars += len(text.strip())

    at = 0
    tags = Tags(page)
    while found := tags.after(at):
        start, end, closing, tag, text = found
        add(page[at:start])
        at = end
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            add(" ")
            continue
        if tag not in _INLINE:
            end_block()
        if closing:
            if (place := last(tag)) >= 0:
                close(place)
            continue
        if tag in _RAW and not text.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
            continue
        if tag in _P_ENDS and solid and stack[solid[-1]][0] == "p":
            close(solid[-1])
        if tag in _SELF_ENDS:
            place = last(*_SELF_ENDS[tag].split())
            if place > last("ul", "ol", "dl", "table", "select"):
                close(place)
        if tag in _VOID:
            continue
        drops = is_boilerplate(tag, text, articles > 0)
        places.setdefault(tag, []).append(len(stack))
        if tag not in _INLINE:
            solid.append(len(stack))
        stack.append((tag, drops))
        dropped += drops
        if tag == "a":
            links += 1
            block_links += 1
        if tag in ("article", "main") and not dropped:
            articles += 1
            if articles == 1:
                regions += 1
                region = -regions
                out.articles.add(region)
        elif tag in ("article", "main"):
            articles += 1
    add(page[at:])
    end_block()
    return out


def decide(block: Block) -> str:
    """First pass: text, boilerplate or unknown."""
    if block.links > 1 and block.link_chars > LINK_SHARE * len(block.text):
        return "boilerplate"
    if len(block.text) < LONG_CHARS:
        return ""
    words = block.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()%#&$*|") in _STOP_WORDS for w in words)
    return "text" if stops >= STOP_SHARE * len(words) else ""


def main_text(page: str | None) -> str:
    parsed = parse(page or "")
    blocks = parsed.blocks
    by_region: dict[int, list[int]] = {}
    for i, block in enumerate(blocks):
        block.label = decide(block)
        by_region.setdefault(block.region, []).append(i)
    kept = set()
    for region, members in by_region.items():
        in_article = region in parsed.articles
        decided = [i for i in members if blocks[i].label]
        for i in members:
            label = blocks[i].label
            if not label and in_article:  # an article's headings and single words have no links
                label = nearest(i, decided, blocks) if decided and blocks[i].links > 1 else "text"
            elif not label and not parsed.articles:
                label = nearest(i, decided, blocks) if decided else "text"
            if label == "text" and (in_article or not parsed.articles):
                kept.add(i)
    return "\n\n".join(blocks[i].text for i in sorted(kept))


def nearest(i: int, decided: list[int], blocks: list[Block]) -> str:
    """Second pass: the label of the nearest decided block, text where two are as near; ``decided`` goes up."""
    place = bisect_left(decided, i)
    sides = decided[max(0, place - 1) : place + 1]
    least = min(abs(i - j) for j in sides)
    return "text" if any(blocks[j].label == "text" for j in sides if abs(i - j) == least) else "boilerplate"


def extract(df: DataFrame, page: str = "html") -> DataFrame:
    """All columns of ``df``, then ``content``, the page's main text."""
    kept = [f for f in df.schema.fields if f.name != "content"]
    schema = T.StructType([*kept, T.StructField("content", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, page):
            texts = [main_text(p) for p in batch.column(page).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
