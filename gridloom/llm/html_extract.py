"""Main text of web pages by two passes of block rules.

Pass 1 looks at each block alone: link density, length and stop-word density make it good, bad, near-good or short. Elements
and class names are hints: one that names a menu, an advert or the like makes a block bad, a vaguer one on a paragraph leaves
it undecided. Pass 2 looks at the neighbours: short and near-good blocks take the label of the nearest decided blocks of their
region. A region is an outermost article or main element, or all that stands outside of them; the page's story is the region
with most text that pass 1 doesn't find bad, and others stay if they hold a third of that. So a teaser in an article element
beside a story without one isn't taken for it.

Defined cases: null or empty html gives "" and 0; equal rows each give their own row; unclosed tags, comments and
scripts end with the page; other columns of the input are ignored; a page without any good block keeps the undecided ones.
Text is never cut. A worker holds one Arrow batch (16 MB of pages or one page) and some ten times a page in blocks.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import bounded_batches

#: Frequent function words of the four languages.
STOP_WORDS = frozenset(
    "the of and to in is it that was for on are as with be by at from this have or an not but had his they you which one we "
    "der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei "
    "le la les de des du un une et est en que qui dans pour sur au aux par plus ne pas ce il elle se avec son sont ou "
    "el los las del y en un una que es por con para no se su al lo como más o pero sus le ha me".split()
)
#: Elements that end a block, elements without text, and elements whose text is never the article.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center col dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BOILER = frozenset("nav footer aside form menu head button select dialog header noscript template svg math object canvas video audio".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark what isn't the article, on any element; and those that may do so on a paragraph, but needn't.
_SURE = "ads?|advert\\w*|promo\\w*|sponsor\\w*|side-?bar|nav|navigation|navbar|menu|breadcrumbs?|footer|masthead|comments?|commentlist|replies|respond|disqus|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|pagination|pager|copyright|complementary|contentinfo"
_VAGUE = "banner|widget|header|notices?|login|social|share|sharing|related|recommend\\w*|tags|legal|disclaimer|hidden|search"
SURE, VAGUE = (re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I) for words in (_SURE, _VAGUE))
#: Elements that end tags of what stands outside of them don't close.
BARRIERS = frozenset(("article", "main", "body"))
#: Elements of running text: a vague mark on them doesn't decide.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote span a b i em strong small figcaption td th dd dt q cite u".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(?=[/a-zA-Z])[^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rules:
    """Pass 1: over max_link_density is bad; under short characters is short; stop words from high is good, from low near-good."""

    max_link_density: float = 0.4
    short: int = 60
    long: int = 160
    low: float = 0.05
    high: float = 0.12


@dataclass
class Block:
    """linked: characters in links; boiler, doubt: a sure or a vague mark stands over it; region: 0 outside of article and main elements."""

    text: str
    linked: int
    boiler: bool
    doubt: bool
    region: int
    heading: bool


def blocks(page: str) -> list[Block]:
    """Split a page into blocks of text with what the rules need to know."""
    found: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, bool, bool]] = []
    standing: dict[str, list[int]] = {}  # where the open elements of a name stand in the stack, and which of them end tags don't pass
    barriers: list[int] = []
    boiler = doubt = article = anchors = heading = regions = 0
    has_heading = False

    def flush() -> None:
        nonlocal has_heading
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            linked = min(len(text), len(" ".join(entities.unescape("".join(links)).split())))
            found.append(Block(text, linked, boiler > 0, doubt > 0, regions if article else 0, has_heading))
        parts.clear()
        links.clear()
        has_heading = heading > 0

    def text(piece: str) -> None:
        if piece:
            parts.append(piece)
            if anchors:
                links.append(piece)

    def drop(k: int) -> None:
        """Close the open elements from the k-th on."""
        nonlocal boiler, doubt, article, anchors, heading
        for name, marked, vague in reversed(stack[k:]):
            standing[name].pop()
            if name in BARRIERS:
                barriers.pop()
            boiler -= marked
            doubt -= vague
            article -= name in ("article", "main")
            anchors -= name == "a"
            heading -= name in HEADINGS
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        if m[1]:
            # a stray end tag doesn't close the article
            if standing.get(name) and (name in ("html", "body") or not barriers or standing[name][-1] >= barriers[-1]):
                drop(standing[name][-1])
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            if name in ("p", "li", "td", "th", "tr", "option", "dt", "dd"):
                for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                    if stack[k][0] == name:  # their end tags may be left out
                        drop(k)
                        break
                    if stack[k][0] in BLOCKS:
                        break
            values = [entities.unescape(a or b or c) for a, b, c in ATTR.findall(m[3])]
            region = name in ("article", "main")
            # a header inside the article carries its title
            marked = name in BOILER and not (name == "header" and article) or name not in ("html", "body") and any(map(SURE.search, values))
            hinted = name not in ("html", "body") and not region and any(map(VAGUE.search, values))
            vague = hinted and name in RUNNING
            marked = marked or hinted and not vague
            standing.setdefault(name, []).append(len(stack))
            if name in BARRIERS:
                barriers.append(len(stack))
            stack.append((name, marked, vague))
            boiler += marked
            doubt += vague
            regions += region and not article
            article += region
            anchors += name == "a"
            heading += name in HEADINGS
            has_heading = heading > 0
    flush()
    return found


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def first_pass(b: Block, rules: Rules) -> str:
    """good, bad, near or short, from the block alone."""
    n = len(b.text)
    if b.boiler or b.linked > rules.max_link_density * n:
        return "bad"
    if n < rules.short or b.heading or b.doubt:
        return "short"
    words = WORD.findall(b.text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if density >= rules.high:
        return "good" if n >= rules.long else "near"
    if density >= rules.low or b.region:
        return "near"
    return "bad"


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided block of their region; of two as near the good one, and a heading goes with what follows it."""
    out = [x == "good" for x in labels]
    sides: list[list[tuple[int, str]]] = []  # of each block the nearest decided one before and after it
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[int, tuple[int, str]] = {}
        side = [(-1, "")] * len(found)
        for i in order:
            side[i] = last.get(found[i].region, (-1, ""))
            if labels[i] in ("good", "bad"):
                last[found[i].region] = (i, labels[i])
        sides.append(side)
    lost = "good" not in labels
    for i, (b, label) in enumerate(zip(found, labels, strict=True)):
        if label in ("good", "bad"):
            continue
        (p, before), (q, after) = sides[0][i], sides[1][i]
        if lost:
            out[i] = True
        elif not before and not after:
            out[i] = b.region > 0 or label == "near"
        elif not before or not after or before == after:
            out[i] = (before or after) == "good"
        elif label == "near" or b.heading and after == "good":
            out[i] = True
        else:
            out[i] = (before if i - p < q - i else after if q - i < i - p else "good") == "good"
    return out


def story(found: list[Block], labels: list[str]) -> set[int]:
    """The regions that hold the page's story: the one with most text that isn't bad, and those with a third of it."""
    size: dict[int, int] = {}
    for b, label in zip(found, labels, strict=True):
        # outside of an article short blocks don't count: menus and notices are short
        if label in ("good", "near") or label == "short" and b.region:
            size[b.region] = size.get(b.region, 0) + len(b.text)
    if not size:
        return {b.region for b in found}
    most = max(size.values())
    if any(n == most for r, n in size.items() if r):
        size.pop(0, None)  # what stands outside the article isn't the article
    return {r for r, n in size.items() if 3 * n >= most}


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """The article of one page: good blocks in page order, joined by one space."""
    if not page:
        return ""
    found = blocks(page)
    labels = [first_pass(b, rules) for b in found]
    here = story(found, labels)
    own = [(b, x) for b, x in zip(found, labels, strict=True) if b.region in here]
    own_blocks, own_labels = [b for b, _ in own], [x for _, x in own]
    return " ".join(b.text for b, keep in zip(own_blocks, second_pass(own_blocks, own_labels), strict=True) if keep)


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages. Row by row: no shuffle, one Arrow batch in memory."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, rules) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    own = pages.select(pages["page_id"].cast("bigint"), pages["url"].cast("string"), pages["html"].cast("string"))
    return own.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
