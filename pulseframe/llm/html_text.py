"""Main text of HTML pages by two-pass block rules.

Markup is cut into blocks of text. The first pass classifies every block by link density, stop-word density and
length; blocks that these can't tell stay open. The second pass gives each open block the label of the nearest
decided block of its region. Where a block stands is one more input: what stands in menus, footers, forms or
elements marked as adverts, comments and the like is never main text, and an article or main element that holds
most of the good text leaves the rest of the page out.

Stop words are those of four languages. On a page in none of them, and for blocks in other scripts, they tell
nothing, and length and links decide.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of four languages, one line each.
STOP_WORDS = frozenset(
    """
    the of and to in is a that it for was on are with as be this by from at or an not have which
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an
    de la le les et des en un une du que est pour qui dans au par sur pas plus ne se ce avec
    de la que el en y a los se del las un por con no una su para es al lo como más
    """.split()
)

#: Words of class, id or role that mark what is not main text.
MARKED = frozenset(
    """
    ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice
    nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments disqus respond replies share sharing social related
    recommended subscribe subscription newsletter popup modal overlay login signup widget pagination pager disclaimer copyright
    """.split()
)
#: Of these the words of what holds articles of its own.
LISTED = frozenset("comment comments disqus respond replies related recommended".split())
#: Words that follow a marking one in the name of the same thing (comment-list, sidebar-left).
PARTS_OF = frozenset("area bar block body box container content inner item left link links list menu outer panel right row section text top bottom wrap wrapper".split())

BLOCK_TAGS = frozenset(
    """
    p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre section article header footer nav aside
    main form fieldset legend hr figure figcaption address details summary body html head title option label center
    """.split()
)
#: Elements whose whole content is dropped; the text of the raw ones is not markup.
RAW = frozenset("script style template textarea svg iframe".split())
SILENT = frozenset("head title noscript select option button object math canvas audio video datalist".split()) | RAW
#: Elements that hold no main text, and those that hold it.
ASIDE = frozenset("nav footer aside menu dialog".split())
MAIN = frozenset(["article", "main"])
#: A form with one of these holds the page and not fields.
OF_PAGE = frozenset("h1 header nav footer".split()) | MAIN
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start of these ends an open paragraph or heading.
ENDS_PARAGRAPH = BLOCK_TAGS - {"body", "html", "head", "title", "option", "label"}
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
PLAIN = re.compile(r"[^>\"']*")
RAW_END = {x: re.compile(f"</{x}\\b", re.I) for x in RAW}
#: Attributes that keep an element from being shown.
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=]|/?$)|\baria-hidden\s*=\s*["']?true|\bstyle\s*=\s*(?:"[^"]*|'[^']*|[^\s"'>]*)(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[^\W\d_]+")

#: How calls to the reader begin, by language. Such a block of at most CALL words is no main text wherever it stands.
CALLS = re.compile(
    r"""(?:subscribe\s(?:to|now|today|for)|sign\sup\s(?:for|to|now|today)|share\s(?:this|on|via)|follow\sus|like\sus\son|buy\snow|shop\snow|order\snow|click\shere|read\smore|learn\smore
    |download\s(?:our|the)\sapp|get\sour\s(?:app|newsletter)|advertisement\b|sponsored\b|jetzt\s(?:kaufen|bestellen|abonnieren)|abonnieren\ssie|folgen\ssie\suns|mehr\slesen|anzeige$
    |abonnez-vous|achetez\smaintenant|partagez\s(?:cet|sur)|suivez-nous|lire\sla\ssuite|publicité\b|suscríbete|compra\sahora|comparte\sen|síguenos|leer\smás|publicidad\b)""",
    re.I | re.X,
)
CALL = 24
#: Within an article a long block of few stop words is no text of it if more than this share of its words is in links.
SOME_LINKS = 0.1

#: A block of so many words is long enough to be told from boilerplate by having no stop words, of so many by having them.
LONG, MEDIUM = 14, 6
LOW_DENSITY, HIGH_DENSITY = 0.08, 0.12
LINK_DENSITY = 0.4
#: A page whose long blocks together have fewer stop words than this is in none of the four languages.
KNOWN_DENSITY = 0.2
#: A block with a copyright sign that is shorter is a notice.
NOTICE = 40
#: Letters of scripts without spaces between words (Thai to Khmer, Chinese, Japanese), and how many make a word.
UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
LETTERS_OF_WORD = 2
LATIN = re.compile("[A-Za-zÀ-ɏ]")


def length(text: str) -> int:
    """Words, those of scripts without spaces by their letters."""
    words = len(text.split())
    return max(words, len(UNSPACED.findall(text)) // LETTERS_OF_WORD) if not text.isascii() and UNSPACED.search(text) else words


def stop_words(text: str) -> int:
    return sum(w in STOP_WORDS for w in WORD.findall(text.lower()))


def marks(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role names what is not main text, and whether it is a list of other texts.

    Names are whole: a marking word alone, at the end (site-footer), or followed by words for its parts
    (comment-list). Words that only tell of one (no-sidebar, comments-open) don't mark.
    """
    marked = listed = False
    for m in ATTRIBUTE.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = WORD.findall(name)
            while len(words) > 1 and words[-1] in PARTS_OF:
                words.pop()
            if words and words[-1] in MARKED and words[0] not in ("no", "has", "have", "with", "without", "hide", "show"):
                marked = True
                listed |= words[-1] in LISTED
    return marked, listed


def tokens(page: str) -> Iterator[tuple[str, bool, str]]:
    """Text pieces as ("", False, text) and tags as (name, ending, attributes), in one pass over the page.

    A ``>`` in a quoted value doesn't end a tag. If quotes leave a tag without end, quotes count for nothing from
    there on; a tag without any end drops the rest of the page. The text of raw elements is left out.
    """
    at, quoted, size = 0, True, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield "", False, page[at:]
            return
        name = NAME.match(page, start + 2 if page.startswith("/", start + 1) else start + 1)
        if not name and not page.startswith(("!", "?", "/"), start + 1):
            yield "", False, page[at : start + 1]
            at = start + 1
            continue
        if start > at:
            yield "", False, page[at:start]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        end = _tag_end(page, name.end() if name else start, quoted)
        if end < 0 and quoted:
            quoted, end = False, page.find(">", start)
        if end < 0:
            return
        at = end + 1
        if not name:
            continue
        own, ending = name[0].lower(), page[start + 1] == "/"
        if own in RAW and not ending:
            found = RAW_END[own].search(page, at)
            if not found:
                return
            at = found.start()
            continue
        yield own, ending, page[name.end() : end]


def _tag_end(page: str, at: int, quoted: bool) -> int:
    """Where the ``>`` of a tag is, -1 if there is none."""
    while quoted:
        at = PLAIN.match(page, at).end()
        if at == len(page):
            return -1
        if page[at] == ">":
            return at
        at = page.find(page[at], at + 1) + 1
        if not at:
            return -1
    return page.find(">", at)


@dataclass(slots=True)
class Mark:
    """An element that its class, id or role, or that it is a form, makes one of no main text, until the mark is lifted.

    What it holds is first counted where it stands and summed over the marks inside at the page's end.
    """

    outer: int
    listed: bool = False
    form: bool = False
    nearest_listed: int = 0
    articles: int = 0
    unlisted: int = 0
    headings: int = 0
    of_page: int = 0
    lifted: bool = False
    inner: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    """Text with its words, those of them in links and among the stop words, and where it stands."""

    text: str
    n: int
    linked: int
    stops: int
    region: int
    main: bool
    off: bool
    mark: int


@dataclass(slots=True)
class Place:
    """An open element, or the page, and what holds for text inside it."""

    name: str = ""
    off: bool = False
    mark: int = 0
    main: bool = False
    silent: bool = False


def read_blocks(page: str) -> tuple[list[Block], list[Mark]]:
    """The non-empty text blocks of a page in order, and its marks; mark 0 is the page itself."""
    found: list[Block] = []
    marked = [Mark(-1, lifted=True)]
    stack = [Place()]
    is_open: dict[str, int] = defaultdict(int)
    mains: list[int] = []
    parts: list[str] = []
    linked, in_link, region, breaks = 0, False, 0, 0

    def flush() -> None:
        nonlocal parts, linked, breaks
        text, here = " ".join("".join(parts).split()), stack[-1]
        if text:
            found.append(Block(text, length(text), linked, stop_words(text), region, here.main, here.off, here.mark))
        parts, linked, breaks = [], 0, 0

    def close() -> None:
        nonlocal region
        place = stack.pop()
        is_open[place.name] -= 1
        if place.name in MAIN:
            mains.pop()
            region += 1

    for name, ending, rest in tokens(page):
        if not name:
            if not stack[-1].silent:
                piece = html.unescape(rest)
                parts.append(piece)
                if not piece.isspace():
                    breaks = 0
                    linked += length(piece) if in_link else 0
            continue
        if name == "a":
            in_link = not ending
            continue
        if name == "br":
            parts.append(" ")
            breaks += 1
        is_block = name in BLOCK_TAGS or name in SILENT or name in ASIDE
        if is_block or breaks > 1:
            flush()
        if name in VOID or not is_block and name != "span":
            continue
        in_link = in_link and not is_block
        if ending:
            while is_open[name]:
                last = stack[-1].name
                close()
                if last == name:
                    break
            continue
        if name in ENDS_PARAGRAPH and stack[-1].name in PARAGRAPHS:
            close()
        here = stack[-1]
        mark = here.mark
        if name in MAIN:
            region += not here.main
            if not here.off:
                around = mains[-1] if mains else 0
                marked[mark].articles += 1
                marked[around].articles -= 1
                marked[mark].unlisted += 1
                marked[around].unlisted -= marked[around].nearest_listed == marked[mark].nearest_listed
            mains.append(mark)
        elif name not in ("body", "html"):
            own, listed = marks(rest) if rest and not here.off else (False, False)
            if own or name == "form":
                marked.append(Mark(mark, listed, not own))
                marked[mark].inner.append(len(marked) - 1)
                marked[-1].nearest_listed = len(marked) - 1 if listed else marked[mark].nearest_listed
                mark = len(marked) - 1
        if not here.off:
            marked[here.mark].headings += name == "h1"
            marked[here.mark].of_page += name in OF_PAGE
        off = here.off or name in ASIDE or name == "header" and not here.main
        hidden = bool(rest) and name not in ("body", "html") and HIDDEN.search(rest) is not None
        stack.append(Place(name, off, mark, here.main or name in MAIN, here.silent or name in SILENT or hidden))
        is_open[name] += 1
    flush()
    for x in reversed(marked[1:]):
        outer = marked[x.outer]
        outer.articles += x.articles
        outer.unlisted += 0 if x.listed else x.unlisted
        outer.headings += x.headings
        outer.of_page += x.of_page
        x.lifted = x.form and x.of_page > 0
    return found, marked


def standing(marked: list[Mark]) -> list[bool]:
    """Of each mark, whether it or one around it is not lifted."""
    out = [False]
    for x in marked[1:]:
        out.append(not x.lifted or out[x.outer])
    return out


def classify(block: Block, known: bool) -> bool | None:
    """First pass: main text or not by links, stop words and length, None if they can't tell.

    On a page that is not in a ``known`` language, and in other scripts than Latin, length and links decide.
    """
    if block.linked > LINK_DENSITY * block.n or "©" in block.text and block.n < NOTICE and not block.main:
        return False
    if block.n <= CALL and CALLS.match(block.text):
        return False
    if block.n < MEDIUM:
        return None
    if block.stops >= HIGH_DENSITY * block.n:
        return True
    if block.n < LONG:
        return None
    if not known or not block.text.isascii() and 2 * len(LATIN.findall(block.text)) < sum(map(str.isalpha, block.text)):
        return True
    return None if block.stops >= LOW_DENSITY * block.n or block.main and block.linked <= SOME_LINKS * block.n else False


def in_known_language(found: list[Block], aside: list[bool]) -> bool:
    """Whether the long unmarked blocks of a page together have the stop words of a known language."""
    long = [x for x, off in zip(found, aside, strict=True) if x.n >= LONG and not off and x.linked <= LINK_DENSITY * x.n]
    return sum(x.stops for x in long) >= KNOWN_DENSITY * sum(x.n for x in long)


def lift(found: list[Block], marked: list[Mark], known: bool) -> None:
    """Lift the marks of wrappers around the main text.

    A mark around articles is lifted if no main text stands outside of marks; and if it holds more than stands there, unless
    it tells a list such as comments, or some stands in an article or main element and the mark is around several articles.
    On a page without these elements, whose text all stands in marked ones, the mark around a heading is lifted. The mark
    around the most text goes first, from the outside.
    """
    good, good_main, held, held_main = ([0] * len(marked) for _ in range(4))
    for x in found:
        if not x.off:
            n = x.n if classify(x, known) else 0
            good[x.mark] += n
            good_main[x.mark] += n * x.main
            n = x.n * (x.linked <= LINK_DENSITY * x.n)
            held[x.mark] += n
            held_main[x.mark] += n * x.main
    for i in range(len(marked) - 1, 0, -1):
        held[marked[i].outer] += held[i]
        held_main[marked[i].outer] += held_main[i]
    has_main = any(x.main for x in found)
    free = free_main = 0
    queue: list[tuple[bool, int, int]] = []
    opened = [0]
    while opened or queue:
        while opened:
            i = opened.pop()
            free += good[i]
            free_main += good_main[i]
            for j in marked[i].inner:
                if marked[j].lifted:
                    opened.append(j)
                else:
                    heapq.heappush(queue, (marked[j].listed, -(held_main if marked[j].articles else held)[j], j))
        while queue:
            listed, amount, i = heapq.heappop(queue)
            x = marked[i]
            if not amount:
                continue
            around_text = x.articles and (not free or not listed and -amount > free and (not free_main or x.unlisted == 1))
            if around_text or not free and not has_main and x.headings:
                x.lifted = True
                opened.append(i)
                break


def inherit(found: list[Block], labels: list[bool | None], aside: list[bool]) -> list[bool]:
    """Second pass: an open block takes the label of the nearest decided block of its region, good if two are equally near.

    Within an article what stands aside of it doesn't count. A region without a decided block is main text if it is an article or main element.
    On a page without any main text all open blocks are.
    """
    near: list[list[int]] = [[] for _ in found]
    for step in (1, -1):
        last: dict[int, int] = {}
        for i in range(len(found))[::step]:
            if found[i].region in last:
                near[i].append(last[found[i].region])
            if labels[i] is not None and not (found[i].main and aside[i]):
                last[found[i].region] = i
    out = []
    for i, label in enumerate(labels):
        if label is None:
            least = min((abs(i - j) for j in near[i]), default=0)
            label = any(labels[j] for j in near[i] if abs(i - j) == least) if near[i] else found[i].main
        out.append(label)
    if not any(out):
        # nothing on the page is decided to be main text: what is left open is, or short pages would be empty
        out = [label is None for label in labels]
    return out


def main_text(page: str | None) -> str:
    """The main blocks joined by line breaks."""
    found, marked = read_blocks(page or "")
    stands = standing(marked)
    aside = [x.off or stands[x.mark] for x in found]
    if any(stands[x.mark] and not x.off for x in found):
        lift(found, marked, in_known_language(found, aside))
        stands = standing(marked)
        aside = [x.off or stands[x.mark] for x in found]
    known = in_known_language(found, aside)
    labels = [False if off else classify(x, known) for x, off in zip(found, aside, strict=True)]
    good = inherit(found, labels, aside)
    inside = sum(x.n for x, ok in zip(found, good, strict=True) if ok and x.main)
    outside = sum(x.n for x, ok in zip(found, good, strict=True) if ok and not x.main)
    return "\n".join(x.text for x, ok in zip(found, good, strict=True) if ok and (x.main or outside > inside))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages(page_id, url, html, ...)``.

    A null or empty page, and one without main text, has the empty text. Character references are decoded, white
    space inside a block is one space, blocks are trimmed and joined by one line break; nothing is capped. Text
    outside of article and main elements is left out if these hold more main text than it does. Time grows with the
    length of a page and not faster, whatever its markup; a page is held by one task. Rows that repeat are each
    extracted; other columns are not looked at. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
