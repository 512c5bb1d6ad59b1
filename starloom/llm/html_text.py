"""Main-text extraction by two-pass block rules.

Pass 1 judges every text block on its own from three densities (length, link
share, stop-word share) and from the page region it sits in.  Pass 2 gives
each ambiguous block the label of its nearest decided neighbours.
"""
from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, ship

# --- fixed values: common function words, HTML element classes, region words ---
STOP_WORDS = frozenset("""
the of and to a in that is was it for on are as with his they be at this have from or had by but not what all were
we when your can there an which their if will each about how up out them she many some so these would other into has
der die das und ist in den von zu mit sich des auf für als auch es an werden aus er hat dass sie nach wird bei
einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde
le la les de des un une et est que qui dans pour pas au sur par plus avec ce il elle du en ne se son sont aux ou
mais comme tout nous sa fait été aussi leur bien cette ont entre sans
el los las una que y en no se por con su para lo como más al ha pero sus o este sí porque esta cuando muy sobre
también me hasta hay donde quien desde todo nos durante
""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select button svg math iframe object audio video canvas title".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data dfn del em font i img ins kbd label mark q s samp small
span strike strong sub sup time tt u var wbr""".split())
BAD_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_WORDS = frozenset("""nav navbar navigation menu submenu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts
advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent notice notices gdpr
popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget
toolbar pagination pager comment comments reply replies disqus respond copyright legal masthead skip form search alert
paywall""".split())
#: Elements that class and id words never condemn.
WHOLE_TAGS = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
#: First parts of a token that tells of a state ("has-sidebar"), and parts that beside a region word leave it one ("post-comments").
STATES = frozenset("has have no not with without is hide show".split())
BOXES = frozenset("""box boxes bar container wrapper wrap inner outer area section block list item items link links button
buttons icon icons unit slot top bottom left right module panel group row post posts entry article page site inline js media""".split())
HEADER_WORDS = frozenset("header masthead banner".split())
MAIN_WORDS = frozenset("articlebody article-body article-content post-content post-body entry-content story-body main-content".split())

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
WORD = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s+")
IMPLIED = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
LISTS = frozenset("ul ol".split())
SCOPE = frozenset("div article section main aside nav header footer form ul ol dl table tr td th blockquote body li figure".split())


@dataclass(frozen=True)
class Rules:
    """Thresholds of the two passes.  ``stop_known`` is the least share of
    stop words in a page's own text for which their density says anything:
    below it the page is in a language of which the list has no words."""
    length_low: int = 70
    length_high: int = 200
    stop_low: float = 0.30
    stop_high: float = 0.32
    stop_known: float = 0.15
    max_link: float = 0.2
    max_link_main: float = 0.9


@dataclass
class Block:
    text: str
    links: int
    bad: bool
    main: bool
    heading: bool
    item: bool
    place: int  # of the outermost open list (-1: none)


def _names_region(token: str, in_main: bool) -> bool:
    """Does a class or id token name a boilerplate region?  Inside the main
    region all its parts must say so, or be words of mere layout."""
    parts = set(re.split(r"[-_]+", token))
    if in_main:
        words = BAD_WORDS - HEADER_WORDS
        return token in words or not parts.isdisjoint(words) and parts - words <= BOXES
    if re.split(r"[-_]+", token)[0] in STATES:
        return False
    return "header" in parts or not (parts | {token}).isdisjoint(BAD_WORDS)


def _flags(tag: str, attrs: str, in_main: bool) -> tuple[bool, bool, bool]:
    """Is this element a boilerplate region; do only its class or id say so;
    is it a main region?"""
    bad, named, main = tag in BAD_TAGS, False, tag in MAIN_TAGS
    if tag == "header":
        bad = not in_main
    if attrs and "=" in attrs or "hidden" in attrs:
        for name, a, b, c, lone in ATTR.findall(attrs):
            name, value = (name or lone).lower(), (a or b or c).lower()
            if name in ("class", "id"):
                for token in value.split():
                    main |= token in MAIN_WORDS
                    named |= _names_region(token, in_main)
            elif name == "role":
                bad |= value in BAD_ROLES and not (in_main and value == "banner")
                main |= value == "main"
            elif name == "itemprop":
                main |= value == "articlebody"
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                bad = True
            elif name == "style":
                bad |= "display:none" in value.replace(" ", "")
    return bad, named, main and not bad


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, with the region they sit in.  Where
    class or id words condemned elements around the main region, the page is
    read again without those words."""
    out, around = _read(page, frozenset())
    return _read(page, around)[0] if around else out


def _read(page: str, spared: frozenset[int]) -> tuple[list[Block], frozenset[int]]:
    """The blocks, and the elements (by position) around the main region that
    only class or id words condemn; those in ``spared`` are not condemned.
    The main region is every ``main``; on a page without one that has no
    other main region outside boilerplate, what is declared main within."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, inside a bad region, inside a main region
    named: list[tuple[int, int]] = []  # depth and position of open elements condemned by words
    hard: list[int] = []  # depth of open elements condemned otherwise
    sure: set[int] = set()
    maybe: set[int] = set()
    free = False
    parts: list[str] = []
    links = 0
    link_depth = 0
    where = (False, False, False, False, -1)
    # what the stack holds, kept up to date so that no step looks through it
    opened: dict[str, list[int]] = {}  # depths of the open elements of each tag
    scopes: list[int] = []
    outer: list[int] = []              # depths of elements that are not inline
    lists: list[tuple[int, int]] = []  # depth and position of open lists
    headings = 0
    end = len(page)

    def flush():
        nonlocal links
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, links, *where))
            parts.clear()
        links = 0

    def add(raw: str):
        nonlocal links, where
        text = html.unescape(raw) if "&" in raw else raw
        if not parts or where[0] is not bool(stack and stack[-1][1]):
            if parts and text.strip():
                flush()
            where = (bool(stack and stack[-1][1]), bool(stack and stack[-1][2]), headings > 0, bool(opened.get("li")), lists[0][1] if lists else -1)
        parts.append(text)
        if link_depth:
            links += len(text.strip())

    def push(tag: str, in_bad: bool, in_main: bool, at: int):
        nonlocal link_depth, headings
        k = len(stack)
        opened.setdefault(tag, []).append(k)
        if tag in SCOPE:
            scopes.append(k)
        if tag not in INLINE:
            outer.append(k)
        if tag in LISTS:
            lists.append((k, at))
        headings += tag in HEADINGS
        link_depth += tag == "a"
        stack.append((tag, in_bad, in_main))

    def close(k: int):
        nonlocal link_depth, headings
        for tag, _, _ in stack[k:]:
            opened[tag].pop()
            headings -= tag in HEADINGS
            link_depth -= tag == "a"
        del stack[k:]
        for kept in (scopes, outer, hard):
            while kept and kept[-1] >= k:
                kept.pop()
        for kept in (named, lists):
            while kept and kept[-1][0] >= k:
                kept.pop()

    def last(tag: str, below: list[int]) -> int:
        """Depth of the innermost open element of this tag, unless one of ``below`` lies in it; else -1."""
        k = opened[tag][-1] if opened.get(tag) else -1
        return k if not below or k >= below[-1] else -1

    pos = 0
    while pos < end:
        m = MARKUP.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos:m.start()])
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            k = last(tag, outer if tag in INLINE else [])
            if k >= 0:
                close(k)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
                pos = stop.end() if stop else end
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        for old in IMPLIED.get(tag, ("p",) if tag not in INLINE else ()):
            k = last(old, scopes)
            if k >= 0:
                close(k)
        in_bad, in_main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        bad, by_name, main = _flags(tag, m[3], in_main)
        bad |= tag == "head"
        if main and not in_main and not bad and not hard:
            declared = tag == "main" or "main" in re.findall(r"role\s*=\s*[\"']?(\w+)", m[3].lower())
            free |= not named or declared
            if declared:
                sure.update(at for _, at in named)
            elif not by_name:
                maybe.update(at for _, at in named)
        if bad:
            hard.append(len(stack))
        elif by_name and not main and tag not in WHOLE_TAGS and m.start() not in spared:
            named.append((len(stack), m.start()))
            bad = True
        push(tag, in_bad or bad, in_main or main, m.start())
    flush()
    return out, frozenset(sure if free else maybe)


def link_lists(found: list[Block], r: Rules) -> set[int]:
    """Lists (by position) of nothing but links at an edge of the declared
    main region: they lead elsewhere.  Lists with text of their own, or
    between other text, belong to the article."""
    main = [(i, b) for i, b in enumerate(found) if b.main and not b.bad]
    other: dict[int, bool] = {}
    for _, b in main:
        if b.item and b.place >= 0:
            other[b.place] = other.get(b.place, True) and b.links / len(b.text) > r.max_link_main
    text = [i for i, b in main if not (b.item and other.get(b.place, False))]
    spans: dict[int, list[int]] = {}
    for i, b in main:
        if b.item and other.get(b.place, False):
            spans.setdefault(b.place, []).append(i)
    return {at for at, inside in spans.items() if not text or inside[0] < text[0] or inside[-1] > text[-1]}


def stop_words_known(found: list[Block], r: Rules) -> bool:
    """Is the page's own text in a language of the stop words?"""
    stop = n = 0
    for b in found:
        if not b.bad and b.links / len(b.text) <= r.max_link:
            words = WORD.findall(b.text.lower())
            n += len(words)
            stop += sum(w in STOP_WORDS for w in words)
    return stop >= r.stop_known * n


def first_pass(b: Block, r: Rules, edge: set[int] = frozenset(), known: bool = True) -> str:
    """good, bad, neargood or short.  ``edge``: lists that ``link_lists``
    found; ``known``: does stop-word density say anything on this page?  If it
    does not, long blocks without a link are good, others near-good."""
    n = len(b.text)
    share = b.links / n
    if b.bad or (b.item and b.place in edge if b.main else share > r.max_link):
        return "bad"
    if n < r.length_low:
        return "bad" if b.links and not b.main else "short"
    if b.main:
        return "good"
    if not known:
        return "neargood" if b.links else "good"
    words = WORD.findall(b.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if stop >= r.stop_high:
        return "good" if n > r.length_high else "neargood"
    return "neargood" if stop >= r.stop_low else "bad"


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Ambiguous blocks inherit from the nearest decided neighbours of their
    own region (blocks of boilerplate regions do not vote).  Where the two
    differ, a block leans to good if it is near-good, a heading above a good
    block or inside the declared main region.  With no voter, a block outside
    the main region stays only on a page that declares none, if it is no link."""
    n = len(found)
    declared = any(b.main for b in found)
    before, after = [""] * n, [""] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        seen: dict[bool, str] = {}
        for i in order:
            side[i] = seen.get(found[i].main, "")
            if labels[i] in ("good", "bad") and not found[i].bad:
                seen[found[i].main] = labels[i]
    keep = []
    for i, b in enumerate(found):
        near = {before[i], after[i]} - {""}
        if labels[i] in ("good", "bad"):
            keep.append(labels[i] == "good")
        elif b.main or near == {"good"}:
            keep.append(True)
        elif len(near) == 2:
            keep.append(labels[i] == "neargood" or b.heading and after[i] == "good")
        else:
            keep.append(not near and not declared and not b.links)
    return keep


def extract(page: str | None, rules: Rules = Rules()) -> str:
    """Kept blocks joined by an empty line; empty for a null or empty page."""
    found = blocks(page or "")
    edge, known = link_lists(found, rules), stop_words_known(found, rules)
    kept = second_pass(found, [first_pass(b, rules, edge, known) for b in found])
    return "\n\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",),
                  rules: Rules = Rules()) -> DataFrame:
    """``id_col``, ``keep`` columns, text and n_chars of every page; no shuffle.

    A null or empty page has an empty text.  Whole pages are read, whatever
    their length; repeated rows give repeated results; an empty table gives
    an empty result; columns not named here are never read, so extra columns
    cannot clash.
    """
    ship(pages.sparkSession)
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, *keep))

    def run(it):
        for b in batches(it, 4 << 20, "__html"):
            text = [extract(p, rules) for p in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                names=[id_col, *keep, "text", "n_chars"])

    rows = pages.select(id_col, *keep, F.col(html_col).cast("string").alias("__html"))
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
