"""Main text of web pages by two passes of block rules.

A page becomes blocks: runs of text between block-level tags, with their stop-word density, length
and link density, and what the elements around them say.  The first pass calls a block good, bad or
short from its own figures; the second gives each short block the label of the nearest decided
neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.llm.common import as_row, whole

# Frequent function words of the languages that occur; a parameter of the operator.
STOP_WORDS = frozenset("""
    the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all
    were when we there can an your which their said if will each about how up out them then she many some so these
    would other into has her two like him see time could no make than been its who now people my made over did down
    der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie
    nach wird bei einer um am sind noch wie einem einen so zum war haben nur oder aber vor zur bis mehr durch man sein
    le la les de des un une et en du que qui dans pour est par sur au aux plus ne se ce pas avec son sa ses il elle ils
    mais ou nous vous leur cette sont comme tout fait sans
    el los las del que y a en un una por con no para es se lo al como su sus o este ha si sobre entre cuando muy sin
    ser son dos esta hay donde
""".split())
SHORT, LONG = 60, 180
FEW_STOPS, MANY_STOPS = 0.08, 0.2
MOST_LINKS = 0.4
#: Linked blocks in a row that are a menu.
MENU = 4

_BLOCK = frozenset("""
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary
    table tbody td tfoot th thead tr ul
""".split())
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg select".split())
_RAW_ENDS = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE_TAGS = frozenset("nav aside footer form button menu dialog fieldset".split())
#: Parts of class names and ids that stand for what surrounds an article.
_ASIDE_PARTS = frozenset("""
    ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets menu menus
    nav navbar navigation breadcrumb breadcrumbs masthead topbar footnav social share sharing recommended recommendations
    pagination pager toolbar search copyright disclaimer tracking teaser outbrain taboola header footer related
""".split())
#: Parts that say an element has or lacks such a thing, or belongs to one of an article's own parts.
_ABOUT = frozenset("no not non without hide has have with is free enabled disabled open closed left right full layout page body wrapper".split())
_OWN = frozenset("entry post article content story main section chapter figure table page title heading".split())
#: What "related" announces when it means other pages.
_OTHERS = frozenset("posts post articles article links link stories story content items reading news products entries pages box list".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*)>?|<[!?/][^>]*>?|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Short calls to the reader that stand in articles without any mark; a parameter of the operator.
_CALLS = re.compile(
    r"\b(?:subscribe|newsletter|sign up|log ?in|follow us|share this|advertisement|sponsored|cookies?|read more|click here|"
    r"abonnieren|anmelden|werbung|abonnez|publicité|suscríbete|publicidad|all rights reserved)\b", re.I
)
CALL = 160


@dataclass
class Block:
    """A run of text: its parts, whether they are linked, and where it stands.

    ``aside``: in an element whose kind says that it is no main text; ``named``: the elements around
    it whose names say so, which hold unless most of the page is in them.
    """

    tag: str
    aside: bool
    article: int
    named: tuple = ()
    parts: list = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: str = ""


def _names(attributes: str) -> tuple[str, str, bool]:
    """(class and id, role, hidden) of a start tag."""
    names, role, hidden = [], "", False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                names.append(value)
            elif name == "role":
                role = value
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "")
            else:
                hidden |= name == "hidden" or value == "true"
    return " ".join(names), role, hidden


def _parts(names: str) -> Iterator[list[str]]:
    """The parts of each class name and id: lower-case runs between separators."""
    for name in names.split():
        if parts := [p for p in re.split(r"[^a-z0-9]+", name) if p]:
            yield parts


def _furniture(names: str) -> bool:
    """Whether a class name or id, as a whole, names something around an article.

    Its first or last part has to say so; "no-sidebar", "has-menu" and "ad-free" do not, nor does an
    article's own part such as "entry-header", nor "related" before a subject.
    """
    for parts in _parts(names):
        first, last = parts[0], parts[-1]
        if len(parts) > 1 and (first in _ABOUT or last in _ABOUT - {"wrapper", "left", "right", "open", "closed", "body"}):
            continue
        if last in ("header", "footer") and len(parts) > 1 and parts[-2] in _OWN:
            continue
        if first == "related" and len(parts) > 1:
            if parts[1] in _OTHERS:
                return True
            continue
        if first in _ASIDE_PARTS or last in _ASIDE_PARTS:
            return True
    return False


def _talk(names: str) -> bool:
    return any(parts[0] in _COMMENTS or parts[-1] in _COMMENTS for parts in _parts(names) if parts[0] not in _ABOUT)


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in page order, with white space folded and references decoded."""
    found: list[Block] = []
    # Open elements: (tag, no main text by kind, it holds comments, number of its article, named
    # elements around it, something other than a div is no main text).
    stack: list[tuple] = [("", False, False, 0, (), False)]
    open_tags: Counter = Counter()
    unended: set[str] = set()
    current, links, articles, at, marks = None, 0, 0, 0, 0

    def end() -> None:
        nonlocal current
        if current is not None:
            current.text = " ".join("".join(current.parts).split())
            if current.text:
                found.append(current)
            current = None

    def pop() -> str:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        return tag

    while at < len(page):
        m = _PIECE.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                if current is None:
                    top = stack[-1]
                    current = Block(top[0], top[1], top[3], top[4])
                text = html.unescape(m[0])
                current.parts.append(text)
                if links:
                    current.linked += len("".join(text.split()))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = 0
            if tag in _BLOCK:
                end()
                if open_tags[tag]:
                    while pop() != tag:
                        pass
                links = 0
            continue
        if tag in _RAW:
            closing = None if tag in unended else _RAW_ENDS[tag].search(page, at)
            if closing is not None:
                at = page.find(">", closing.end() - 1) + 1 or len(page)
            elif tag in ("script", "style"):
                at = len(page)
            else:
                unended.add(tag)  # no later one ends either
            continue
        if tag == "a":
            links = 1
        elif tag == "br":
            if current is not None:
                current.parts.append(" ")
        if tag not in _BLOCK:
            continue
        end()
        links = 0
        if tag == "p" and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            pop()
        elif stack[-1][0] == "p":
            pop()
        if tag in _VOID or m[3].endswith("/"):
            continue
        names, role, hidden = _names(m[3])
        _, aside, comments, article, named, firm = stack[-1]
        talk = comments or _talk(names)
        marked = hidden or tag in _ASIDE_TAGS or role in _ASIDE_ROLES
        if tag == "header" and not article:
            marked = True
        furniture = _furniture(names)
        if tag in ("article", "main") or role == "main":
            furniture = False
            if not talk:
                # A main element inside what was never closed starts anew.
                marked, aside, named = hidden, aside and firm, () if not firm else named
            articles += 1
            article = article or articles
        elif tag in ("body", "html"):
            marked = furniture = False
        if furniture:
            marks += 1
            named = (*named[-7:], marks)
        aside = aside or marked or talk
        stack.append((tag, aside, talk, article, named, firm or (aside and tag != "div")))
        open_tags[tag] += 1
    end()
    _settle_names(found)
    return found


def _settle_names(found: list[Block]) -> None:
    """A name holds unless most of the page's text that is not linked stands in its element."""
    weight: Counter = Counter()
    total = 0
    for block in found:
        if not block.aside:
            plain = max(0, len(block.text) - 2 * block.linked)
            total += plain
            for mark in block.named:
                weight[mark] += plain
    for block in found:
        if any(weight[mark] < LONG or 2 * weight[mark] <= total for mark in block.named):
            block.aside = True


def _first_pass(block: Block, stop_words: frozenset) -> str:
    text = block.text
    if block.aside or (text.startswith("©") and not block.article):
        return "bad"
    if len(text) < CALL and block.tag in ("div", "section", "span", "") and _CALLS.search(text):
        return "bad"
    letters = len(text) - text.count(" ")
    linked = block.linked / max(letters, 1)
    if linked > MOST_LINKS:
        # A linked item or line of an article may be one of its own; its neighbours say.
        return "short" if block.article and block.tag in ("li", "p", "td", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption") else "bad"
    words = [w.strip(".,;:!?()\"'«»¿¡").lower() for w in text.split(" ")]
    stops = sum(w in stop_words for w in words) / len(words)
    if len(text) < SHORT:
        return "short"
    if block.article or stops >= MANY_STOPS or (len(text) >= LONG and stops >= FEW_STOPS):
        return "good"
    return "short" if stops >= FEW_STOPS else "bad"


def _menus(found: list[Block]) -> None:
    """Many linked items in a row are a menu, in an article too."""
    begin = None
    for i in range(len(found) + 1):
        linked = i < len(found) and found[i].label == "short" and found[i].linked > MOST_LINKS * max(1, len(found[i].text) - found[i].text.count(" "))
        if linked and begin is None:
            begin = i
        elif not linked and begin is not None:
            if i - begin >= MENU:
                for block in found[begin:i]:
                    block.label = "bad"
            begin = None


def _second_pass(found: list[Block]) -> None:
    """Short blocks take the label of the nearest decided block of their own article or none.

    Between different labels the nearer one counts, by the blocks between; at equal distance
    headings follow what comes after them, other blocks what comes before.  Where nothing around is
    decided, a short block is good inside an article, and outside if the page has no good block.
    """
    n = len(found)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for order, out in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, int] = {}
        for i in order:
            out[i] = last.get(found[i].article)
            if found[i].label != "short" and not (found[i].aside and found[i].article):
                last[found[i].article] = i
    any_good = any(b.label == "good" for b in found)
    labels = []
    for i, block in enumerate(found):
        if block.label != "short":
            labels.append(block.label)
            continue
        a, b = before[i], after[i]
        if a is None and b is None:
            labels.append("good" if block.article or not any_good else "bad")
        elif a is None or b is None:
            labels.append(found[b if a is None else a].label)
        elif i - a == b - i:
            labels.append(found[b if re.fullmatch("h[1-6]", block.tag) else a].label)
        else:
            labels.append(found[a if i - a < b - i else b].label)
    for block, label in zip(found, labels):
        block.label = label


def main_text(page: str, stop_words: frozenset = STOP_WORDS) -> str:
    """The good blocks, one per line; empty if there are none."""
    found = blocks(page)
    for block in found:
        block.label = _first_pass(block, stop_words)
    _menus(found)
    _second_pass(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extracted(pages: DataFrame, html_col: str = "html", stop_words: frozenset = STOP_WORDS) -> DataFrame:
    """``row`` (struct of all input columns), ``text`` and ``n_chars`` (code points) per page.

    Pages without main text, null and empty ones give an empty text.  Nothing is cut: every good
    block is returned whole.  Broken markup is read as far as it goes: an element that is never
    closed ends with its parent, an unclosed comment, script or style with the page.  Repeated rows
    have equal results; an empty table gives an empty result; columns may have any names.
    """

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([main_text(page, stop_words) for page in series], dtype="object")

    named = pages.select(as_row(pages), read(whole(F.col(f"`{html_col}`"))).alias("text"))
    return named.withColumn("n_chars", F.length("text").cast("long"))
