"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags; menus, headers, footers, sidebars, notices, adverts,
forms and reader comments are excluded by their elements' tags and names before any rule. Pass one
decides the other blocks from length, link density and stop-word density: long prose with many stop
words and few links is content, link-dense text is not; short blocks, and those between the
thresholds, stay ambiguous. Pass two gives them the label of the nearest decided neighbours.

An article or main element is a prior: inside it only prose and menus (lines of links that follow each
other) are decided at once, its edges count as content, and an ambiguous block there takes the label of the
nearest decided neighbours inside, which is content unless both of them are menus. So a sidebar's label does
not spread to it. The page's edges decide nothing.

A class or id counts as a whole name (``sidebar``, ``site-footer``, ``nav-list``), not by any part of it
(``has-sidebar``, ``menu-closed``). A container that holds the page's main element, or all its articles, is
no boilerplate whatever its name, unless it is named after comments, adverts or related pages.

Unclosed scripts and styles run to the end of the page. Other skipped elements (buttons, drawings,
frames) that are unclosed or self-closed are empty, and the text after them is read.

Defined results: null and empty pages give an empty text; unclosed and truncated markup is read
as far as it goes; very long and hostile pages are read whole and in linear time; an empty table gives no rows; repeated rows give repeated results; extra
columns are ignored; between unlike neighbours a block that was nearly content by itself and a
heading before content are content, and any other ambiguous block is if the nearer one is (or both
are as near); on a page without content blocks the undecided ones that are not short are content.
``decisions`` tells how each block was decided.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

# Stop words of the four languages of the corpus.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may then do first any my now such like our over me even most made after also did many must before back through years where much your way well down should because each just those people too very "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei "
    "le la les de des du et un une est en que qui dans pour par sur au aux avec ne pas ce il elle se plus son sa ses ou mais nous vous ils leur comme cette être ont été sont "
    "el los las del una con para por al lo como más pero sus su este ya entre porque cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos esto antes algunos qué unos otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas".split()
)
# Class and id words of boilerplate.
BOILER_WORDS = frozenset(
    "ad ads adbox adslot adunit adspace adv advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored sponsors promo promotion menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars widget widgets footer footers header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist replies reply responses response respond disqus pagination pager copyright skip search hidden".split()
)
# Parts of names that tell of a state or a layout, and endings of the names of boilerplate.
STATE_WORDS = frozenset("has no with without is not layout open opened closed active inactive enabled disabled collapsed expanded toggled visible loaded".split())
ENDINGS = frozenset("area bar block bottom box button buttons col column container content form group icons inner item items left link links list main message outer panel posts primary right section secondary slot text top unit wrap wrapper".split())
# Names whose containers are boilerplate even if all articles are in them.
OTHER_PAGES = frozenset("ad ads adbox adslot adunit adspace adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored sponsors promo promotion related recommended comment comments commentlist replies reply responses response respond disqus".split())
# Elements by role.
BOILER_TAGS = frozenset("nav footer aside form head menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
CONTAINERS = frozenset("html head body div section nav article main aside header footer form ul ol dl table tbody thead tfoot tr td th figure fieldset menu dialog details blockquote".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption caption option summary legend title center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Names of article elements that are a reader's comment or an advert.
_OTHER_ARTICLE = re.compile(r"comments?(?:[-_](?:body|item|entry|content|text|wrap|inner|\d+))*|commentlist|repl(?:y|ies)|respon(?:d|se)|disqus\w*|ads?|advert\w*|sponsor(?:ed)?|promo")
#: Thresholds of pass one: characters, link density (and that of a line of a menu), stop-word density.
SHORT, LONG, LINKS, MENU, STOPS_LOW, STOPS_HIGH = 70, 200, 0.2, 0.9, 0.15, 0.3

# quoted strings and what is between them, at most so many that a page of unclosed tags is read in linear time
_ATTRIBUTES = r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+'){0,512}+"
_UNREAD = r"<!--.*?(?:-->|\Z)|<(?:script|style)(?:/|\s(?:[^'\">/]++|\"[^\"]*+\"|'[^']*+'|/(?!>)){0,512}+(?<=[\s\"'])/)>|<(script|style)\b[^>]*>(?:.*?</\1\s*>|.*\Z)"
_TOKEN = re.compile(rf"{_UNREAD}|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S | re.I)
_SKIP = re.compile(rf"{_UNREAD}|<(/?)(noscript|template|svg|iframe|object|textarea|select|button)(?![^\s/>])({_ATTRIBUTES}|[^>]*)>", re.S | re.I)
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
#: Skipped elements that can hold one of their own name, and those whose content is no markup.
_NESTED = frozenset("svg object template".split())
_RAW = {x: re.compile(rf"<(/?){x}(?![^\s/>])[^>]*>", re.I) for x in ("iframe", "textarea")}
_NAMES = re.compile(r"\b(class|id|role|itemprop|style|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = re.compile(r"[a-z]+")


@lru_cache(1 << 14)
def boiler_words(name: str) -> frozenset[str]:
    """The boilerplate words that a class or id stands for: the whole name, its last word, or its first one before a usual ending."""
    words = _PARTS.findall(name)
    if not words or not STATE_WORDS.isdisjoint(words):
        return frozenset()
    first = all(w in ENDINGS or w in BOILER_WORDS for w in words[1:])
    return BOILER_WORDS & {words[-1], *(words[:1] if first else ())}


def _is_boiler(tag: str, attributes: str, in_main: bool, holds: str) -> bool:
    """holds: main, if the element holds the page's main element; articles, if it holds all articles."""
    if holds == "main":
        return False
    if tag in BOILER_TAGS and not (holds and tag == "form") or tag == "header" and not in_main and not holds:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return any(_OTHER_ARTICLE.fullmatch(x) for name, a, b, c in _NAMES.findall(attributes) if name.lower() != "style" for x in (a or b or c).lower().split())
    for name, a, b, c in _NAMES.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if (name == "hidden" or name == "style" and "display:none" in value.replace(" ", "")) and not holds:
            return True
        if name in ("class", "id", "role", "itemprop"):
            for word in frozenset().union(*map(boiler_words, value.split())):
                if not (in_main and word == "header") and (not holds or word in OTHER_PAGES):
                    return True
    return False


def skipped(page: str) -> dict[int, int]:
    """Start and end of the skipped elements that are closed."""
    spans: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    at, last = 0, page.rfind(">") + 1  # no tag ends later
    while m := _SKIP.search(page, at, last):
        at = m.end()
        if m.group(3) is None:
            continue
        name = m.group(3).lower()
        if m.group(2):
            if opened.get(name):
                spans[opened[name].pop()] = at
        elif _CLOSED.search(m.group(4)):
            continue
        elif name in _RAW:
            end = _RAW[name].search(page, at)
            if end and end.group(1):
                spans[m.start()] = at = end.end()
        elif name in _NESTED:
            opened.setdefault(name, []).append(m.start())
        else:
            opened[name] = [m.start()]
    return spans


def tags(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, where the text goes on, tag, it closes, attributes) of everything that is not text; tag is empty if it is no tag that counts."""
    found, at, skip = [], 0, skipped(page)
    while m := _TOKEN.search(page, at):
        at = skip.get(m.start(), m.end())
        counts = m.group(3) is not None and at <= m.end()
        found.append((m.start(), at, m.group(3).lower() if counts else "", bool(m.group(2)), m.group(4) or ""))
    return found


class Open:
    """The containers that are open."""

    def __init__(self):
        self.stack: list[tuple] = []
        self.names: Counter[str] = Counter()

    def push(self, tag: str, *state) -> None:
        self.stack.append((tag, *state))
        self.names[tag] += 1

    def close(self, tag: str):
        """Those that an end tag closes, the innermost first; none if it closes nothing."""
        while self.names[tag]:
            top = self.stack.pop()
            self.names[top[0]] -= 1
            yield top
            if top[0] == tag:
                return


def holders(found: list[tuple[int, int, str, bool, str]]) -> dict[int, str]:
    """The containers (by place in the list) that hold the main element, or all outer articles."""
    opened, mains, articles, depth = Open(), 0, 0, 0
    spans: list[tuple[int, int, int]] = []

    def end(top) -> None:
        nonlocal depth
        _, i, m, a, own = top
        spans.append((i, mains - m, articles - a))
        depth -= own

    for i, (_, _, tag, closes, attributes) in enumerate(found):
        if closes:
            for top in opened.close(tag):
                end(top)
        elif tag in CONTAINERS:
            own = tag == "article" and not _is_boiler(tag, attributes, False, "")
            opened.push(tag, i, mains, articles, own)
            mains += tag == "main"
            articles += own and not depth
            depth += own
    for top in reversed(opened.stack):
        end(top)
    return {i: "main" if m else "articles" for i, m, a in spans if m or a and a == articles}


def blocks(page: str) -> list[tuple[str, str, float, bool]]:
    """(text, zone, link density, is a heading) of the page's non-empty blocks; zone: boiler, main or open."""
    out: list[tuple[str, str, float, bool]] = []
    opened = Open()  # with the boilerplate depth and main depth before each
    text: list[str] = []
    boiler = main = links = at = 0
    in_link = block_boiler = heading = False
    found = tags(page)
    holds = holders(found)

    def end_block() -> None:
        nonlocal links
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append((whole, "boiler" if boiler or block_boiler else "main" if main else "open", min(1.0, links / len(whole)), heading))
            text.clear()
        links = 0

    for i, (start, resume, tag, closes, attributes) in enumerate(found):
        if start > at:
            piece = page[at:start]
            text.append(piece)
            if in_link:
                links += len(piece.strip())
        at = resume
        if tag == "a":
            in_link = not closes
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS:
            end_block()
            block_boiler = in_link = False
            heading = tag in HEADINGS and not closes
            if closes:
                for _, boiler, main in opened.close(tag):  # noqa: B007
                    pass
            elif tag in CONTAINERS:
                opened.push(tag, boiler, main)
                boiler += _is_boiler(tag, attributes, main > 0, holds.get(i, ""))
                main += tag in MAIN_TAGS
            else:
                block_boiler = tag == "title" or _is_boiler(tag, attributes, main > 0, "")
    if at < len(page):
        text.append(page[at:])
    end_block()
    return out


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()%&*#$") in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(found: list[tuple[str, str, float, bool]]) -> list[str]:
    """boiler, good, bad, near, far, menu, heading or short for each block."""
    labels = []
    for text, zone, links, heading in found:
        if zone == "boiler":
            labels.append("boiler")
        elif zone == "main" and links > LINKS:
            labels.append("menu" if links > MENU and len(text) < SHORT else "near")
        elif zone == "open" and (links > LINKS or "©" in text):
            labels.append("bad")
        elif len(text) < SHORT:
            labels.append("bad" if zone == "open" and links > 0 else "heading" if heading else "short")
        else:
            stops = stop_density(text)
            labels.append("good" if stops >= STOPS_HIGH and len(text) > LONG else "near" if stops >= STOPS_LOW else "far")
    # lines of links that follow each other
    menus = [x == "menu" and "menu" in labels[max(0, i - 1) : i] + labels[i + 1 : i + 2] for i, x in enumerate(labels)]
    return ["bad" if m else "near" if x == "menu" else x for x, m in zip(labels, menus, strict=True)]


def _nearest(labels: list[str]) -> list[tuple[int, str, int, str]]:
    """(distance, label) of the last decided block before and the first one after each block."""

    def decided(order: range) -> list[tuple[int, str]]:
        found, last = [(len(labels), "")] * len(labels), None
        for i in order:
            if last is not None:
                found[i] = (abs(i - last), labels[last])
            if labels[i] in ("good", "bad"):
                last = i
        return found

    return [(*x, *y) for x, y in zip(decided(range(len(labels))), decided(range(len(labels) - 1, -1, -1)), strict=True)]


def second_pass(labels: list[str], zones: list[str]) -> list[tuple[bool, str]]:
    """(kept, how it was decided: zone, rule, inherited or prior) of each block; ambiguous ones inherit from the nearest decided neighbours."""
    how = ["zone" if x == "boiler" else "rule" if x in ("good", "bad") else "" for x in labels]
    labels = ["bad" if x == "boiler" else x for x in labels]
    inside = [i for i, z in enumerate(zones) if z == "main"]
    # an article's edges count as content: a block there is no content only between two menus
    for i, (_, before, _, after) in zip(inside, _nearest([labels[i] for i in inside]), strict=True):
        if labels[i] not in ("good", "bad"):
            how[i] = "inherited" if before or after else "prior"
            labels[i] = "left" if before == after == "bad" else "taken"
    labels = [{"left": "bad", "taken": "good"}.get(x, x) for x in labels]
    if "good" not in labels:
        labels = ["good" if x in ("near", "far") else x for x in labels]
        how = ["prior" if not h and x == "good" else h for h, x in zip(how, labels, strict=True)]
    out = []
    for x, h, (m, b, n, a) in zip(labels, how, _nearest(labels), strict=True):
        nearest = b == "good" and m <= n or a == "good" and n <= m or not a and not b
        out.append((x == "good" or x != "bad" and (nearest or x == "near" and "good" in (a, b) or x == "heading" and a == "good"), h or "inherited"))
    return out


def decisions(page: str) -> list[tuple[str, bool, str]]:
    """(text, kept, how) of every block of a page."""
    found = blocks(page)
    return [(x[0], *d) for x, d in zip(found, second_pass(first_pass(found), [x[1] for x in found]), strict=True)]


def main_text(page: str) -> str:
    return "\n".join(text for text, kept, _ in decisions(page) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for b in batches:
            texts = [main_text(x or "") for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint")
