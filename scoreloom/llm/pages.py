"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags. The first pass classifies each block by its place
(landmark tags, names in class, id and role), length, link density and stop-word density as good, bad or
ambiguous. A name that only holds a word of boilerplate may be a sidebar's, or a page's that has one (`right-sidebar`): such a
container is boilerplate unless it holds most of the text around it, and of its main text. In the second pass ambiguous short blocks inherit the label of the nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import slices

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or an they which you one we all her there their been if so would "
    "der die das und ist nicht ein eine zu den von mit sich auf für im dem als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des du et un une que qui dans en pour pas sur par au avec ce il plus est sont ou se "
    "el los las del y por con para una su al lo como más o pero sus ha sin sobre".split()
)
# Frequent signs of Japanese and Chinese.
STOP_SIGNS = frozenset("のはをにがともでたしるすな的是不了在有我他这中大来上个们和地到时")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article aside body details dialog div dl fieldset figure footer form header html main menu nav ol section table td ul blockquote".split())
SKIPPED = "script style noscript template svg iframe object canvas textarea select button title math audio video".split()
#: Whose content isn't text even if they are never closed.
RAW = frozenset("script style noscript template iframe textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where the next of their kind begins.
ENDED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion sidebar sidebars side widget widgets rail menu menus nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist respond reply replies disqus discussion cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager copyright legal "
    "skip search complementary contentinfo tags reviews".split()
)
#: First words of names that tell of a layout or a subject, and last words that deny what stands before.
MODIFIERS = frozenset("has with without no not is category tag tags page".split())
DENIALS = frozenset("none no off hidden".split())
COMMENT_NAMES = frozenset("comment comments commentlist respond reply replies reviews disqus".split())
MAIN_NAMES = frozenset("article main content post entry story articlebody bodytext".split())
HEADER_NAMES = frozenset("header head".split())

#: Characters of a short and of a long block; stop-word densities of text; the most of it that links may make up.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.2, 0.3, 0.33
#: Within the main container only blocks that are nearly all links are bad.
LINKS_IN_MAIN = 0.8
#: A container whose name is in doubt holds more than this share of the text around it, or is boilerplate.
MOST = 0.5

# A tag begins with its name; attributes follow. A quote counts only after an equals sign.
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?|=)""")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in SKIPPED}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_SENTENCE = re.compile(r"[.!?](?=\s|$)|[。！？]")
_COPYRIGHT = re.compile(r"^\s*(?:©|\(c\)\s|copyright\b)", re.IGNORECASE)

GOOD, BAD, AMBIGUOUS = "good", "bad", "ambiguous"


class Block(NamedTuple):
    text: str
    links: int  # characters inside links
    place: str  # main, boilerplate or open


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from at on, the first of each name, and the place after the tag's end."""
    found: dict[str, str] = {}
    while m := _ATTRIBUTE.match(page, at):
        at = m.end()
        if m[1]:
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    end = page.find(">", at)
    return found, len(page) if end < 0 else end + 1


def _names(attributes: dict[str, str]) -> tuple[set[str], set[str]]:
    """Whole names in class and id, and first and last words of the names that are several; modifiers speak for nothing."""
    whole, parts = set(), set()
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in _NAME.findall(token)]
        if words:
            whole.add("".join(words))
        if len(words) > 1 and words[0] not in MODIFIERS and words[-1] not in DENIALS:
            parts |= {words[0], words[-1]}
    return whole, parts


def _kind(name: str, attributes: dict[str, str], outer: str) -> tuple[str, bool]:
    """The place inside an element: main, boilerplate, open, hidden, or muted for hidden text inside a block; and whether a part of its name puts it in doubt."""
    if outer in ("boilerplate", "hidden", "muted") or not attributes and name not in BLOCKS:
        return outer, False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attributes.get("style", "")):
        return "hidden" if name in BLOCKS else "muted", False
    if name not in BLOCKS:
        return outer, False
    role = attributes.get("role", "").lower()
    whole, parts = _names(attributes)
    if name in ("html", "body", "article", "main"):  # their names tell of the layout, but comments may be articles
        whole, parts = whole & COMMENT_NAMES, parts & COMMENT_NAMES
    if name in BOILERPLATE_TAGS or role in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "dialog", "alert") or whole & BOILERPLATE_NAMES:
        return "boilerplate", False
    doubt = bool(parts & BOILERPLATE_NAMES)
    if name not in CONTAINERS:
        return outer, doubt
    if name in ("article", "main") or role in ("main", "article") or whole & MAIN_NAMES:
        return "main", doubt and not (role in ("main", "article") or whole & MAIN_NAMES)
    if parts & MAIN_NAMES:
        return "main", doubt
    if outer != "main" and (name == "header" or whole & HEADER_NAMES):
        return "boilerplate", False
    return outer, doubt or outer != "main" and bool(parts & HEADER_NAMES)


class Doubt(NamedTuple):
    """A container that its name puts in doubt: the place around it, and the doubt that it is in (-1: none)."""

    outer: str
    within: int


def _resolved(found: list[tuple[Block, int]], doubts: list[Doubt]) -> list[Block]:
    """The blocks, each with the doubt that it stands in (-1: none), with every doubt decided from the outermost on."""
    if not doubts:
        return [b for b, _ in found]
    around = [0] * len(doubts)  # plain characters beside and in a container, in the same place
    inside, main_inside = [0] * len(doubts), [0] * len(doubts)
    total = {"": 0, "main": 0}
    plain = [(0 if b.place in ("boilerplate", "hidden") else len(b.text) - b.links) for b, _ in found]
    for (b, at), n in zip(found, plain, strict=True):
        total[""] += n
        total["main"] += n if b.place == "main" else 0
        while at >= 0:
            inside[at] += n
            main_inside[at] += n if b.place == "main" else 0
            at = doubts[at].within
    fine: list[bool] = []
    for k, d in enumerate(doubts):
        around[k] = total["main"] if d.outer == "main" else total[""]
        most_main = d.outer == "main" or not total["main"] or main_inside[k] > MOST * total["main"]
        fine.append((d.within < 0 or fine[d.within]) and most_main and inside[k] > MOST * around[k])
    return [b if at < 0 or fine[at] else b._replace(place="boilerplate") for b, at in found]


def blocks(page: str) -> list[Block]:
    """The blocks of a page with any text, in order: white space made single, character references decoded.

    The page is read once from left to right, however broken it is. A page without any tag is one block of its main text.
    """
    out: list[tuple[Block, int]] = []
    texts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, str, int]] = []  # open elements, the place inside each, and the last doubt
    doubts: list[Doubt] = []
    opened: dict[str, list[int]] = {}  # the places in it of each name, and of containers
    containers: list[int] = []
    unclosed: set[str] = set()
    place, doubt, links, at, head, tags, size = "open", -1, 0, 0, False, 0, len(page)

    def flush() -> None:
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text and place != "hidden" and not head:
                out.append((Block(text, len(" ".join(html.unescape("".join(linked)).split())) if linked else 0, place if tags else "main"), doubt))
            texts.clear()
            linked.clear()

    def add(piece: str) -> None:
        if piece and place != "muted":
            texts.append(piece)
            if links:
                linked.append(piece)

    def close(names: tuple[str, ...], through: bool) -> None:
        """Ends the innermost element of these names; not one outside of the container, unless through."""
        k = max((opened[x][-1] for x in names if opened.get(x)), default=-1)
        if k < 0 or not through and containers and containers[-1] > k:
            return
        for x, *_ in stack[k:]:
            opened[x].pop()
        while containers and containers[-1] >= k:
            containers.pop()
        del stack[k:]

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            break
        m = _TAG.match(page, lt)
        if m is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                stop = size if end < 0 else end + 3
            elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                stop = size if end < 0 else end + 1
            else:  # a sign, no tag
                add(page[at : lt + 1])
                at = lt + 1
                continue
            add(page[at:lt])
            at, tags = stop, tags + 1
            continue
        add(page[at:lt])
        tags += 1
        attributes, at = _attributes(page, m.end())
        name, closing = m[1].lower(), page[lt + 1] == "/"
        if name in _CLOSE and not closing and name not in unclosed:
            if end := _CLOSE[name].search(page, at):
                at = page.find(">", end.end())
                at = size if at < 0 else at + 1
            elif name in RAW:
                at = size
            else:
                unclosed.add(name)
            continue
        if name == "a":
            links = 0 if closing else 1
        if name == "br":
            add(" ")
        elif name == "head":
            flush()
            head = not closing
        elif name not in VOID:
            if name in BLOCKS:
                flush()
                links = 0
                head = head and name != "body"
            if closing:
                close((name,), name in BLOCKS)
            else:
                if name in BLOCKS:
                    close(("p",), False)
                if name in ENDED:
                    close(ENDED[name], False)
                _, outer, doubt = stack[-1] if stack else ("", "open", -1)
                kind, unsure = _kind(name, attributes, outer)
                if name == "main" or attributes.get("role", "").lower() == "main":
                    doubt = -1  # whatever the names around it
                if unsure:
                    doubts.append(Doubt(outer, doubt))
                    doubt = len(doubts) - 1
                opened.setdefault(name, []).append(len(stack))
                if name in CONTAINERS:
                    containers.append(len(stack))
                stack.append((name, kind, doubt))
            _, place, doubt = stack[-1] if stack else ("", "open", -1)
        elif name in BLOCKS:
            flush()
    add(page[at:])
    flush()
    return _resolved(out, doubts)


def density(text: str) -> float:
    """The share of stop words, or in scripts without spaces of four times that of their frequent signs."""
    words = text.lower().split()
    if sum(c >= "\u2e80" for c in text) > 0.3 * len(text):
        return min(1.0, 4 * sum(c in STOP_SIGNS for c in text) / len(text))
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(block: Block) -> str:
    """good, bad or ambiguous by place, link density, length and stop-word density."""
    if block.place == "boilerplate":
        return BAD
    size = len(block.text)
    share = block.links / size
    if block.place == "main" and share <= LINKS_IN_MAIN and size > LONG:
        return GOOD
    if share > (LINKS_IN_MAIN if block.place == "main" else LINKS):
        return BAD
    stop = density(block.text)
    if block.place == "main":
        return GOOD if size >= SHORT and stop >= STOP_LOW else AMBIGUOUS
    if _COPYRIGHT.match(block.text):
        return BAD
    if size < SHORT:
        return BAD if block.links else AMBIGUOUS
    if stop >= STOP_HIGH or stop >= STOP_LOW and size > LONG:
        return GOOD
    if size > LONG and not block.links and len(_SENTENCE.findall(block.text)) * LONG >= size:
        return GOOD  # sentences in a language whose words aren't known
    return AMBIGUOUS if stop >= STOP_LOW else BAD


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Which blocks stay. An ambiguous one takes the label of the nearest decided block, of the good one of two
    as near. Within the main container only blocks of that container are its neighbours, and it stays if none is decided."""
    n = len(found)

    def nearest(order: range) -> list[tuple[int, str] | None]:
        out: list[tuple[int, str] | None] = [None] * n
        seen: dict[bool, tuple[int, str]] = {}
        for i in order:
            main = found[i].place == "main"
            if labels[i] != AMBIGUOUS:
                seen[main] = (i, labels[i])
            else:
                options = [seen[True]] if main and True in seen else [] if main else list(seen.values())
                out[i] = min(options, key=lambda x: abs(x[0] - i), default=None)  # noqa: B023
        return out

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    stays = []
    for i, label in enumerate(labels):
        if label == AMBIGUOUS:
            near = [x for x in (before[i], after[i]) if x]
            if not near:
                label = GOOD if found[i].place == "main" else BAD
            else:
                least = min(abs(x[0] - i) for x in near)
                label = GOOD if any(x[1] == GOOD and abs(x[0] - i) == least for x in near) else BAD
                if found[i].place == "main" and len(found[i].text) > found[i].links:
                    label = GOOD  # its neighbours there can only be bad as lists of links
        stays.append(label == GOOD)
    return stays


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    stays = second_pass(found, [first_pass(b) for b in found])
    return "\n\n".join(b.text for b, s in zip(found, stays, strict=True) if s)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            texts = pa.array([main_text(x.as_py()) for x in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """Per page row: page_id, url, text (empty if none), n_chars (its code points).

    The whole html is read; null counts as empty. Blocks are joined in page order by an empty line. Repeated
    rows and null ids give a row each; no rows give no rows; other columns play no part.
    """
    kinds = dict(pages.dtypes)
    out = pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
