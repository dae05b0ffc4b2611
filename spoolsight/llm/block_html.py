"""Main text of web pages by two passes of rules over their blocks.

A page is cut into blocks at block-level tags. What an element is called (tag, role, class, id) is evidence: a menu, page header
or footer, sidebar, form, advert or reader comment is boilerplate with all below it, unless it holds the page's main article
or nearly all of the text around it; weaker names only decide what else is undecided.

First pass, for a block outside of such elements: one whose text is mostly links is boilerplate; one of some length with many
stop words is content; a long one is content inside an article, and outside it is boilerplate if it has few stop words. On
pages in a language of which no stop word is known, words of up to three letters take their place, and texts without
blanks between words go by their length. Everything else, mostly short blocks, is undecided. Second pass: an undecided block
of an article is content if one of its nearest decided neighbours there, before and after, is, or if none in the article is.
Elsewhere it takes the label of the nearest decided block of its own section, content on a tie, or, in a section without
decided blocks, that of its nearest decided neighbours of any section, boilerplate on a tie. A page without any decided
block is content.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tokens of a page, and the tags and names that the rules know.
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
COMMENT_ENDS = re.compile(r"<!--(?:-?|.*--!?)>\Z", re.S)
#: A line of the page's owner, however its element is called.
OWNER = re.compile(r"\A\W*(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
BLOCK = set("address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
SELF_CLOSING = set("p li dt dd option tr td th".split())
VOID = set("hr".split())
NEVER = set("head nav aside footer form select menu dialog button".split())
SECTION = set("article main section body td".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Names that mark boilerplate as a part of a class or id, reader comments, and those that do so only as the whole of one.
NAMES = set("ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar newsletter subscribe subscription login signup copyright legal".split())
COMMENTS = set("comment comments disqus reply replies".split())
VAGUE = set("notice notices alert header share sharing social related recommended search tags".split())
#: A class with such a part says something of the page's state, not what its element is.
STATES = set("has no not with without is open opened closed none enabled disabled on off".split())
STOP_WORDS = frozenset(
    "the of and to in a is that it was for on with as be by this are from or at which not have an but what all were when we there can your his they he she you i"
    " de la el en y los las un una que se del al con por para su lo no es como más mi si sin sobre este ya"
    " le les et des du dans une qui il est pour pas au sur ne par avec son elle plus ce sont ses ou mais"
    " der die das und von zu den mit sich dem ist nicht ein eine als auch auf für im aus wird bei nach wie oder an".split()
)
LINKS, SHORT, LONG, MANY_STOPS, FEW_STOPS = 0.4, 70, 140, 0.12, 0.05
#: A page's share of stop words below which its language is unknown; letters a word above which words have no blanks between.
KNOWN, UNSPACED = 0.04, 15
WORDS = re.compile(r"[^\W\d_]+")
NOTHING, WEAK, STRONG, COMMENT = range(4)
#: Shares of the text around it from which an element is spared, by what its names say. Reader comments are so only on pages
#: without a main article.
SPARED = {NOTHING: 2.0, WEAK: 0.5, STRONG: 0.9, COMMENT: 0.99}


@dataclass(slots=True)
class _Element:
    tag: str
    parent: int
    kind: int  # how its names speak against it
    article: bool  # whether its innermost section is an article
    section: int
    plain: int = 0  # characters outside links, with all below it but reader comments


@dataclass(slots=True)
class _Block:
    text: str
    linked: int  # characters in links
    element: int


def parse(page: str) -> tuple[list[_Block], list[_Element]]:
    """Blocks with text in page order, and the elements around them, each after its parent; the first stands for the page."""
    found: list[_Block] = []
    elements = [_Element("", -1, NOTHING, False, 0)]
    sections = 1
    stack = [0]
    open_tags: dict[str, int] = {}
    text: list[str] = []
    linked: list[str] = []
    in_link, at, unclosed = False, 0, False
    last = page.rfind(">") + 1  # no tag ends after it

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                found.append(_Block(whole, len(" ".join(html.unescape("".join(linked)).split())), stack[-1]))
        text.clear()
        linked.clear()

    def close(size: int) -> None:
        for e in stack[size:]:
            open_tags[elements[e].tag] -= 1
        del stack[size:]

    for m in TOKEN.finditer(page, 0, last):
        if m.start() > at:
            part = page[at : m.start()]
            text.append(part)
            if in_link:
                linked.append(part)
        at = m.end()
        closing, tag = m[2], (m[3] or "").lower()
        if m[1] or m[0].startswith("<!--"):  # it may go on to the end of the page
            unclosed = at == last and not _closed(m[0], m[1])
            continue
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            text.append(" ")
        if tag not in BLOCK and tag != "button":
            continue
        flush()
        in_link = False if tag != "button" else in_link
        if closing:
            if open_tags.get(tag):
                size = len(stack) - 1
                while elements[stack[size]].tag != tag:
                    size -= 1
                close(size)
            continue
        top = elements[stack[-1]]
        if top.tag in SELF_CLOSING and (top.tag == "p" or tag == top.tag):
            close(len(stack) - 1)
        if tag in VOID:
            continue
        if tag == "body" and len(stack) > 1:
            close(2 if elements[stack[1]].tag == "html" else 1)
        above = elements[stack[-1]]
        kind = NOTHING if tag in ("body", "html", "h1") else _kind(m[4])
        if tag in NEVER or tag == "header" and not above.article:
            kind = max(kind, STRONG)
        article, section = above.article, above.section
        if tag in SECTION and (tag in ("article", "main") or not above.article):
            article, section, sections = tag in ("article", "main"), sections, sections + 1
        elements.append(_Element(tag, stack[-1], kind, article, section))
        stack.append(len(elements) - 1)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    if not unclosed:
        text.append(page[at:].split("<!--", 1)[0])
    flush()
    for block in found:
        elements[block.element].plain += len(block.text) - block.linked
    for e in reversed(elements[1:]):
        elements[e.parent].plain += e.plain if e.kind < COMMENT else 0
    return found, elements


def _closed(token: str, tag: str | None) -> bool:
    """Whether a comment, or an element whose content is no markup, has its own end."""
    return bool(re.search(rf"</{tag}\s*>\Z", token, re.I) if tag else COMMENT_ENDS.match(token))


def _kind(attributes: str | None) -> int:
    """How class, id, role and visibility speak against an element."""
    kind = NOTHING
    for name, value in ATTRIBUTE.findall(attributes or ""):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role":
            kind = max(kind, STRONG if value in ROLES else NOTHING)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            kind = max(kind, STRONG)
        elif name in ("class", "id"):
            for token in value.split():
                parts = set(re.split("[_-]+", token))
                if token in VAGUE:
                    kind = max(kind, STRONG)
                elif not parts & STATES:
                    kind = max(kind, COMMENT if parts & COMMENTS else STRONG if parts & NAMES else WEAK if parts & VAGUE else NOTHING)
    return kind


def boilerplate(elements: list[_Element]) -> list[int]:
    """For each element the strongest kind that holds of it, its own or one above it, after exemptions."""
    above = [NOTHING] * len(elements)  # before exemptions
    for k, e in enumerate(elements[1:], 1):
        above[k] = max(above[e.parent], e.kind)
    articles = [k for k, e in enumerate(elements) if e.tag in ("article", "main") and e.plain and above[k] < COMMENT]
    main = max((k for k in articles if 2 * elements[k].plain >= elements[0].plain), key=lambda k: elements[k].plain, default=0)
    clean = max((k for k in articles if above[k] < STRONG), key=lambda k: elements[k].plain, default=0)
    if clean and 4 * elements[clean].plain >= elements[main].plain * bool(main):
        main = clean
    holds_main, k = set(), main
    while k > 0:
        holds_main.add(k)
        k = elements[k].parent
    held, inside = [NOTHING] * len(elements), [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        inside[k] = k == main or inside[e.parent]
        around = elements[main if inside[k] else 0].plain + (e.plain if e.kind == COMMENT else 0)
        spared = k in holds_main or e.plain >= SPARED[e.kind] * around > 0 and not (main and e.kind == COMMENT)
        held[k] = max(held[e.parent], NOTHING if spared else e.kind)
    return held


def densities(found: list[_Block], held: list[int]) -> list[float | None]:
    """Share of stop words in each block; None where words cannot be told apart."""
    words = [WORDS.findall(b.text) for b in found]
    stops = [sum(w.lower() in STOP_WORDS for w in ws) for ws in words]
    open_blocks = [k for k, b in enumerate(found) if held[b.element] < STRONG]
    if sum(stops[k] for k in open_blocks) < KNOWN * sum(len(words[k]) for k in open_blocks):
        stops = [sum(len(w) <= 3 and w.islower() for w in ws) for ws in words]
    return [None if sum(map(len, ws)) > UNSPACED * len(ws) else s / len(ws) if ws else 0.0 for ws, s in zip(words, stops, strict=True)]


def first_pass(found: list[_Block], elements: list[_Element], held: list[int]) -> list[bool | None]:
    """Labels of the blocks that their own features decide."""
    labels: list[bool | None] = []
    dense = [b.linked > LINKS * len(b.text) for b in found]
    for k, (block, density) in enumerate(zip(found, densities(found, held), strict=True)):
        kind, size = held[block.element], len(block.text) * (1 if density is not None else 2)
        article = elements[block.element].article
        if kind >= STRONG:
            labels.append(False)
        elif dense[k]:  # links in a row are a list of them; one among an article's other blocks may be a part of it
            alone = article and not any(dense[max(0, k - 1) : k]) and not any(dense[k + 1 : k + 2])
            labels.append(None if alone else False)
        elif not article and size < LONG and OWNER.search(block.text):
            labels.append(False)
        elif size >= SHORT and density is not None and density >= MANY_STOPS:
            labels.append(True)
        elif size >= LONG and (density is None or article):
            labels.append(True)
        elif size >= LONG and density < FEW_STOPS or kind == WEAK:
            labels.append(False)
        else:
            labels.append(None)
    return labels


def second_pass(labels: list[bool | None], sections: list[int | None], articles: list[bool]) -> list[bool]:
    """Labels of all blocks: undecided ones inherit. ``sections``: each block's section, None inside boilerplate elements, whose
    blocks are no one's neighbours; ``articles``: whether that section is an article."""
    own: dict[int, list[int]] = {}
    for k, section in enumerate(sections):
        if labels[k] is not None and section is not None:
            own.setdefault(section, []).append(k)
    content = {sections[k] for k, label in enumerate(labels) if label}
    decided = [k for k, label in enumerate(labels) if label is not None and sections[k] is not None]
    final: list[bool] = []
    for k, label in enumerate(labels):
        if label is not None:
            final.append(label)
        elif sections[k] in own and (sections[k] in content or not articles[k]):
            final.append(_nearest(k, own[sections[k]], labels, True, articles[k]))
        else:
            final.append(articles[k] or not decided or _nearest(k, decided, labels, False))
    return final


def main_text(page: str | None) -> str:
    """Content blocks of a page, joined by line ends; empty for null and for pages without content."""
    found, elements = parse(page or "")
    held = boilerplate(elements)
    sections = [None if held[b.element] >= STRONG else elements[b.element].section for b in found]
    final = second_pass(first_pass(found, elements, held), sections, [elements[b.element].article for b in found])
    return "\n".join(b.text for b, label in zip(found, final, strict=True) if label)


def _nearest(k: int, decided: list[int], labels: list[bool | None], tie: bool, either: bool = False) -> bool:
    """Label of the nearest decided block before or after; with ``either``, content if one of these two is."""
    place = bisect(decided, k)
    near = decided[max(0, place - 1) : place + 1]
    if either:
        return any(labels[n] for n in near)
    least = min(abs(k - n) for n in near)
    said = {labels[n] for n in near if abs(k - n) == least}
    return tie if len(said) == 2 else bool(said.pop())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Main text of every page from its whole source: page_id, url, text, n_chars (code points).

    No shuffle. Null or empty source gives empty text. White space inside a block becomes one blank; blocks are joined by one
    line end in page order. Ids and addresses are passed on as they are, nulls and repeats too; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(page.as_py()) for page in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
