"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one weighs a block's density of stop words, its length and its link
density, with the container it stands in as a prior, and decides where that is enough; pass two gives ambiguous (short or
sparse) blocks the label of their nearest decided neighbours.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import arrow_map

#: Frequent function words.
STOP_WORDS = frozenset(
    """the of and to a in that is was it for on with as by at be this are from or an not have he his but they which you
    le la les de des du un une et en que qui dans pour pas sur est au avec il elle ne ce se par plus sont
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass
    el los las y que del se por con para una su al lo como más pero sus este ya""".split()
)
#: Tags whose content is never text.
RAW = frozenset("script style noscript template textarea title svg math iframe object select head".split())
#: Elements that hold boilerplate whatever their words.
CHROME = frozenset("nav header footer aside form menu dialog button fieldset figcaption label".split())
BLOCK = frozenset(
    """address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol option p pre section
    summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words that name boilerplate in a class or id: a notice, advert, sidebar, menu or comment section.
CHROME_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising advertorial banner sponsor sponsored sponsors promo promos promotion cookie
    cookies consent gdpr notice popup modal newsletter subscribe subscription sidebar side widget widgets nav navbar navigation menu breadcrumb
    breadcrumbs header masthead footer comment comments respond disqus replies related share sharing social login search pagination
    pager tag tags toolbar""".split()
)
#: Of a name with several parts these count where they come first, too, as in ``cookie-bar``; others only as the last part.
CHROME_FIRST = CHROME_WORDS - frozenset("side widget header tag tags search menu banner".split())
#: A name that begins so says something about a page or post, not that it is boilerplate: ``no-sidebar``, ``has-comments``, ``tag-python``.
ABOUT = frozenset("no not non has with without is hide show tag tags category cat type status format layout single page body".split())
#: The head of a post is its own: ``entry-header``.
OWN_HEADER = frozenset("post entry article story content".split())
#: A section of comments is no wrapper of the article unless it holds the page's first heading.
COMMENT_WORDS = frozenset("comment comments respond disqus replies".split())
#: What may end a tag, or begin a quoted value in which it can't end; the name of a tag.
TAG_STOP = re.compile(r"=\s*([\"'])|>")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
NAME_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[^\W\d_]+")


#: A start tag that ends an open one on top of the stack, though no end tag is written.
ENDS_ALSO = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset("tr td th".split()), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
#: Blocks that may stand inside a paragraph.
IN_PARAGRAPH = frozenset("br button caption legend meta link tbody td tfoot th thead tr".split())
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


def chrome_name(names: str) -> str:
    """"" for classes, ids and roles that name no boilerplate, else "comment" or "other". Names are read as wholes: each part of
    a name, split at hyphens, underscores and capitals, is a word or isn't."""
    found = ""
    for name in names.split():
        parts = [x.lower() for x in _PARTS.split(name) if x]
        if not parts or len(parts) > 1 and parts[0] in ABOUT or parts[-1] == "header" and OWN_HEADER & set(parts):
            continue
        if parts[-1] in CHROME_WORDS or parts[0] in CHROME_FIRST:
            found = "comment" if found == "comment" or COMMENT_WORDS & {parts[0], parts[-1]} else "other"
    return found


RIGHTS = re.compile(r"©|\bcopyright\b|\ball rights reserved\b", re.I)


@dataclass
class Rules:
    """Weights of the evidence. A block is decided where they add up to ``sure`` or more, either way."""

    sure: float = 1.5
    #: A block of so many characters is judged by its density of stop words; under it, words say nothing.
    short: int = 70
    stop_high: float = 0.25
    stop_low: float = 0.08
    dense: float = 2.0
    sparse: float = -2.0
    #: Of a density between the two, in a block of twice ``short`` or more.
    middling: float = 1.5
    #: Of a block that is link text only; others in proportion. Three or more such blocks in a row are a menu.
    linked: float = -3.0
    menu: float = -2.0
    rights: float = -2.4
    #: Priors of containers, all smaller than ``sure``, so that none decides by itself: boilerplate (a form, too, where there is
    #: an article), short blocks of another form, article, and what stands outside the article.
    chrome: float = -1.0
    form: float = -1.25
    article: float = 1.0
    outside: float = -1.0
    #: A container that is only named boilerplate is a wrapper, without a prior, if it holds this share of what is evidently
    #: text in the page, and a heading.
    wrapper: float = 0.5
    #: Under this density of stop words the page is in a language without a list, so that a long block counts as ``unknown``.
    known: float = 0.04
    unknown: float = 1.5


@dataclass
class Block:
    text: str
    linked: int
    #: "fixed" (boilerplate by its element), "chrome" (by a name), "form", "main" or "", by the containers around it, and a number
    #: for the container.
    place: str
    region: int
    heading: bool
    #: 1, 2, ... of a heading, else 0; the innermost container that is named boilerplate (-1: none).
    level: int = 0
    named: int = -1


class Outline:
    """The open block-level elements of a page."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str]] = []  # tag, place
        self.open: Counter[str] = Counter()
        self.fixed = self.region = 0  # open containers that hold boilerplate whatever stands in them; containers seen
        self.named: list[str] = []  # places of the other open containers; the innermost counts
        self.linked_at = -1  # depth at which a link was opened
        self.holders: list[int] = []  # open containers that are named boilerplate, by number
        self.parents: list[int] = []  # of each such container the one around it, or -1
        self.of_comments: list[bool] = []

    @property
    def place(self) -> str:
        return "fixed" if self.fixed else self.named[-1] if self.named else ""

    def push(self, tag: str, place: str) -> None:
        self.stack.append((tag, place))
        self.open[tag] += 1
        self._count(place, 1)

    def pop(self) -> str:
        tag, place = self.stack.pop()
        self.open[tag] -= 1
        self._count(place, -1)
        if len(self.stack) < self.linked_at:
            self.linked_at = -1
        return tag

    def _count(self, place: str, n: int) -> None:
        if not place:
            return
        self.region += 1
        if place == "fixed":
            self.fixed += n
        elif n > 0:
            self.named.append(place)
        else:
            self.named.pop()
            if place == "chrome":
                self.holders.pop()

    def start(self, tag: str, attrs: str) -> None:
        if tag not in IN_PARAGRAPH and self.stack and self.stack[-1][0] == "p":
            self.pop()
        also = ENDS_ALSO.get(tag, ())
        while self.stack and self.stack[-1][0] in also:
            self.pop()
        names = " ".join(filter(None, (x for y in NAME_ATTR.findall(attrs) for x in y))) if "=" in attrs else ""
        place = ""
        if tag in CHROME:
            place = "form" if tag == "form" else "fixed"
        elif tag in ("article", "main") or names == "main":
            place = "main"
        elif names and tag not in ("html", "body") and (kind := chrome_name(names)):
            place = "chrome"
            self.parents.append(self.holders[-1] if self.holders else -1)
            self.of_comments.append(kind == "comment")
            self.holders.append(len(self.parents) - 1)
        self.push(tag, place)

    def end(self, tag: str) -> None:
        if self.open[tag]:
            while self.pop() != tag:
                pass


def blocks_of(page: str) -> tuple[list[Block], Outline]:
    """Blocks in page order, references decoded and white space folded; blocks without text are left out.

    Each character is read a fixed number of times, however a page is broken: a tag that never ends takes the rest of
    the page, as in a browser, and so does a comment, script or style.
    """
    out: list[Block] = []
    outline = Outline()
    parts: list[str] = []
    linked, level, pos, size = 0, 0, 0, len(page)
    unclosed: set[str] = set()
    last_quote = {q: page.rfind(q) for q in "\"'"}
    raw_end: dict[str, re.Pattern] = {}

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, outline.place, outline.region, level > 0, level, outline.holders[-1] if outline.holders else -1))
            parts.clear()
        linked = 0

    def add(chunk: str) -> None:
        nonlocal linked
        parts.append(chunk)
        if outline.linked_at >= 0:
            linked += len("".join(htmllib.unescape(chunk).split()))

    def tag_end(at: int) -> int:
        while m := TAG_STOP.search(page, at):
            if not m[1]:
                return m.start()
            at = page.index(m[1], m.end()) + 1 if m.end() <= last_quote[m[1]] else m.end()
        return -1

    while pos < size:
        at = page.find("<", pos)
        if at < 0:
            add(page[pos:])
            break
        if at > pos:
            add(page[pos:at])
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            pos = stop + 3 if stop >= 0 else size
            continue
        ends = page.startswith("/", at + 1)
        name = TAG_NAME.match(page, at + 1 + ends)
        if not name:
            if ends or page[at + 1 : at + 2] in ("!", "?"):
                stop = page.find(">", at)
                pos = stop + 1 if stop >= 0 else size
            else:
                add("<")
                pos = at + 1
            continue
        stop = tag_end(name.end())
        if stop < 0:
            break
        tag, attrs, pos = name[0].lower(), page[name.end() : stop], stop + 1
        if tag in BLOCK:
            flush()
        if tag in RAW and not ends:
            if not attrs.endswith("/") and tag not in unclosed:
                found = raw_end.setdefault(tag, re.compile(rf"</{re.escape(tag)}\s*>", re.I)).search(page, pos)
                if found:
                    pos = found.end()
                elif tag in ("script", "style"):
                    pos = size
                else:
                    unclosed.add(tag)
        elif tag == "a":
            outline.linked_at = -1 if ends else len(outline.stack)
        elif tag in BLOCK and tag not in VOID and (ends or not attrs.endswith("/")):
            if ends:
                outline.end(tag)
            else:
                outline.start(tag, attrs)
            level = int(tag[1]) if not ends and len(tag) == 2 and tag[0] == "h" and tag != "hr" else 0
    flush()
    return out, outline


def link_share(b: Block) -> float:
    return b.linked / max(1, len("".join(b.text.split())))


def stop_density(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def evidence(blocks: list[Block], rules: Rules) -> list[float]:
    """What words, length and links of each block say: over zero for an article's text, under zero for boilerplate."""
    links, density = [link_share(b) for b in blocks], [stop_density(b.text) for b in blocks]
    judged = [(d, len(b.text)) for b, d, x in zip(blocks, density, links) if len(b.text) >= rules.short and x < 0.5]
    known = sum(d * n for d, n in judged) >= rules.known * sum(n for _, n in judged)
    out, run = [], 0
    for i, (b, d, x) in enumerate(zip(blocks, density, links)):
        score = rules.linked * x
        if RIGHTS.search(b.text) and len(b.text) < 3 * rules.short:
            score += rules.rights
        if len(b.text) >= rules.short:
            middling = rules.middling if len(b.text) >= 2 * rules.short else 0.0
            score += rules.unknown if not known else rules.dense if d >= rules.stop_high else rules.sparse if d < rules.stop_low else middling
        out.append(score)
        run = run + 1 if x > 0.9 else 0
        if run == 3:
            out[-3:] = [s + rules.menu for s in out[-3:]]
        elif run > 3:
            out[-1] += rules.menu
    return out


def unwrapped(blocks: list[Block], outline: Outline, found: list[float], rules: Rules) -> list[str]:
    """The blocks' places, after containers that are boilerplate by name only, but hold the page's text, have lost that name."""
    n = len(outline.parents)
    if not n:
        return [b.place for b in blocks]
    mass, best = [0] * n, [9] * n  # evident text, and the highest heading, in each container
    total, top_level = 0, min((b.level for b in blocks if b.level and b.place != "fixed"), default=9)
    for b, s in zip(blocks, found):
        if s > 0 and b.place != "fixed":
            total += len(b.text)
        if b.named >= 0:
            mass[b.named] += len(b.text) if s > 0 else 0
            best[b.named] = min(best[b.named], b.level or 9)
    for c in range(n - 1, -1, -1):
        if (up := outline.parents[c]) >= 0:
            mass[up] += mass[c]
            best[up] = min(best[up], best[c])
    holds = [m > 0 and m >= rules.wrapper * total and h < 9 and (h == top_level if comments else True) for m, h, comments in zip(mass, best, outline.of_comments)]
    chrome = [False] * n
    for c, up in enumerate(outline.parents):
        chrome[c] = not holds[c] or up >= 0 and chrome[up]
    return ["" if b.place == "chrome" and b.named >= 0 and not chrome[b.named] else b.place for b in blocks]


def decide(blocks: list[Block], outline: Outline, rules: Rules = Rules()) -> list[bool]:
    """Whether each block is main text.

    Pass one adds to a block's evidence the prior of its container; no prior is enough by itself. An article element is
    believed where it holds most of the text that the evidence is for; then what stands outside has a prior, too. Pass two
    gives a block that is not decided the label of its nearest decided neighbour, a heading that of the next one; inside an
    article or boilerplate, neighbours are those of the same container, and without any the prior holds.
    """
    found = evidence(blocks, rules)
    places = unwrapped(blocks, outline, found, rules)
    mass = Counter()
    for b, place, s in zip(blocks, places, found):
        if s > 0 and place in ("main", ""):
            mass[place] += len(b.text)
    believed = "main" in places and mass["main"] >= mass[""] / 2
    priors = {"fixed": rules.chrome, "chrome": rules.chrome, "form": rules.chrome if believed else 0.0, "main": rules.article if believed else 0.0, "": rules.outside if believed else 0.0}
    prior = [priors[p] or (rules.form if p == "form" and len(b.text) < rules.short else 0.0) for b, p in zip(blocks, places)]
    scores = [s + x for s, x in zip(found, prior)]
    labels: list[bool | None] = [s > 0 if abs(s) >= rules.sure else None for s in scores]

    def nearest(order: range, inside: bool) -> list[tuple[int, bool] | None]:
        """Distance and label of the decided block that comes last before each one, of the same container if ``inside``."""
        out: list[tuple[int, bool] | None] = [None] * len(blocks)
        last, at, region = None, 0, -1
        for i in order:
            if inside and blocks[i].region != region:
                last, region = None, blocks[i].region
            if labels[i] is not None:
                last, at = labels[i], i
            elif last is not None:
                out[i] = (abs(i - at), last)
        return out

    ahead, back = range(len(blocks)), range(len(blocks) - 1, -1, -1)
    near = {inside: (nearest(ahead, inside), nearest(back, inside)) for inside in (False, True)}
    out = []
    for i, (b, label) in enumerate(zip(blocks, labels)):
        if label is None:
            before, after = (x[i] for x in near[prior[i] != 0])
            known = [n for n in ((after,) if b.heading and after else (before, after)) if n]
            label = min(known, key=lambda n: (n[0], not n[1]))[1] if known else prior[i] > 0
        out.append(label)
    return out


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """The page's main text: its blocks joined by a space; "" for a page without any, and for null."""
    blocks, outline = blocks_of(page or "")
    return " ".join(b.text for b, good in zip(blocks, decide(blocks, outline, rules)) if good)


def extract_pages(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text, n_chars of every row; null html is an empty page, repeated rows and extra columns don't matter."""

    def run(cols: dict) -> dict:
        texts = [main_text(h, rules) for h in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
