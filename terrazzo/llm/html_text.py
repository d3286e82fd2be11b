"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides each block alone: many link
characters or a copyright line make it boilerplate; length and the density of stop words make it
text; short or middling blocks stay open, but on a page without a sure block the middling ones are
text. Length alone decides blocks of a script without stop words here, and those without stop words
on a page of another language (its words together, and its long blocks each, are below the density).
In the second pass an open block takes the label of its nearest decided neighbours; the page's edges
are none. Only a short block in a bare container nearer to the page's start than to the first decided
block, whose element is another, is left out like a menu.

Element names, roles, and words of classes and ids are signals beside these. A name that only
contains such a word lowers its blocks by a step, so that their neighbours decide. One that says
what an element is (nav, footer, a form, "comments", "sidebar-left", but not "no-sidebar") makes it a
suspect region: it goes, unless it holds the article element or the main heading and nothing outside
of all suspect regions does, or nothing outside is sure and most of the text is inside of it. A suspect region inside of one that
stays is judged likewise. An article or main element raises its blocks by a step, and where most of
the sure text is in such elements only their blocks count; open blocks there are text where nothing
speaks against it.

Cases: a null or empty page, and one without text, gives an empty text; unclosed and stray tags,
quotes and comments end where a browser ends them, or with the page; a very long page is read whole,
in time that grows with its length; an open block as near to a text as to boilerplate takes the
label before it; pages that repeat and equal blocks are each kept; rows are independent; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed: element names by role.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "math", "canvas", "textarea", "title")
SKIPPED = frozenset((*RAW, "head", "audio", "video", "map"))
SUSPECT = frozenset(("nav", "footer", "aside", "button", "select", "option", "menu", "dialog"))  # never the text unless the article is inside
MAIN = frozenset(("article", "main"))
INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "meter", "nobr", "output", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br", "link", "meta", "input", "area", "source", "track", "embed", "param", "base", "col", "center",
))
CONTAINERS = frozenset(("div", "section", "table", "tbody", "tr", "td", "th"))
VOID = frozenset(("br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "param", "source", "track", "wbr"))
# Fixed: words of class and id attributes, and roles, that mark what is not the article.
NOISE = frozenset((
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended",
    "recommendations", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "comment", "comments", "commentlist",
    "disqus", "respond", "replies", "widget", "toolbar", "skip", "hidden", "outbrain", "taboola", "disclaimer",
))
# Fixed: words that may follow what an element is, and words that deny it.
GENERIC = frozenset((
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "form", "group", "holder", "icons", "inner", "item", "items", "label", "left", "link", "links", "list",
    "message", "module", "outer", "page", "panel", "posts", "region", "right", "row", "section", "slot", "text", "thread", "title", "top", "unit", "wrap", "wrapper",
))
DENIALS = frozenset(("no", "non", "not", "has", "with", "without", "hide", "is"))
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"))
# Fixed: frequent function words of some languages.
STOPWORDS = frozenset("""
the of and to in a is that for it was on are as with be this by an from or at which not have has had but they you we his her their were been will would can its if there what when who all so no up out about into than them then
der die das und ist nicht ein eine einer einem einen zu mit von den dem des im für auf sich auch als an es so wie bei aus nach oder werden wird sind war hat zum zur über noch nur vor durch man
le la les de des du un une et est en que qui dans pour pas par sur avec ce il au se ne plus on son sa ses aux ou mais nous vous leur elle ils été cette être comme
el los las del y es por con para se lo una su al como más pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos no
il di che è non per si con da sono una alla della nel dei gli più anche ma o do da em não os as dos na uma no para com ao het een van zijn op te dat met voor niet aan er
""".split())

LINKS, MANY_LINKS, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.33, 0.66, 70, 200, 0.10, 0.20
LOWER = {"good": "near", "near": "short"}  # a step down

_TOKEN = re.compile(
    r"<!--(?:.*?(?:--!?>|\Z))|<(?P<raw>%s)\b(?>[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>(?:.*?(?:</(?P=raw)\s*+[^>]*>|\Z))|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/](?:[^>]*)(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)" % "|".join(RAW),
    re.S | re.I,
)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WIDE = re.compile("[\u1100-\u115f\u2e80-\ua4cf\uac00-\ud7a3\uf900-\ufaff\ufe30-\ufe6f\uff00-\uff60\U00020000-\U0003fffd]")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_FOREIGN = re.compile(r"[^\W\d_\x00-\u024f\u1e00-\u1eff]")  # letters that are not Latin
_WORD = re.compile(r"[^\W_]+")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
STRONG, WEAK = 2, 1


def name_hint(value: str, in_main: bool) -> int:
    """What the names of a class or id attribute say against its element."""
    hint = 0
    for name in value.split():
        pieces = [p.lower() for p in _PIECE.findall(name)]
        noise = [p in NOISE or (p == "header" and not in_main) for p in pieces]
        if any(noise) and DENIALS.isdisjoint(pieces[: noise.index(True)]):
            last = len(pieces) - 1
            while not noise[last] and pieces[last] in GENERIC:
                last -= 1
            hint = max(hint, STRONG if noise[last] else WEAK)
    return hint


def _hint(tag: str, attrs: str, in_main: bool) -> int:
    """What an element's own tag says against its text."""
    hint = STRONG if tag == "form" or (tag == "header" and not in_main) else 0
    if not attrs or tag in ("html", "body"):
        return hint
    for name, a, b, c in _NAMED.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            hint = max(hint, name_hint(value, in_main))
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in ROLES) or (name == "style" and _UNSEEN.search(value)):
            hint = STRONG
    return hint


class Region:
    """A suspect element: its parent region, and whether it holds an article element or a main heading."""

    __slots__ = ("parent", "hard", "main", "title", "kept")

    def __init__(self, parent: Region | None, hard: bool):
        self.parent, self.hard, self.main, self.title, self.kept = parent, hard, False, False, False


class Block:
    __slots__ = ("text", "links", "main", "tag", "region", "weak", "label", "words", "stops")

    def __init__(self, text: str, links: int, main: bool, tag: str, region: Region | None, weak: bool):
        self.text, self.links, self.main, self.tag, self.region, self.weak, self.label = text, links, main, tag, region, weak, ""
        self.words = self.stops = 0


def blocks(page: str) -> tuple[list[Block], list[Region]]:
    """All blocks with text outside elements that are skipped, in page order, and the suspect regions, outer ones first."""
    out: list[Block] = []
    regions: list[Region] = []
    pieces: list[str] = []
    linked = 0
    stack: list[tuple[str, int, Region | None]] = []  # open elements with 1 skipped, 2 main, 4 link, 8 weak, and the region outside of each
    open_: dict[str, int] = {}
    skipped = mains = anchors = weaks = breaks = 0
    region: Region | None = None

    def close():
        nonlocal linked, breaks
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, linked, mains > 0, next((t for t, _, _ in reversed(stack) if t not in INLINE), ""), region, weaks > 0))
            pieces.clear()
        linked = breaks = 0

    def pop():
        nonlocal skipped, mains, anchors, weaks, region
        name, kind, region = stack.pop()
        open_[name] -= 1
        skipped -= kind & 1
        mains -= kind >> 1 & 1
        anchors -= kind >> 2 & 1
        weaks -= kind >> 3

    def text(a: int, b: int):
        nonlocal linked, breaks
        if b > a and not skipped:
            t = page[a:b]
            pieces.append(t)
            if not t.isspace():
                breaks = 0
                if anchors:
                    linked += len("".join(t.split()))

    at = 0
    for m in _TOKEN.finditer(page):
        text(at, m.start())
        at = m.end()
        tag, end, attrs = m["tag"], m["end"], m["attrs"]
        if tag is None:
            if m["raw"]:
                continue
            loose = _LOOSE.match(m[0])
            if not loose:
                continue
            end, tag, attrs = loose.groups()
        tag = tag.lower()
        inline = tag in INLINE
        if tag == "br":
            breaks += 1
            if breaks > 1:
                close()
            elif not skipped:
                pieces.append(" ")
            continue
        if not inline:
            close()
        if end:
            if open_.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if not inline and stack and stack[-1][0] == "p":
            pop()
        if tag in VOID:
            continue
        hint = _hint(tag, attrs, mains > 0)
        suspect = tag in SUSPECT or hint == STRONG
        kind = (1 if tag in SKIPPED else 0) | (2 if tag in MAIN and not suspect else 0) | (4 if tag == "a" else 0) | (8 if hint == WEAK else 0)
        if attrs.endswith("/") and tag not in MAIN and tag not in SKIPPED and not suspect:
            continue
        if suspect and inline:
            close()
        stack.append((tag, kind, region))
        open_[tag] = open_.get(tag, 0) + 1
        skipped += kind & 1
        mains += kind >> 1 & 1
        anchors += kind >> 2 & 1
        weaks += kind >> 3
        if suspect:
            region = Region(region, tag in SUSPECT)
            regions.append(region)
        outer = region
        while outer and (tag in MAIN or tag == "h1") and not suspect:
            outer.main, outer.title = outer.main or tag in MAIN, outer.title or tag == "h1"
            outer = outer.parent
    text(at, len(page))
    close()
    return out, regions


def columns(text: str) -> int:
    """Length with wide characters (Chinese, Japanese, Korean) as two."""
    return len(text) if text.isascii() else len(text) + len(_WIDE.findall(text))


def foreign(text: str) -> bool:
    """Whether most letters are of scripts without stop words here."""
    return not text.isascii() and 2 * len(_FOREIGN.findall(text)) > sum(map(str.isalpha, text))


def by_length(n: int) -> str:
    """The label of a block of few links where stop words cannot speak."""
    return "good" if n > LONG else "near"


def decide(block: Block) -> str:
    """First pass: good, bad, near (probably text), short, or bare (long, of few links, without stop words)."""
    n = len(block.text)
    words = [w.lower() for w in _WORD.findall(block.text)] if n >= SHORT or block.links else []
    stops = sum(w in STOPWORDS for w in words)
    density = stops / max(1, len(words))
    if block.links > (LINKS if density < MANY_STOPS or not block.main else MANY_LINKS) * n:
        return "bad"
    if not block.main and (block.text.startswith("©") or (n < LONG and "©" in block.text)):
        return "bad"
    if not block.main:
        n = columns(block.text)
    if n < SHORT:
        return "short" if block.main or not block.links else "bad"
    if not block.main and density < FEW_STOPS and foreign(block.text):
        return by_length(n)
    block.words, block.stops = len(words), stops
    if density >= MANY_STOPS:
        return "good" if n > LONG or block.main else "near"
    if density >= FEW_STOPS:
        return "near"
    return "near" if block.main else "bare"


def outside(block: Block) -> bool:
    """Whether no suspect region that goes holds the block; a region stays only if those around it do."""
    return not block.region or block.region.kept


def judge(found: list[Block], regions: list[Region]) -> None:
    """Marks the suspect regions that stay, outer ones first."""
    sure: dict[Region, int] = {}  # characters of sure text in each region
    own: dict[Region | None, list[Block]] = {}
    inner: dict[Region | None, list[Region]] = {}
    for b in found:
        own.setdefault(b.region, []).append(b)
        r = b.region if b.label == "good" else None
        while r:
            sure[r] = sure.get(r, 0) + len(b.text)
            r = r.parent
    for r in regions:
        if sure.get(r):
            inner.setdefault(r.parent, []).append(r)
    held = rest = 0
    main = title = False
    chosen, open_ = None, []
    while True:
        open_ += inner.get(chosen, [])
        for b in own.get(chosen, ()):  # what the last region adds to the text outside of suspect ones
            held, rest = held + len(b.text) * (b.label == "good"), rest + len(b.text) * (b.label in ("near", "short"))
            main, title = main or b.main, title or b.tag == "h1"
        article = [r for r in open_ if (r.main and not main) or (r.title and not title and not main and sure[r] > held)]
        most = [r for r in open_ if not (held or main or r.hard) and sure[r] > 2 * rest]
        chosen = max(article or most, key=sure.get, default=None)
        if not chosen:
            return
        chosen.kept = True
        open_.remove(chosen)


def settle(labels: list[str], edge: str | None, lenient: bool, tags: list[str]) -> list[bool]:
    """Second pass: whether each block is text, from the labels of the first pass.

    edge is the label beyond both ends, if any; lenient: open blocks between unlike neighbours are text.
    """
    end = (edge, None) if edge else None
    after, nearest = [], end
    for i in range(len(labels) - 1, -1, -1):
        after.append(nearest)
        if labels[i] in ("good", "bad"):
            nearest = (labels[i], i)
    after.reverse()
    before, keep = end, []
    for i, label in enumerate(labels):
        then = after[i]
        if label in ("good", "bad"):
            before = (label, i)
        elif before and then:
            if before[0] == then[0]:
                label = before[0]
            elif label == "near" or lenient:
                label = "good"
            else:
                label = before[0] if i - before[1] <= then[1] - i else then[0]
        elif then and label == "short" and tags[i] in CONTAINERS and tags[i] != tags[then[1]] and i < then[1] - i:
            label = "bad"
        elif before or then:
            label = (before or then)[0]
        keep.append(label == "good")
    return keep


def extract(page: str) -> str:
    """The article's blocks, joined by an empty line."""
    found, regions = blocks(page)
    for b in found:
        b.label = decide(b)
    words, stops = sum(b.words for b in found), sum(b.stops for b in found)
    covered = stops and (stops >= FEW_STOPS * words or any(b.label == "good" and b.stops for b in found))
    for b in found:
        if b.label == "bare":
            b.label = "bad" if covered else by_length(columns(b.text))
        if b.weak:
            b.label = LOWER.get(b.label, b.label)
    for some in ([b for b in found if not b.region], found):  # middling blocks are text where no block is sure
        if not any(b.label == "good" for b in found):
            for b in some:
                b.label = "good" if b.label == "near" else b.label
    judge(found, regions)
    sure = lambda some: sum(len(b.text) for b in some if b.label == "good")
    inside = [b for b in found if b.main and outside(b)]
    others = [b for b in found if not b.main and outside(b)]
    if inside and 2 * sure(inside) >= sure(others):
        found = inside
    else:
        for b in found:
            b.label, b.main = b.label if outside(b) else "bad", False
    article = bool(found) and found[0].main
    keep = settle([b.label for b in found], "good" if article else None, article, [b.tag for b in found])
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def extract_pages(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` with text and n_chars."""

    def run(batches):
        for batch in batches:
            texts = [extract(x).encode("utf-8", "replace").decode("utf-8") if x else "" for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    types = dict(pages.dtypes)
    return pages.select(*keep, page).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "text string, n_chars bigint"]))


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
