"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from math import log1p
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPENS = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_IN_TAG = re.compile(r"""[>"']""")
#: One attribute: a name after white space, a slash or the value before it, and its value, if any. Read one after another, so no name is found within a value.
_ATTR = re.compile(r"""[\s/]*+(=?[^\s/>=]++|=)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: Elements of running text; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never hold an article's text.
DROPPED = frozenset("script style noscript template head title nav footer aside button select option textarea input svg canvas iframe object menu dialog noembed noframes".split())
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert alertdialog dialog".split())
#: Words of a class or id that tell of what stands around an article.
_AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social breadcrumb breadcrumbs sidebar nav navbar navigation menu toolbar masthead footer pager pagination "
    "comment comments commentlist reply replies responses disqus discussion respond related recommended recommendations teaser widget copyright disclaimer".split()
)
#: Of these, words that also name parts of an article: a discussion, a notice, a response.
_UNSURE = frozenset("notice notices notification alert banner consent disclaimer discussion menu promotion respond response responses social subscription".split())
#: Of these, words that tell of ads and page furniture even on a paragraph; the others may tell what it says.
_PLAIN = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo cookie cookies gdpr popup modal overlay newsletter subscribe signup login share sharing breadcrumb breadcrumbs "
    "sidebar nav navbar navigation toolbar masthead footer pager pagination disqus teaser widget copyright".split()
)
#: Words that add nothing to a name: a comments-area or a site-sidebar is named as comments or a sidebar is.
_NEUTRAL = frozenset("area bar block box button buttons container element group icon icons item items link links list main panel post posts primary secondary section site slot top bottom left right thread unit user users reader readers wrap wrapper".split())
#: Elements that are text themselves.
_TEXTS = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt figcaption caption".split())
#: What is left of a path's ratio in an element whose name tells that it stands around an article, or may tell so.
NAMED, MAYBE_NAMED = 0.01, 0.3
_CLOSES_P = frozenset("p div article section header footer nav aside ul ol dl table pre blockquote h1 h2 h3 h4 h5 h6 hr form main figure fieldset address details menu".split())
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")


class Token(NamedTuple):
    """A tag and the text before it; the last has no tag."""

    text: str
    closing: bool = False
    tag: str = ""
    attrs: str = ""


def tokens(page: str) -> Iterator[Token]:
    """Tags in order, without comments and declarations. A tag ends at the first > outside of quotes or, where a quote is never closed, at the first >.

    Each quote that turns out to lead nowhere is remembered, so that the whole page is read a fixed number of times, however broken it is.
    """
    last, lost = page.rfind(">"), set()
    start = at = 0
    while m := _OPENS.search(page, at):
        if m[2] is None:
            end = page.find("-->", m.end()) + 3 if m[0] == "<!--" else page.find(">", m.end()) + 1
            yield Token(page[start : m.start()])
            start = at = end if end > 2 or m[0] != "<!--" and end else len(page)
            continue
        if m.end() > last:
            at = m.end()
            continue
        here, met = m.end(), []
        while True:
            q = _IN_TAG.search(page, here)
            if not q or q[0] == ">":
                end = q.start() if q else -1
                break
            met.append(q.start())
            here = -1 if q.start() in lost else page.find(q[0], q.end()) + 1
            if here <= 0:
                end = -1
                break
        if end < 0:
            lost.update(met)
            end = page.find(">", m.end())
        yield Token(page[start : m.start()], bool(m[1]), m[2].lower(), page[m.end() : end])
        start = at = end + 1
        if not m[1] and m[2].lower() in RAW:
            close = re.compile(rf"</{re.escape(m[2])}\b[^>]*>?", re.I).search(page, at)
            start = at = close.end() if close else len(page)
    yield Token(page[start:])


class Path:
    """A path of block elements from the root: its parent path, its own name, and what its blocks add up to."""

    __slots__ = ("best", "children", "depth", "inside", "name", "own", "parent", "plain", "under")

    def __init__(self, parent: Path | None, tag: str, name: str) -> None:
        self.parent, self.name = parent, name
        self.depth = parent.depth + 1 if parent else 0
        self.inside = bool(parent) and (parent.inside or tag in ("article", "main"))  # of an article or main element
        self.plain = not parent or parent.plain and tag in ("html", "body")  # nothing but the page itself
        self.children: dict[str, Path] = {}
        self.own: dict[int, list[int]] = {}  # by outer, as in Block
        self.under = [0, 0, 0, 0]
        self.best: float | None = None


class Block(NamedTuple):
    """A run of text between two block boundaries. outer: how many elements of its path stand outside the outermost whose name tells that it stands around
    an article, all if none does; penalty: what such names leave of its ratio."""

    path: Path
    text: str
    linked: int
    outer: int
    penalty: float = 1.0


class Named:
    """An element that by its name stands around an article, or a main or article element itself: what it holds. Elements know the one around them, and the next that isn't inline."""

    __slots__ = ("around", "block", "chars", "counts", "depth", "holds", "inline", "longest", "outer", "penalised", "penalty", "sure", "within")

    def __init__(self, around: Named | None, block: Named | None, penalty: float, depth: int, inline: bool, sure: bool) -> None:
        self.sure = sure  # its name, and not just its being a form, tells that it stands around an article
        self.around, self.block, self.penalty, self.depth, self.inline = around, block, penalty, depth, inline
        self.penalised = penalty < 1 or bool(around) and around.penalised
        self.chars = 0
        self.holds = self.longest = False


class Open:
    """An open element. What is true of all within it is passed on to them, so that nothing has to look through the stack."""

    __slots__ = ("article", "dropped", "link", "named", "named_block", "named_inline", "path", "tag")


def attributes(attrs: str) -> dict[str, str]:
    """Values by lower-case name; of a repeated name, the first counts, as in browsers."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(attrs):
        out.setdefault(name.lower(), next((v for v in values if v), ""))
    return out


def _is_around(tag: str, named: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "article", "main") or not named:
        return False
    return "hidden" in named or named.get("role", "").strip().lower() in _ROLES or bool(_NOT_SHOWN.search(named.get("style", "")))


def name_penalty(tag: str, named: dict[str, str]) -> float:
    """What the element's name leaves of its paths' ratios: less than 1 if a whole token of its class or its id consists of words of _AROUND, neutral words and numbers aside."""
    if tag == "form":
        return NAMED
    if not named or tag in ("html", "body", "article", "main"):
        return 1.0
    least = 1.0
    if named.get("role", "").strip().lower() == "form":
        return NAMED
    for token in f"{named.get('class', '')} {named.get('id', '')}".lower().split():
        parts = {x for x in re.split(r"[\W\d_]+", token) if x}
        words = parts - _NEUTRAL
        if words and words <= _AROUND and not (tag in _TEXTS and words.isdisjoint(_PLAIN)):
            least = min(least, MAYBE_NAMED if words <= _UNSURE else NAMED)
    return least


def _implied(tag: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The open elements that a start tag closes, and those beyond which it doesn't look for them."""
    closes = ("p",) if tag in _CLOSES_P else {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
    return closes, {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(tag, ("td", "th", "button", "table"))


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, without elements that never hold an article's text, each with the path of block elements from the root to it.

    A name doesn't count if its element holds main, a heading of the first level, the longest article or all of the page's text, nor, where it only may stand around an article or is a form's and no article or
    main stands outside of such elements, if it holds over half of it. Unclosed and misnested elements are closed where their parents end.
    """
    root = Path(None, "", "")
    base = Open()
    base.tag, base.path, base.dropped, base.link, base.article = "", root, False, False, False
    base.named = base.named_block = base.named_inline = None
    stack: list[Open] = [base]
    opened: dict[str, int] = defaultdict(int)
    out: list[Block] = []
    within: list[Named | None] = []  # per block, the innermost named element around it
    plain: dict[int, list[tuple[Named, int]]] = {}  # per block, named inline elements and their letters in it
    everyone: list[Named] = []
    words: list[str] = []
    inserted: list[tuple[Named, int]] = []
    articles: list[Named] = []
    outside: list[Named] = []  # main and article elements that no named one is around
    linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        top = stack[-1]
        if raw and not top.dropped:
            words.append(raw)
            if top.link:
                linked += len(raw)
            if top.named_inline:
                inserted.append((top.named_inline, len(raw)))

    def flush() -> None:
        nonlocal linked
        if words:
            if joined := " ".join(entities.unescape("".join(words)).split()):
                top = stack[-1]
                if top.named_block:
                    top.named_block.chars += len(joined)
                if inserted:
                    plain[len(out)] = inserted.copy()
                    for entry, n in inserted:
                        entry.chars += n
                out.append(Block(top.path, joined, linked, top.path.depth))
                within.append(top.named_block)
            words.clear()
        inserted.clear()
        linked = 0

    def close(upto: int) -> None:
        for e in stack[upto:]:
            opened[e.tag] -= 1
        del stack[upto:]

    for token in tokens(page):
        text(token.text)
        tag = token.tag
        if not tag:
            continue
        if token.closing:
            if opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        if tag not in INLINE:
                            flush()
                        close(i)
                        break
                    if tag in INLINE and stack[i].tag not in INLINE:
                        break  # it was closed with its block
            continue
        if tag in RAW:
            if tag not in INLINE:
                flush()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag not in INLINE:
            flush()
            closes, barrier = _implied(tag)
            if any(opened[x] for x in closes):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closes:
                        close(i)
                        break
                    if stack[i].tag in barrier:
                        break
        if tag in VOID:
            continue
        top, e = stack[-1], Open()
        named = attributes(token.attrs) if token.attrs else {}
        around = _is_around(tag, named, top.article)
        left = 1.0 if around else name_penalty(tag, named)
        inline = tag in INLINE
        e.tag, e.dropped, e.link, e.article = tag, top.dropped or around, top.link or tag == "a" and "href" in named, top.article or tag in ("article", "main")
        e.path, e.named, e.named_block, e.named_inline = top.path, top.named, top.named_block, top.named_inline
        if not inline:
            name = tag if tag in ("html", "body") else ".".join([tag, *(named[k] for k in named if k in ("class", "id"))])
            e.path = top.path.children.get(name) or top.path.children.setdefault(name, Path(top.path, tag, name))
        if left < 1 or tag in ("article", "main"):
            sure = left <= NAMED and tag != "form" and named.get("role", "").strip().lower() != "form"
            entry = Named(top.named, top.named_block, left, top.path.depth, inline, sure)
            everyone.append(entry)
            e.named = entry
            if inline:
                e.named_inline = top.named_inline or entry
            else:
                e.named_block = entry
        stack.append(e)
        opened[tag] += 1
        if tag in ("article", "main", "h1") and not e.dropped:
            if tag == "article":
                articles.append(e.named)
            elif e.named:
                e.named.holds = True
            if tag != "h1" and not (top.named and top.named.penalised):
                outside.append(e.named)
    flush()

    for x in reversed(everyone):  # what an element holds, those around it hold as well
        if x.around:
            x.around.holds |= x.holds
        if x.block and not x.inline:
            x.block.chars += x.chars
    total = sum(len(b.text) for b in out)
    longest = max(articles, key=lambda x: x.chars, default=None)
    while longest:
        longest.longest, longest = True, longest.around
    most = total if any(x.chars for x in outside) else total / 2
    for x in everyone:
        x.counts = x.penalty < 1 and not (x.holds or x.longest or (x.chars >= total if x.sure else x.chars > most))
        x.within, x.outer = (x.block.within, x.block.outer) if x.block else (1.0, None)
        if x.counts and not x.inline:
            x.within = min(x.within, x.penalty)
            x.outer = x.depth if x.outer is None else x.outer
    for i, (b, x) in enumerate(zip(out, within, strict=True)):
        penalty, outer = (x.within, x.outer) if x else (1.0, None)
        for y, n in plain.get(i, ()):
            if y.counts:
                penalty *= 1 - (1 - y.penalty) * min(1.0, n / len(b.text))
        if penalty < 1:
            out[i] = b._replace(outer=b.outer if outer is None else outer, penalty=penalty)
    return out


def _ratio(sums: list[int]) -> float:
    chars, marks, linked, n = sums
    return (chars / n) * (1 + log1p(marks / n)) * max(0.0, 1 - linked / max(1, chars)) ** 2


def content(page: str, share: float = 0.12) -> str:
    """Blocks of the paths that hold the article, joined by line feeds.

    Per path from the root to a block, text length and punctuation are summed, and both ratios to the number of blocks are
    fused, less for linked text. A path's ratio is smoothed with the highest among the elements around it, over all blocks below them, so
    headings and short paragraphs go with the text around them; elements that hold the whole page tell nothing and don't count. Where article or main elements hold a third of the text, what is outside
    them counts a tenth. In elements that by class or id stand around an article, and in forms, a path's ratio counts NAMED or MAYBE_NAMED times, and isn't in the ratios of what is around
    them. Paths under share of the highest ratio are left out, as are elements that by their tag, role or state never hold an article's text.
    Sums go up the tree of paths once, so a page takes time in proportion to its length, however deep it is nested.
    """
    found = blocks(page)
    paths: list[Path] = []
    seen: set[Path] = set()
    for b in found:
        row = (len(b.text), len(_PUNCTUATION.findall(b.text)), min(b.linked, len(b.text)), 1)
        own = b.path.own.setdefault(b.outer, [0, 0, 0, 0])
        for i, x in enumerate(row):
            own[i] += x
        p = b.path
        while p and p not in seen:
            seen.add(p)
            paths.append(p)
            p = p.parent
    paths.sort(key=lambda p: p.depth)
    above: dict[Path, dict[int, list[int]]] = {}  # what a path's blocks add to the elements around it, by where that ends
    for p in reversed(paths):
        got = above.pop(p, {})
        for outer, s in got.items():
            if outer < p.depth:
                for i, x in enumerate(s):
                    p.under[i] += x
        if p.parent:
            up = above.setdefault(p.parent, {})
            for source in (got, {(-1 if outer == p.depth else outer): s for outer, s in p.own.items()}):
                for outer, s in source.items():
                    if outer < p.parent.depth:
                        have = up.setdefault(outer, [0, 0, 0, 0])
                        for i, x in enumerate(s):
                            have[i] += x
    kept = [b for b in found if b.penalty == 1]
    marked = 3 * sum(len(b.text) for b in kept if b.path.inside) >= max(1, sum(len(b.text) for b in kept))
    around: dict[Path, tuple[float | None, float | None]] = {}  # of the elements around a path: the highest ratio, and that of the innermost if none may count
    for p in paths:
        best, nearest = around[p.parent] if p.parent else (None, None)
        around[p] = (best, nearest)
        if p.parent is None:
            continue
        if not p.plain and p.under[3]:
            mine = _ratio(p.under)
            if p.inside or p.under[3] < len(kept):
                around[p] = (mine if best is None else max(best, mine), mine)
            else:
                around[p] = (best, mine)
    score: dict[tuple[Path, int], float] = {}
    for p in paths:
        best, nearest = around[p.parent] if p.parent else (None, None)
        for outer, s in p.own.items():
            own = _ratio(s)
            near = own if best is None and nearest is None else nearest if best is None else best
            score[p, outer] = (own + 2 * near) / 3 * (1 if p.inside or not marked else 0.1)
    scores = [score[b.path, b.outer] * b.penalty for b in found]
    least = share * max(scores, default=0.0)
    taken = [x >= least and x > 0 for x in scores]
    fill(found, taken, paths)
    return "\n".join(b.text for b, x in zip(found, taken, strict=True) if x)


def fill(found: list[Block], taken: list[bool], paths: list[Path]) -> None:
    """Takes what the element that directly holds most of the taken text has besides: lists, tables and boxes between taken blocks, and before and after them unless they are mostly links.

    Blocks that a name keeps out stay out, and where nothing but the page itself holds the text, only what is between counts.
    """
    chars: dict[Path, int] = defaultdict(int)
    for b, x in zip(found, taken, strict=True):
        if x and b.path.parent:
            chars[b.path.parent] += len(b.text)
    if not chars:
        return
    home = max(chars, key=lambda p: (chars[p], -p.depth))
    inside: set[Path] = set()
    for p in paths:  # parents come first
        if p is home or p.parent in inside:
            inside.add(p)
    at = [i for i, (b, x) in enumerate(zip(found, taken, strict=True)) if x and b.path in inside]
    for i, b in enumerate(found):
        if not taken[i] and b.penalty == 1 and b.path in inside:
            taken[i] = at[0] < i < at[-1] or not home.plain and 2 * b.linked < len(b.text)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """text and n_chars of every row's whole html, with its id and url.

    Null, empty or textless html gives an empty text; repeated rows each get a row; an empty table gives an empty one; other columns
    aren't read.
    """
    kept = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [content(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    types = [kept.schema[c].dataType.simpleString() for c in ("id", "url")]
    return kept.mapInArrow(extracted, f"id {types[0]}, url {types[1]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
