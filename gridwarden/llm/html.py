"""Main text of web pages: site templates are found by counting element subtrees per host, and removed.

1. Each page's block elements are hashed (tags and text of the whole subtree), those inside its article apart
   from the others. A subtree is a template of its host if it stands in at least ``least_pages`` contexts (the
   text beside it), however large the host, and in more than half as many contexts as there are different
   pages or articles around it: what only copies and near copies of one article share is no template.
2. Each page meets only those templates that it holds itself: its subtrees are joined to the templates by host and
   sign, so no list grows with the host. Template subtrees are deleted. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments that
   their tags, roles or class names tell are deleted as well.

Inside an ``article`` (or else ``main``) element only boxes can be templates, no single paragraph or heading.
Where templates would take all of a page's text, they are kept.

Defined results: null html gives an empty text; a null or odd url counts as host ''; broken markup is read
as browsers do in the main (implied end tags, unknown end tags ignored, a tag cut by the end dropped);
repeated rows count once and give repeated rows; an empty table gives no rows; columns beside url and html pass untouched
if they are kept, whatever their names, but for ``text`` and ``n_chars``, which are made.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from hashlib import blake2b
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridwarden.llm.common import SLICE_ROWS, free_names, per_row, schema_of
from gridwarden.session import cut_lineage, temporary

# an unpaired quote counts as a plain sign, and a tag may end with the text, so every attempt ends where the next begins
_TAG = re.compile(r"""<!--|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""")
_NAMES = re.compile(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)

# Fixed values of the markup language.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",),
}
_WALLS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist")}

# What is never part of the article: tags, roles, words of class names and ids.
_DROP_TAGS = frozenset("head script style textarea title xmp iframe noembed noframes noscript template nav footer aside form button select dialog menu svg object applet canvas audio video".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form".split())
_DROP_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts advertisement advertising promo promotion sponsor sponsored cookie cookies consent gdpr notice notices newsletter subscribe "
    "popup modal share sharing social comment comments respond disqus related pagination pager widget widgets toolbar login skiplink".split()
)
# Words that may stand next to those in a class name of a box inside an article ("share-buttons", not "social-history").
_SHELL_WORDS = frozenset("area articles bar block box button buttons container content form icons inner item items links list outer panel posts section signup unit wrap wrapper".split())
# The same outside an article, where places and pages are named too ("left-sidebar", "main-nav", not "with-sidebar", "ad-hoc").
_PLACE_WORDS = _SHELL_WORDS | frozenset("banner bottom desktop dropdown fixed global header left main mobile page primary right row secondary site slot sticky sub top user".split())
_NAMED_BOXES = frozenset("div section ul ol dl table figure".split())
_HEADER_WORDS = frozenset("header masthead banner topbar".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WHOLE = frozenset("html body article main".split())

#: Elements that go as templates inside an article; a paragraph or heading that recurs there ("Yes.", "History") is text.
_BOXES = frozenset("div section ul ol nav table aside footer header form figure dl".split())
#: Turns a sign into that of the same subtree inside an article: the two are counted apart.
_INSIDE = 0x5BD1E995_27D4EB2F

#: Elements whose subtrees are hashed.
_HASHED = frozenset("div section ul ol li nav p table aside footer header form figure blockquote dl h1 h2 h3 h4 h5 h6".split())


#: Words of a context: few, so that a near copy seldom has a change among them.
_CONTEXT_WORDS = 8
#: Contexts of a subtree.
_CONTEXTS = 3


#: Why an element goes: by its tag or role for certain, or by a name or as a form, unless the article is in it.
_SURE, _LIKELY = 1, 2


class Element(NamedTuple):
    tag: str
    drop: int  # 0, _SURE or _LIKELY
    header: bool
    first: int  # its texts are pieces[first:end]
    end: int
    sign: int  # hash of the subtree, 0 if none


def _sign(tag: str, parts: list[str]) -> int:
    return int.from_bytes(blake2b("\0".join([tag, *parts]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) or 1


def _known(tag: str, name: str, value: str, inside: bool) -> set[str]:
    """Words of a class or id that may tell what an element is: those of names known as a whole.

    Inside an article only class names of boxes count: text there has names of its own.
    Headings and sections elsewhere have ids made of their titles, which count if they are a known word as a whole.
    """
    if inside and (tag not in _NAMED_BOXES or name != "class"):
        return set()
    if name == "id" and (tag in _HEADINGS or tag in ("p", "section")):
        return {value}
    tokens = [set(re.findall(r"[a-z]+", t)) for t in value.split()]
    if inside:
        return {w for t in tokens if t <= _DROP_WORDS | _SHELL_WORDS for w in t & _DROP_WORDS}
    return {w for t in tokens if t <= _DROP_WORDS | _PLACE_WORDS | _HEADER_WORDS for w in t}


def parse(html: str) -> tuple[list[str | None], list[Element]]:
    """Texts in page order, None where a block begins or ends, and the elements closed, inner ones first."""
    pieces: list[str | None] = []
    done: list[Element] = []
    names: list[str] = []  # open tags
    count: Counter[str] = Counter()
    opened: list[tuple[int, bool, int, list[str]]] = []

    def put(text: str) -> None:
        if text and not text.isspace():
            text = unescape(text) if "&" in text else text
            if opened:
                opened[-1][3].append(" ".join(text.split()))
        if text:
            pieces.append(text)

    def close() -> None:
        tag = names.pop()
        count[tag] -= 1
        drop, header, first, parts = opened.pop()
        if tag in _BLOCK:
            pieces.append(None)
        sign = _sign(tag, parts) if parts else 0
        if sign and opened:
            opened[-1][3].append(str(sign))
        done.append(Element(tag, drop, header, first, len(pieces), sign if tag in _HASHED else 0))

    def close_up_to(tags: Sequence[str], walls: Sequence[str]) -> None:
        """Close the innermost open element of the tags, unless a wall lies above it."""
        for i in range(len(names) - 1, -1, -1):
            if names[i] in tags:
                while len(names) > i:
                    close()
                return
            if names[i] in walls:
                return

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            put(html[at:])
            break
        put(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                at = end + 3 if (end := html.find("-->", at)) >= 0 else n
            continue
        if at == n and html[-1] != ">":
            break
        tag = m[2].lower()
        if m[1]:
            if count[tag]:
                close_up_to((tag,), ())
            elif tag == "br":
                pieces.append(" ")
            continue
        if tag in _BLOCK:
            if count["p"]:
                close_up_to(("p",), ("article", "aside", "body", "button", "div", "li", "main", "section", "table", "td", "th", "blockquote"))
            if tag in _CLOSES:
                for _ in _CLOSES[tag]:
                    if not any(count[t] for t in _CLOSES[tag]):
                        break
                    close_up_to(_CLOSES[tag], _WALLS.get(tag, ("table",)))
            pieces.append(None)
        if tag in _VOID:
            if tag in ("br", "wbr"):
                pieces.append(" " if tag == "br" else "")
            continue
        words: set[str] = set()
        roles: set[str] = set()
        if "=" in m[3]:
            for a in _NAMES.finditer(m[3]):
                value = a[2].strip("\"'").lower()
                if a[1].lower() == "role":
                    roles |= set(value.split())
                else:
                    words |= _known(tag, a[1].lower(), value, bool(count["article"] or count["main"]))
        whole = tag in _WHOLE
        sure = (tag in _DROP_TAGS and tag != "form") or bool(roles & (_DROP_ROLES - {"form"}))
        likely = tag == "form" or "form" in roles or bool(words & _DROP_WORDS)
        drop = 0 if whole else _SURE if sure else _LIKELY if likely else 0
        header = not whole and (tag == "header" or bool(words & _HEADER_WORDS))
        names.append("main" if "main" in roles and not whole else tag)
        count[names[-1]] += 1
        opened.append((drop, header, len(pieces), []))
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
            if end is None:
                at = n
            else:
                at = end.start()
    while names:
        close()
    return pieces, done


def _outermost(elements: Iterable[Element]) -> list[Element]:
    """Elements that lie in no other of them, in page order."""
    out: list[Element] = []
    for e in sorted(elements, key=lambda e: (e.first, -e.end)):
        if not out or e.first >= out[-1].end:
            out.append(e)
    return out


def _marked(pieces: list, elements: Iterable[Element], before: bytearray | None = None) -> bytearray:
    """One byte a piece: 1 inside any of the elements (or where ``before`` has it)."""
    out = bytearray(before or bytes(len(pieces)))
    for e in _outermost(elements):
        out[e.first : e.end] = b"\1" * (e.end - e.first)
    return out


def _roots(pieces: list, elements: list[Element], gone: bytearray) -> list[Element]:
    """Outermost articles that hold text which stays, else such main elements."""
    for tag in ("article", "main"):
        found = _outermost(e for e in elements if e.tag == tag)
        found = [e for e in found if any(p and not p.isspace() and not gone[i] for i, p in enumerate(pieces[e.first : e.end], e.first))]
        if found:
            return found
    return []


def _gone(pieces: list, elements: list[Element]) -> bytearray:
    """What tags, roles and names remove.

    A wrapper is not the menu or notice that its name speaks of: an element that goes by its name, or as a form, stays if all
    articles with text are in such elements and one is in this. Without articles a form stays that has most of the text, and if
    nothing is left, names decide nothing.
    """
    sure = _marked(pieces, (e for e in elements if e.drop == _SURE))
    likely = [e for e in elements if e.drop == _LIKELY]
    gone = _marked(pieces, likely, sure)
    if not likely or _roots(pieces, elements, gone):
        return gone
    held = _marked(pieces, _roots(pieces, elements, sure))
    if any(held):
        return _marked(pieces, (e for e in likely if not any(held[e.first : e.end])), sure)
    kept = list(accumulate((0 if not p or g else len(p.strip()) for p, g in zip(pieces, sure, strict=True)), initial=0))
    gone = _marked(pieces, (e for e in likely if e.tag != "form" or 2 * (kept[e.end] - kept[e.first]) <= kept[-1]), sure)
    return gone if any(p and not p.isspace() and not g for p, g in zip(pieces, gone, strict=True)) else sure


def _places(pieces: list, elements: list[Element]) -> tuple[list[Element], bytearray, list[tuple[Element, int]]]:
    """Outermost articles, what tags and names remove, and the elements that may be templates with their signs there.

    Inside an article these are boxes. Elsewhere a heading goes only with the box around it.
    """
    gone = _gone(pieces, elements)
    roots = _roots(pieces, elements, gone)
    held = list(accumulate(_marked(pieces, roots), initial=0))
    out = []
    for e in elements:
        if e.sign and held[e.first] == held[e.end] and e.tag not in _HEADINGS:
            out.append((e, e.sign))
        elif e.sign and e.tag in _BOXES and held[e.end] - held[e.first] == e.end - e.first:
            out.append((e, e.sign ^ _INSIDE))
    return roots, gone, out


def template_candidates(html: str | None) -> list[tuple[int, int, int, int, bool]]:
    """(sign, rank, context, region, open) of a page's block subtrees, distinct.

    The region is the text of the article around the subtree, or else of the page. Its contexts are the beginnings
    of the longest blocks of the region beside the subtree, by rank: equal for copies and for most near copies of an
    article. Several ranks, as one long notice may be the longest block of every page. Subtrees that take the
    whole region are left out. ``open`` tells that the sign decides over text of the page.
    """
    pieces, elements = parse(html or "")
    roots, gone, places = _places(pieces, elements)
    found, firsts = set(), [r.first for r in roots]
    sides: dict[tuple[int, int], tuple] = {}
    kept = list(accumulate((bool(p and not p.isspace() and not g) for p, g in zip(pieces, gone, strict=True)), initial=0))
    for e, sign in places:
        inside = sign != e.sign
        root = roots[bisect_right(firsts, e.first) - 1] if inside else None
        lo, hi = (root.first, root.end) if root else (0, len(pieces))
        if (lo, hi) not in sides:
            sides[lo, hi] = _sides(pieces, gone, lo, hi)
        before, after, region = sides[lo, hi]
        for rank, (_, text) in enumerate(_longest(before[e.first - lo], after[e.end - lo])):
            found.add((sign, rank, _sign("", text.split()[:_CONTEXT_WORDS]), region, (inside or not roots) and kept[e.end] > kept[e.first]))
    return sorted(found)


def _longest(a: tuple, b: tuple) -> tuple:
    return tuple(sorted(a + b, reverse=True)[:_CONTEXTS]) if a and b else a or b


def _sides(pieces: list, gone: bytearray, lo: int, hi: int) -> tuple[list, list, int]:
    """Longest blocks that stay, before and after each piece of the range, as (length, text), and the hash of all its text."""
    at: list[tuple] = [()] * (hi - lo)
    texts, block, start = [], [], lo
    for i in range(lo, hi + 1):
        if i == hi or pieces[i] is None:
            if block and (text := " ".join("".join(block).split())):
                texts.append(text)
                at[start - lo] = ((len(text), text),)
            block = []
        elif not gone[i]:
            start = start if block else i
            block.append(pieces[i])
    before = list(accumulate(at, _longest, initial=()))
    after = list(accumulate(reversed(at), _longest, initial=()))[::-1]
    return before, after, _sign("", texts)


def main_text(html: str | None, templates: frozenset[int] = frozenset()) -> str:
    """The article's blocks in page order, joined by line ends."""
    pieces, elements = parse(html or "")
    roots, gone, places = _places(pieces, elements)
    if roots:
        inside = _marked(pieces, roots)
        gone = bytearray(g | (not i) for g, i in zip(gone, inside, strict=True))
    else:
        gone = _marked(pieces, (e for e in elements if e.header), gone)
    return _blocks(pieces, _marked(pieces, (e for e, sign in places if sign in templates), gone)) or _blocks(pieces, gone)


def _blocks(pieces: list, gone: bytearray) -> str:
    out, block = [], []
    for piece, skip in zip([*pieces, None], [*gone, 0], strict=True):
        if piece is None:
            if block and (text := " ".join("".join(block).split())):
                out.append(text)
            block = []
        elif not skip:
            block.append(piece)
    return "\n".join(out)


# --- on tables -------------------------------------------------------------------------------------

_SIGNS = schema_of("host string, page long, sign long, rank int, context long, region long, open boolean")

#: Parts that the pages of one host and sign are dealt to.
_SALTS = 16


def host_of(url):
    """Host of a url column, '' if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def page_subtrees(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, page, sign, rank, context, region, open): the candidates of each page; equal pages of a host share the hash ``page``."""
    arrow = to_arrow_schema(_SIGNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                keys, rows = [], []
                for host, page, value in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    found = template_candidates(value)
                    keys += [(host, page)] * len(found)
                    rows += found
                columns = [*zip(*keys, strict=True), *zip(*rows, strict=True)] if rows else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return pages.select(host_of(F.col(f"`{url}`")).alias("host"), _page(html).alias("page"), F.col(f"`{html}`").alias("_html")).mapInArrow(run, _SIGNS)


def _page(html: str):
    return F.xxhash64(F.col(f"`{html}`"))


def site_templates(subtrees: DataFrame, least_pages: int = 5) -> DataFrame:
    """(host, sign) of the subtrees that recur on a host in at least ``least_pages`` contexts."""
    kinds = subtrees.select("host", "sign", "rank", "context", "region").distinct()
    kinds = kinds.groupBy("host", "sign", "rank", "context").agg(F.count("*").alias("_regions"))
    counts = kinds.groupBy("host", "sign", "rank").agg(F.count("*").alias("_contexts"), F.sum("_regions").alias("_regions"))
    return counts.filter((F.col("_contexts") >= least_pages) & (F.col("_contexts") * 2 > F.col("_regions"))).select("host", "sign").distinct()


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", keep: Sequence[str] = ("page_id", "url"), **options) -> DataFrame:
    """``keep`` columns, text, n_chars.

    The subtrees are stored first, as they are read twice, and so is what the pages hold of templates: Spark knows
    its size, so it broadcasts it only if it is small. Pairs of host and sign that stand on very many pages are
    spread by a salt, with the templates copied to each.
    """
    with temporary(pages.sparkSession) as keep_stored:
        subtrees = cut_lineage(page_subtrees(pages, url, html), "page-subtrees")
        templates = site_templates(subtrees, **options).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        host_, page_, templates_ = free_names(pages.columns, "_host", "_page", "_templates")
        open_ = subtrees.filter("open").select("host", "page", "sign").distinct().withColumn("_salt", F.pmod(F.col("page"), F.lit(_SALTS)).cast("int"))
        found = open_.join(templates, ["host", "sign", "_salt"], "left_semi").groupBy(F.col("host").alias(host_), F.col("page").alias(page_))
        found = keep_stored(found.agg(F.sort_array(F.collect_list("sign")).alias(templates_)), "page-templates")
    rows = pages.withColumns({host_: host_of(F.col(f"`{url}`")), page_: _page(html)}).join(found, [host_, page_], "left")

    def setup():
        def one(value, templates):
            text = main_text(value, frozenset(templates or ()))
            return text, len(text)

        return lambda htmls, templates: list(zip(*map(one, htmls, templates), strict=True)) or [[], []]

    return per_row(rows, setup, "text string, n_chars long", [html, templates_], keep)
