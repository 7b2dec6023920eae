"""HTML main-text extraction (operator 6).

A page is flattened into text blocks. Each block gets its word count and link density and those of its neighbours, and three weaker
marks: how clearly the markup around it names a part that is no article (`hint`, 0 to 2), whether it stands in an article or main element, and whether it says
itself that it is boilerplate (`cue`). A decision tree tells content from the rest; it is trained on the labelled pages below, whose blocks go through the same
functions as any page's.

No text feature can tell an advert's sentence from an article's, so where markup names a part for what it is (a nav, aside, footer or form element, a role, a class
that is nothing but such names) the tree follows it. A name that is only a piece of a class (legal-note, social-history) does not hide link-poor text, and boilerplate that no
markup names goes by its words, links and neighbours.

Cases: null html is empty; a page without content gives the empty string, an empty table no rows. Unclosed tags end with what encloses them; an unclosed script,
style or comment runs to the end of the page. Other elements whose content is no text of the page (svg, button, select, ...) go with it where they are
closed; self-closed or unclosed they are one tag. A link without end tag ends with its block. A quoted value that nothing closes does not count as one, so
the page is read in one pass whatever its quotes. Null url, repeated rows and tied ids pass through, each judged on its own. Very long pages are taken whole. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small

# --- fixed values: names of HTML elements and of page parts ---
RAW = "noscript|template|textarea|select|svg|iframe|title|button"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
HOLDERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form head header html li main menu nav ol p search section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARTS = frozenset("nav aside footer form menu dialog fieldset search head".split())
_NAMES = (
    r"ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promos?|promotion|banner|sidebar|side-bar|comments?|comment-?list|disqus|respond|replies|notices?|cookies?|consent|gdpr|"
    r"alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|header|masthead|topbar|toolbar|share|sharing|social|related|recommended|widget|tags?|copyright|legal|skip"
)
PART_NAME = re.compile(_NAMES, re.I)
#: what a class name may add to a part's name without meaning something else: kinds of boxes after it, places before it
BOXES = frozenset("area bar block body box button buttons col column container content entry form group holder icon icons image inner item items left link links list main panel right row section strip text title top wrap wrapper".split())
PLACES = frozenset("bottom fixed global left main mobile page post primary right secondary site sticky sub top".split())
CUE = re.compile(
    r"©|\(c\) ?\d{4}|\bcopyright (?:\(c\)|\d{4}|by\b)|\ball rights reserved(?= ?(?:[.!|,;·]|\Z))|\b(?:we|site|website|page) uses? cookies\b|\b(?:accept|allow) (?:all )?cookies\b|\bcookie (?:policy|settings|preferences|notice)\b|"
    r"\bprivacy policy\b|\bterms of (?:use|service)\b|\bsubscribe (?:to|now|for)\b|\b(?:our|weekly|daily) newsletter\b|\bsign (?:in|up)(?: |\Z)(?:to|for|now|here|\Z)|\blog ?in to\b|\bshare (?:this|on)\b|\bfollow us\b|\Aadvertisement\b|\bsponsored (?:by|content|post)\b|"
    r"\b(?:related|recommended|popular|recent) (?:articles|posts|stories)\b|\Aread more\b|\bpowered by\b|\bleave a (?:reply|comment)\b|\Afiled under\b|\Aposted in\b",
    re.I,
)
#: what a lower-cased block must hold for CUE to find anything
NEEDLES = (
    "©", "(c)", "copyright ", "all rights reserved", "cookie", "privacy policy", "terms of ", "subscribe ", "newsletter", "sign in", "sign up", "log in to", "login to", "share ", "follow us", "advertisement", "sponsored ",
    " articles", " posts", " stories", "read more", "powered by", "leave a ", "filed under", "posted in",
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_START = re.compile(r"<(?:!--|(?P<raw>script|style)\b|(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)|[!?/])", re.I)
_INSIDE = re.compile(r"""(?:[^<>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+""")  # a value is quoted only after =; possessive: nothing is tried twice
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style")}
_RAW_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<hard>script|style)\b[^>]*>.*?(?:</(?P=hard)\s*>|\Z)|<(?P<end>/?)(?P<tag>" + RAW + r")\b[^>]*>", re.I | re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


def tokens(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, tag, whether an end tag, attributes) of whatever is markup, in page order; comments, scripts and styles have no tag."""
    out, at, last, loose = [], 0, page.rfind(">"), False
    while m := _START.search(page, at):
        start, at, tag, attrs = m.start(), m.end(), "", ""
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
        elif start > last:  # no tag ends any more
            continue
        elif m["raw"]:
            end = _RAW_END[m["raw"].lower()].search(page, page.find(">", at) + 1)
            at = end.end() if end else len(page)
        elif m["tag"]:
            end = page.find(">", at) if loose else _INSIDE.match(page, at).end()
            if page[end : end + 1] != ">":  # another tag begins, or quotes run to the end of the page: then no later tag is read by its quotes
                loose, end = end == len(page), page.find(">", at)
            tag, attrs, at = m["tag"].lower(), page[at:end], end + 1
        else:
            at = page.find(">", at) + 1
        out.append((start, at, tag, bool(m["end"]), attrs))
    return out


def _raw_spans(page: str) -> dict[int, int]:
    """Start -> end of each element of `RAW` that is closed; an end tag closes the nearest open one of its name."""
    spans, open_ = {}, {}
    for m in _RAW_TAG.finditer(page, 0, page.rfind(">") + 1):
        if not m["tag"]:
            continue
        mine = open_.setdefault(m["tag"].lower(), [])
        if not m["end"]:
            if not m[0].endswith("/>"):
                mine.append(m.start())
        elif mine:
            spans[mine.pop()] = m.end()
    return spans


def _closed_links(found: list[tuple[int, int, str, bool, str]]) -> set[int]:
    """Starts of the links whose end tag comes before the next link."""
    closed, opened = set(), None
    for start, _, tag, end, _ in found:
        if tag == "a":
            if end and opened is not None:
                closed.add(opened)
            opened = None if end else start
    return closed


def _named(value: str, whole: bool) -> int:
    """2 if a class or id names such a part and nothing else, 1 if a piece of it does. whole: only names that stand alone count."""
    level = 0
    for token in value.split():
        if PART_NAME.fullmatch(token):
            return 2
        pieces = [x for x in re.split("[_-]+", token) if x]
        named = [bool(PART_NAME.fullmatch(x)) for x in pieces]
        if whole or not any(named):
            continue
        first, last = named.index(True), len(named) - 1 - named[::-1].index(True)
        clear = all(named[first : last + 1]) and all(x.lower() in PLACES for x in pieces[:first]) and all(x.lower() in BOXES for x in pieces[last + 1 :])
        level = max(level, 2 if clear else 1)
        if level == 2:
            return 2
    return level


def _hint(tag: str, attrs: str, in_main: bool) -> int:
    if tag in PARTS or (tag == "header" and not in_main):
        return 2
    if tag in ("html", "body"):
        return 0
    level = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in ROLES):
            return 2
        if name in ("class", "id"):
            level = max(level, _named(value, tag in ("article", "main")))
    return level


def blocks_of(page: str) -> list[tuple[str, int, int, int, bool]]:
    """(text, words, words in links, hint, in main) of each block with text, in page order."""
    out, parts, links = [], [], 0
    open_: list[tuple[str, int, bool]] = []  # holder, hint, in main
    link: tuple[int, bool] | None = None  # holders open where the link began, whether it is closed

    def flush() -> None:
        nonlocal links, link
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            _, hinted, main = open_[-1] if open_ else ("", 0, False)
            n = len(text.split(" "))
            out.append((text, n, min(links, n), hinted, main))
        links = 0
        if link and not link[1]:
            link = None

    def words(text: str) -> None:
        nonlocal links
        if text:
            text = html.unescape(text)
            parts.append(text)
            if link:
                links += len(text.split())

    def close(k: int) -> None:
        """The holders from the k-th on end, and a link that began in them."""
        nonlocal link
        del open_[k:]
        if link and len(open_) < link[0]:
            link = None

    found, raw, at = tokens(page), _raw_spans(page), 0
    closed = _closed_links(found)
    for start, end, tag, ends, attrs in found:
        if start < at:  # inside an element of RAW
            continue
        words(page[at:start])
        at = raw.get(start, end)
        if at > end or not tag:
            continue
        if tag == "br" or tag in ("td", "th"):
            parts.append(" ")
        elif tag == "a":
            link = None if ends else (len(open_), start in closed)
        elif tag in BLOCKS:
            flush()
            if tag in HOLDERS:
                if ends:
                    k = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
                    if k is not None:
                        close(k)
                else:
                    if open_ and open_[-1][0] == "p":
                        close(len(open_) - 1)
                    if tag == "body":  # whatever the head left open
                        close(0)
                    _, hinted, main = open_[-1] if open_ else ("", 0, False)
                    fresh = tag in ("article", "main") and not any(h == 2 and t in ("aside", "article", "section", "li") for t, h, _ in open_)
                    hinted = _hint(tag, attrs, main) if fresh else max(hinted, _hint(tag, attrs, main))
                    open_.append((tag, hinted, main or tag in ("article", "main")))
    words(page[at:])
    flush()
    return out


# --- the labelled pages, made up and labelled by hand: {+n} stands for n words of content, {n} for n other words; a block with words of content is content ---
LABELLED = (
    # a newspaper's article, well marked, with links and readers' comments inside the article
    "<header><div><a>{1}</a></div><ul><li><a>{2}</a><li><a>{1}</a></ul></header><div class=ad>{12}</div><main><h1>{+9}</h1><p>{+3} <a>{+1}</a></p><p>{+64}</p><p>{+82} <a>{+3}</a></p><h2>{+1}</h2><p>{+41}</p>"
    "<div class=share><a>{6}</a></div><ul><li><a>{8}</a><li><a>{7}</a></ul><h3 class=comments>{1}</h3><div class=comments><p>{38}</p><p>{118} <a>{2}</a></p></div></main><aside><h3>{1}</h3><p>{22}</p></aside><footer><p>© {13}</p><a>{5}</a></footer>",
    # a short notice in an article element between menu, advert and footer
    "<nav><li><a>{1}</a><li><a>{1}</a></nav><div class=advert>{9}</div><article><h1>{+2}</h1><p>{+2}</p></article><footer>Copyright 2020 {11}</footer>",
    # a long read: paragraphs of every length, lines about rights, cookies and a newsletter that belong to it
    "<nav><a>{1}</a></nav><div class=cookie-notice>We use cookies {13}</div><main><h1>{+7}</h1><p>{+180}</p><h2>{+3}</h2><p>{+18} all rights reserved.</p><p>{+5} privacy policy {+2}</p><p>{+2} our newsletter</p><p>{+236} <a>{+4}</a></p>"
    "<p>{+9} <a>{+6}</a></p><h2>{+1}</h2><p>{+21} <a>{+12}</a></p><p>{+66} cookie policy {+2}</p></main><footer>© {9}</footer>",
    # a weblog of plain boxes, nothing named; a paragraph about rights among them
    "<div><a>{3}</a></div><div><a>{1}</a></div><div><a>{1}</a></div><div><a>{2}</a></div><div>{+7}</div><div>{+95}</div><div>{+115} <a>{+5}</a></div><div>{+60}</div><div>{+14}</div><div>{+9}</div><div>{+10} <a>{+1}</a></div><div>{+30} all rights reserved, {+30}</div>"
    "<div>{+68} <a>{+2}</a></div><div>Filed under {1} <a>{4}</a></div><div><a>{8}</a></div><div>{2}</div><div><a>{4}</a></div><div><a>{5}</a></div><div><a>{3}</a></div><div>© {8}</div><div>Powered by <a>{1}</a></div>",
    # a page with an unnamed cookie line on top and unnamed lines of rights at the end
    "<div>We use cookies {20} <a>{3}</a></div><div><a>{2}</a></div><div><a>{3}</a></div><div>{+6}</div><div>{+110}</div><div>{+44} <a>{+1}</a></div><div>{+80}</div><div>{+18}</div><div>Subscribe to our newsletter {3}</div><div>Privacy policy {6} <a>{4}</a></div><div>Copyright 2019 {22}</div>",
    # a manual: table of contents, code and short lines in main
    "<header><a>{2}</a></header><main><ul><li><a>{4}</a><li><a>{3}</a><li><a>{5}</a></ul><h1>{+3}</h1><p>{+25} <a>{+3}</a></p><pre>{+6}</pre><p>{+12}</p><pre>{+2}</pre><h2>{+1}</h2><p>{+41} <a>{+9}</a></p><div><a>{5}</a></div></main><footer><a>{4}</a></footer>",
    # article boxes whose classes only contain a part's name
    "<nav><a>{1}</a></nav><article><h1>{+6}</h1><div class=social-history><p>{+45}</p><p>{+78} <a>{+2}</a></p><p>{+10}</p></div><div class=legal-note><h2>{+3}</h2></div><p>{+60}</p><div class=tag-cloud>{1} <a>{4}</a></div><div class=tag-cloud><a>{3}</a></div></article><footer>© {10}</footer>",
    # such boxes outside: text, and lists of links
    "<div class=login-info><a>{2}</a></div><div class=login-info><a>{1}</a></div><div>{+8}</div><div class=social-history>{+70}</div><div class=social-history>{+87} <a>{+3}</a></div><div>{+55}</div><div class=tag-cloud><a>{4}</a></div><div class=tag-cloud><a>{6}</a></div>"
    "<div class=share-text>Share this {1} <a>{2}</a></div><div class=legal-text>Terms of use {11} <a>{2}</a></div>",
    # a sidebar and comments of prose that markup names
    "<nav><a>{3}</a></nav><div><h1>{+5}</h1><p>{+88}</p><p>{+62} <a>{+2}</a></p></div><div class=sidebar><h3>{2}</h3><p>{55}</p><p>{126} <a>{4}</a></p></div><section class=comments><p>{20}</p><p>{1}</p><p>{210}</p></section><footer>© {8}</footer>",
    # a portal: links and teasers between them, no article
    "<div><a>{2}</a></div><div><a>{6}</a></div><div>{2} <a>{9}</a></div><div><a>{7}</a></div><div>{18}</div><div><a>{6}</a></div><div>{21}</div><div><a>{8}</a></div><div>{2} <a>{10}</a></div><div>{4}</div><div><a>{3}</a></div><div>{15}</div><div><a>{5}</a></div><div>Follow us <a>{1}</a></div>",
    # a shop's front: captions and prices between links
    "<div><a>{1}</a></div><div><a>{1}</a></div><div>{3}</div><div><a>{4}</a></div><div>{2}</div><div><a>{5}</a></div><div>{2}</div><div><a>{4}</a></div><div>{26}</div><div><a>{6}</a></div><div>{1}</div><div><a>{2}</a></div>",
    # an article of one paragraph, and one of two, among links that nothing names
    "<div><a>{2}</a></div><div><a>{3}</a></div><div>{+5}</div><div>{+130}</div><div><a>{4}</a></div><div>{12}</div><div><a>{5}</a></div><div>{2}</div><div><a>{4}</a></div>",
    "<div><a>{3}</a></div><div>{1}</div><div><a>{3}</a></div><div>{+4}</div><div>{+48}</div><div>{+33}</div><div><a>{6}</a></div><div>{14}</div><div><a>{6}</a></div><div>{3}</div><div><a>{2}</a></div>",
    # a reference page: title above links to its parts, a short last paragraph before more links
    "<header><a>{1}</a><a>{2}</a></header><main><h1>{+3}</h1><ul><li><a>{4}</a><li><a>{3}</a></ul><h2>{+2}</h2><p>{+42} <a>{+2}</a></p><h2>{+2}</h2><p>{+9}</p></main><aside><a>{2}</a></aside><footer><a>{1}</a> <a>{4}</a></footer>",
    "<nav><a>{2}</a></nav><article><h1>{+1}</h1><ul><li><a>{5}</a></ul><p>{+16} <a>{+1}</a></p><p>{+11} cookie policy</p><p>{+48}</p><p>{+1}</p><div class=related><a>{3}</a></div><div class=related><a>{2}</a></div></article><footer>{6}</footer>",
    # the same without main element
    "<div><a>{3}</a></div><div><h1>{+6}</h1><p>{+52}</p><p>{+16}</p></div><div><a>{5}</a></div><div><a>{7}</a></div><div>{2}</div><div><a>{4}</a></div><div>{1}</div><div><a>{3}</a></div><div>© {7}</div>",
    # a recipe without main element
    "<div><a>{1}</a></div><div><a>{2}</a></div><div><h1>{+4}</h1><p>{+32}</p><h2>{+3}</h2><ul><li>{+5}<li>{+4}</ul><p>{+24}</p><p>{+38}</p></div><div><a>{5}</a></div><div>Posted in <a>{3}</a></div><div>© 2021 {4}</div>",
    # a headline and short paragraphs, then a list of links with a heading of its own
    "<div><a>{1}</a></div><div><a>{2}</a></div><div>{+8}</div><div>{+20}</div><div>{+17}</div><div>{+2}</div><div>{+25}</div><div>{+12}</div><div>{2}</div><div><a>{7}</a></div><div><a>{6}</a></div><div><a>{8}</a></div>",
)


def page_of(sketch: str) -> str:
    """A labelled page's html: words of content are `kept`, others `gone`."""
    return re.sub(r"\{(\+?)(\d+)\}", lambda m: " ".join(["kept" if m[1] else "gone"] * int(m[2])), sketch)


def rows_of(page: list[tuple[int, int, int, int, int]]) -> list[tuple]:
    """Features of a page's blocks: words and link density in hundredths, the same of the block before and of that after, hint, in main, cue."""
    size = [(w, 100 * links // w) for w, links, *_ in page]
    none = (0, 0)
    return [(*x, *(size[i - 1] if i else none), *(size[i + 1] if i + 1 < len(size) else none), *map(int, page[i][2:5])) for i, x in enumerate(size)]


def cue(text: str) -> bool:
    low = text.lower()
    return any(n in low for n in NEEDLES) and bool(CUE.search(text))


def features_of(blocks: list[tuple[str, int, int, int, bool]]) -> list[tuple]:
    return rows_of([(*b[1:], cue(b[0])) for b in blocks])


def labelled(pages: tuple = LABELLED) -> list[tuple]:
    """Features and label of each block of the labelled pages."""
    found = [blocks_of(page_of(p)) for p in pages]
    return [(*f, int("kept" in b[0])) for blocks in found for f, b in zip(features_of(blocks), blocks)]


def grow(rows: list[tuple], depth: int = 8):
    """A decision tree by Gini impurity: a leaf is 0 or 1, a node (feature, cut, at most, above)."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    gini = lambda part: (k := sum(r[-1] for r in part)) * (len(part) - k) / len(part)
    best = None
    for f in (1, 0, 3, 5, 2, 4, 8, 7, 6):  # ties go to the block itself, then to its neighbours, markup last
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            low, high = [r for r in rows if r[f] <= a], [r for r in rows if r[f] > a]
            score = gini(low) + gini(high)
            if best is None or score < best[0] - 1e-12:
                best = (score, f, (a + b) / 2, low, high)
    if best is None:
        return int(2 * ones >= len(rows))
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


def trained():
    return grow(labelled())


def decide(tree, features: tuple) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if features[f] <= cut else high
    return tree


def verdicts(blocks: list[tuple[str, int, int, int, bool]], tree) -> list[int]:
    """1 for each block that is content."""
    return [decide(tree, f) for f in features_of(blocks)]


def main_text(page: str | None, tree) -> str:
    blocks = blocks_of(page) if page else []
    return "\n\n".join(b[0] for b, keep in zip(blocks, verdicts(blocks, tree)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            text = [main_text(h, tree) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
