"""Main text of web pages by line-block distribution.

Markup is stripped in one linear pass: block elements end a line, inline ones do not, white space
collapses, character references are decoded. Lines of menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments (by element, role or class name) weigh nothing.
Class names count by word (``comment-list``, ``cookie-bar``), but not where another word says that the
block only has such a part (``with-sidebar``); an ``article`` or ``main`` goes by whole names alone. Characters of the other lines
outside links are summed over sliding windows; where a window rises over the threshold the text
surges, where windows fall below it it dives, and the lines between are kept in page order. Lines of
an ``article`` or ``main`` element weigh as much as a window needs, so that its short paragraphs
stay; text blocks around it are chosen by their windows. Where these blocks hold more text than the
element, it is no main text (a teaser): its lines weigh their length, like all others.

A null or empty page, or one without main text, gives an empty text. Pages are independent rows:
repeated rows give repeated results, and other columns are not read. Pages stay in their partitions
(no shuffle), one Arrow batch at a time.
"""

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from jobflow.llm.registry import query

#: lines per window, and characters a window needs where nothing marks the article
WINDOW, SURGE = 3, 80

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:"[^"]*+"|'[^']*+'|[^>"'])*+)(?:>|\Z)"""
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)", re.S)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_RAW = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I) for n in (
    "script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "xmp")}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
              " span strike strong sub sup time tt u var wbr".split())
_SPACE = {"br", "td", "th", "wbr"}
_NESTS = set("nav header footer aside form dialog menu article main div section ul ol dl table select button fieldset"
             " figure svg math object audio video canvas head blockquote details".split())
_DROPPED = set("nav footer aside form dialog menu select button fieldset svg math object audio video canvas head".split())
_ARTICLE = {"article", "main"}
_BOILER = set("ad ads adv advert advertisement banner sponsor sponsored promo cookie cookies consent gdpr notice notices alert"
              " nav navbar navigation menu breadcrumb breadcrumbs sidebar aside complementary widget footer contentinfo"
              " comment comments disqus respond responses replies reply share sharing social related recommended newsletter"
              " subscribe signup login popup modal overlay dialog search pagination pager toolbar skip copyright".split())
#: words that only place a boilerplate word in the name of an article (site-nav, left-sidebar)
_PLACES = set("site page global main top bottom left right primary secondary".split())
#: words by which a name tells what a block has or is about, not what it is (with-sidebar, tag-social)
_HAVING = set("with has no without layout wrap wrapper tag category open closed".split())
_HEADER = {"header", "masthead", "topbar"}


def _names(marks: str, known: set, whole: bool = False) -> bool:
    """Whether a name of ``marks`` has a word of ``known`` (comment-list, cookie-bar) and none that says
    what the block merely has. ``whole``: only a name made up of such words and of places counts."""
    for name in marks.lower().split():
        words = set(re.findall("[a-z]+", name))
        if words & known and (words <= known | _PLACES if whole else not words & _HAVING):
            return True
    return False


def page_lines(html: str) -> list[tuple[str, int, bool]]:
    """(line, its characters outside links, whether inside article or main), without boilerplate."""
    lines, parts = [], []
    stack, counts, dropped, article, link, linked = [], {}, 0, 0, False, 0

    def flush():
        nonlocal link, linked
        if parts:
            line = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if line:
                lines.append((line, max(0, len(line) - linked), article > 0))
        link, linked = False, 0  # a link left open ends with its block

    at, size = 0, len(html)
    while at < size:
        tag = _TAG.search(html, at)
        stop = tag.start() if tag else size
        if stop > at and not dropped:
            parts.append(html[at:stop])
            linked += link and stop - at
        if not tag:
            break
        at = tag.end()
        name = (tag["name"] or tag["name2"] or "").lower()
        if not name:
            continue
        ends = bool(tag["end"] or tag["end2"])
        if name in _RAW:
            if not ends:
                close = _RAW[name].search(html, at)
                at = close.start() if close else size
            continue
        if name in _SPACE:
            parts.append(" ")
            continue
        if name in _INLINE:
            if name == "a":
                link = not ends
            continue
        flush()
        if name not in _NESTS:
            continue
        if not ends:
            rest = tag["rest"] or tag["rest2"] or ""
            marks = " ".join("".join(m) for m in _MARKS.findall(rest))
            drop = name in _DROPPED or _names(marks, _BOILER, name in _ARTICLE) or bool(_HIDDEN.search(rest)) or (
                not article and (name == "header" or _names(marks, _HEADER)))
            stack.append((name, drop))
            counts[name] = counts.get(name, 0) + 1
            dropped += drop
            article += name in _ARTICLE
        elif counts.get(name):
            while True:  # closes what was left open inside
                top, drop = stack.pop()
                counts[top] -= 1
                dropped -= drop
                article -= top in _ARTICLE
                if top == name:
                    break
    flush()
    return lines


def surge_and_dive(weights: list[int], threshold: int, window: int = WINDOW) -> list[int]:
    """Places in the blocks that begin where a window of weights surges and end where it dives."""
    n = len(weights)
    sums, total = [0] * (n + 1), 0
    for k, weight in enumerate(weights):
        total += weight
        sums[k + 1] = total
    kept, inside = [], False
    for k in range(n):
        ahead = sums[min(n, k + window)] - sums[k]
        around = sums[min(n, k + window)] - sums[max(0, k - window + 1)]
        if inside:
            inside = around >= threshold
        else:
            inside = ahead >= threshold
        if inside:
            kept.append(k)
    return kept


def main_text(html: str) -> str:
    lines = page_lines(html)
    kept, first = [], 0
    while first < len(lines):  # no window reaches across an edge of the article
        last, inside = first, lines[first][2]
        while last < len(lines) and lines[last][2] == inside:
            last += 1
        weights = [SURGE if inside else line[1] for line in lines[first:last]]
        kept += [first + k for k in surge_and_dive(weights, SURGE)]
        first = last
    around = sum(len(lines[k][0]) for k in kept if not lines[k][2])
    if around > sum(len(line[0]) for line in lines if line[2]):
        kept = surge_and_dive([line[1] for line in lines], SURGE)
    return "\n".join(lines[k][0] for k in kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    names = ["page_id", "url", "text", "n_chars"]

    def parse(batches):
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names)

    return pages.select("page_id", "url", "html").mapInArrow(parse, "page_id long, url string, text string, n_chars long")


@query("op4_html_text")
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
