"""HTML extraction (operator 5): line-block distribution.

Markup is stripped into lines, one for each block element. Regions that are no article text (menus, forms, adverts,
reader comments, ...) become empty lines. A line weighs its characters outside links, or nothing if it is mostly links.
Where a page marks an article that has text, that is evidence: lines inside weigh SURGE more, lines outside
SURGE less; where it marks none, a top heading weighs SURGE more.
Weights are summed over sliding windows of WINDOW lines, on every page alike: a stretch runs from the surge, where the
sum reaches SURGE, to the dive, where it falls to nothing, without the weightless lines at its ends; its text is kept.

Null and empty html give "". Unclosed and stray tags are tolerated: an open region ends at an article's border. Blocks
are never dropped for their length inside a kept stretch. Pages may be of any length; work is in proportion to it. A
window that just reaches SURGE is a surge. Repeated rows give repeated results, an empty table gives an empty one, and
extra columns may have any name: only key, url and html are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines in a window, and the sum of weights that makes a surge.
WINDOW, SURGE = 3, 86

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|title|select|object|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[^a-z0-9]+")

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REGIONS = frozenset("nav header footer aside form button dialog menu fieldset".split())
#: Words of a class, id or role that mark a region as no article text.
MARKS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Elements that hold a page or its article, whatever their class says.
WHOLE = frozenset("html body article main p h1 h2 h3 h4 h5 h6 b i em strong span a".split())


def _marked(name: str, attrs: str) -> bool:
    if name in WHOLE and name not in ("article", "p", "span"):
        return False
    for m in NAMED.finditer(attrs):
        words = WORD.split((m[1] or m[2] or m[3] or "").lower())
        if not MARKS.isdisjoint(words if name not in ("article", "p", "span") else words[:1]):
            return True
    return False


#: (text, characters outside links, inside an article, in a top heading)
Line = tuple[str, int, bool, bool]


def lines(page: str) -> list[Line]:
    """The lines of a page; stripped regions are empty ones."""
    out: list[Line] = []
    parts: list[str] = []
    linked, in_link, in_title, depth = 0, False, False, 0
    skip, nested = "", 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        out.append((text, 0 if 2 * linked > len(text) else len(text), depth > 0, in_title))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not skip:
            text = html.unescape(raw)
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    last = 0
    for m in TOKEN.finditer(page):
        add(page[last : m.start()])
        last = m.end()
        name = m[3]
        if not name:
            continue
        name, closing, attrs = name.lower(), bool(m[2]), m[4]
        if skip:
            if name in ("article", "main") and skip not in ("article", "main"):
                close()
                skip = ""
            elif name == skip:
                nested += -1 if closing else not attrs.endswith("/") and name not in VOID
                if nested <= 0:
                    skip = ""
                continue
            else:
                continue
        if name in BLOCKS:
            close()
        elif name in ("br", "td", "th", "option"):
            parts.append(" ")
        if name == "a":
            in_link = not closing
        elif name == "h1":
            in_title = not closing
        if name in ("article", "main") and closing:
            depth = max(0, depth - 1)
        elif not closing and name not in VOID:
            region = name in REGIONS and not (name == "header" and depth)
            if region or _marked(name, attrs):
                skip, nested = name, 1
                close()
            elif name in ("article", "main"):
                depth += 1
    add(page[last:])
    close()
    return out


def weights(rows: list[Line]) -> list[int]:
    """What each line counts: its characters outside links, and what the page marks as its article for or against it."""
    marked = any(text and inside for text, _, inside, _ in rows)

    def one(text: str, n: int, inside: bool, title: bool) -> int:
        if not text:
            return 0
        if marked and not inside:
            return max(0, n - SURGE)
        return n + SURGE if inside or title else n

    return [one(*row) for row in rows]


def kept(rows: list[Line]) -> list[str]:
    """Lines between surges and dives."""
    sizes = weights(rows)
    sums = [sum(sizes[i : i + WINDOW]) for i in range(len(sizes))]
    out, i, n = [], 0, len(sums)
    while i < n:
        if sums[i] < SURGE:
            i += 1
            continue
        j = i
        while j < n and sums[j] > 0:
            j += 1
        heavy = [k for k in range(i, j) if sizes[k]]
        out += [t for t, *_ in rows[heavy[0] : heavy[-1] + 1] if t]
        i = j
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(kept(lines(page))) if page else ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """key, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [key, url, "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url, content).mapInArrow(run, f"{key} {kind}, {url} string, text string, n_chars long")
