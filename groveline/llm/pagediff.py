"""Main text of web pages by nearest-URL page differencing.

Each page is cut into lines, one for each block. Pages of a host stand in the order of their paths; each is paired with the neighbour
whose path agrees with its own the longest, lines are aligned by longest common subsequence, and lines that the two share are
deleted: what a site puts on every page is shared by neighbours, the article isn't. What no neighbour shows goes by the markup: lines
of menus, headers, footers, sidebars, notices, adverts, forms and reader comments. Lines that are neither shared nor of such a part
stay, inside article and main elements or outside. Where that leaves nothing, the heaviest element that only a layout word in its name sets
apart (a div named side-story) is the article. Of shared lines only paragraphs and headings inside a page's article element stay
(articles are reprinted and cite each other). A page that is a copy says nothing: pages in order that are copies of the page before
form a run, and each page is paired with the nearest page of another run, before or after, that is no copy of it; three runs are
tried on each side. A copy has nine tenths of both pages' unmarked lines and of their bytes in common.

Defined results: null or empty html gives an empty text; a null or odd url is a host of its own kind with its whole text as path; a
page alone on its host has only its markup; pages of one path stand by page_id, url and a hash of html; repeated rows are pages of their own, copies of each other; an empty table gives an empty
result; columns other than page_id, url and html are not read. Pages are handled whole.
"""

from __future__ import annotations

import html as entities
import math
import pickle
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.llm.hashing import tidy

# Element names of HTML, and words by which sites name the parts around an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template iframe svg math canvas object audio video select textarea button title".split())
RAW = frozenset("script style textarea title".split())
AROUND = frozenset("nav footer aside form dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": {"p"}, "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "td", "th", "tr"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"option"}}
NAMED = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar comment comments disqus reply replies share sharing social related recommended newsletter subscribe subscription signup login pagination pager widget toolbar skip legal copyright".split()
)
#: Of these words, those that also stand in names of an article's own element.
LAYOUT = frozenset("side header masthead topbar banner notice overlay modal widget toolbar promo promotion related recommended legal".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

PIECES = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
BLOCK_LEVEL = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Open:
    """An element that is open: whether its text is silent, stands around the article, inside an article or main element, or is prose of an
    article element. box: number of the outermost element that stands around the article by nothing but a layout word in its name, or 0."""

    tag: str
    silent: bool = False
    around: bool = False
    article: bool = False
    element: bool = False
    prose: bool = False
    box: int = 0


@dataclass
class Page:
    lines: list[str] = field(default_factory=list)
    around: list[bool] = field(default_factory=list)
    prose: list[bool] = field(default_factory=list)
    box: list[int] = field(default_factory=list)


#: How an element is set apart from the article: not, by a layout word in its name, or by all else.
NO, PERHAPS, YES = 0, 1, 2


def set_apart(attributes: str) -> int:
    """Whether an element's class, id or role, or its being hidden, sets it apart from the article."""
    out = NO
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return YES
        if name == "role" and value.lower() in ROLES:
            return YES
        if name in ("class", "id"):
            words = {w.lower() for w in BLOCK_LEVEL.split(value)} & NAMED
            if words - LAYOUT:
                return YES
            out = max(out, PERHAPS if words else NO)
    return out


def cut(source: str) -> Page:
    """The lines of a page: the text between the starts and ends of blocks, white space run together, not empty."""
    page, text, stack, boxes = Page(), [], [Open("")], 0

    def end_line() -> None:
        line = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if line:
            page.lines.append(line)
            page.around.append(stack[-1].around)
            page.prose.append(stack[-1].prose)
            page.box.append(stack[-1].box)

    at, size = 0, len(source)
    while at < size:
        m = PIECES.match(source, at)
        if m is None:  # a "<" that opens nothing
            text.append(source[at])
            at += 1
            continue
        at = m.end()
        closing, tag, attributes, plain = m.groups()
        if plain is not None:
            if not stack[-1].silent:
                text.append(plain)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE and not (tag not in VOID and not closing and "=" in attributes and set_apart(attributes)):
            if not closing or not any(o.tag == tag for o in stack[1:]):
                continue
        if closing:
            found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if tag not in INLINE:
                end_line()
            if found:
                if tag in INLINE:
                    end_line()
                del stack[found:]
            continue
        end_line()
        if tag in VOID:
            continue
        while stack[-1].tag in CLOSES.get(tag, {"p"} if tag not in INLINE else ()):
            stack.pop()
        up = stack[-1]
        now = Open(tag, up.silent, up.around, up.article, up.element, up.prose or up.element and tag in PROSE, up.box)
        apart = set_apart(attributes)
        if tag in RAW or tag in SILENT:
            now.silent = True
        if tag in ("article", "main"):
            now.article, now.around = apart < YES, apart == YES or any(o.article and o.around for o in stack)
            now.box = up.box if now.around and apart < YES else 0
            now.element = now.article and (up.element or tag == "article")
        elif tag == "body":
            now.silent = now.around = False
            now.box = 0
        elif tag in AROUND or tag == "header" and not up.article or apart == YES:
            now.around, now.box = True, 0
        elif apart == PERHAPS and not up.around:
            boxes += 1
            now.around, now.box = True, boxes
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = stop.end() if stop else size
            continue
        if not attributes.rstrip().endswith("/"):
            stack.append(now)
    end_line()
    return page


def common_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which of a's lines are on a longest common subsequence with b, by bit vectors over b.

    Lines that only one of them has are left out first. Of the bit vectors, one in some number of lines is kept, and those between are
    made again on the way back, so that memory grows with the lines to the power of 1.5 bits.
    """
    own, other = set(a), set(b)
    places = [i for i, x in enumerate(a) if x in other]
    x, y = [a[i] for i in places], [h for h in b if h in own]
    where: dict[int, int] = {}
    for j, h in enumerate(y):
        where[h] = where.get(h, 0) | 1 << j
    full = (1 << len(y)) - 1

    def after(v: int, h: int) -> int:  # a zero bit at j: y's line j makes the longest common subsequence with the lines of x so far one longer
        u = v & where[h]
        return ((v + u) | (v - u)) & full

    step = max(1, math.isqrt(len(x)))
    marks, v = [], full
    for n, h in enumerate(x):
        if n % step == 0:
            marks.append(v)
        v = after(v, h)
    shared, j = [False] * len(a), len(y)
    for k in range(len(marks) - 1, -1, -1):
        rows = [marks[k]]
        for h in x[k * step : (k + 1) * step]:
            rows.append(after(rows[-1], h))
        i = len(rows) - 1
        while i and j:
            if x[k * step + i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                shared[places[k * step + i]] = True
            elif rows[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
    return shared


@dataclass
class Seen:
    """A page as its neighbours see it; sizes: bytes of its lines."""

    host: str
    path: str
    hashes: list[int]
    around: list[bool]
    sizes: list[int]

    def __post_init__(self) -> None:
        self.lines = len(self.around) - sum(self.around)
        self.weight = sum(n for n, a in zip(self.sizes, self.around, strict=True) if not a)


def compare(page: Seen, other: Seen, copy: float) -> tuple[list[bool], bool]:
    """Which lines the page shares with the other one; whether that one is a copy, or has nothing to say."""
    if page.hashes == other.hashes or not other.lines:
        return [False] * len(page.hashes), True
    shared = common_lines(page.hashes, other.hashes)
    both = [n for n, a, s in zip(page.sizes, page.around, shared, strict=True) if s and not a]
    return shared, len(both) >= copy * max(page.lines, other.lines) and sum(both) >= copy * max(page.weight, other.weight)


def joins(page: Seen, before: Seen, copy: float) -> bool:
    """Whether a page goes on with the run of the page before it."""
    return page.host == before.host and bool(page.lines) == bool(before.lines) and compare(page, before, copy)[1]


def run_starts(pages: list[Seen], copy: float) -> list[int]:
    """Where runs of copies start among pages in order."""
    return [i for i, p in enumerate(pages) if not i or not joins(p, pages[i - 1], copy)]


def edges(pages: list[Seen], copy: float, tries: int) -> tuple[list[Seen], list[Seen]]:
    """Of pages in order: the first page of each of the first runs, and from the end back the last page of each of the last runs."""
    starts = run_starts(pages, copy)
    ends = [i - 1 for i in [*starts[1:], len(pages)]][::-1]
    heads, tails = [pages[i] for i in starts[: tries + 1]], [pages[i] for i in ends[: tries + 1]]
    return [p for p in heads if p.host == pages[0].host], [p for p in tails if p.host == pages[-1].host]


def around_cells(cells: list[tuple[list[Seen], list[Seen]]], copy: float, tries: int) -> list[tuple[list[Seen], list[Seen]]]:
    """From the edges of cells in order, for each cell: the last pages of the runs before it and the first pages of those after it,
    nearest first, as far as a page of its host can need them."""
    left, right = [[] for _ in cells], [[] for _ in cells]
    for d in range(1, len(cells)):
        heads, tails = cells[d - 1]
        far = left[d - 1]
        more = far[joins(heads[0], far[0], copy) :] if far and len(tails) <= tries and heads[0].host == tails[0].host == far[0].host else []
        left[d] = [*tails, *more][: tries + 1]
    for d in range(len(cells) - 2, -1, -1):
        heads, tails = cells[d + 1]
        far = right[d + 1]
        more = far[joins(far[0], tails[0], copy) :] if far and len(heads) <= tries and heads[0].host == tails[0].host == far[0].host else []
        right[d] = [*heads, *more][: tries + 1]
    return list(zip(left, right, strict=True))


def shared_lines(pages: list[Seen], copy: float, tries: int = 3, left: list[Seen] = (), right: list[Seen] = ()) -> list[list[bool]]:
    """For each of the pages in order, which of its lines it shares with its neighbour; left and right: what stands around them."""
    m = len(left)
    every = [*left[::-1], *pages, *right]
    starts = [*range(m), *(m + i for i in run_starts(pages, copy) if i or not m or not joins(pages[0], left[0], copy))]
    starts += [m + len(pages) + i for i, p in enumerate(right) if i or not joins(p, pages[-1], copy)]
    ends = [i - 1 for i in [*starts[1:], len(every)]]
    out, k = [], 0
    for i, p in enumerate(pages, m):
        while i > ends[k]:
            k += 1
        found = []
        for side in (ends[max(0, k - tries) : k][::-1], starts[k + 1 : k + 1 + tries]):
            for j in side:
                if every[j].host != p.host:
                    break
                shared, copied = compare(p, every[j], copy)
                if not copied:
                    found.append((agreement(p.path, every[j].path), shared))
                    break
        out.append(max(found, key=lambda x: x[0])[1] if found else [False] * len(p.hashes))
    return out


def agreement(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def seen(c: dict[str, list], i: int) -> Seen:
    numbers = lambda data, kind: np.frombuffer(data, kind).tolist()
    return Seen(c["host"][i], c["path"][i], numbers(c["hashes"][i], np.int64), [bool(f & 1) for f in c["flags"][i]], numbers(c["sizes"][i], np.int32))


KEY = ["host", "path", "page_id", "url", "mark"]


def place(host: str, path: str, page_id: int | None, url: str | None, mark: int) -> tuple:
    """What pages are ordered by."""
    return host, path, page_id is not None, page_id or 0, url or "", mark


def keyed(pages: DataFrame) -> DataFrame:
    """KEY and html; mark: a hash of html."""
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.when(host == "", url).otherwise(F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1))
    return pages.select(host.alias("host"), path.alias("path"), "page_id", "url", F.xxhash64("html").alias("mark"), "html")


def cuts(rows: DataFrame, cell: int, cell_bytes: int, each: int = 32) -> list[tuple]:
    """Where the order of pages is cut into cells, from a sample of ``each`` places a cell. No result depends on where."""
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    cells = max(-(-n // cell), -(-size // cell_bytes))
    if cells < 2:
        return []
    weight = F.greatest(F.lit(1 / cell), F.coalesce(F.octet_length("html"), F.lit(0)) / cell_bytes)
    some = rows.where(F.rand(7) < min(1.0, each * cells / n)).select(*KEY, weight.alias("weight")).collect()
    some = sorted((place(*r[:5]), r[5]) for r in some)
    total, found, so_far = sum(w for _, w in some), [], 0.0
    for at, w in some:
        if int(so_far / total * cells) < int((so_far + w) / total * cells) < cells:
            found.append(at)
        so_far += w
    return found


def parsed(rows: DataFrame, borders: list[tuple], text: bool = True) -> DataFrame:
    """KEY, the page's cell, and its lines: their hashes, flags, sizes and, if wanted, text."""
    import zlib

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, flags, boxes, lengths, zipped, sizes = [], [], [], [], [], []
            keys = zip(*(batch.column(n).to_pylist() for n in KEY), strict=True)
            cells = pa.array([bisect_right(borders, place(*k)) for k in keys], pa.int32())
            for source in batch.column("html").to_pylist():
                page = cut(source or "")
                raw = [x.encode("utf-8", "replace") for x in page.lines]
                hashes.append(np.array([zlib.crc32(x) << 31 ^ zlib.adler32(x) for x in raw], np.int64).tobytes())
                flags.append(bytes(a + 2 * b for a, b in zip(page.around, page.prose, strict=True)))
                boxes.append(np.array(page.box, np.int32).tobytes())
                lengths.append(np.array([len(x) for x in raw], np.int32).tobytes())
                joined = b"\n".join(raw) if text else b""
                zipped.append(pa.compress(joined, codec="zstd", asbytes=True) if text else None)
                sizes.append(len(joined))
            made = [cells, pa.array(hashes, pa.binary()), pa.array(flags, pa.binary()), pa.array(boxes, pa.binary()), pa.array(lengths, pa.binary()), pa.array(zipped, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in KEY), *made], [*KEY, "cell", "hashes", "flags", "boxes", "sizes", "zip", "size"])

    return rows.mapInArrow(tidy(each), "host string, path string, page_id long, url string, mark long, cell int, hashes binary, flags binary, boxes binary, sizes binary, zip binary, size long")


def in_order(c: dict[str, list]) -> list[int]:
    """The places of rows in the order of their pages."""
    return sorted(range(len(c["path"])), key=lambda i: place(*(c[n][i] for n in KEY)))


def texts(c: dict[str, list], order: list[int], shared: list[list[bool]]) -> list[str]:
    """The main texts of pages, in order. Where nothing but boxes is left, the one with most text of its own is the article."""
    out = []
    for i, found in zip(order, shared, strict=True):
        size = c["size"][i]
        lines = pa.decompress(c["zip"][i], decompressed_size=size, codec="zstd", asbytes=True).decode().split("\n") if size else []
        kept = [not f & 1 and (f & 2 or not s) for s, f in zip(found, c["flags"][i], strict=True)]
        if lines and not any(kept):
            box = np.where(found, 0, np.frombuffer(c["boxes"][i], np.int32))
            weight = np.bincount(box, np.frombuffer(c["sizes"][i], np.int32))
            weight[0] = 0
            kept = (box == weight.argmax()) & (box > 0)
        out.append(" ".join(x for x, k in zip(lines, kept, strict=True) if k))
    return out


def edges_of_cells(lines: DataFrame, copy: float, tries: int) -> dict[int, tuple[list[Seen], list[Seen]]]:
    """What stands around each cell: a few pages a cell, by way of the driver."""

    def each(table: pa.Table) -> pa.Table:
        c = {n: table.column(n).to_pylist() for n in table.column_names}
        both = edges([seen(c, i) for i in in_order(c)], copy, tries)
        return pa.table({"cell": pa.array(c["cell"][:1], pa.int32()), "edges": pa.array([pickle.dumps(both)], pa.binary())})

    found = lines.drop("zip", "size").groupBy("cell").applyInArrow(tidy(each), "cell int, edges binary").collect()
    found = sorted(((r["cell"], pickle.loads(r["edges"])) for r in found), key=lambda x: x[0])
    return dict(zip((cell for cell, _ in found), around_cells([e for _, e in found], copy, tries), strict=True))


def extract(pages: DataFrame, cell: int = 4096, copy: float = 0.9, tries: int = 3, cell_bytes: int = 16 << 20) -> DataFrame:
    """page_id, url, text, n_chars for each page.

    Pages in order of host and path are cut into ranges of about ``cell`` pages or ``cell_bytes`` of html, so that no task holds a
    host; each range knows the runs next to it, so that a page meets the same neighbours wherever the cuts are. Pages with ``copy``
    of their unmarked lines and bytes in common are copies; ``tries`` runs are tried on each side.
    """
    rows = keyed(pages)
    borders = cuts(rows, cell, cell_bytes)
    beside = edges_of_cells(parsed(rows, borders, text=False), copy, tries) if borders else {}

    def each(table: pa.Table) -> pa.Table:
        c = {n: table.column(n).to_pylist() for n in table.column_names}
        order = in_order(c)
        text = texts(c, order, shared_lines([seen(c, i) for i in order], copy, tries, *beside.get(c["cell"][0], ((), ()))))
        return pa.table({"page_id": pa.array([c["page_id"][i] for i in order], pa.int64()), "url": pa.array([c["url"][i] for i in order], pa.string()), "text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())})

    return parsed(rows, borders).groupBy("cell").applyInArrow(tidy(each), "page_id long, url string, text string, n_chars long")
