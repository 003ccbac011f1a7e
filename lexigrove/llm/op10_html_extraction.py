"""HTML extraction with nearest-URL page differencing.

Each page becomes its blocks of text (lines) in page order, each with what its markup says
of it: *article* (in prose elements of ``article`` or ``main``), *boxed* (within them, but in
a ``div`` or ``section`` with a class or id of its own), *frame* (navigation, headers,
footers, asides, forms, notices, adverts, comments, by element, role, class or id) or *open*
(neither). All pages of a host are ranked by path, query and page_id; each is paired with
the nearest pages before and after it, all their lines are aligned by longest common
subsequence, and lines that a neighbour shares are deleted. A page whose lines all equal
those of another is its copy and says nothing about templates, so neighbours are sought
beyond copies.

Markup then vetoes what differencing alone gets wrong, as pages quote each other, and an
advert that no neighbour shows is one all the same: frame lines go though no neighbour shares
them; article lines stay though one does; a box stays unless a neighbour shares all its
lines and it holds less than half of the article's text; open lines beside an article go.
So in a page with an article, differencing decides its boxes; in one without, it
decides all open lines. ``n_shared`` tells how many of a page's ``n_lines`` lines a neighbour shares.

The ranks are cut into ranges of ``RANGE`` pages, more beyond ``RANGES`` of them, so no task
holds a host; the pages next to a range are sent to it as well, wherever they stand. Only the
keys at the ends of ranges reach the driver. Pages are parsed twice, once for the order and
once for the lines, which costs less than to keep the lines.

Defined cases: null and empty html give the empty text; a null url is a host of its own;
repeated rows are copies of each other, each with its text; equal paths are ordered by query
and page_id; very long and unclosed markup is read in linear time, and a tag that never ends
takes the rest of the page with it; lines of any number are aligned exactly, by bit vectors,
in halves where the vectors would pass ``BITS``; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import html as _html
import re
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Pages in a range of ranks, at least, and ranges, at most.
RANGE, RANGES = 128, 8192
#: Kinds of lines; a boxed line has BOXED plus the number of its box.
ARTICLE, FRAME, OPEN, BOXED = 0, 1, 2, 3
#: Bits of the vectors kept for an alignment at once.
BITS = 1 << 29

# Fixed values of the HTML and MathML standards.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg object select annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr "
    "math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom msub msup msubsup munder mover munderover mtable mtr mtd".split()
)
FRAMES = frozenset("nav footer aside form dialog menu head button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOXES = frozenset("div section".split())
GROUPS = frozenset("div section ul ol dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What whole class names and ids say of an element: parts of a page, with or without a place and a kind of box.
PARTS = (
    "ads? adverts? advertisements? advertising banner sponsor sponsored promo promotion cookies? consent gdpr notices? newsletter subscribe signup popup modal overlay paywall nav navbar navigation menu breadcrumbs? "
    "sidebar footer header masthead topbar toolbar share sharing social related recommended recommendations comments? disqus disqus_thread replies respond login search pagination pager skip"
).replace(" ", "|")
PLACES, SHAPES = "site|page|main|top|bottom|left|right|global|primary|secondary|mobile", "area|bar|box|banner|block|buttons?|container|content|form|inner|left|link|links|list|menu|nav|notice|panel|posts|articles|right|section|slot|unit|widget|wrap|wrapper"
NAMES = re.compile(rf"(?:(?:{PLACES})[-_]?)?(?:{PARTS})(?:[-_](?:{PARTS}|{SHAPES}|\d+))*")
#: The same within an article, where words of prose serve as names: only what is no article by any reading.
INNER = re.compile(r"(?:ads?|adverts?|advertisements?|sponsored|cookie|newsletter|breadcrumbs?|comments?|disqus|pagination|sidebar)(?:[-_](?:area|bar|box|banner|block|container|form|list|notice|section|slot|thread|unit|wrap|wrapper|\d+))*")
#: Names within an article that prose does not have: such a box goes if it holds less than half of the page's article.
SURE = re.compile(
    rf"(?:(?:{PLACES})[-_]?)?(?:notices?|promos?|promotion|popup|newsletter|subscribe|signup|share|sharing|social|consent|gdpr|paywall|modal|overlay|banner)(?:[-_](?:{PARTS}|{SHAPES}|\d+))*|(?:users?|posts?|readers?)[-_]comments?|respond"
)
#: Article elements that are no page's article.
ASIDES = re.compile(r"(?:comment|reply|teaser|related|card|promo|ad|sponsored)s?(?:[-_].*)?")
#: Elements that end an open one of their own name; any block ends a paragraph.
CLOSES_OWN = frozenset("li dt dd tr td th option".split())
#: A comment, a section, a declaration, a tag, text; what does not end there ends with the page. No form is tried twice.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\s++|/|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+)?+|=)*+)>|[^<]++|<(?![a-zA-Z]|/[a-zA-Z])",
    re.S,
)
#: Where no tag ends as it should: one that ends at the next angle, or with the page.
LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<", re.S)
ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: The lines travel packed: four bytes for each kind, and the texts under zstandard.
LINES = "page_id long, url string, kinds binary, lines binary, host string, path string, query string, seq long, digest long, span long, own boolean"
KEY = ("host", "path", "query", "seq", "address", "digest")
KEYS = "host string, path string, query string, seq long, address string, digest long"
#: The first and last key of a range, and the ones nearest to them that are no copies of them.
EDGES = f"span long, role string, {KEYS}"
TEXTS = "page_id long, url string, text string, n_chars long, n_lines long, n_shared long"


def _kind_of(name: str, attrs: str, inside_article: bool) -> int | None:
    """What an element says of its content; None if nothing."""
    if name in FRAMES or name == "header" and not inside_article:
        return FRAME
    named = False
    if attrs and name not in ("html", "body"):
        for key, a, b, c in ATTR.findall(attrs):
            key, value = key.lower(), (a or b or c).lower()
            if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                return FRAME
            if key == "style" and re.search(r"display\s*:\s*none", value):
                return FRAME
            if key in ("class", "id"):
                named = named or bool(value)
                says = ASIDES if name == "article" else INNER if inside_article else NAMES
                if name != "main" and name not in HEADINGS and any(says.fullmatch(x) for x in value.split()):
                    return FRAME
            if key == "role" and value in ("main", "article"):
                return ARTICLE
    if name in ("article", "main"):
        return ARTICLE
    return BOXED if inside_article and named and name in BOXES else None


def _suspect(name: str, attrs: str) -> int:
    """What the class or id of an element within an article says: 2 that it is none of it, 1 that it may be a list of links or a form, 0 nothing."""
    if not attrs or name not in GROUPS:
        return 0
    values = [x for key, a, b, c in ATTR.findall(attrs) if key.lower() in ("class", "id") for x in (a or b or c).lower().split()]
    return 2 if any(SURE.fullmatch(x) for x in values) else 1 if any(NAMES.fullmatch(x) for x in values) else 0


def _shut(page: str, at: int, name: str) -> int | None:
    """The place after the end of an element whose tag ends at a place, those of its name within it counted; None if it never ends."""
    nests, depth = name in ("object", "svg", "template"), 1
    for m in re.compile(rf"<(/?){name}\b[^>]*+(?:>|\Z)", re.I).finditer(page, at):
        depth += -1 if m[1] else 1 if nests and not m[0].endswith("/>") else 0
        if not depth:
            return m.end()
    return None


def _tokens(page: str):
    """(tag end mark, tag name, attributes, text) in order, in linear time, without what stands in elements that hold no text."""
    at, n, pattern, endless = 0, len(page), TOKEN, set()
    while at < n:
        m = pattern.match(page, at)
        if m is None:
            pattern = LOOSE
            continue
        at = m.end()
        if m[2] and not m[1] and (name := m[2].lower()) in RAW:
            if (not m[3].endswith("/") or name in ("script", "style", "textarea", "title")) and name not in endless:
                shut = _shut(page, at, name)
                if shut is None and name in ("script", "style"):
                    return  # the rest is code
                if shut is None:
                    endless.add(name)  # an element that never ends takes nothing but its tag
                else:
                    at = shut
            continue
        yield m[1], m[2], m[3], m[0]


def blocks_of(page: str | None) -> tuple[list[int], list[str]]:
    """Kinds and texts of a page's lines, in order."""
    page = page or ""
    kinds, lines, parts = [], [], []
    stack: list[tuple[str, int, int]] = []
    opened: dict[str, int] = {}
    kind, boxes = OPEN, 0
    # boxes within articles to judge by what they hold: first line, end, characters of links, controls, and what their names say
    suspects: list[list[int]] = []
    links = controls = 0
    in_link = False

    def end():
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                kinds.append(kind)
                lines.append(text)
            parts.clear()

    def close(k):
        for name, _, s in stack[k:]:
            opened[name] -= 1
            if s >= 0:
                suspects[s][1:4] = [len(lines), links - suspects[s][2], controls - suspects[s][3]]
        del stack[k:]
        return stack[-1][1] if stack else OPEN

    for shut, name, attrs, whole in _tokens(page):
        if name is None:
            if whole[0] != "<" or len(whole) < 3:
                parts.append(whole)
                links += len(whole) if in_link else 0
            elif whole.startswith("<![CDATA["):
                parts.append(_html.escape(whole[9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if name == "a":
            in_link = not shut
        elif name in ("input", "button", "form") and not shut:
            controls += 1
        if shut:
            if name in INLINE or name in VOID:
                if name == "br":
                    parts.append(" ")
                continue
            end()
            if opened.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                kind = close(k)
            continue
        if name in INLINE:
            continue
        if name in VOID:
            if name == "br":
                parts.append(" ")
            elif name == "hr":
                end()
            continue
        end()
        if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in CLOSES_OWN):
            kind = close(len(stack) - 1)
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and not (attrs and ATTR.search(attrs)):
            continue  # bare blocks nest nothing that matters, and are often not closed
        if attrs.rstrip().endswith("/"):
            continue
        inside, suspect = kind == ARTICLE or kind >= BOXED, -1
        own = _kind_of(name, attrs, inside)
        if inside and own != FRAME and (says := _suspect(name, attrs)):
            suspect = len(suspects)
            suspects.append([len(lines), -1, links, controls, says])
        if kind != FRAME and own is not None and not (own == ARTICLE and kind >= BOXED):
            if own == BOXED:
                own, boxes = BOXED + boxes, boxes + 1
            kind = own
        stack.append((name, kind, suspect))
        opened[name] = opened.get(name, 0) + 1
    end()
    close(0)
    sizes = [len(t) for t in lines]
    whole = sum(n for n, k in zip(sizes, kinds, strict=True) if k != FRAME)
    for first, last, linked, held, says in suspects:
        size = sum(sizes[first:last])
        if says == 2 and 2 * size < whole or 2 * linked >= size and linked or held and 2 * size < whole:
            kinds[first:last] = [FRAME] * (last - first)
    return kinds, lines


def _vectors(a: list, b: list):
    """Bit vectors of the alignment of ever longer heads of ``a`` with ``b`` (Hyyrö, 2004): bit j is 0 where b[j] lengthens it."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks.setdefault(x, []).append(j)
    bits = {}
    for x in set(a) & masks.keys():
        held = bytearray(len(b) // 8 + 1)
        for j in masks[x]:
            held[j >> 3] |= 1 << (j & 7)
        bits[x] = int.from_bytes(held, "little")
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        if x in bits:
            u = v & bits[x]
            v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list, b: list) -> list[int]:
    """Length of the longest common subsequence of ``a`` and each head of ``b``."""
    from itertools import accumulate

    last = (1 << len(b)) - 1
    for last in _vectors(a, b):
        pass
    return list(accumulate((bit == "0" for bit in reversed(f"{last:0{len(b)}b}")), initial=0)) if b else [0]


def common(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    found, todo = set(), [(a, b, 0)]
    while todo:
        x, y, base = todo.pop()
        low, high = 0, 0
        while low < min(len(x), len(y)) and x[low] == y[low]:
            low += 1
        while high < min(len(x), len(y)) - low and x[-1 - high] == y[-1 - high]:
            high += 1
        found.update(range(base, base + low), range(base + len(x) - high, base + len(x)))
        x, y, base = x[low : len(x) - high], y[low : len(y) - high], base + low
        if len(x) > 1 and len(x) * len(y) > BITS:
            # Hirschberg's halves: the head and the tail of y that go best with the halves of x
            half = len(x) // 2
            head, tail = _lengths(x[:half], y), _lengths(x[half:][::-1], y[::-1])
            cut = max(range(len(y) + 1), key=lambda j: head[j] + tail[len(y) - j])
            todo += [(x[:half], y[:cut], base), (x[half:], y[cut:], base + half)]
            continue
        rows = list(_vectors(x, y))
        i, j = len(x), len(y)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                    found.add(base + i)
    return found


def shared_lines(lines: list[str], neighbours: list[list[str]]) -> list[set[int]]:
    """For each neighbour, the places of lines that it shares."""
    return [common(lines, other) for other in neighbours]


def main_text(kinds: list[int], lines: list[str], shared: list[set[int]]) -> str:
    """A page's text, after deleting what its neighbours share, unless markup vetoes it."""
    gone = set().union(*shared)
    inside = [i for i, k in enumerate(kinds) if k == ARTICLE or k >= BOXED]
    if not inside:
        return " ".join(t for i, t in enumerate(lines) if kinds[i] == OPEN and i not in gone)
    boxes: dict[int, list[int]] = {}
    for i in inside:
        boxes.setdefault(kinds[i], []).append(i)
    size = sum(len(lines[i]) for i in inside)
    out = {k for k, held in boxes.items() if k >= BOXED and any(s.issuperset(held) for s in shared) and 2 * sum(len(lines[i]) for i in held) < size}
    return " ".join(lines[i] for i in inside if kinds[i] not in out)


def _packed(b):
    """Kinds and lines of each page of a batch as bytes, and its key."""
    import xxhash

    # no line holds a line feed, for white space within blocks is one space
    blocks = [(array("I", k).tobytes(), "\n".join(t).encode("utf-8", "surrogatepass")) for k, t in map(blocks_of, b.column("html").to_pylist())]
    digests = [xxhash.xxh3_64_intdigest(k + b"\xff" + t) - (1 << 63) for k, t in blocks]
    return blocks, list(zip(*(b.column(c).to_pylist() for c in KEY[:-1]), digests, strict=True))


def _keys(batches):
    import pyarrow as pa

    for b in batches:
        _, keys = _packed(b)
        yield pa.RecordBatch.from_pylist([dict(zip(KEY, k, strict=True)) for k in keys], pa.schema([(c, pa.int64() if c in ("seq", "digest") else pa.string()) for c in KEY]))


def _edges(key, table_):
    import pyarrow as pa

    keys = sorted(zip(*(table_.column(c).to_pylist() for c in KEY), strict=True))
    found = [("first", keys[0]), ("last", keys[-1])]
    found += [("after", k) for k in [next((k for k in keys if k[-1] != keys[0][-1]), None)] if k]
    found += [("before", k) for k in [next((k for k in reversed(keys) if k[-1] != keys[-1][-1]), None)] if k]
    columns = [pa.array([key[0].as_py()] * len(found), pa.int64()), pa.array([r for r, _ in found], pa.string())]
    columns += [pa.array([k[i] for _, k in found], pa.int64() if c in ("seq", "digest") else pa.string()) for i, c in enumerate(KEY)]
    return pa.table(dict(zip(("span", "role", *KEY), columns, strict=True)))


def guests(edges: list[dict]) -> dict[tuple, list[int]]:
    """Ranges, beside its own, to which a key's page goes: where it is the nearest page before or after that is no copy.

    ``edges`` has the keys of each range by role, in order."""
    out: dict[tuple, list[int]] = {}
    for at, own in enumerate(edges):
        for step, mine, nearest, beyond in ((-1, "first", "last", "before"), (1, "last", "first", "after")):
            k = at + step
            # ranges of nothing but copies are passed over
            while 0 <= k < len(edges) and edges[k][nearest][-1] == own[mine][-1] and beyond not in edges[k] and edges[k][nearest][0] == own[mine][0]:
                k += step
            if 0 <= k < len(edges):
                near = edges[k][nearest]
                found = edges[k][beyond] if near[-1] == own[mine][-1] and near[0] == own[mine][0] and beyond in edges[k] else near
                if found[0] == own[mine][0] and found[-1] != own[mine][-1]:
                    out.setdefault(found, []).append(at)
    return out


def _lines(firsts: list[tuple], sent: dict[tuple, list[int]]):
    def run(batches):
        from bisect import bisect_right

        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            blocks, keys = _packed(b)
            spans = [bisect_right(firsts, k) - 1 for k in keys]
            rows = [(i, s, s == spans[i]) for i, k in enumerate(keys) for s in (spans[i], *sent.get(k, ()))]
            at, lines = pa.array([i for i, *_ in rows], pa.int64()), [pack(t) for _, t in blocks]
            columns = [b.column("page_id").take(at), b.column("url").take(at), pa.array([blocks[i][0] for i, *_ in rows], pa.binary()), pa.array([lines[i] for i, *_ in rows], pa.binary())]
            columns += [b.column(c).take(at) for c in ("host", "path", "query", "seq")]
            columns += [pa.array([keys[i][-1] for i, *_ in rows], pa.int64()), pa.array([s for _, s, _ in rows], pa.int64()), pa.array([o for *_, o in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in LINES.split(", ")])

    return run


def _differ(key, table_):
    import pyarrow as pa
    import zstandard

    ids, urls, own = (table_.column(c).to_pylist() for c in ("page_id", "url", "own"))
    unpack = zstandard.ZstdDecompressor().decompress
    packed = [table_.column(c).to_pylist() for c in ("kinds", "lines")]
    keys = list(zip(*(table_.column(c).to_pylist() for c in ("host", "path", "query", "seq")), [u or "" for u in urls], table_.column("digest").to_pylist(), strict=True))

    @lru_cache(maxsize=16)
    def blocks(i):
        k = list(array("I", packed[0][i]))
        return k, unpack(packed[1][i]).decode("utf-8", "surrogatepass").split("\n") if k else []

    order = sorted(range(len(ids)), key=keys.__getitem__)
    near: dict[int, list[int]] = {i: [] for i in order}
    for way in (order, order[::-1]):
        last = None
        for before, i in zip(way, way[1:]):
            if keys[before][0] != keys[i][0]:
                last = None
            elif keys[before][-1] != keys[i][-1]:
                last = before
            if last is not None:
                near[i].append(last)
    order = [i for i in order if own[i]]
    texts, n_lines, n_shared = [], [], []
    for i in order:
        kinds, lines = blocks(i)
        shared = shared_lines(lines, [blocks(j)[1] for j in near[i]])
        texts.append(main_text(kinds, lines, shared))
        n_lines.append(len(lines))
        n_shared.append(len(set().union(*shared)))
    return pa.table({
        "page_id": pa.array([ids[i] for i in order], pa.int64()), "url": pa.array([urls[i] for i in order], pa.string()),
        "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "n_lines": pa.array(n_lines, pa.int64()), "n_shared": pa.array(n_shared, pa.int64()),
    })


def extract(pages: DataFrame, spark: SparkSession, least: int = RANGE) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared) of every page."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    address = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(address, r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(address, r"^[^?#]*\?([^#]*)", 1)
    placed = source.withColumns({"host": host, "path": path, "query": query, "seq": F.coalesce("page_id", F.lit(-(1 << 63))), "address": address})
    keys = stored(placed.select(*KEY[:-1], "html").mapInArrow(_keys, KEYS).distinct(), spark, "keys")
    ordered = stored(keys.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("place", F.monotonically_increasing_id()), spark, "order")
    part = F.shiftright("place", 33)
    # one row for each partition of the order
    counts, before, n = sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()), [], 0
    for p, m in counts:
        before.append((p, n))
        n += m
    starts = spark.createDataFrame(before, "part long, before long")
    size = max(least, -(-n // RANGES))
    ranked = ordered.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("span", F.floor((F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)) / size))
    edges: list[dict] = [{} for _ in range(-(-n // size))]
    for r in ranked.select("span", *KEY).groupBy("span").applyInArrow(_edges, EDGES).collect():
        edges[r["span"]][r["role"]] = tuple(r[c] for c in KEY)
    dealt = placed.mapInArrow(_lines([e["first"] for e in edges], guests(edges)), LINES)
    return dealt.groupBy("span").applyInArrow(_differ, TEXTS)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"), spark)
