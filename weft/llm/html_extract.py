"""Main text of web pages: page differencing against the nearest URLs of the same host.

A page becomes lines, one a block, each marked by the elements around it as article, furniture (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments) or other. Pages are ordered by host and URL path; a page's neighbours are
the nearest ``reach`` pages with other lines on each side, those with more leading path segments in common first. The lists of
lines are aligned by their longest common subsequence and shared lines are deleted. What is left, without furniture, is the
main text.

Pages of one article share its lines as well, so copies of the page are passed over: neighbours that share more than
``copy_share`` of what another neighbour does not share, or nearly all of the text. How long the boilerplate is does not
matter. Of the other neighbours, the nearest decides lines without a mark. A line that the page itself marks as article is
deleted only if all of them share it: what a template repeats stands on all pages, while a passage that two articles quote is
part of both. A page that marks an article keeps the article alone.

The order is cut into ranges of ``range_rows`` pages or more (at most ``max_ranges``, so the driver holds at most twice as
many boundary keys), each with the ``reach`` pages on either side of it. So a host that holds a third of all pages is spread
over many tasks, the result does not depend on the number of partitions, and pages move once, compressed; a task holds one
range. Mirrors are passed over however many lie in a row within a range; across its edge, ``reach`` of them.

Defined results: null or empty html gives an empty text; a page without a neighbour, or without a url, loses only its
furniture; repeated rows give one row each; unclosed and truncated elements end at the end of the element around them or of
the page; pages of any number of lines, equal ones too, take memory in proportion to it; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import itertools
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.url_filter import url_parts
from weft.session import materialize

ARTICLE, FURNITURE, OTHER = "a", "f", "o"

#: A page that shares all but this part of the text is a copy, whatever other pages share.
NEARLY_ALL = 0.1

#: Elements whose content is not text.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "title", "iframe", "object", "canvas", "audio", "video", "select", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that do not end a block.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
FURNITURE_TAGS = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"}
FURNITURE_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
FURNITURE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|side-?bar|menu|nav|navbar|navigation|topbar|masthead|breadcrumbs?|foot(?:er)?"
    r"|page-?header|site-?header|comments?|comment-?list|disqus|replies|respond|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|share|sharing|social"
    r"|related|recommended|recirc|newsletter|subscribe|signup|login|widget|pagination|pager|tags?|toolbar|copyright|disclaimer|skip-?link)(?:$|[\s_-])"
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _mark(tag: str, attributes: str, inside: str) -> str:
    """The mark of an element, given the mark of the element around it."""
    if inside == FURNITURE or tag in FURNITURE_TAGS or tag == "header" and inside != ARTICLE:
        return FURNITURE
    named = {}
    if attributes:
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        names = f"{named.get('class', '')} {named.get('id', '')}".lower()
        if named.get("role", "").lower() in FURNITURE_ROLES or "hidden" in named or named.get("aria-hidden") == "true":
            return FURNITURE
        if tag not in ("html", "body", "article", "main") and FURNITURE_NAMES.search(names) or tag == "article" and "comment" in names:
            return FURNITURE
    return ARTICLE if tag in ("article", "main") or named.get("role") in ("main", "article") or named.get("itemprop") == "articleBody" else inside


def page_lines(source: str) -> list[tuple[str, str]]:
    """(mark, text) of every block with text, in page order."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = [("", OTHER)]  # open elements with their marks
    held: list[str] = []
    at, size = 0, len(source)

    def end_block() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((stack[-1][1], text))

    while at < size:
        m = TOKEN.search(source, at)
        if m is None:
            rest = source[at:]
            held.append(rest if not re.match(r"<[a-zA-Z/!?]", rest) else "")
            break
        held.append(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:  # a comment or declaration
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in SILENT:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.end() if end else size
            continue
        if tag not in INLINE:
            if tag == "br":
                held.append(" ")
                continue
            end_block()
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag in INLINE and any(x not in INLINE for x, _ in stack[i + 1 :]):
                        break  # an inline element does not close a block
                    end_block() if stack[i][1] != stack[i - 1][1] else None
                    del stack[i:]
                    break
        else:
            if tag in ("article", "main", "footer", "nav", "header") or tag == "p":
                # these do not stand in a paragraph; an unclosed one ends here
                while len(stack) > 1 and (stack[-1][0] in INLINE or stack[-1][0] == "p"):
                    stack.pop()
            if tag == "li" and stack[-1][0] == "li":
                stack.pop()
            mark = _mark(tag, attributes, stack[-1][1])
            if mark != stack[-1][1]:
                end_block()
            stack.append((tag, mark))
    end_block()
    return out


def _prefix_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequence of ``a`` with every prefix of ``b``; bit-parallel, a number of len(b) bits."""
    masks: dict[str, int] = {}
    for j, y in enumerate(b):
        masks[y] = masks.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of one longest common subsequence with ``b``."""
    found: set[int] = set()
    todo = [(0, a, b)]
    while todo:
        at, a, b = todo.pop()
        start, ends = 0, min(len(a), len(b))
        while start < ends and a[start] == b[start]:
            start += 1
        tail = 0
        while tail < ends - start and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        found.update(range(at, at + start), range(at + len(a) - tail, at + len(a)))
        at, a, b = at + start, a[start : len(a) - tail], b[start : len(b) - tail]
        where: dict[str, list[int]] = {}
        for j in range(len(b) - 1, -1, -1):
            where.setdefault(b[j], []).append(j)
        if sum(len(where.get(x, ())) for x in a) > 8 * (len(a) + len(b)):
            # lines that repeat: cut a in the middle and b where both halves have most in common
            half = len(a) // 2
            both = _prefix_lengths(a[:half], b) + _prefix_lengths(a[half:][::-1], b[::-1])[::-1]
            cut = int(both.argmax())
            todo += [(at, a[:half], b[:cut]), (at + half, a[half:], b[cut:])]
            continue
        # longest increasing sequence of matching places: heads[k] is the least end in b of a chain of k + 1 matches
        heads: list[int] = []
        chain: list[tuple[int, tuple | None]] = []
        for i, x in enumerate(a):
            for j in where.get(x, ()):
                k = bisect_left(heads, j)
                link = (at + i, chain[k - 1] if k else None)
                if k == len(heads):
                    heads.append(j)
                    chain.append(link)
                elif j < heads[k]:
                    heads[k], chain[k] = j, link
        link = chain[-1] if chain else None
        while link:
            found.add(link[0])
            link = link[1]
    return found


def main_text(lines: list[tuple[str, str]], neighbours: Iterable[list[tuple[str, str]]], copy_share: float) -> tuple[str, int]:
    """The text, and how many lines differencing deleted. neighbours: nearest first, taken only as far as needed."""
    texts = [t for _, t in lines]
    body = {i for i, (m, _) in enumerate(lines) if m != FURNITURE}
    article = {i for i, (m, _) in enumerate(lines) if m == ARTICLE}
    found: list[set[int]] = []
    more = iter(neighbours)

    def take(n: int) -> None:
        found.extend(common_lines(texts, [t for _, t in other]) for other in itertools.islice(more, n))

    def size(places: set[int]) -> int:
        return sum(len(texts[i]) for i in places)

    def is_copy(k: int) -> bool:
        if size(body - found[k]) <= NEARLY_ALL * size(body):
            return True
        # what another page does not share is this page's own: a copy shares that, a page of the same template does not
        return any(size(own & found[k]) > copy_share * size(own) for j in range(len(found)) if j != k and (own := body - found[j]))

    take(2)
    while not (others := [f for k, f in enumerate(found) if not is_copy(k)]):
        have = len(found)
        take(1)
        if len(found) == have:
            break
    shared = others[0] if others else set()
    if shared & article:
        take(1 << 30)  # what a page marks as its article is weighed against all neighbours
        others = [f for k, f in enumerate(found) if not is_copy(k)]
        shared = shared - article | set.intersection(article, *others)
    left = [t for i, (m, t) in enumerate(lines) if i not in shared and (m == ARTICLE or m == OTHER and not article)]
    return " ".join(left), len(shared)


def _near(path: str, other: str) -> int:
    n = 0
    for x, y in zip(path.split("/"), other.split("/")):
        if x != y:
            break
        n += 1
    return n


def _edges(keys: DataFrame, range_rows: int, max_ranges: int, reach: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Of every range, in order: its first key (host, path, id as text), the last of the first ``reach`` keys, and the first of the last ones."""
    ordered = keys.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
    ordered = materialize(ordered.select("host", "path", "key", F.monotonically_increasing_id().alias("at")), "keys")
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(F.shiftright("at", 33)).count().collect())  # a row a partition
    total = sum(n for _, n in counts)
    size = max(range_rows, 2 * reach, -(-total // max_ranges))
    begin, offsets = 0, []
    for part, n in counts:
        offsets.append((part, begin))
        begin += n
    if not offsets:
        return [], [], []
    parts = F.broadcast(keys.sparkSession.createDataFrame(offsets, "part long, begin long"))
    ordered = ordered.withColumn("part", F.shiftright("at", 33)).join(parts, "part")
    place = (F.col("begin") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place")
    within = F.col("place") % size
    edge = ordered.select("host", "path", "key", place).where((within == 0) | (within == reach - 1) | (within == size - reach))
    rows = sorted(edge.collect(), key=lambda r: r.place)
    at = lambda n: {r.place // size: (r.host, r.path, r.key) for r in rows if r.place % size == n}
    firsts, heads, tails = at(0), at(reach - 1), at(size - reach)
    last = (chr(0x10FFFF), "", "")  # a short last range is all head, and has nothing after it
    return [firsts[k] for k in sorted(firsts)], [heads.get(k, last) for k in sorted(firsts)], [tails.get(k, last) for k in sorted(firsts)]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", copy_share: float = 0.5, reach: int = 4, range_rows: int = 2000, max_ranges: int = 100_000) -> DataFrame:
    """One row per input row: ``id_col``, url, text, n_shared (lines that differencing deleted)."""
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    kind = pages.schema[id_col].dataType
    found = _edges(pages.select(host.alias("host"), path.alias("path"), key.alias("key")), range_rows, max_ranges, reach)
    edges = spark.sparkContext.broadcast(found)  # three keys a range, max_ranges at most
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"), key.alias("key"), F.col(html_col).cast("string").alias("html"))
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()),
        T.StructField("key", T.StringType()), T.StructField("lines", T.BinaryType()), T.StructField("range", T.IntegerType()), T.StructField("guest", T.BooleanType()),
    ])

    def parse(batches):
        firsts, heads, tails = edges.value
        for batch in batches:
            places, packed, ranges, guests = [], [], [], []
            columns = [batch.column(j).to_pylist() for j in range(2, 6)]
            for i, (h, p, k, source) in enumerate(zip(*columns)):
                blob = zlib.compress(json.dumps(page_lines(source or ""), ensure_ascii=False).encode("utf-8", "surrogatepass"), 1)
                own = (h, p, k)
                at = bisect_right(firsts, own) - 1
                to = [(at, False)]
                if at > 0 and own <= heads[at]:
                    to.append((at - 1, True))
                if at + 1 < len(firsts) and own >= tails[at]:
                    to.append((at + 1, True))
                for r, guest in to:
                    places.append(i)
                    packed.append(blob)
                    ranges.append(r)
                    guests.append(guest)
            take = batch.take(pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays([*take.columns[:5], pa.array(packed, pa.binary()), pa.array(ranges, pa.int32()), pa.array(guests, pa.bool_())], schema.names)

    # a partition a range: ranges are too many and too large to be dealt into the default number of partitions
    moved = rows.mapInArrow(parse, schema).repartition(max(1, len(found[0])), "range").sortWithinPartitions("range", "host", "path", "key")
    out = T.StructType([T.StructField("id", kind), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_shared", T.IntegerType())])

    def judge(held):
        """Text and deleted lines of every page of one range that is not a guest. held: id, url, host, path, lines as bytes, guest."""
        before, after = list(range(len(held))), list(range(len(held)))  # the nearest page on that side with other lines
        for i in range(len(held)):
            before[i] = -1 if i == 0 else before[i - 1] if held[i - 1][4] == held[i][4] else i - 1
        for i in reversed(range(len(held))):
            after[i] = len(held) if i + 1 == len(held) else after[i + 1] if held[i + 1][4] == held[i][4] else i + 1
        lines = functools.lru_cache(4 * reach)(lambda blob: [tuple(x) for x in json.loads(zlib.decompress(blob).decode("utf-8", "surrogatepass"))])

        def neighbours(i):
            sides = []
            for step, end in ((before, -1), (after, len(held))):
                j, n = step[i], 0
                while j != end and n < reach and held[j][2] == held[i][2] and held[i][2]:
                    sides.append((-_near(held[i][3], held[j][3]), n, end, held[j][4]))
                    j, n = step[j], n + 1
            seen = {held[i][4]}
            for *_, blob in sorted(sides, key=lambda s: s[:3]):
                if blob not in seen:
                    seen.add(blob)
                    yield lines(blob)

        return [(held[i][0], held[i][1], *main_text(lines(held[i][4]), neighbours(i), copy_share)) for i in range(len(held)) if not held[i][5]]

    def compare(batches):
        held, current, id_type = [], None, None

        def result():
            got = judge(held)
            for i in range(0, len(got), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got[i : i + 1000]), (id_type, pa.string(), pa.string(), pa.int32()))], out.names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for row in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5, 7, 6))):
                if row[6] != current:
                    yield from result()
                    held, current = [], row[6]
                held.append(row[:6])
        yield from result()

    judged = moved.select("id", "url", "host", "path", "key", "lines", "range", "guest").mapInArrow(compare, out)
    return judged.select(F.col("id").alias(id_col), "url", "text", "n_shared")
