"""Main text of web pages by nearest-URL page differencing.

Pages of a host are put in the order of their URL paths. Each page is paired with the nearer of its two neighbours, the one whose
path shares the longer beginning with its own; the lines of both are aligned by longest common subsequence, and shared lines,
which belong to the site's template, are deleted. An exact check of the markup follows: what stands in menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments is deleted though a page has it alone, and a line inside a
marked article stays though a neighbour has it too, as articles repeat one another's lines. `n_shared` counts a page's shared lines.

Pages of a host with equal lines are one in the order, so a neighbour is never a copy. Pages are parsed twice: first for the
hashes of their lines, from which all pairs are aligned, then for the text. The order comes from a range shuffle of the hashes
into parts, and each part gets the last page of the part before it and the first of the part after it, so the result does not
depend on the number of parts and a host of any size spreads over tasks. A task streams its part and holds three pages.

Defined cases: null html gives an empty text; a page that is alone on its host, or all of whose fellows are copies, shares
nothing; of equally near neighbours the earlier one counts; of equal lines that can be aligned differently the longest common
subsequence takes the earliest of the neighbour's; null and broken URLs form a host of their own; repeated rows each get their
row; an empty table gives no rows; a task holds its longest page a few times; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm._store import forget, stored

# HTML's elements by role, and common names of page furniture
_RAW = "script|style|noscript|template|svg|iframe|textarea|select|option|button|title"
_FURNITURE = frozenset("nav header footer aside form menu dialog".split())
_BLOCKS = frozenset(
    "html body head p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre article section main header footer nav aside form menu dialog figure figcaption hr address details summary fieldset legend center".split()
)
_HELD = frozenset("div article section main header footer nav aside form menu dialog ul ol dl table figure details fieldset blockquote".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside widget related recommended comment comments respond reply replies disqus cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription share sharing social login signup search searchbox toolbar copyright disclaimer pagination pager skip masthead".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
_REMARKS = frozenset("comment comments reply replies respond".split())
_ARTICLE = frozenset("article post entry story".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: where a line stands
FURNITURE, LOOSE, ARTICLE = 0, 1, 2


def _role(tag: str, attributes: str, inside: bool) -> int:
    """What an element makes of its content; `inside` an article, what is only hidden stays."""
    role = FURNITURE if tag in _FURNITURE else ARTICLE if tag in ("article", "main") else LOOSE
    if not attributes.strip("/ \n\t") or tag in ("html", "body"):
        return role
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        kind = name.lower()
        if kind in ("class", "id"):
            words = set(_SPLIT.split(value))
            if words & (_REMARKS if role == ARTICLE else _NAMES):
                return FURNITURE
            if words & _ARTICLE and tag in ("div", "section"):
                role = max(role, ARTICLE)
        elif kind == "role" and value in _ROLES:
            return FURNITURE
        elif not inside and (kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and _HIDDEN.search(value)):
            return FURNITURE
        elif kind == "role" and value in ("main", "article"):
            role = max(role, ARTICLE)
    return role


def lines(page: str) -> list[tuple[str, int]]:
    """The text blocks of a page, white space made single, and where each stands."""
    out: list[tuple[str, int]] = []
    held: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    now: list[str] = []
    state = LOOSE

    def close() -> None:
        if now:
            text = " ".join(entities.unescape("".join(now)).split())
            if text:
                out.append((text, state))
            now.clear()

    for m in _TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            if m[0][0] != "<":
                now.append(m[0])
            elif m[0] == "<":
                now.append("<")
            continue
        tag = tag.lower()
        if tag == "br":
            now.append(" ")
            continue
        if tag in _BLOCKS:
            close()
        if m[2]:
            if opened[tag]:
                if tag not in _BLOCKS:
                    close()
                while opened[tag] and held:
                    last = held.pop()[0]
                    opened[last] -= 1
                    if last == tag:
                        break
                state = held[-1][1] if held else LOOSE
            continue
        if held and held[-1][0] in ("p", "li") and tag in _BLOCKS:
            opened[held.pop()[0]] -= 1
            state = held[-1][1] if held else LOOSE
        role = _role(tag, m[4], state == ARTICLE)
        if tag in _HELD or role == FURNITURE and not m[4].endswith("/") and tag not in ("input", "img", "hr", "link", "meta"):
            if role == FURNITURE and tag not in _BLOCKS:
                close()
            own = FURNITURE if state == FURNITURE or role == FURNITURE else max(role, state)
            held.append((tag, own))
            opened[tag] += 1
            state = own
    close()
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places of `a` on a longest common subsequence of lines; equal beginnings and ends are taken first."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(a) - tail, len(a))}
    common = set(b[head : len(b) - tail])
    x = [i for i in range(head, len(a) - tail) if a[i] in common]
    mine = {a[i] for i in x}
    y = [s for s in b[head : len(b) - tail] if s in mine]
    if not x:
        return out
    # Hunt and Szymanski: lines seldom repeat, so few places of y match each of x
    places: dict[str, list[int]] = {}
    for j in range(len(y) - 1, -1, -1):
        places.setdefault(y[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in x:
        for j in places[a[i]]:
            k = bisect_left(ends, j)
            node = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(node)
            else:
                ends[k] = j
                links[k] = node
    node = links[-1]
    while node:
        out.add(node[0])
        node = node[1]
    return out


def candidates(own: list[tuple[str, int]]) -> tuple[bool, list[int]]:
    """Whether a page marks an article, and the places of its lines that the markup does not rule out."""
    marked = any(s == ARTICLE for _, s in own)
    return marked, [i for i, (_, s) in enumerate(own) if s == (ARTICLE if marked else LOOSE)]


def main_text(own: list[tuple[str, int]], other: list[tuple[str, int]] | None) -> str:
    """The lines of a page that its neighbour lacks, with the check of the markup."""
    template = set() if other is None else shared([t for t, _ in own], [t for t, _ in other])
    marked, places = candidates(own)
    return "\n".join(own[i][0] for i in places if marked or i not in template)


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _digest(own: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    """(key, hashes of the lines): pages with equal lines in equal places of the markup have equal keys."""
    hashes = b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t, _ in own)
    return hashlib.blake2b(hashes + bytes(s for _, s in own), digest_size=16).digest(), hashes


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, path, page_id, key and line hashes of pages (host, path, page_id, html)."""
    for rows in batches:
        both = [_digest(lines(x or "")) for x in rows.column(3).to_pylist()]
        yield pa.record_batch([*rows.columns[:3], pa.array([k for k, _ in both], pa.binary()), pa.array([h for _, h in both], pa.binary())], names=["host", "path", "page_id", "key", "hashes"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, key and the places of shared lines, for pages (part, host, path, key, hashes, ghost) in order; ghosts belong to other parts."""
    out: list[tuple] = []
    before: tuple | None = None
    now: tuple | None = None

    def settle(later: tuple | None) -> None:
        if now is None or now[5]:
            return
        near = [p for p in (before, later) if p is not None and p[:2] == now[:2]]  # of this part and host
        other = max(near, key=lambda p: _alike(p[2], now[2]), default=None)
        places = [] if other is None else sorted(shared(np.frombuffer(now[4], dtype=np.int64).tolist(), np.frombuffer(other[4], dtype=np.int64).tolist()))
        out.append((now[1], now[3], places))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 3
        made = pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.list_(pa.int32())), strict=True)], names=["host", "key", "shared"])
        out.clear()
        return made

    for rows in batches:
        for row in zip(*(rows.column(i).to_pylist() for i in range(6)), strict=True):
            settle(row)
            before, now = now, row
            if len(out) >= 512:
                yield batch()
    settle(None)
    yield batch()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, host, key, whether an article is marked, and the places and lines that the markup does not rule out."""
    for rows in batches:
        out = []
        for page in rows.column(3).to_pylist():
            own = lines(page or "")
            marked, places = candidates(own)
            out.append((_digest(own)[0], marked, places, [own[i][0] for i in places]))
        kinds = (pa.binary(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string()))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.record_batch([*rows.columns[:3], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["page_id", "url", "host", "key", "marked", "places", "lines"])


def _templates(pages: DataFrame) -> DataFrame:
    """(host, key, shared): the places of the lines that each different page of a host shares with its nearest neighbour."""
    scanned = pages.select("host", "path", "page_id", "html").mapInArrow(_hashed, "host string, path string, page_id long, key binary, hashes binary")
    different = scanned.groupBy("host", "key").agg(F.min(F.struct("path", "page_id")).alias("at"), F.first("hashes").alias("hashes"))
    order = ["host", "path", "page_id", "key"]
    dealt = different.select("host", "at.path", "at.page_id", "key", "hashes").repartitionByRange(*order).sortWithinPartitions(*order)
    # written, so that parts stay what they are whatever is computed anew
    ordered = stored(dealt.withColumn("part", F.spark_partition_id()), "ordered")
    page = F.struct(*order, "hashes")
    ends = ordered.groupBy("part").agg(F.min(page).alias("first"), F.max(page).alias("last"))  # a row for each part
    by = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(by).alias("before"), F.lead("first").over(by).alias("after"))
    ghosts = [ends.where(f"{e} is not null").select("part", f"{e}.*", F.lit(True).alias("ghost")) for e in ("before", "after")]
    every = ordered.select("part", *order, "hashes", F.lit(False).alias("ghost")).union(ghosts[0]).union(ghosts[1])
    streamed = every.repartitionByRange("part").sortWithinPartitions("part", *order).select("part", "host", "path", "key", "hashes", "ghost")
    out = stored(streamed.mapInArrow(_aligned, "host string, key binary, shared array<int>"), "templates")
    forget(ordered)
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """The main text of each row of `pages` (page_id, url, html)."""
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    keyed = pages.select(F.lower(F.regexp_extract(url, parts, 1)).alias("host"), F.regexp_extract(url, parts, 2).alias("path"), F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    templates = _templates(keyed)
    texts = keyed.select("page_id", "url", "host", "html").mapInArrow(_texts, "page_id long, url string, host string, key binary, marked boolean, places array<int>, lines array<string>")
    found = texts.join(templates, ["host", "key"], "left")
    left = F.filter("lines", lambda x, i: ~F.array_contains("shared", F.get("places", i)))
    text = F.array_join(F.when(F.col("marked") | F.col("shared").isNull(), F.col("lines")).otherwise(left), "\n").alias("text")
    return found.select("page_id", "url", text, F.coalesce(F.size("shared"), F.lit(0)).cast("long").alias("n_shared")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
