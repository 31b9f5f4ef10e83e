"""Operator 1, main text of web pages by nearest-URL page differencing.

Each page is cut into blocks (lines of text) and each block is marked with the
part of the page that it stands in.  Pages of a host are ordered by URL path; the
lines of a page are aligned by longest common subsequence with those of the two
pages before and the two after it, and shared lines are template text:

* a line outside the page's article goes if the nearest of them (longest common
  path, then closest number) shares it;
* a line of the article goes if three of them or more share it that are no version
  of the same article, which is one that shares over half of the article's lines.

Differencing cannot tell a menu or advert that differs from page to page, so
markup assists where it is explicit: elements that are by their nature no article
(nav, aside, footer, form), their roles, and names whose head word says so
(``cookie-notice``, ``ad-slot``, but not ``notice-period`` or ``related-work``).

Scale: two map-only passes over the pages.  Between them only line hashes move,
8 bytes a line.  Paths are ordered by range partitioning, so a host with a third
of all pages spreads over many tasks; neighbours across partition borders come
from two rows per partition.  Deletions are joined back to pages; only pages with
deletions have a row, broadcast if their count is within a checked bound.

Defined cases: null or empty html gives empty text; a null URL is a host and path
of its own ('', ''); pages of equal host and path are versions of one page and
are never compared with each other; repeated rows each get a row; html that ends
within a tag loses that tag only.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .runtime import cut, read

BROADCAST_BYTES = 32 << 20
LCS_BITS = 1 << 27
NEAR = 2
VOTES = 3
#: How far up the open elements a paragraph is looked for that a block ends.
MAX_DEPTH = 512
#: Tags whose quotes never end, after which quotes are no longer respected.
MAX_UNQUOTED = 16

_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "template", "textarea", "svg", "iframe", "object", "canvas", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br", "nobr"}
_CLOSED_BY_BLOCK = {"p", "b", "i", "em", "strong", "span", "a", "u", "small", "font"}
_DROP_TAGS = {"nav", "aside", "form", "footer", "head", "title", "button", "menu", "dialog", "fieldset"}
_DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words of class names and ids: a name says what its head (last) word says, after words that say nothing.
_NEUTRAL = set("area bar block body bottom box button buttons col column container content group icons inner item items left link links list main outer panel region right row section slot text top unit wrap wrapper zone".split())
_DROP_WORDS = set("ad adbox ads advert advertisement advertising adverts aside banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|article-body|post-content|entry-content|main-content|articlebody|story-body)(?:$|[\s_-])", re.I)

MAIN, OTHER, DROPPED = 2, 1, 0


@lru_cache(maxsize=4096)
def _head(name: str) -> str:
    """The head word of a class name or id: the last that says something, else the first."""
    words = [w.lower() for w in _WORDS.findall(name)]
    telling = [w for w in words if w not in _NEUTRAL and not w.isdigit()]
    return telling[-1] if telling else words[0] if words else ""


def _kind(tag: str, attributes: str, inside: bool) -> int | None:
    """DROPPED or MAIN if the element says so, else None; ``inside`` the article a header is a part of it."""
    if tag in _DROP_TAGS:
        return DROPPED
    names, role = "", ""
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name = m[1].lower()
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            if name in ("class", "id"):
                names += " " + value
            elif name == "role":
                role = value.strip().lower()
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return DROPPED
            elif name == "itemprop" and value.lower() == "articlebody":
                return MAIN
    if tag not in ("html", "body", "main", "article"):
        heads = {_head(x) for x in names.split()} if names else set()
        if role in _DROP_ROLES or heads & _DROP_WORDS or "header" in heads and not inside:
            return DROPPED
    if tag in ("article", "main") or role in ("main", "article") or names and _MAIN_NAMES.search(names):
        return MAIN
    return None


def tags(page: str):
    """(text before, name, attributes, end tag?, self-closing?) of each tag in order, name None at the end; one pass over the page.

    Comments, CDATA sections, declarations and the content of raw elements are skipped; html that ends within a tag loses
    that tag only.
    """
    at, text, size, unquoted = 0, [], len(page), 0
    while at < size:
        start = page.find("<", at)
        if start < 0:
            text.append(page[at:])
            break
        text.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", start):
            end = page.find("]]>", start)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            continue
        m = _NAME.match(page, start + 1)
        if not m:
            text.append("<")
            at = start + 1
            continue
        rest = _REST.match(page, m.end()) if unquoted < MAX_UNQUOTED else None
        end = rest.end() if rest else page.find(">", m.end()) + 1
        unquoted += rest is None
        if not end:
            break
        name, closing = m[1].lower(), page[start + 1] == "/"
        alone = page[end - 2] == "/"
        yield "".join(text), name, page[m.end() : end - 1 - alone], closing, alone
        text, at = [], end
        if name in _RAW and not closing and not alone:
            raw = _raw_end(name).search(page, at)
            at = raw.end() if raw else size
    yield "".join(text), None, "", False, False


@lru_cache(maxsize=32)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The page's blocks in order, as (text, MAIN | OTHER | DROPPED)."""
    if not page:
        return []
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    state = OTHER

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, state))

    def close(i: int) -> int:
        before = stack[i][1]
        opened.subtract(t for t, _ in stack[i:])
        del stack[i:]
        return before

    for before, tag, attributes, closing, alone in tags(page):
        if before:
            parts.append(before)
        if tag is None:
            break
        if closing:  # an end tag closes up to its start tag, if that is open
            if tag not in _INLINE:
                flush()
            if opened[tag] > 0:
                i = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)
                if any(t not in _INLINE for t, _ in stack[i:]):
                    flush()
                state = close(i)
            continue
        if tag in _RAW:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _INLINE:
            flush()
            # a block element ends an open paragraph and what is inline in it
            if opened["p"] > 0:
                for i in range(len(stack) - 1, max(-1, len(stack) - 1 - MAX_DEPTH), -1):
                    if stack[i][0] not in _CLOSED_BY_BLOCK:
                        break
                    if stack[i][0] == "p":
                        state = close(i)
                        break
        if tag in _VOID or alone:
            continue
        stack.append((tag, state))
        opened[tag] += 1
        kind = _kind(tag, attributes, state == MAIN)
        if kind == DROPPED and state != DROPPED:
            if tag in _INLINE:
                flush()
            state = DROPPED
        elif kind == MAIN and state == OTHER:
            state = MAIN
        elif tag == "header" and state != MAIN:
            state = DROPPED
    flush()
    return out


def lcs(a: list[int], b: list[int]) -> list[int]:
    """Indices in ``a`` of a longest common subsequence with ``b`` (bit-parallel; split by halves if the matrix is large)."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    edges = [*range(low), *range(len(a) - high, len(a))]
    if not x or not y:
        return edges
    if len(x) * len(y) > LCS_BITS and len(x) > 1:
        half = len(x) // 2
        upper, lower = _prefix_lengths(x[:half], y), _prefix_lengths(x[half:][::-1], y[::-1])
        cut_at = max(range(len(y) + 1), key=lambda k: upper[k] + lower[len(y) - k])
        inner = lcs(x[:half], y[:cut_at]) + [half + i for i in lcs(x[half:], y[cut_at:])]
    else:
        inner = _traced(x, y)
    return sorted(edges + [low + i for i in inner])


def _masks(b: list[int]) -> dict[int, int]:
    found: dict[int, int] = {}
    for j, v in enumerate(b):
        found[v] = found.get(v, 0) | 1 << j
    return found


def _rows(a: list[int], b: list[int]):
    masks, full = _masks(b), (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = (v + u | v - u) & full
        yield v


def _prefix_lengths(a: list[int], b: list[int]) -> list[int]:
    v = (1 << len(b)) - 1
    for row in _rows(a, b):
        v = row
    out = [0]
    for j in range(len(b)):
        out.append(out[-1] + (not v >> j & 1))
    return out


def _traced(a: list[int], b: list[int]) -> list[int]:
    rows = [(1 << len(b)) - 1, *_rows(a, b)]
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i] >> (j - 1) & 1:  # the last column adds nothing
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:  # the row above has the same value here
            i -= 1
        else:
            out.append(i - 1)
            i, j = i - 1, j - 1
    return out[::-1]


def url_key(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, lower-cased host, without query, fragment, final slash and .html; numbers padded so that they order."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].rpartition("@")[2].lower(), m[2]) if m else ("", re.sub(r"[?#].*", "", url or "", flags=re.S))
    path = re.sub(r"(?:\.html?|/)+\Z", "", path)
    return host, re.sub(r"\d+", lambda d: d[0].lstrip("0").zfill(12), path)


def distance(a: str, b: str) -> tuple[int, int]:
    """Smaller is nearer: path segments not shared, then the difference of the first numbers that differ."""
    x, y = a.split("/"), b.split("/")
    shared = 0
    while shared < min(len(x), len(y)) and x[shared] == y[shared]:
        shared += 1
    gap = 1 << 62
    if shared < min(len(x), len(y)):
        p, q = re.findall(r"\d{12,}", x[shared]), re.findall(r"\d{12,}", y[shared])
        gap = next((min(abs(int(u) - int(v)), gap) for u, v in zip(p, q, strict=False) if u != v), gap)
    return max(len(x), len(y)) - shared, gap


def _line_hashes(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return textnum.Words(data, offsets, np.zeros(256, bool)).hashes()


_LINES = pa.schema([("page_id", pa.int64()), ("h", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.binary()), ("kinds", pa.binary())])
_LINES_DDL = "page_id long, h long, host string, path string, lines binary, kinds binary"


def _lines(batches):
    for batch in batches:
        rows = []
        for page_id, h, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "h", "url", "html")), strict=True):
            found = blocks(page)
            kinds = bytes(k for _, k in found)
            hashes = _line_hashes([t for t, _ in found]) if found else np.zeros(0, np.uint64)
            rows.append((page_id, h, *url_key(url), hashes.tobytes(), kinds))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LINES, strict=True)], schema=_LINES)


_DELETED = pa.schema([("d_page_id", pa.int64()), ("d_h", pa.int64()), ("deleted", pa.binary()), ("n_shared", pa.int64())])
_DELETED_DDL = "d_page_id long, d_h long, deleted binary, n_shared long"


def template_lines(lines: list[int], kinds: bytes, near: list[list[int]]) -> tuple[list[int], int]:
    """Indices of the template lines of a page, and how many lines the nearest neighbour shares; ``near`` has the neighbours' lines, the nearest first."""
    shared = [lcs(lines, other) for other in near]
    main = [i for i, k in enumerate(kinds) if k == MAIN]
    voted: Counter[int] = Counter()
    for found in shared:
        inside = [i for i in found if kinds[i] == MAIN]
        if 2 * len(inside) <= len(main):  # not a version of the same article
            voted.update(inside)
    gone = [i for i in shared[0] if kinds[i] == OTHER] + [i for i, n in voted.items() if n >= VOTES]
    return sorted(gone), len(shared[0])


def _align(batches):
    for batch in batches:
        rows = []
        columns = ("page_id", "h", "path", "lines", "kinds", "prev", "next")
        for page_id, h, path, lines, kinds, before, after in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            near = sorted((distance(path, x["path"]), k, x["lines"]) for k, x in enumerate((*before, *after)))
            if near:
                gone, shared = template_lines(np.frombuffer(lines, np.uint64).tolist(), kinds, [np.frombuffer(x, np.uint64).tolist() for _, _, x in near])
                if gone:
                    rows.append((page_id, h, np.array(gone, np.int32).tobytes(), shared))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DELETED, strict=True)] if rows else [pa.array([], f.type) for f in _DELETED], schema=_DELETED)


def neighbours(paths: DataFrame) -> DataFrame:
    """(host, path, prev, next) of distinct host and path, with path and lines of the NEAR paths before and after on the host, the closest first."""
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(paths.repartitionByRange(n, "host", "path").withColumn("range", F.spark_partition_id()).withColumn("x", F.struct("host", "path", "lines")))
    inside = W.partitionBy("range", "host").orderBy("path")
    at = {"prev": F.lag, "next": F.lead}
    got = placed.select("range", "host", "path", *[F.array(*[f("x", i).over(inside) for i in range(1, NEAR + 1)]).alias(k) for k, f in at.items()])
    # across borders: the first and last rows of each range, and of the ranges beside it
    whole = W.partitionBy("range")
    placed = placed.withColumns({"up": F.row_number().over(whole.orderBy("host", "path")), "down": F.row_number().over(whole.orderBy(F.desc("host"), F.desc("path")))})
    few = {k: F.array_sort(F.collect_list(F.when(F.col(k) <= NEAR, F.struct(k, "x")))) for k in ("up", "down")}
    ends = placed.where(f"up <= {NEAR} OR down <= {NEAR}").groupBy("range").agg(*[few[k].alias(k) for k in few])
    across = W.orderBy("range")
    beside = {k: F.flatten(F.array(*[F.coalesce(f(F.transform(e, lambda y: y["x"]), i).over(across), F.array()) for i in range(1, NEAR + 1)])) for k, f, e in (("prev", F.lag, "down"), ("next", F.lead, "up"))}
    both = got.join(ends.select("range", *[v.alias(f"{k}_range") for k, v in beside.items()]), "range")
    for k in at:
        same = F.filter(F.concat(k, f"{k}_range"), lambda y: y.isNotNull() & (y["host"] == F.col("host")))
        both = both.withColumn(k, F.slice(same, 1, NEAR))
    return both.select("host", "path", *at)


def deletions(pages: DataFrame) -> DataFrame:
    """(d_page_id, d_h, deleted, n_shared): of the pages with deletions, the indices of the deleted blocks."""
    lines = cut(pages.mapInArrow(_lines, _LINES_DDL))
    one = lines.groupBy("host", "path").agg(F.min_by("lines", F.struct("page_id", "h")).alias("lines"))
    pairs = lines.join(neighbours(one), ["host", "path"])
    return cut(pairs.mapInArrow(_align, _DELETED_DDL).distinct())


def _texts(batches):
    for batch in batches:
        texts = []
        for page, deleted in zip(batch.column("html").to_pylist(), batch.column("deleted").to_pylist(), strict=True):
            gone = set(np.frombuffer(deleted, np.int32).tolist()) if deleted else ()
            texts.append("\n".join(t for i, (t, k) in enumerate(blocks(page)) if k != DROPPED and i not in gone))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url")), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64("url", "html").alias("h"))
    gone = deletions(pages)
    small = (gone.agg(F.sum(F.octet_length("deleted") + 64).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES
    on = F.col("page_id").eqNullSafe(F.col("d_page_id")) & (F.col("h") == F.col("d_h"))
    both = pages.join(F.broadcast(gone) if small else gone, on, "left").select("page_id", "url", "html", "deleted")
    return both.mapInArrow(_texts, T.StructType([both.schema["page_id"], both.schema["url"], T.StructField("text", T.StringType())]))


def op1_page_differencing(spark, sf_dir: str) -> DataFrame:
    found = extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
