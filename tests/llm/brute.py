"""Plain restatements of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import groupby

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def removal(docs, units, width, join):
    """(doc_id, units, removed, runs, hash of what is kept) by first owners of ``width`` units."""
    cut = [(d, units(t)) for d, t in docs]
    rank = lambda d: LAST if d is None else d
    first = {}
    for d, u in cut:
        for i in range(len(u) - width + 1):
            k = tuple(u[i : i + width])
            first[k] = min(first.get(k, LAST), rank(d))
    out = []
    for d, u in cut:
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            if first[tuple(u[i : i + width])] < rank(d):
                gone[i : i + width] = [True] * width
        out.append((d, len(u), sum(gone), sum(1 for k, _ in groupby(gone) if k), sha(join(x for x, g in zip(u, gone, strict=True) if not g))))
    return out


def tokens(docs):
    return removal(docs, lambda t: WORD.findall(t or ""), 13, " ".join)


def substrings(docs):
    return removal(docs, lambda t: list((t or "").encode()), 50, bytes)


def fingerprint(t):
    w = WORD.findall(lower(t or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(docs):
    prints = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, f"{prints[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(docs)]


def statistics(t):
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    hit = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def targets(sizes):
    """sizes: [(source, size)] in order; water filling by repeated resharing."""
    total, weights = sum(n for _, n in sizes), {s: i % 3 + 1 for i, (s, _) in enumerate(sizes)}
    fixed, open_ = {}, dict(sizes)
    while open_:
        rest, w = total - sum(fixed.values()), sum(weights[s] for s in open_)
        over = [s for s, n in open_.items() if rest * weights[s] / w > 3 * n]
        if not over:
            return fixed | {s: rest * weights[s] / w for s in open_}
        for s in over:
            fixed[s] = 3 * open_.pop(s)
    return fixed


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(t):
    t = t or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return _digest(spans, ("email", "ip", "card", "phone"))


def lcs_places(a, b):
    """Places in ``a`` of a longest common subsequence with ``b``, equal ends first, then as far back as the plain table allows."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    n = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            n[i + 1][j + 1] = n[i][j] + 1 if p == q else max(n[i][j + 1], n[i + 1][j])
    i, j, out = len(x), len(y), []
    while i and j:
        if n[i][j] == n[i][j - 1]:
            j -= 1
        elif n[i][j] == n[i - 1][j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(low + i)
    return [*range(low), *reversed(out), *range(len(a) - high, len(a))]


def main_texts(pages, blocks, key, distance):
    """(page_id, text) by pairing, alignment and deletion over ``pages`` (page_id, url, html); blocks are (text, 0 dropped, 1 other, 2 article)."""
    cut = [(i, key(u), blocks(h)) for i, u, h in pages]
    lines = {}
    for i, k, found in cut:  # one version of each path stands for it
        lines.setdefault(k, []).append((i, [t for t, _ in found]))
    out = []
    for i, (host, path), found in cut:
        paths = sorted(p for h, p in lines if h == host)
        at = paths.index(path)
        near = sorted((distance(path, p), k, p) for k, p in enumerate(paths[max(0, at - 2) : at][::-1] + paths[at + 1 : at + 3]))
        own, main = [t for t, _ in found], [x for x, (_, k) in enumerate(found) if k == 2]
        gone, votes = set(), Counter()
        for rank, (_, _, p) in enumerate(near):
            shared = lcs_places(own, min(lines[host, p], key=lambda v: v[0])[1])
            if rank == 0:
                gone |= {x for x in shared if found[x][1] == 1}
            if 2 * len(set(shared) & set(main)) <= len(main):
                votes.update(set(shared) & set(main))
        gone |= {x for x, n in votes.items() if n > 2}
        out.append((i, "\n".join(t for x, (t, k) in enumerate(found) if k and x not in gone)))
    return out


def pii_terms(docs, support=2, smooth=1.0, threshold=0.9):
    """Per row (start, end, level) of the terms that disclose an entity of the row: PMI over rows, level 1 if the class of the last two letters is under the threshold."""
    runs = [[(m.start(), m.end(), lower(m[0])) for m in re.finditer(r"[A-Za-z\x80-\U0010ffff]+", t or "")] for _, t in docs]
    spans = [[(k, int(a), int(b)) for k, a, b in (x.split(":") for x in filter(None, pii(t)[2].split(",")))] for _, t in docs]
    holds = [{(k, t[a:b]) for k, a, b in s} for s, (_, t) in zip(spans, docs, strict=True)]
    terms = [[r for r in rs if r[1] - r[0] >= 3 and not any(a < r[1] and r[0] < b for _, a, b in s)] for rs, s in zip(runs, spans, strict=True)]
    n_term = Counter(x for rs in runs for x in {w for _, _, w in rs} | {("class", w[-2:]) for _, _, w in rs})
    n_entity = Counter(e for h in holds for e in h)
    both, ids = Counter(), {}
    for h, rs, (d, _) in zip(holds, terms, docs, strict=True):
        for e in h:
            for x in {w for _, _, w in rs} | {("class", w[-2:]) for _, _, w in rs}:
                both[e, x] += 1
                ids.setdefault((e, x), set()).add(d)

    def high(e, x):
        p = min(0.5, n_entity[e] / len(docs))
        given = min(1.0, (both[e, x] + smooth * p) / (n_term[x] + smooth))
        return len(ids[e, x]) >= support and 1 + math.log(given) / -math.log(p) >= threshold

    out = []
    for h, rs in zip(holds, terms, strict=True):
        levels = ((a, b, max((1 + high(e, ("class", w[-2:])) for e in h if high(e, w)), default=0)) for a, b, w in rs)
        out.append([x for x in levels if x[2]])
    return out


def secrets(t):
    t = t or ""
    words = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    spans = [(m.start(), 0, m.end()) for m in re.finditer(rf"({words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return _digest(spans, ("assign", "access", "hex"))


def _digest(spans, kinds):
    text = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return tuple(sum(k == i for _, k, _ in spans) for i in range(len(kinds))), sha(text), text


def contamination(t, items):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x or ""))
    w = words(t)
    hit, ids = set(), set()
    for item_id, x in items:
        v = words(x)
        for i in range(max(1, len(v) - 9)) if v else ():
            part = v[i : i + 10]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    ids.add(str(item_id))
    return len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)
