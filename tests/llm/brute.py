"""Plain-Python versions of the corpus operators, for small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

MASK = (1 << 64) - 1


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def simhash(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    g = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    votes = [0] * 64
    for x in g:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(g))


def components(prints, bits=4):
    """Least member of each fingerprint's component under links of at most so many differing bits."""
    prints = sorted(set(prints))
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(prints):
        for b in prints[k + 1 :]:
            if (a ^ b).bit_count() <= bits:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {f: find(f) for f in prints}


def keep_one(rows):
    """Ids of rows(id, text) that stay: the least of each component."""
    prints = {i: simhash(t) for i, t in rows}
    of, least = components(prints.values()), {}
    for i, f in prints.items():
        least[of[f]] = min(i, least.get(of[f], i))
    return {i for i, f in prints.items() if least[of[f]] == i}


def boilerplate(rows, min_sites, near=0.15):
    """Lines of rows(text, site) on enough sites and in enough classes of copies among the texts that hold a widespread line."""
    held, times = defaultdict(set), Counter()
    for t, site in rows:
        for line in t.split("\n") if t is not None else ():
            if line.strip(" "):
                held[line].add((t, site))
                times[line] += 1
    wide = {x for x, own in held.items() if times[x] >= min_sites and len({s for _, s in own}) >= min_sites * (1 - near) - 1}
    texts = {t for x in wide for t, _ in held[x]}
    prints = {t: simhash(t) for t in texts}
    of = components(prints.values())
    return {x for x in wide if len({s for _, s in held[x]}) >= min_sites and len({of[prints[t]] for t, _ in held[x]}) >= min_sites}


def strip_lines(t, bad):
    return None if t is None else "\n".join(x for x in t.split("\n") if x not in bad)


def quality(rows, labels, buckets=1 << 16):
    """{id: (base_failed, score)} and the threshold of rows(id, text) under labels(id, quality, toxic)."""
    best, toxic = {}, set()
    for i, q, t in labels:
        best[i] = max(best.get(i, -1), -1 if q is None else q)
        if t == 1:
            toxic.add(i)
    raw, target, own, failed = Counter(), Counter(), {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = [zlib.crc32(lower(x).encode()) for x in w]
        own[i] = [(x * 0xA24BAED4963EE407 & MASK) >> 48 for x in h] + [((a * 0x9E3779B97F4A7C15 + b) * 0xD6E8FEB86659FD93 & MASK) >> 48 for a, b in zip(h, h[1:])]
        raw.update(own[i])
        if best.get(i) == 1 and i not in toxic:
            target.update(own[i])
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
        failed[i] = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    p, q = sum(target.values()) + buckets, sum(raw.values()) + buckets
    weight = lambda b: math.log((target[b] + 1) / p) - math.log((raw[b] + 1) / q)
    score = {i: sum(map(weight, f)) / len(f) if f else 0.0 for i, f in own.items()}
    good = sorted(math.floor(score[i] * 1000) for i in own if best.get(i) == 1 and not failed[i])
    least = -0.3
    for k, b in enumerate(good):
        if sum(x <= b for x in good) > 0.005 * len(good):
            least = b / 1000 - 0.02
            break
    return {i: (failed[i], score[i]) for i in own}, least


def contaminated(rows, items):
    """Ids of rows(id, text) that hold a window of items(text)."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for t in items:
        w = find(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[n].add(tuple(w[k : k + n]))
    out = set()
    for i, t in rows:
        w = find(t)
        if any(tuple(w[k : k + n]) in own for n, own in windows.items() for k in range(len(w) - n + 1)):
            out.add(i)
    return out
