"""Plain statements of what the operators return, one text at a time."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

BLANKS = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w]


def quality_counts(text):
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    twice = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(BLANKS)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(twice))


def shingles(text, n=5):
    w = [x.translate(LOWER) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def classes(rows):
    """Smallest linked id of each (doc_id, text)."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if either and 100 * both >= 80 * either:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def line_key(line):
    return line.strip(BLANKS).translate(LOWER)


def kept_lines(rows):
    """(lines, dropped, kept text) per (doc_id, text)."""
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= 20 and i is not None:
                holders[line_key(line)].add(i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or last.get(line_key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    found = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return found[1].translate(LOWER), found[2]


def url_rule(url, rules):
    host, path = url_parts(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host))
            and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best.key if best else None, best.verdict if best else "allow"


def learns(doc_id, folds, left_out):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds != left_out


def base_scores(rows):
    """(tokens, known, training tokens, score) per (doc_id, text)."""
    counts = Counter()
    for i, t in rows:
        if learns(i, 7, 2):
            counts.update([w.translate(LOWER) for w in words(t)] + [None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        own = [w.translate(LOWER) for w in words(t)] + [None]
        out.append((i, len(own), sum(counts[w] > 0 for w in own), n,
                    sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)))
    return out
