"""Plain passes over small tables that the operators must agree with."""

from __future__ import annotations

import re

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def fold(text):
    return (text or "").translate(FOLD)


def simhash(text):
    words = SPACED.findall(fold(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints):
    """prints: list of (doc_id, fingerprint); smallest reachable id of each distinct fingerprint."""
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for d, f in prints:
        r = find(f)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return {f: least.get(find(f)) for f in distinct}


def contaminated(docs, items, window=10):
    """{doc_id: (n_words, n_hit, sorted item ids as strings)}"""
    wins = {}
    for item, text in items:
        w = ALNUM.findall(fold(text))
        n = min(len(w), window)
        for i in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in wins}
    out = {}
    for doc, text in docs:
        w = ALNUM.findall(fold(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if owners := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= owners
        out[doc] = (len(w), len(hit), sorted(map(str, found)))
    return out


def repeats(docs, width=35):
    """{doc_id: (n_words, kept words)} after removal of windows that start twice."""
    seen = {}
    split = [(d, SPACED.findall(t or "")) for d, t in docs]
    for _, w in split:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def near_groups(docs, width=5, similarity=0.8):
    """Smallest id of each document's group of texts whose word shingles are that similar."""
    sets = {}
    for d, t in docs:
        words = SPACED.findall(fold(t))
        grams = [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
        sets[d] = frozenset(grams)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_gram = {}
    for d, grams in sets.items():
        for g in grams or [None]:
            by_gram.setdefault(g, []).append(d)
    seen = set()
    for members in by_gram.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    shared = len(sets[a] & sets[b])
                    if shared >= similarity * (len(sets[a]) + len(sets[b]) - shared):
                        x, y = sorted((find(a), find(b)))
                        parent[y] = x
    return {d: find(d) for d in sets}
