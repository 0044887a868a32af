"""Plain Python versions of operators, to test against."""

from __future__ import annotations

import re

BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {}
    for kind, pattern in BASE_PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


def shingle_set(text: str | None) -> frozenset:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def jaccard_classes(documents: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id: (set size, smallest doc_id reachable), by comparing all documents that share a shingle."""
    sets = {d: shingle_set(t) for d, t in documents}
    holders: dict = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(d: int) -> int:
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    for d, s in sets.items():
        common: dict[int, int] = {}
        for x in s:
            for e in holders[x]:
                if e < d:
                    common[e] = common.get(e, 0) + 1
        for e, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def leaks(documents: list[tuple[int, str]], items: list[tuple[int, str | None]]) -> set[tuple[int, int]]:
    """Pairs with a stretch, on one diagonal, where enough words agree (5 in a row somewhere on it)."""
    words = lambda t: [w for w in re.split(r"[^\w]+|_+", t.lower()) if w]
    found = set()
    for item, text in items:
        own = words(text or "")
        for doc, held in documents:
            theirs = words(held)
            for shift in range(-len(own) + 1, len(theirs)):
                hits = [0 <= shift + j < len(theirs) and theirs[shift + j] == w for j, w in enumerate(own)]
                best = run = same = matched = 0
                for hit in hits:
                    if run <= 0:
                        run = same = 0
                    run, same = run + (1 if hit else -3), same + hit
                    if run > best:
                        best, matched = run, same
                if own and matched >= min(12, -(-len(own) * 8 // 10)):
                    found.add((doc, item))
    return found


def leaks_by_share(documents: list[tuple[int, str]], items: list[tuple[int, str]]) -> set[tuple[int, int]]:
    """Pairs where, on one diagonal, at least four in five of all the item's words agree: a plain count."""
    words = lambda t: [w for w in re.split(r"[^\w]+|_+", t.lower()) if w]
    found = set()
    for item, text in items:
        own = words(text)
        for doc, held in documents:
            theirs = words(held)
            for shift in range(-len(own) + 1, len(theirs)):
                same = sum(0 <= shift + j < len(theirs) and theirs[shift + j] == w for j, w in enumerate(own))
                if own and 5 * same >= 4 * len(own):
                    found.add((doc, item))
    return found


def syncmer_sketch(text: str, settings) -> list[int]:
    """The fingerprint of one text from the definition: k-mers whose least inner hash stands at an edge, by one hash function for each inner string."""
    k, s = settings.K, settings.S
    mask = (1 << 64) - 1

    def mixed(x: int) -> int:
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
            x ^= x >> shift
            x = x * factor & mask
        return x ^ (x >> 32)

    def inner(i: int) -> int:
        h = 0
        for c in text[i : i + s]:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) & mask
        return mixed(h)

    found: dict[int, int] = {}
    for i in range(len(text) - k + 1):
        own = [inner(j) for j in range(i, i + k - s + 1)]
        if min(own) in (own[0], own[-1]):
            h = 0
            for j in range(0, k, s):
                h = (h * 0xD6E8FEB86659FD93 + own[j]) & mask
            found.setdefault(mixed(h) >> (64 - settings.HASH_BITS), i)
    return [(h << settings.PLACE_BITS) | i for h, i in sorted(found.items())[: settings.KEPT]]


def positional_likeness(a: list[int], b: list[int], kept: int, bits: int) -> float:
    """Shared anchors among the smallest of both, as many as stand in one order, over those."""
    x, y = ({v >> bits: v & ((1 << bits) - 1) for v in s} for s in (a, b))
    union = sorted(set(x) | set(y))[:kept]
    places = [q for _, q in sorted((x[h], y[h]) for h in union if h in x and h in y)]
    best: list[int] = []
    for i, q in enumerate(places):
        best.append(1 + max([best[j] for j in range(i) if places[j] <= q], default=0))
    return max(best, default=0) / len(union)
