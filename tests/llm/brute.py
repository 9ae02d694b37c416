"""Step-by-step models that the operators are compared with."""

from __future__ import annotations

import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, n: int = 3) -> set[tuple[str, ...]]:
    w = [lower(x) for x in words(text)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def components(texts: dict[int, str | None], above: int = 90, below: int = 100) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest linked id), from all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def top(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    index: dict[tuple[str, ...], list[int]] = {}
    for d in sorted(sets):
        shared: dict[int, int] = {}
        for s in sets[d]:
            for e in index.setdefault(s, []):
                shared[e] = shared.get(e, 0) + 1
            index[s].append(d)
        for e, both in shared.items():
            if below * both >= above * (len(sets[d]) + len(sets[e]) - both):
                a, b = sorted((top(d), top(e)))
                root[b] = a
    return {d: (len(s), top(d)) for d, s in sets.items()}
