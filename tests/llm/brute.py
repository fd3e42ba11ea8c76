"""Plain restatements of what the operators compute, for comparison on small tables."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, n: int = 5, lower: bool = True) -> set[tuple[str, ...]]:
    w = WORD.findall(ascii_lower(text or "") if lower else text or "")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_components(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    """doc_id -> smallest reachable doc_id, over links of Jaccard 0.75 or more, by comparing all pairs that share a shingle."""
    sets: dict[int, list[set]] = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    having: dict[tuple, list] = {}
    for i, group in sets.items():
        for s in group:
            for x in s:
                having.setdefault(x, []).append((i, s))
    done = set()
    for group in having.values():
        for k, (i, s) in enumerate(group):
            for j, t in group[:k]:
                if (id(s), id(t)) not in done:
                    done.add((id(s), id(t)))
                    if 100 * len(s & t) >= 75 * len(s | t):
                        a, b = sorted((root(i), root(j)))
                        parent[b] = a
    return {i: root(i) for i in sets}
