"""Plain versions of operators, for small tables."""

from __future__ import annotations

import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near_groups(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (number of shingles, component), from all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            a, b = sets[x], sets[y]
            if 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 4 * len(a & b) >= 3 * len(a | b):
                p, q = find(x), find(y)
                top[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[int]:
    """Bins of (size, source, cluster) in order: of the bins that fit and hold neither, the fullest, of equal ones the oldest."""
    bins: list[list] = []
    out = []
    for size, source, cluster in items:
        fit = [(b[0], k) for k, b in enumerate(bins) if b[0] >= size and source not in b[1] and cluster not in b[2]]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([capacity, set(), set()])
        bins[k][0] -= size
        bins[k][1].add(source)
        bins[k][2].add(cluster)
        out.append(k)
    return out
