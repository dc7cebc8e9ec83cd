"""Exact pair work inside bounded blocks: intersections, agreements and local components, in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Groups of up to so many members are handled together; larger ones as matrices, one at a time.
SMALL = 12
#: Columns of a membership matrix at once.
COLUMNS = 4096


def local_labels(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Smallest member index of every member's component under the links p-q."""
    label = np.arange(n)
    while len(p):
        least = np.minimum(label[p], label[q])
        before = label.copy()
        np.minimum.at(label, p, least)
        np.minimum.at(label, q, least)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def small_pairs(starts: np.ndarray, sizes: np.ndarray, own: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All member pairs of the groups given; in a group marked ``cross`` only those from different blocks."""
    p, q = [], []
    for size in np.unique(sizes):
        if size < 2:
            continue
        i, j = np.triu_indices(size, 1)
        s = starts[sizes == size]
        p.append((s[:, None] + i).ravel())
        q.append((s[:, None] + j).ravel())
    if not p:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, q = np.concatenate(p), np.concatenate(q)
    keep = ~cross[p] | (own[p] != own[q])
    return p[keep], q[keep]


def group_pairs(starts: np.ndarray, n: int, own: np.ndarray, cross: np.ndarray, similar: Callable[[np.ndarray, np.ndarray], np.ndarray], matrix: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of the same group that pass.

    ``similar(p, q)`` says it for index pairs, ``matrix(rows, columns)`` for a
    block of them; the latter serves groups of more than SMALL members.
    """
    sizes = np.diff(np.append(starts, n))
    small = sizes <= SMALL
    p, q = small_pairs(starts[small], sizes[small], own, cross)
    if len(p):
        ok = similar(p, q)
        p, q = p[ok], q[ok]
    found = [(p, q)]
    for s, size in zip(starts[~small], sizes[~small]):
        members = np.arange(s, s + size)
        if cross[s]:
            low = own[s : s + size] == own[s : s + size].min()
            rows, columns = members[low], members[~low]
            i, j = np.nonzero(matrix(rows, columns)) if len(columns) else (np.zeros(0, int), np.zeros(0, int))
        else:
            rows = columns = members
            i, j = np.nonzero(np.triu(matrix(rows, columns), 1))
        found.append((rows[i], columns[j]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def set_intersections(sh: np.ndarray, at: np.ndarray) -> tuple[Callable, Callable]:
    """Intersection sizes of the members' sets, for index pairs and for blocks."""

    def by_pair(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        for k in range(len(p)):
            a, b = sh[at[p[k]] : at[p[k] + 1]], sh[at[q[k]] : at[q[k] + 1]]
            if len(a) > len(b):
                a, b = b, a
            if len(a):
                i = np.searchsorted(b, a)
                out[k] = np.count_nonzero(b[np.minimum(i, len(b) - 1)] == a)
        return out

    def by_block(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        def gathered(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.concatenate([sh[at[m] : at[m + 1]] for m in members]), np.repeat(np.arange(len(members)), at[members + 1] - at[members])

        (a, of_a), (b, of_b) = gathered(rows), gathered(columns)
        shared = np.intersect1d(a, b)
        out = np.zeros((len(rows), len(columns)), np.float32)
        if not len(shared):
            return out.astype(np.int64)
        places = []
        for v, of in ((a, of_a), (b, of_b)):
            i = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
            hit = shared[i] == v
            places.append((i[hit], of[hit]))
        for c in range(0, len(shared), COLUMNS):
            parts = []
            for (i, of), n in zip(places, (len(rows), len(columns))):
                inside = (i >= c) & (i < c + COLUMNS)
                m = np.zeros((n, min(COLUMNS, len(shared) - c)), np.float32)
                m[of[inside], i[inside] - c] = 1
                parts.append(m)
            out += parts[0] @ parts[1].T
        return np.rint(out).astype(np.int64)

    return by_pair, by_block
