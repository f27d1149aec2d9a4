"""All pairs of two blocks of weighted sets, compared exactly inside a task.

Sets are ragged arrays of element hashes, each set's elements distinct and an
element's weight the same in every set.  Shared elements become columns of dense
matrices, COLUMNS at a time, so memory is bounded by the rows of a block.
"""

from __future__ import annotations

import numpy as np

COLUMNS = 4096


def gather(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the elements of rows, and the position in rows that each belongs to."""
    n = np.diff(starts)[rows]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - n, n) + np.repeat(starts[:-1][rows], n), np.repeat(np.arange(len(rows)), n)


def shared_weight(s: np.ndarray, w: np.ndarray, starts: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weight of the elements that row x of left and row y of right have in common."""
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    (a, of_a), (b, of_b) = gather(starts, left), gather(starts, right)
    if np.array_equal(left, right):
        u, n = np.unique(s[a], return_counts=True)
        u = u[n > 1]
    else:
        u = np.intersect1d(s[a], s[b])
    if not len(u):
        return both
    sides = []
    for at, row in ((a, of_a), (b, of_b)):
        code = np.minimum(np.searchsorted(u, s[at]), len(u) - 1)
        some = np.flatnonzero(u[code] == s[at])
        some = some[np.argsort(code[some], kind="stable")]
        sides.append((code[some], row[some], np.sqrt(w[at[some]])))
    for k in range(0, len(u), COLUMNS):
        width = min(COLUMNS, len(u) - k)
        dense = []
        for (code, row, root), rows in zip(sides, (left, right), strict=True):
            x, y = np.searchsorted(code, [k, k + width])
            m = np.zeros((len(rows), width), dtype=np.float32)
            m[row[x:y], code[x:y] - k] = root[x:y]
            dense.append(m)
        both += dense[0] @ dense[1].T
    return both


def similarities(s: np.ndarray, w: np.ndarray, starts: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weighted Jaccard of every row of left with every row of right; 1 for two empty sets."""
    both = shared_weight(s, w, starts, left, right)
    upto = np.concatenate([[0], np.cumsum(w, dtype=np.float64)])
    total = (upto[starts[1:]] - upto[starts[:-1]]).astype(np.float32)
    union = total[left][:, None] + total[right][None]
    union -= both
    empty = union <= 0
    union[empty] = both[empty] = 1
    both /= union
    return both


def joining(hits: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs (x, y) that hits marks, those that join labels which no pair before them joined."""
    root: dict[int, int] = {}

    def of(n: int) -> int:
        while root.get(n, n) != n:
            root[n] = n = root.get(root[n], root[n])
        return n

    out = []
    for x in np.flatnonzero(hits.any(axis=1)).tolist():
        y = np.flatnonzero(hits[x])
        _, first = np.unique(right[y], return_index=True)
        for k in y[first].tolist():
            a, b = of(int(left[x])), of(int(right[k]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((x, k))
    return out
