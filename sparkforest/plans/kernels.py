"""Graph kernels on numpy arrays, for graphs that fit one task; the operators give the same answers by rounds of joins beyond."""

from __future__ import annotations

import numpy as np


def dense(*columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(ids ascending, the columns as positions in them)."""
    ids, at = np.unique(np.concatenate(columns) if columns else np.empty(0, np.int64), return_inverse=True)
    ends = np.cumsum([len(c) for c in columns])[:-1]
    return ids, [np.asarray(x) for x in np.split(at, ends)]


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest position in each position's component: min-hooking of roots and pointer jumping."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        cross = a != b
        if not cross.any():
            return label
        u, v, a, b = u[cross], v[cross], a[cross], b[cross]
        low = np.minimum(a, b)
        np.minimum.at(label, np.maximum(a, b), low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def jump(parent: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, sum of the weights from the vertex up to the root's child); a root's own weight counts nothing."""
    total = np.where(parent == np.arange(len(parent)), 0, weight)
    up = parent.copy()
    for _ in range(64):
        new = up[up]
        total = total + total[up]
        if (new == up).all():
            if (parent[up] != up).any():
                break
            return up, total
        up = new
    raise ValueError("the parents have a cycle")


def breadth_first(n: int, u: np.ndarray, v: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, level); parent is the smallest neighbour one level up, a root's its own; level -1 and parent itself where unreached."""
    src, dst = np.concatenate((u, v)), np.concatenate((v, u))
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    first = np.searchsorted(src, np.arange(n + 1))
    parent, level = np.arange(n), np.full(n, -1)
    level[roots] = 0
    front, depth = np.sort(roots), 0
    while len(front):
        size = first[front + 1] - first[front]
        at = np.repeat(first[front] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        to, by = dst[at], np.repeat(front, size)
        fresh = level[to] < 0
        to, by = to[fresh], by[fresh]
        # The front is ascending, so the first to reach a vertex is its smallest neighbour above.
        front, which = np.unique(to, return_index=True)
        depth += 1
        parent[front], level[front] = by[which], depth
    return parent, level


def depth_first(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, preorder number over all trees) of the depth-first search from every component's smallest position; neighbours are pushed in ascending order and the vertex that pushed last is the parent."""
    src, dst = np.concatenate((u, v)), np.concatenate((v, u))
    order = np.lexsort((dst, src))
    first = np.searchsorted(src[order], np.arange(n + 1))
    parent, number = np.arange(n), np.full(n, -1)
    descend(first, dst[order], first[1:].copy(), parent, number)
    return parent, number


def descend(first: np.ndarray, dst: np.ndarray, left: np.ndarray, parent: np.ndarray, number: np.ndarray) -> None:
    """The search of depth_first, which fills ``parent`` and ``number`` (from -1). The neighbours of x are dst[first[x]:first[x + 1]], ascending, of
    which the last are taken first; ``left`` starts as first[1:] and holds how far each vertex has come.

    The way back goes along the parents, so nothing but these arrays is held, and they may lie on disk. Bigints all, without gaps.
    """
    first, dst, left, parent, number = (memoryview(x) for x in (first, dst, left, parent, number))
    k = 0
    for r in range(len(number)):
        if number[r] >= 0:
            continue
        x, parent[r], number[r] = r, r, k
        k += 1
        while True:
            at, low = left[x], first[x]
            while at > low:
                at -= 1
                y = dst[at]
                if number[y] < 0:
                    left[x], parent[y], number[y] = at, x, k
                    k += 1
                    x = y
                    break
            else:
                left[x] = low
                if x == r:
                    break
                x = parent[x]


def subtree(parent: np.ndarray, value: np.ndarray, fold: np.ufunc) -> np.ndarray:
    """fold (np.add, np.minimum or np.maximum) of the values in each vertex' subtree, by doubling."""
    n = len(parent)
    out, up = value.copy(), parent.copy()
    real = up != np.arange(n)
    while real.any():
        carried = out[real].copy()
        new = out.copy()
        fold.at(new, up[real], carried)
        out = new
        # Twice the jump exists where the ancestor can jump as far again.
        real = real & real[up]
        up = up[up]
    return out


def least_forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The positions of the edges of the spanning forest that the edges' order makes smallest: every tree takes its first outgoing edge, all at once."""
    taken = np.empty(0, np.int64)
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        cross = np.flatnonzero(a != b)
        if not len(cross):
            return np.sort(taken)
        first = np.full(n, len(u))
        np.minimum.at(first, a[cross], cross)
        np.minimum.at(first, b[cross], cross)
        taken = np.unique(np.concatenate((taken, first[first < len(u)])))
        label = components(n, u[taken], v[taken])


def _pair_keys(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b) * np.int64(n) + np.maximum(a, b)


def repair(n: int, parent: np.ndarray, u: np.ndarray, v: np.ndarray, dead_u: np.ndarray, dead_v: np.ndarray) -> np.ndarray:
    """The parents after the edges dead_u, dead_v are gone and the fragments are joined again through the edges u, v.

    The same answer as the composition of operators.contract and operators.reroot: fragments are named by their roots, the
    smallest edge joins two fragments, their forest is breadth-first from the smallest fragment of each component.
    """
    every = np.arange(n)
    parent = parent.copy()
    child = every[parent != every]
    gone = child[np.isin(_pair_keys(n, child, parent[child]), _pair_keys(n, dead_u, dead_v))]
    parent[gone] = gone
    root, _ = jump(parent, np.zeros(n, dtype=np.int64))
    ru, rv = root[u], root[v]
    cross = ru != rv
    u, v, ru, rv = u[cross], v[cross], ru[cross], rv[cross]
    if not len(u):
        return parent
    turn = ru > rv
    a, b = np.where(turn, rv, ru), np.where(turn, ru, rv)
    wa, wb = np.where(turn, v, u), np.where(turn, u, v)
    order = np.lexsort((wb, wa, b, a))
    a, b, wa, wb = a[order], b[order], wa[order], wb[order]
    first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    a, b, wa, wb = a[first], b[first], wa[first], wb[first]
    frags, (x, y) = dense(a, b)
    label = components(len(frags), x, y)
    above, _ = breadth_first(len(frags), x, y, np.unique(label))
    below = np.flatnonzero(above != np.arange(len(frags)))
    keys = x * np.int64(len(frags)) + y
    at = np.searchsorted(keys, _pair_keys(len(frags), below, above[below]))
    low = below < above[below]
    start, onto = np.where(low, wa[at], wb[at]), np.where(low, wb[at], wa[at])
    # All paths are walked up together; they lie in different fragments.
    new, now = parent.copy(), start
    while len(now):
        up = parent[now]
        on = up != now
        now, up = now[on], up[on]
        new[up] = now
        now = up
    new[start] = onto
    return new
