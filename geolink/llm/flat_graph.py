"""A robust-pruned flat graph over unit vectors, and range-expanding greedy search in it.

Nothing here compares all pairs: nodes are inserted in growing batches, each
finds its candidates by a greedy search of the graph so far, and a search holds
what it has visited per query, for a block of queries at a time.
"""

from __future__ import annotations

import numpy as np

#: Kept neighbours and the most a list may hold, pruning slack, entry medoids.
DEGREE, WIDTH, SLACK, MEDOIDS = 12, 32, 1.2, 12
#: Beam while building and while searching; queries searched at a time; the first batch.
BUILD_BEAM, BEAM, QUERIES, FIRST = 24, 12, 256, 32
#: Single-precision hits within this of the threshold are verified.
NEAR = 1e-3


def medoids(x: np.ndarray) -> np.ndarray:
    """The node nearest to the mean of the shard and of each of a few cells of it."""
    cells = (x @ x[np.linspace(0, len(x) - 1, min(MEDOIDS, len(x))).astype(int)].T).argmax(axis=1)
    out = [int((x @ x.mean(axis=0)).argmax())]
    for c in np.unique(cells):
        at = np.flatnonzero(cells == c)
        out.append(int(at[(x[at] @ x[at].mean(axis=0)).argmax()]))
    return np.unique(out)


def padded(row: np.ndarray, value: np.ndarray, rows: int, blank) -> np.ndarray:
    """Values as a matrix, one line a row number (sorted), blanks behind."""
    count = np.bincount(row, minlength=rows)
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    out = np.full((rows, max(1, count.max(initial=0))), blank, dtype=value.dtype)
    out[row, np.arange(len(row)) - start[row]] = value
    return out


def greedy(x: np.ndarray, lists: np.ndarray, asked: np.ndarray, enter: np.ndarray, beam: int, threshold: float = np.inf) -> tuple[np.ndarray, ...]:
    """Search for the nodes ``asked``: (beam's nodes, their similarities, query numbers, nodes in range of them).

    Opens the best unopened node of a query's beam, and every node in range,
    until none is left.  Nodes in range need no place in the beam.
    """
    n, b = len(x), len(asked)
    rows = np.arange(b)
    seen = np.zeros((b, n), dtype=bool)
    seen[rows, asked] = True
    node = np.full((b, beam), -1)
    near = np.full((b, beam), -2, dtype=np.float32)
    opened = np.ones((b, beam), dtype=bool)
    hit_q, hit_t = [], []

    def visit(q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take in nodes not seen; those in range are returned, the others compete for the beam."""
        nonlocal node, near, opened
        on = (t >= 0) & ~seen[q, t]
        key = np.unique(q[on] * n + t[on])
        q, t = key // n, key % n
        seen[q, t] = True
        s = np.einsum("ij,ij->i", x[asked[q]], x[t])
        hit = s >= threshold - NEAR
        hit_q.append(q[hit])
        hit_t.append(t[hit])
        who, back = np.unique(q[~hit], return_inverse=True)
        if len(who):
            new = padded(back, t[~hit], len(who), -1)
            all_node = np.concatenate([node[who], new], axis=1)
            all_near = np.concatenate([near[who], padded(back, s[~hit], len(who), np.float32(-2))], axis=1)
            all_opened = np.concatenate([opened[who], new < 0], axis=1)
            top = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            node[who], near[who], opened[who] = (np.take_along_axis(a, top, axis=1) for a in (all_node, all_near, all_opened))
        return q[hit], t[hit]

    in_range = visit(np.repeat(rows, len(enter)), np.tile(enter, b))
    own = lists[asked]
    more = visit(np.repeat(rows, own.shape[1]), own.ravel())
    wait_q, wait_t = (np.concatenate(pair) for pair in zip(in_range, more, strict=True))
    while True:
        value = np.where(opened, np.float32(-3), near)
        best = value.argmax(axis=1)
        on = np.flatnonzero(value[rows, best] > -3)
        opened[on, best[on]] = True
        q, t = np.concatenate([on, wait_q]), np.concatenate([node[on, best[on]], wait_t])
        if not len(q):
            break
        wait_q, wait_t = visit(np.repeat(q, lists.shape[1]), lists[t].ravel())
    return node, near, np.concatenate(hit_q), np.concatenate(hit_t)


def robust_prune(x: np.ndarray, who: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """For each node its nearest candidates, less those much nearer to one already taken (-1: blank)."""
    near = x[candidates]
    gap = 1 - np.einsum("ijk,ik->ij", near, x[who])  # half the squared distance
    alive = (candidates >= 0) & (candidates != who[:, None])
    rows = np.arange(len(who))
    out = np.full((len(who), degree), -1)
    for k in range(degree):
        best = np.where(alive, gap, np.inf).argmin(axis=1)
        on = alive[rows, best]
        if not on.any():
            break
        pick = candidates[rows, best]
        out[on, k] = pick[on]
        # a candidate much nearer to the pick than to the node is reached through the pick
        alive &= (SLACK * (1 - np.einsum("ijk,ik->ij", near, near[rows, best])) > gap) & (candidates != pick[:, None])
    return out


def _link(x: np.ndarray, lists: np.ndarray, who: np.ndarray, candidates: np.ndarray) -> None:
    """Give nodes pruned lists and enter them in their neighbours' lists, pruning those that overflow."""
    kept = robust_prune(x, who, candidates, DEGREE)
    lists[who] = -1
    lists[who, :DEGREE] = kept
    source, target = np.repeat(who, DEGREE), kept.ravel()
    source, target = source[target >= 0], target[target >= 0]
    to = np.unique(target)
    if not len(to):
        return
    held = lists[to]
    r, c = np.nonzero(held >= 0)
    key = np.unique(np.concatenate([np.searchsorted(to, target) * len(x) + source, r * len(x) + held[r, c]]))
    every = padded(key // len(x), key % len(x), len(to), -1)
    fits = (every >= 0).sum(axis=1) <= WIDTH
    fit = every[fits][:, :WIDTH]
    lists[to[fits]] = -1
    lists[to[fits], : fit.shape[1]] = fit
    over = np.flatnonzero(~fits)
    for a in range(0, len(over), QUERIES):
        at = over[a : a + QUERIES]
        lists[to[at]] = -1
        lists[to[at], : WIDTH // 2] = robust_prune(x, to[at], every[at], WIDTH // 2)


def build(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Neighbour lists (-1: blank) by inserting the nodes in random order, then searching for each once more."""
    n = len(x)
    order = rng.permutation(n)
    lists = np.full((n, WIDTH), -1)
    first = order[:FIRST]
    _link(x, lists, first, np.tile(first, (len(first), 1)))
    for passing in range(2):
        at = len(first) if passing == 0 else 0
        while at < n:
            # a batch finds only what was there before it, so batches grow with the graph
            who = order[at : at + min(QUERIES, max(FIRST, at // 2) if passing == 0 else QUERIES)]
            there = first if passing == 0 else order[:: max(1, n // FIRST)]
            node, _, _, _ = greedy(x, lists, who, there[: FIRST // 2], BUILD_BEAM)
            _link(x, lists, who, np.concatenate([node, lists[who]], axis=1))
            at += len(who)
    return lists


def range_search(x: np.ndarray, lists: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) in range, verified in double precision, found by searching for every node from the medoids."""
    n, low = len(x), x.astype(np.float32)
    enter, keys = medoids(x), []
    for a in range(0, n, QUERIES):
        asked = np.arange(a, min(n, a + QUERIES))
        _, _, q, t = greedy(low, lists, asked, enter, BEAM, threshold)
        keys.append(np.minimum(asked[q], t) * n + np.maximum(asked[q], t))
    i, j = np.divmod(np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64), n)
    ok = np.concatenate([np.einsum("ij,ij->i", x[i[b : b + (1 << 16)]], x[j[b : b + (1 << 16)]]) >= threshold for b in range(0, len(i), 1 << 16)] or [np.zeros(0, bool)])
    return i[ok], j[ok]
