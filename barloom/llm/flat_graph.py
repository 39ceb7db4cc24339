"""A robust-pruned flat proximity graph over unit vectors, built and searched in numpy for many queries at once."""

from __future__ import annotations

import numpy as np

DEGREE, BEAM, ALPHA = 24, 48, 1.2


def greedy(x: np.ndarray, adj: np.ndarray, start: int, q: np.ndarray, beam: int = BEAM, wide: int = 4) -> np.ndarray:
    """Greedy beam search of each query from the start node; the best nodes of each beam, -1 where there are fewer."""
    n, m = len(q), len(x)
    seen = np.zeros((n, m), bool)
    seen[:, start] = True
    ids, sims, done = np.full((n, beam), -1), np.full((n, beam), -3.0, "float32"), np.ones((n, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = start, q @ x[start], False
    live = np.arange(n)
    while len(live):
        # beams are sorted, so the first open entries are the best
        rank = np.cumsum(~done[live], 1)
        pick = ~done[live] & (rank <= wide)
        live = live[pick.any(1)]
        pick = pick[pick.any(1)]
        if not len(live):
            break
        done[live] |= pick
        at = np.argsort(~pick, 1, kind="stable")[:, :wide]
        node = np.where(np.take_along_axis(pick, at, 1), np.take_along_axis(ids[live], at, 1), -1)
        nb = np.where(node[:, :, None] >= 0, adj[node], -1).reshape(len(live), -1)
        nb.sort(1)
        ok = nb >= 0
        ok[:, 1:] &= nb[:, 1:] != nb[:, :-1]
        ok &= ~seen[live[:, None], nb]
        r, k = np.nonzero(ok)
        seen[live[r], nb[r, k]] = True
        s = np.full(nb.shape, -3.0, "float32")
        s[r, k] = np.einsum("ij,ij->i", q[live[r]], x[nb[r, k]])
        i2, s2 = np.concatenate([ids[live], np.where(ok, nb, -1)], 1), np.concatenate([sims[live], s], 1)
        d2 = np.concatenate([done[live], ~ok], 1)
        top = np.argsort(-s2, 1, kind="stable")[:, :beam]
        ids[live], sims[live], done[live] = (np.take_along_axis(z, top, 1) for z in (i2, s2, d2))
    return ids


def robust_prune(x: np.ndarray, p: np.ndarray, cand: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Up to ``degree`` neighbours of each node p from its candidates: the nearest one is kept, and whatever lies
    ``alpha`` times nearer to it than to p goes; again and again."""
    cand = np.sort(cand, 1)
    ok = (cand >= 0) & (cand != p[:, None])
    ok[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    v = x[cand]
    far = 1 - np.einsum("pkd,pd->pk", v, x[p])
    out = np.full((len(p), degree), -1)
    rows = np.arange(len(p))
    for r in range(degree):
        near = np.where(ok, far, 9.0)
        j = near.argmin(1)
        some = near[rows, j] < 9
        if not some.any():
            break
        out[some, r] = cand[rows, j][some]
        between = 1 - np.einsum("pkd,pd->pk", v, v[rows, j])
        ok &= ~((alpha * between <= far) & some[:, None])
        ok[rows, j] = False
    return out


def _linked_back(x: np.ndarray, adj: np.ndarray, p: np.ndarray) -> None:
    """Adds p to the lists of its neighbours, pruning lists that overflow."""
    a, r = np.nonzero(adj[p] >= 0)
    to, frm = adj[p][a, r], p[a]
    order = np.argsort(to, kind="stable")
    to, frm = to[order], frm[order]
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, "int64")
    count = np.diff(np.r_[first, len(to)])
    for some in np.array_split(np.argsort(count, kind="stable"), max(1, len(count) // 256)):
        if not len(some):
            continue
        new = np.full((len(some), count[some].max()), -1)
        for i, f in enumerate(some):
            new[i, : count[f]] = frm[first[f] : first[f] + count[f]]
        node = to[first[some]]
        adj[node] = robust_prune(x, node, np.concatenate([adj[node], new], 1))


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> np.ndarray:
    """Neighbour lists (-1 padded) of all rows: nodes are inserted in doubling batches, then all are searched and
    pruned once more in the full graph."""
    m = len(x)
    adj = np.full((m, degree), -1)
    if m < 2:
        return adj
    start = medoid(x)
    order = np.random.default_rng(m).permutation(m)
    order = np.r_[start, order[order != start]]
    at, batches = 1, []
    while at < m:
        end = min(m, at * 2, at + 256)
        batches.append(order[at:end])
        at = end
    batches += [order[i : i + 256] for i in range(0, m, 256)]
    for p in batches:
        found = greedy(x, adj, start, x[p], beam)
        adj[p] = robust_prune(x, p, np.concatenate([found, adj[p]], 1))
        _linked_back(x, adj, p)
    extra = _islands(adj, start)
    wide = np.full((m, len(extra)), -1)
    wide[start] = extra
    return np.concatenate([adj, wide], 1)


def _islands(adj: np.ndarray, start: int) -> list[int]:
    """A node of each part of the graph that can't be reached from the start: tight groups keep their lists to
    themselves. The start gets an edge to each."""
    seen, extra, front = np.zeros(len(adj), bool), [], np.array([start])
    while True:
        while len(front):
            seen[front] = True
            nb = np.unique(adj[front])
            front = nb[nb >= 0]
            front = front[~seen[front]]
        if seen.all():
            return extra
        extra.append(int(seen.argmin()))
        front = np.array(extra[-1:])


def in_range(x: np.ndarray, exact: np.ndarray, adj: np.ndarray, q: np.ndarray, exact_q: np.ndarray, least: float, slack: float = 0.02) -> np.ndarray:
    """(query, node) matrix of the nodes found at a similarity of ``least`` or more, confirmed on the exact vectors.

    A greedy search from the medoid finds the first ones; then the range is expanded: neighbours of all nodes within
    ``least - slack`` are looked at until none is new.
    """
    n, m = len(q), len(x)
    out = np.zeros((n, m), bool)
    step = np.zeros((m, m), "float32")
    a, k = np.nonzero(adj >= 0)
    step[a, adj[a, k]] = 1
    start = medoid(x)
    for at in range(0, n, 512):
        found = greedy(x, adj, start, q[at : at + 512])
        r, k = np.nonzero(found >= 0)
        seen = np.zeros((len(found), m), bool)
        new = np.zeros_like(seen)
        new[r, found[r, k]] = True
        while new.any():
            seen |= new
            front = np.zeros_like(seen)
            r, v = np.nonzero(new)
            for b in range(0, len(r), 100_000):
                i, j = r[b : b + 100_000], v[b : b + 100_000]
                s = np.einsum("ij,ij->i", exact_q[at + i], exact[j])
                out[at + i, j] = s >= least
                front[i, j] = s >= least - slack
            rows = np.flatnonzero(front.any(1))
            new = np.zeros_like(seen)
            if len(rows):
                new[rows] = front[rows].astype("float32") @ step > 0
            new &= ~seen
    return out
