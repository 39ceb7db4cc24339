"""Suffix arrays of byte strings by induced sorting, in numpy: buckets are scanned in order, a whole wave at a time."""

from __future__ import annotations

import numpy as np


def classified(t: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than their right neighbour. The last symbol must be the only smallest."""
    n = len(t)
    small = np.zeros(n, bool)
    small[-1] = True
    # each position takes the answer of the next position whose right neighbour differs
    nxt = np.where(t[:-1] != t[1:], np.arange(n - 1, dtype="int32" if n < 2**31 else "int64"), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    small[:-1] = t[nxt] < t[nxt + 1]
    return small


def _dealt(at: np.ndarray, t: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Appends positions to the buckets of their symbols, keeping their order."""
    sym = t[at]
    order = np.argsort(sym, kind="stable")
    sym, at = sym[order], at[order]
    cuts = [0, *(np.flatnonzero(sym[1:] != sym[:-1]) + 1).tolist(), len(at)]
    for a, b in zip(cuts, cuts[1:]):
        buckets[sym[a]].append(at[a:b])


def _pass(t: np.ndarray, small: np.ndarray, seeds: list[list[np.ndarray]], up: bool) -> list[list[np.ndarray]]:
    """One scan over the buckets: from seeds (and what is induced on the way) to the suffixes of the other class.

    up: ascending scan that induces larger-class suffixes; otherwise a descending scan that induces smaller-class ones,
    whose buckets then hold their parts in descending order.
    """
    sigma = len(seeds)
    out: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    for c in range(sigma) if up else range(sigma - 1, -1, -1):
        done = 0
        while True:
            wave = out[c][done:]
            done = len(out[c])
            last = not wave
            if last:
                wave = seeds[c]
            if wave:
                w = wave[0] if len(wave) == 1 else np.concatenate(wave)
                w = w[w > 0] - 1
                w = w[~small[w]] if up else w[small[w]]
                if len(w):
                    _dealt(w, t, out)
            if last:
                break
    return out


def _induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes from the leftmost-smaller ones in the given order."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    _dealt(lms, t, seeds)
    large = _pass(t, small, seeds, True)
    down = [[p[::-1] for p in reversed(b)] for b in large]
    less = _pass(t, small, down, False)
    less[0] = less[0] or [np.array([len(t) - 1], lms.dtype)]  # the end itself has no right neighbour that would induce it
    parts = [p for c in range(sigma) for p in (*large[c], *(q[::-1] for q in reversed(less[c])))]
    return np.concatenate(parts)


def _names(t: np.ndarray, small: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings, in text order; equal substrings have equal names."""
    rank = np.zeros(len(t), lms.dtype)
    rank[lms] = np.arange(len(lms), dtype=lms.dtype)
    end = np.append(lms[1:], len(t) - 1)
    a, b = order[:-1], order[1:]
    size = end[rank[a]] - a
    new = size != end[rank[b]] - b
    live, k = np.flatnonzero(~new), 0
    while len(live):
        bad = t[a[live] + k] != t[b[live] + k]
        new[live[bad]] = True
        live = live[~bad]
        live = live[size[live] > k]
        k += 1
    name = np.empty(len(lms), "int64")
    name[rank[order]] = np.concatenate([[0], np.cumsum(new)])
    return name


def _sorted_names(name: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes of the string of names, by their first ``most`` names at least: names of neighbours are
    joined to names of twice the span, again and again, until all differ."""
    n, span = len(name), 1
    while True:
        right = np.zeros(n, "int64")
        right[: n - span] = name[span:] + 1
        key = name * (n + 1) + right
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        name = np.empty(n, "int64")
        name[order] = new
        span *= 2
        if new[-1] == n - 1 or span >= most or span >= n:
            return order


def suffix_array(data: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of all suffixes of a byte string in order. With ``depth``, suffixes that agree on that many bytes may
    stand in any order among each other."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    t = np.append(data.astype("int16") + 1, np.int16(0))
    small = classified(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype("int32" if n < 2**31 - 2 else "int64")
    sa = _induced(t, small, lms, 257)
    leftmost = np.zeros(n + 1, bool)
    leftmost[lms] = True
    order = sa[leftmost[sa]]
    if len(lms) > 1:
        name = _names(t, small, lms, order)
        if name.max() < len(lms) - 1:
            # each leftmost-smaller substring but the last takes two bytes or more
            order = lms[_sorted_names(name, len(lms) if depth is None else depth // 2 + 2)]
        sa = _induced(t, small, order, 257)
    return sa[1:]


def permuted_prefixes(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Of each position, the bytes (up to ``most``) that its suffix shares with the one ranked before it: the permuted common
    prefixes, found in text order, as text positions are neighbours in memory."""
    n = len(data)
    before = np.full(n, -1, "int64")
    before[sa[1:]] = sa[:-1]
    room = np.minimum(n - np.maximum(np.arange(n), before), most)  # neither suffix has more bytes
    out = np.zeros(n, "int64")
    at, words, k = np.flatnonzero(before >= 0), eight(data), 0
    while len(at):
        differ = words[at + k] ^ words[before[at] + k]
        low = differ & (~differ + np.uint64(1))  # the lowest differing bit tells the first differing byte
        bytes_ = np.where(differ == 0, 8, np.searchsorted(_BYTES, low, "right") - 1)
        out[at] = np.minimum(k + bytes_, room[at])
        k += 8
        at = at[(differ == 0) & (room[at] > k)]
    return out


_BYTES = np.uint64(1) << np.arange(0, 64, 8, dtype="uint64")


def permuted_repeats(data: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For each rank, whether its suffix shares ``length`` bytes with the one ranked before."""
    return permuted_prefixes(data, sa, length)[sa] >= length


def eight(data: np.ndarray) -> np.ndarray:
    """Each position's next eight bytes as one number, zeros beyond the end."""
    v = data.astype("uint64")
    for k in (1, 2, 4):
        v[: max(0, len(v) - k)] |= v[k:] << np.uint64(8 * k)
    return v
