"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Symbols are small integers.  Suffixes are classified as S or L; leftmost
S positions ("leftmost-smaller") are sorted by inducing from their first
symbols, named, ordered among themselves through the string of names, and a
second pass induces the whole array from them.  An induction scans the buckets
in order; all entries of a bucket that are known are handled as one vector, so
a bucket takes as many steps as its symbol repeats in a row.

The string of names is shorter (a third as a rule) and goes through the same
function while it has at most ``SMALL`` distinct names; with more, a bucket
scan would take one step for each name, and its suffixes are ordered by rank
doubling instead, restricted to those still tied.
"""

from __future__ import annotations

import numpy as np

SMALL = 4096


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is S type; the last one is L (an end smaller than
    all symbols follows)."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    out = np.zeros(n, bool)
    if len(change):
        rises = t[change + 1] > t[change]
        lengths = np.diff(np.concatenate([[-1], change]))
        out[: change[-1] + 1] = np.repeat(rises, lengths)
    return out


def _induce(t: np.ndarray, stype: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The array induced from ``lms``, leftmost S positions in bucket order."""
    n, k = len(t), len(size)
    ends = np.cumsum(size)
    starts = ends - size
    sa = np.full(n, -1, np.int64)
    lcount = np.bincount(t[~stype], minlength=k)
    seeds = np.bincount(t[lms], minlength=k)
    seed_at = np.concatenate([[0], np.cumsum(seeds)])
    after_l, after_s = np.zeros(n, bool), np.zeros(n, bool)  # types of the suffixes one longer
    after_l[1:], after_s[1:] = ~stype[:-1], stype[:-1]

    def put(j: np.ndarray, free: np.ndarray, sign: int) -> None:
        """Place suffixes j, in order, at the free ends of their buckets."""
        c = t[j]
        order = np.argsort(c, kind="stable")
        j, c = j[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        many = np.diff(np.append(first, len(c)))
        sa[np.repeat(free[c[first]] - sign * first, many) + sign * np.arange(len(c))] = j
        free[c[first]] += sign * many

    free = starts.copy()  # next place for an L suffix
    if not stype[n - 1]:
        put(np.array([n - 1]), free, 1)
    for c in np.flatnonzero(size):
        at = starts[c]
        while at < free[c]:
            block = sa[at : free[c]]
            at = free[c]
            j = block[after_l[block]] - 1
            if len(j):
                put(j, free, 1)
        block = lms[seed_at[c] : seed_at[c + 1]]
        if len(block):
            j = block[after_l[block]] - 1
            if len(j):
                put(j, free, 1)
    free = ends - 1  # next place for an S suffix, from the right
    for c in np.flatnonzero(size)[::-1]:
        at = ends[c] - 1
        while at > free[c]:
            block = sa[free[c] + 1 : at + 1][::-1]
            at = free[c]
            j = block[after_s[block]] - 1
            if len(j):
                put(j, free, -1)
        block = sa[starts[c] : starts[c] + lcount[c]][::-1]
        j = block[after_s[block]] - 1  # of smaller buckets, since the block's are L
        if len(j):
            put(j, free, -1)
    return sa


def _sorted(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative keys and values in order of key and value, as one number each where that fits."""
    bits = int(x.max()).bit_length()
    if int(key.max()).bit_length() + bits > 63:
        order = np.lexsort((x, key))
        return key[order], x[order]
    both = np.sort(key << bits | x)
    return both >> bits, both & ((1 << bits) - 1)


def _doubling(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string over many names: ranks of the first 1, 2, 4, ...
    symbols, sorted again only where they tie."""
    n = len(names)
    sa, rank = np.empty(n, np.int64), np.empty(n, np.int64)
    where, x, key = np.arange(n), np.arange(n), np.zeros(n, np.int64)
    bits = (int(names.max()) + 1).bit_length()
    h = max(1, (63 - n.bit_length()) // bits)  # symbols that fit beside a position
    for off in range(h):
        key <<= bits
        key[: max(n - off, 0)] |= names[off:].astype(np.int64) + 1
    while True:
        key, x = _sorted(key, x)
        sa[where] = x
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(x)))
        rank[x] = np.repeat(where[first], sizes)
        tied = np.repeat(sizes > 1, sizes)
        where, x = where[tied], x[tied]
        if not len(x):
            return sa
        after = np.where(x + h < n, rank[np.minimum(x + h, n - 1)] + 1, 0)
        key = rank[x] * (n + 1) + after
        h *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``t`` (non-negative integers) in order."""
    t = np.asarray(t)
    n = len(t)
    if n < 2:
        return np.arange(n)
    top = int(t.max()) + 1
    if top > SMALL:
        return _doubling(t)
    t = t.astype(np.uint16)
    size = np.bincount(t, minlength=top)
    stype = _types(t)
    lms = np.flatnonzero(stype[1:] & ~stype[:-1]) + 1
    if not len(lms):
        return _induce(t, stype, lms, size)
    sa = _induce(t, stype, lms[np.argsort(t[lms], kind="stable")], size)
    m = len(lms)
    place = np.full(n, -1, np.int32)
    place[lms] = np.arange(m)
    order = place[sa]
    order = order[order >= 0].astype(np.int64)
    # name: equal neighbours have equal lengths and symbols up to the next leftmost S;
    # as many symbols as fit are compared as one number
    until = np.append(lms[1:], n - 1) - lms + 1
    bits = top.bit_length()
    held = 63 // bits
    head, live = np.zeros(m, np.int64), np.arange(m)
    for off in range(held):
        live = live[until[live] > off]
        head[live] |= (t[lms[live] + off].astype(np.int64) + 1) << bits * (held - 1 - off)
    a, b = order[:-1], order[1:]
    x, y = head[order], until[order]
    same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    off = held
    live = np.flatnonzero(same & (y[1:] > off))
    while len(live):
        differ = t[lms[a[live]] + off] != t[lms[b[live]] + off]
        same[live[differ]] = False
        off += 1
        live = live[~differ]
        live = live[until[a[live]] > off]
    # the last one ends at the end of the string, like no other
    same &= (a != m - 1) & (b != m - 1)
    names = np.empty(m, np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    lms_sorted = lms[suffix_array(names) if int(names.max()) + 1 < m else order]
    return _induce(t, stype, lms_sorted[np.argsort(t[lms_sorted], kind="stable")], size)


def permuted_lcp(data: np.ndarray, sa: np.ndarray, room: np.ndarray, cap: int, step: int = 32, least: int = 1) -> np.ndarray:
    """For each position, the length it shares with the suffix before its own
    in order, at most ``cap`` and ``room`` (bytes up to where matches end); 0
    where these leave less than ``least``.

    Of a run of positions every ``step``-th is compared from scratch, 8 bytes at
    a time; the others start one below what the position before them shares.
    ``data`` are bytes (uint8)."""
    n = len(sa)
    out = np.zeros(n, np.int64)
    wide = (room >= least)[sa]
    wide = np.flatnonzero(wide[1:] & wide[:-1])
    phi = np.full(n, -1, np.int64)
    phi[sa[wide + 1]] = sa[wide]
    i = np.flatnonzero(phi >= 0)
    if not len(i):
        return out
    phi = phi[i]
    limit = np.minimum(cap, np.minimum(room[i], room[phi]))
    padded = np.concatenate([data, np.zeros(cap + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = np.ascontiguousarray(words).view("<u8")[:, 0]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1] + 1]))
    turn = ((np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))) % step).astype(np.uint16)
    order = np.argsort(turn, kind="stable")
    shared = np.zeros(len(i), np.int64)
    for r, k in enumerate(np.split(order, np.cumsum(np.bincount(turn))[:-1])):
        x, y, most = i[k], phi[k], limit[k]
        at = np.maximum(shared[k - 1] - 1, 0) if r else np.zeros(len(k), np.int64)
        live = np.flatnonzero(at < most)
        while len(live):
            differ = words[x[live] + at[live]] ^ words[y[live] + at[live]]
            whole = differ == 0
            low = differ & (~differ + np.uint64(1))
            at[live] += np.where(whole, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
            live = live[whole]
            live = live[at[live] < most[live]]
        shared[k] = np.minimum(at, most)
    out[i] = shared
    return out
