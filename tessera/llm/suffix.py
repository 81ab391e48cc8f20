"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are classified as S or L, the leftmost-smaller substrings are sorted by induction and named, the string of names
is sorted in the same way, level by level, and the whole array is induced from it. An induction is one linear scan of the
array, carried out in strides: what stands before the first place that a stride itself fills is final, and induces its
predecessors together; where strides get short, places are scanned one by one.
"""

from __future__ import annotations

import numpy as np

#: Widest stride of a scan, the stride under which places are scanned singly, and how many then are.
WIDEST, SHORT, SINGLY = 1 << 18, 24, 512


def _scan(v: np.ndarray, t: np.ndarray, wanted: np.ndarray, at: np.ndarray) -> None:
    """Induce along ``v``: each suffix put there puts its predecessor, if ``wanted``, at its bucket's next place ``at``."""
    i, width, n = 0, 1024, len(v)
    if len(at) < 1 << 16:
        t = t.astype(np.uint16)  # sorts by digits
    while i < n:
        e = min(n, i + width)
        seg = v[i:e]
        source = np.flatnonzero(seg > 0)
        j = seg[source] - 1
        ok = wanted[j]
        if not ok.any():
            i, width = e, min(2 * width, WIDEST)
            continue
        source, j = source[ok] + i, j[ok]
        signs = t[j]
        order = np.argsort(signs, kind="stable")
        source, j, signs = source[order], j[order], signs[order]
        begins = np.ones(len(signs), bool)
        np.not_equal(signs[1:], signs[:-1], out=begins[1:])
        first = np.flatnonzero(begins)
        size = np.append(first[1:], len(signs)) - first
        target = np.arange(len(signs)) + np.repeat(at[signs[first]] - first, size)
        stop = int(target.min())
        if stop >= e:
            v[target] = j
            at[signs[first]] += size
            i, width = e, min(2 * width, WIDEST)
            continue
        final = source < stop  # in each bucket a prefix, since sources ascend there
        v[target[final]] = j[final]
        at[signs[first]] += np.add.reduceat(final, first, dtype=np.int64)
        width = max(64, 2 * (stop - i))
        if stop - i >= SHORT:
            i = stop
            continue
        i, end = stop, min(n, stop + SINGLY)
        while i < end:
            s = v[i]
            if s > 0 and wanted[s - 1]:
                c = t[s - 1]
                v[at[c]] = s - 1
                at[c] += 1
            i += 1


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, signs: int) -> np.ndarray:
    """The array induced from leftmost-smaller suffixes in the order given; ``t`` ends in its only, least sign."""
    n = len(t)
    count = np.bincount(t, minlength=signs)
    end = np.cumsum(count)
    sa = np.full(n, -1, np.int32)
    # the given suffixes go, in order, to the ends of their buckets
    begins = t[lms]
    order = np.argsort(begins, kind="stable")
    held = np.bincount(begins, minlength=signs)
    sorted_begins = begins[order]
    rank = np.arange(len(lms)) - (np.cumsum(held) - held)[sorted_begins]
    places = (end - held)[sorted_begins] + rank
    sa[places] = lms[order]
    _scan(sa, t, ~small, end - count)
    sa[places] = -1  # they, too, are induced by the way back
    sa[0] = n - 1
    _scan(sa[::-1], t, small, n - end)
    return sa


def _sorted(t: np.ndarray, signs: int) -> np.ndarray:
    """Suffix array of ``t``, whose last sign is 0 and occurs nowhere else."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    less, same = t[:-1] < t[1:], t[:-1] == t[1:]
    # a suffix is S where the next different sign is larger; the last suffix is S
    nxt = np.where(same, n, np.arange(n - 1))
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    small = np.append(less[np.minimum(nxt, n - 2)], True)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = _induce(t, small, lms, signs)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    # names: neighbours in the order are compared sign by sign, to the next leftmost-smaller place
    until = np.full(n, n - 1)
    until[lms[:-1]] = lms[1:]
    size = until[order] - order + 1
    differ = np.ones(len(order), bool)
    like = np.flatnonzero(size[1:] == size[:-1]) + 1
    if len(like):
        each = size[like]
        offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        equal = t[np.repeat(order[like], each) + offset] == t[np.repeat(order[like - 1], each) + offset]
        differ[like] = ~np.logical_and.reduceat(equal, np.cumsum(each) - each)
    names = np.cumsum(differ) - 1
    if names[-1] + 1 < len(order):
        by_place = np.empty(n, np.int32)
        by_place[order] = names
        order = lms[_sorted(by_place[lms], int(names[-1]) + 1)]
    return _induce(t, small, order, signs)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Start of each suffix of ``data`` (uint8) in sorted order."""
    if not len(data):
        return np.zeros(0, np.int64)
    t = np.zeros(len(data) + 1, np.int32)  # a shard is far smaller than 2**31
    t[:-1] = data
    t[:-1] += 1
    return _sorted(t, 257)[1:]


def permuted_lcp(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place the length of the longest common prefix with the suffix before it in sorted order.

    A value is compared out only where the signs before the two suffixes differ; elsewhere it is one less than its
    left neighbour's.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    own = np.ones(n, bool)
    own[1:] = (before[1:] <= 0) | (data[place[1:] - 1] != data[before[1:] - 1])
    own &= before >= 0
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), shape=(n + 8, 8), strides=(1, 1))
    i = np.flatnonzero(own)
    lcp = np.zeros(n, np.int64)
    a, b = i.copy(), before[i]
    while len(i):
        room = np.minimum(8, n - np.maximum(a, b))
        x = np.ascontiguousarray(words[np.minimum(a, n)]).view(np.uint64)[:, 0]
        y = np.ascontiguousarray(words[np.minimum(b, n)]).view(np.uint64)[:, 0]
        z = x ^ y
        low = z & (~z + np.uint64(1))
        same = np.where(z == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64)) >> 3)
        same = np.minimum(same, room)
        lcp[i] += same
        on = same == 8
        i, a, b = i[on], a[on] + 8, b[on] + 8
    reach = np.where(own, lcp + place, 0)
    out = np.maximum.accumulate(reach) - place
    out[before < 0] = 0
    return np.maximum(out, 0)
