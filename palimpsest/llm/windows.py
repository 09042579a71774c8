"""Array kernels for repeated fixed-length byte windows.

A *window* is the ``size`` bytes that start at a position; it is the suffix of
that position, seen only through its first ``size`` bytes.  Everything here is
vectorised over one document or one block of neighbourhoods.
"""

from __future__ import annotations

import numpy as np

#: Odd, so it is invertible modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Window starts handled at once; also the number of values of the packed position.
_BLOCK_BITS = 17
_BLOCK = 1 << _BLOCK_BITS
_POSITION = np.uint64((1 << _BLOCK_BITS) - 1)
_powers: dict[str, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        step = np.full(max(n, 4096), base, dtype=np.uint64)
        step[0] = 1
        have = _powers[key] = np.multiply.accumulate(step)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes at each position of a uint8 array."""
    n = len(data)
    terms = (data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(terms, out=sums[1:])
    return _mix((sums[k:] - sums[:-k]) * _power_table(_BASE_INVERSE, n - k + 1))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values (two block scans)."""
    n = len(values)
    m = n - width + 1
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])


def anchors(data: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Split all window starts of one document into runs with one anchor each.

    The anchor of a window is its ``k``-byte gram with the least hash (leftmost
    on a tie), which depends on the window's own bytes only: equal windows have
    equal anchors at the same distance.  Returns arrays ``(gram, anchor, lo,
    hi)``: windows that start at ``lo..hi`` (inclusive) share the anchor.
    """
    n = len(data)
    out: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, max(0, n - size + 1), _BLOCK - size):
        piece = data[begin : begin + _BLOCK - size + size - 1]
        if len(piece) < size:
            break
        grams = gram_hashes(piece, k)
        packed = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        at = (sliding_min(packed, size - k + 1) & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        own = at[first]
        out.append((grams[own], own + begin, first + begin, last + begin))
    if not out:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def repeated(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, size: int) -> np.ndarray:
    """Which of the windows at ``starts`` have an equal one in their group.

    Most-significant-digit radix passes over 8-byte digits, no deeper than
    ``size`` bytes: a pass splits each group by its next digit, and groups of
    one leave.  Groups whose members all share the digit keep their order, so
    only groups that really split are sorted.  What is left after the last
    digit are the groups of equal windows.
    """
    found = np.zeros(len(starts), dtype=bool)
    if not len(starts):
        return found
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    active = np.argsort(groups, kind="stable")
    group = groups[active]

    def cut(active, group, digit=None):
        """Group numbers from equal neighbours, without the groups of one."""
        new = np.ones(len(active), dtype=bool)
        new[1:] = group[1:] != group[:-1]
        if digit is not None:
            new[1:] |= digit[1:] != digit[:-1]
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] > 1
        return active[keep], number[keep]

    active, group = cut(active, group)
    for depth in range(0, size, 8):
        if not len(active):
            break
        digit = words[starts[active] + min(depth, size - 8)]
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        length = np.diff(np.append(begin, len(group)))
        split = np.logical_or.reduceat(digit != np.repeat(digit[begin], length), begin)
        if split.any():
            at = np.flatnonzero(np.repeat(split, length))
            order = at[np.lexsort((digit[at], group[at]))]
            active[at], digit[at] = active[order], digit[order]
            active, group = cut(active, group, digit)
    found[active] = True
    return found
