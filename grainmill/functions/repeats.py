"""Whether a text holds a run that is followed by itself, in time near linear in the text."""

from __future__ import annotations

import numpy as np

#: Roots up to this length are looked for one by one.
SHORT = 32
#: Pairs of places that are compared at a time.
AT_ONCE = 1 << 20
#: Symbols that are compared first; at most half of ``SHORT``.
WINDOW = 8
BASE = np.uint64(0x9E3779B97F4A7C15)


def _run(s: np.ndarray, root: int) -> bool:
    """Whether ``root`` places in a row equal those ``root`` further on."""
    unlike = np.flatnonzero(s[:-root] != s[root:])
    return int(np.diff(np.r_[-1, unlike, len(s) - root]).max()) > root


def _extent(sums: np.ndarray, powers: np.ndarray, p: np.ndarray, root: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
    """How many symbols from p on (or before p) equal those ``root`` further on, up to ``most``: never too few; too many if hashes collide."""
    low, high = np.zeros_like(p), most.copy()
    by = powers[root]
    while (open_ := low < high).any():
        mid = (low + high + 1) >> 1
        a = p if forward else p - mid
        same = (sums[a + mid] - sums[a]) * by == sums[a + root + mid] - sums[a + root]
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def has_square(text: str, least: int) -> bool:
    """Whether some run of at least ``least`` characters is followed by itself.

    Roots (the runs' lengths) up to ``SHORT`` are a pass over the text each. A longer one of
    length r makes r places in a row equal to those r further on, so one of them is a
    multiple of r: only those are compared, n / r for each r, and where a window beside them agrees, the
    equality is extended both ways by hashes of prefixes, and what is found is confirmed.
    """
    n = len(text)
    if least <= 0 or n < 2 * least:
        return False
    s = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    s = s.astype(np.uint8) if s.max() < 256 else s
    for root in range(least, min(SHORT, n // 2) + 1):
        if _run(s, root):
            return True
    first = max(least, SHORT + 1)
    if first > n // 2:
        return False
    powers = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)])
    sums = np.r_[np.uint64(0), np.cumsum(s.astype(np.uint64) * powers[:-1])]
    window = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        window = window * BASE + s[k : n - WINDOW + 1 + k]
    roots = np.arange(first, n // 2 + 1)
    counts = (n - 1) // roots
    ends = np.cumsum(counts)
    low = 0
    while low < len(roots):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - counts[low] + AT_ONCE, "right")))
        c = counts[low:high]
        root = np.repeat(roots[low:high], c)
        p = (np.arange(len(root)) - np.repeat(np.cumsum(c) - c, c)) * root
        near = s[p] == s[p + root]
        p, root = p[near], root[near]
        last = n - WINDOW
        after = (p + root <= last) & (window[np.minimum(p, last)] == window[np.minimum(p + root, last)])
        before = (p >= WINDOW) & (window[np.maximum(p - WINDOW, 0)] == window[np.maximum(p - WINDOW, 0) + root])
        p, root = p[after | before], root[after | before]
        if len(p):
            ahead = _extent(sums, powers, p, root, np.minimum(root, n - p - root), True)
            behind = _extent(sums, powers, p, root, np.minimum(root, p), False)
            for i in np.flatnonzero(ahead + behind >= root):
                a, r = int(p[i] - behind[i]), int(root[i])
                if np.array_equal(s[a : a + r], s[a + r : a + 2 * r]) or _run(s, r):
                    return True
        low = high
    return False
