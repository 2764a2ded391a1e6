"""Simple-8b: unsigned integers in 64-bit words, a 4-bit selector and as many equal-width values as fit.

Selectors 0..13 hold 60 values of 1 bit down to 1 value of 60 bits. Selector 14 is
an escape: the word after it is one raw 64-bit value. The caller keeps the number
of values and the places of the escapes, so decoding is done selector by selector
on whole arrays.
"""

from __future__ import annotations

#: Fixed by the coding: (values in a word, bits of each), by selector.
LAYOUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 14


def width_table():
    """The narrowest selector of every value below 2**16; made once by a caller that encodes many blocks."""
    import numpy as np

    limits = np.array([1 << bits for _, bits in LAYOUTS], dtype=np.uint64)
    return np.searchsorted(limits, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.int8)


def encode(values, widths=None):
    """(words, escapes): uint64 words, and the places in them of the escape words."""
    import numpy as np

    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    widths = width_table() if widths is None else widths
    need = widths[np.minimum(values, np.uint64((1 << 16) - 1)).astype(np.uint16)]
    large = np.flatnonzero(values >> np.uint64(16))
    if len(large):
        need[large] = np.searchsorted(np.array([1 << bits for _, bits in LAYOUTS], dtype=np.uint64), values[large], side="right")
    places = np.arange(n, dtype=np.int32)
    take, chosen = np.ones(n, np.int8), np.where(need == ESCAPE, ESCAPE, 13).astype(np.int8)
    least = int(need.min())
    for selector in range(12, least - 1, -1):
        count = LAYOUTS[selector][0]
        wide = np.concatenate(([-1], np.flatnonzero(need > selector), [n])).astype(np.int32)
        gaps = np.diff(wide)
        runs = np.flatnonzero(gaps > count)
        tail = gaps[-1] > 1 and gaps[-1] <= count  # the tail may be padded
        if len(runs) * 64 < n:
            for at in runs.tolist():
                first, end = int(wide[at]) + 1, int(wide[at + 1])
                last = n if end == n else end - count + 1
                take[first:last], chosen[first:last] = count, selector
            if tail:
                take[wide[-2] + 1 :], chosen[wide[-2] + 1 :] = count, selector
        else:
            ahead = np.repeat(wide[1:], gaps)[:n]  # the next value that is too wide
            fits = (ahead - places >= count) | (ahead == n)
            take[fits], chosen[fits] = count, selector
    starts, steps, at = [], take.tolist(), 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    used = chosen[starts]
    places = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(used == ESCAPE)[:-1]))
    words = np.zeros(len(starts) + int((used == ESCAPE).sum()), np.uint64)
    padded = np.concatenate((values, np.zeros(60, np.uint64)))
    for selector in np.unique(used).tolist():
        here = used == selector
        if selector == ESCAPE:
            words[places[here]] = np.uint64(ESCAPE << 60)
            words[places[here] + 1] = values[starts[here]]
            continue
        count, bits = LAYOUTS[selector]
        shifts = (np.arange(count) * bits).astype(np.uint64)
        block = padded[starts[here][:, None] + np.arange(count)] << shifts
        words[places[here]] = np.bitwise_or.reduce(block, axis=1) | np.uint64(selector << 60)
    return words, places[used == ESCAPE].astype(np.uint32)


def decode(words, escapes, n: int):
    """The ``n`` values of ``words``."""
    import numpy as np

    words = np.asarray(words, dtype=np.uint64)
    coded = np.ones(len(words), bool)
    coded[np.asarray(escapes, np.int64) + 1] = False
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in LAYOUTS] + [1, 0], dtype=np.int64)[selectors]
    counts[~coded] = 0
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(words) else np.zeros(0, np.int64)
    out = np.zeros(int(counts.sum()) if len(words) else 0, np.uint64)
    for selector in np.unique(selectors[coded]).tolist():
        here = np.flatnonzero(coded & (selectors == selector))
        if selector == ESCAPE:
            out[starts[here]] = words[here + 1]
            continue
        count, bits = LAYOUTS[selector]
        shifts = (np.arange(count) * bits).astype(np.uint64)
        out[starts[here][:, None] + np.arange(count)] = (words[here][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return out[:n]
