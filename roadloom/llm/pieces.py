"""Pieces of text by the places they have in it: 64-bit keys, and which of them are the same, on whole arrays."""

from __future__ import annotations

#: Pieces up to so many bytes are read eight bytes at a time, all at once; the rest one by one.
SHORT = 64


def word_places(data: bytes):
    """The first byte and the size of each run of bytes other than spaces."""
    import numpy as np

    gap = np.frombuffer(data, np.uint8) == 32
    edges = np.flatnonzero(np.concatenate((gap[:1] ^ True, gap[1:] != gap[:-1], gap[-1:] ^ True)))
    return edges[::2], edges[1::2] - edges[::2]


def piece_keys(data: bytes, starts, sizes):
    """A 64-bit key of each piece: equal pieces have equal ones, up to eight bytes of one size no others have."""
    import numpy as np
    import xxhash

    ahead = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each place on
    sizes = sizes.astype(np.uint64)
    keys = sizes * np.uint64(0xC2B2AE3D27D4EB4F)
    at, left, here = starts, sizes, slice(None)
    for _ in range(SHORT // 8):
        short = np.minimum(left, np.uint64(8)) * np.uint64(8)
        own = ahead[at] & (~np.uint64(0) >> ((np.uint64(64) - short) & np.uint64(63)))
        own = (keys[here] ^ own) * np.uint64(0x9E3779B97F4A7C15)
        keys[here] = own ^ (own >> np.uint64(29))
        more = np.flatnonzero(left > np.uint64(8))
        if not len(more):
            break
        here = more if isinstance(here, slice) else here[more]
        at, left = at[more] + 8, left[more] - np.uint64(8)
    long = np.flatnonzero(sizes > np.uint64(SHORT))
    for i, a, n in zip(long.tolist(), starts[long].tolist(), sizes[long].tolist()):
        keys[i] = xxhash.xxh3_64_intdigest(data[a : a + n])
    return keys


def same_keys(key):
    """Numbers of the distinct keys, and a place of each: by two rounds of a hash table, the rest by sorting."""
    import numpy as np

    which = np.empty(len(key), np.int32)
    first, left, number, keys = [], None, 0, key
    for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        slot = ((keys * np.uint64(factor)) >> np.uint64(43)).astype(np.int64)
        table = np.empty(1 << 21, np.int32)
        table[slot] = np.arange(len(keys), dtype=np.int32)  # one of those that meet in a slot
        owner = table.take(slot)
        agree = keys.take(owner) == keys
        owners = np.flatnonzero(owner == np.arange(len(keys)))
        table[slot[owners]] = np.arange(number, number + len(owners), dtype=np.int32)
        label = table.take(slot)
        if left is None:
            which[:], left = label, np.flatnonzero(~agree)
            first.append(owners)
        else:
            which[left], others = label, left[~agree]
            first.append(left[owners])
            left = others
        number += len(owners)
        keys = key[left]
        if not len(left):
            break
    if len(left):
        _, at, back = np.unique(keys, return_index=True, return_inverse=True)
        which[left] = back + number
        first.append(left[at])
    return which, np.concatenate(first)
