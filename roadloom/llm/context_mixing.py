"""Language-model scores by online logistic context mixing over the running text.

The lower-cased words of a document, each ended by a space, and a line feed at the
end are spelled bit by bit. Eight predictors look up the bits seen after a hashed
context: the last 1 to 6 bytes, the word so far, and the word so far with the end
of the word before it (all within the last ``WINDOW`` bytes, so contexts run across
words). A predictor's table holds quantised bit counts; what a count is worth is
calibrated on the corpus. Two sets of mixing weights, gated by how well the long
contexts know the place and by the place in the word, turn the calibrated log-odds
into a probability of the bit; an adaptive probability map refines it. The refined,
the plain and softened forms are opinions on a byte, whose weights are updated online
as the document is read.

Above the bits stands a predictor of whole words: the word that most often followed
the two words before it. Where there is one, a bit says whether it comes, with
the log-odds of such cases in the corpus plus what this document has shown so far;
only if it does not come is the word spelled. Probabilities are those of a code, so
the score is the document's log10 probability, and its bits a byte are given too.

All training tokens are counted, by exact sums: words, followers of word pairs, and
runs of ``WINDOW + 1`` bytes. As the predictors see nothing beyond such a run, the
distinct runs with their counts stand for the whole corpus: the tables are filled
and the weights learned from them, each occurrence judged without itself. What
grows with the input is dealt into blocks by hash and met there by the chunks that
ask for it, so no task and no broadcast holds it; the byte tables, which are
broadcast, have at most ``MOST_SLOTS`` slots each, and as calibration sees their
states as they are, contexts that share a slot cost sharpness, not correctness.

A training document is judged without itself: its followers without those it counted,
each byte without its own occurrence. So a text that occurs elsewhere in the corpus
stands apart from one that does not.

Documents are read once and kept as chunks of about ``CHUNK_TOKENS`` tokens or fewer (a
longer document is a chunk of its own): distinct words, and tokens as places among
them. A document's score depends on its text, its fold and the corpus alone.

A null text is empty: its only token is the end. A null doc_id counts as the empty
string where the fold is drawn. Rows that repeat a doc_id are documents each. An
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import exact_id, id_list, nullable, returned, shared_folder, stored
from roadloom.llm.pieces import piece_keys, same_keys, word_places
from roadloom.llm.token_store import open_store, parallelism

CHUNK_TOKENS = 1_500_000
#: Bytes whose predictions a task works out at a time (a longer document alone).
SCORED_BYTES = 1_500_000
#: Runs whose opinions a worker keeps, 24 bytes each: bounds its memory, not its results.
KEPT_RUNS = 1 << 20
#: The end of a document, a token that no text can hold.
END = b"\n"
WINDOW = 5
#: The predictors: orders in bytes, the word so far, the word so far and two letters (and the space) before it.
PREDICTORS = (1, 2, 3, 4, 5, "word", "across")
LEAST_SLOTS, MOST_SLOTS = 1 << 19, 1 << 22
PART = 1 << 16
#: States of a bit count: all pairs below EXACT sights in all, then LEVELS of sights by 48 log-odds.
EXACT, LEVELS, STEPS = 8, (8, 16, 64, 1024), 48
STATES = 256
GATES = (16, 20)
BUCKETS = 64
#: Opinions on a byte: the refined one, then the plain and softened ones; their weights at a document's start, and the share that each keeps.
SHARP = (1.0, 0.8, 0.6)
OPINIONS, FIRST, SHARE = 1 + len(SHARP), (0.4, 0.2, 0.3, 0.1), 0.02
#: Bytes of a key of each kind of message, and of a follower's hash.
KEY, FOLLOWER = (8, 4, 7), 3
FOLLOWERS = (1 << 8 * FOLLOWER) - 1
#: Cells of the word predictor: its count by its share among the followers.
CELLS = 8 * 4


def in_fold(doc_id, folds: int, held: int) -> bool:
    """Held out: crc32 of the id as text, modulo ``folds``, is ``held``."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == held


def pack_chunk(words, doc_ids, held, lengths, places) -> bytes:
    """A chunk as six compressed parts behind their sizes, as they are and compressed."""
    import numpy as np
    import pyarrow as pa

    ids = np.array([0 if i is None else i for i in doc_ids], "<i8")
    null = np.array([i is None for i in doc_ids], np.uint8)
    parts = (b" ".join(words), ids.tobytes(), null.tobytes(), np.array(held, np.uint8).tobytes(), np.array(lengths, "<i8").tobytes(), planes(places, 4))
    small = [pa.compress(x, codec="zstd", asbytes=True) for x in parts]
    return struct.pack("<12Q", *map(len, parts), *map(len, small)) + b"".join(small)


def read_chunk(path: str, offset: int, size: int):
    """(words, doc_ids, held, lengths, places) of a stored chunk."""
    import numpy as np
    import pyarrow as pa

    system, path = open_store(path)
    with system.open_input_file(path) as f:
        f.seek(offset)
        data = f.read(size)
    sizes = struct.unpack_from("<12Q", data)
    at, parts = 96, []
    for whole, n in zip(sizes[:6], sizes[6:]):
        parts.append(pa.decompress(data[at : at + n], decompressed_size=whole, codec="zstd", asbytes=True))
        at += n
    ids, null = np.frombuffer(parts[1], "<i8").tolist(), np.frombuffer(parts[2], np.uint8).tolist()
    doc_ids = [None if no else i for i, no in zip(ids, null)]
    return parts[0].split(b" "), doc_ids, np.frombuffer(parts[3], np.uint8).astype(bool), np.frombuffer(parts[4], "<i8"), unplanes(parts[5], 4).astype(np.int64)


def numbered(texts: list[bytes]):
    """(words, lengths, places): the distinct words of lower-cased texts, frequent ones first and END last, and each text's tokens as places among them."""
    import numpy as np

    data = b" ".join(texts) + b" "
    starts, sizes = word_places(data)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    lengths = np.diff(np.searchsorted(starts, begins)) + 1
    places = np.empty(len(starts) + len(texts), np.int32)
    last = np.zeros(len(places), bool)
    last[np.cumsum(lengths) - 1] = True
    words = []
    if len(starts):
        which, first = same_keys(piece_keys(data, starts, sizes))
        order = np.argsort(-np.bincount(which))
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        places[~last] = number.take(which)
        first = first[order]
        words = [data[a : a + n] for a, n in zip(starts[first].tolist(), sizes[first].tolist())]
    places[last] = len(words)
    return [*words, END], lengths, places


def chunks_of(docs: DataFrame, folds: int, held: int, folder: str) -> DataFrame:
    """Chunks in files below ``folder``: distinct words, documents, and their tokens as places among the words; the catalogue.

    A task writes one file under a name of that attempt's own and then reports it, so
    retried attempts leave nothing but an orphan file.
    """

    def run(batches):
        import uuid

        import pandas as pd
        from pyspark import TaskContext

        at, out, offset = TaskContext.get().partitionId(), None, 0
        uri = f"{folder}/part-{at:06d}-{uuid.uuid4().hex}.chunks"
        rows, tokens, reports = [], 0, []  # rows: id, held out, text
        plain = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))

        def close():
            nonlocal out, offset, rows, tokens
            if out is None:
                system, path = open_store(uri)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            words, lengths, places = numbered([r[2] for r in rows])
            data = pack_chunk(words, [r[0] for r in rows], [r[1] for r in rows], lengths, places)
            out.write(data)
            reports.append(((at << 32) + len(reports), len(places), uri, offset, len(data)))
            rows, tokens, offset = [], 0, offset + len(data)
            del words, lengths, places, data
            returned()

        for batch in batches:
            for i, text in zip(id_list(batch), batch["text"]):
                text = ("" if text is None else text).encode("utf-8", "surrogatepass").translate(plain)
                rows.append((i, in_fold(i, folds, held), text))
                tokens += text.count(b" ") + 2  # its tokens or somewhat more
                if tokens >= CHUNK_TOKENS:
                    close()
        if rows:
            close()
        if out is not None:
            out.close()
        yield pd.DataFrame(reports, columns=["chunk", "tokens", "path", "offset", "bytes"])

    return docs.select(*exact_id(), "text").mapInPandas(run, "chunk long, tokens long, path string, offset long, bytes long")


# -- text as runs of bytes --------------------------------------------------------------


def spelling(words: list[bytes]):
    """The letters of all words, and each word's first letter and size in them."""
    import numpy as np

    pieces = [w if w == END else w + b" " for w in words]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes


def stream(spelt, places, lengths):
    """The bytes of consecutive documents, the first byte of each token, and the first byte of each document."""
    import numpy as np

    letters, begins, sizes = spelt
    begins, sizes = begins[places], sizes[places]
    ends = np.cumsum(sizes)
    tokens = ends - sizes
    data = letters.take(np.repeat(begins - tokens, sizes) + np.arange(ends[-1]))
    return data, tokens, tokens[np.cumsum(lengths) - lengths]


def runs(data, starts):
    """For every byte the run that ends with it, as an integer: the byte lowest, line feeds before the document."""
    import numpy as np

    full = np.uint64((1 << 8 * (WINDOW + 1)) - 1)
    run = data.astype(np.uint64)
    for back in (1, 2, 4):  # doubling: the last 2, 4 and 8 bytes
        run[back:] |= run[:-back] << np.uint64(8 * back)
    run &= full
    sizes = np.diff(np.append(starts, len(data)))
    pad = int.from_bytes(b"\n" * (WINDOW + 1), "little")
    for at in range(WINDOW):
        here = starts[sizes > at] + at
        own = np.uint64((1 << 8 * (at + 1)) - 1)
        run[here] = (run[here] & own) | (np.uint64(pad) & ~own)
    return run & full


def contexts(run):
    """The hashed context of each predictor, and the letters since the last space (at most WINDOW)."""
    import numpy as np

    before = run >> np.uint64(8)
    letters, inside = np.zeros(len(run), np.uint64), np.ones(len(run), bool)
    for back in range(WINDOW):
        byte = (before >> np.uint64(8 * back)) & np.uint64(255)
        inside &= (byte != 32) & (byte != 10)
        letters += inside
    found = []
    for k, what in enumerate(PREDICTORS):
        size = np.uint64(what) if isinstance(what, int) else letters if what == "word" else np.minimum(letters + np.uint64(3), np.uint64(WINDOW))
        own = before & ((np.uint64(1) << (np.uint64(8) * size)) - np.uint64(1))
        own = (own + size + np.uint64(k << 56)) * np.uint64(0x9E3779B97F4A7C15)
        own = (own ^ (own >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((own >> np.uint64(32)).astype(np.uint32))
    return found, letters.astype(np.int64)


def lines(context, byte, bit: int, slots_of: int):
    """Where a context's counts for the half byte that ``bit`` is in begin: its 15 slots lie within 16 and its place among them is hashed too."""
    import numpy as np

    half = np.uint32(0x85EBCA6B) if bit > 3 else ((byte.astype(np.uint32) >> np.uint32(4)) | np.uint32(16)) * np.uint32(0x85EBCA6B)
    return (((context ^ half) * np.uint32(0xC2B2AE35)) >> np.uint32(33 - slots_of.bit_length())).astype(np.int64)


def inner(byte, bit: int):
    """The bits of the half byte above one of them, a leading one before them: 1 to 15."""
    import numpy as np

    top = 1 << (3 - bit % 4)
    return top | ((byte >> (bit + 1)) & (top - 1)).astype(np.int64)


def slots(context, byte, bit: int, slots_of: int):
    """The slot of a context's counts for one bit of the byte, given the bits above it."""
    return lines(context, byte, bit, slots_of) ^ inner(byte, bit)


class States:
    """Quantised pairs of bit counts."""

    def __init__(self):
        import numpy as np

        self.number = np.zeros((EXACT, EXACT), np.uint8)
        pairs = [(n - ones, ones) for n in range(EXACT) for ones in range(n + 1)]
        for s, pair in enumerate(pairs):
            self.number[pair] = s
        self.first = len(pairs)
        grid = np.sinh(np.linspace(-2.2, 2.2, STEPS)) / np.sinh(2.2) * 9
        self.middle = (grid[1:] + grid[:-1]) / 2
        self.odds = np.zeros(STATES)
        self.known = np.zeros(STATES, np.int64)  # how well a state knows its place, 0 to 3
        self.without = np.tile(np.arange(STATES, dtype=np.uint8), (2, 1))  # the state without one sight of the bit
        for s, (zeros, ones) in enumerate(pairs):
            self.odds[s] = np.log((ones + 0.15) / (zeros + 0.15))
            self.known[s] = (zeros + ones > 0) + (zeros + ones > 2)
            self.without[0, s] = self.number[max(zeros - 1, 0), ones]
            self.without[1, s] = self.number[zeros, max(ones - 1, 0)]
        for level in range(len(LEVELS)):
            self.odds[self.first + STEPS * level : self.first + STEPS * (level + 1)] = grid
        self.known[self.first :] = 3

    def of(self, zeros, ones):
        import numpy as np

        total = zeros + ones
        small = total < EXACT
        out = np.empty(len(total), np.uint8)
        out[small] = self.number[zeros[small], ones[small]]
        zeros, ones, total = zeros[~small], ones[~small], total[~small]
        level = np.searchsorted(LEVELS, total, side="right") - 1
        out[~small] = self.first + STEPS * level + np.searchsorted(self.middle, np.log((ones + 0.3) / (zeros + 0.3)))
        return out


# -- what is gathered from the corpus, in blocks ----------------------------------------


def planes(values, width: int) -> bytes:
    """Integers as byte planes, the lowest first: what is zero or alike lies together and compresses."""
    import numpy as np

    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int):
    import numpy as np

    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8")[:, 0]


def rising(values, width: int) -> bytes:
    """Sorted integers by their steps."""
    import numpy as np

    return planes(np.diff(values.astype(np.uint64), prepend=np.uint64(0)), width)


def unrising(data: bytes, width: int):
    import numpy as np

    return np.cumsum(unplanes(data, width), dtype=np.uint64)


def word_hashes(words: list[bytes]):
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pair_keys(hashes, places, lengths, blocks: int):
    """For every token the key of the two words before it in its document: block, then 32 bits."""
    import numpy as np

    here = hashes[places]
    ends = np.cumsum(lengths)
    last, one = np.full(len(here), 3, np.uint64), np.full(len(here), 5, np.uint64)
    last[1:], one[2:] = here[:-1], here[:-2]
    last[ends - lengths] = 3
    one[ends - lengths] = 5
    one[(ends - lengths + 1)[lengths > 1]] = 5
    key = (last * np.uint64(0x9E3779B97F4A7C15)) ^ (one * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    return (((key >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))


def messages(chunks: DataFrame, blocks: dict) -> DataFrame:
    """(kind, block, chunk, a, b, n): what each chunk has of each block, with its counts in training documents.

    kind 0: hashes of words; 1: keys of word pairs and the followers' hashes, the count doubled and one more
    if held-out documents have it too; 2: runs of bytes.
    """

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples(index=False):
                words, _, held, lengths, places = read_chunk(row.path, int(row.offset), int(row.bytes))
                train, counted = ~held, np.repeat(~held, lengths)
                hashes = word_hashes(words)
                out = []

                def deal(kind, block, a, b, n):
                    cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
                    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(block)]):
                        out.append((kind, int(block[lo]), row.chunk, rising(a[lo:hi], KEY[kind]), b"" if b is None else planes(b[lo:hi], FOLLOWER), planes(n[lo:hi], 4)))

                order = np.argsort(hashes)
                n = np.bincount(places[counted], minlength=len(words))
                deal(0, word_block(hashes[order], blocks[0]), hashes[order], None, n[order])

                pairs = pair_keys(hashes, places, lengths, blocks[1])
                follower = hashes[places] & np.uint64(FOLLOWERS)
                both = (pairs * np.uint64(0xD6E8FEB86659FD93)) ^ (follower * np.uint64(0x9E3779B97F4A7C15))
                order = np.argsort(both)
                first = np.flatnonzero(np.concatenate(([True], np.diff(both[order]) != 0)))
                n = np.add.reduceat(counted[order].astype(np.int64), first)
                n, order = 2 * n + (n < np.diff(np.append(first, len(order)))), order[first]
                again = np.argsort(pairs[order])
                n, order = n[again], order[again]
                deal(1, (pairs[order] >> np.uint64(32)).astype(np.int64), pairs[order] & np.uint64(0xFFFFFFFF), follower[order], n)
                yield pd.DataFrame(out, columns=["kind", "block", "chunk", "a", "b", "n"])

                if train.any():
                    spelt, ends, parts = spelling(words), np.cumsum(lengths), []
                    doc_bytes = np.add.reduceat(spelt[2][places], ends - lengths)
                    for a, b in _batches(np.cumsum(doc_bytes), SCORED_BYTES):
                        data, _, starts = stream(spelt, places[ends[a] - lengths[a] : ends[b - 1]], lengths[a:b])
                        parts.append(np.unique(runs(data, starts)[np.repeat(train[a:b], doc_bytes[a:b])], return_counts=True))
                    keys, n = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(keys)
                    keys, n = keys[order], n[order]
                    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                    keys, n = keys[first], np.add.reduceat(n, first)
                    del parts
                    block = run_block(keys, blocks[2])
                    order = np.argsort(block.astype(np.uint16) if blocks[2] < 1 << 16 else block, kind="stable")
                    out.clear()
                    deal(2, block[order], keys[order], None, n[order])
                    del keys, n, block, order, first, data, spelt
                    returned()
                    yield pd.DataFrame(out, columns=["kind", "block", "chunk", "a", "b", "n"])

    return chunks.repartition(parallelism(chunks), "chunk").mapInPandas(run, "kind int, block int, chunk long, a binary, b binary, n binary")


def word_block(hashes, blocks: int):
    import numpy as np

    return (((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def run_block(keys, blocks: int):
    """By all but the last two bytes: neighbours stay together and their steps are small."""
    import numpy as np

    return ((((keys >> np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64)


def cell(best, total):
    """The word predictor's cell: sights of the follower (0 to 7) by its share of all (0 to 3)."""
    import numpy as np

    return np.minimum(np.log2(np.maximum(best, 1) * 2.0).astype(np.int64) - 1, 7) * 4 + np.minimum((4 * best) // np.maximum(total, 1), 3)


def settle(pdf):
    """A block's sums, and its answers to the chunks.

    kind 0: counts of the chunk's words, in its order; 1: which of its pairs are known
    (places in its order), their two most frequent followers and counts; 2: the runs and their counts; 3: training tokens and distinct words;
    4: hits and tries of the word predictor by cell, each occurrence judged without itself.
    """
    import numpy as np
    import pandas as pd

    kind, block = int(pdf["kind"].iloc[0]), int(pdf["block"].iloc[0])
    names = ["kind", "block", "chunk", "a", "b", "n"]
    pdf = pdf.sort_values("chunk")
    a = [unrising(x, KEY[kind]) for x in pdf["a"]]
    n = [unplanes(x, 4).astype(np.int64) for x in pdf["n"]]
    if kind == 2:
        keys = np.concatenate(a)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], np.diff(keys) != 0)))
        keys, total = keys[first], np.add.reduceat(np.concatenate(n)[order], first)
        return pd.DataFrame([(2, block, -1, rising(keys, KEY[2]), b"", planes(total, 8))], columns=names)
    if kind == 0:
        keys, where = np.unique(np.concatenate(a), return_inverse=True)
        total = np.bincount(where, np.concatenate(n)).astype(np.int64)
        cuts = np.cumsum([len(x) for x in a])[:-1]
        rows = [(0, block, c, b"", b"", planes(total[w], 8)) for c, w in zip(pdf["chunk"].tolist(), np.split(where, cuts))]
        rows.append((3, block, -1, b"", b"", np.array([total.sum(), (total > 0).sum()], "<i8").tobytes()))
        return pd.DataFrame(rows, columns=names)
    asked, n = [x & 1 for x in n], [x >> 1 for x in n]
    follower = [unplanes(x, FOLLOWER) for x in pdf["b"]]
    both, where = np.unique((np.concatenate(a) << np.uint64(32)) | np.concatenate(follower), return_inverse=True)
    total = np.bincount(where, np.concatenate(n)).astype(np.int64)
    key = (both >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(first, len(key)))
    # The most frequent follower of a pair, the smaller hash first, as one number; then without it.
    rank = (total << 8 * FOLLOWER) | (FOLLOWERS - (both & np.uint64(FOLLOWERS)).astype(np.int64))
    n1 = np.maximum.reduceat(rank, first)
    rank[rank == np.repeat(n1, sizes)] = -1
    n2 = np.maximum.reduceat(rank, first)
    f1, f2 = ((FOLLOWERS - (x & FOLLOWERS)).astype(np.uint32) for x in (n1, n2))
    n1, n2 = n1 >> 8 * FOLLOWER, np.where(n2 < 0, 0, n2 >> 8 * FOLLOWER)
    table = {"key": key[first], "f1": f1, "n1": n1, "f2": f2, "n2": n2, "n": np.add.reduceat(total, first)}

    hits, tries = np.zeros(CELLS), np.zeros(CELLS)
    n1, n2, every = table["n1"], table["n2"], table["n"]
    stays = (n1 - 1 >= n2) & (n1 > 1)  # without one sight of itself the best follower is still foretold
    for weight, best, hit in ((np.where(stays, n1, 0), n1 - 1, True), (np.where(stays | (n2 == 0), 0, n1), n2, False), (every - n1, n1, False)):
        own = (weight > 0) & (best > 0) & (every > 1)
        at = cell(best[own], every[own] - 1)
        tries += np.bincount(at, weight[own], minlength=CELLS)
        hits += np.bincount(at, weight[own], minlength=CELLS) * hit
    rows = [(4, block, -1, b"", b"", np.concatenate((hits, tries)).astype("<i8").tobytes())]
    for c, keys, held in zip(pdf["chunk"].tolist(), a, asked):
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        at = np.searchsorted(table["key"], keys[cuts].astype(np.uint32))
        more = (every[at] > 1) | (every[at] > 0) & (np.maximum.reduceat(held, cuts) > 0)  # one sight is a training document's own
        at = at[more]
        rows.append((1, block, c, rising(np.flatnonzero(more), 4), planes(table["f1"][at], 4) + planes(table["f2"][at] * (n2[at] > 0), 4), b"".join(planes(x[at], 4) for x in (n1, n2, every))))
    return pd.DataFrame(rows, columns=names)


def bit_tables(found: DataFrame, sizes: list[int]):
    """The states of all predictors' slots, from the runs: bounded by MOST_SLOTS bytes each."""
    import numpy as np

    def count(batches):
        import numpy as np
        import pandas as pd

        def tables(blocks):
            keys, n = (np.concatenate(x) for x in zip(*blocks))
            hashed, _ = contexts(keys)
            byte = (keys & np.uint64(255)).astype(np.uint8)
            for k, size in enumerate(sizes):
                seen = np.zeros(2 * size)
                for bit in range(8):
                    seen += np.bincount(2 * slots(hashed[k], byte, bit, size) + ((byte >> np.uint8(bit)) & 1), n, minlength=2 * size)
                seen = seen.astype("<i8").reshape(-1, 2 * min(PART, size))
                for part in np.flatnonzero(seen.any(1)).tolist():
                    yield pd.DataFrame({"k": [k], "part": [part], "seen": [zlib.compress(seen[part].tobytes(), 1)]})

        held, many = [], 0
        for batch in batches:
            for keys, n in zip(batch["a"], batch["n"]):
                held.append((unrising(keys, KEY[2]), unplanes(n, 8).astype(np.float64)))
                many += len(held[-1][0])
                if many > 1_500_000:
                    yield from tables(held)
                    held, many = [], 0
        if held:
            yield from tables(held)

    def add(pdf):
        import numpy as np
        import pandas as pd

        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in pdf["seen"]).reshape(-1, 2)
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "part": pdf["part"].iloc[:1], "seen": [zlib.compress(States().of(total[:, 0], total[:, 1]).tobytes(), 1)]})

    schema = "k int, part int, seen binary"
    tables = [np.zeros(size, np.uint8) for size in sizes]
    # Few tasks, as each passes on whole tables.
    runs_seen = found.agg(F.coalesce(F.sum(F.octet_length("n") / 8), F.lit(0)).cast("long")).first()[0]
    counted = found.select("a", "n").repartition(1 + runs_seen // 1_500_000).mapInPandas(count, schema).groupBy("k", "part").applyInPandas(add, schema)
    for row in counted.toLocalIterator():
        part = np.frombuffer(zlib.decompress(row["seen"]), np.uint8)
        tables[row["k"]][row["part"] * PART : row["part"] * PART + len(part)] = part
    return tables


class Mixer:
    """The bit predictors and the two gated sets of weights over their calibrated log-odds."""

    def __init__(self, tables, odds=None, weights=None):
        import numpy as np

        self.tables, self.states = tables, States()
        self.odds = np.tile(self.states.odds, (len(tables), 1)).astype(np.float32) if odds is None else odds
        self.weights = [np.full((g, len(tables)), 1.6 / len(tables)) for g in GATES] if weights is None else weights

    def planes(self, run, leave: bool):
        """For the eight bits of the last byte, the highest first: (bit values, states by predictor); and the gates. ``leave`` takes the occurrence out of the counts."""
        import numpy as np

        hashed, letters = contexts(run)
        byte = (run & np.uint64(255)).astype(np.uint8)
        out = []
        for bit in range(7, -1, -1):
            value = (byte >> np.uint8(bit)) & np.uint8(1)
            if bit % 4 == 3:
                begin = [lines(h, byte, bit, len(t)) for h, t in zip(hashed, self.tables)]
            states = [t.take(b ^ inner(byte, bit)) for b, t in zip(begin, self.tables)]
            out.append((value, [self.states.without[value, s] for s in states] if leave else states))
        top, known = out[0][1], self.states.known
        gates = 4 * known[top[4]] + known[top[2]], 4 * np.minimum(letters, 4) + known[top[5]]
        return out, gates

    def inputs(self, states):
        import numpy as np

        return np.stack([o.take(s) for o, s in zip(self.odds, states)])

    def opinions(self, run, leave: bool, refined):
        """(runs, OPINIONS): log probability of the last byte by both weight sets in equal parts, refined, plain and softened.

        Runs are taken in the order of their contexts, nearest byte first, so that what
        they share is looked up once: each bit is judged once for all runs that agree
        up to it, and its chances multiply those of the bits above.
        """
        import numpy as np

        out = np.empty((len(run), OPINIONS), np.float32)
        key = (run >> np.uint64(8)).byteswap() | (run & np.uint64(255))
        order = np.argsort(key)
        # For each predictor the log-odds in favour of the bit that comes, by that bit and the state.
        own = self.states.without if leave else np.tile(np.arange(STATES), (2, 1))
        odds = [np.concatenate((-o[own[0]], o[own[1]])) for o in self.odds]
        known = self.states.known[own].ravel()
        weights = [np.ascontiguousarray(w.T.astype(np.float32)) for w in self.weights]
        for lo in range(0, len(run), 16_384):
            at = order[lo : lo + 16_384]
            part, step = run[at], key[at]
            step[1:] ^= step[:-1].copy()
            step[0] = 256  # how far up a run differs from the one before it
            byte = (part & np.uint64(255)).astype(np.uint32)
            new = step >= np.uint64(256)
            above = context = np.cumsum(new, dtype=np.int64) - 1  # the context of each run, then its bits so far
            hashed, letters = contexts(part[new])
            within, chances = above, np.ones((OPINIONS, int(above[-1]) + 1))
            for bit in range(7, -1, -1):
                new = step >= np.uint64(1 << bit)
                heads = np.flatnonzero(new)
                begun, own_byte = above.take(heads), byte.take(heads)
                if bit == 7:
                    begin = [lines(h, None, bit, len(t)) for h, t in zip(hashed, self.tables)]
                elif bit == 3:
                    half = np.flatnonzero(step >= np.uint64(16))
                    where, half_byte, within = context.take(half), byte.take(half), above
                    begin = [lines(h.take(where), half_byte, bit, len(t)) for h, t in zip(hashed, self.tables)]
                where, node = within.take(heads), inner(own_byte, bit)
                bits = ((own_byte >> np.uint32(bit)) & np.uint32(1)).astype(np.int64) * STATES
                states = [t.take(b.take(where) ^ node) + bits for b, t in zip(begin, self.tables)]
                here = np.cumsum(new, dtype=np.int64) - 1
                if bit == 7:
                    gates = 4 * known[states[4]] + known[states[2]], 4 * np.minimum(letters[where], 4) + known[states[5]]
                    chosen = sum(w.take(g, axis=1) for w, g in zip(weights, gates))
                    gated = here
                by = gated.take(heads)
                z = np.zeros(len(heads), np.float32)
                for w, o, s in zip(chosen, odds, states):
                    z += w.take(by) * o.take(s)
                np.clip(z, -24, 24, out=z)
                z *= np.float32(0.5)
                spot = np.floor(np.clip(z * np.float32((BUCKETS - 1) / 16), 1 - BUCKETS / 2, BUCKETS / 2 - 1)).astype(np.int64)
                place = (np.uint32(256 >> bit) | (own_byte >> np.uint32(bit))).astype(np.int64) * BUCKETS + BUCKETS // 2 + spot
                chances = chances.take(begun, axis=1)
                plain = 1 / (1 + np.exp(-z))
                chances[0] *= (refined.take(place) + plain) * np.float32(0.5)
                for k, sharp in enumerate(SHARP, 1):
                    chances[k] *= plain if sharp == 1 else 1 / (1 + np.exp(z * np.float32(-sharp)))
                above = here
            found = np.log(chances).astype(np.float32).T
            out[at] = found if len(found) == len(at) else found.take(above, axis=0)
        return out


def map_place(run, z):
    """(runs, 8): the places in the adaptive probability map for the bits of the last byte, which has log-odds ``z`` for each.

    A place is the byte's bits up to a bit, that bit included, and the log-odds in its
    favour in BUCKETS steps: what is learned is how often the bit came.
    """
    import numpy as np

    byte = (run & np.uint64(255)).astype(np.int64)[:, None] >> np.arange(7, -1, -1)
    spot = np.clip(z * ((BUCKETS - 1) / 16), 1 - BUCKETS / 2, BUCKETS / 2 - 1)
    return ((256 >> np.arange(7, -1, -1)) | byte) * BUCKETS + BUCKETS // 2 + np.floor(spot).astype(np.int64)


def calibrate(found: DataFrame, shared) -> DataFrame:
    """(cell, zeros, ones): bits seen in each state of each predictor over all training bytes, each judged without itself."""

    def run(batches):
        import numpy as np
        import pandas as pd

        mixer = Mixer(shared.value)
        for batch in batches:
            for keys, n in zip(batch["a"], batch["n"]):
                keys, n = unrising(keys, KEY[2]), unplanes(n, 8).astype(np.float64)
                seen = np.zeros((2, len(PREDICTORS) * STATES))
                for lo in range(0, len(keys), 200_000):
                    for value, states in mixer.planes(keys[lo : lo + 200_000], leave=True)[0]:
                        for k, s in enumerate(states):
                            both = np.bincount(s.astype(np.int64) * 2 + value, n[lo : lo + 200_000], minlength=2 * STATES).reshape(-1, 2)
                            seen[:, k * STATES : (k + 1) * STATES] += both.T
                at = np.flatnonzero(seen.any(0))
                yield pd.DataFrame({"cell": at, "zeros": seen[0, at], "ones": seen[1, at]})

    return found.select("a", "n").mapInPandas(run, "cell int, zeros double, ones double").groupBy("cell").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))


def learn(found: DataFrame, shared) -> DataFrame:
    """(kind, cell, x, y): kind 0, sums of mass times weight and of mass; kind 1, how often the probability map's places came.

    Each block goes through its runs in hashed order, in small groups weighted by their
    counts, corrects the gates' weights by the errors (a Newton step on what has been
    seen so far), and passes on its weights with the bytes they come from.
    """

    def run(batches):
        import numpy as np
        import pandas as pd

        tables, odds = shared.value
        for batch in batches:
            for keys, n in zip(batch["a"], batch["n"]):
                keys, n = unrising(keys, KEY[2]), unplanes(n, 8).astype(np.float64)
                mixer, many = Mixer(tables, odds), len(PREDICTORS)
                order = np.argsort(keys * np.uint64(0xD6E8FEB86659FD93))
                curve = [np.tile(np.eye(many) * 20.0, (g, 1, 1)) for g in GATES]
                seen = np.zeros(512 * BUCKETS)
                for lo in range(0, len(keys), 8192):
                    at = order[lo : lo + 8192]
                    planes, gates = mixer.planes(keys[at], leave=True)
                    x = np.stack([mixer.inputs(states) for _, states in planes], axis=2)  # predictors, runs, bits
                    values = np.stack([value for value, _ in planes], axis=1).astype(np.float32)
                    final = 0.0
                    for i, gate in enumerate(gates):
                        by = np.argsort(gate, kind="stable")
                        sorted_x, own_n, gate = x[:, by], n[at[by]].astype(np.float32)[:, None], gate[by]
                        z = np.clip(np.einsum("knb,kn->nb", sorted_x, mixer.weights[i].T.astype(np.float32).take(gate, axis=1)), -12, 12)
                        back = np.empty_like(by)
                        back[by] = np.arange(len(by))
                        final = final + 0.5 * z[back]
                        p = 1 / (1 + np.exp(-z))
                        error, bend = own_n * (values[by] - p), own_n * np.maximum(p * (1 - p), np.float32(1e-4))
                        cuts = np.flatnonzero(np.concatenate(([True], gate[1:] != gate[:-1])))
                        slope = np.zeros((GATES[i], many))
                        for begin, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(gate)]):
                            own, g = sorted_x[:, begin:stop].reshape(many, -1).astype(np.float64), gate[begin]
                            slope[g] = own @ error[begin:stop].ravel()
                            curve[i][g] += (own * bend[begin:stop].ravel()) @ own.T
                        mixer.weights[i] = mixer.weights[i] + np.linalg.solve(curve[i], slope[:, :, None])[:, :, 0]
                    place, times = map_place(keys[at], np.where(values, final, -final)).ravel(), np.repeat(n[at], 8)
                    seen += np.bincount(place, times, minlength=512 * BUCKETS)
                mass = [np.trace(c, axis1=1, axis2=2) for c in curve]
                flat = np.concatenate([(w * m[:, None]).ravel() for w, m in zip(mixer.weights, mass)])
                yield pd.DataFrame({"kind": 0, "cell": np.arange(len(flat)), "x": flat, "y": np.concatenate([np.repeat(m, many) for m in mass])})
                at = np.flatnonzero(seen)
                yield pd.DataFrame({"kind": 1, "cell": at, "x": seen[at], "y": 0.0})

    out = found.select("a", "n").mapInPandas(run, "kind int, cell int, x double, y double")
    return out.groupBy("kind", "cell").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


class Model:
    """Everything that scoring needs of the corpus but the answers to its chunk; of bounded size."""

    def __init__(self, tables, odds, weights, refined, followers, train_tokens: int, distinct: int):
        self.tables, self.odds, self.weights, self.refined, self.followers = tables, odds, weights, refined, followers
        self.train_tokens, self.distinct = train_tokens, distinct
        self.kept = None  # what a worker has worked out


def _mean_bits(zeros, ones, odds, strength: float):
    """The log-odds of cells seen so often, drawn towards the given ones."""
    import numpy as np

    p = 1 / (1 + np.exp(-odds))
    p = (ones + strength * p) / (zeros + ones + strength)
    return np.log(p / (1 - p))


def fit(found: DataFrame, most_slots: int = MOST_SLOTS) -> Model:
    """The model from the settled blocks (stored: they are read several times)."""
    import numpy as np

    spark = found.sparkSession
    sums = {3: np.zeros(2, np.int64), 4: np.zeros(2 * CELLS, np.int64)}
    for row in found.where("kind in (3, 4)").select("kind", "n").toLocalIterator():  # a short row for each block
        sums[row["kind"]] += np.frombuffer(row["n"], "<i8")
    train_tokens, distinct = sums[3].tolist()
    hits, tries = sums[4][:CELLS], sums[4][CELLS:]
    followers = _mean_bits(tries - hits, hits, np.full(CELLS, -1.0), 4.0)

    byte_runs = found.where("kind = 2")
    runs_seen = byte_runs.agg(F.coalesce(F.sum(F.octet_length("n") / 8), F.lit(0)).cast("long")).first()[0]
    wanted = min(max(LEAST_SLOTS, 1 << (4 * runs_seen).bit_length()), most_slots)
    # A context of one to three bytes has fewer bits below it than these.
    sizes = [min(wanted, {1: 1 << 16, 2: 1 << 20, 3: 1 << 22}.get(p, wanted)) for p in PREDICTORS]
    tables = bit_tables(byte_runs, sizes)
    shared = spark.sparkContext.broadcast(tables)  # at most MOST_SLOTS bytes a predictor
    mixer = Mixer(tables)
    seen = np.zeros((2, len(PREDICTORS), STATES))
    for row in calibrate(byte_runs, shared).collect():  # predictors times states
        seen[:, row["cell"] // STATES, row["cell"] % STATES] = row["zeros"], row["ones"]
    odds = _mean_bits(seen[0], seen[1], np.tile(mixer.states.odds, (len(PREDICTORS), 1)), 4.0).astype(np.float32)
    shared = spark.sparkContext.broadcast((tables, odds))
    flat, came = np.concatenate([w.ravel() for w in mixer.weights]), np.zeros((512, BUCKETS))
    for row in learn(byte_runs, shared).collect():  # gates times predictors, places of the map
        if row["kind"] == 0:
            flat[row["cell"]] = row["x"] / row["y"]
        else:
            came.ravel()[row["cell"]] = row["x"]
    # The other bit at the mirrored log-odds is the same event's counterpart.
    other = came[np.arange(512) ^ 1, ::-1]
    middle = (np.arange(BUCKETS) - (BUCKETS - 1) / 2) * (16 / (BUCKETS - 1))
    refined = 1 / (1 + np.exp(-_mean_bits(other, came, middle, 40.0)))
    split = GATES[0] * len(PREDICTORS)
    weights = [flat[:split].reshape(GATES[0], -1), flat[split:].reshape(GATES[1], -1)]
    return Model(tables, odds, weights, refined.astype(np.float32).ravel(), followers, train_tokens, distinct)


# -- scoring ----------------------------------------------------------------------------


def spelled(model: Model, data, starts, train):
    """log10 probability of every byte of consecutive documents; in training documents each byte is judged without itself.

    The opinions on a byte are mixed by weights that are updated online: after every
    byte of the document an opinion gains by the probability it gave it.
    """
    import numpy as np

    sizes = np.diff(np.append(starts, len(data)))
    run = runs(data, starts)
    run |= np.repeat(train, sizes).astype(np.uint64) << np.uint64(8 * (WINDOW + 1))
    if model.kept is None:
        model.kept = Kept(model)
    opinions = model.kept.opinions(run)
    del run
    out, ends = np.empty(len(data)), np.cumsum(sizes)
    for a, b in _batches(ends, 32_768):
        lo, hi = int(ends[a] - sizes[a]), int(ends[b - 1])
        own = np.ascontiguousarray(opinions[lo:hi].T)
        # The opinions' weights before each byte: what they gave all bytes of the document before it, compared with the first.
        before = np.zeros((OPINIONS, hi - lo))
        np.cumsum(np.subtract(own[1:, :-1], own[0, :-1], dtype=np.float64), axis=1, out=before[1:, 1:])
        before[1:] -= np.repeat(before[1:, starts[a:b] - lo], sizes[a:b], axis=1)
        before -= before.max(axis=0)
        weights = np.exp(before.astype(np.float32))
        weights *= np.array(FIRST, np.float32)[:, None]
        total = weights.sum(axis=0)
        weights += np.float32(SHARE) * total
        np.exp(own, out=own)
        own *= weights
        out[lo:hi] = np.log(own.sum(axis=0) / weights.sum(axis=0))
    out *= 1 / np.log(10.0)
    return out


class Kept:
    """The opinions on runs, each worked out once and kept for the batches after it while no other run takes its place."""

    def __init__(self, model: Model):
        import numpy as np

        self.mixer, self.refined = Mixer(model.tables, model.odds, model.weights), model.refined
        self.runs, self.found = np.full(KEPT_RUNS, ~np.uint64(0)), np.empty((KEPT_RUNS, OPINIONS), np.float32)

    def opinions(self, run):
        """(runs, OPINIONS) of runs that carry a bit above them where their own occurrence is to be left out."""
        import numpy as np

        tag = np.uint64(8 * (WINDOW + 1))
        place = ((run * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - KEPT_RUNS.bit_length())).astype(np.int64)
        out, missing = self.found.take(place, axis=0), np.flatnonzero(self.runs.take(place) != run)
        if len(missing):
            run = run[missing]
            which, first = same_keys(run)
            run, place = run[first], place[missing[first]]
            counted, new = run >> tag == 1, np.empty((len(first), OPINIONS), np.float32)
            for leave in (False, True):
                new[counted == leave] = self.mixer.opinions(run[counted == leave] & ((np.uint64(1) << tag) - np.uint64(1)), leave, self.refined)
            out[missing] = new.take(which, axis=0)
            self.runs[place] = run
            stays = self.runs.take(place) == run  # one of those that meet in a place
            self.found[place[stays]] = new[stays]
        return out


def _columns(data: bytes, many: int):
    return [unplanes(data[k * len(data) // many : (k + 1) * len(data) // many], 4) for k in range(many)]


def _batches(ends, size: int):
    """Ranges of documents of about ``size`` bytes."""
    import numpy as np

    a = 0
    while a < len(ends):
        begin = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, begin + size, side="right")))
        yield a, b
        a = b


def followed(model: Model, at, follower, train, lengths, answers):
    """For every token: whether a word was foretold, whether it came, and the log-odds that it would. ``at``: its pair's place among the answers or -1."""
    import numpy as np

    n = len(at)
    foretold, hit, odds = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n)
    some = np.flatnonzero(at >= 0)
    if not len(some):
        return foretold, hit, odds
    at = at[some]
    best = {x: answers[x][at].astype(np.int64) for x in ("f1", "n1", "f2", "n2", "n")}
    # A training document's own sights do not count: its tokens behind one pair of words meet, and who of them follows the pair's best.
    doc = np.repeat(np.arange(len(lengths)), lengths)[some]
    own = np.flatnonzero(np.repeat(train, lengths)[some])
    mixed = (doc[own] << 32) | at[own]
    by = np.argsort(mixed)
    if len(by):
        mixed, came = mixed[by], follower[some[own]].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], mixed[1:] != mixed[:-1])))
        times = np.diff(np.append(first, len(by)))
        for name, what in (("n1", came == best["f1"][own]), ("n2", (came == best["f2"][own]) & (best["n2"][own] > 0)), ("n", None)):
            best[name][own[by]] -= np.repeat(times if what is None else np.add.reduceat(what[by].astype(np.int64), first), times)
    other = best["n2"] > best["n1"]
    word, count = np.where(other, best["f2"], best["f1"]), np.where(other, best["n2"], best["n1"])
    sure = count > 0
    some, doc = some[sure], doc[sure]
    foretold[some] = True
    hit[some] = word[sure] == follower[some].astype(np.int64)
    base = model.followers[cell(count[sure], best["n"][sure])]
    # What the document has shown so far: hits against those expected, from its start on.
    p = 1 / (1 + np.exp(-base))
    starts = np.repeat(np.flatnonzero(new := np.diff(doc, prepend=-1) != 0), np.diff(np.append(np.flatnonzero(new), len(doc))))
    before = lambda x: (s := np.concatenate(([0.0], np.cumsum(x))))[:-1] - s[starts]
    mean, strength = 0.2, 4.0
    tries = np.arange(len(doc)) - starts + strength
    shown, expected = ((before(x) + strength * mean) / tries for x in (hit[some].astype(float), p))
    odds[some] = np.clip(base + np.log(shown / (1 - np.minimum(shown, 0.9999))) - np.log(expected / (1 - np.minimum(expected, 0.9999))), -10, 10)
    return foretold, hit, odds


def gathered(docs: DataFrame, folds: int, held: int):
    """The catalogue of chunks, the settled blocks, and the number of blocks of each kind."""
    chunks = stored(chunks_of(docs, folds, held, shared_folder(docs.sparkSession, "lm-chunks")), "lm-catalogue")
    tokens = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    blocks = {0: 1 + tokens // 2_000_000, 1: 1 + tokens // 1_500_000, 2: 1 + tokens // 3_000_000}
    names = "kind int, block int, chunk long, a binary, b binary, n binary"
    return chunks, stored(messages(chunks, blocks).groupBy("kind", "block").applyInPandas(settle, names), "lm-blocks", "zstd"), blocks


def language_scores(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``docs(doc_id, text)``."""
    chunks, found, blocks = gathered(docs, folds, held)
    model = docs.sparkSession.sparkContext.broadcast(fit(found))  # of bounded size, see MOST_SLOTS

    def score(left, right):
        import numpy as np
        import pandas as pd

        returned()
        model_, right = model.value, right.sort_values("block")
        known = np.concatenate([unplanes(x, 8).astype(np.int64) for x in right["n"][right["kind"] == 0]])
        row = left.iloc[0]
        words, doc_ids, held_out, lengths, places = read_chunk(row["path"], int(row["offset"]), int(row["bytes"]))
        hashes = word_hashes(words)
        counts = np.empty(len(words), np.int64)
        counts[np.argsort(hashes)] = known
        train, every = ~held_out, model_.train_tokens + model_.distinct + 1
        spelt, ends = spelling(words), np.cumsum(lengths)
        doc_bytes = np.add.reduceat(spelt[2][places], ends - lengths)
        pairs = pair_keys(hashes, places, lengths, blocks[1])
        follower = hashes[places] & np.uint64(FOLLOWERS)
        order = np.argsort(pairs)
        sorted_pairs = pairs[order]
        new = np.concatenate(([True], sorted_pairs[1:] != sorted_pairs[:-1]))
        asked, rank = sorted_pairs[new], np.empty(len(pairs), np.int32)
        rank[order] = np.cumsum(new) - 1
        parts, known = {x: [] for x in ("f1", "f2", "n1", "n2", "n")}, np.full(len(asked), -1)
        many = 0
        for block, a, b, n in right.loc[right["kind"] == 1, ["block", "a", "b", "n"]].itertuples(index=False):
            here = int(np.searchsorted(asked, np.uint64(block << 32))) + unrising(a, 4).astype(np.int64)
            known[here] = np.arange(many, many + len(here))
            many += len(here)
            for name, column in zip(("f1", "f2"), _columns(b, 2)):
                parts[name].append(column)
            for name, column in zip(("n1", "n2", "n"), _columns(n, 3)):
                parts[name].append(column)
        answers = {x: np.concatenate(v) if v else np.zeros(0, np.uint64) for x, v in parts.items()}
        del pairs, order, sorted_pairs, new, asked, right, parts, hashes
        returned()
        out = []
        for a, b in _batches(np.cumsum(doc_bytes), SCORED_BYTES):
            lo, hi, own = int(ends[a] - lengths[a]), int(ends[b - 1]), lengths[a:b]
            data, first, starts = stream(spelt, places[lo:hi], own)
            price = np.add.reduceat(spelled(model_, data, starts, train[a:b]), first)
            foretold, hit, odds = followed(model_, known.take(rank[lo:hi]), follower[lo:hi], train[a:b], own, answers)
            chance = 1 / (1 + np.exp(-odds))
            price = np.where(foretold, np.where(hit, np.log10(chance), np.log10(1 - chance) + price), price)
            seen, cut = counts[places[lo:hi]], np.cumsum(own) - own
            total = np.add.reduceat(price, cut)
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": nullable(doc_ids[a:b]),
                        "held_out": ~train[a:b],
                        "n_tokens": own,
                        "n_known": np.add.reduceat((seen > 0).astype(np.int64), cut),
                        "train_tokens": model_.train_tokens,
                        "base_score": np.add.reduceat(np.log10(seen + 1.0), cut) - own * np.log10(float(every)),
                        "score": total,
                        "bits_per_byte": -total / np.log10(2.0) / doc_bytes[a:b],
                    }
                )
            )
        return pd.concat(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    replies = found.where("kind in (0, 1)").select(F.col("chunk").alias("home"), "kind", "block", "a", "b", "n")
    return chunks.groupBy("chunk").cogroup(replies.groupBy("home")).applyInPandas(score, schema)
