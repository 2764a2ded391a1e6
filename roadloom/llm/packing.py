"""Best-fit-decreasing packing of token sequences.

Documents are encoded, ended with an id and cut into pieces of at most the
capacity. Best-fit decreasing treats pieces of one length alike, so it is run on
the table of lengths and their counts (as many rows as the capacity at most),
however many documents there are: a segment tree over remaining capacities finds
the tightest open bin in logarithmic time, and a whole run of equal pieces and
equal bins is placed at once, just as one by one. The result is a table of
ranges "the pieces of length L ranked lo.. go to bins base.. at offset o", whose
size depends on the capacity alone; pieces are ranked within their length by a
window over (length, hash bucket) and looked up in it.

Null texts are empty documents (the end id alone). A null doc_id is an ordinary
document; repeated rows are documents each; an empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import exact_id, id_list, nullable, stored
from roadloom.llm.tokens import PieceEncoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: how many open bins have each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        at = remaining + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least ``need`` that an open bin has."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:  # climb until a right sibling has bins, then keep left on the way down
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int):
    """Ranges (length, lo, base, each, offset): pieces of a length from rank lo on go, ``each`` a bin, to bins from ``base``; and the number of bins."""
    tree, open_bins, contents = CapacityTree(capacity), {}, [None]  # contents: (inner, length, each), a chain from the last put in

    def put(remaining: int, inside: int, n: int) -> None:
        open_bins.setdefault(remaining, []).append([inside, n])
        tree.add(remaining, n)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, inside, n = capacity, 0, left  # as many new bins as it takes
            else:
                inside, n = open_bins[remaining][-1]
            each = min(remaining // length, left)  # the bin just used is the tightest until it is full
            used = min(n, left // each)
            if inside:
                tree.add(remaining, -used)
                open_bins[remaining][-1][1] -= used
                if not open_bins[remaining][-1][1]:
                    open_bins[remaining].pop()
            contents.append((inside, length, each))
            put(remaining - each * length, len(contents) - 1, used)
            left -= used * each
    ranges, bins, next_rank = [], 0, dict.fromkeys(counts, 0)
    for groups in open_bins.values():
        for inside, n in groups:
            chain = []
            while inside:
                inner, length, each = contents[inside]
                chain.append((length, each))
                inside = inner
            offset = 0
            for length, each in reversed(chain):
                ranges.append((length, next_rank[length], bins, each, offset))
                next_rank[length] += n * each
                offset += each * length
            bins += n
    return sorted(ranges), bins


def document_pieces(docs: DataFrame, tokenizer_json: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece of each document, in the columns of PIECES."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one file of a few MB

    def run(batches):
        import pandas as pd

        encoder, end = PieceEncoder(shared.value), end_id.to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part, rows = batch.iloc[lo : lo + 500], []
                for i, ids in zip(id_list(part), encoder.encode(part["text"])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        rows.append((i, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield out.assign(doc_id=nullable([r[0] for r in rows]))

    return docs.select(*exact_id(), "text").mapInPandas(run, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int, rows_a_bucket: int = 2000) -> DataFrame:
    """``pieces`` with sequence_id and offset. They are read several times, so should be stored."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    ranges, _ = best_fit_decreasing(counts, capacity)
    buckets = max(1, sum(counts.values()) // rows_a_bucket)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "bucket"])
    others = [c for c in pieces.columns if c != "doc_id"]
    ranked = ranked.select(*exact_id(), *others, (F.col("base") + F.col("rank")).alias("rank"))
    table = pieces.sparkSession.sparkContext.broadcast(ranges)  # bounded by the capacity, not the data

    def run(batches):
        import numpy as np

        found = np.array(table.value, dtype=np.int64).reshape(-1, 5)
        key = found[:, 0] * 2**46 + found[:, 1]  # lengths below 2**17, ranks below 2**46
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            _, lo, base, each, offset = found[np.searchsorted(key, length * 2**46 + rank, side="right") - 1].T
            at = rank - lo
            yield batch.drop(columns="rank").assign(sequence_id=base + at // each, offset=offset + at % each * length)

    kept = ", ".join(f"{n} {t}" for n, t in pieces.dtypes if n != "doc_id")
    placed = ranked.mapInPandas(run, f"doc_id long, no_doc_id boolean, {kept}, sequence_id long, offset long")
    return placed.select(F.when(~F.col("no_doc_id"), F.col("doc_id")).alias("doc_id"), *others, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs(doc_id, text)``."""
    return pack_pieces(stored(document_pieces(docs, tokenizer_json, capacity, end_id), "packing-pieces"), capacity)
