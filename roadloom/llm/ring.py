"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring. Equal texts form one key, so
copies stay together; keys are hashed into a fixed number of ring cells, and a
cell goes to the first shard clockwise whose load stays within ``1 + slack`` of
the mean: what overflows a full shard continues clockwise. Keys too heavy for
that (more than ``heavy`` of a shard) are placed one by one before the cells, and
a key above a whole shard is dealt into salted parts, as no shard could hold it.

All work that grows with the data is DataFrame expressions: one scan of the
texts, partially aggregated sums by cell, and a window over (shard, bucket)
parts of a few thousand rows for the slots. The driver only walks the ring over
sums whose number is fixed by the parameters (``cells`` plus at most
``shards / heavy`` heavy keys and their parts).

Null and empty texts are one key of size 8; a null doc_id is an ordinary row;
repeated rows each get a slot; an empty table gives no rows. Extra columns are
not read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import stored, text_or_empty


def _point(*what) -> int:
    return int.from_bytes(hashlib.blake2b(repr(what).encode(), digest_size=8).digest(), "big")


class Ring:
    """Virtual nodes of ``shards`` on a 64-bit ring, and the loads so far."""

    def __init__(self, shards: int, vnodes: int, cap: float):
        points = sorted((_point("node", s, v), s) for s in range(shards) for v in range(vnodes))
        self.places, self.owners = [p for p, _ in points], [s for _, s in points]
        self.loads, self.cap = [0] * shards, cap

    def put(self, place: int, load: int) -> int:
        """The first shard clockwise from ``place`` that has room, or else the emptiest."""
        at, n, seen = bisect.bisect_left(self.places, place), len(self.owners), set()
        for i in range(n):
            shard = self.owners[(at + i) % n]
            if shard in seen:
                continue
            seen.add(shard)
            if self.loads[shard] + load <= self.cap:
                break
            if len(seen) == len(self.loads):
                shard = min(range(len(self.loads)), key=lambda s: (self.loads[s], s))
                break
        self.loads[shard] += load
        return shard


def shard_documents(docs: DataFrame, shards: int = 24, vnodes: int = 128, slack: float = 0.001, heavy: float = 0.002, cells: int = 16384, rows_a_bucket: int = 4000) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs(doc_id, text)``."""
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text_or_empty()).cast("long") + 8).alias("size"),
            F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
            F.xxhash64(text_or_empty()).alias("key"),
            F.monotonically_increasing_id().alias("row"),  # tells repeated rows apart where their text has to be split
        ),
        "ring-rows",
    )
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    mean = total / shards
    ring = Ring(shards, vnodes, (1 + slack) * mean)

    # Heavy keys: no more than shards / heavy of them can exist. One that fits in a shard stays whole.
    keys = rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > heavy * mean)
    parts = F.when(F.col("bytes") > ring.cap, F.ceil(F.col("bytes") / (mean / 2))).otherwise(1).cast("int")
    keys = F.broadcast(stored(keys.select("key", parts.alias("parts")), "ring-heavy"))
    rows = rows.join(keys, "key", "left").withColumn(
        "part", F.when(F.col("parts") == 1, 0).when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", "row"), F.col("parts") * 4).cast("int"))
    ).withColumn("cell", F.pmod(F.col("key"), F.lit(cells)).cast("int"))
    sums = rows.groupBy(F.when(F.col("part").isNull(), F.col("cell")).alias("cell"), F.when(F.col("part").isNotNull(), F.col("key")).alias("key"), "part").agg(F.sum("size").alias("bytes"))
    units = [(r["bytes"], r["cell"], r["key"], r["part"]) for r in sums.collect()]
    units = sorted((-b, _point("cell", c) if k is None else _point("key", k, p), c, k, p) for b, c, k, p in [(u[0], -1 if u[1] is None else u[1], u[2], u[3]) for u in units])
    by_cell, by_key = [0] * cells, []
    for minus, place, cell, key, part in units:
        shard = ring.put(place, -minus)
        if key is None:
            by_cell[cell] = shard
        else:
            by_key.append({"key": key, "part": part, "own": shard})

    own = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(by_key)), "array<struct<key:long,part:int,own:int>>")).alias("x")).select("x.*")
    placed = rows.join(F.broadcast(own), ["key", "part"], "left").withColumn(
        "shard", F.coalesce("own", F.element_at(F.from_json(F.lit(json.dumps(by_cell)), "array<int>"), F.col("cell") + 1))
    )
    buckets = max(1, math.ceil(n / shards / rows_a_bucket))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows")).select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("rank", F.row_number().over(within) - 1)
        .join(base, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).alias("slot"))
    )
