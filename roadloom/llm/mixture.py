"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents may belong to several sources. They are aggregated by membership
pattern (the set of their sources), so the flow has a node for each pattern and
each source, however many documents there are: a pattern supplies its words once
at cost 0, a second time at cost 1, and so on (repetition costs are convex), and
a source takes words up to its quota. Costs sit on supply arcs alone, so raising
the supplies layer by layer and augmenting gives the cheapest maximal flow.

A pattern's flow is turned into whole documents: all of them ``flow // words``
times, and once more the documents first in a seeded order until the rest is
filled. The cut in that order is found by partially aggregated sums over hash
buckets; only the one bucket that holds the cut is gone through document by
document, taking what still fits.

A null text has size 0; a null source is a source of its own, last in order; a null
doc_id is an ordinary row; rows that repeat (doc_id, sources, size) share one
decision; a text of any length is one document; an empty table gives no rows. Extra
columns are kept by ``mixed_documents`` and not read otherwise.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import SPACE, exact_id, ids_of, stored, text_or_empty


def word_count() -> Column:
    return F.size(F.array_remove(F.split(text_or_empty(), SPACE), "")).cast("long")


def source_targets(sizes: dict, weights=(3, 1, 2), share: float = 1.5, repeats: int = 2) -> dict:
    """Word targets by source: ``share`` of all words by weight, none above ``repeats`` times its source.

    Sources take the weights in turn, ordered by code point, null last.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    free, capped = list(order), {}
    while free:
        scale = max(0.0, total - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * scale > repeats * sizes[s]]
        if not over:
            return capped | {s: weight[s] * scale for s in free}
        capped |= {s: float(repeats * sizes[s]) for s in over}
        free = [s for s in free if s not in capped]
    return capped


class Flow:
    """Maximal flow by shortest augmenting levels; capacities may be raised between runs."""

    def __init__(self, n: int):
        self.to, self.cap, self.out = [], [], [[] for _ in range(n)]

    def arc(self, a: int, b: int, cap: int) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.cap += [cap, 0]
        return len(self.to) - 2

    def run(self, start: int, end: int) -> None:
        while True:
            level, queue = {start: 0}, deque([start])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.cap[e] and self.to[e] not in level:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if end not in level:
                return
            tried, path, at = [0] * len(self.out), [], start
            while True:
                if at == end:
                    push = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= push
                        self.cap[e ^ 1] += push
                    path, at = [], start
                elif tried[at] < len(self.out[at]):
                    e = self.out[at][tried[at]]
                    if self.cap[e] and level.get(self.to[e]) == level[at] + 1:
                        path.append(e)
                        at = self.to[e]
                    else:
                        tried[at] += 1
                elif path:
                    at = self.to[path.pop() ^ 1]
                    tried[at] += 1
                else:
                    break


def route(patterns: dict, quotas: dict, repeats: int) -> dict:
    """Words that each pattern (tuple of sources) supplies: all quotas met as far as can be, with the least repetition."""
    names, sources = list(patterns), list(quotas)
    flow = Flow(len(names) + len(sources) + 2)
    start, end = len(names) + len(sources), len(names) + len(sources) + 1
    place = {s: len(names) + i for i, s in enumerate(sources)}
    supply = [flow.arc(start, i, 0) for i in range(len(names))]
    for i, p in enumerate(names):
        for s in p:
            flow.arc(i, place[s], repeats * patterns[p])
    for s in sources:
        flow.arc(place[s], end, quotas[s])
    for _ in range(repeats):  # layer by layer, the cheapest first
        for i, p in enumerate(names):
            flow.cap[supply[i]] += patterns[p]
        flow.run(start, end)
    return {p: flow.cap[supply[i] ^ 1] for i, p in enumerate(names)}


def _fill(room_column: str = "room"):
    """Within the bucket of the cut: take documents in order while they fit, then one more if that comes nearer."""

    def run(pdf):
        pdf = pdf.sort_values(["order", "words", "no_doc_id", "doc_id"], kind="stable")
        room = int(pdf[room_column].iloc[0])
        extra = []
        for words in pdf["words"].tolist():
            extra.append(int(words <= room))
            room -= words if words <= room else 0
        left = [(abs(room - w), i) for i, (w, x) in enumerate(zip(pdf["words"].tolist(), extra)) if not x]
        if left and min(left)[0] < room:
            extra[min(left)[1]] = 1
        return pdf.assign(doc_id=ids_of(pdf), extra=extra)[["doc_id", "pattern", "size", "extra"]].astype({"extra": "int32"})

    return run


def mixture(rows: DataFrame, weights=(3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 29, rows_a_bucket: int = 2000, max_patterns: int = 1_000_000):
    """(doc_id, pattern, size, copies) for the distinct rows of ``rows(doc_id, pattern, size)``, with sizes and targets by source.

    ``pattern`` is the JSON of a sorted array of sources. More than
    ``max_patterns`` distinct patterns are an error: the flow runs on the driver.
    """
    spark = rows.sparkSession
    keys = stored(rows.groupBy("doc_id", "pattern", "size").agg(F.count("*").alias("m")).withColumn("words", F.col("size") * F.col("m")), "mix-keys")
    found = keys.groupBy("pattern").agg(F.sum("words").alias("words"), F.count("*").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    members = {r["pattern"]: tuple(json.loads(r["pattern"])) for r in found}
    sizes: dict = {}
    for r in found:
        for s in members[r["pattern"]]:
            sizes[s] = sizes.get(s, 0) + r["words"]
    targets = source_targets(sizes, weights, share, repeats)
    supply = route({members[r["pattern"]]: r["words"] for r in found}, {s: round(t) for s, t in targets.items()}, repeats)
    plan = [(r["pattern"], f // r["words"] if r["words"] else 0, f % r["words"] if r["words"] else 0, max(1, r["n"] // rows_a_bucket)) for r in found for f in [supply[members[r["pattern"]]]]]
    plan = F.broadcast(spark.createDataFrame(plan, "pattern string, base int, rest long, buckets int"))  # at most max_patterns rows

    order = F.xxhash64(F.lit(seed), "doc_id", "size", "pattern")
    keys = keys.join(plan, "pattern").withColumn("order", order).withColumn("bucket", F.pmod(F.col("order"), F.col("buckets")).cast("int"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = keys.groupBy("pattern", "bucket").agg(F.sum("words").alias("w")).withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    keys = keys.join(sums, ["pattern", "bucket"]).withColumn("room", F.col("rest") - F.col("before"))
    keys = keys.withColumn("place", F.when(F.col("w") <= F.col("room"), 1).when(F.col("room") > 0, 0).otherwise(-1))
    cut = keys.where("place = 0").select(*exact_id(), "pattern", "size", "words", "order", "room")
    filled = cut.groupBy("pattern").applyInPandas(_fill(), "doc_id long, pattern string, size long, extra int")
    sure = keys.where("place <> 0").select("doc_id", "pattern", "size", F.when(F.col("place") == 1, 1).otherwise(0).alias("extra"))
    copies = sure.unionByName(filled).join(plan.select("pattern", "base"), "pattern")
    return copies.select("doc_id", "pattern", "size", (F.col("base") + F.col("extra")).alias("copies")), sizes, targets


def _pattern(sources: Column) -> Column:
    return F.to_json(F.sort_array(F.array_distinct(sources)), {"ignoreNullFields": "false"})


def mixed_counts(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row, for documents of one source each."""
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _pattern(F.array(source)).alias("pattern"), word_count().alias("size")), "mix-rows")
    copies, sizes, targets = mixture(rows, **options)
    facts = [(json.dumps([s], ensure_ascii=False), sizes[s], float(targets[s])) for s in sizes]
    facts = F.broadcast(docs.sparkSession.createDataFrame(facts, "source_json string, source_size long, target double"))  # one row a source
    copies = copies.withColumnsRenamed({c: f"_{c}" for c in ("doc_id", "pattern", "size")})
    same = rows["doc_id"].eqNullSafe(copies["_doc_id"]) & (rows["pattern"] == copies["_pattern"]) & (rows["size"] == copies["_size"])
    out = rows.join(copies, same).join(facts, F.from_json("pattern", "array<string>") == F.from_json("source_json", "array<string>"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns."""
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _pattern(F.array(source)).alias("pattern"), word_count().alias("size")), "mix-rows")
    copies, _, _ = mixture(rows, **options)
    copies = copies.where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("pattern").alias("_in"), F.col("size").alias("_n"), F.col("copies").alias("_copies"))
    same = docs["doc_id"].eqNullSafe(copies["_id"]) & (_pattern(F.array(docs[source])) == copies["_in"]) & (word_count() == copies["_n"])
    out = docs.join(copies, same).withColumn("__roadloom_copy", F.explode(F.sequence(F.lit(1), copies["_copies"])))
    return out.select(*(docs[c] for c in docs.columns))
