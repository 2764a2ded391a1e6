"""Connected components of a link table by alternating star contractions.

Each round replaces links by links to the smallest neighbour (large star, then
small star; Kiveris et al. 2014), so it ends in O(log^2 n) rounds for any shape.
Rounds are joins and partially aggregated minima; nothing is collected but the
two counters that decide when to stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import checkpoint


def _forest(batches):
    """Spanning stars of the links that one task holds: (node, smallest node of its local component)."""
    import pandas as pd

    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars():
        nodes = list(parent)
        pairs = [(n, r) for n in nodes if (r := find(n)) != n]
        return pd.DataFrame({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}, dtype="int64")

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 1_000_000:  # bounded memory: pass on what is known and start anew
            yield stars()
            parent.clear()
    yield stars()


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component = smallest reachable node.

    Self-links, repeated links and either direction are accepted; links with a
    null end are ignored; no links give no rows.
    """
    pairs = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    pairs = pairs.where("a is not null and b is not null and a <> b")
    pairs = checkpoint(pairs.mapInPandas(_forest, "a long, b long").distinct())
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u links to u's smallest neighbour (or u itself).
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: neighbours not above u, and u, link to the smallest of them.
        down = large.where("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
        nxt = checkpoint(small.where("a <> b").distinct())
        # Stars at rest: every node has one link, and no target has a link of its own.
        sources = nxt.groupBy("a").agg(F.count("*").alias("n"))
        many = sources.where("n > 1").limit(1).count()
        chained = many or nxt.select(F.col("b").alias("a")).distinct().join(sources, "a", "left_semi").limit(1).count()
        pairs = nxt
        if not chained:
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
