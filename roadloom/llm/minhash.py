"""Near-duplicate documents by one-permutation MinHash with optimal densification.

One pass over the texts hashes the distinct word shingles of a document once; the
hash's high bits choose a bin, the least hash of a bin is its value, and an empty
bin copies the value of a bin drawn by a hash of (bin, attempt) until that one is
filled (optimal densification), so a signature costs one permutation. Signatures
are cut into bands; documents that agree in a band share a bucket.

Links, with bounded pair counts:

1. Equal shingle sets are one class (128-bit fingerprint), represented by its
   smallest id; only representatives go on.
2. In every bucket the member found in most buckets is the hub of a star: each
   other member is compared with it, so n members give n - 1 candidate pairs.
3. Candidates are confirmed on the full shingle sets.
4. A star can miss a link between two members that do not resemble the hub. The
   members of buckets that still hold two or more components are compared in
   blocks: those outside the largest component are queries against all the rest.
   No pair is written out for that, and nothing is capped.

Words are maximal runs of non-white ASCII after lower-casing A-Z. A text with
fewer words than a shingle has its whole sequence as the only one; a null or
wordless text has none, links with nothing and is kept. A null doc_id links with
nothing, has a null component and is kept. Rows that repeat a doc_id share its
component. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import exact_id, ids_of, stored
from roadloom.llm.components import connected_components

#: Keys over which the rows of one hub or cluster are spread in joins.
SALTS = 32


def _shingle_sets(texts, k: int):
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    import numpy as np
    import xxhash

    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = [len(w) for w in words]
    flat = np.fromiter((xxhash.xxh3_64_intdigest(x) for w in words for x in w), np.uint64, sum(counts))
    prime, one, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

    def fold(columns):
        acc = columns[0] * prime
        for c in columns[1:]:
            acc = ((acc ^ (acc >> np.uint64(29))) + c) * prime
        acc ^= acc >> np.uint64(30)
        acc *= one
        acc ^= acc >> np.uint64(27)
        acc *= two
        return acc ^ (acc >> np.uint64(31))

    n = len(flat)
    full = fold([flat[i : n - k + 1 + i] for i in range(k)]) if n >= k else flat[:0]
    at, out = 0, []
    for c in counts:
        if c >= k:
            out.append(np.unique(full[at : at + c - k + 1]))
        elif c:
            out.append(fold([flat[at + i : at + i + 1] for i in range(c)]) ^ np.uint64(c))
        else:
            out.append(flat[:0])
        at += c
    return out


class OnePermutation:
    """Signatures of ``bands * rows`` bins, and their band keys."""

    ATTEMPTS = (24, 4096)

    def __init__(self, bands: int, rows: int, seed: int):
        import numpy as np

        self.np, self.bands, self.rows, self.bins = np, bands, rows, bands * rows
        draw = np.random.Generator(np.random.PCG64(seed))
        self.probes = draw.integers(0, self.bins, (self.ATTEMPTS[1], self.bins), dtype=np.int32)
        self.salts = draw.integers(1, 2**63, (bands, 1), dtype=np.uint64)

    def signature(self, hashes):
        np = self.np
        bins = ((hashes >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))  # hashes are sorted, so are their bins
        values, filled = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        values[bins[first].astype(np.int64)] = hashes[first]
        filled[bins[first].astype(np.int64)] = True
        empty, done = np.flatnonzero(~filled), 0
        for upto in self.ATTEMPTS:
            if not len(empty):
                break
            probes = self.probes[done:upto, empty]
            hit = filled[probes]
            which, found = hit.argmax(0), hit.any(0)
            source = probes[which, np.arange(len(empty))]
            values[empty[found]] = values[source[found]]
            empty, done = empty[~found], upto
        if len(empty):  # no attempt met a filled bin: the next filled one
            there = np.flatnonzero(filled)
            values[empty] = values[there[np.searchsorted(there, empty) % len(there)]]
        return values

    def keys(self, hashes):
        np = self.np
        rows = self.signature(hashes).reshape(self.bands, self.rows)
        acc = self.salts[:, 0].copy()
        for i in range(self.rows):
            acc = (acc ^ rows[:, i]) * np.uint64(0xD6E8FEB86659FD93)
            acc ^= acc >> np.uint64(32)
        return acc.view(np.int64)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, n, f1, f2, bands): set size, 128-bit fingerprint of the set, band keys."""

    def run(batches):
        import numpy as np
        import pandas as pd
        import xxhash

        hasher = OnePermutation(bands, rows, seed)
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo : lo + 1000]
                sets = _shingle_sets(part["text"], shingle)
                prints = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]
                yield pd.DataFrame(
                    {
                        "doc_id": ids_of(part),
                        "n": [len(s) for s in sets],
                        "f1": [p[0] for p in prints],
                        "f2": [p[1] for p in prints],
                        "bands": [hasher.keys(s) if len(s) else s.view(np.int64) for s in sets],
                    }
                )

    return docs.select(*exact_id(), "text").mapInPandas(run, "doc_id long, n long, f1 long, f2 long, bands array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, hashes) for the documents in ``ids``, whole sets."""

    def run(batches):
        import pandas as pd

        seen: set = set()
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo : lo + 1000]
                sets = _shingle_sets(part["text"], shingle)
                out = []
                for i, s in zip(part["doc_id"].tolist(), sets):
                    if len(s) and (what := (i, hash(s.tobytes()))) not in seen:
                        seen.add(what)
                        out.append((i, s.view("int64")))
                yield pd.DataFrame({"doc_id": [i for i, _ in out], "hashes": [s for _, s in out]})

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    return found.mapInPandas(run, "doc_id long, hashes array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity; the pairs of one ``a`` are spread over SALTS keys, to which its set is copied where there are pairs."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b", F.lit(5)), F.lit(SALTS)).cast("int"))
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb")), "b")
    wanted = pairs.select("a", "salt").distinct()
    both = both.join(wanted.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")), "a"), ["a", "salt"])
    na, nb = F.size("ha"), F.size("hb")
    near = both.where((100 * na >= percent * nb) & (100 * nb >= percent * na))
    common = F.size(F.array_intersect("ha", "hb")).cast("long")
    return near.withColumn("c", common).where(100 * F.col("c") >= percent * (F.size("ha") + F.size("hb") - F.col("c"))).select("a", "b").distinct()


def _compare(percent: int):
    """Of one block of queries against one block of targets: links that join different components, by exact overlap counts."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        queries, targets = pdf[pdf["query"]], pdf[~pdf["query"]]
        links, parent = [], {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        if len(queries) and len(targets):
            sizes = np.array([len(h) for h in targets["hashes"]])
            flat = np.concatenate([np.asarray(h, np.int64) for h in targets["hashes"]])
            words, flat = np.unique(flat, return_inverse=True)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            docs, parts = targets["doc_id"].to_numpy(), targets["component"].to_numpy()
            flag = np.zeros(len(words), np.int32)
            for doc, part, hashes in zip(queries["doc_id"].tolist(), queries["component"].tolist(), queries["hashes"]):
                hashes = np.asarray(hashes, np.int64)
                at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
                at = at[words[at] == hashes]
                flag[at] = 1
                common = np.add.reduceat(flag[flat], starts).astype(np.int64)
                flag[at] = 0
                near = (100 * common >= percent * (len(hashes) + sizes - common)) & (parts != part)
                for i in np.flatnonzero(near).tolist():
                    x, y = find(part), find(int(parts[i]))
                    if x != y:
                        parent[x] = y
                        links.append((doc, int(docs[i])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _missed(live: DataFrame, hubs: DataFrame, component: DataFrame, sets: DataFrame, percent: int, block: int = 1_000_000):
    """Links between members of a bucket that its star did not bring into one component; None if no bucket has such.

    The buckets concerned are joined into clusters. Within a cluster the documents
    outside its largest component are queries against all of it, in blocks of about
    ``block`` hashes, so a task holds two blocks whatever the cluster's size.
    """
    now = live.join(component.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    stars = stored(now.join(mixed, "bucket", "left_semi").join(hubs, "bucket").select("doc", "hub", "component"), "minhash-left")
    if stars.limit(1).count() == 0:
        return None
    clusters = connected_components(stars.select(F.col("doc").alias("a"), F.col("hub").alias("b")))
    members = clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).join(
        component.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left"
    )
    members = members.withColumn("component", F.coalesce("component", "doc_id")).join(sets, "doc_id")
    members = stored(members, "minhash-clusters")
    parts = members.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum(F.size("hashes")).alias("h"))
    plan = parts.groupBy("cluster").agg(F.max(F.struct("n", "component", "h")).alias("top"), F.sum("h").alias("h"))
    blocks = lambda h: F.ceil(h / F.lit(float(block))).cast("int")
    plan = plan.select("cluster", F.col("top.component").alias("largest"), F.greatest(F.lit(1), blocks(F.col("h"))).alias("tbs"), F.greatest(F.lit(1), blocks(F.col("h") - F.col("top.h"))).alias("qbs"))
    salt = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SALTS)).cast("int")
    members = members.withColumn("salt", salt)
    plan = members.select("cluster", "salt").distinct().join(plan, "cluster")
    members = members.join(plan.hint("merge"), ["cluster", "salt"])  # grows with the documents, so never broadcast
    place = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["cluster", "qb", "tb", "query", "doc_id", "component", "hashes"]
    targets = members.withColumn("tb", place(F.col("tbs"), 1)).withColumn("qb", each(F.col("qbs"))).withColumn("query", F.lit(False)).select(columns)
    queries = members.where("component <> largest").withColumn("qb", place(F.col("qbs"), 2)).withColumn("tb", each(F.col("tbs"))).withColumn("query", F.lit(True)).select(columns)
    # Dealt by block: a partitioning by cluster alone would do for the grouping, and leave all blocks of a cluster to one task.
    return targets.unionByName(queries).repartition("cluster", "qb", "tb").groupBy("cluster", "qb", "tb").applyInPandas(_compare(percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, seed: int = 11) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``.

    ``bands * rows`` bins: a pair at the default similarity of 0.8 shares no band
    with probability (1 - 0.8**6)**40 < 1e-5.
    """
    signed = stored(signatures(docs, shingle, bands, rows, seed), "minhash-signatures")
    reps = signed.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    reps = stored(reps, "minhash-classes")

    # Buckets with more than one class. Their hub is the member with the most such buckets: the most central one.
    members = reps.select(F.col("rep").alias("doc"), F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("bucket")
    live = stored(members.join(shared, "bucket", "left_semi").distinct(), "minhash-live")
    weights = live.groupBy("doc").agg(F.count("*").alias("weight"))
    hubs = live.join(weights, "doc").groupBy("bucket").agg(F.max_by("doc", F.struct("weight", -F.col("doc"))).alias("hub"))
    hubs = stored(hubs, "minhash-hubs")
    sets = stored(_sets_of(docs, weights.select(F.col("doc").alias("doc_id")), shingle), "minhash-sets")

    stars = live.join(hubs, "bucket").where("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    links = stored(_confirmed(stars, sets, percent), "minhash-links")
    component = connected_components(links)
    more = _missed(live, hubs, component, sets, percent)
    if more is not None:
        # Stored first: one stage with two Python operators would hold two workers a task.
        component = connected_components(links.unionByName(stored(more, "minhash-links")))

    found = signed.join(reps.select("f1", "f2", "rep"), ["f1", "f2"], "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    found = found.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "rep")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
