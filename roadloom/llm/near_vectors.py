"""Near-duplicate vectors by sorted projection passes.

A pass gives every vector a key of random-hyperplane bits (64 hashes, concatenated),
orders all vectors by it and compares each with its next ``window`` neighbours in
double precision. Vectors of cosine c share a leading bit with probability
1 - arccos(c)/pi, so a pair meets in a window of n vectors with about that to the
power log2(n / window); the number of passes follows from n, to meet pairs at the
threshold with probability ``recall``. Verified pairs of all passes are united into
components; a task passes on only the links that join components it has not yet
joined, so a dense group gives links in proportion to its size.

What the passes miss is then searched exactly. Every vector belongs to the cell of
its nearest pivot (pivots are vectors of the table), and cells are dealt into blocks
of bounded size. By the triangle inequality on the sphere a vector can link into a
cell only if its angle to the pivot is at most the cell's radius plus the threshold
angle; all blocks it can link into are compared with it, and links that join
different components are added. So the passes decide how much work is left, not the
result. Where cells are wide (no direction preferred in many dimensions) nothing can
be excluded and the search takes all pairs of blocks.

Links within a component are then counted completely, not only those met in a
window. Members within half the threshold angle of the component's mean direction
(the core) are all linked with each other by the triangle inequality on the
sphere, so they are counted, not compared. The other members are queries against
their whole component, in blocks of bounded size.

A vector that is null, empty, zero or has null or non-finite components links
with nothing, and so does one with a null vec_id (its component is null and it is
kept). Vectors of different lengths never link. Rows that repeat a vec_id are
vectors each. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import stored
from roadloom.llm.components import connected_components


#: Vectors travel through the passes in single precision: cosines nearer to the threshold are decided afterwards.
SINGLE = 1e-6


def passes_needed(n: int, window: int, cosine: float, recall: float) -> int:
    """Passes for pairs at ``cosine`` among ``n`` vectors to share a window at least once."""
    bit = 1 - math.acos(cosine) / math.pi
    met = bit ** max(1.0, math.log2(max(2.0, n / window)))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def _unit(matrix):
    import numpy as np

    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(norms > 0, norms, 1)[:, None]


def _windows(window: int, cosine: float):
    """Links between neighbours of one sorted partition; rows: pass, key, dim, id, vector."""

    def run(batches):
        import numpy as np
        import pandas as pd

        parent: dict[int, int] = {}
        tail = None

        def find(x):
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for lo in range(0, len(batch), 2000):
                rows = batch.iloc[lo : lo + 2000]
                if tail is not None:
                    rows = pd.concat([tail, rows], ignore_index=True)
                tail, links = rows.iloc[-window:], []
                ids, passes, dims = rows["id"].to_numpy(), rows["pass"].to_numpy(), rows["dim"].to_numpy()
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    x = _unit(np.array(rows["vector"].iloc[at].tolist(), dtype=np.float64))
                    for step in range(1, min(window, len(at) - 1) + 1):
                        cosines = np.einsum("ij,ij->i", x[step:], x[:-step])
                        for i in np.flatnonzero((cosines >= cosine - SINGLE) & (passes[at[step:]] == passes[at[:-step]])).tolist():
                            a, b = int(ids[at[i]]), int(ids[at[i + step]])
                            ra, rb = find(a), find(b)
                            if ra != rb:
                                links.append((a, b))
                                if cosines[i] >= cosine + SINGLE:  # sure to be confirmed
                                    parent[max(ra, rb)] = min(ra, rb)
                yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
                if len(parent) > 500_000:  # bounded memory: later links may only repeat
                    parent.clear()

    return run


def _count_links(cosine: float):
    """How many targets of the block each query is linked with."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        queries, targets = pdf[pdf["query"]], pdf[~pdf["query"]]
        ids, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(queries) and len(targets):
            q, t = (_unit(np.array(x["vector"].tolist(), dtype=np.float64)) for x in (queries, targets))
            linked = (q @ t.T >= cosine) & (queries["id"].to_numpy()[:, None] != targets["id"].to_numpy()[None, :])
            # Both ends gain a link; where both are queries the mirrored block gives the other end.
            core = targets["core"].to_numpy()
            ids = np.concatenate((queries["id"].to_numpy(), targets["id"].to_numpy()[core]))
            n = np.concatenate((linked.sum(1), linked[:, core].sum(0)))
        return pd.DataFrame({"id": ids, "n": n})

    return run


def _crossing(cosine: float):
    """Links between components within one pair of blocks: one for each pair of components, and all too near the threshold to be sure of."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        lo = int(pdf["lo"].iloc[0])
        first, second = pdf[pdf["own"] == lo], pdf[pdf["own"] == int(pdf["hi"].iloc[0])]
        links = []
        if len(first) and len(second):
            x, y = (np.frombuffer(b"".join(side["unit"]), "<f4").reshape(len(side), -1) for side in (first, second))
            a, b = first["id"].to_numpy(), second["id"].to_numpy()
            names, codes = np.unique(np.concatenate((first["component"], second["component"])), return_inverse=True)
            ca, cb, n = codes[: len(a)], codes[len(a) :], len(names)
            slack = SINGLE + 1.2e-7 * x.shape[1]
            root = np.arange(n)

            def find(i):
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            for at in range(0, len(a), 500):
                cosines, ka = x[at : at + 500] @ y.T, ca[at : at + 500]
                i, j = np.nonzero((cosines >= cosine - slack) & (ka[:, None] != cb[None, :]))
                if not len(i):
                    continue
                sure = cosines[i, j] >= cosine + slack
                links += zip(a[at + i[~sure]].tolist(), b[j[~sure]].tolist())
                i, j = i[sure], j[sure]
                _, one = np.unique(ka[i].astype(np.int64) * n + cb[j], return_index=True)
                for k in one.tolist():
                    ra, rb = find(ka[i[k]]), find(cb[j[k]])
                    if ra != rb:
                        links.append((int(a[at + i[k]]), int(b[j[k]])))
                        root[max(ra, rb)] = min(ra, rb)
                every = np.array([find(k) for k in range(n)])
                ca, cb, root = every[ca], every[cb], np.arange(n)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def crossing_links(good: DataFrame, component: DataFrame, cosine: float, block: int = 16_384, most: int = 1024) -> DataFrame:
    """(a, b): candidates for all links of ``good(id, vector, dim)`` that join different components."""
    import numpy as np

    angle = math.acos(cosine) + 1e-4
    sizes = {r["dim"]: r["n"] for r in good.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    ranked = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id")
    wanted = F.least(F.lit(most), F.ceil(F.col("n") / block))
    per_dim = good.groupBy("dim").agg(F.count("*").alias("n"))
    # Candidates for pivots by hash: about 20 times as many as needed, ranked, so that no task orders a whole table.
    some = good.join(F.broadcast(per_dim), "dim").where(F.pmod(F.xxhash64("id", F.lit(5)), F.ceil(F.col("n") / (20 * wanted))) == 0)
    chosen = some.withColumn("at", F.row_number().over(ranked)).where(F.col("at") <= wanted).select("dim", "vector").collect()
    pivots = {d: [r["vector"] for r in chosen if r["dim"] == d] for d in sizes}
    # Any direction serves where no row was drawn.
    pivots = {d: _unit(np.array(p if p else [[1.0] * d], dtype=np.float64)) for d, p in pivots.items()}

    def angles(x, dim):
        import numpy as np

        return np.arccos(np.clip(x @ pivots[dim].T, -1, 1))

    def nearest(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for dim, same in batch.groupby("dim"):
                far = angles(_unit(np.array(same["vector"].tolist(), dtype=np.float64)), int(dim))
                yield pd.DataFrame({"dim": same["dim"], "cell": far.argmin(1).astype(np.int32), "angle": far.min(1)})

    cells = good.select("dim", "vector").mapInPandas(nearest, "dim int, cell int, angle double")
    cells = cells.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).orderBy("dim", "cell").collect()
    blocks: dict = {}  # of a dimension: cell, radius, first block, blocks
    first = 0
    for c in cells:
        many = math.ceil(c["n"] / block)
        blocks.setdefault(c["dim"], []).append((c["cell"], c["radius"], first, many))
        first += many

    def dealt(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for lo in range(0, len(batch), 2000):
                for dim, same in batch.iloc[lo : lo + 2000].groupby("dim"):
                    x = _unit(np.array(same["vector"].tolist(), dtype=np.float64))
                    far, packed = angles(x, int(dim)), [v.tobytes() for v in x.astype("<f4")]
                    near, ids, names = far.argmin(1), same["id"].to_numpy(), same["component"].to_numpy()
                    own = np.zeros(len(x), np.int64)
                    for cell, _, begin, many in blocks[int(dim)]:
                        at = near == cell
                        own[at] = begin + (ids[at] ^ (ids[at] >> 33)) % many
                    for cell, radius, begin, many in blocks[int(dim)]:
                        at = np.flatnonzero(far[:, cell] <= radius + angle)
                        for other in range(begin, begin + many):
                            if len(at):
                                yield pd.DataFrame({"lo": np.minimum(own[at], other), "hi": np.maximum(own[at], other), "own": own[at], "id": ids[at], "component": names[at], "unit": [packed[k] for k in at]})

    rows = good.select("id", "vector", "dim").join(component.withColumnRenamed("node", "id"), "id", "left")
    rows = rows.withColumn("component", F.coalesce("component", "id"))
    rows = rows.mapInPandas(dealt, "lo long, hi long, own long, id long, component long, unit binary")
    return rows.groupBy("lo", "hi").applyInPandas(_crossing(cosine), "a long, b long")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, window: int = 32, recall: float = 0.98, seed: int = 7, block: int = 2000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding)``."""
    raw = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), raw.alias("vector"))
    fine = F.size("vector") > 0
    fine &= F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine &= F.exists("vector", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))
    # Scaled by the largest component, so that norms neither vanish nor overflow; ids of our own tell repeated rows apart.
    top = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    scaled = F.when(F.col("usable"), F.transform("vector", lambda x: x / F.col("top")))
    rows = rows.withColumn("usable", usable).withColumn("top", top).withColumn("vector", scaled).drop("top")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    good = rows.where("usable").select(F.col("row").alias("id"), "vec_id", "vector", F.size("vector").alias("dim"))
    n = good.count()
    passes = passes_needed(n, window, cosine, recall)

    def keyed(batches):
        import numpy as np
        import pandas as pd

        planes: dict = {}
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.iloc[lo : lo + 2000]
                for dim, same in part.groupby("dim"):
                    if dim not in planes:
                        planes[dim] = np.random.Generator(np.random.PCG64([seed, int(dim)])).standard_normal((passes * 64, int(dim)))
                    x = np.array(same["vector"].tolist(), dtype=np.float64)
                    bits = (x @ planes[dim].T >= 0).reshape(len(x), passes, 64)
                    keys = np.packbits(bits, axis=2).view(">u8")[:, :, 0].astype(np.uint64)
                    keys = (keys ^ np.uint64(1 << 63)).view(np.int64)  # the same order as signed
                    yield pd.DataFrame(
                        {
                            "pass": np.tile(np.arange(passes, dtype=np.int32), len(x)),
                            "key": keys.ravel(),
                            "dim": np.full(len(x) * passes, dim, np.int32),
                            "id": np.repeat(same["id"].to_numpy(), passes),
                            "vector": [v for v in same["vector"] for _ in range(passes)],
                        }
                    )

    order = ["dim", "pass", "key", "id"]
    spread = good.select("id", "dim", "vector").mapInPandas(keyed, "pass int, key long, dim int, id long, vector array<float>")
    links = spread.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_windows(window, cosine), "a long, b long")
    # Keys travel with vectors in single precision; what they find is verified in double.
    found = stored(links.distinct(), "vector-candidates")
    ends = lambda c: good.select(F.col("id").alias(c), F.col("vector").alias(f"v{c}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, z: acc + z)
    exact = dot("va", "vb") >= cosine * F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb"))
    verified = stored(found.join(ends("a"), "a").join(ends("b"), "b").where(exact).select("a", "b"), "vector-links")
    component = connected_components(verified)
    # What no pass met: links between components.
    crossing = stored(crossing_links(good, component, cosine).distinct(), "vector-crossing")
    crossing = stored(crossing.join(ends("a"), "a").join(ends("b"), "b").where(exact).select("a", "b"), "vector-joining")
    if crossing.limit(1).count():
        component = connected_components(verified.unionByName(crossing))

    # Complete counts within components.
    members = stored(good.join(component.withColumnRenamed("node", "id"), "id").select("id", "vec_id", "component", "vector"), "vector-members")
    unit = F.transform("vector", lambda x: x / F.sqrt(F.col("norm2")))
    members = members.withColumn("norm2", dot("vector", "vector")).withColumn("unit", unit).drop("norm2")
    means = members.select("component", F.posexplode("unit").alias("i", "x")).groupBy("component", "i").agg(F.sum("x").alias("x"))
    means = means.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m")).select("component", F.transform("m", lambda e: e["x"]).alias("mean"))
    half = math.cos(math.acos(cosine) / 2) + 1e-9
    marked = members.join(means, "component").withColumn("core", dot("unit", "mean") >= half * F.sqrt(dot("mean", "mean")))
    marked = stored(marked.select("id", "vec_id", "component", "vector", "core"), "vector-cores")
    sizes = marked.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.col("core").cast("long")).alias("cores"), F.min("vec_id").alias("component_id"))
    sizes = stored(sizes, "vector-sizes")
    outer = marked.join(sizes.where("n > cores"), "component")
    blocks = lambda x: F.greatest(F.lit(1), F.ceil(x / F.lit(float(block)))).cast("int")
    outer = outer.withColumn("tbs", blocks(F.col("n"))).withColumn("qbs", blocks(F.col("n") - F.col("cores")))
    place = lambda k, salt: F.pmod(F.xxhash64("id", F.lit(salt)), k).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    columns = ["component", "qb", "tb", "query", "id", "core", "vector"]
    targets = outer.withColumn("tb", place(F.col("tbs"), 1)).withColumn("qb", each(F.col("qbs"))).withColumn("query", F.lit(False)).select(columns)
    queries = outer.where("not core").withColumn("qb", place(F.col("qbs"), 2)).withColumn("tb", each(F.col("tbs"))).withColumn("query", F.lit(True)).select(columns)
    counted = targets.unionByName(queries).groupBy("component", "qb", "tb").applyInPandas(_count_links(cosine), "id long, n long")
    counted = counted.groupBy("id").agg(F.sum("n").alias("more"))

    linked = marked.join(sizes.select("component", "cores", "component_id"), "component").join(counted, "id", "left")
    own = F.when(F.col("core"), F.col("cores") - 1).otherwise(0) + F.coalesce("more", F.lit(0))
    linked = linked.select("vec_id", own.alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    single = good.join(component.select(F.col("node").alias("id")), "id", "left_anti")
    single = single.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(single).unionByName(alone)
