import base64
import hashlib
import math

import numpy as np
import pytest


def brute(rows, cosine):
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = []
    for i, v in rows:
        ok = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) if ok else None
        good.append(x / np.linalg.norm(x) if ok else None)
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if good[a] is not None and good[b] is not None and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[find(n)] = min(least.get(find(n), i), i) if i is not None else None
    return sorted((i if i is not None else -1, links[n], least[find(n)] if i is not None else -1) for n, (i, _) in enumerate(rows))


def test_near_vectors(spark):
    from roadloom.llm.near_vectors import near_vectors

    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(80)]
    centre, far = rng.standard_normal(16), rng.standard_normal(16)
    rows += [(i, (centre + rng.standard_normal(16) * 0.25).tolist()) for i in range(80, 150)]  # some linked, some not, few to all
    rows += [(i, (far + rng.standard_normal(16) * 0.02).tolist()) for i in range(150, 200)]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [1.0, None] + [0.0] * 14), (204, [float("nan")] + [1.0] * 15), (205, [1e30] * 16), (206, [1e-30] * 16), (207, [1.0] * 8), (208, [2.0] * 8)]
    rows += [rows[0], rows[0], (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id long, row long, component string").repartition(3)
    got = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], -1 if r["component_id"] is None else r["component_id"]) for r in near_vectors(df, recall=0.999).collect())
    assert got == brute(rows, 0.9)
    assert near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_a_hot_direction_are_all_found(spark):
    from roadloom.llm.near_vectors import near_vectors

    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre, dim = unit(rng.standard_normal(64)), 64
    # A cone about one direction whose members do not link by themselves, and pairs planted just above the threshold.
    cone = unit(0.85 * centre + math.sqrt(1 - 0.85**2) * unit(rng.standard_normal((2400, dim))))
    side = rng.standard_normal((150, dim))
    side = unit(side - (side * cone[:150]).sum(1, keepdims=True) * cone[:150])
    rows = np.concatenate((cone, 0.905 * cone[:150] + math.sqrt(1 - 0.905**2) * side))
    rows = [(i, v.tolist()) for i, v in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    x = np.array([v for _, v in rows])
    links = ((x @ x.T) >= 0.9).sum(1) - 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()}
    want = {i: (n, c) for i, n, c in brute(rows, 0.9)}
    assert {i: n for i, (n, _) in want.items()} == dict(enumerate(links.tolist()))
    assert got == want
    # Windows that end at every partition, and hardly a pass: the same rows.
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df, window=1, recall=0.1).collect()} == want


def test_crossing_links_of_many_cells(spark):
    from roadloom.llm.near_vectors import crossing_links

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((1, 16)) + 0.3 * rng.standard_normal((60, 16)) for _ in range(8)])
    good = spark.createDataFrame([(i, v.tolist(), 16) for i, v in enumerate(x)], "id long, vector array<double>, dim int")
    none = spark.createDataFrame([], "node long, component long")
    from roadloom.llm.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(crossing_links(good, none, 0.9, block=37)).collect()}
    want = {i: c for i, n, c in brute([(i, v.tolist()) for i, v in enumerate(x)], 0.9) if n}
    assert got == want


@pytest.mark.parametrize("least", [0, 10])
def test_archive_round_trip(spark, least):
    from roadloom.llm.warc import archived, read_archive, write_archive

    rows = [(i, f"http://x/{i}", f"<html>{i % 7} é</html>" * (i % 5)) for i in range(60)] + [(60, None, None), (61, "a\r\nb", ""), (62, "u", "z" * 200_000), (62, "u", "z" * 200_000), (None, "n", "only null"), (None, "n", "<html>1 é</html>")]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, newest long, sha string").repartition(3)
    newest = {}
    for i, _, h in rows:
        p = (h or "").encode()
        newest[p] = max((x for x in (newest.get(p), i) if x is not None), default=None)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= least and newest[p] is not None and i != newest[p]
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", newest[p] if again else None))
    key = lambda r: tuple((x is not None, x) for x in r)
    got = archived(pages, least).drop("url").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    files = write_archive(pages, f"{__import__('roadloom.llm.common', fromlist=['x']).shared_folder(spark, 'w')}", least)
    for split in (700, 10_000):  # records start in one range and end in another
        assert sorted(map(tuple, read_archive(files, split_bytes=split).drop("url").collect()), key=key) == sorted(want, key=key)
    bodies = read_archive(files, payloads=True).where("record_type = 'response'").select("payload").collect()
    assert {bytes(r[0]) for r in bodies} == {(h or "").encode() for _, _, h in rows}
    assert archived(pages.limit(0)).count() == 0


def test_magic_inside_a_record_is_passed_over():
    import io

    from roadloom.llm.warc import MAGIC, members, parse, record

    noise = MAGIC * 3 + b"\x00junk"
    data = record(1, "a", b"one", None, False) + noise + record(2, "b", b"two" * 1000, None, False)
    for step in (16, 64, 1 << 20):
        found = [parse(m)[0] for m in members(io.BytesIO(data), len(data), 0, len(data), step)]
        assert found == [1, 2]
    cut = [parse(m)[0] for a in range(0, len(data), 37) for m in members(io.BytesIO(data), len(data), a, min(a + 37, len(data)), 64)]
    assert cut == [1, 2]


def test_components(spark):
    from roadloom.llm.components import connected_components

    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 2000), (2000, 1500), (5, 5), (None, 3), (7, 8), (8, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1500: 1000, 2000: 1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
