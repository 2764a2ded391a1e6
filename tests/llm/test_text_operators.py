"""Each operator against a plain computation, over nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low_words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="session")
def word_json():
    from roadloom.llm.queries import tokenizer

    return tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="session")
def byte_json():
    from roadloom.llm.queries import tokenizer

    return tokenizer("byte_bpe_50k.json")


def exact_components(rows, k, percent=80):
    sets = {}
    for i, text, *_ in rows:
        if i is None:
            continue
        w = low_words(text)
        own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets[i] = own
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, texts, k):
    from roadloom.llm.minhash import near_duplicates

    got = near_duplicates(docs, shingle=k).collect()
    assert len(got) == len(texts)
    want = exact_components(texts, k)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_of_a_spread_group(spark):
    """A cloud whose members resemble their neighbours but not one hub: stars alone would miss links."""
    from roadloom.llm.minhash import near_duplicates

    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in range(i):
            w[(j * 3) % 200] = f"x{j}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == {i: c for i, (_, c) in exact_components(rows, 4).items()}


def test_signature_densification():
    from roadloom.llm.minhash import OnePermutation

    hasher = OnePermutation(40, 6, 1)
    one = hasher.signature(np.array([77 << 40], np.uint64))
    assert (one == 77 << 40).all()
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**64 - 1, 900, dtype=np.uint64))
    b = np.unique(np.concatenate((a[:800], rng.integers(0, 2**64 - 1, 100, dtype=np.uint64))))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((hasher.signature(a) == hasher.signature(b)).mean() - true) < 0.15


def test_quality_features(docs, texts):
    from roadloom.llm.quality import text_features

    got = Counter(tuple(r) for r in text_features(docs, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = Counter()
    for i, text, *_ in texts:
        t = text or ""
        w = WORD.findall(t)
        windows = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        often = Counter(windows)
        covered = {p for j, x in enumerate(windows) if often[x] > 1 for p in range(j, j + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))] += 1
    assert got == want


def test_binomial_tail(spark):
    from fractions import Fraction
    from math import comb

    from pyspark.sql import functions as F

    from roadloom.llm.quality import binomial_tail

    cases = [(0, 10), (0, 1), (1, 500), (3, 2000), (2, 40), (10, 400)]
    rows = spark.createDataFrame(cases, "k long, n long").withColumn("p", binomial_tail(F.col("k"), F.col("n"), 0.01)).collect()
    for r in rows:
        exact = 1.0 if r["k"] >= 0.01 * r["n"] else float(sum(comb(r["n"], i) * Fraction(1, 100) ** i * Fraction(99, 100) ** (r["n"] - i) for i in range(r["k"] + 1)))
        assert r["p"] == pytest.approx(exact, rel=1e-9)


def test_quality_cutoffs_hold_their_guarantee(spark):
    from roadloom.llm.quality import good_documents, quality_verdicts

    rows = [(i, " ".join(f"u{i}x{j}" + ("" if i % 5 else "###") for j in range(40)), "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i, *_ in rows] + [(1, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_verdicts(docs, labels, alpha=0.05).collect()}
    assert not any(got[i] for i in got if i % 5 == 0)
    assert all(got[i] for i in got if i % 5)
    few = labels.where("doc_id < 40")
    assert all(r["kept"] for r in quality_verdicts(docs, few).collect())  # too few labels prove nothing
    assert good_documents(docs, labels, alpha=0.05).columns == docs.columns
    assert good_documents(docs, labels, alpha=0.05).count() == 2400


def test_quality_cutoffs_of_a_small_stratum(spark):
    from roadloom.llm.quality import quality_verdicts

    # 500 good labels of each of four strata, and junk that no good document is like; one rule is useless.
    rows = [(i, " ".join(f"u{i}x{j}" + ("###" if i % 5 == 0 else "!" if i % 3 == 0 else "") for j in range(40)), "abcd"[i // 625]) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_verdicts(docs, labels).collect()}
    assert got == {i: i % 5 > 0 for i, *_ in rows}
    # What is as common among the good as alpha is not proved, however much it would catch.
    labels = spark.createDataFrame([(i, int(i % 5 > 0 or i % 45 == 0), 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in quality_verdicts(docs, labels).collect())


def test_quality_of_odd_rows(spark, docs, no_docs, texts):
    from roadloom.llm.quality import good_documents, quality_verdicts

    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality_verdicts(docs, labels).collect()
    assert len(rows) == len(texts)
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert quality_verdicts(no_docs, labels).count() == 0
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)


def test_token_counts(docs, no_docs, texts, byte_json):
    from roadloom.llm.token_count import token_counts
    from roadloom.llm.tokens import load

    library = load(byte_json)
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 1024) for i, t, *_ in texts)
    assert Counter(tuple(r) for r in token_counts(docs, byte_json, chunk=500, overlap=16).collect()) == want
    assert Counter(tuple(r) for r in token_counts(docs, byte_json).collect()) == want
    assert token_counts(no_docs, byte_json).count() == 0


def test_resynchronisation(byte_json):
    import random

    from roadloom.llm.token_count import Counter as Pieces
    from roadloom.llm.token_count import count_tokens
    from roadloom.llm.tokens import load

    library, pieces, rng = load(byte_json), Pieces(byte_json), random.Random(3)
    parts = ["hello", " world", "  ", "\n", " \t", "'s", "I'm", "123", "!!", "é", "<|endoftext|>", "<|endof", "text|>", " ", "中文", "a" * 50, " " * 40, " a", " b."]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))
        want = len(library.encode(t, add_special_tokens=False))
        assert count_tokens(library, t, rng.choice([40, 64, 200]), rng.choice([1, 33, 60])) == want
        assert pieces.count([t]) == [want]
    for t in ("x" * 3000, " " * 3000, "x" * 900 + " " + "y" * 900):
        assert count_tokens(library, t, 200, 16) == len(library.encode(t, add_special_tokens=False))


def test_piece_encoder(word_json, texts):
    import random

    from roadloom.llm.tokens import PieceEncoder, load

    encoder, library, rng = PieceEncoder(word_json), load(word_json), random.Random(5)
    parts = ["hello", " World", "  ", "\n", "'s", "I'm", "45", "!!", "É", "<|endoftext|>", "<|EndOfText|>", "<|endof", "text|>", "中文", "...", "a.", "b:", ".̸", "ΑΣ.", "İ", "».", ".'s", "ﬁ", "\x1c"]
    samples = [t for _, t, *_ in texts] + ["".join(rng.choice(parts) for _ in range(20)) for _ in range(500)]
    for got, text in zip(encoder.encode(samples), samples):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_simple8b_round_trip():
    from roadloom.llm import simple8b

    rng = np.random.default_rng(1)
    kinds = [lambda n: rng.integers(0, 2, n), lambda n: rng.integers(0, 49408, n), lambda n: rng.integers(0, 2**63, n) * 2 + 1, lambda n: np.where(rng.random(n) < 0.9, 0, rng.integers(0, 2**62, n))]
    for i in range(300):
        values = kinds[i % 4](int(rng.integers(0, 150))).astype(np.uint64)
        words, escapes = simple8b.encode(values)
        assert (simple8b.decode(words, escapes, len(values)) == values).all()
    words, _ = simple8b.encode(np.zeros(600, np.uint64))
    assert len(words) == 10


def test_token_store(docs, no_docs, texts, word_json, tmp_path, monkeypatch):
    from roadloom.llm import token_store
    from roadloom.llm.tokens import load

    library = load(word_json)
    rows = token_store.stored_tokens(docs, word_json, 2, f"file://{tmp_path}/a").collect()
    assert len(rows) == len(texts)
    ids = {}
    for i, t, *_ in texts:
        own = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        ids.setdefault(i, []).append((len(own), zlib.crc32(own.tobytes())))
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in ids[r["doc_id"]]
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_store.stored_tokens(no_docs, word_json, 2, f"file://{tmp_path}/b").count() == 0


def test_packing(docs, no_docs, texts, word_json):
    from roadloom.llm.packing import pack_documents
    from roadloom.llm.tokens import load

    library = load(word_json)
    rows = pack_documents(docs, word_json, capacity=256).collect()
    want = Counter()
    for i, t, *_ in texts:
        own = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(own), 256)):
            want[(i, k, a, len(own[a : a + 256]), zlib.crc32(own[a : a + 256].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert pack_documents(no_docs, word_json).count() == 0


def test_best_fit_decreasing_equals_one_by_one():
    import bisect
    import random

    from roadloom.llm.packing import best_fit_decreasing

    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([10, 64, 100])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 200))), reverse=True)
        room = []
        for n in lengths:
            at = bisect.bisect_left(room, n)
            left = (room.pop(at) if at < len(room) else capacity) - n
            bisect.insort(room, left)
        ranges, bins = best_fit_decreasing(Counter(lengths), capacity)
        assert bins == len(room)
        assert all(0 <= offset and offset + each * length <= capacity for length, _, _, each, offset in ranges)


def test_mixture(docs, no_docs, texts):
    from roadloom.llm.mixture import mixed_counts, mixed_documents, source_targets

    rows = mixed_counts(docs).collect()
    assert len(rows) == len(texts)
    sizes = {}
    for _, t, _, s in texts:
        sizes[s] = sizes.get(s, 0) + len(low_words(t))
    targets = source_targets(sizes)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(targets[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    taken = Counter()
    for r in rows:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
    for s in sizes:
        assert abs(taken[sizes[s]] - targets[s]) <= 0.03 * targets[s]
    again = Counter(tuple(r) for r in mixed_counts(docs.repartition(5)).collect())
    assert again == Counter(tuple(r) for r in rows)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(low_words(r["text"])) for r in out.select("text").collect()) == sum(taken.values())
    assert mixed_counts(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0


def test_flow_of_overlapping_sources():
    from roadloom.llm.mixture import route

    patterns = {("a",): 100, ("b",): 10, ("a", "b"): 60}
    got = route(patterns, {"a": 100, "b": 60}, 2)
    assert sum(got.values()) == 160 and all(got[p] <= 2 * patterns[p] for p in patterns)
    assert sum(max(0, got[p] - patterns[p]) for p in patterns) == 0  # no repetition is needed
    got = route(patterns, {"a": 100, "b": 100}, 2)
    assert sum(got.values()) == 200 and sum(max(0, got[p] - patterns[p]) for p in patterns) == 30


def test_sharding(docs, no_docs, texts):
    from roadloom.llm.ring import shard_documents

    rows = shard_documents(docs, shards=4, slack=0.05, heavy=0.05).collect()
    assert len(rows) == len(texts)
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    where = {}
    for r in rows:
        where.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(x) == 1 for x in where.values())  # copies stay together
    assert shard_documents(no_docs).count() == 0


def test_sharding_is_even_with_a_hot_text(spark):
    from roadloom.llm.ring import shard_documents

    docs = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('hot ', 20) else concat(id, repeat('x', cast(id % 90 as int))) end as text")
    rows = shard_documents(docs, shards=8).groupBy("shard").sum("size").collect()
    loads = [r[1] for r in rows]
    assert len(loads) == 8 and max(loads) <= 1.01 * sum(loads) / 8 and min(loads) >= 0.95 * sum(loads) / 8


def test_sharding_keeps_a_text_whole_that_fits(spark):
    from roadloom.llm.ring import shard_documents

    # One text of 0.9 shards, one of 2.2 shards, of rows that repeat.
    rows = [(1, "a" * 92)] * 90 + [(None, "b" * 92)] * 220 + [(i, f"{i:092d}") for i in range(490)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = shard_documents(docs, shards=8, slack=0.05, heavy=0.05).collect()
    by = {}
    for r in got:
        by.setdefault(r["text_crc32"], Counter())[r["shard"]] += 1
    assert len(by[zlib.crc32(b"a" * 92)]) == 1 and len(by[zlib.crc32(b"b" * 92)]) > 2
    loads = Counter(r["shard"] for r in got)
    assert len(loads) == 8 and max(loads.values()) <= 1.25 * 100


def test_sharding_by_the_plain_ring(spark):
    """Every row where a plain walk of the ring puts its text; one more shard moves little more than its share."""
    from roadloom.llm import ring as m

    rows = [(i, f"{i} " + "x" * (i * 37 % 200)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashed = dict(map(tuple, docs.selectExpr("doc_id", "xxhash64(text)").collect()))
    placed = {}
    for shards in (24, 25):
        sizes, total = Counter(), 0
        for i, t in rows:
            sizes[hashed[i]] += len(t) + 8
            total += len(t) + 8
        mean = total / shards
        points = sorted((m._point("node", s, v), s) for s in range(shards) for v in range(128))
        heavy = {k for k, b in sizes.items() if b > 0.002 * mean}
        units = Counter()
        for k, b in sizes.items():
            units[("key", k, 0) if k in heavy else ("cell", k % 64)] += b
        loads, where = [0] * shards, {}
        for b, place, u in sorted((-b, m._point(*u), u) for u, b in units.items()):
            walk = [s for p, s in points if p >= place] + [s for p, s in points if p < place]
            fits = next((s for s in walk if loads[s] - b <= 1.001 * mean), None)
            where[u] = min(range(shards), key=lambda s: (loads[s], s)) if fits is None else fits
            loads[where[u]] -= b
        placed[shards] = {r["doc_id"]: r["shard"] for r in m.shard_documents(docs, shards=shards, cells=64).collect()}
        assert placed[shards] == {i: where[("key", k, 0) if k in heavy else ("cell", k % 64)] for i, k in hashed.items()}
        assert max(loads) <= 1.02 * mean and min(loads) >= 0.9 * mean
    size = {i: len(t) + 8 for i, t in rows}
    moved = sum(size[i] for i, s in placed[24].items() if placed[25][i] != s)
    assert moved < 0.25 * sum(size.values())


def test_language_scores(docs, no_docs, texts):
    from math import log10

    from roadloom.llm.context_mixing import in_fold, language_scores

    rows = language_scores(docs).collect()
    assert len(rows) == len(texts)
    counts = Counter()
    for i, t, *_ in texts:
        if not in_fold(i, 7, 2):
            counts.update([*low_words(t), b" "])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, *_ in texts:
        w = [*low_words(t), b" "]
        want[(i, in_fold(i, 7, 2), len(w), sum(counts[x] > 0 for x in w), n, round(sum(log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)
    assert language_scores(no_docs).count() == 0
