"""The language model against a plain reading of one document after another."""

import math
import random
from collections import Counter

import numpy as np
import pytest


def words_of(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def spelling(words):
    return b"".join(w if w == b"\n" else w + b" " for w in words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    syllables = {"x": ["ka", "to", "mi", "re", "su", "no"], "y": ["bra", "kle", "stu", "gro", "fli"]}
    rows = []
    for i in range(160):
        own = rng.choice("xy")
        rows.append((i, " ".join("".join(rng.choice(syllables[own]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 80)))))
    rows += [(160, rows[0][1]), (161, rows[4][1] + " " + rows[4][1]), (162, None), (163, "Ä ß É"), (163, "a b a b a b a b"), (None, rows[7][1])]
    return rows


@pytest.fixture(scope="module")
def parts(spark, corpus):
    """The model and the scores, both from the same small corpus."""
    from roadloom.llm import context_mixing as m

    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    _, found, _ = m.gathered(docs, 7, 2)
    return m.fit(found), m.language_scores(docs).collect()


def plain_score(m, model, text, train, followers):
    """Bit by bit and word by word, from the tables of the model."""
    states, words = m.States(), words_of(text)
    data, prices = spelling(words), []
    logs = [0.0] * m.OPINIONS
    for at, byte in enumerate(data):
        last = (b"\n" * m.WINDOW + data[:at])[-m.WINDOW :]
        run = np.array([int.from_bytes(last + bytes([byte]), "big")], np.uint64)
        hashed, letters = m.contexts(run)
        tail = last.replace(b"\n", b" ").rpartition(b" ")[2]
        assert letters[0] == len(tail)
        weights, chances = None, []
        for bit in range(7, -1, -1):
            value = byte >> bit & 1
            seen = [int(t[m.slots(h, np.array([byte], np.uint8), bit, len(t))[0]]) for h, t in zip(hashed, model.tables)]
            if train:
                seen = [int(states.without[value, s]) for s in seen]
            if weights is None:
                known = [states.known[s] for s in seen]
                weights = model.weights[0][4 * known[4] + known[2]] + model.weights[1][4 * min(len(tail), 4) + known[5]]
            z = sum(w * float(model.odds[k][s]) for k, (w, s) in enumerate(zip(weights, seen)))
            z = max(-24, min(24, z)) / 2 * (1 if value else -1)
            spot = math.floor(max(1 - m.BUCKETS / 2, min(m.BUCKETS / 2 - 1, z * (m.BUCKETS - 1) / 16)))
            node = 256 >> bit | byte >> bit
            soft = [1 / (1 + math.exp(-z * x)) for x in m.SHARP]
            chances.append([0.5 * (soft[0] + float(model.refined[node * m.BUCKETS + m.BUCKETS // 2 + spot])), *soft])
        each = [math.prod(c) for c in zip(*chances)]
        top = max(logs)
        share = [f * math.exp(x - top) for f, x in zip(m.FIRST, logs)]
        share = [w + m.SHARE * sum(share) for w in share]
        prices.append(math.log10(sum(w * p for w, p in zip(share, each)) / sum(share)))
        logs = [x + math.log(p) for x, p in zip(logs, each)]

    total, at, tries, hits, expected = 0.0, 0, 0, 0, 0.0
    own = Counter()
    if train:
        for i, w in enumerate(words):
            own[(*([None, None] + words)[i : i + 2], w)] += 1
    for i, w in enumerate(words):
        size = len(w) + (w != b"\n")
        price, at = sum(prices[at : at + size]), at + size
        pair = tuple(([None, None] + words)[i : i + 2])
        seen = sorted(followers.get(pair, Counter()).items(), key=lambda x: (-x[1], int(m.word_hashes([x[0]])[0]) & m.FOLLOWERS))
        every = sum(n for _, n in seen) - sum(n for (*p, _), n in own.items() if tuple(p) == pair)
        best = [(n - own[(*pair, f)], -k, f) for k, (f, n) in enumerate(seen[:2])]
        if best and max(best)[0] > 0:
            n, _, f = max(best)
            odds = float(model.followers[m.cell(np.array([n]), np.array([every]))[0]])
            shown, due = (hits + 0.8) / (tries + 4), (expected + 0.8) / (tries + 4)
            tries, hits, expected = tries + 1, hits + (f == w), expected + 1 / (1 + math.exp(-odds))
            odds = max(-10, min(10, odds + math.log(shown / (1 - min(shown, 0.9999))) - math.log(due / (1 - min(due, 0.9999)))))
            p = 1 / (1 + math.exp(-odds))
            price = math.log10(p) if f == w else math.log10(1 - p) + price
        total += price
    return total


def test_scores_equal_a_plain_reading(corpus, parts):
    from roadloom.llm import context_mixing as m

    model, rows = parts
    followers = {}
    for i, t in corpus:
        if not m.in_fold(i, 7, 2):
            w = words_of(t)
            for k, x in enumerate(w):
                followers.setdefault(tuple(([None, None] + w)[k : k + 2]), Counter())[x] += 1
    want = Counter()
    for i, t in corpus:
        want[(i, round(plain_score(m, model, t, not m.in_fold(i, 7, 2), followers), 2))] += 1
    got = Counter((r["doc_id"], r["score"]) for r in rows)
    for (i, score), n in got.items():
        assert any(j == i and abs(score - x) <= 0.02 + 1e-4 * abs(x) for j, x in want), (i, score, [x for j, x in want if j == i])


def test_tables_hold_the_counts_of_the_training_texts(corpus, parts):
    from roadloom.llm import context_mixing as m

    model, states = parts[0], m.States()
    counts, at = [{} for _ in m.PREDICTORS], {}
    for i, t in corpus:
        if m.in_fold(i, 7, 2):
            continue
        data = spelling(words_of(t))
        for j, byte in enumerate(data):
            last = (b"\n" * m.WINDOW + data[:j])[-m.WINDOW :]
            tail = len(last.replace(b"\n", b" ").rpartition(b" ")[2])
            for k, what in enumerate(m.PREDICTORS):
                size = what if isinstance(what, int) else tail if what == "word" else min(tail + 3, m.WINDOW)
                for bit in range(8):
                    key = (last[m.WINDOW - size :], bit, byte >> (bit + 1))
                    counts[k].setdefault(key, [0, 0])[byte >> bit & 1] += 1
                    at.setdefault((k, key), (last, byte))
    right = every = 0
    for (k, key), (last, byte) in at.items():
        run = np.array([int.from_bytes(last + bytes([byte]), "big")], np.uint64)
        slot = m.slots(m.contexts(run)[0][k], np.array([byte], np.uint8), key[1], len(model.tables[k]))[0]
        zeros, ones = counts[k][key]
        right += int(model.tables[k][slot]) == int(states.of(np.array([zeros]), np.array([ones]))[0])
        every += 1
    assert right >= 0.97 * every  # the rest share a slot


def test_probabilities_of_a_byte_sum_to_one(parts):
    from roadloom.llm import context_mixing as m

    model = parts[0]
    mixer = m.Mixer(model.tables, model.odds, model.weights)
    for last in (b"\n\n\n\n\n", b" kato", b"zq\xc3\xa4 "):
        run = np.array([int.from_bytes(last + bytes([b]), "big") for b in range(256)], np.uint64)
        chances = np.exp(mixer.opinions(run, False, model.refined).astype(np.float64)).sum(0)
        assert chances == pytest.approx(np.ones(m.OPINIONS), abs=2e-2)
        assert chances[1:] == pytest.approx(np.ones(m.OPINIONS - 1), abs=1e-4)


def test_held_out_texts_are_foretold_and_copies_stand_apart(spark):
    from roadloom.llm.context_mixing import in_fold, language_scores

    rng = random.Random(2)
    syllables = {"x": ["ka", "to", "mi", "re", "su", "no"], "y": ["bra", "kle", "stu", "gro", "fli"]}
    rows = []
    for i in range(900):
        own = rng.choice("xy")
        rows.append((i, " ".join("".join(rng.choice(syllables[own]) for _ in range(rng.randint(1, 4))) for _ in range(60))))
    rows += [(1000 + i, rows[i][1]) for i in range(40)]
    got = {r["doc_id"]: r for r in language_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    pairs = [i for i in range(40) if not in_fold(i, 7, 2) and not in_fold(1000 + i, 7, 2)]
    copied = [got[i]["score"] / got[i]["n_tokens"] for i in pairs]
    alone = [got[i]["score"] / got[i]["n_tokens"] for i in range(100, 900) if not in_fold(i, 7, 2)]
    assert max(alone) < min(copied)


def test_columns_that_clash_and_very_long_texts(spark):
    from roadloom.llm.context_mixing import language_scores

    rows = [(1, "word " * 300_000, 1, "k"), (2, "x" * 400_000, 2, "k"), (3, "", 3, "k"), (4, None, 4, "k")]
    got = {r["doc_id"]: r for r in language_scores(spark.createDataFrame(rows, "doc_id long, text string, chunk long, kind string")).collect()}
    assert [got[i]["n_tokens"] for i in (1, 2, 3, 4)] == [300_001, 2, 1, 1]
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got.values())
