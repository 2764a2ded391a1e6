"""Work that is done once for equal pieces: words are numbered, and runs judged, on whole arrays."""

import random

import numpy as np


def test_words_are_numbered_as_a_plain_reading_does():
    from roadloom.llm.context_mixing import END, numbered

    rng = random.Random(1)
    letters = [b"a", b"b", b"\0", b" ", "é".encode(), b"c"]
    for _ in range(300):
        texts = [b"".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 200]))) for _ in range(rng.randint(1, 5))]
        texts.append(b"x" * rng.randint(1, 300) + b" " + b"x" * rng.randint(1, 300))
        words, lengths, places = numbered(texts)
        assert len(set(words)) == len(words)
        read, at = [], 0
        for n in lengths.tolist():
            read.append([words[k] for k in places[at : at + n]])
            at += n
        assert at == len(places) and read == [[w for w in t.split(b" ") if w] + [END] for t in texts]


def test_a_worker_judges_a_run_once(monkeypatch):
    from roadloom.llm import context_mixing as m

    rng = np.random.default_rng(1)
    tables = [rng.integers(0, m.STATES, 1 << 16).astype(np.uint8) for _ in m.PREDICTORS]
    odds = rng.normal(size=(len(tables), m.STATES)).astype(np.float32)
    weights = [rng.normal(size=(g, len(tables))) / 4 for g in m.GATES]
    model = m.Model(tables, odds, weights, rng.random(512 * m.BUCKETS).astype(np.float32), None, 1, 1)
    run = rng.integers(0, 1 << 16, 20_000).astype(np.uint64) + np.uint64(0x6B61746F0000)
    run |= rng.integers(0, 2, len(run)).astype(np.uint64) << np.uint64(48)
    plain = m.Mixer(tables, odds, weights)
    want = np.empty((len(run), m.OPINIONS), np.float32)
    for at, r in enumerate(run.tolist()):
        if at % 200 == 0:  # one by one, away from the runs that share its context
            want[at] = plain.opinions(np.array([r & (1 << 48) - 1], np.uint64), r >> 48 == 1, model.refined)
    judged, opinions = [], m.Mixer.opinions
    monkeypatch.setattr(m.Mixer, "opinions", lambda self, run, *a: judged.append(len(run)) or opinions(self, run, *a))
    kept = m.Kept(model)
    first = kept.opinions(run)
    assert np.array_equal(first[::200], want[::200])
    assert sum(judged) == len(np.unique(run))
    assert np.array_equal(kept.opinions(run), first)
    assert sum(judged) < 1.1 * len(np.unique(run))  # but for the runs that meet in a place


def test_pieces_of_a_token_store_are_numbered_as_a_plain_reading_does():
    import re

    from roadloom.llm.tokens import MARKS, numbered_pieces

    rng = random.Random(2)
    letters = [b"a", b"z", b"\0", b" ", b"\n", b".", b"'", "é".encode(), b"A", b"9"]
    cut = re.compile(b"(?<=[a-z])(?=[" + re.escape(MARKS) + b"])")
    for _ in range(300):
        texts = [b"".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(rng.randint(1, 6))]
        texts.append(b"z" * rng.randint(1, 200) + b"." * rng.randint(0, 100))
        pieces, lengths, places = numbered_pieces(texts)
        assert len(set(pieces)) == len(pieces) and len(places) == lengths.sum()
        at = 0
        for t, n in zip(texts, lengths.tolist()):
            assert [pieces[k] for k in places[at : at + n]] == cut.sub(b" ", t).split()
            at += n
