"""Ids above 2^53 next to a null id come out as they went in, row for row."""

from collections import Counter

import pytest

BIG = [2**53 + 1, 2**53 + 3, -(2**53) - 1, 2**63 - 1, None, 7]


@pytest.fixture(scope="module")
def big_docs(spark):
    rows = [(i, f"words of document {i} " + "and more of it " * k, "en", "ab"[k % 2]) for k, i in enumerate(BIG)] * 13
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)


@pytest.fixture(scope="module")
def word_json():
    from roadloom.llm.queries import tokenizer

    return tokenizer("word_bpe_49k.json")


def ids(df, column="doc_id"):
    return Counter(r[column] for r in df.select(column).collect())


WANT = Counter({i: 13 for i in BIG})


def test_mixture(big_docs):
    from roadloom.llm.mixture import mixed_counts, mixed_documents

    for options in ({"share": 1.3}, {"share": 1.5}, {"share": 0.4, "rows_a_bucket": 1}):
        got = mixed_counts(big_docs, **options)
        assert ids(got) == WANT
        taken = {r["doc_id"]: r["taken"] // r["size"] for r in got.collect()}
        assert ids(mixed_documents(big_docs, **options)) == Counter({i: 13 * taken[i] for i in BIG if taken[i]})


def test_token_counts(big_docs, word_json):
    from roadloom.llm.queries import tokenizer
    from roadloom.llm.token_count import token_counts

    assert ids(token_counts(big_docs, tokenizer("byte_bpe_50k.json"))) == WANT


def test_token_store(big_docs, word_json):
    from roadloom.llm.token_store import stored_tokens

    rows = stored_tokens(big_docs, word_json).orderBy("start").collect()
    assert Counter(r["doc_id"] for r in rows) == WANT
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_packing(big_docs, word_json):
    from roadloom.llm.packing import pack_documents

    assert ids(pack_documents(big_docs, word_json)) == WANT


def test_language_scores(big_docs):
    from roadloom.llm.context_mixing import in_fold, language_scores

    got = language_scores(big_docs)
    assert ids(got) == WANT
    assert all(r["held_out"] == in_fold(r["doc_id"], 7, 2) for r in got.collect())


def test_archive(spark):
    from roadloom.llm.warc import archived

    rows = [(i, "u", f"<p>{k % 2}</p>") for k, i in enumerate(BIG)]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in archived(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    even, odd = 2**53 + 1, 2**63 - 1
    assert got == {even: ("response", None), -(2**53) - 1: ("revisit", even), None: ("revisit", even), odd: ("response", None), 2**53 + 3: ("revisit", odd), 7: ("revisit", odd)}


def test_near_duplicates(big_docs):
    from roadloom.llm.minhash import near_duplicates

    got = near_duplicates(big_docs)
    assert ids(got) == WANT
    assert all(r["component_id"] == r["doc_id"] for r in got.collect())


def test_near_vectors_and_shards_and_quality(spark, big_docs):
    from roadloom.llm.near_vectors import near_vectors
    from roadloom.llm.quality import quality_verdicts
    from roadloom.llm.ring import shard_documents

    vectors = spark.createDataFrame([(i, [float(k == j) for j in range(6)]) for k, i in enumerate(BIG)], "vec_id long, embedding array<float>").coalesce(1)
    assert ids(near_vectors(vectors), "vec_id") == Counter(BIG)
    assert ids(shard_documents(big_docs, shards=3)) == WANT
    labels = spark.createDataFrame([(2**53 + 1, 1, 0)], "doc_id long, quality int, toxic int")
    assert ids(quality_verdicts(big_docs, labels)) == WANT
