def test_pipeline(spark, tmp_path, texts):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == current.columns
            out.write.parquet(f"{tmp_path}/{k}")
            out = spark.read.parquet(f"{tmp_path}/{k}")
        current = out
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length").collect()), key=str) == sorted(map(tuple, current.select("doc_id", "piece", "length").collect()), key=str)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_near_dedup_against_brute_force(spark, texts):
    """Repeated rows, null ids and columns with the names of the operators' own: one of each group stays, the rest untouched."""
    import corpus_pipeline
    from test_text_operators import exact_components, low_words

    rows = [(i, t, lang, s, len(t or ""), 1, "k") for i, t, lang, s in [*texts, (None, texts[7][1], "en", "a"), (None, texts[-2][1], "en", "a")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id long, member string").repartition(4)
    out = corpus_pipeline.minhash_near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    numbered = [(n, t) for n, (_, t, *_) in enumerate(rows)]
    groups = {}
    for n, (_, part) in exact_components(numbered, 5).items():
        groups.setdefault(part, []).append(rows[n][0])
    want = sorted((min(ids, key=lambda i: (i is None, i or 0)) for ids in groups.values()), key=str)
    got = out.collect()
    assert sorted((r["doc_id"] for r in got), key=str) == want
    assert {tuple(r) for r in got} <= set(rows)
    assert all(any(r["text"] == t for r in got) for _, t in numbered if not low_words(t))


def test_stages_against_plain_ones(spark, tmp_path, texts):
    """Every stage's decisions from its operator's table, by the rows that stay."""
    from collections import Counter

    import corpus_pipeline
    from roadloom.llm.mixture import mixed_counts
    from roadloom.llm.quality import quality_verdicts

    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in texts], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    kept = Counter(r["doc_id"] for r in quality_verdicts(docs, labels).where("kept").collect())
    assert Counter(r["doc_id"] for r in good.collect()) == kept
    for i, t, *_ in texts:  # the base rule by hand
        if len((t or "").split()) < 20:
            assert i is None or i not in kept
    taken = Counter()
    for r in mixed_counts(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    words = Counter()
    for r in corpus_pipeline.source_mixture(spark, docs, str(tmp_path)).collect():
        words[r["doc_id"]] += len((r["text"] or "").encode().split())
    assert words == Counter({i: n for i, n in taken.items() if n}) or +words == +taken
