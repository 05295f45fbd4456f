"""Each stage of the pipeline on a small table, with rows that must go and rows that must stay."""

import numpy as np

import corpus_pipeline
from quadlight.llm import decontamination


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 8))))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(40)
    rows, labels = [], []
    for i in range(200):
        text = prose(120)
        if i % 10 == 0:
            text = text.replace(" ", " vile ", 3)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(i % 10 == 0)))
    leak = prose(50) + " " + item + " " + prose(50)
    rows += [(300, "%%% " * 200, "en", "s", 800), (301, "too short", "en", "s", 9), (302, rows[1][1], "en", "s", 1), (303, leak, "en", "s", 1), (304, None, None, None, None), (1, rows[1][1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = sorted(r[0] for r in docs.select("doc_id").collect())
    plain = [i for i in range(200) if i % 10]
    assert left["quality rules"] == sorted([*range(200), 1, 302, 303])
    assert left["toxicity"] == sorted([*plain, 1, 302, 303])
    assert left["simhash near-dedup"] == sorted([*plain, 303])
    assert left["benchmark decontamination"] == plain
    assert set(left["best-fit packing"]) == set(plain)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r[0] for r in whole.select("doc_id").collect()) == left["best-fit packing"]


def test_leaks_are_searched_with_vectors_of_all_documents(spark, tmp_path, monkeypatch):
    """Frequencies and latent vectors are those of a dense matrix of every document: more than a sample of 2,000 holds,
    with repeated ids, null ids and null texts."""
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda words, n: " ".join(rng.choice(words, n))
    items = [prose(vocabulary[:300], 30) for _ in range(30)]
    texts = [prose(vocabulary[i % 7 * 40 : i % 7 * 40 + 160], 60) for i in range(2600)]
    rows = [(None if i % 100 == 0 else i // 2, text) for i, text in enumerate(texts)] + [(5000, None), (5001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    indexes, search = [], decontamination.search
    monkeypatch.setattr(decontamination, "search", lambda docs, index, *rest: indexes.append(index) or search(docs, index, *rest))
    stage = lambda: corpus_pipeline.no_leaks(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert stage().count() == len(rows)
    stage()
    index, again = indexes
    assert (index.latent == again.latent).all()

    counts = lambda of: np.array([np.bincount([index.numbers[w.encode()] for w in t.split() if w.encode() in index.numbers], minlength=len(index.numbers)) for t in of])
    corpus, own = counts(texts), counts(items)
    weights = decontamination.term_weights((corpus > 0).sum(axis=0), len(rows), index.texts)
    assert np.allclose(index.weights, weights)
    unit = lambda a: a * weights / np.maximum(np.linalg.norm(a * weights, axis=1, keepdims=True), 1e-12)
    corpus, own = unit(corpus), unit(own)
    basis = np.linalg.qr(np.random.default_rng(11).normal(size=(len(weights), 128)))[0]
    for _ in range(2):
        basis = np.linalg.qr(corpus.T @ (corpus @ basis) + own.T @ (own @ basis) * len(rows) / len(items))[0]
    got = index.latent / weights[:, None]
    assert np.abs(got @ got.T - basis @ basis.T).max() < 1e-3
