"""The pipeline on a small corpus against a brute-force version of it."""

import collections
import os

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_ops import DOCS, brute_near, brute_pii, brute_quality, corpus, split, words


def test_pipeline(spark, tmp_path):
    import random

    import sentencepiece

    rng = random.Random(11)
    rows = [(i, t, "en", s or "none", n) for i, t, _, s, n in corpus()[: len(corpus()) - 3]]
    rows += [(1000 + i, words(rng, 70) + f" mail me{i}@example.org now", "en", f"s{i % 3}", 0) for i in range(30)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [r for r in rows if not brute_quality(r[1])[-1]]
    near = brute_near(kept, 5, 80)
    kept = [r for r in kept if near[r[0]][1] == r[0]]
    got = collections.Counter(r["doc_id"] for r in out)
    assert set(got) <= {r[0] for r in kept} and max(got.values()) <= 2
    lib = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.pieces.MODEL)
    for r in out:
        text = lib.decode(list(r["ids"]))
        assert r["round_trip"] and not brute_pii(text) and ("<EMAIL>" in text) == (r["doc_id"] >= 1000)
    size = {r[0]: len(split(r[1])) for r in kept}
    taken = sum(size[i] * n for i, n in got.items())
    total = sum(size.values())
    assert abs(taken - 1.5 * total) <= 5 * max(size.values())


def test_stages_have_the_documents_columns(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mixing", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert set(stage(spark, docs, "").columns) == set(docs.columns)
    assert "text" in docs.columns and os.path.exists(corpus_pipeline.__file__) and F is not None
