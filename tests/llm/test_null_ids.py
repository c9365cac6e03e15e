"""Rows without an id, and columns that are null throughout, go through every operator."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import licenses, mixing, neardup, passages, pieces, pii, quality, urls, vectors
from tests.llm.test_ops import DOCS


def test_null_ids(spark):
    text = "some words that are the same in each of these rows " * 8 + "\nReleased under the MIT License."
    rows = [(None, text, None, None, None), (None, text, None, None, None), (1, text, None, None, None), (2, text, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    near = neardup.near_duplicates(docs, 3, 85).collect()
    # the copies without an id belong to the class of those with one, but aren't its kept document
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in near) == [(0, False), (0, False), (0, False), (1, True), (2, False)]
    assert {(r["doc_id"], r["other_id"]) for r in passages.passages(docs).collect()} == {(2, 1)}
    assert sorted(r["doc_id"] or 0 for r in licenses.license_scan(docs).where("confirmed").collect()) == [0, 0, 1, 2]
    assert quality.quality(docs).count() == 5 and pii.personal_data(docs).count() == 5 and pieces.encode(docs, hot_units=10).count() == 5
    rows, parts = mixing.mix(docs, ["doc_id"])
    taken = mixing.taken_words(rows, parts).collect()
    assert len(taken) == 5 and sum(r["taken"] for r in taken) == round(1.5 * sum(r["size"] for r in taken))
    assert urls.url_filter(spark.createDataFrame([(None, "http://a.net/x"), (None, None)], "page_id long, url string")).count() == 2
    v = [float(x) for x in np.arange(1, 5)]
    out = vectors.near_vectors(spark.createDataFrame([(None, v, 1), (1, v, 1), (2, v, 1), (3, v, None)], "vec_id long, embedding array<float>, label int"))
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in out.collect()) == [(0, 0), (1, 1), (2, 1), (3, 0)]
    nulls = docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    assert neardup.stage(spark, nulls, "").count() == 0 and quality.stage(spark, nulls, "").count() == 0
    assert pii.stage(spark, nulls, "").count() == 5 and mixing.stage(spark, nulls, "").count() == 5
