"""Every name that an operator uses inside, or adds, as a column of its input: nothing crashes, and what a stage keeps keeps its values."""

import collections

import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses, mixing, neardup, passages, pieces, pii, quality, urls, vectors, warc
from tests.llm.test_ops import DOCS, words

NAMES = (
    "_k _kk _d _n _each _q _w _id _r _bad _given _o _b _g _s _t _i _heavy _often _again _first ids n_pieces round_trip decoded pii_email pii_ip pii_card pii_phone pii_iban pii_nir pii_dni pii_ssn "
    "pii_secret row k id h n l b a keep src src_name size source_size target goal bucket buckets rn start stop words epoch slot taken copies same each host path segs leaf rule verdict "
    "template_rejected key payload shard first again rep component label sketch h1 h2 band doc other place there seed extra chains s e x y few_words repeats symbols lines kept n_words base_failed "
    "host_ok dim vec keys block i j others embedding_ a.b `q` Ids PII_Email"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    import random

    rng = random.Random(2)
    text = words(rng, 80)
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate([text, text, text + " more", words(rng, 60) + " mail a@b.cd token 04dbebab91ab85687d33eeaaf9ac699e1188f962", None, "", words(rng, 70)])]
    wide = spark.createDataFrame(rows, DOCS)
    seen = {c.lower() for c in wide.columns}
    names = [n for n in NAMES if n.lower() not in seen and not seen.add(n.lower())]
    return wide.select("*", *[F.lit(f"own {n}").alias(n) for n in names]), names


def values(df, names):
    return {tuple(r) for r in df.select(*[F.col("`" + n.replace("`", "``") + "`") for n in names]).collect()}


def test_stages_keep_columns_of_any_name(spark, docs):
    df, names = docs
    own = [tuple(f"own {n}" for n in names)]
    for stage in (quality.stage, neardup.stage, pii.stage, mixing.stage):
        out = stage(spark, df, "")
        assert collections.Counter(out.columns) == collections.Counter(df.columns), stage.__module__
        assert values(out, names) <= set(own) and out.count() > 0
    added = {"ids", "n_pieces", "round_trip"}
    out = pieces.stage(spark, df, "")
    rest = [n for n in names if n.lower() not in added]
    assert values(out, rest) == {tuple(f"own {n}" for n in rest)} and out.count() == df.count()
    assert out.where("doc_id = 4").first()["ids"] is None and out.where("doc_id = 0").first()["n_pieces"] > 80
    assert pieces.decode(out).where("doc_id = 1").first()["decoded"] == df.where("doc_id = 1").first()["text"]


def test_operators_read_past_columns_of_any_name(spark, docs):
    df, names = docs
    assert quality.quality(df).count() == pii.personal_data(df).count() == df.count()
    assert {(r["doc_id"], r["other_id"]) for r in passages.passages(df).collect()} >= {(1, 0), (2, 0)}
    assert licenses.license_scan(df).count() == 0
    extra = [F.lit(f"own {n}").alias(n) for n in names if n.lower() not in ("label", "id")]
    pages = spark.createDataFrame([(1, "http://a.net/x", "p"), (2, "http://b.org/y", "p")], "page_id long, url string, html string").select("*", *[c for c in extra])
    assert urls.url_filter(pages).count() == 2 and warc.plan(pages, "page_id", "url", "html", 0)[0].count() == 2
    vecs = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)], "vec_id long, embedding array<double>, label int").select("*", *extra)
    assert [r["n_links"] for r in vectors.near_vectors(vecs).collect()] == [1, 1]
