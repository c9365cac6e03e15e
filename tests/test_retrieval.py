import math
import random

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.vectors import cosine, embed_text, fnv1a, hash_embedder
from tessera.operators import retrieval
from tessera.operators.engine import Engine
from tessera.operators.graphs import components


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(col).first()[0]


def test_tokens(spark):
    assert one(spark, tx.tokens(F.col("s")), s="The Airlines flew to class, a bus; I moved X2 it's Éclairs") == ["airline", "fly", "class", "bus", "move", "x2", "it", "éclair"]
    assert one(spark, tx.stems(F.col("s")), s="owns own owned gas") == ["ga", "own", "owned"]
    assert one(spark, tx.strip_thinking(F.col("s")), s="<think>a\nb</think> yes <think>open") == "yes"
    assert one(spark, tx.chunks(F.col("s"), 10), s="aaaa\nbbbb\ncccccccccccc\nd") == ["aaaa\nbbbb", "cccccccccccc", "d"]


def test_topic_overlap(spark):
    line, q = "Melanie --likes--> painting hikes", "What did Melanie paint on the hike"
    assert one(spark, tx.topic_overlap(tx.stems(F.col("a")), F.lit("Melanie"), tx.stems(F.col("b"))), a=line, b=q) == 2


def test_scores(spark):
    cases = [("the cat sat", "a cat sat down", 0.8), ("", "the", 1.0), ("x", "", 0.0), ("x x y", "x y y", 2 / 3)]
    df = spark.createDataFrame(cases, "p string, g string, f double")
    for r in df.select("f", tx.token_f1(F.col("p"), F.col("g")).alias("got")).collect():
        assert abs(r["f"] - r["got"]) < 1e-9
    assert one(spark, tx.exact_match(F.col("a"), F.col("b")), a="The cat!", b="cat")


def test_dates(spark):
    days = spark.createDataFrame([(20240301,), (20240000,), (19700101,), (20230500,)], "d long").select(tx.days_of(F.col("d"))).collect()
    assert [r[0] for r in days] == [19783, 19723, 0, 19478]


def test_vectors(spark):
    assert fnv1a(b"a") == 0xAF63DC4C8601EC8C
    v = embed_text("Alpha beta alpha", 16)
    assert abs(math.sqrt(sum(x * x for x in v)) - 1) < 1e-6 and embed_text("", 4) == [0.0] * 4
    df = spark.createDataFrame([("Alpha beta alpha",), (None,)], "t string").select(hash_embedder(16)("t").alias("v")).collect()
    assert [round(x, 6) for x in df[0]["v"]] == [round(x, 6) for x in v] and df[1]["v"] == [0.0] * 16
    c = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0, 9.0]), ([0.0], [1.0]), ([], [])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 6) for r in c] == [0.707107, 0.0, 0.0]


def test_bm25_against_formula(spark):
    rng = random.Random(3)
    vocab = ["car", "battery", "tea", "river", "stone", "cloud", "lamp"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(12)))) for i in range(30)]
    got = {r["id"]: r["score"] for r in retrieval.bm25(spark.createDataFrame(docs, "id long, text string"), "car battery car lamps").collect()}
    lists = {i: t.split() for i, t in docs}
    avg = sum(map(len, lists.values())) / len(lists)
    for i, ws in lists.items():
        want = 0.0
        for q in ("car", "battery", "lamp"):
            df, f = sum(q in x for x in lists.values()), ws.count(q)
            want += math.log((30 - df + 0.5) / (df + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ws) / avg)) if f else 0
        assert abs(got[i] - want) < 1e-9
    assert retrieval.bm25(spark.createDataFrame([], "id long, text string"), "car").count() == 0


def test_entities_aliases_and_budget(spark):
    e = Engine(spark, "lineage")
    e.declare("current", "ann", "drives", "honda_civic", prov=["ep1"])
    e.declare("current", "car", "needs", "oil", prov=["ep2"])
    e.declare("current", "bob", "drives", "van", prov=["ep3"])
    e.declare("edge", "x", "y", "car")
    facts = retrieval.fact_documents(e)
    assert {r["text"] for r in facts.collect()} == {"current(ann, drives, honda_civic)", "current(car, needs, oil)", "current(bob, drives, van)"}
    plain = {r["text"]: r["score"] for r in retrieval.rank_facts(facts, "the car").collect()}
    assert list(plain) == ["current(car, needs, oil)"] and abs(plain["current(car, needs, oil)"] - (1 + 1.5 + 0.4)) < 1e-9
    alias = spark.createDataFrame([("car", "honda_civic")], "a string, b string")
    bridged = {r["text"]: r["score"] for r in retrieval.rank_facts(facts, "the car", alias).collect()}
    assert abs(bridged["current(ann, drives, honda_civic)"] - 0.4) < 1e-9 and "current(bob, drives, van)" not in bridged
    eps = spark.createDataFrame([(f"ep{i}", f"text of episode {i} about the car") for i in range(1, 12)], "id string, text string")
    sel = retrieval.select(e, eps, "the car", 60)
    assert sel["episodes"][0][0] == "ep2" and sel["used_tokens"] <= 60 and retrieval.render(sel).startswith("== memory (facts) ==")
    vectors = facts.select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    assert retrieval.rank_facts(facts, "zzz", vectors=vectors, query_vector=[1.0, 0.0]).count() == 3


def test_top_k_and_components(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in retrieval.top_k(v, [1.0, 0.0], 3).collect()] == [19, 18, 17]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
