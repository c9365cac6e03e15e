"""Stores that outlive their process: versions of snapshots, streams that come again, and what turns do to plans."""

import pytest
from pyspark.sql import functions as F

from tessera.cli import run
from tessera.operators.engine import Engine
from tessera.operators.memory import Memory
from tessera.sources import snapshot
from tessera.sources.storage import names_in
from tessera.streaming.epochs import change_feed, episode_stream, fact_stream
from tests.test_memory import current


def memory(spark, **kw):
    return Memory(spark, clock=lambda: 1000, **kw)


def test_saves_to_one_path_in_a_loop(spark, tmp_path):
    path = f"{tmp_path}/s"
    m = memory(spark, rules="busy(E, count(R)) :- current(E, R, _).")
    want = set()
    for i in range(4):
        m.observe([(f"p{i} --likes--> tea\np{i} --likes--> jam\nann --works_at--> o{i}", 10 * i)])
        m.maintain()
        snapshot.save(m, path)
        want = {x for x in want if x[1] != "works_at"} | {(f"p{i}", "likes", "tea"), (f"p{i}", "likes", "jam"), ("ann", "works_at", f"o{i}")}
        assert current(m) == want  # the memory goes on from the files it wrote
        m = snapshot.load(spark, path, clock=lambda: 1000)
        assert current(m) == want and len(m.escalated) == i + 1 and m.n == i + 1
    assert len(names_in(spark, path)) == snapshot.KEPT_VERSIONS
    # a save that was cut off before its manifest doesn't count
    m.episodes.write.parquet(f"{path}/v9999999999-cut/episodes")
    m.episodes.write.parquet(f"{path}/v9999999999-cut/manifest/part")
    assert current(snapshot.load(spark, path)) == want
    assert list(snapshot.load(spark, path).escalated)[0].startswith("p0 ")


def files(spark, tmp_path, n):
    rows = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    for i in range(n):
        rows.where(F.col("a") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return rows.schema


def feed_rows(spark, path):
    rows = spark.read.schema("kind string, pred string, args string, epoch long").option("recursiveFileLookup", True).parquet(path)
    return sorted(map(tuple, rows.select("epoch", "kind", "pred", "args").collect()))


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    schema = files(spark, tmp_path, 3)
    rules = "r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z)."

    def start(engine, trigger=True):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        fact_stream(engine, stream, "e", f"{tmp_path}/cp", f"{tmp_path}/feed").trigger(availableNow=True).start().awaitTermination()

    e = Engine(spark)
    e.install(rules)
    start(e)
    first = feed_rows(spark, f"{tmp_path}/feed")
    assert len([x for x in first if x[2] == "r"]) == 6
    # the last batch is handed out again to an engine of a new process
    import os
    import shutil

    last = max(int(x) for x in os.listdir(f"{tmp_path}/cp/commits") if x.isdigit())
    for x in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{tmp_path}/cp/commits/{x}"):
            os.remove(f"{tmp_path}/cp/commits/{x}")
    again = Engine(spark)
    again.install(rules)
    start(again)
    assert feed_rows(spark, f"{tmp_path}/feed") == first and again.facts("r").count() == 6
    assert change_feed(f"{tmp_path}/feed", spark).isStreaming
    shutil.rmtree(f"{tmp_path}/feed")


def test_memory_of_a_stream_survives(spark, tmp_path):
    for i, text in enumerate(["ann --works_at--> a", "ann --works_at--> b\nann --likes--> tea", "ann --likes--> jam"]):
        spark.createDataFrame([(text, i)], "text string, ts long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        m = memory(spark)
        stream = spark.readStream.schema("text string, ts long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        episode_stream(m, stream, f"{tmp_path}/cp", save_every=2).trigger(availableNow=True).start().awaitTermination()
    assert current(m) == {("ann", "works_at", "b"), ("ann", "likes", "tea"), ("ann", "likes", "jam")} and len(m.escalated) == 1


def test_known_facts_are_no_news(spark):
    e = Engine(spark)
    e.install("p(X) :- q(X).")
    e.declare("q", "a")
    e.run()
    at = e.epoch
    e.declare("q", "a")
    e.declare("q", "b")
    assert e.run()["total"] == 1
    assert sorted((r["kind"], r["pred"], r["args"]) for r in e.changes_from(at).collect()) == [("Added", "p", '["b"]'), ("Added", "q", '["b"]')]


def test_plans_and_feed_stay_small(spark, monkeypatch):
    import tessera.operators.engine as engine
    import tessera.operators.memory as mem

    for module, name in ((engine, "MOST_PARTS"), (engine, "MOST_CHANGES"), (mem, "STORED_EVERY")):
        monkeypatch.setattr(module, name, 2)
    m = memory(spark)
    for i in range(5):
        m.observe([(f"p{i % 2} --works_at--> o{i}\np{i} --likes--> tea", i)])
        m.maintain()
    assert current(m) == {("p0", "works_at", "o4"), ("p1", "works_at", "o3")} | {(f"p{i}", "likes", "tea") for i in range(5)}
    assert len(m.engine.base["edge"].parts) <= 4 and len(m.engine.feed) <= 3
    news = m.engine.changes_from(0).where("kind = 'Added' and pred = 'edge'").count()
    assert news == 5 + 5 + 3  # openings, likes, and the three that closed


def test_command_line(spark, tmp_path):
    out = []
    call = lambda *args, text="": (run(spark, ["--store", f"{tmp_path}/m", *args], lambda: text, out.append), out[-1])
    assert call("observe", "--ts", "5", text="ann --works_at--> acme\nann --likes--> tea")[0] == 0
    assert call("query", text="current(ann, works_at, X)") == (0, "X=acme")
    assert call("install_rules", "--rules=w(X) :- current(X, works_at, _).")[0] == 0 and call("query", "--goal", "w(X)") == (0, "X=ann")
    assert call("query", "--goal", "w(X")[0] == 1 and call("fly")[0] == 2 and "usage" in out[-1]
    with pytest.raises(Exception):
        snapshot.load(spark, f"{tmp_path}/none")
