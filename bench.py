"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Besides catalogue queries over the tables it times the published micro-benchmarks' shapes: the closure of a 500-node chain in
full, one appended edge, an idle run, and a ground point lookup; and the closure with triangles of a random graph."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera import catalogue  # noqa: E402
from tessera.operators.engine import Engine  # noqa: E402
from tessera.operators.memory import Memory  # noqa: E402

NAMES = (
    "temporal_current", "closure_nonlinear", "closure_cyclic", "ask_deep_magic", "join_triangle", "neg_over_derived", "agg_multi_joint",
    "conf_best_path", "prov_union", "policy_supersede", "alias_same_as", "bm25_topk", "cosine_topk", "protocol_parse", "latest_value_per_slot",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tessera-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, f) -> None:
        began = time.perf_counter()
        f()
        took[name] = round(time.perf_counter() - began, 3)

    found = catalogue.queries()
    found["temporal_current"](spark, sf).count()  # the first query also starts the JVM's compilers
    for name in NAMES:
        timed(name, lambda n=name: found[n](spark, sf).write.format("noop").mode("overwrite").save())
    chain = Engine(spark)
    chain.register("e", spark.range(499).select(F.concat(F.lit("n"), "id"), F.concat(F.lit("n"), F.col("id") + 1)))
    chain.install("r(X, Y) :- e(X, Y). trans: r(X, Z) :- r(X, Y), r(Y, Z).")
    counts: dict[str, int] = {}
    timed("chain500_full", lambda: counts.update(chain500=chain.run()["total"]))  # 124,750
    chain.declare("e", "n499", "n500")
    timed("chain500_one_edge", chain.run)
    timed("chain500_idle", chain.run)
    timed("chain500_point", lambda: chain.contains("r", "n3", "n450"))
    # a graph of 2,000 nodes and 8,000 arcs: its closure of some 3.9 million facts, and its triangles
    arcs = spark.range(8000).select(F.concat(F.lit("n"), F.col("id") % 2000).alias("a"), F.concat(F.lit("n"), F.pmod(F.xxhash64("id"), F.lit(2000))).alias("b")).distinct()
    graph = Engine(spark)
    graph.register("arc", arcs)
    graph.install("reach(A, B) :- arc(A, B). step: reach(A, C) :- reach(A, B), arc(B, C). tri(A, B, C) :- arc(A, B), arc(B, C), arc(C, A).")
    timed("graph2000_closure_triangles", lambda: counts.update(graph2000=graph.run()["total"]))
    timed("graph2000_point", lambda: graph.contains("reach", "n5", "n17"))
    # turns of a memory: what one costs must not grow with those before it
    memory, turns = Memory(spark, clock=lambda: 0), []
    for i in range(16):
        began = time.perf_counter()
        memory.observe([(f"p{i % 5} --works_at--> firm{i}\np{i} --likes--> tea", i)])
        memory.maintain()
        turns.append(time.perf_counter() - began)
    took["memory_turn_early"], took["memory_turn_late"] = round(sorted(turns[2:8])[3], 3), round(sorted(turns[10:])[3], 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "counts": counts, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
