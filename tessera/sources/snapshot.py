"""Snapshots of a memory: versions of Parquet tables, each made whole by its manifest, and a text form for exchange."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.engine import OPEN_END
from tessera.operators.memory import Escalations, Memory, in_order
from tessera.plans.compiler import relation_schema
from tessera.plans.program import ANY, INT
from tessera.plans.rules import RuleError
from tessera.sources.storage import exists, names_in, remove

MAGIC = "TESSERA1"
_ESCAPES = [("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), (" ", "\\s")]


def escape(text: str) -> str:
    for raw, shown in _ESCAPES:
        text = text.replace(raw, shown)
    return text


def unescape(text: str) -> str:
    out, it = [], iter(text)
    for c in it:
        if c != "\\":
            out.append(c)
            continue
        n = next(it, None)
        out.append({"t": "\t", "n": "\n", "s": " ", "\\": "\\", None: "\\"}.get(n, f"\\{n}"))
    return "".join(out)


def escaped(col: Column) -> Column:
    for raw, shown in _ESCAPES:
        col = F.replace(col, F.lit(raw), F.lit(shown))
    return col


MANIFEST = "manifest"
KEPT_VERSIONS = 2


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the whole versions below a path, oldest first: those whose manifest is written."""
    return [v for v in names_in(spark, path) if v.startswith("v") and exists(spark, f"{path}/{v}/{MANIFEST}/_SUCCESS")]


def save(memory: Memory, path: str, batch: int | None = None) -> str:
    """Writes episodes, edges, escalations and other base facts as a new version below ``path``, its manifest last: without it a version
    doesn't count, so a save that is cut off leaves the one before. The memory goes on with the new files, and versions older than the
    one before are removed. ``batch``: the last batch of a stream that it holds. Returns the version's path."""
    spark, engine = memory.spark, memory.engine
    engine.flush()
    names = [v for v in names_in(spark, path) if v.startswith("v")]
    at = f"{path}/v{int(names[-1][1:11]) + 1 if names else 1:010d}-{uuid.uuid4().hex[:8]}"
    memory.episodes.write.parquet(f"{at}/episodes")
    memory.open.unionByName(memory.closed).write.parquet(f"{at}/edges")
    in_order(memory.escalated.table(), "part", "i").write.parquet(f"{at}/escalations")
    kept = {}
    for pred, base in sorted(engine.base.items()):
        if pred != "edge" and base.parts:
            engine._union(base.parts, base.types).write.parquet(f"{at}/facts/{pred}")
            kept[pred] = base.types
    manifest = {
        "magic": MAGIC, "now": engine.now, "rules": memory.rules, "batches": [[b.id, b.source] for b in engine.batches], "counter": engine.counter,
        "escalations": len(memory.escalated), "n": memory.n, "facts": kept, "batch": batch,
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{at}/{MANIFEST}")
    _rebase(memory, at, manifest)
    for old in [v for v in names if v not in versions(spark, path)[-KEPT_VERSIONS:]]:
        remove(spark, f"{path}/{old}")
    return at


def _rebase(memory: Memory, at: str, manifest: dict) -> None:
    """Lets a memory read from a version's files."""
    spark, engine = memory.spark, memory.engine
    memory.episodes = spark.read.schema(memory.episodes.schema).parquet(f"{at}/episodes")
    edges = spark.read.schema(memory.open.schema).parquet(f"{at}/edges")
    memory.open, memory.closed = edges.where(F.col("vt") == OPEN_END), edges.where(F.col("vt") != OPEN_END)
    memory.turns = {}
    waiting = spark.read.schema("i long, text string").parquet(f"{at}/escalations")
    memory.escalated = Escalations(spark, [(waiting, manifest["escalations"])] if manifest["escalations"] else [])
    for pred, types in manifest["facts"].items():
        known = engine.base.get(pred)
        if known is not None and not known.pending:
            known.parts, known.removals = [spark.read.schema(relation_schema(types, engine.semiring)).parquet(f"{at}/facts/{pred}")], 0
    known = engine.base.get("edge")
    if known is not None and not known.pending and not known.shrunk:
        args = [F.col(c).alias(f"p{i}") for i, c in enumerate(("subj", "pred", "obj", "vf", "vt", "at"))]
        known.parts, known.removals = [edges.select(*args, F.col("conf").alias("_conf"), F.col("prov").alias("_prov"))], 0


def load(spark: SparkSession, path: str, **options) -> Memory:
    """A memory from the last whole version of a snapshot; derived relations are derived anew."""
    return restore(Memory(spark, **options), path)[0]


def restore(memory: Memory, path: str) -> tuple[Memory, int | None]:
    """Fills a new memory from the last whole version: (memory, last batch that it holds)."""
    spark, engine = memory.spark, memory.engine
    whole = versions(spark, path)
    if not whole:
        raise RuleError(f"{path} isn't a snapshot")
    at = f"{path}/{whole[-1]}"
    manifest = json.loads("".join(r["value"] for r in spark.read.text(f"{at}/{MANIFEST}").collect()))
    if manifest.get("magic") != MAGIC:
        raise RuleError(f"{path} isn't a snapshot")
    memory.rules, engine.batches = manifest["rules"], []
    for batch_id, source in manifest["batches"]:
        engine.counter = int(batch_id[1:]) - 1
        engine.install(source)
    engine.counter, memory.n = manifest["counter"], manifest["n"]
    for pred, types in manifest["facts"].items():
        engine._add(pred, spark.read.schema(relation_schema(types, engine.semiring)).parquet(f"{at}/facts/{pred}"), types)
    _rebase(memory, at, manifest)
    memory._publish()
    engine.set_now(manifest["now"])
    memory.maintain()
    return memory, manifest["batch"]


def fact_lines(memory: Memory) -> DataFrame:
    """(value): a line ``FACT pred conf prov args`` for each base fact, tab-separated and escaped."""
    parts = []
    memory.engine.flush()
    derived = {c.head.pred for c in memory.engine.clauses()}
    for pred, base in sorted(memory.engine.base.items()):
        if pred in derived:
            continue
        df = memory.engine._union(base.parts, base.types)
        shown = []
        for i, k in enumerate(base.types):
            c = F.col(f"p{i}")
            number = lambda x: F.concat(F.lit("i:"), x.cast("string"))
            symbol = lambda x: F.concat(F.lit("s:"), escaped(x))
            shown.append(number(c) if k == INT else F.coalesce(number(c["i"]), symbol(c["s"])) if k == ANY else symbol(c))
        prov = F.array_join(F.transform("_prov", lambda p: F.replace(escaped(p), F.lit(","), F.lit("\\c"))), ",")
        parts.append(df.select(F.concat_ws("\t", F.lit("FACT"), F.lit(pred), F.col("_conf").cast("string"), prov, F.array_join(F.array(*shown), " ")).alias("value")))
    return memory.engine._union(parts, [])


def export_text(memory: Memory) -> str:
    """The text form of a small memory: magic, clock, rule batches, episodes, escalations and facts, one a line."""
    lines = [MAGIC, f"NOW\t{memory.engine.now}", *[f"RULEB\t{escape(b.id)}\t{escape(b.source)}" for b in memory.engine.batches]]
    lines += [f"EP\t{escape(r['id'])}\t{r['ts']}\t{escape(r['speaker'] or '')}\t{escape(r['text'])}" for r in memory.episodes.orderBy("n").toLocalIterator()]
    lines += [f"ESC\t{escape(e)}" for e in memory.escalated]
    return "\n".join([*lines, *[r["value"] for r in fact_lines(memory).orderBy("value").toLocalIterator()]]) + "\n"


def import_text(spark: SparkSession, text: str, magics: tuple[str, ...] = (MAGIC,), **options) -> Memory:
    """A memory from the text form; other first lines than our own may be allowed by ``magics``."""
    lines = text.split("\n")
    if lines[0] not in magics:
        raise RuleError(f"not a snapshot: {lines[0][:40]!r}")
    memory = Memory(spark, **options)
    memory.engine.batches, episodes, edges, now, waiting = [], [], [], 0, []
    for line in lines[1:]:
        kind, *rest = line.split("\t")
        if kind == "NOW":
            now = int(rest[0])
        elif kind == "RULEB":
            memory.engine.counter = max(0, int(unescape(rest[0])[1:]) - 1)
            memory.engine.install(unescape(rest[1]))
        elif kind == "EP":
            episodes.append((unescape(rest[0]), len(episodes) + 1, unescape(rest[3]), int(rest[1]), unescape(rest[2]) or None))
        elif kind == "ESC":
            waiting.append(unescape(rest[0]))
        elif kind == "FACT":
            pred, conf, prov, shown = rest
            args = [int(a[2:]) if a[:2] == "i:" else unescape(a[2:]) for a in shown.split(" ")] if shown else []
            sources = [unescape(p.replace("\\c", ",")) for p in prov.split(",") if p]
            if pred == "edge":
                o = (args[2], None) if isinstance(args[2], int) else (None, args[2])
                edges.append((args[0], args[1], o, *args[3:], float(conf), sources, sources))
            else:
                memory.engine.declare(pred, *args, conf=float(conf), prov=sources)
    if not any("edge(" in b.source for b in memory.engine.batches):
        from tessera.operators.packs import TEMPORAL

        memory.engine.install(TEMPORAL)
    if episodes:
        memory.episodes, memory.n = spark.createDataFrame(episodes, memory.episodes.schema), len(episodes)
    if edges:
        every = spark.createDataFrame(edges, memory.open.schema)
        end = F.lit(9223372036854775807)
        memory.open, memory.closed = every.where(F.col("vt") == end), every.where(F.col("vt") != end)
    memory.escalated = Escalations.of(spark, waiting)
    memory._publish()
    memory.engine.set_now(now)
    memory.maintain()
    return memory
