"""Facts from streams: each micro-batch is an epoch of the engine.

What a batch brought is stored under its id before it is applied. A query that starts anew, in the same process or another one, restores
what the batches before its first one held; a batch that comes again is read from its own table, derives the same facts, and writes the
same part of the feed in place of the one before. So facts and feed are as if every batch had come once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.engine import Engine
from tessera.operators.memory import Memory
from tessera.sources import snapshot
from tessera.sources.storage import exists, names_in

#: Batches of episodes after which memory is saved; a restart ingests at most so many again.
SAVE_EVERY = 20


def _kept(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """The rows of a batch from its own table, which is written once."""
    if not exists(spark, f"{path}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _stored_batches(spark: SparkSession, folder: str) -> list[int]:
    found = [int(n.removeprefix("batch=")) for n in names_in(spark, folder) if n.startswith("batch=")]
    return sorted(i for i in found if exists(spark, f"{folder}/batch={i}/_SUCCESS"))


def fact_stream(engine: Engine, stream: DataFrame, pred: str, checkpoint: str, feed: str | None = None, on_epoch: Callable[[int, dict], None] | None = None):
    """A writer that declares a stream's rows as facts of ``pred`` and runs the engine, batch by batch; start it with a trigger.

    The engine has the same rules and other facts at each start; facts of ``pred`` that it holds at the very first one are stored too."""
    spark, folder = engine.spark, f"{checkpoint}-facts"
    last: int | None = None

    def take(rows: DataFrame, batch_id: int) -> None:
        nonlocal last
        rows = rows.select(*stream.columns)
        kept = _kept(spark, f"{folder}/batch={batch_id}", rows)
        if last is None or last != batch_id - 1:  # the first batch of this query, or one that failed on the way
            first = f"{folder}/first"
            if not exists(spark, f"{first}/_SUCCESS"):
                known = engine.base.get(pred)
                had = engine._union(known.parts, known.types).toDF(*stream.columns[: len(known.types)], *engine.semiring.columns).select(*stream.columns) if known and known.parts else spark.createDataFrame([], rows.schema)
                had.write.mode("overwrite").parquet(first)
            before = [f"{folder}/batch={i}" for i in _stored_batches(spark, folder) if i < batch_id]
            engine.replace(pred, spark.read.schema(rows.schema).parquet(first, *before))
            engine.run()
        last = None
        engine.register(pred, kept)
        at = engine.epoch
        report = engine.run()
        if feed is not None:
            engine.changes_from(at).drop("epoch").withColumn("epoch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{feed}/batch={batch_id}")
        if on_epoch is not None:
            on_epoch(batch_id, report)
        last = batch_id

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def episode_stream(memory: Memory, stream: DataFrame, checkpoint: str, save_every: int = SAVE_EVERY):
    """A writer that ingests a stream of episodes (text, ts) under the update policy into a memory that is new at each start.

    Batches are stored with the time at which they were asserted, and memory is saved every few batches; a start restores the last
    save and ingests the batches since then at their own times."""
    spark, folder = memory.spark, f"{checkpoint}-episodes"
    last: int | None = None

    def ingest(batch: DataFrame) -> None:
        wall = batch.agg(F.max("_wall")).first()[0]
        if wall is None:
            return
        clock, memory.clock = memory.clock, lambda: wall
        try:
            memory.observe(batch.drop("_wall"))
        finally:
            memory.clock = clock
        memory.maintain()

    def take(rows: DataFrame, batch_id: int) -> None:
        nonlocal last
        _kept(spark, f"{folder}/batch={batch_id}", rows.select(*stream.columns).withColumn("_wall", F.lit(memory.clock()).cast("long")))
        if last is None:
            last = -1
            if snapshot.versions(spark, f"{folder}/saved"):
                last = snapshot.restore(memory, f"{folder}/saved")[1]
        for i in _stored_batches(spark, folder):
            if last < i <= batch_id:
                ingest(spark.read.parquet(f"{folder}/batch={i}"))
                last = i
        if batch_id % save_every == save_every - 1:
            snapshot.save(memory, f"{folder}/saved", batch_id)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def change_feed(engine_feed: str, spark) -> DataFrame:
    """The stored feed as a stream: (kind, pred, args, epoch, batch)."""
    return spark.readStream.schema("kind string, pred string, args string, epoch long").option("recursiveFileLookup", True).parquet(engine_feed)
