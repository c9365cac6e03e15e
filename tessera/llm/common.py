"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 8 << 20

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share: {master} has none")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        found = _own_dirs[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: this cuts lineage, and a lost executor costs nothing that is stored."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session to BATCH_BYTES: with long texts, batches of the default size in the JVM and in each
    Python worker would take a large part of a small executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body`` as a variable, so that lambdas don't evaluate it again for each element."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """The words of a text, in order; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that differ from all columns and from each other, in more than case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its very name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def own(df: DataFrame, *but: str) -> list[Column]:
    """The columns of a table, those aside that differ from ``but`` in case only."""
    return [quoted(c) for c in df.columns if c.lower() not in {x.lower() for x in but}]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys with many rows that a join broadcasts at most: a key counts as such with one part in so many of all rows.
HEAVY_KEYS, HEAVY_ROWS = 50_000, 16


def heavy_keys(rows: DataFrame, key: str, total: int) -> tuple[DataFrame, int]:
    """The keys that hold a large part of ``total`` rows, and their number, at most HEAVY_KEYS."""
    least = max(HEAVY_ROWS, total // HEAVY_KEYS)
    often = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_often")).where(F.col("_often") >= least).select(key), "heavy")
    return often, often.count()


def join_unique(rows: DataFrame, unique: DataFrame, key: str, total: int, heavy: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Inner join of stored ``rows`` (``total`` of them) with a table that has one row for each key.

    Rows of a frequent key would meet in one task. Such keys, at most HEAVY_KEYS by their count, are broadcast with their row of
    ``unique``; all other rows are joined by shuffle. ``heavy``: what ``heavy_keys`` gives for the rows, if it is known."""
    often, n = heavy or heavy_keys(rows, key, total)
    if not n:
        return rows.join(unique, key)
    values = [c for c in unique.columns if c != key]
    known = unique.join(F.broadcast(often), key, "left_semi").select(key, F.struct(*values).alias("_heavy"))
    marked = rows.join(F.broadcast(known), key, "left")
    near = marked.where("_heavy is not null").select(*rows.columns, *[F.col(f"_heavy.{c}").alias(c) for c in values])
    return near.unionByName(marked.where("_heavy is null").drop("_heavy").join(unique, key))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges(a, b)``: returns (node, component).

    Minimum labels spread along the links, and each round also replaces a label by the label of the node it
    names (pointer jumping), so rounds grow with the logarithm of the longest chain. Each round is stored. The
    links of a node with many, and the nodes of a large component, are spread over tasks.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).where("x <> y")
    both = stored(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "cc-edges")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("label")), "cc-labels")
    links, nodes = both.count(), labels.count()
    heavy = heavy_keys(both, "y", links)
    while True:
        at = labels.select(F.col("node").alias("y"), F.col("label").alias("there"))
        near = join_unique(both, at, "y", links, heavy).groupBy(F.col("x").alias("node")).agg(F.min("there").alias("near"))
        low = stored(labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("hop")), "cc-low")
        up = labels.select(F.col("node").alias("hop"), F.col("label").alias("root"))
        step = stored(join_unique(low, up, "hop", nodes).select("node", "was", F.least("hop", "root").alias("label")), "cc-step")
        changed = step.where("label <> was").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
