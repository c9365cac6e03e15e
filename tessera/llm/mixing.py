r"""Operator 4: mixing sources to target weights by a low-discrepancy schedule.

The documents of a source lie shuffled (by hash) on a line of words, once for each epoch; the line is cut into blocks of
equally many words. Slot t of the schedule maps the golden-ratio point frac(t / phi) through the sources' cumulative
weights to a source, slots are ranked per source, and the slot of rank k takes block k of its source. The last block of a
source is cut so that the source's taken words equal its rounded target.

Places on a line are sums over all documents before; they add up in two levels (buckets of the hash, then inside a
bucket), so a source of any size is spread over many tasks. Only the table of sources comes to the driver: it is the mix's
own configuration, one row for each source.

Defined cases: a null or empty text has the size 0, is never taken and is still returned; a null source is a source of its
own, last in order; repeated rows take places of their own; an empty table gives an empty result; reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import SPACE_RUN, fresh, own, quoted, stored, table

WEIGHTS = (3, 1, 2)
SHARE_PERCENT, MAX_EPOCHS = 150, 2
#: Slots of a whole mix at most, about: the length of a block follows from it.
SLOTS = 1 << 18
GOLDEN = 0.6180339887498949
#: Rows of a bucket, about, and buckets of a run.
BUCKET_ROWS, FAN = 2000, 2048


def n_words(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (F.size(F.split(t, SPACE_RUN)) - F.when(t.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) - F.when(t.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)).cast("long")


def words_exact(text: Column) -> Column:
    """``n_words`` with the two texts set right that a split counts wrongly: the empty one and the one of spaces only."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), n_words(text)).otherwise(F.lit(0).cast("long"))


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = MAX_EPOCHS) -> list[float]:
    """Target words of each source of ``sizes`` (in order): shares by weight, none above ``epochs`` times its size, the excess reshared."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    caps = [epochs * n for _, n in sizes]
    left, out, free = share_percent * sum(n for _, n in sizes) / 100, [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        unit = left / sum(w[i] for i in free)
        full = {i for i in free if w[i] * unit >= caps[i]}
        for i in full or free:
            out[i] = float(caps[i]) if full else w[i] * unit
        if not full:
            break
        left = max(0.0, left - sum(caps[i] for i in full))
        free -= full
    return out


def running_sum(rows: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group that come before, by (bucket, order).

    Three levels of windows: over a group's runs of FAN buckets, over the buckets of a run, over the rows of a bucket. A task holds at
    most FAN buckets, or a bucket's rows, or a group's runs, which are 1 / FAN of its buckets."""
    upto = lambda keys, by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0))
    sums = rows.groupBy(F.col(group).alias("_g"), F.col(bucket).alias("_b")).agg(F.sum(value).alias("_s")).withColumn("_t", F.floor(F.col("_b") / FAN))
    tops = sums.groupBy(F.col("_g").alias("_tg"), F.col("_t").alias("_tt")).agg(F.sum("_s").alias("_ts"))
    tops = tops.select("_tg", "_tt", before("_ts", upto(["_tg"], ["_tt"])).alias("_to"))
    offsets = sums.withColumn("_bo", before("_s", upto(["_g", "_t"], ["_b"]))).join(tops, F.col("_g").eqNullSafe(F.col("_tg")) & (F.col("_t") == F.col("_tt")))
    offsets = offsets.select("_g", "_b", (F.col("_to") + F.col("_bo")).alias("_o"))
    rows = rows.withColumn("_i", before(value, upto([group, bucket], order)))
    joined = rows.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col(bucket) == F.col("_b")))
    return joined.withColumn(out, F.col("_o") + F.col("_i")).drop("_g", "_b", "_o", "_i")


def schedule(spark: SparkSession, plan: list[dict], block: int) -> DataFrame:
    """(src, block, slot, words): slots by golden-ratio points, ranked per source. ``plan``: src, words (rounded target)."""
    need = {p["src"]: ceil(p["words"] / block) for p in plan}
    n = sum(need.values())
    bounds, at = [], 0
    for p in plan:
        at += need[p["src"]]
        bounds.append((p["src"], at / max(n, 1), need[p["src"]], p["words"]))
    sources = spark.createDataFrame(bounds or [(0, 1.0, 0, 0)], "src int, upto double, need long, words long")
    tops = F.array(*[F.lit(b[1]) for b in bounds[:-1]]) if len(bounds) > 1 else F.expr("cast(array() as array<double>)")
    point = (F.col("slot") * F.lit(GOLDEN)) % 1.0
    first = F.size(F.filter(tops, lambda x: x <= F.col("point")))
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("src", F.element_at(F.array(*[F.lit(b[0]) for b in bounds or [(0,)]]), first + 1))
    slots = slots.select("slot", "src", F.floor(F.col("slot") / 8192).alias("bucket"), F.lit(1).cast("long").alias("one"))
    ranked = running_sum(slots, "src", "bucket", ["slot"], "one", "rank").select("slot", "src", "rank")
    had = ranked.groupBy("src").agg(F.count(F.lit(1)).alias("had"))
    # a source's count of points differs from its share by a few: surplus slots go, missing ones follow at the end
    tail = sources.join(had, "src", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < need")
    tail = tail.select(F.explode(F.sequence("had", F.col("need") - 1)).alias("rank"), "src").select((F.col("rank") + n).alias("slot"), "src", "rank")
    taken = ranked.unionByName(tail).join(F.broadcast(sources), "src").where("rank < need")  # one row for each source
    return taken.select("src", F.col("rank").alias("block"), "slot", F.least(F.lit(block), F.col("words") - F.col("rank") * block).alias("words"))


def mix(docs: DataFrame, keep: Sequence[str | Column], text: str = "text", source: str = "source", weights=WEIGHTS, share_percent=SHARE_PERCENT, epochs=MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """Returns (rows, pieces). rows: ``keep`` (a struct of the columns named so, which also give a document its place), size,
    source_size, target and row (src, bucket, rn), one for each document; pieces: row, epoch, slot, from, words, one for each part
    of a document that a slot takes, in the order of slots."""
    spark = docs.sparkSession
    named = [quoted(c) if isinstance(c, str) else c for c in keep]
    base = docs.select(F.struct(*named).alias("keep"), quoted(source).alias("src_name"), words_exact(quoted(text)).alias("size"))
    # 60 bits of a digest that any engine gives alike
    place = F.conv(F.substring(F.md5(F.to_json("keep").cast("binary")), 1, 15), 16, 10).cast("long")
    base = stored(base.withColumn("h", place), "mix-sizes")
    found = base.groupBy("src_name").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).orderBy(F.col("src_name").asc_nulls_last()).collect()
    sizes = [(r["src_name"], r["words"]) for r in found]
    aims = targets(sizes, weights, share_percent, epochs)
    plan = [{"src": i, "name": r["src_name"], "size": r["words"], "n": r["n"], "target": a, "words": min(epochs * r["words"], round(a))} for i, (r, a) in enumerate(zip(found, aims, strict=True))]
    block = max(1, sum(p["words"] for p in plan) // SLOTS)
    info = spark.createDataFrame(
        [(p["src"], p["name"], p["size"], p["target"], p["words"], max(1, p["n"] // BUCKET_ROWS, isqrt(p["n"] // 64))) for p in plan],
        "src int, _name string, source_size long, target double, goal long, buckets long",
    )
    rows = base.join(F.broadcast(info), F.col("src_name").eqNullSafe(F.col("_name"))).drop("_name")
    rows = rows.withColumn("bucket", F.pmod("h", "buckets"))
    order = ["h", "keep", "size"]
    rows = running_sum(rows, "src", "bucket", order, "size", "start")
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("src", "bucket").orderBy(*order)))
    rows = stored(rows.select("keep", "src", "bucket", "rn", "size", "source_size", "target", "goal", "start"), "mix-rows")
    # document d's words in epoch e lie at start + e * source_size; those before the goal are taken
    spans = rows.where("size > 0").select("src", "bucket", "rn", "size", "goal", "source_size", "start", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    spans = spans.withColumn("a", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("goal"))).where("a < b")
    cut = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    slots = schedule(spark, [p for p in plan if p["words"] > 0], block).withColumnRenamed("words", "slot_words")
    pieces = cut.join(slots, ["src", "block"])
    low, high = F.greatest("a", F.col("block") * block), F.least(F.col("b"), F.col("block") * block + F.col("slot_words"))
    pieces = pieces.select("src", "bucket", "rn", "epoch", "slot", (low - F.col("a")).alias("from"), (high - low).alias("words")).where("words > 0")
    return rows, pieces


def taken_words(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    sums = pieces.groupBy("src", "bucket", "rn").agg(F.sum("words").alias("taken"))
    return rows.join(sums, ["src", "bucket", "rn"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pieces = mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return taken_words(rows, pieces).select("keep.doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them: an epoch's copy stays if at least half of its words are taken.

    A source's line is taken from its start, so at most one document of a source is cut, and rounding moves only that one.
    A document without words belongs to no block and stays once."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    taken = taken_words(*mix(docs, ["doc_id", key.alias("k")]))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5).cast("int"))
    # equal rows are told apart by nothing, so their copies are dealt to the rows of one key in turn
    d, k, each, n = fresh(docs.columns, "_d", "_k", "_each", "_n")
    by_key = taken.select(F.col("keep.doc_id").alias(d), F.col("keep.k").alias(k), copies.alias("copies")).groupBy(d, k).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("same"))
    by_key = by_key.where("copies > 0").select(d, k, F.ceil(F.col("copies") / F.col("same")).cast("int").alias(each))
    one = docs.join(by_key, F.col("doc_id").eqNullSafe(F.col(d)) & (key == F.col(k)))
    return one.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(each)))).select(*own(docs))


SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{"doc_id":' || doc_id || '}'), 1, 15) AS BIGINT) AS h FROM documents
), c AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, count(*) AS docs, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s GROUP BY source
), o AS (
  SELECT *, 150 * sum(n) OVER () / 100 AS total, coalesce(sum(2 * n) OVER (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM c
), f AS (SELECT *, 2 * n <= w * ((total - caps) / ws) AS full_ FROM o
), t AS (
  SELECT *, CASE WHEN full_ THEN CAST(2 * n AS DOUBLE) ELSE w * ((total - coalesce(sum(2 * n) FILTER (WHERE full_) OVER (), 0)) / sum(w) FILTER (WHERE NOT full_) OVER ()) END AS target FROM f
), g AS (
  SELECT *, CAST(least(2 * n, round_even(target, 0)) AS BIGINT) AS goal, greatest(1, docs // 2000, CAST(floor(sqrt(docs // 64)) AS BIGINT)) AS buckets FROM t
), l AS (
  SELECT s.doc_id, s.size, g.n, g.target, g.goal,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h % g.buckets, s.h, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS a
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, n AS source_size, target, CAST(greatest(0, least(a + size, goal) - a) + greatest(0, least(a + n + size, goal) - a - n) AS BIGINT) AS taken FROM l
"""
