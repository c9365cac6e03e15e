"""The update policy of memory in set form: what a sequence of observations does to the facts that are open.

Per subject and relation, in order of arrival: the first object is added; an object that is open already is merged; for an
exclusive relation a new object closes the open one and takes its place; other relations keep both, and those that aren't
multi-valued by name escalate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: prefixes of relations that hold many values, and of those that hold one
MULTI = ("evidence", "mentions", "located", "describes", "tag", "related_to", "depends_on", "owns", "calls", "part_of", "source", "cites", "symptom_of", "aka", "alias_of")
FUNCTIONAL = ("status", "phone", "address", "email", "version", "value_of", "current_value")
OPEN_END = 9223372036854775807


def starts_with_any(col: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, p: a | F.startswith(col, F.lit(p)), prefixes, F.lit(False))


def with_class(obs: DataFrame, exclusive: DataFrame | None = None) -> DataFrame:
    """Adds ``kind``: exclusive, multi or plain. ``exclusive``: (pred) of relations that hold one value though their name doesn't say so."""
    if exclusive is not None:
        named = exclusive.select(F.col(exclusive.columns[0]).alias("pred"), F.lit(True).alias("_x")).distinct()
        obs = obs.join(named, "pred", "left")
    else:
        obs = obs.withColumn("_x", F.lit(None).cast("boolean"))
    one = starts_with_any(F.col("pred"), FUNCTIONAL) | F.coalesce("_x", F.lit(False))
    kind = F.when(starts_with_any(F.col("pred"), MULTI), "multi").when(one, "exclusive").otherwise("plain")
    return obs.withColumn("kind", kind).drop("_x")


def decide(obs: DataFrame, exclusive: DataFrame | None = None) -> DataFrame:
    """Adds kind and ``action`` (ADD, NOOP, UPDATE or ESCALATE) to observations (seq, ts, subj, pred, obj, conf, prov), and
    ``island``: rows of one subject, relation and island hold one fact."""
    rows = with_class(obs, exclusive)
    slot = Window.partitionBy("subj", "pred").orderBy("seq")
    same = Window.partitionBy("subj", "pred", "obj").orderBy("seq")
    changed = F.when(F.lag("obj").over(slot).isNull() | (F.lag("obj").over(slot) != F.col("obj")), 1).otherwise(0)
    rows = rows.withColumns({"_new": changed, "_again": F.row_number().over(same), "_n": F.row_number().over(slot)})
    rows = rows.withColumn("island", F.when(F.col("kind") == "exclusive", F.sum("_new").over(slot)).otherwise(F.lit(0)))
    by_island = F.when(F.col("_new") == 0, "NOOP").when(F.col("_n") == 1, "ADD").otherwise("UPDATE")
    by_object = F.when(F.col("_again") > 1, "NOOP").when((F.col("_n") == 1) | (F.col("kind") == "multi"), "ADD").otherwise("ESCALATE")
    return rows.withColumn("action", F.when(F.col("kind") == "exclusive", by_island).otherwise(by_object)).drop("_new", "_again", "_n")


def edges(decided: DataFrame, asserted_at: Column | None = None) -> DataFrame:
    """(subj, pred, obj, vf, vt, at, conf, prov, was): one row for each fact, closed ones with the annotation of the superseded
    and their own sources in ``was``. ``asserted_at``: an aggregate over a fact's rows, by default its first time."""
    facts = decided.groupBy("subj", "pred", "obj", "island", "kind").agg(
        F.min_by("ts", "seq").alias("vf"),
        F.max("conf").alias("conf"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("prov")))).alias("prov"),
        (asserted_at if asserted_at is not None else F.min_by("ts", "seq")).alias("at"),
    )
    ahead = F.lead("vf").over(Window.partitionBy("subj", "pred").orderBy("island"))
    facts = facts.withColumn("vt", F.when(F.col("kind") == "exclusive", F.coalesce(ahead, F.lit(OPEN_END))).otherwise(F.lit(OPEN_END)))
    closed = F.col("vt") != OPEN_END
    return facts.select(
        "subj", "pred", "obj", "vf", "vt", "at",
        F.when(closed, F.lit(0.9)).otherwise(F.col("conf")).alias("conf"),
        F.when(closed, F.array(F.lit("superseded"))).otherwise(F.col("prov")).alias("prov"),
        F.col("prov").alias("was"),
    )


def escalations(decided: DataFrame) -> DataFrame:
    """(seq, subj, pred, obj, text) of the observations that contradict an open fact of a relation that isn't multi-valued."""
    shown = F.coalesce(F.col("obj")["i"].cast("string"), F.col("obj")["s"])
    text = F.concat("subj", F.lit(" --"), "pred", F.lit("--> "), shown, F.lit(": another value is open"))
    return decided.where("action = 'ESCALATE'").select("seq", "subj", "pred", shown.alias("obj"), text.alias("text"))
