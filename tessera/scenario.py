"""A synthetic log of a small company with known answers, and what a memory makes of it.

The log is a DataFrame: each turn's kind and values are hashes of its number, so any part of it can be made anywhere. What should be
known in the end follows from the log by SQL functions, and is compared with what the memory answers.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.memory import Memory

RULES = """
chain(X, Y) :- current(X, "answers_to", Y).
up: chain(X, Z) :- chain(X, Y), current(Y, "answers_to", Z).
"""
#: Relation of each kind of turn: a job is replaced by a newer one, seats and skills add up, a favourite that changes is a contradiction.
RELATIONS = {"job": "works_at", "seat": "answers_to", "skill": "mentions", "favourite": "drinks"}


@dataclass
class Scenario:
    """``mix``: how many of so many turns are of each kind; the rest is talk without facts."""

    turns: int = 1000
    seed: int = 7
    people: int = 24
    firms: int = 9
    mix: dict[str, int] = field(default_factory=lambda: {"job": 3, "seat": 2, "skill": 2, "favourite": 1, "talk": 2})

    def _draw(self, what: str, below: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(what), "turn"), F.lit(below))

    def log(self, spark: SparkSession) -> DataFrame:
        """(turn, ts, kind, subj, obj, text)."""
        at, kind, low = self._draw("kind", sum(self.mix.values())), F.lit(None).cast("string"), 0
        for name, n in self.mix.items():
            kind, low = F.when(at >= low, F.lit(name)).otherwise(kind), low + n
        who = F.format_string("staff_%02d", self._draw("who", self.people))
        # a boss has a lower number, so seats make no circles
        rank = self._draw("who", self.people)
        boss = F.format_string("staff_%02d", F.pmod(F.xxhash64(F.lit(self.seed), F.lit("boss"), "turn"), F.greatest(rank, F.lit(1))))
        things = {"job": F.format_string("firm_%d", self._draw("firm", self.firms)), "seat": boss, "skill": F.format_string("skill_%d", self._draw("skill", 40)), "favourite": F.format_string("drink_%d", self._draw("drink", 5))}
        rows = spark.range(self.turns).withColumnRenamed("id", "turn").withColumn("kind", kind)
        obj = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in things.items()])
        rows = rows.select("turn", (F.col("turn") * 60).alias("ts"), "kind", who.alias("subj"), obj.alias("obj"))
        fact = F.concat("subj", F.lit(" --"), F.coalesce(*[F.when(F.col("kind") == k, F.lit(r)) for k, r in RELATIONS.items()]), F.lit("--> "), "obj")
        return rows.withColumn("text", F.coalesce(fact, F.concat(F.lit("small talk at the coffee machine, minute "), F.col("turn").cast("string"))))

    def truth(self, log: DataFrame) -> dict[str, DataFrame]:
        """What should hold after the log: jobs and their changes, seats, skills, and slots of favourites that are contradictory."""
        of = lambda kind: log.where(F.col("kind") == kind)
        jobs = of("job")
        before = jobs.alias("a").join(jobs.alias("b"), (F.col("a.subj") == F.col("b.subj")) & (F.col("a.turn") < F.col("b.turn")))
        last = before.groupBy("b.turn").agg(F.max_by("a.obj", "a.turn").alias("was"), F.first("b.obj").alias("now")).where("was <> now")
        drinks = of("favourite").groupBy("subj").agg(F.count_distinct("obj").alias("n"))
        return {
            "job": jobs.groupBy("subj").agg(F.max_by("obj", "turn").alias("obj")), "changes": last,
            "seat": of("seat").where("subj <> obj").select("subj", "obj").distinct(), "skill": of("skill").select("subj", "obj").distinct(),
            "doubt": drinks.where("n > 1").select("subj"), "sure": drinks.where("n = 1").select("subj"),
        }


def _above(pairs: set[tuple[str, str]], start: str) -> set[str]:
    """Everyone over a person, from the pairs of one scenario's people."""
    found, ahead = set(), {start}
    while ahead:
        ahead = {b for a, b in pairs if a in ahead} - found
        found |= ahead
    return found


def subjects_of(queue: Iterable[str], relation: str) -> set[str]:
    """Whose slots of a relation wait in a queue of contradictions."""
    return {t.split(" --", 1)[0] for t in queue if t.split(" --", 1)[1].startswith(f"{relation}--> ")}


def evaluate(spark: SparkSession, turns: int = 1000, seed: int = 7, batch: int = 250, goals: int = 3) -> dict[str, float]:
    """Shares of right answers by kind, and figures: current jobs and superseded ones, seats over several steps by goals of demand,
    abstention (a contradictory slot has all its values open and is queued, another one isn't), tokens, and seconds a turn."""
    world = Scenario(turns, seed)
    memory = Memory(spark, RULES, clock=lambda: 0)
    log = memory.engine.space.stored(world.log(spark))
    started = time.monotonic()
    for at in range(0, turns, batch):
        memory.observe(log.where((F.col("turn") >= at) & (F.col("turn") < at + batch)).select(F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), "text", "ts"))
    memory.maintain(60 * turns)
    seconds = (time.monotonic() - started) / turns
    truth, current = world.truth(log), memory.engine.space.stored(memory.current())
    pairs = lambda df: {tuple(r) for r in df.collect()}
    held = {k: pairs(current.where(F.col("pred") == r).select("subj", "obj")) for k, r in RELATIONS.items()}
    share = lambda got, want: 1.0 if not got and not want else len(got & want) / len(got | want)
    seats = pairs(truth["seat"])
    own = {(a, b) for a, b in held["seat"] if a != b}
    asked = sorted({a for a, _ in seats}, key=lambda a: (-len(_above(seats, a)), a))[:goals]
    hop_started, right = time.monotonic(), 0
    for who in asked:
        got = {r["Y"] for r in memory.engine.ask_deep(f'chain("{who}", Y)').collect()}
        right += got - {who} == _above(seats, who) - {who}
    hop_seconds = time.monotonic() - hop_started
    drinks: dict[str, set[str]] = {}
    for a, b in held["favourite"]:
        drinks.setdefault(a, set()).add(b)
    # a person's seats wait in the same queue, so it is read by slot
    queued = subjects_of(memory.escalated, RELATIONS["favourite"])
    doubt, sure = {r[0] for r in truth["doubt"].collect()}, {r[0] for r in truth["sure"].collect()}
    abstained = sum(len(drinks.get(a, ())) > 1 and a in queued for a in doubt) + sum(len(drinks.get(a, ())) == 1 and a not in queued for a in sure)
    context = memory.context([f"staff_{i:02d}" for i in range(5)], 400)
    transcript = log.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = {
        "jobs": share(held["job"], pairs(truth["job"])), "seats": share(own, seats), "skills": share(held["skill"], pairs(truth["skill"])),
        "multi_hop": right / max(len(asked), 1), "abstention": abstained / max(len(doubt | sure), 1),
    }
    return parts | {
        "accuracy": sum(parts.values()) / len(parts), "supersessions": float(memory.closed.where("pred = 'works_at'").count()), "expected_supersessions": float(truth["changes"].count()),
        "escalations": float(len(memory.escalated)), "context_tokens": len(context.encode()) / 4, "transcript_tokens": transcript / 4, "seconds_a_turn": seconds, "multi_hop_seconds": hop_seconds,
    }
