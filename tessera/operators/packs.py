"""Rule packs and the helpers that feed them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.engine import Engine
from tessera.plans.program import INT, SYM

# fixed values: the rules of the default views, of canonical names, of relevance and of order in time
TEMPORAL = """
current(E, R, O) :- edge(E, R, O, VF, VT, _), now(T), VF =< T, T < VT.
believed(E, R, O, T) :- edge(E, R, O, VF, VT, AT), AT =< T, VF =< T, T < VT.
exclusive("works_at").
"""
CANONICAL = """
same_as(X, X) :- entity(X).
same_as(X, Y) :- alias(X, Y).
same_as(X, Y) :- alias(Y, X).
same_as(X, Z) :- same_as(X, Y), same_as(Y, Z).
aliased(X) :- alias(X, _).
maps_to(X, X) :- entity(X), !aliased(X).
maps_to(L, C) :- alias(L, C).
alias_conflict(L) :- alias(L, C1), alias(L, C2), C1 \\= C2.
alias_conflict(N) :- alias(N, _), alias(_, N).
"""
RELEVANCE = """
near(S, E, 1) :- mentions(S, E).
diffuse: near(S, E2, D) :- near(S, E1, Dm), Dm < 3, D = Dm + 1, current(E1, "links", E2).
"""
ORDERING = """
first_dated(A, min(D)) :- dated(A, D).
happened_before(A, B) :- first_dated(A, D1), first_dated(B, D2), A \\= B, D1 < D2.
stated_before(X, Y) :- current(X, "before", Y).
stated_before(X, Z) :- stated_before(X, Y), stated_before(Y, Z).
"""
#: Vectors of names are dealt to so many blocks, which are compared two by two.
VECTOR_BLOCKS = 32


def symbols_of(engine: Engine, preds: list[str]) -> DataFrame:
    """(name): every symbol in the given relations."""
    parts = []
    for pred in preds:
        df = engine.relation(pred)
        for i, kind in enumerate(engine.types()[pred]):
            if kind != INT:
                parts.append(df.select((F.col(f"p{i}") if (kind or SYM) == SYM else F.col(f"p{i}")["s"]).alias("name")))
    return reduce(DataFrame.union, parts).where("name is not null").distinct()


def seed_entities(engine: Engine, preds: list[str]) -> None:
    """Declares ``entity`` for every symbol in the given relations."""
    engine.register("entity", symbols_of(engine, preds))


def canonical_view(pred: str, arity: int) -> str:
    """A rule that shows a relation through ``maps_to``; the middle of three arguments, a relation's name, stays."""
    args = [f"X{i}" for i in range(arity)]
    shown = [f"C{i}" if not (arity == 3 and i == 1) else args[i] for i in range(arity)]
    body = [f"{pred}({', '.join(args)})"] + [f"maps_to({a}, {c})" for a, c in zip(args, shown, strict=True) if a != c]
    return f"canonical_{pred}({', '.join(shown)}) :- {', '.join(body)}."


def install_canonical(engine: Engine, preds: list[tuple[str, int]]) -> str:
    """Installs the pack and a view for each (relation, arity), with all their symbols as entities."""
    engine.register("alias", engine.spark.createDataFrame([], "l string, c string"))
    seed_entities(engine, [p for p, _ in preds])
    return engine.install(CANONICAL + "\n".join(canonical_view(p, n) for p, n in preds))


def assert_alias(engine: Engine, local: str, canonical: str, conf: float = 0.9) -> None:
    engine.declare("alias", local, canonical, conf=conf, prov=("reconcile",))
    engine.declare("entity", local)
    engine.declare("entity", canonical)


def reconcile(engine: Engine, candidates: DataFrame, confirm: Callable[[str, str, str], tuple[str, str, float] | None]) -> list[tuple[str, str, float]]:
    """Asks ``confirm`` about each pair of a report of candidates (a, b, why): (local, canonical, confidence) asserts an alias, None doesn't.
    A name that is an alias already, or that aliases lead to, doesn't become one. Returns what was asserted."""
    done: list[tuple[str, str, float]] = []
    known = {(r["p0"], r["p1"]) for r in engine.facts("alias").select("p0", "p1").collect()} if "alias" in engine.types() else set()
    for r in candidates.collect():  # a report of a bounded length
        found = confirm(r["a"], r["b"], r["why"])
        if found is None or found[0] == found[1] or not {found[0], found[1]} <= {r["a"], r["b"]}:
            continue
        if found[0] in {x for x, _ in known} | {y for _, y in known} or found[1] in {x for x, _ in known}:
            continue
        assert_alias(engine, *found)
        known.add(found[:2])
        done.append(found)
    return done


def seed_mentions(engine: Engine, session: str, hits: DataFrame) -> None:
    """Declares ``mentions(session, entity)`` from (entity, score) with the score as confidence."""
    rows = hits.select(F.lit(session).alias("s"), F.col(hits.columns[0]).alias("e"), F.col(hits.columns[1]).cast("double").alias("c"))
    engine.register("mentions", rows, args=["s", "e"], _conf=F.col("c"), _prov=F.array(F.lit("semantic")))


def alias_candidates(names: DataFrame, facts: DataFrame | None = None, vectors: DataFrame | None = None, least_cosine: float = 0.72, slot_size: int = 8, limit: int = 120) -> DataFrame:
    """(a, b, why): pairs of names that may be one entity: one is a run of the other's words, both are objects of a slot (subject and relation) with at most
    ``slot_size`` objects, or their vectors are close. A report of the best ``limit`` pairs for someone to confirm."""
    from tessera.functions.vectors import cosine

    n = names.select(F.col(names.columns[0]).alias("name")).distinct()
    # names are short: each has few runs of words, and a run that is a name is found by equality
    ws = F.split(F.lower("name"), "[ _]+")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(ws)), lambda n: F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))))
    held = n.select(F.col("name").alias("b"), F.explode(F.array_distinct(runs)).alias("run"))
    short = n.select(F.col("name").alias("a"), F.array_join(ws, " ").alias("run"))
    contained = short.join(held, "run").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit("contained").alias("why"))
    found = contained
    if facts is not None:  # (subj, pred, obj)
        s, p, o = facts.columns[:3]
        slots = facts.groupBy(s, p).agg(F.collect_set(o).alias("os"), F.count_distinct(o).alias("n")).where(F.col("n").between(2, slot_size))
        pairs = slots.select(F.explode("os").alias("a"), "os").select("a", F.explode("os").alias("b")).where("a < b")
        found = found.unionByName(pairs.withColumn("why", F.lit("slot")))
    if vectors is not None:  # (name, vector); every pair meets once, in the cell of both blocks
        v = vectors.select(F.col(vectors.columns[0]).alias("name"), F.col(vectors.columns[1]).alias("v")).withColumn("own", F.pmod(F.xxhash64("name"), F.lit(VECTOR_BLOCKS)))
        every = F.explode(F.sequence(F.lit(0), F.lit(VECTOR_BLOCKS - 1)).cast("array<bigint>"))
        left = v.select(F.col("name").alias("a"), F.col("v").alias("va"), F.col("own").alias("i"), every.alias("j"))
        right = v.select(F.col("name").alias("b"), F.col("v").alias("vb"), F.col("own").alias("j"), every.alias("i"))
        close = left.join(right, ["i", "j"]).where("a < b").where(cosine(F.col("va"), F.col("vb")) > least_cosine)
        found = found.unionByName(close.select("a", "b", F.lit("vectors").alias("why")))
    return found.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("why")).orderBy(F.desc(F.length("why")), "a", "b").limit(limit)
