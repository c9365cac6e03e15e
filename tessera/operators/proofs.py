"""Supports of derived facts, and proof trees that are built level by level.

A support of a fact is a clause's body as ground facts. The supports of many facts are found by one join for each clause: the facts stand
as one more atom in front of the body. A proof takes the facts that it needs level by level, with a few supports each, and asks for
more only of facts for which those don't lead back to base facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.engine import Engine
from tessera.plans.compiler import SPARK_TYPES, merged, solve
from tessera.plans.program import ANY
from tessera.plans.rules import Agg, Atom, Clause, Const, Pos, Var, Wild
from tessera.plans.semiring import Facts

#: Supports of a fact that are kept for each rule, and those that a proof asks for at first.
SUPPORTS = 4
_ASKED = "_asked"


def _open(clause: Clause) -> Clause:
    """The clause with the facts asked for as its first atom, and variables for wildcards, so that supports name whole facts."""
    names = iter(f"_w{i}" for i in range(1 << 16))
    fill = lambda a: Atom(a.pred, tuple(Var(next(names)) if isinstance(x, Wild) else x for x in a.args))
    body = tuple(Pos(fill(x.atom)) if isinstance(x, Pos) else x for x in clause.body)
    return Clause(clause.head, (Pos(Atom(_ASKED, tuple(Wild() if isinstance(a, Agg) else a for a in clause.head.args))), *body), clause.name)


def _found(engine: Engine, clause: Clause, asked: DataFrame, most: int | None) -> DataFrame:
    """(fact array of the asked facts' arguments, body array of (pred, arguments)) of a clause, at most ``most`` for each fact."""
    types = engine.types()
    kinds = types[clause.head.pred]
    plain = lambda df: df.select(*[c for c in df.columns if c[0] == "p"])
    whole = _open(clause)
    groups = [i for i, a in enumerate(clause.head.args) if not isinstance(a, Agg)]
    atoms = whole.positives()[1:]
    keep = {v for a in whole.positives() for v in a.variables()}
    # an aggregate's result isn't part of the body: its group is asked for
    front = asked.select(*[F.col(f"p{i}") if i in groups else F.lit(None).cast(SPARK_TYPES[k]).alias(f"p{i}") for i, k in enumerate(kinds)], *([] if kinds else ["_one"])).distinct()
    source = lambda k, p: front if p == _ASKED else plain(engine.relation(p))
    body = solve(engine.spark, whole, source, types | {_ASKED: kinds}, Facts(), engine.now, keep, 0)

    def shown(term) -> Column:
        value, kind = body.operand(term)
        return F.coalesce(value["i"].cast("string"), F.concat(F.lit("'"), value["s"])) if kind == ANY else value.cast("string") if kind == "int" else F.concat(F.lit("'"), value)

    args = lambda a: F.array(*[shown(t) for t in a.args]) if a.args else F.expr("cast(array() as array<string>)")
    head = F.array(*[shown(clause.head.args[i]) for i in groups]) if groups else F.expr("cast(array() as array<string>)")
    facts = F.array(*[F.struct(F.lit(a.pred).alias("pred"), args(a).alias("args")) for a in atoms]) if atoms else F.expr("cast(array() as array<struct<pred:string,args:array<string>>>)")
    out = body.df.select(head.alias("fact"), facts.alias("body")).distinct()
    if most is not None:
        out = out.withColumn("k", F.row_number().over(Window.partitionBy("fact").orderBy("body"))).where(F.col("k") <= most).drop("k")
    return out


def _value(text: str) -> str | int:
    """Symbols carry a quote in front, integers don't."""
    return text[1:] if text[:1] == "'" else int(text)


def supports(engine: Engine, pred: str, most: int = SUPPORTS) -> DataFrame:
    """(fact, label, body): for each derived fact of a predicate up to ``most`` supports a rule, as texts."""
    keys = [f"p{i}" for i in range(len(engine.types()[pred]))]
    asked = merged(engine.relation(pred).select(*keys), len(keys), Facts()) if keys else engine.relation(pred).limit(1)
    out = engine.spark.createDataFrame([], "fact string, label string, body array<string>")
    text = lambda args: F.array_join(F.transform(args, lambda a: F.regexp_replace(a, "^'", "")), ", ")
    for c in engine.rules():
        if c.head.pred == pred:
            found = _found(engine, c, asked, most)
            fact = F.concat(F.lit(f"{pred}("), text(F.col("fact")), F.lit(")"))
            body = F.transform("body", lambda b: F.concat(b["pred"], F.lit("("), text(b["args"]), F.lit(")")))
            out = out.unionByName(found.select(fact.alias("fact"), F.lit(c.label).alias("label"), body.alias("body")))
    return out


def fact(engine: Engine, pred: str, *args: str | int) -> dict | None:
    """A stored fact: its annotation, whether it is a base fact, and its supports (label, body) up to SUPPORTS a rule; None if unknown."""
    row = engine.query(pred, *args).first() if pred in engine.types() else None
    if row is None:
        return None
    graph = _Graph(engine)
    graph.ask({(pred, tuple(args))}, SUPPORTS)
    marks = {c: row[c] for c in engine.semiring.columns}
    return {"annotation": marks, "base": (pred, tuple(args)) in graph.base, "supports": [(label, body) for label, bodies in graph.bodies[pred, tuple(args)] for body in bodies]}


class _Graph:
    """What is known of the facts of a proof: annotations, base facts, and supports by rule."""

    def __init__(self, engine: Engine) -> None:
        self.engine, self.marks, self.base, self.bodies, self.whole = engine, {}, set(), {}, {}

    def _table(self, pred: str, rows: list[tuple]) -> DataFrame:
        kinds = self.engine.types()[pred]
        one = lambda a, k: a if k != ANY else (a, None) if isinstance(a, int) else (None, a)
        if not kinds:
            return self.engine.spark.range(1).select(F.lit(1).alias("_one"))
        schema = ", ".join(f"p{i} {SPARK_TYPES[k]}" for i, k in enumerate(kinds))
        fits = [r for r in rows if all(k == ANY or isinstance(a, int) == (k == "int") for a, k in zip(r, kinds, strict=True))]
        return self.engine.spark.createDataFrame([tuple(one(a, k) for a, k in zip(r, kinds, strict=True)) for r in fits], schema)

    def ask(self, facts: set[tuple], most: int | None) -> None:
        """Fills in facts: two jobs for each predicate, and one for each of its rules."""
        engine = self.engine
        by: dict[str, list[tuple]] = {}
        for p, a in sorted(facts, key=repr):
            self.bodies[p, a], self.whole[p, a] = [], most
            self.marks.setdefault((p, a), None)
            if p in engine.types() and len(engine.types()[p]) == len(a):
                by.setdefault(p, []).append(a)
        plain = lambda v: (v["i"] if v["i"] is not None else v["s"]) if hasattr(v, "asDict") else v
        for p, rows in by.items():
            keys = [f"p{i}" for i in range(len(engine.types()[p]))]
            asked = F.broadcast(self._table(p, rows))  # the facts of one level
            join = lambda df: df.join(asked, keys) if keys else df.limit(1)  # noqa: E731, B023
            for r in merged(join(engine.relation(p)), len(keys), engine.semiring).collect():
                self.marks[p, tuple(plain(r[k]) for k in keys)] = {c: r[c] for c in engine.semiring.columns}
            base = engine.base_relation(p)
            if base is not None:
                self.base |= {(p, tuple(plain(r[k]) for k in keys)) for r in join(base).select(*(keys or [F.lit(1)])).distinct().collect()}
            for c in engine.rules():
                if c.head.pred != p:
                    continue
                held: dict[tuple, list] = {}
                for r in _found(engine, c, asked, most).collect():
                    held.setdefault(tuple(map(_value, r["fact"])), []).append([(b["pred"], tuple(map(_value, b["args"]))) for b in r["body"]])
                groups = [i for i, a in enumerate(c.head.args) if not isinstance(a, Agg)]
                for a in rows:
                    fits = all(not isinstance(t, Const) or t.value == a[i] for i, t in enumerate(c.head.args))
                    found = held.get(tuple(a[i] for i in groups), []) if fits else []
                    if found:
                        self.bodies[p, a].append((c.label, sorted(found, key=repr)))

    def ranks(self) -> dict[tuple, int]:
        """How many steps lie between each fact and base facts, for those that have a founded proof among the supports known."""
        rank = {f: 0 for f in self.base}
        # a fact whose supports weren't asked for yet isn't founded, nor is a rule without atoms in need of any
        while True:
            new = {}
            for f, rules in self.bodies.items():
                best = min((max((rank[b] for b in body), default=0) + 1 for _, bodies in rules for body in bodies if all(b in rank for b in body)), default=None)
                if best is not None and best < rank.get(f, 1 << 60):
                    new[f] = best
            if not new:
                return rank
            rank |= new

    def prove(self, goal: tuple) -> dict[tuple, int]:
        todo, most = {goal}, SUPPORTS
        while True:
            while todo:
                self.ask(todo, most)
                todo = {b for f in todo for _, bodies in self.bodies[f] for body in bodies for b in body if b not in self.bodies}
            rank = self.ranks()
            open_ = {f for f in self.bodies if f not in rank and self.marks[f] is not None and self.whole[f] is not None}
            full = {f for f in open_ if any(len(bodies) >= self.whole[f] for _, bodies in self.bodies[f])}
            if goal in rank or not full:
                return rank
            # all supports of what isn't founded yet
            most = most * 8 if most < 1 << 12 else None
            todo = full


def why(engine: Engine, pred: str, *args: str | int) -> str:
    """An indented proof tree: one derivation for each rule, facts shown once, base facts as leaves."""
    engine.flush()
    graph = _Graph(engine)
    goal = (pred, tuple(args))
    rank = graph.prove(goal)
    lines: list[str] = []
    seen: set[tuple] = set()
    text = lambda f: f"{f[0]}({', '.join(map(str, f[1]))})"

    def show(f: tuple, depth: int) -> None:
        pad = "  " * depth
        marks = graph.marks.get(f)
        if marks is None:
            lines.append(f"{pad}{text(f)}  [unknown fact]")
            return
        if f in seen:
            lines.append(f"{pad}{text(f)}  [cycle: shown above]")
            return
        seen.add(f)
        lines.append(f"{pad}{text(f)}{engine.semiring.render(marks)}")
        if f in graph.base:
            lines.append(f"{pad}  ↳ asserted (base fact)")
        labels = set()
        for label, bodies in graph.bodies.get(f, []):
            if label in labels:
                continue
            labels.add(label)
            lines.append(f"{pad}  ↳ via {label}")
            # the support that is nearest to base facts, so one that doesn't come back to this fact
            for b in min(bodies, key=lambda body: (max((rank.get(b, 1 << 60) for b in body), default=0), repr(body))):
                show(b, depth + 2)

    show(goal, 0)
    return "\n".join(lines) + "\n"
