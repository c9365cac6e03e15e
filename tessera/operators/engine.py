"""The engine: base facts, installed rules, and derived relations kept up to date run by run.

Rules are evaluated component by component. Inside a recursive component each iteration joins the newest facts (delta)
with what is known so far and stores what is new, so lineage never grows; a run after changes fires only the components
whose inputs changed, incrementally where the inputs only grew and are read positively, else from their base.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans import magic
from tessera.plans.compiler import SPARK_TYPES, convert, derive, matches, merged, relation_schema
from tessera.plans.program import ANY, INT, SYM, arities, check_clause, components, infer_types, reads, type_of, wider
from tessera.plans.rules import Atom, Clause, Const, Now, Pos, RuleError, Var, parse_goal, parse_program
from tessera.plans.semiring import MODES, Interpret, Semiring
from tessera.sources.storage import Space

OPEN_END = 9223372036854775807
#: A closure's iteration doubles if that makes at most so many rows, and so many times the known facts.
DOUBLING_ROWS, DOUBLING_TIMES = 50_000_000, 16
#: Iterations in which an annotated closure only takes linear steps: sums of products of floating-point numbers then are a plain recursion's, bit by bit.
PLAIN_STEPS = 32
#: Tables that a relation is the union of, changes that the feed holds as plans, and new facts that are broadcast to look up known ones, at
#: most; beyond that tables are stored as one, and facts are joined by shuffle.
MOST_PARTS, MOST_CHANGES, BROADCAST_FACTS = 16, 128, 100_000


@dataclass
class Base:
    """Base facts of a predicate: DataFrames with columns p0.. and annotations, all of the kinds ``types``."""

    types: list[str | None]
    parts: list[DataFrame] = field(default_factory=list)
    pending: list[DataFrame] = field(default_factory=list)
    shrunk: bool = False
    #: joins that removals have put on the parts since they were stored
    removals: int = 0


@dataclass
class Change:
    """What a run did to a relation: ``added`` facts, and ``removed`` ones if it was rebuilt (else None)."""

    added: DataFrame
    removed: DataFrame | None = None


@dataclass
class Batch:
    id: str
    source: str
    clauses: list[Clause]


class Engine:
    """A store of facts and rules. ``mode``: facts, conf, lineage, or a Semiring of one's own."""

    def __init__(self, spark: SparkSession, mode: str | Semiring = "facts", now: int = 0, refresh_on_clock: bool = True) -> None:
        self.spark, self.now, self.refresh_on_clock = spark, now, refresh_on_clock
        self.semiring: Semiring = MODES[mode]() if isinstance(mode, str) else mode
        self.space = Space(spark)
        self.base: dict[str, Base] = {}
        self.rows: dict[str, list[tuple]] = {}
        self.derived: dict[str, DataFrame] = {}
        self.derived_types: dict[str, list[str | None]] = {}
        self.batches: list[Batch] = []
        self.counter = 0
        self.epoch = 0
        self.dirty: set[str] = set()
        self.clock_moved = False
        self.feed: list[tuple[int, str, str, DataFrame]] = []
        self.old_feed: DataFrame | None = None
        self.steps: dict[str, int] = {}
        self.last_demand_facts = 0
        self.last_iterations = 0
        self._types: dict[str, list[str | None]] | None = None

    # base facts

    def _kinds(self, df: DataFrame) -> list[str]:
        kinds = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StringType):
                kinds.append(SYM)
            elif isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
                kinds.append(INT)
            elif f.dataType == T.StructType([T.StructField("i", T.LongType()), T.StructField("s", T.StringType())]) or f.dataType.simpleString() == SPARK_TYPES[ANY]:
                kinds.append(ANY)
            else:
                raise RuleError(f"facts hold symbols and 64-bit integers: cast {f.name}, a {f.dataType.simpleString()}")
        return kinds

    def register(self, pred: str, df: DataFrame, **annotations) -> None:
        """Adds the rows of a DataFrame as facts, columns by position. Annotations are Columns over it, such as ``_conf=F.col("c")``;
        their columns must not be among the facts' own: name those with ``args``."""
        args = annotations.pop("args", None)
        facts = df.select(*args) if args else df
        kinds = self._kinds(facts)
        marks = self.semiring.one() | {k: v for k, v in annotations.items() if k in self.semiring.columns}
        cols = [F.col(f"`{c}`").cast(SPARK_TYPES[k]).alias(f"p{i}") for i, (c, k) in enumerate(zip(facts.columns, kinds, strict=True))]
        self._add(pred, df.select(*cols, *[v.cast(self.semiring.columns[n]).alias(n) for n, v in marks.items()]), kinds)

    def replace(self, pred: str, df: DataFrame, **annotations) -> None:
        """Puts the rows of a DataFrame in place of a predicate's base facts."""
        self.flush()
        if pred in self.base:
            self.base[pred].parts, self.base[pred].pending = [], []
        self.register(pred, df, **annotations)
        self.base[pred].pending, self.base[pred].shrunk = [], True

    def _add(self, pred: str, df: DataFrame, kinds: list[str | None]) -> None:
        known = self.base.get(pred)
        if known is None:
            self._arity(pred, len(kinds))
            self.base[pred] = known = Base(list(kinds))
        if len(known.types) != len(kinds):
            raise RuleError(f"{pred} has {len(known.types)} arguments, not {len(kinds)}")
        wide = [wider(a, b) for a, b in zip(known.types, kinds, strict=True)]
        if wide != known.types:
            known.parts = [self._typed(x, known.types, wide) for x in known.parts]
            known.pending = [self._typed(x, known.types, wide) for x in known.pending]
            known.types, self._types = wide, None
        elif self._types is None or self._types.get(pred) != wide:
            self._types = None
        new = self._typed(df, kinds, wide)
        known.parts.append(new)
        known.pending.append(new)

    def _arity(self, pred: str, n: int) -> None:
        waiting = {p: len(r[0][0]) for p, r in self.rows.items()}
        have = arities(self.clauses(), waiting | {p: len(b.types) for p, b in self.base.items()}).get(pred)
        if have is not None and have != n:
            raise RuleError(f"{pred} has {have} arguments, not {n}")

    def _typed(self, df: DataFrame, have, want) -> DataFrame:
        if list(have) == list(want):
            return df
        cols = [convert(F.col(f"p{i}"), a, b).alias(f"p{i}") for i, (a, b) in enumerate(zip(have, want, strict=True))]
        return df.select(*cols, *self.semiring.columns)

    def declare(self, pred: str, *args: str | int, conf: float = 1.0, prov: tuple[str, ...] | list[str] = ()) -> None:
        """Adds one fact; facts wait for the next run or query and then enter together."""
        if any(not isinstance(a, (str, int)) or isinstance(a, bool) for a in args):
            raise RuleError(f"facts hold symbols and 64-bit integers: {pred}{args}")
        self._arity(pred, len(args))
        self.rows.setdefault(pred, []).append((args, float(conf), sorted(set(prov))))

    def flush(self) -> None:
        """Lets the facts that were declared one by one enter."""
        for pred, rows in self.rows.items():
            kinds: list[str | None] = [None] * len(rows[0][0])
            for args, _, _ in rows:
                if len(args) != len(kinds):
                    raise RuleError(f"{pred} has {len(kinds)} arguments, not {len(args)}")
                kinds = [wider(k, type_of(a)) for k, a in zip(kinds, args, strict=True)]
            schema = ", ".join([*[f"p{i} {SPARK_TYPES[k]}" for i, k in enumerate(kinds)], "c double, v array<string>"])
            one = lambda a, k: a if k != ANY else (a, None) if isinstance(a, int) else (None, a)
            df = self.spark.createDataFrame([(*[one(a, k) for a, k in zip(args, kinds, strict=True)], c, v) for args, c, v in rows], schema)
            marks = self.semiring.one() | {k: v for k, v in {"_conf": F.col("c"), "_prov": F.col("v")}.items() if k in self.semiring.columns}
            self._add(pred, df.select(*[f"p{i}" for i in range(len(kinds))], *[v.alias(n) for n, v in marks.items()]), kinds)
        self.rows = {}

    def retract(self, pred: str, *args: str | int) -> bool:
        """Removes a base fact; False if there is none (a fact that rules derive isn't a base fact)."""
        self.flush()
        base = self.base.get(pred)
        if base is None or len(base.types) != len(args):
            return False
        match = F.lit(True)
        for i, (a, k) in enumerate(zip(args, base.types, strict=True)):
            match = match & F.coalesce(matches(F.col(f"p{i}"), k, a), F.lit(False))
        gone = [x.where(match) for x in base.parts]
        if not any(x.limit(1).count() for x in gone):
            return False
        self._remove(pred, [x.where(~match) for x in base.parts], self._union(gone, base.types))
        return True

    def retract_all(self, pred: str, df: DataFrame) -> None:
        """Removes the base facts that a DataFrame lists, columns by position."""
        self.flush()
        base = self.base.get(pred)
        if base is None:
            return
        kinds = self._kinds(df)
        keys = [f"p{i}" for i in range(len(base.types))]
        cols = [convert(F.col(f"`{c}`").cast(SPARK_TYPES[a]), a, b).alias(k) for c, k, a, b in zip(df.columns, keys, kinds, base.types, strict=True)]
        gone = df.select(*cols).distinct()
        self._remove(pred, [x.join(gone, keys, "left_anti") for x in base.parts], self._union([x.join(gone, keys, "left_semi") for x in base.parts], base.types))

    def _remove(self, pred: str, left: list[DataFrame], gone: DataFrame) -> None:
        base = self.base[pred]
        base.parts, base.pending, base.shrunk = left, [], True
        base.removals += 1
        self._compact(base)
        self._report((self.epoch, "Retracted", pred, gone.select(*[f"p{i}" for i in range(len(base.types))]).distinct()))

    def _compact(self, base: Base) -> None:
        """Stores a relation that has become a union of many tables, or has many removals, as one table."""
        if not base.pending and (len(base.parts) > MOST_PARTS or base.removals > MOST_PARTS):
            base.parts, base.removals = [self.space.stored(self._union(base.parts, base.types))], 0

    def _report(self, entry: tuple[int, str, str, DataFrame]) -> None:
        """Adds to the feed; older changes are stored as one table."""
        self.feed.append(entry)
        if len(self.feed) > MOST_CHANGES:
            self.old_feed, self.feed = self.space.stored(self.changes_from(0)), []

    def _unknown(self, pred: str, base: Base) -> DataFrame:
        """Of the facts that wait the ones that weren't known, keys only and each once."""
        new = self._keys(pred, self._union(base.pending, base.types)).distinct()
        known = base.parts[: len(base.parts) - len(base.pending)]
        if not known or not base.types:
            return new
        new = self.space.stored(new)
        return self.space.stored(self._without(new, self._keys(pred, self._union(known, base.types))))

    def _few(self, df: DataFrame) -> bool:
        """Whether a stored table may be broadcast."""
        return df.count() <= BROADCAST_FACTS

    def _without(self, new: DataFrame, have: DataFrame) -> DataFrame:
        """The rows of a stored table that another one lacks, by all columns; few rows are looked up there without shuffling it."""
        if self._few(new):
            have = have.join(F.broadcast(new), new.columns, "left_semi").distinct()
        return new.join(have, new.columns, "left_anti")

    # rules

    def clauses(self) -> list[Clause]:
        seen, out = set(), []
        for b in self.batches:
            for c in b.clauses:
                if c.clause_id not in seen:
                    seen.add(c.clause_id)
                    out.append(c)
        return out

    def rules(self) -> list[Clause]:
        return [c for c in self.clauses() if not c.is_fact]

    def demand_only(self) -> set[str]:
        """Predicates with rules that only a goal makes safe, and those that read them."""
        found: set[str] = set()
        for c in self.rules():
            try:
                check_clause(c)
            except RuleError:
                found.add(c.head.pred)
        while True:
            more = {c.head.pred for c in self.rules() if any(q in found for q, _ in reads(c))} - found
            if not more:
                return found
            found |= more

    def check(self, source: str) -> list[Clause]:
        """The clauses of a program that could be installed; else raises RuleError. Nothing changes."""
        clauses = parse_program(source)
        for c in clauses:
            try:
                check_clause(c)
            except RuleError:
                check_clause(c, c.head.variables())  # safe for goals that bind the head
        every = [*self.clauses(), *clauses]
        arities(every, {p: len(b.types) for p, b in self.base.items()} | {p: len(r[0][0]) for p, r in self.rows.items()})
        components(every)
        return clauses

    def install(self, source: str) -> str:
        """Installs a program as a batch, whole or not at all, and returns the batch's id."""
        clauses = self.check(source)
        self.counter += 1
        batch = Batch(f"b{self.counter}", source, clauses)
        self.batches.append(batch)
        self._touch(clauses)
        return batch.id

    def uninstall(self, batch_id: str) -> bool:
        """Removes a batch; what only it derived goes with the next run."""
        found = [b for b in self.batches if b.id == batch_id]
        if not found:
            return False
        self.batches = [b for b in self.batches if b.id != batch_id]
        self._touch(found[0].clauses)
        return True

    def _touch(self, clauses: list[Clause]) -> None:
        self._types = None
        for c in clauses:
            self.dirty.add(c.head.pred)
            if c.is_fact:
                base = self.base.get(c.head.pred)
                if base:
                    base.shrunk = True

    def batch_conflicts(self, batch_id: str) -> list[str]:
        """Predicates that this batch and another one both define."""
        own = {c.head.pred for b in self.batches if b.id == batch_id for c in b.clauses if not c.is_fact}
        return [f"{p} is also defined by {b.id}" for b in self.batches if b.id != batch_id for p in sorted(own & {c.head.pred for c in b.clauses if not c.is_fact})]

    # relations

    def types(self) -> dict[str, list[str | None]]:
        if self._types is None:
            clauses = self.clauses()
            ns = arities(clauses, {p: len(b.types) for p, b in self.base.items()})
            self._types = infer_types(clauses, {p: b.types for p, b in self.base.items()}, ns)
        return self._types

    def _empty(self, types) -> DataFrame:
        return self.spark.createDataFrame([], relation_schema(types, self.semiring) or "_one int")

    def _union(self, parts: list[DataFrame], types) -> DataFrame:
        if not parts:
            return self._empty(types)
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def _program_facts(self, pred: str, types) -> list[DataFrame]:
        heads = [c.head for c in self.clauses() if c.is_fact and c.head.pred == pred]
        if not heads:
            return []
        if not types:
            return [self.spark.range(1).select(F.lit(1).alias("_one"), *[v.alias(n) for n, v in self.semiring.one().items()])]
        one = lambda a, k: a if k != ANY else (a, None) if isinstance(a, int) else (None, a)
        df = self.spark.createDataFrame([tuple(one(a.value, k) for a, k in zip(h.args, types, strict=True)) for h in heads], relation_schema(types, Semiring()))
        return [df.select("*", *[v.alias(n) for n, v in self.semiring.one().items()])]

    def base_relation(self, pred: str) -> DataFrame | None:
        types = self.types().get(pred, [])
        base = self.base.get(pred)
        parts = [self._typed(x, base.types, types) for x in base.parts] if base else []
        parts += self._program_facts(pred, types)
        return self._union(parts, types) if parts else None

    def relation(self, pred: str) -> DataFrame:
        """All facts of a predicate, base and derived; equal facts may occur twice (see ``facts``)."""
        self.flush()
        types = self.types().get(pred)
        if types is None:
            raise RuleError(f"no such predicate: {pred}")
        parts = [x for x in [self.base_relation(pred)] if x is not None]
        if pred in self.derived:
            parts.append(self._typed(self.derived[pred], self.derived_types[pred], types))
        return self._union(parts, types)

    def facts(self, pred: str) -> DataFrame:
        """The facts of a predicate, each once, with its annotation."""
        df, types = self.relation(pred), self.types()[pred]
        if pred in self.derived and self.derived_types[pred] == types and types and self.base_relation(pred) is None:
            return df  # stored with each fact once
        return merged(df, len(types), self.semiring)

    def interpreted(self, pred: str, reading: Interpret, name: str = "value") -> DataFrame:
        """The facts of a predicate with a reading of their annotation in a column more."""
        return self.facts(pred).withColumn(name, reading.read({c: F.col(c) for c in self.semiring.columns}))

    # evaluation

    def set_now(self, now: int) -> None:
        """Moves the clock; relations that read it are derived anew by the next run (unless refresh_on_clock is off)."""
        if now != self.now:
            self.now, self.clock_moved = now, True

    def advance_clock(self, now: int) -> int:
        """Moves the clock forward only, then runs; returns the number of new facts."""
        self.set_now(max(now, self.now))
        return self.run()["total"]

    def invalidate_derived(self) -> None:
        self.dirty |= {c.head.pred for c in self.rules()}

    def _clock_readers(self) -> set[str]:
        return {c.head.pred for c in self.rules() if any(isinstance(x, Now) for x in c.body)}

    def run(self) -> dict[str, int]:
        """Brings derived relations up to date. Returns the new facts by predicate and their ``total``."""
        self.flush()
        types = self.types()
        lazy = self.demand_only()
        rules = [c for c in self.rules() if c.head.pred not in lazy]
        changes: dict[str, Change] = {}
        for pred, base in self.base.items():
            new = self._unknown(pred, base) if base.pending else None
            if base.shrunk:
                changes[pred] = Change(self._empty(types[pred]), self._empty(types[pred]))
            elif base.pending:
                # a known fact may come with a better annotation
                delta = self._union(base.pending, base.types) if self.semiring.columns else new
                changes[pred] = Change(self._typed(delta, base.types, types[pred]))
            if new is not None:
                self._report((self.epoch, "Added", pred, new))
            base.pending, base.shrunk = [], False
            self._compact(base)
        facts = {c.head.pred for c in self.clauses() if c.is_fact} & self.dirty
        for pred in facts:
            changes[pred] = Change(self._empty(types[pred]), self._empty(types[pred]))
        stale = {p for p in self.derived if p not in {c.head.pred for c in rules}}
        for pred in stale:
            gone = self.derived.pop(pred)
            if pred in types:
                changes[pred] = Change(self._empty(types[pred]), gone)
            self._report((self.epoch, "Retracted", pred, self._only_keys(gone)))
        clocked = self._clock_readers() if self.clock_moved and self.refresh_on_clock else set()
        report: dict[str, int] = {}
        self.last_iterations = 0
        for group in components(rules):
            own = [c for c in rules if c.head.pred in group]
            inputs = {q for c in own for q, _ in reads(c)}
            moved = {q for q in inputs | set(group) if q in changes}
            force = any(p in self.dirty or p in clocked or p not in self.derived or self.derived_types[p] != types[p] for p in group)
            if not force and not moved:
                continue
            closed = {q for c in own for q, c2 in reads(c) if c2}
            grows = not force and all(changes[q].removed is None and q not in closed for q in moved)
            old = {p: self._typed(self.derived[p], self.derived_types[p], types[p]) if p in self.derived else None for p in group}
            if grows:
                new = self._fixpoint(group, own, {q: changes[q].added for q in moved}, old)
                for p, (full, delta) in new.items():
                    self.derived[p] = full
                    self.steps[p] = self.steps.get(p, 0) + 1
                    if self.steps[p] > MOST_PARTS:
                        self.derived[p], self.steps[p] = self.space.stored(full), 0
                    n = delta.count()
                    if n:
                        changes[p] = Change(self._union([changes[p].added, delta], types[p]) if p in changes else delta)
                        report[p] = n
                        self._report((self.epoch, "Added", p, self._only_keys(delta)))
                continue
            new = self._fixpoint(group, own, None, {})
            for p, (full, _) in new.items():
                keys = [f"p{i}" for i in range(len(types[p]))]
                before = old[p] if old[p] is not None else self._empty(types[p])
                if keys and old[p] is not None:
                    added, removed = self._differences(full, before, keys)
                else:
                    added, removed = full, before
                n = full.count() if old[p] is None else added.count()
                lost = 0 if old[p] is None else removed.limit(1).count()
                self.derived[p], self.derived_types[p], self.steps[p] = full, types[p], 0
                if n:
                    report[p] = n
                    self._report((self.epoch, "Added", p, self._only_keys(added)))
                if lost:
                    self._report((self.epoch, "Retracted", p, self._only_keys(removed)))
                same = not n and not lost and not self.semiring.columns
                if not same:
                    annotated = bool(self.semiring.columns) and old[p] is not None
                    changes[p] = Change(added, removed if lost or annotated else None)
        self.dirty, self.clock_moved = set(), False
        self.epoch += 1
        return report | {"total": sum(report.values())}

    def _differences(self, full: DataFrame, before: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """What only the first and only the second of two tables of facts, each once, holds; both are shuffled once."""
        ann = list(self.semiring.columns)
        now = full.select(*keys, *ann, F.lit(True).alias("_now"))
        was = before.select(*keys, *[F.col(c).alias(f"_o{c}") for c in ann], F.lit(True).alias("_was"))
        differ = self.space.stored(now.join(was, keys, "full").where("_now is null or _was is null"))
        return differ.where("_now").select(*keys, *ann), differ.where("_was").select(*keys, *[F.col(f"_o{c}").alias(c) for c in ann])

    def _keys(self, pred: str, df: DataFrame) -> DataFrame:
        return df.select(*[f"p{i}" for i in range(len(self.base[pred].types))])

    def _only_keys(self, df: DataFrame) -> DataFrame:
        return df.select(*[c for c in df.columns if c[0] == "p"])

    def _closure_forms(self, group: list[str], own: list[Clause]) -> tuple[list[Clause], list[Clause]] | None:
        """(linear, doubling) forms of a transitive closure r of e, however it is written; None for other programs.

        Both derive the same facts, and an iteration may use either: a doubling one extends the newest facts by all known ones, e's among them."""
        if len(group) != 1 or len(own) != 2 or self.base_relation(group[0]) is not None:
            return None
        r = group[0]
        one = [c for c in own if len(c.body) == 1 and len(c.positives()) == 1]
        two = [c for c in own if len(c.body) == 2 and len(c.positives()) == 2]
        if len(one) != 1 or len(two) != 1 or any(not isinstance(a, Var) for c in own for x in (c.head, *c.positives()) for a in x.args):
            return None
        (e,), (a, b) = one[0].positives(), two[0].positives()
        head, (x, z) = one[0].head.args, two[0].head.args if len(two[0].head.args) == 2 else (None, None)
        if len(head) != 2 or e.args != head or head[0] == head[1] or e.pred == r or len(a.args) != 2 or len(b.args) != 2:
            return None
        if a.args[0] != x or b.args[1] != z or a.args[1] != b.args[0] or len({x, z, a.args[1]}) != 3 or not {a.pred, b.pred} <= {r, e.pred} or r not in (a.pred, b.pred):
            return None
        form = lambda p, q: Clause(two[0].head, (Pos(Atom(p, a.args)), Pos(Atom(q, b.args))), two[0].name)
        linear = two[0] if a.pred != b.pred else form(r, e.pred)
        return [one[0], linear], [one[0], form(r, r)]

    def _few_paths(self, left: DataFrame, right: DataFrame, full: DataFrame, few: bool = False) -> bool:
        """Whether joining some paths to others makes few rows for what it may save in iterations. ``few``: the left ones may be broadcast."""
        most = DOUBLING_ROWS + DOUBLING_TIMES * full.count()
        ends = left.groupBy(F.col("p1").alias("y")).agg(F.count(F.lit(1)).alias("i"))
        if few:
            made = right.select(F.col("p0").alias("y")).join(F.broadcast(ends), "y").agg(F.sum(F.col("i").cast("double"))).first()[0] or 0.0
            return made <= most
        starts = right.groupBy(F.col("p0").alias("y")).agg(F.count(F.lit(1)).alias("o"))
        if left.count() * (starts.agg(F.max("o")).first()[0] or 0) <= most:
            return True
        made = ends.join(starts, "y").agg(F.sum(F.col("i").cast("double") * F.col("o"))).first()[0] or 0.0
        return made <= most

    def _fixpoint(self, group: list[str], own: list[Clause], seeds: dict[str, DataFrame] | None, old: dict) -> dict[str, tuple[DataFrame, DataFrame]]:
        """Facts of a component as (all derived, newly derived), stored. ``seeds``: what the inputs gained since ``old``
        was complete; None derives from the base."""
        types, ann = self.types(), self.semiring
        recursive = any(q in group for c in own for q, _ in reads(c))
        forms = self._closure_forms(group, own) if recursive else None
        rules = forms[0] if forms else own
        static = {q: self.relation(q) for c in own for q, _ in reads(c) if q not in group}
        bases = {p: self.base_relation(p) for p in group}
        paths: dict[str, list[str]] = {p: [] for p in group}
        start: dict[str, DataFrame | None] = {p: old.get(p) for p in group}
        full = dict(start)
        schema = {p: self._empty(types[p]).schema for p in group}

        def known(pred: str) -> DataFrame:
            if pred in static:
                return static[pred]
            parts = [x for x in (bases[pred], full[pred]) if x is not None]
            return self._union(parts, types[pred])

        def fire(changed: dict[str, DataFrame] | None, rules: list[Clause] = rules) -> dict[str, DataFrame]:
            found: dict[str, list[DataFrame]] = {}
            for c in rules:
                atoms = c.positives()
                if changed is None:
                    found.setdefault(c.head.pred, []).append(derive(self.spark, c, lambda k, q: known(q), types, ann, self.now))
                    continue
                for k, a in enumerate(atoms):
                    if a.pred in changed:
                        pick = lambda i, q, k=k, a=a: changed[a.pred] if i == k else known(q)
                        found.setdefault(c.head.pred, []).append(derive(self.spark, c, pick, types, ann, self.now, k))
            return {p: merged(self._union(xs, types[p]), len(types[p]), ann) for p, xs in found.items()}

        def absorb(found: dict[str, DataFrame], few: bool = False) -> dict[str, DataFrame]:
            """Stores what is new and returns it. ``few``: what was found may be little, then it is looked up without shuffling all facts."""
            out = {}
            for p, df in found.items():
                keys = [f"p{i}" for i in range(len(types[p]))]
                have = full[p]
                if have is not None and not ann.columns:
                    if keys and few:
                        df = self._without(self.space.stored(df), have)
                    else:
                        df = df.join(have, keys, "left_anti") if keys else df.join(have.limit(1).select(F.lit(1).alias("_one")), "_one", "left_anti")
                elif have is not None:
                    was = have.select(*keys, *[F.col(c).alias(f"_o{c}") for c in ann.columns], F.lit(True).alias("_had"))
                    grew = ann.grew({c: F.col(f"_o{c}") for c in ann.columns}, {c: F.col(c) for c in ann.columns})
                    df = (df.join(was, keys, "left") if keys else df.crossJoin(was)).where(F.col("_had").isNull() | grew).select(*keys, *ann.columns, "_had")
                path = self.space.put(df)
                new = self.space.get([path], df.schema)
                if not new.limit(1).count():
                    continue
                better = have is not None and bool(ann.columns) and new.where("_had").limit(1).count() > 0
                out[p] = new = new.drop("_had")
                if better:
                    start[p], paths[p] = self.space.stored(merged(have.unionByName(new), len(types[p]), ann)), []
                else:
                    paths[p].append(path)
                parts = [start[p], self.space.get(paths[p], schema[p]) if paths[p] else None]
                full[p] = self._union([x for x in parts if x is not None], types[p])
            return out

        def by_powers(newest: DataFrame) -> dict[str, DataFrame]:
            """Extends a closure's newest facts by e's paths of 1, 2, 4, 8... steps, so that a path of a tree is made once. Returns facts that are
            still to be extended, if the next power would make too many rows."""
            r = group[0]
            extend = lambda a, b: derive(self.spark, forms[1][1], lambda k, q: a if k == 0 else b, types, ann, self.now)
            ends = seeds is None or forms[0][1].positives()[0].pred == r
            power = newest if seeds is None else self.space.stored(merged(derive(self.spark, forms[0][0], lambda k, q: known(q), types, ann, self.now), len(types[r]), ann))
            longer = seeds is None
            while True:
                if longer:
                    if not self._few_paths(power, power, full[r]):
                        return {r: newest}
                    power = self.space.stored(merged(extend(power, power), len(types[r]), ann))
                    if not power.limit(1).count():
                        return {}
                # all paths shorter than the power's, from the base or from what is new
                reach = full[r] if seeds is None else self._union(gained[r], types[r])
                a, b = (reach, power) if ends else (power, reach)
                if not self._few_paths(a, b, full[r]):
                    return {r: newest}
                self.last_iterations += 1
                made = [extend(a, b), *([power] if seeds is None else [])]
                found = absorb({r: merged(self._union(made, types[r]), len(types[r]), ann)})
                if r not in found:
                    return {}
                newest, longer = found[r], True
                gained[r].append(newest)

        delta = absorb(fire(seeds), seeds is not None)
        gained: dict[str, list[DataFrame]] = {p: [d] for p, d in delta.items()}
        if forms is not None and delta and not ann.columns and (seeds is None or not self._few(delta[group[0]])):
            delta = by_powers(delta[group[0]])
        while recursive and delta:
            self.last_iterations += 1
            few = seeds is not None and all(self._few(d) for d in delta.values())
            plain = bool(ann.columns) and len(gained[group[0]]) <= PLAIN_STEPS if forms is not None else True
            double = not plain and self._few_paths(delta[group[0]], full[group[0]], full[group[0]], few)
            delta = absorb(fire(delta, forms[1] if double else rules), few)
            for p, d in delta.items():
                gained.setdefault(p, []).append(d)
        out = {}
        for p in group:
            every = full[p] if full[p] is not None else self.space.stored(self._empty(types[p]))
            news = self._union(gained.get(p, []), types[p])
            if ann.columns and p in gained and seeds is not None:
                keys = [f"p{i}" for i in range(len(types[p]))]
                news = merged(news, len(types[p]), ann)
                if old.get(p) is not None and keys:
                    news = news.join(old[p], keys, "left_anti")
            out[p] = (every, news)
        return out

    # questions

    def query(self, pred: str, *pattern: str | int | None) -> DataFrame:
        """Facts of a predicate whose arguments equal the pattern's where it isn't None; columns p0.. and annotations."""
        df = self.relation(pred)
        kinds = self.types()[pred]
        if pattern and len(pattern) != len(kinds):
            raise RuleError(f"{pred} has {len(kinds)} arguments, not {len(pattern)}")
        for i, v in enumerate(pattern):
            if v is not None:
                df = df.where(matches(F.col(f"p{i}"), kinds[i], v))
        return merged(df, len(kinds), self.semiring)

    def contains(self, pred: str, *args: str | int) -> bool:
        return pred in self.types() and self.query(pred, *args).limit(1).count() > 0

    def bindings(self, goal: Atom, df: DataFrame, kinds) -> DataFrame:
        """The goal's variables as columns, once for each distinct binding. A ground goal that holds gives one row ``holds``."""
        cols, seen = {}, {}
        for i, a in enumerate(goal.args):
            if isinstance(a, Const):
                df = df.where(matches(F.col(f"p{i}"), kinds[i], a.value))
            elif isinstance(a, Var):
                if a.name in seen:
                    df = df.where(F.col(f"p{seen[a.name]}") == F.col(f"p{i}"))
                else:
                    seen[a.name] = i
                    value = F.col(f"p{i}")
                    cols[a.name] = F.coalesce(value["i"].cast("string"), value["s"]) if kinds[i] == ANY else value
        marks = list(self.semiring.columns)
        if not cols:
            df = df.select(F.lit(True).alias("holds"), *marks)
            return df.limit(1)
        out = df.select(*[c.alias(n) for n, c in cols.items()], *marks)
        return out.distinct() if not marks else out.groupBy(*cols).agg(*[c.alias(n) for n, c in self.semiring.plus().items()])

    def ask(self, goal: str | Atom) -> DataFrame:
        """Answers a goal of one atom from what is materialized."""
        atom = parse_goal(goal) if isinstance(goal, str) else goal
        kinds = self.types().get(atom.pred)
        if kinds is None:
            self.flush()
            kinds = self.types().get(atom.pred)
        if kinds is None:
            raise RuleError(f"no such predicate: {atom.pred}")
        if len(kinds) != len(atom.args):
            raise RuleError(f"{atom.pred} has {len(kinds)} arguments, not {len(atom.args)}")
        return self.bindings(atom, self.relation(atom.pred), kinds)

    def ask_deep(self, goal: str | Atom) -> DataFrame:
        """Answers a goal by deriving only what it demands; the engine itself stays as it is."""
        atom = parse_goal(goal) if isinstance(goal, str) else goal
        self.flush()
        derived = {c.head.pred for c in self.rules()}
        if atom.pred not in derived:
            return self.ask(atom)
        if atom.pred in self.derived and not self.dirty and not any(b.pending or b.shrunk for b in self.base.values()) and not self.clock_moved:
            return self.ask(atom)
        goal_pred, clauses, seeds = magic.rewrite(atom, self.rules())
        side = self.fork()
        side.derived, side.derived_types, side.batches = {}, {}, [Batch("demand", "", [*[c for c in self.clauses() if c.is_fact], *clauses])]
        side.dirty = set()
        for pred, original in magic.base_names(clauses).items():
            facts = self.base_relation(original)
            if facts is not None:
                side._types = None
                side.base[pred] = Base(list(self.types()[original]), [facts], [])
        for pred, args in seeds:
            side.declare(pred, *args)
        side.flush()
        side._types = None
        report = side.run()
        self.last_demand_facts = report["total"]
        if goal_pred not in side.types():
            return self.ask(atom)
        return side.bindings(atom, side.relation(goal_pred), side.types()[goal_pred])

    def fork(self) -> "Engine":
        """An engine with the same facts and rules; what is done to it doesn't reach this one."""
        side = Engine(self.spark, self.semiring, self.now, self.refresh_on_clock)
        side.base = {p: Base(list(b.types), list(b.parts), list(b.pending), b.shrunk, b.removals) for p, b in self.base.items()}
        side.rows = {p: list(r) for p, r in self.rows.items()}
        side.derived, side.derived_types = dict(self.derived), dict(self.derived_types)
        side.batches, side.counter, side.epoch = list(self.batches), self.counter, self.epoch
        side.dirty, side.clock_moved = set(self.dirty), self.clock_moved
        return side

    def what_if(self, assumed: list[tuple], goal: str, retracted: list[tuple] = ()) -> DataFrame:
        """Answers a goal as if facts (pred, args...) held or didn't hold. This engine stays as it is."""
        side = self.fork()
        for pred, *args in assumed:
            side.declare(pred, *args, prov=("hypothetical",))
        for pred, *args in retracted:
            side.retract(pred, *args)
        side.run()
        return side.ask(goal)

    def ask_text(self, goal: str, deep: bool = False) -> list[str]:
        """Answers as lines ``X=a, Y=b``; a ground goal that holds gives one empty line."""
        df = self.ask_deep(goal) if deep else self.ask(goal)
        names = [c for c in df.columns if c not in self.semiring.columns and c != "holds"]
        return sorted(", ".join(f"{n}={r[n]}" for n in names) for r in df.collect())

    # changes

    def changes_from(self, epoch: int) -> DataFrame:
        """The feed since an epoch, inclusive: (epoch, kind, pred, args) with args as a JSON array."""
        parts = [] if self.old_feed is None else [self.old_feed.where(F.col("epoch") >= epoch)]
        for e, kind, pred, df in self.feed:
            if e >= epoch:
                text = F.to_json(F.array(*[self._shown(df, c) for c in df.columns]))
                parts.append(df.select(F.lit(e).cast("long").alias("epoch"), F.lit(kind).alias("kind"), F.lit(pred).alias("pred"), text.alias("args")))
        if not parts:
            return self.spark.createDataFrame([], "epoch long, kind string, pred string, args string")
        return self._union(parts, [])

    changes_since = changes_from

    def _shown(self, df: DataFrame, name: str):
        """A column as text, whatever its kind."""
        col = F.col(name)
        return F.coalesce(col["i"].cast("string"), col["s"]) if df.schema[name].dataType.typeName() == "struct" else col.cast("string")

    def schema_summary(self, samples: int = 3) -> list[str]:
        """``pred/arity: n rows`` and some rows, for each relation."""
        self.flush()
        out = []
        for pred in sorted(self.types()):
            df = self.facts(pred)
            rows = [self.render(pred, r) for r in df.limit(samples).collect()]
            out.append(f"{pred}/{len(self.types()[pred])}: {df.count()} rows" + (f" e.g. {'; '.join(rows)}" if rows else ""))
        return out

    def render(self, pred: str, row) -> str:
        show = lambda v: str((v["i"] if v["i"] is not None else v["s"]) if hasattr(v, "asDict") else v)
        return f"{pred}({', '.join(show(row[f'p{i}']) for i in range(len(self.types()[pred])))})"

