"""From a clause to a DataFrame. Join order, strategies and pushdown are left to Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.program import ANY, INT, SYM, term_type, variable_types
from tessera.plans.rules import Agg, Clause, Cmp, Const, Neg, Now, RuleError, Term, Var, Wild
from tessera.plans.semiring import Semiring

SPARK_TYPES = {SYM: "string", INT: "bigint", ANY: "struct<i:bigint,s:string>", None: "string"}


def relation_schema(types: list[str | None], semiring: Semiring) -> str:
    cols = [f"p{i} {SPARK_TYPES[t]}" for i, t in enumerate(types)] + [f"{c} {t}" for c, t in semiring.columns.items()]
    return ", ".join(cols)


def convert(col: Column, have: str | None, want: str | None) -> Column:
    """A column of another kind; values that the kind doesn't hold become null."""
    have, want = have or SYM, want or SYM
    if have == want:
        return col
    if want == ANY:
        i, s = (col, F.lit(None).cast("string")) if have == INT else (F.lit(None).cast("bigint"), col)
        return F.when(col.isNotNull(), F.struct(i.alias("i"), s.alias("s")))
    if have == ANY:
        return col["i"] if want == INT else col["s"]
    return F.lit(None).cast(SPARK_TYPES[want])


def convert_text(col: Column, kind: str | None) -> Column:
    return F.coalesce(col["i"].cast("string"), col["s"]) if kind == ANY else col.cast("string")


def literal(value: str | int, want: str | None) -> Column:
    return convert(F.lit(value).cast("bigint") if isinstance(value, int) else F.lit(value), INT if isinstance(value, int) else SYM, want)


def matches(col: Column, kind: str | None, value: str | int) -> Column:
    """Whether a column equals a constant, in a form that reaches the scan's filters."""
    own = INT if isinstance(value, int) else SYM
    if (kind or SYM) == ANY:
        return col["i" if own == INT else "s"] == F.lit(value)
    return col == F.lit(value) if (kind or SYM) == own else F.lit(False)


def compare(op: str, a: Column, ta: str | None, b: Column, tb: str | None) -> Column:
    """Integers compare as numbers, symbols by their text; of different kinds only ``\\=`` holds."""
    ops = {"<": lambda x, y: x < y, "=<": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "=": lambda x, y: x == y, "\\=": lambda x, y: x != y}
    ta, tb = ta or SYM, tb or SYM
    if ta == tb and ta != ANY:
        return ops[op](a, b)
    both = [ops[op](convert(a, ta, k), convert(b, tb, k)) for k in (INT, SYM) if ta in (k, ANY) and tb in (k, ANY)]
    same = F.lit(False)
    for x in both:
        same = same | F.coalesce(x, F.lit(False))
    if op == "\\=":
        pairs = [convert(a, ta, k).isNotNull() & convert(b, tb, k).isNotNull() for k in (INT, SYM) if ta in (k, ANY) and tb in (k, ANY)]
        alike = F.lit(False)
        for x in pairs:
            alike = alike | x
        return same | ~alike
    return same


class Body:
    """The body of a clause as it is joined up. ``names`` maps variables to columns, which differ in more than case."""

    def __init__(self, clause: Clause, types: dict[str, list[str | None]], semiring: Semiring, now: int, keep: set[str]) -> None:
        self.clause, self.types, self.semiring, self.now, self.keep = clause, types, semiring, now, keep
        self.env = variable_types(clause, types)
        self.names: dict[str, str] = {}
        self.bound: set[str] = set()
        self.df: DataFrame | None = None
        self.annotated = False
        self.rest = [x for x in clause.body if not hasattr(x, "atom") or isinstance(x, Neg)]
        self.waiting: list = []

    def name(self, var: str) -> str:
        return self.names.setdefault(var, f"v{len(self.names)}")

    def operand(self, term: Term) -> tuple[Column, str | None]:
        if isinstance(term, Const):
            t = term_type(term, {})
            return literal(term.value, t), t
        return F.col(self.name(term.name)), self.env.get(term.name)

    def scan(self, atom, df: DataFrame) -> DataFrame:
        """One atom over its relation: constants and repeated variables become filters, wildcards go."""
        kinds, cols, seen = self.types[atom.pred], {}, {}
        for i, a in enumerate(atom.args):
            if isinstance(a, Const):
                df = df.where(matches(F.col(f"p{i}"), kinds[i], a.value))
            elif isinstance(a, Var):
                if a.name in seen:
                    j = seen[a.name]
                    df = df.where(compare("=", F.col(f"p{j}"), kinds[j], F.col(f"p{i}"), kinds[i]))
                else:
                    seen[a.name] = i
                    cols[a.name] = convert(F.col(f"p{i}"), kinds[i], self.env.get(a.name))
                    if (kinds[i] or SYM) != (self.env.get(a.name) or SYM):
                        df = df.where(cols[a.name].isNotNull())
        return df.select(*[c.alias(self.name(v)) for v, c in cols.items()], *[F.col(c) for c in df.columns if c in self.semiring.columns])

    def needed(self) -> set[str]:
        names = set(self.keep)
        for x in [*self.rest, *self.waiting]:
            names |= x.atom.variables() if hasattr(x, "atom") else x.variables() if isinstance(x, Cmp) else {x.term.name} if isinstance(x.term, Var) else set()
        return names

    def add(self, atom, df: DataFrame) -> None:
        new = self.scan(atom, df)
        names = atom.variables()
        shared = [self.name(v) for v in sorted(names & self.bound)]
        ann = list(self.semiring.columns)
        if self.df is None:
            self.df, self.annotated = new, bool(ann)
        elif not ann and names <= self.bound and shared:
            self.df = self.df.join(new, shared, "left_semi")
        else:
            new = new.withColumnsRenamed({c: f"_n{c}" for c in ann})
            self.df = self.df.join(new, shared) if shared else self.df.crossJoin(new)
            if ann:
                merged = self.semiring.times({c: F.col(c) for c in ann}, {c: F.col(f"_n{c}") for c in ann})
                self.df = self.df.withColumns(merged).drop(*[f"_n{c}" for c in ann])
        self.bound |= names
        self.settle()
        need = self.needed()
        self.df = self.df.select(*[self.name(v) for v in sorted(self.bound) if v in need], *ann)
        self.bound = {v for v in self.bound if v in need}

    def start(self, spark: SparkSession) -> None:
        """A body without atoms fires once."""
        if self.df is None:
            one = spark.range(1)
            self.df = one.select(*[c.alias(n) for n, c in self.semiring.one().items()]) if self.semiring.columns else one.select(F.lit(1).alias("_one"))
            self.settle()

    def settle(self) -> None:
        """Applies what has become applicable: clock, assignments, comparisons, negations."""
        going = True
        while going:
            going = False
            for x in list(self.rest):
                done = self.apply(x)
                if done:
                    self.rest.remove(x)
                    going = True

    def apply(self, x) -> bool:
        if isinstance(x, Now):
            if isinstance(x.term, Wild):
                return True
            clock = F.lit(self.now).cast("bigint")
            if isinstance(x.term, Const) or x.term.name in self.bound:
                self.df = self.df.where(compare("=", *self.operand(x.term), clock, INT))
            else:
                self.df = self.df.withColumn(self.name(x.term.name), clock)
                self.bound.add(x.term.name)
            return True
        if isinstance(x, Cmp):
            free = x.variables() - self.bound
            if not free:
                self.df = self.df.where(compare(x.op, *self.operand(x.left), *self.total(x.right)))
                return True
            if x.op != "=" or len(free) > 1:
                return False
            (v,) = free
            if x.left == Var(v):
                if any(t == Var(v) for _, t in x.right):
                    return False
                value, kind = self.total(x.right)
            else:
                places = [s for s, t in x.right if t == Var(v)]
                if places != [1]:
                    return False
                left, others = x.left, [(-s, t) for s, t in x.right if t != Var(v)]
                value, kind = self.total([(1, left), *others])
            self.df = self.df.withColumn(self.name(v), convert(value, kind, self.env.get(v))).where(F.col(self.name(v)).isNotNull())
            self.bound.add(v)
            return True
        return False  # negations come last, once all positive atoms are in

    def total(self, terms) -> tuple[Column, str | None]:
        if len(terms) == 1:
            return self.operand(terms[0][1])
        out = None
        for sign, t in terms:
            value = convert(*self.operand(t), INT)
            out = value if out is None else F.try_add(out, value) if sign > 0 else F.try_subtract(out, value)
        return out, INT

    def negate(self, atom, df: DataFrame) -> None:
        """Negation as absence, or by the factor that the semiring gives a negated atom."""
        ann, graded = list(self.semiring.columns), self.semiring.hooked("negate")
        kinds, on, seen = self.types[atom.pred], {}, {}
        for i, a in enumerate(atom.args):
            if isinstance(a, Const):
                df = df.where(matches(F.col(f"p{i}"), kinds[i], a.value))
            elif isinstance(a, Var):
                if a.name in seen:
                    j = seen[a.name]
                    df = df.where(compare("=", F.col(f"p{j}"), kinds[j], F.col(f"p{i}"), kinds[i]))
                elif a.name in self.bound:
                    on[self.name(a.name)] = convert(F.col(f"p{i}"), kinds[i], self.env.get(a.name))
                seen.setdefault(a.name, i)
        if graded:
            sums = [c.alias(f"_n{n}") for n, c in self.semiring.plus().items()]
            cols = [c.alias(n) for n, c in on.items()]
            found = df.groupBy(*cols).agg(*sums).withColumn("_there", F.lit(True)) if on else df.agg(*sums, F.count(F.lit(1)).alias("_rows")).where("_rows > 0").drop("_rows").withColumn("_there", F.lit(True))
            self.df = self.df.join(found, list(on), "left") if on else self.df.withColumn("_k", F.lit(1)).join(found.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
            factor = self.semiring.negate({c: F.col(f"_n{c}") for c in ann}, F.coalesce("_there", F.lit(False)))
            self.df = self.df.withColumns({f"_f{c}": v for c, v in factor.items()}).where(~self.semiring.is_zero({c: F.col(f"_f{c}") for c in ann}))
            product = self.semiring.times({c: F.col(c) for c in ann}, {c: F.col(f"_f{c}") for c in ann})
            self.df = self.df.withColumns(product).drop("_there", *[f"_n{c}" for c in ann], *[f"_f{c}" for c in ann])
        elif on:
            self.df = self.df.join(df.select(*[c.alias(n) for n, c in on.items()]), list(on), "left_anti")
        else:
            some = df.limit(1).select(F.lit(1).alias("_k"))
            self.df = self.df.withColumn("_k", F.lit(1)).join(some, "_k", "left_anti").drop("_k")


def join_order(clause: Clause, first: int | None) -> list[int]:
    """Positions of the positive atoms: the given one first, then always one that shares most variables with those before."""
    atoms = clause.positives()
    left = list(range(len(atoms)))
    order: list[int] = []
    bound: set[str] = set()
    while left:
        if not order and first is not None:
            k = first
        else:
            k = max(left, key=lambda i: (len(atoms[i].variables() & bound), sum(isinstance(a, Const) for a in atoms[i].args), -i))
        order.append(k)
        left.remove(k)
        bound |= atoms[k].variables()
    return order


Source = Callable[[int | None, str], DataFrame]


def solve(spark: SparkSession, clause: Clause, source: Source, types, semiring: Semiring, now: int, keep: set[str], first: int | None = None) -> Body:
    """The joined body. ``source(k, pred)`` gives the relation for the k-th positive atom, ``source(None, pred)`` for a negated one."""
    body = Body(clause, types, semiring, now, keep)
    atoms = clause.positives()
    body.waiting = list(x for x in clause.body if hasattr(x, "atom") and not isinstance(x, Neg))
    for k in join_order(clause, first):
        body.waiting = [x for x in body.waiting if x.atom is not atoms[k]]
        body.add(atoms[k], source(k, atoms[k].pred))
    body.start(spark)
    for x in [y for y in body.rest if isinstance(y, Neg)]:
        body.rest.remove(x)
        body.negate(x.atom, source(None, x.atom.pred))
    if body.rest:
        raise RuleError(f"{body.rest[0]} can't be evaluated: {clause}")
    return body


def merged(df: DataFrame, n: int, semiring: Semiring) -> DataFrame:
    """Equal facts become one, with the sum of their annotations."""
    keys = [f"p{i}" for i in range(n)]
    if not semiring.columns:
        return df.distinct() if n else df.limit(1)
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in semiring.plus().items()])


def derive(spark: SparkSession, clause: Clause, source: Source, types, semiring: Semiring, now: int, first: int | None = None) -> DataFrame:
    """The facts that a clause derives, not yet merged."""
    head = clause.head
    inner = [a.term if isinstance(a, Agg) else a for a in head.args]
    keep, stamped = {a.name for a in inner if isinstance(a, Var)}, semiring.hooked("derive")
    if stamped:  # the identity of a derivation is that of all its atoms
        keep |= {v for a in clause.positives() for v in a.variables()}
    body = solve(spark, clause, source, types, semiring, now, keep, first)
    want = types[head.pred]
    if stamped:
        shown = lambda t: F.lit("_") if isinstance(t, Wild) else convert_text(*body.operand(t))
        atoms = [F.concat(F.lit(f"{a.pred}("), F.concat_ws(", ", *[shown(t) for t in a.args]), F.lit(")")) for a in clause.positives()]
        marks = semiring.derive({c: F.col(c) for c in semiring.columns}, clause.clause_id, F.array_sort(F.array(*atoms)) if atoms else F.expr("cast(array() as array<string>)"))
        body.df = body.df.withColumns(marks)

    def column(term: Term, kind: str | None) -> Column:
        value, have = body.operand(term)
        return convert(value, have, kind)

    if not clause.aggregates:
        cols = [column(a, want[i]).alias(f"p{i}") for i, a in enumerate(head.args)]
        marks = [F.col(c) for c in semiring.columns]
        return body.df.select(*cols, *marks) if cols or marks else body.df.select(F.lit(1).alias("_one"))
    # aggregates fold the distinct tuples of group and aggregated terms together
    group = [i for i, a in enumerate(head.args) if not isinstance(a, Agg)]
    terms = [column(a.term if isinstance(a, Agg) else a, term_type(a.term, body.env) if isinstance(a, Agg) else want[i]).alias(f"p{i}") for i, a in enumerate(head.args)]
    marks = semiring.aggregate(tuple(a.fn for a in head.args if isinstance(a, Agg)))
    tuples = body.df.select(*terms, *(list(semiring.columns) if marks else []))
    tuples = merged(tuples, len(terms), semiring) if marks else tuples.distinct()
    folds = [F.count(F.lit(1)).alias("_rows")]
    for i, a in enumerate(head.args):
        if isinstance(a, Agg):
            kind = term_type(a.term, body.env)
            if a.fn == "sum" and kind == SYM:
                raise RuleError(f"sum needs integers: {clause}")
            col = convert(F.col(f"p{i}"), kind, INT) if a.fn == "sum" or kind == ANY else F.col(f"p{i}")
            fold = {"count": F.count(F.lit(1)), "min": F.min(col), "max": F.max(col), "sum": F.coalesce(F.sum(col), F.lit(0))}[a.fn]
            folds.append(convert(fold, INT if a.fn in ("count", "sum") or kind == ANY else kind, want[i]).alias(f"p{i}"))
    out = tuples.groupBy(*[f"p{i}" for i in group]).agg(*folds, *[c.alias(n) for n, c in (marks or {}).items()]).where("_rows > 0")
    if marks:
        return out.select(*[f"p{i}" for i in range(len(head.args))], *marks)
    return out.select(*[f"p{i}" for i in range(len(head.args))], *[c.alias(n) for n, c in semiring.aggregated().items()])
