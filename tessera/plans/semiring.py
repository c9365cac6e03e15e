"""Annotations of facts as column expressions, so that they stay inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


Marks = dict[str, Column]


class Semiring:
    """What a fact carries besides its arguments: ``columns`` (name to type) and how they combine.

    ``times`` joins the annotations of a body, ``plus`` aggregates those of equal facts, ``grew`` says whether the second
    annotation adds anything to the first. ``plus`` must be idempotent for recursion to end.

    Three more hooks may be overridden; as long as they aren't, they cost nothing. ``negate`` gives the factor of a negated atom,
    ``derive`` stamps a body's product with the identity of its derivation, ``aggregate`` folds the annotations of a group's rows."""

    columns: dict[str, str] = {}

    def one(self) -> Marks:
        return {}

    def times(self, a: Marks, b: Marks) -> Marks:
        return {}

    def plus(self) -> Marks:
        return {}

    def grew(self, old: Marks, new: Marks) -> Column:
        return F.lit(False)

    def is_zero(self, a: Marks) -> Column:
        """Whether an annotation means that there is no derivation; rows for which a negated atom's factor is zero go."""
        return F.lit(False)

    def negate(self, found: Marks, present: Column) -> Marks | None:
        """The factor of a negated atom: ``found`` is the sum of the annotations of what matches, ``present`` whether anything does. None
        (the default) is negation as absence."""
        return None

    def derive(self, a: Marks, clause_id: str, body: Column) -> Marks | None:
        """A body's product with the mark of its derivation: the clause's content id, and the body's ground atoms as a sorted array of
        texts, the same however the body was joined. None (the default) leaves the product as it is."""
        return None

    def aggregate(self, fns: tuple[str, ...]) -> Marks | None:
        """Aggregates over the annotations of the distinct rows that a head with the aggregates ``fns``, in order, folds. None (the
        default) gives ``aggregated``."""
        return None

    def aggregated(self) -> Marks:
        """The annotation of an aggregate's result, where ``aggregate`` doesn't say."""
        return self.one()

    def render(self, marks: dict) -> str:
        """How a fact's annotation is shown in a proof."""
        parts = [f"conf {marks['_conf']:.3f}"] if marks.get("_conf") is not None else []
        parts += [f"prov [{', '.join(marks['_prov'])}]"] if marks.get("_prov") is not None else []
        parts += [f"{c.lstrip('_')} {v}" for c, v in marks.items() if c not in ("_conf", "_prov")]
        return f"  ({', '.join(parts)})" if parts else ""

    def hooked(self, name: str) -> bool:
        return getattr(type(self), name) is not getattr(Semiring, name)


class Interpret:
    """A reading of finished annotations, as a column. The fixpoint never sees it, so it need not be lawful: a mean, a median, a text."""

    def read(self, a: Marks) -> Column:
        raise NotImplementedError


class Facts(Semiring):
    """Plain sets of facts."""


class Confidence(Semiring):
    """The best product of confidences over all derivations."""

    columns = {"_conf": "double"}

    def one(self):
        return {"_conf": F.lit(1.0)}

    def times(self, a, b):
        return {"_conf": a["_conf"] * b["_conf"]}

    def plus(self):
        return {"_conf": F.max("_conf")}

    def grew(self, old, new):
        return new["_conf"] > old["_conf"] + 1e-12


class Lineage(Confidence):
    """Confidence, and the sorted ids of all sources that any derivation uses."""

    columns = {"_conf": "double", "_prov": "array<string>"}

    def one(self):
        return {"_conf": F.lit(1.0), "_prov": F.expr("cast(array() as array<string>)")}

    def times(self, a, b):
        return {"_conf": a["_conf"] * b["_conf"], "_prov": F.array_union(a["_prov"], b["_prov"])}

    def plus(self):
        return {"_conf": F.max("_conf"), "_prov": F.array_sort(F.array_distinct(F.flatten(F.collect_set("_prov"))))}

    def grew(self, old, new):
        return (new["_conf"] > old["_conf"] + 1e-12) | (F.size(F.array_except(new["_prov"], old["_prov"])) > 0)


class Depth(Semiring):
    """The smallest number of base facts that a derivation uses: an example of a carrier of one's own."""

    columns = {"_cost": "long"}

    def one(self):
        return {"_cost": F.lit(0).cast("long")}

    def times(self, a, b):
        return {"_cost": a["_cost"] + b["_cost"]}

    def plus(self):
        return {"_cost": F.min("_cost")}

    def grew(self, old, new):
        return new["_cost"] < old["_cost"]


def distinct_sorted(values: Column) -> Column:
    """An array sorted, each element once. Spark's own array_distinct and array_except compare structs pair by pair; here equal ones are neighbours.
    The outer transform names the sorted array, so that it is made once."""
    kept = lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))
    return F.transform(F.array(F.sort_array(values)), kept)[0]


class Derivations(Semiring):
    """The set of derivations of a fact, each with the confidence of its body's product: a carrier of which averages can be read."""

    columns = {"_conf": "double", "_ways": "array<struct<id:string,conf:double>>"}

    def one(self):
        return {"_conf": F.lit(1.0), "_ways": F.expr("cast(array() as array<struct<id:string,conf:double>>)")}

    def times(self, a, b):
        return {"_conf": a["_conf"] * b["_conf"], "_ways": self.one()["_ways"]}

    def plus(self):
        return {"_conf": F.max("_conf"), "_ways": distinct_sorted(F.flatten(F.collect_set("_ways")))}

    def grew(self, old, new):
        return (new["_conf"] > old["_conf"] + 1e-12) | (F.size(distinct_sorted(F.concat(old["_ways"], new["_ways"]))) > F.size(old["_ways"]))

    def derive(self, a, clause_id, body):
        way = F.struct(F.concat_ws("|", F.lit(clause_id), body).alias("id"), a["_conf"].alias("conf"))
        return {"_conf": a["_conf"], "_ways": F.array(way)}

    def aggregate(self, fns):
        # a count is as sure as its least sure row, a sum as its rows are on average
        fold = F.avg("_conf") if "sum" in fns else F.min("_conf")
        return {"_conf": fold, "_ways": F.first(self.one()["_ways"])}


class MeanConfidence(Interpret):
    """The mean confidence of a fact's derivations, its own where it has none."""

    def read(self, a):
        total = F.aggregate(a["_ways"], F.lit(0.0), lambda s, w: s + w["conf"])
        return F.when(F.size(a["_ways"]) > 0, total / F.size(a["_ways"])).otherwise(a["_conf"])


class Doubt(Confidence):
    """Confidence for which a negated atom isn't absent or present but as likely as its match isn't."""

    def negate(self, found, present):
        return {"_conf": F.when(present, 1 - found["_conf"]).otherwise(F.lit(1.0))}

    def is_zero(self, a):
        return a["_conf"] <= 1e-12


MODES = {"facts": Facts, "conf": Confidence, "lineage": Lineage}
