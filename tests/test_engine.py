import pytest
from pyspark.sql import functions as F

from tessera.operators.engine import Engine
from tessera.operators.proofs import why
from tessera.plans.rules import RuleError
from tessera.plans.semiring import Depth


def rows(df):
    return {tuple(r) for r in df.collect()}


def answers(e, goal, deep=False):
    return e.ask_text(goal, deep)


def chain(spark, n, mode="facts"):
    e = Engine(spark, mode)
    e.register("e", spark.range(n).select(F.concat(F.lit("n"), "id"), F.concat(F.lit("n"), F.col("id") + 1)))
    return e


@pytest.mark.parametrize("rule", ["r(X, Z) :- r(X, Y), e(Y, Z).", "r(X, Z) :- e(X, Y), r(Y, Z).", "r(X, Z) :- r(X, Y), r(Y, Z)."])
def test_closure(spark, rule):
    e = chain(spark, 12)
    e.install("r(X, Y) :- e(X, Y). " + rule)
    assert e.run()["r"] == 12 * 13 // 2
    assert e.last_iterations <= 5  # doubling
    assert e.run()["total"] == 0
    e.declare("e", "n12", "n13")
    assert e.run()["r"] == 13
    assert answers(e, "r(n0, n13)") == ["holds=True"] or answers(e, "r(n0, n13)") == [""]
    assert len(answers(e, "r(X, n13)")) == 13


def test_cyclic_mutual_and_triangles(spark):
    e = Engine(spark)
    for a, b in [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]:
        e.declare("arc", a, b)
    e.install("reach(A, B) :- arc(A, B). reach(A, C) :- reach(A, B), arc(B, C). tri(A, B, C) :- arc(A, B), arc(B, C), arc(C, A).")
    e.install("odd(A, B) :- arc(A, B). odd(A, C) :- even(A, B), arc(B, C). even(A, C) :- odd(A, B), arc(B, C).")
    e.run()
    assert e.facts("reach").count() == 12
    assert rows(e.facts("tri")) == {("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")}
    assert e.facts("odd").count() == e.facts("even").count() == 12


def test_negation_constants_repeats_and_arity_zero(spark):
    e = Engine(spark)
    for x, y in [("a", "a"), ("a", "b"), ("b", "c")]:
        e.declare("p", x, y)
    e.install("same(X) :- p(X, X). leaf(Y) :- p(_, Y), !p(Y, _). never(X) :- p(X, _), !p(a, a). always(X) :- p(X, _), !p(z, z). from(Y) :- p(a, Y). some() :- p(_, _). none() :- p(z, _).")
    e.run()
    assert rows(e.facts("same")) == {("a",)} and rows(e.facts("leaf")) == {("c",)} and rows(e.facts("from")) == {("a",), ("b",)}
    assert rows(e.facts("never")) == set() and rows(e.facts("always")) == {("a",), ("b",)}
    assert e.facts("some").count() == 1 and e.facts("none").count() == 0


def test_arithmetic_comparisons_and_clock(spark):
    e = Engine(spark, now=10)
    for n in (1, 2, 3, 9223372036854775807):
        e.declare("n", n)
    e.install("up(X, Y) :- n(X), Y = X + 1. back(X, Y) :- n(X), X = Y + 5. big(X) :- n(X), X >= 3. at(T) :- now(T). near(X) :- n(X), now(T), X < T - 7. ten() :- now(10). v(X) :- X = 4.")
    e.run()
    assert rows(e.facts("up")) == {(1, 2), (2, 3), (3, 4)}  # overflow derives nothing
    assert (1, -4) in rows(e.facts("back")) and rows(e.facts("at")) == {(10,)} and rows(e.facts("near")) == {(1,), (2,)}
    assert e.facts("ten").count() == 1 and rows(e.facts("v")) == {(4,)}
    e.set_now(9)
    e.run()
    assert rows(e.facts("near")) == {(1,)} and e.facts("ten").count() == 0


def test_mixed_kinds(spark):
    e = Engine(spark)
    for v in ("x", 5, "5"):
        e.declare("m", v)
    e.declare("k", 5)
    e.declare("s", "5")
    e.install("i(X) :- m(X), k(X). t(X) :- m(X), s(X). low(X) :- m(X), X < 6. other(X) :- m(X), X \\= 5. c(count(X)) :- m(X). g(max(X)) :- k(X).")
    e.run()
    assert rows(e.facts("i")) == {(5,)} and rows(e.facts("t")) == {("5",)} and rows(e.facts("c")) == {(3,)}
    assert answers(e, "low(X)") == ["X=5"] and answers(e, "other(X)") == ["X=5", "X=x"] and e.facts("low").count() == 1


def test_aggregates(spark):
    e = Engine(spark)
    for p, k, r in [("ann", "a", 3), ("ann", "b", 7), ("ann", "b", 3), ("bob", "a", 1)]:
        e.declare("bought", p, k, r)
    e.install("items(P, count(K)) :- bought(P, K, _). stats(P, count(K), max(R)) :- bought(P, K, R). total(P, sum(R)) :- bought(P, _, R). all(count(K), min(R)) :- bought(_, K, R).")
    e.install("many(P) :- items(P, N), N >= 2. empty(count(X)) :- bought(X, zzz, _).")
    e.run()
    assert rows(e.facts("items")) == {("ann", 2), ("bob", 1)}
    assert rows(e.facts("stats")) == {("ann", 3, 7), ("bob", 1, 1)}  # joint tuples
    assert rows(e.facts("total")) == {("ann", 10), ("bob", 1)} and rows(e.facts("all")) == {(4, 1)} and e.facts("empty").count() == 0
    e.declare("bought", "bob", "c", 1)
    e.run()
    assert rows(e.facts("many")) == {("ann",), ("bob",)}
    e.retract("bought", "bob", "c", 1)
    e.run()
    assert rows(e.facts("many")) == {("ann",)}


def test_annotations(spark):
    e = Engine(spark, "lineage")
    e.declare("p", "x", conf=0.5, prov=["ep1"])
    e.declare("p", "x", conf=0.9, prov=["ep2"])
    e.declare("q", "x", conf=0.9, prov=["ep3"])
    e.install("r(X) :- p(X), q(X). n(count(X)) :- p(X).")
    e.run()
    (r,) = e.facts("r").collect()
    assert abs(r["_conf"] - 0.81) < 1e-9 and r["_prov"] == ["ep1", "ep2", "ep3"]
    assert e.facts("n").first()["_conf"] == 1.0
    e.declare("p", "x", conf=1.0, prov=["ep4"])  # a better derivation of a known fact spreads
    e.run()
    (r,) = e.facts("r").collect()
    assert abs(r["_conf"] - 0.9) < 1e-9 and "ep4" in r["_prov"]


def test_best_path_on_a_cycle_and_own_carrier(spark):
    arcs = [("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.5), ("c", "a", 0.9)]
    e = Engine(spark, "conf")
    for a, b, c in arcs:
        e.declare("e", a, b, conf=c)
    e.install("r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z).")
    e.run()
    best = {(r["p0"], r["p1"]): r["_conf"] for r in e.facts("r").collect()}
    assert abs(best["a", "c"] - 0.81) < 1e-9 and abs(best["a", "a"] - 0.729) < 1e-9 and len(best) == 9
    d = Engine(spark, Depth())
    d.register("e", spark.createDataFrame([(a, b) for a, b, _ in arcs], "a string, b string"), _cost=F.lit(1))
    d.install("r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z).")
    d.run()
    assert {(r["p0"], r["p1"]): r["_cost"] for r in d.facts("r").collect()}["a", "a"] == 2


def test_retract_uninstall_and_feed(spark):
    e = chain(spark, 4)
    a = e.install("r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z).")
    b = e.install("end(X) :- e(_, X), !e(X, _).")
    e.run()
    at = e.epoch
    assert e.retract("e", "n1", "n2") and not e.retract("e", "n1", "n2") and not e.retract("r", "n0", "n1")
    e.run()
    assert rows(e.facts("r")) == {("n0", "n1"), ("n2", "n3"), ("n2", "n4"), ("n3", "n4")} and rows(e.facts("end")) == {("n1",), ("n4",)}
    feed = {(r["kind"], r["pred"], r["args"]) for r in e.changes_from(at).collect()}
    assert ("Retracted", "r", '["n0","n4"]') in feed and ("Added", "end", '["n1"]') in feed and ("Retracted", "e", '["n1","n2"]') in feed
    assert e.uninstall(b) and not e.uninstall(b)
    e.run()
    assert "end" not in e.derived and e.facts("r").count() == 4
    assert a == "b1" and e.install("x(X) :- e(X, _).") == "b3" and e.batch_conflicts("b3") == []
    c = e.install("x(Y) :- e(_, Y).")
    assert e.batch_conflicts(c) == ["x is also defined by b3"]


def test_growth_of_a_negated_relation(spark):
    e = Engine(spark)
    e.declare("p", "a")
    e.declare("p", "b")
    e.install("ok(X) :- p(X), !blocked(X). last(X) :- ok(X).")
    e.run()
    e.declare("blocked", "a")
    e.run()
    assert rows(e.facts("last")) == {("b",)}
    e.retract("blocked", "a")
    e.run()
    assert rows(e.facts("last")) == {("a",), ("b",)}


def test_base_facts_on_derived_predicate_and_backfill(spark):
    e = Engine(spark)
    e.declare("p", "a")
    e.declare("q", "z")
    e.run()
    e.install("q(X) :- p(X). r(X) :- q(X). s(k, 1). s(X, 2) :- q(X).")
    e.run()
    assert rows(e.facts("q")) == {("a",), ("z",)} == rows(e.facts("r")) and ("k", 1) in rows(e.facts("s"))
    e.declare("q", "y")
    e.run()
    assert rows(e.facts("r")) == {("a",), ("y",), ("z",)}


def test_demand_equals_full_and_derives_less(spark):
    src = "r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), r(Y, Z). lone(X) :- node(X), !r(X, _). big(X, count(Y)) :- r(X, Y). top(X, N) :- big(X, N), N > 3."
    full = Engine(spark)
    edges = [(f"c{c}_{i}", f"c{c}_{i + 1}") for c in range(10) for i in range(9)]
    full.register("e", spark.createDataFrame(edges, "a string, b string"))
    full.declare("node", "c0_9")
    lazy = full.fork()
    full.install(src)
    full.run()
    lazy.install(src)
    for goal in ["r(c3_4, X)", "r(X, c3_4)", "r(c1_0, c1_9)", "r(c1_0, c2_0)", "lone(c0_9)", "big(c1_0, N)", "top(c1_0, N)"]:
        assert rows(lazy.ask_deep(goal)) == rows(full.ask(goal)), goal
    lazy.ask_deep("r(c3_4, X)")
    assert lazy.last_demand_facts < 450 // 4 and "r" not in lazy.derived


def test_demand_only_rules(spark):
    e = Engine(spark, now=30)
    e.declare("edge", "a", "w", "x", 10, 9223372036854775807, 20)
    e.install("believed(E, R, O, T) :- edge(E, R, O, VF, VT, AT), AT =< T, VF =< T, T < VT. current(E, R, O) :- edge(E, R, O, VF, VT, _), now(T), VF =< T, T < VT.")
    e.run()
    assert "believed" not in e.derived and answers(e, "current(a, w, X)") == ["X=x"]
    assert answers(e, "believed(a, w, X, 25)", True) == ["X=x"] and answers(e, "believed(a, w, X, 15)", True) == []


def test_what_if_leaves_the_engine_alone(spark):
    e = chain(spark, 3)
    e.install("r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z).")
    e.run()
    assert rows(e.what_if([("e", "n3", "n9")], "r(n0, X)")) == {("n1",), ("n2",), ("n3",), ("n9",)}
    assert rows(e.what_if([], "r(n0, X)", [("e", "n1", "n2")])) == {("n1",)}
    assert e.facts("r").count() == 6 and e.facts("e").count() == 3


def test_rejections_change_nothing(spark):
    e = Engine(spark)
    e.declare("p", "a", 1)
    for bad in ["q(X) :- p(X).", "q(X) :- p(X, _), !q(X).", "q(X) :- p(X, _). q(X, Y) :- p(X, Y).", "ok(X) :- p(X, _). bad(X) :- Y < 3."]:
        with pytest.raises(RuleError):
            e.install(bad)
    assert not e.batches and e.check("q(X) :- p(X, _).") and not e.batches
    with pytest.raises(RuleError):
        e.declare("p", "a")
    with pytest.raises(RuleError):
        e.declare("p", "a", 1.5)
    with pytest.raises(RuleError):
        e.register("d", spark.createDataFrame([(1.5,)], "x double"))


def test_why(spark):
    e = Engine(spark, "lineage")
    for a, b in [("a", "b"), ("b", "c"), ("c", "a")]:
        e.declare("e", a, b, conf=0.9, prov=[f"ep_{a}"])
    e.install("r(X, Y) :- e(X, Y). trans: r(X, Z) :- r(X, Y), r(Y, Z). n(X, count(Y)) :- r(X, Y).")
    e.run()
    tree = why(e, "r", "a", "c")
    assert "via trans" in tree and "asserted (base fact)" in tree and "conf 0.810" in tree and "e(b, c)" in tree
    assert "[unknown fact]" in why(e, "r", "a", "zz") and "via agg:n" in why(e, "n", "a", 3)


def test_schema_summary(spark):
    e = chain(spark, 3)
    e.install("r(X, Y) :- e(X, Y).")
    e.run()
    assert e.schema_summary()[0].startswith("e/2: 3 rows") and len(e.schema_summary()) == 2


def test_hooks_of_a_carrier(spark):
    from tessera.operators.proofs import fact, supports
    from tessera.plans.semiring import Derivations, Doubt, MeanConfidence

    e = Engine(spark, Doubt())
    for p, x, c in [("pkg", "a", 0.8), ("pkg", "b", 1.0), ("pkg", "c", 1.0), ("bad", "a", 0.25), ("bad", "b", 1.0)]:
        e.declare(p, x, conf=c)
    e.install("safe(P) :- pkg(P), !bad(P). none(P) :- pkg(P), !bad(zz).")
    e.run()
    assert {r["p0"]: round(r["_conf"], 6) for r in e.facts("safe").collect()} == {"a": 0.6, "c": 1.0} and e.facts("none").count() == 3
    e = Engine(spark, Derivations())
    for x, y, c in [("s", "m", 0.9), ("m", "t", 1.0), ("s", "t", 0.5)]:
        e.declare("arc", x, y, conf=c)
    e.install("""r(X, Y) :- arc(X, Y). r(X, Z) :- arc(X, Y), r(Y, Z). two(X, Z) :- arc(X, Y), arc(Y, Z).
    n(X, count(Y)) :- arc(X, Y). t(X, sum(N)) :- amount(X, N).""")
    e.declare("amount", "s", 3, conf=0.5)
    e.declare("amount", "s", 4, conf=1.0)
    e.run()
    got = {(r["p0"], r["p1"]): (len(r["_ways"]), round(r["value"], 6)) for r in e.interpreted("r", MeanConfidence()).collect()}
    assert got == {("s", "m"): (1, 0.9), ("m", "t"): (1, 1.0), ("s", "t"): (2, 0.7)}
    assert len(e.facts("two").first()["_ways"]) == 1  # one derivation, in whatever order its body fires
    assert e.query("n", "s", 2).first()["_conf"] == 0.5 and e.query("t", "s", 7).first()["_conf"] == 0.75
    e = Engine(spark)
    for i in range(7):
        e.declare("q", "x", i)
    e.install("p(X) :- q(X, _). also: p(X) :- q(X, N), N < 2.")
    e.run()
    rows = supports(e, "p").collect()
    assert sorted((r["label"], len(r["body"])) for r in rows) == [("also", 1)] * 2 + [("rule/p", 1)] * 4
    found = fact(e, "p", "x")
    assert not found["base"] and len(found["supports"]) == 6 and fact(e, "p", "y") is None and fact(e, "q", "x", 3)["base"]


def test_a_founded_proof_is_found_beyond_the_first_supports(spark):
    e = Engine(spark)
    for i in range(40):
        e.declare("e", f"a{i:02d}", f"a{(i + 1) % 40:02d}")
        e.declare("e", f"a{i:02d}", "hub")
        e.declare("e", "hub", f"a{i:02d}")
    e.declare("start", "zz")
    e.declare("e", "zz", "hub")
    e.install("on(X) :- start(X). on(Y) :- on(X), e(X, Y).")
    e.run()
    tree = why(e, "on", "hub")
    assert "on(zz)" in tree and "cycle" not in tree and tree.count("asserted") == 2


@pytest.mark.parametrize("rules", ["r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z).", "r(X, Y) :- e(X, Y). r(X, Z) :- e(X, Y), r(Y, Z)."])
def test_closure_by_powers_goes_on_from_many_new_facts(spark, monkeypatch, rules):
    from tessera.operators import engine

    monkeypatch.setattr(engine, "BROADCAST_FACTS", 0)  # so that any change counts as many
    arcs = [(i, i * 7 % 23) for i in range(23)] + [(i, i + 1) for i in range(23, 40)] + [(40, 3)]
    e = Engine(spark)
    e.register("e", spark.createDataFrame(arcs[::2], "a long, b long"))
    e.install(rules)
    e.run()
    e.register("e", spark.createDataFrame(arcs[1::2], "a long, b long"))
    e.run()
    want = set(arcs)
    while more := {(x, z) for x, y in want for u, z in arcs if u == y} - want:
        want |= more
    got = [(r["p0"], r["p1"]) for r in e.facts("r").collect()]
    assert sorted(got) == sorted(want)


def test_closure_of_a_tree_makes_each_path_once(spark, monkeypatch):
    from tessera.operators import engine

    made = []
    monkeypatch.setattr(engine, "merged", lambda df, n, s, merged=engine.merged: made.append(df.count()) or merged(df, n, s))
    e = Engine(spark)
    e.register("e", spark.range(1, 2000).selectExpr("id", "id div 2"))
    e.install("r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z).")
    e.run()
    paths = e.relation("r").count()
    assert sum(made) < 3 * paths  # the paths and the powers of e
