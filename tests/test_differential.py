"""Random stratified programs: the engine against a naive fixpoint in plain Python, from scratch and step by step."""

import random

import pytest

from tessera.operators.engine import Engine

DOMAIN = ["a", "b", "c"]


def program(rng, tag):
    """Rules over e0, e1 (given) and p0, p1 (derived), all binary; negation only of given facts."""
    rules = []
    for p in ("p0", "p1"):
        for _ in range(rng.randint(1, 2)):
            body = []
            for _ in range(rng.randint(1, 2)):
                body.append((rng.choice(["e0", "e1", "p0", "p1"]), [rng.choice(["X", "Y", "Z", "a", "b"]) for _ in range(2)], True))
            bound = sorted({v for _, args, _ in body for v in args if v.isupper()})
            if rng.random() < 0.4 and bound:
                body.append((rng.choice(["e0", "e1"]), [rng.choice([*bound, "c"]) for _ in range(2)], False))
            head = [rng.choice([*bound, "a"]) for _ in range(2)]
            rules.append((p, head, body))
    shown = " ".join(f"{tag}{p}({', '.join(h)}) :- {', '.join(('' if pos else '!') + f'{tag}{q}({chr(44).join(a)})' for q, a, pos in b)}." for p, h, b in rules)
    return rules, shown


def naive(rules, facts):
    known = {(p, *t) for p, ts in facts.items() for t in ts}
    while True:
        new = set()
        for p, head, body in rules:
            envs = [{}]
            for q, args, pos in body:
                if pos:
                    out = []
                    for env in envs:
                        for f in known:
                            if f[0] == q:
                                e2 = dict(env)
                                if all((e2.setdefault(a, v) if a.isupper() else a) == v for a, v in zip(args, f[1:], strict=True)):
                                    out.append(e2)
                    envs = out
            for env in envs:
                if all((q, *[env.get(a, a) for a in args]) not in known for q, args, pos in body if not pos):
                    new.add((p, *[env.get(a, a) for a in head]))
        if new <= known:
            return known
        known |= new


@pytest.mark.parametrize("mode", ["facts", "lineage"])
def test_random_programs(spark, mode):
    rng = random.Random(5)
    made, engine = [], Engine(spark, mode)
    for i in range(5):
        rules, shown = program(rng, f"t{i}")
        facts = {q: {(rng.choice(DOMAIN), rng.choice(DOMAIN)) for _ in range(4)} for q in ("e0", "e1")}
        made.append((rules, facts))
        for q, ts in facts.items():
            for t in sorted(ts):
                engine.declare(f"t{i}{q}", *t)
        engine.install(shown)
    engine.run()

    def check():
        for i, (rules, facts) in enumerate(made):
            want = naive(rules, facts)
            for p in ("p0", "p1"):
                got = {(r["p0"], r["p1"]) for r in engine.facts(f"t{i}{p}").collect()}
                assert got == {f[1:] for f in want if f[0] == p}, (i, p)

    check()
    for i, (_, facts) in enumerate(made):  # one fact more and one less in each
        more = (rng.choice(DOMAIN), rng.choice(DOMAIN))
        facts["e0"].add(more)
        engine.declare(f"t{i}e0", *more)
    engine.run()
    check()
    for i, (_, facts) in enumerate(made):
        gone = sorted(facts["e1"])[0]
        facts["e1"].discard(gone)
        assert engine.retract(f"t{i}e1", *gone)
    engine.run()
    check()
