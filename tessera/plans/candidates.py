"""Rules that a model has written, and the asking for them."""

from __future__ import annotations

from collections.abc import Callable

from tessera.operators.engine import Engine
from tessera.plans.program import components
from tessera.plans.rules import Agg, Clause, RuleError, Var, parse_program

PROMPT = (
    "Write rules of this language, one clause a line and nothing else: name: head(X, Y) :- body(X, Z), other(Z, Y), !absent(X), X < Y. "
    "Variables start with a capital letter; every variable of a head stands in a positive atom of its body."
)


def parse_rule_candidates(text: str) -> list[Clause]:
    """The clauses of a model's answer, one for each line; code fences, blank lines and comments are passed over.

    Stricter than installing: every line is one whole clause, the variables of each head stand in positive atoms, and together the
    clauses stratify. Raises RuleError that names the first line at fault, also where there is no rule at all."""
    out: list[Clause] = []
    for line in (x.strip().strip("`").strip() for x in text.splitlines()):
        if not line or line[0] in "#%" or line.isalpha():  # a fence may name a language
            continue
        try:
            clauses = parse_program(line if line.endswith(".") else f"{line}.")
        except RuleError as e:
            raise RuleError(f"{line!r}: {e}") from e
        if len(clauses) != 1:
            raise RuleError(f"{line!r}: a line holds one clause, not {len(clauses)}")
        (clause,) = clauses
        held = {v for a in clause.positives() for v in a.variables()}
        terms = [a.term if isinstance(a, Agg) else a for a in clause.head.args]
        free = sorted({t.name for t in terms if isinstance(t, Var)} - held)
        if free and not clause.is_fact:
            raise RuleError(f"{line!r}: no positive atom has {', '.join(free)}")
        out.append(clause)
    if not out:
        raise RuleError("no rules in the answer")
    components(out)
    return out


def synthesize_rules(engine: Engine, request: str, model: Callable[[str, str], str], install: bool = False) -> str:
    """Asks a model (from a prompt and a text to its answer) for rules over the engine's relations; they are validated, and installed if
    wanted: returns the program, or the batch's id."""
    rules = "\n".join(map(str, engine.rules())) or "(none)"
    answer = model(PROMPT, "\n".join(["Relations:", *engine.schema_summary(), "", "Rules so far:", rules, "", f"Request: {request}"]))
    program = "\n".join(str(c) if str(c).endswith(".") else f"{c}." for c in parse_rule_candidates(answer))
    engine.check(program)
    return engine.install(program) if install else program
