"""The tools that an agent calls on a memory: each takes a dict of arguments and gives {text, is_error}."""

from __future__ import annotations

import difflib
from itertools import islice

from tessera.operators import packs
from tessera.operators.memory import Memory
from tessera.operators.proofs import why
from tessera.plans.rules import RuleError, parse_fact
from tessera.sources import snapshot

LEAST_BUDGET, BUDGET, DUMP, SHOWN = 50, 1000, 200, 50
MUTATING = {"observe", "retract", "install_rules", "uninstall", "canonicalize", "run"}


class Tools:
    """``path``: where changing tools save the memory after each call; None keeps it in the session only."""

    def __init__(self, memory: Memory, path: str | None = None) -> None:
        self.memory, self.path = memory, path
        self.names = sorted(n[5:] for n in dir(self) if n.startswith("tool_"))

    def call(self, name: str, args: dict | None = None) -> dict:
        if name not in self.names:
            near = difflib.get_close_matches(name, self.names, 3, 0.4)
            return {"text": f"unknown tool {name!r}" + (f", did you mean {', '.join(near)}?" if near else f"; there are {', '.join(self.names)}"), "is_error": True}
        try:
            text = getattr(self, f"tool_{name}")(**(args or {}))
        except (RuleError, ValueError, TypeError, KeyError) as e:
            return {"text": f"{name}: {e}", "is_error": True}
        if self.path and name in MUTATING:
            snapshot.save(self.memory, self.path)
        return {"text": text, "is_error": False}

    def tool_observe(self, text: str, ts: int | None = None, speaker: str | None = None) -> str:
        report = self.memory.observe([(text, self.memory.engine.now if ts is None else ts, speaker)])
        self.memory.maintain()
        lines = [f"added {report['added']}, updated {report['updated']}, merged {report['noop']}", *islice(report["escalations"], SHOWN)]
        lines += [f"dropped {r['line']!r}: {r['reason']}" for r in self.memory.dropped.orderBy("line_no").limit(50).collect()]
        return "\n".join(lines)

    def tool_retract(self, text: str) -> str:
        r = self.memory.retract(text)
        return "\n".join([*[f"retracted {x}" for x in r["done"]], *[f"not found {x}" for x in r["missing"]], *[f"no longer derived {x}" for x in r["died"]]]) or "nothing to retract"

    def _answer(self, goal: str, deep: bool) -> str:
        lines = self.memory.engine.ask_text(goal, deep)
        if lines:
            return "\n".join("yes" if x in ("", "holds=True") else x for x in lines)
        pred = goal.split("(")[0].strip()
        known = sorted(self.memory.engine.types())
        near = difflib.get_close_matches(pred, known, 3, 0.4)
        return "no answers" + ("" if pred in known else f"; no relation {pred}" + (f", did you mean {', '.join(near)}?" if near else ""))

    def tool_query(self, goal: str) -> str:
        return self._answer(goal, False)

    def tool_query_deep(self, goal: str) -> str:
        self.memory.maintain()
        return self._answer(goal, True)

    def tool_why(self, fact: str) -> str:
        pred, args = parse_fact(fact)
        return why(self.memory.engine, pred, *args)

    def tool_install_rules(self, rules: str) -> str:
        batch = self.memory.engine.install(rules)
        new = self.memory.maintain()["total"]
        return "\n".join([f"installed {batch}, {new} new facts", *self.memory.engine.batch_conflicts(batch)])

    def tool_uninstall(self, batch: str) -> str:
        if not self.memory.engine.uninstall(batch):
            raise RuleError(f"no batch {batch}")
        self.memory.maintain()
        return f"uninstalled {batch}"

    def tool_batches(self) -> str:
        return "\n".join(f"{b.id}: {b.source.strip()}" for b in self.memory.engine.batches)

    def tool_what_if(self, text: str, goal: str) -> str:
        df = self.memory.what_if(text, goal)
        marks = set(self.memory.engine.semiring.columns)
        names = [c for c in df.columns if c not in marks]
        return "\n".join(sorted(", ".join(f"{n}={r[n]}" for n in names) for r in df.collect())) or "no answers"

    def tool_canonicalize(self, local: str, canonical: str, confidence: float = 0.9) -> str:
        engine = self.memory.engine
        if not any("maps_to(" in b.source for b in engine.batches):
            packs.install_canonical(engine, [("current", 3)])
        packs.assert_alias(engine, local, canonical, confidence)
        self.memory.maintain()
        bad = engine.ask_text("alias_conflict(X)")
        return "\n".join([f"{local} is {canonical}", *[f"conflict {x}" for x in bad]])

    def tool_context(self, query: str, budget: int = BUDGET) -> str:
        return self.memory.context_for_query_rich(query, max(budget, LEAST_BUDGET))

    def tool_dump(self, pred: str | None = None) -> str:
        engine = self.memory.engine
        if pred is None:
            return "\n".join(engine.schema_summary())
        return "\n".join(engine.render(pred, r) for r in engine.facts(pred).limit(DUMP).collect())

    def tool_changes(self, epoch: int = 0) -> str:
        rows = self.memory.engine.changes_from(epoch).orderBy("epoch", "kind", "pred", "args").limit(DUMP).collect()
        return "\n".join(f"{r['epoch']} {r['kind']} {r['pred']}{r['args']}" for r in rows)

    def tool_save(self, path: str | None = None) -> str:
        target = path or self.path
        if not target:
            raise ValueError("no path to save to")
        snapshot.save(self.memory, target)
        return f"saved to {target}"

    def tool_run(self, now: int | None = None) -> str:
        return f"{self.memory.maintain(now)['total']} new facts, epoch {self.memory.engine.epoch}"
