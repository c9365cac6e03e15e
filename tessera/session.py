"""A line-by-line session with an engine."""

from __future__ import annotations

from tessera.operators.engine import OPEN_END, Engine
from tessera.operators.proofs import why
from tessera.plans.rules import RuleError, parse_fact

HELP = """rule <clause>            install a rule or fact
+ <fact> [@conf] [#prov] assert a base fact (MAX is the open end of an interval)
? <goal>                 ask what is materialized
?? <goal>                ask by demand
why <fact>               proof tree
run                      bring derived facts up to date
now <t>                  set the clock
dump [pred]              list facts
batches, rm <id>         installed programs
"""


class Session:
    def __init__(self, spark, mode: str = "lineage") -> None:
        self.engine = Engine(spark, mode)

    def execute(self, line: str) -> str:
        """The output of one command; errors come back as text."""
        line = line.strip()
        if not line or line.startswith("#"):
            return ""
        command, _, rest = line.partition(" ")
        action = getattr(self, {"+": "do_add", "?": "do_ask", "??": "do_ask_deep"}.get(command, f"do_{command}"), None)
        if action is None:
            return f"error: unknown command {command!r}, try help\n"
        try:
            return action(rest.strip())
        except (RuleError, ValueError) as e:
            return f"error: {e}\n"

    def do_help(self, _: str) -> str:
        return HELP

    def do_rule(self, rest: str) -> str:
        return f"installed batch {self.engine.install(rest if rest.endswith('.') else rest + '.')}\n"

    def do_add(self, rest: str) -> str:
        conf, prov, core = 1.0, [], []
        for part in rest.split():
            if part.startswith("@"):
                conf = float(part[1:])
            elif part.startswith("#"):
                prov.append(part[1:])
            else:
                core.append(part)
        pred, args = parse_fact(" ".join(core))
        args = tuple(OPEN_END if a == "MAX" else a for a in args)
        self.engine.declare(pred, *args, conf=conf, prov=prov)
        return f"{pred} {len(args)}\n"

    def _answers(self, rest: str, deep: bool) -> str:
        found = self.engine.ask_text(rest, deep)
        if not found:
            return "no\n"
        return "yes\n" if found == [""] or found == ["holds=True"] else "".join(f"{x}\n" for x in found)

    def do_ask(self, rest: str) -> str:
        return self._answers(rest, False)

    def do_ask_deep(self, rest: str) -> str:
        return self._answers(rest, True)

    def do_why(self, rest: str) -> str:
        pred, args = parse_fact(rest)
        return why(self.engine, pred, *args)

    def do_run(self, _: str) -> str:
        return f"+{self.engine.run()['total']} facts (epoch {self.engine.epoch})\n"

    def do_now(self, rest: str) -> str:
        self.engine.set_now(int(rest))
        return f"now = {int(rest)}\n"

    def do_dump(self, rest: str) -> str:
        self.engine.flush()
        preds = [rest] if rest else sorted(self.engine.types())
        lines = []
        for p in preds:
            df = self.engine.facts(p)
            lines += [self.engine.render(p, r) for r in df.orderBy(*[c for c in df.columns if c[0] == "p"]).limit(1000).collect()]
        return "".join(f"{x}\n" for x in lines)

    def do_batches(self, _: str) -> str:
        return "".join(f"{b.id}: {b.source}\n" for b in self.engine.batches)

    def do_rm(self, rest: str) -> str:
        return f"uninstalled {rest} (run to recompute)\n" if self.engine.uninstall(rest) else f"error: no batch {rest!r}\n"

    def do_esc(self, _: str) -> str:
        return "(escalations are kept by a memory, not by an engine)\n"
