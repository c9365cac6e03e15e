"""A command line on a stored memory: ``python -m tessera.cli [--store PATH] COMMAND [--flag VALUE ...]``.

Commands are the agent tools by name; an argument is a flag of its own name, or stands on standard input if it is the tool's first one
and no flag gives it. The memory is the last version below PATH (or $TESSERA_STORE), a new one if there is none; tools that change it save
a new version. Exit code 1: the tool reports an error; 2: no such command.
"""

from __future__ import annotations

import inspect
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from tessera.operators.memory import Memory
from tessera.sources import snapshot
from tessera.tools import Tools

STORE = "TESSERA_STORE"


def flags(args: list[str]) -> dict[str, str]:
    """``--name value`` and ``--name=value``."""
    out, waiting = {}, list(args)
    while waiting:
        name, eq, value = waiting.pop(0).removeprefix("--").partition("=")
        out[name.replace("-", "_")] = value if eq else waiting.pop(0) if waiting and not waiting[0].startswith("--") else ""
    return out


def run(spark: SparkSession, args: list[str], read: Callable[[], str] = sys.stdin.read, write: Callable[[str], object] = print) -> int:
    given = flags([a for i, a in enumerate(args) if a.startswith("--") or (i and args[i - 1].startswith("--") and "=" not in args[i - 1])])
    words = [a for i, a in enumerate(args) if not a.startswith("--") and not (i and args[i - 1].startswith("--") and "=" not in args[i - 1])]
    path = given.pop("store", None) or os.environ.get(STORE)
    tools = Tools(snapshot.load(spark, path) if path and snapshot.versions(spark, path) else Memory(spark), path)
    if len(words) != 1 or words[0] not in tools.names:
        write(f"usage: [--store PATH] {' | '.join(tools.names)} [--argument VALUE ...]")
        return 2
    wanted = inspect.signature(getattr(tools, f"tool_{words[0]}")).parameters
    call: dict = {k: int(v) if v.lstrip("-").isdigit() and "int" in str(wanted[k].annotation) else v for k, v in given.items() if k in wanted}
    call |= {k: v for k, v in given.items() if k not in wanted}  # the tool says what it doesn't know
    first = next(iter(wanted.values()), None)
    if first is not None and first.default is inspect.Parameter.empty and first.name not in call:
        call[first.name] = read().strip()
    done = tools.call(words[0], call)
    write(done["text"])
    return int(done["is_error"])


def main() -> None:
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
