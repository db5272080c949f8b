"""`python -m tessera COMMAND --name value ...`: a result a line, as JSON, with the table it belongs to. `--flag` alone is true."""

from __future__ import annotations

import inspect
import json
import sys

from pyspark.sql import SparkSession

from .commands import COMMANDS
from .sinks.svg import report


def arguments(f, words: list[str]) -> dict:
    """Values by name, as the types that the command's parameters have."""
    kinds = {n: str(p.annotation) for n, p in inspect.signature(f).parameters.items()}
    out, at = {}, 0
    while at < len(words):
        name = words[at].removeprefix("--").replace("-", "_")
        if not words[at].startswith("--") or name not in kinds or name in ("spark", "o"):
            raise SystemExit(f"no argument {words[at]!r}; there are: {' '.join('--' + n for n in kinds if n not in ('spark', 'o'))}")
        if kinds[name].startswith("bool"):
            out[name], at = True, at + 1
        elif at + 1 == len(words):
            raise SystemExit(f"{words[at]} needs a value")
        else:
            text = words[at + 1]
            out[name], at = int(text) if kinds[name].startswith("int") else float(text) if kinds[name].startswith("float") else text, at + 2
    return out


def main(words: list[str]) -> int:
    if not words or words[0] not in COMMANDS:
        print("commands:", *sorted(COMMANDS), file=sys.stderr)
        return 2
    f = COMMANDS[words[0]]
    given = arguments(f, words[1:])
    spark = SparkSession.builder.appName(f"tessera {words[0]}").getOrCreate()
    try:
        for name, df in f(spark, **given).items():
            for row in report(df):
                print(json.dumps({"table": name})[:-1] + ', "row": ' + row + "}")
    except (TypeError, ValueError) as e:
        print(f"{words[0]}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
