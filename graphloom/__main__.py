"""A console: python -m graphloom STORE [QUERY-FILE ...]; without files, statements from standard input.

Statements end with an empty line: select ..., explain select ..., insert data {...},
delete data {...}, commit, rollback, help, exit.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator


def statements(lines: Iterable[str]) -> Iterator[str]:
    held: list[str] = []
    for line in lines:
        if line.strip():
            held.append(line)
        elif held:
            yield "".join(held)
            held = []
    if held:
        yield "".join(held)


def run(engine, text: str, out=sys.stdout) -> bool:
    """Run one statement; whether to go on."""
    word = text.strip().rstrip(";").lower()
    if word == "exit":
        return False
    if word == "help":
        print(__doc__, file=out)
        return True
    try:
        result = engine.execute(text.strip().rstrip(";"), "terms")
    except ValueError as e:
        print(f"error: {e}", file=out)
        return True
    if isinstance(result, str):
        print(result, file=out)
    elif result is None:
        print("ok", file=out)
    else:
        print("\t".join(result.columns), file=out)
        for row in result.toLocalIterator():
            print("\t".join(map(str, row)), file=out)
    return True


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    from .engine import Engine
    from .sources.triples import TripleStore

    if not args:
        print(__doc__)
        return 2
    engine = Engine(TripleStore(SparkSession.builder.getOrCreate(), args[0]))
    for text in [open(f).read() for f in args[1:]] or statements(sys.stdin):  # noqa: SIM115
        if not run(engine, text):
            break
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
