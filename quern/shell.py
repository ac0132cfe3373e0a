"""A line-oriented shell: one statement or dot-command a line."""

from __future__ import annotations

import sys
from typing import TextIO

from quern.errors import EngineError
from quern.session import Engine, Session


class Shell:
    def __init__(self, session: Session, out: TextIO = sys.stdout):
        self.session, self.out = session, out

    def line(self, line: str) -> bool:
        """Run one line; False ends the shell."""
        line = line.strip()
        if not line or line.startswith("--"):
            return True
        if line.startswith("."):
            return self.command(line)
        try:
            result = self.session.execute(line)
            if self.session.explain and result.planned:
                result.planned.frame.explain("formatted")
            print(result.text(), file=self.out)
        except EngineError as error:
            print(error.line, file=self.out)
        return True

    def command(self, line: str) -> bool:
        name, _, rest = line.partition(" ")
        session = self.session
        listings = {".tables": session.tables, ".indexes": session.indexes, ".databases": session.databases, ".pool": session.pool}
        try:
            if line in (".exit", ".quit"):
                return False
            if line in listings:
                print(listings[line](), file=self.out)
            elif line in (".explain on", ".explain off"):
                session.explain = line.endswith("on")
            elif name == ".save" and rest:
                session.save(rest)
                print(f"saved to {rest}", file=self.out)
            elif name == ".load" and rest:
                session.load(rest)
                print(f"loaded {rest}", file=self.out)
            else:
                print(f"unrecognised command: {line}", file=self.out)
        except EngineError as error:
            print(error.line, file=self.out)
        return True

    def run(self, lines) -> None:
        for line in lines:
            if not self.line(line):
                break
        self.session.close()


def main(arguments: list[str]) -> None:
    """`python -m quern.shell [folder]`: a database in the folder, or in memory."""
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quern").getOrCreate()
    folder = arguments[0] if arguments and arguments[0] != ":memory:" else None
    engine = Engine(spark, folder)
    if folder is None:
        print("in-memory only, nothing will be saved")
    Shell(engine.session()).run(sys.stdin)


if __name__ == "__main__":
    main(sys.argv[1:])
