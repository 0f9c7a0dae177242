"""An interactive shell: statements end with a semicolon."""

from __future__ import annotations

import os
import sys

from .engine import Engine
from .errors import EngineError
from .plans.lexer import tokens

KEYWORDS = "SELECT FROM WHERE GROUP BY ORDER HAVING LIMIT OFFSET JOIN LEFT RIGHT FULL INNER CROSS ON USING UNION ALL DISTINCT EXCEPT INTERSECT WITH RECURSIVE UNNEST QUALIFY WINDOW INSERT INTO VALUES UPDATE SET DELETE MERGE CREATE REPLACE TABLE VIEW SCHEMA FUNCTION DROP ALTER TRUNCATE DECLARE BEGIN END IF WHILE LOOP FOR CASE WHEN THEN ELSE AND OR NOT IN BETWEEN LIKE IS NULL TRUE FALSE CAST SAFE_CAST COUNT SUM AVG MIN MAX".split()
HELP = "help: this text; clear: clears the screen; reset: drops all data; exit or quit: leaves.  Anything else is GoogleSQL, ended by a semicolon."


class Repl:
    def __init__(self, engine: Engine, out=sys.stdout):
        self.engine, self.out, self.buffer = engine, out, ""

    def words(self) -> list[str]:
        """Completions: keywords and names of datasets and tables."""
        c, names = self.engine.catalog, []
        for p in c.projects():
            for d in c.datasets(p):
                names += [p, d, f"{p}.{d}"] + [n for t in c.tables(p, d) for n in (t, f"{d}.{t}", f"{p}.{d}.{t}")]
        return sorted({*KEYWORDS, *names})

    def complete(self, text: str, state: int) -> str | None:
        hits = [w for w in self.words() if w.lower().startswith(text.lower())]
        return hits[state] if state < len(hits) else None

    def feed(self, line: str) -> bool:
        """Takes a line; False ends the shell."""
        word = line.strip().lower().rstrip(";")
        if not self.buffer and word in ("exit", "quit"):
            return False
        if not self.buffer and word == "help":
            print(HELP, file=self.out)
        elif not self.buffer and word == "clear":
            print("\033[2J\033[H", end="", file=self.out)
        elif not self.buffer and word == "reset":
            self.engine.catalog.reset()
            print("All data dropped.", file=self.out)
        else:
            self.buffer += line + "\n"
            if self._whole():
                text, self.buffer = self.buffer, ""
                self.run(text)
        return True

    def _whole(self) -> bool:
        try:
            ts = tokens(self.buffer)
        except EngineError:
            return self.buffer.rstrip().endswith(";")
        return not ts or ts[-1].text == ";"

    def run(self, text: str) -> None:
        if not text.strip(" ;\n"):
            return
        try:
            r = self.engine.query(text)
            if r.df is None:
                print(f"{r.statement} done" + (f", {r.affected} rows" if r.affected is not None else ""), file=self.out)
            else:
                print(r.df._show_string(50, False), file=self.out)
        except EngineError as e:
            print(f"Error: {e}", file=self.out)
        except Exception as e:  # shown, so that the shell goes on
            print(f"Error: {type(e).__name__}: {str(e).splitlines()[0]}", file=self.out)


def main() -> None:
    from .session import create_session

    repl = Repl(Engine(create_session()))
    history = os.path.expanduser("~/.sparkloom_history")
    try:
        import readline

        readline.set_completer(repl.complete)
        readline.parse_and_bind("tab: complete")
        if os.path.exists(history):
            readline.read_history_file(history)
    except ImportError:
        readline = None
    go = True
    while go:
        try:
            go = repl.feed(input("... " if repl.buffer else "> "))
        except KeyboardInterrupt:
            repl.buffer = ""
            print()
        except EOFError:
            break
    if readline:
        readline.write_history_file(history)


if __name__ == "__main__":
    main()
