"""python -m lodeframe [WAREHOUSE]: statements from standard input, results as text rows or tables."""

from __future__ import annotations

import sys
import time


HELP = """Statements end with a semicolon and may run over several lines.
help      this text
\\timing   show how long statements take
\\aligned  results as aligned tables or as rows with pipes
exit      leave; Ctrl-C stops the running statement"""


class Repl:
    """Lines in, text out; a statement runs when its semicolon stands outside strings and comments."""

    def __init__(self, session, out=print, aligned: bool = False):
        self.session, self.out, self.held, self.timing, self.aligned = session, out, "", False, aligned

    def feed(self, line: str) -> bool:
        """Take a line; False when it asks to leave."""
        from .plans.lexer import complete

        word = line.strip().lower()
        if not self.held.strip():
            if word in ("exit", "quit", "\\q"):
                return False
            if word in ("help", "\\?"):
                self.out(HELP)
                return True
            if word in ("\\timing", "\\aligned"):
                setattr(self, word[1:], not getattr(self, word[1:]))
                return True
        self.held += line if line.endswith("\n") else line + "\n"
        # an open string isn't complete, and text that can't be read is run for its error
        if line.rstrip().endswith(";") and (complete(self.held) or not _open(self.held)):
            self.run()
        return True

    def run(self) -> None:
        from .errors import EngineError
        from .plans.lexer import statements

        text, self.held, start = self.held, "", time.perf_counter()
        try:
            for s in statements(text):
                for row in self.session.text_rows(s, aligned=self.aligned):
                    self.out(row)
        except KeyboardInterrupt:
            self.session.spark.sparkContext.cancelAllJobs()
            self.out("cancelled")
        except (EngineError, ValueError) as e:
            self.out(f"ERROR: {e}")
        if self.timing and text.strip():
            self.out(f"{(time.perf_counter() - start) * 1000:.1f} ms")


def _open(text: str) -> bool:
    """Whether a string or comment is still open."""
    from .errors import ParseError
    from .plans.lexer import tokens

    try:
        found = tokens(text)
    except ParseError as e:
        return e.near in ("'", '"', "`", "/")
    return found[-2].text != ";" if len(found) > 1 else False


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    from . import Engine

    spark = SparkSession.builder.appName("lodeframe").getOrCreate()
    repl = Repl(Engine(spark, args[0] if args else None).session(), aligned=sys.stdin.isatty())
    for line in sys.stdin:
        if not repl.feed(line):
            return 0
    # text without a last semicolon is run too
    if repl.held.strip():
        repl.run()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
