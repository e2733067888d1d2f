"""Command line: ``python -m docsieve.cli 'QUERY' [FILE]``; ``-i`` for an interactive session."""

from __future__ import annotations

import argparse
import sys
import time

from . import api
from .complete import COMMANDS
from .errors import QueryError
from .functions.values import schema_of
from .plans.grammar import parse
from .sources import formats, writers


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docsieve", description="Query JSON, YAML, TOML, HCL, XML, CSV, TSV and Markdown.")
    p.add_argument("query", nargs="?")
    p.add_argument("file", nargs="?")
    p.add_argument("-p", "--pretty", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("-r", "--raw", action="store_true", help="print a string without quotes")
    p.add_argument("-f", "--format", choices=formats.FORMATS)
    p.add_argument("-t", "--to", choices=writers.OUTPUTS, default="json")
    p.add_argument("--schema", action="store_true")
    p.add_argument("--assert", dest="check", action="store_true", help="exit with 1 unless the result is true")
    p.add_argument("-i", "--interactive", action="store_true")
    return p


def load(path: str | None, fmt: str | None):
    text = open(path, encoding="utf-8").read() if path else sys.stdin.read()
    return formats.parse(text, fmt or (formats.detect(path) if path else None) or formats.sniff(text))


def main(argv: list[str] | None = None) -> int:
    p = arguments()
    args = p.parse_args(argv)
    try:
        if args.interactive:
            return session(load(args.file or args.query, args.format), args)
        if args.schema and args.file is None and args.query:
            args.file, args.query = args.query, None
        if args.query is None and not args.schema:
            p.print_usage(sys.stderr)
            return 2
        data = load(args.file, args.format)
        if args.schema:
            print(writers.to_json(schema_of(data), args.pretty))
            return 0
        out = api.query(args.query, data)
        if args.check:
            if not isinstance(out, bool):
                print("assertion: expected a boolean", file=sys.stderr)
            return 0 if out is True else 1
        print(out if args.raw and isinstance(out, str) else writers.write(out, args.to, args.pretty).rstrip("\n"))
        return 0
    except (QueryError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def unfinished(line: str) -> bool:
    """Whether a query only lacks closing signs, so that the next line belongs to it."""
    if line.startswith(":"):
        return False
    try:
        return not parse(line, lenient=True).complete
    except QueryError:
        return False


def session(data, args, read=input, show=print) -> int:
    """Reads queries and commands until the end of input."""
    to, raw, pretty, history = args.to, args.raw, args.pretty, []
    while True:
        try:
            line = read("> ").strip()
            while unfinished(line):
                line = f"{line} {read('. ')}".strip()
        except EOFError:
            return 0
        if not line:
            continue
        history = [*history, line][-500:]
        word, _, rest = line.partition(" ")
        try:
            if word in (":q", ":quit"):
                return 0
            if word in (":h", ":help"):
                show(" ".join(f":{c}" for c in COMMANDS))
            elif word == ":schema":
                show(writers.to_json(schema_of(data)))
            elif word == ":to":
                if rest not in writers.OUTPUTS:
                    raise QueryError(f"unknown output format {rest}")
                to = rest
            elif word == ":raw":
                raw = not raw
            elif word == ":pretty":
                pretty = not pretty
            elif word == ":history":
                show("\n".join(history))
            elif word == ":load":
                data = load(rest, None)
            elif word.startswith(":"):
                raise QueryError(f"unknown command {word}")
            else:
                began = time.monotonic()
                out = api.query(line, data)
                cut = len(out) - 10 if isinstance(out, list) and len(out) > 10 and to == "json" else 0
                show(out if raw and isinstance(out, str) else writers.write(out[:10] if cut else out, to, pretty).rstrip("\n"))
                if cut:
                    show(f"... {cut} more")
                if (ms := round(1000 * (time.monotonic() - began))) >= 100:
                    show(f"[{ms}ms]")
        except (QueryError, OSError) as e:
            show(f"error: {e}")


if __name__ == "__main__":
    sys.exit(main())
