"""The command line: ``python -m tarnflow COMMAND ARGS [then COMMAND ARGS]...``

All commands of a line run as one Spark job. A line that does not begin with a source
reads JSON lines from standard input, one that does not end with a sink writes them to
standard output. ``generate`` as the last command prints the line as a Python program
instead of running it.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from .. import __version__
from ..functions import functions
from ..functions.access import guess_literal
from ..operators import grouping, joining, rows
from ..operators.rows import Clause
from ..sources import charts, readers, writers
from .flow import Flow


class UsageError(ValueError):
    pass


@dataclass
class Args:
    """Positional arguments, and for each clause (parted by ``+``) its flags with their values."""

    words: list[str] = field(default_factory=list)
    clauses: list[list[tuple[str, list[str]]]] = field(default_factory=lambda: [[]])

    def all(self, *names: str) -> list[list[str]]:
        return [v for c in self.clauses for f, v in c if f in names]

    def one(self, *names: str, default: str | None = None) -> str | None:
        got = self.all(*names)
        return got[-1][0] if got else default

    def has(self, *names: str) -> bool:
        return bool(self.all(*names))


#: Flags of each command and how many values each takes.
FLAGS: dict[str, dict[str, int]] = {
    "read-csv": {"-delimiter": 1, "-no-header": 0, "-strict": 0}, "read-json": {}, "read-lines": {}, "read-parquet": {}, "exec": {},
    "where": {"-match": 3, "-m": 3, "-expr": 1, "-x": 1}, "update": {"-match": 3, "-m": 3, "-expr": 1, "-x": 1, "-set": 2, "-s": 2, "-set-expr": 2, "-e": 2},
    "include": {}, "exclude": {}, "rename": {"-as": 2}, "sort": {"-desc": 0, "-d": 0}, "limit": {}, "offset": {}, "distinct": {},
    "group-by": {"-count": 1, "-sum": 2, "-avg": 2, "-min": 2, "-max": 2},
    "join": {"-type": 1, "-t": 1, "-right": 1, "-r": 1, "-on": 1, "-left-field": 1, "-right-field": 1},
    "union": {"-file": 1, "-f": 1, "-all": 0, "-a": 0}, "write-csv": {"-delimiter": 1}, "write-json": {"-pretty": 0, "-p": 0}, "write-parquet": {},
    "table": {"-max-width": 1, "-w": 1}, "chart": {"-x": 1, "-y": 1, "-output": 1, "-o": 1}, "functions": {"-category": 1, "-c": 1}, "version": {}, "generate": {},
}
SOURCES = ("read-csv", "read-json", "read-lines", "read-parquet", "exec")
SINKS = ("write-csv", "write-json", "write-parquet", "table", "chart")


def parse_line(argv: Sequence[str]) -> list[tuple[str, Args]]:
    """Commands with their arguments."""
    out: list[tuple[str, Args]] = []
    part: list[str] = []
    for word in [*argv, "then"]:
        if word != "then":
            part.append(word)
            continue
        if not part:
            raise UsageError("a command is missing")
        name, *rest = part
        if name not in FLAGS:
            raise UsageError(f"unknown command {name}; there are {', '.join(sorted(FLAGS))}")
        out.append((name, _arguments(name, rest)))
        if name in ("limit", "offset"):
            _whole(out[-1][1], 1 if name == "limit" else 0)
        part = []
    return out


def _arguments(name: str, words: list[str]) -> Args:
    args, flags, i = Args(), FLAGS[name], 0
    if name == "exec":
        args.words = [w for w in words if w != "--"]
        return args
    while i < len(words):
        w = words[i]
        if w == "+":
            args.clauses.append([])
        elif w in flags:
            n = flags[w]
            if i + n >= len(words):
                raise UsageError(f"{name} {w} takes {n} values")
            args.clauses[-1].append((w, words[i + 1 : i + 1 + n]))
            i += n
        elif w.startswith("-") and not w.lstrip("-").replace(".", "").isdigit():
            raise UsageError(f"{name} has no flag {w}")
        else:
            args.words.append(w)
        i += 1
    return args


def _clauses(args: Args) -> list[Clause]:
    out = []
    for c in args.clauses:
        out.append(
            Clause(
                [tuple(v) for f, v in c if f in ("-match", "-m")],
                [v[0] for f, v in c if f in ("-expr", "-x")],
                {v[0]: guess_literal(v[1]) for f, v in c if f in ("-set", "-s")},
                {v[0]: v[1] for f, v in c if f in ("-set-expr", "-e")},
            )
        )
    return out


def _whole(args: Args, least: int) -> int:
    try:
        n = int(args.words[0])
    except (IndexError, ValueError):
        raise UsageError("a whole number is needed") from None
    if n < least:
        raise UsageError(f"the number must be at least {least}")
    return n


def _file(args: Args) -> str:
    if not args.words:
        raise UsageError("a file is needed")
    return args.words[0]


def open_file(spark, path: str) -> Flow:
    """A file by its ending: .json and .jsonl, .parquet, else delimited text."""
    if path.endswith((".json", ".jsonl")):
        return Flow.read_json(spark, path)
    return Flow.read_parquet(spark, path) if path.rstrip("/").endswith(".parquet") else Flow.read_csv(spark, path)


def _source(spark, name: str, a: Args) -> Flow:
    if name == "read-csv":
        config = readers.CSVConfig(header=not a.has("-no-header"), delimiter=a.one("-delimiter", default=","))
        if not a.words:
            return Flow(readers.csv_rows(spark, sys.stdin, config), [readers.ROW])
        return Flow.read_csv(spark, a.words[0], config, a.has("-strict"))
    if name == "read-json":
        return Flow.read_json(spark, a.words[0]) if a.words else Flow(readers.json_rows(spark, sys.stdin))
    if name == "exec":
        return Flow.exec(spark, *a.words)
    return (Flow.read_lines if name == "read-lines" else Flow.read_parquet)(spark, _file(a))


def _group(flow: Flow, a: Args) -> Flow:
    made = {v[0]: grouping.count() for v in a.all("-count")}
    for flag, make in (("-sum", grouping.sum_), ("-avg", grouping.avg), ("-min", grouping.min_), ("-max", grouping.max_)):
        made |= {v[1]: make(v[0]) for v in a.all(flag)}
    if not a.words or not made:
        raise UsageError("group-by needs a field and an aggregate")
    return flow.group_by(*a.words, **made)


def _join(spark, flow: Flow, a: Args) -> Flow:
    right = a.one("-right", "-r") or _file(a)
    on = [v[0] for v in a.all("-on")]
    lefts, rights = [v[0] for v in a.all("-left-field")], [v[0] for v in a.all("-right-field")]
    if bool(on) == bool(lefts) or len(lefts) != len(rights):
        raise UsageError("join needs -on, or as many -left-field as -right-field")
    how = a.one("-type", "-t", default="inner")
    return flow.join(open_file(spark, right), on or joining.on_pairs(*zip(lefts, rights, strict=True)), how)


def _verb(spark, flow: Flow, name: str, a: Args) -> Flow:
    verbs: dict[str, Callable[[], Flow]] = {
        "where": lambda: flow.where_clauses(*_clauses(a)),
        "update": lambda: flow.update_clauses(*_clauses(a)),
        "include": lambda: flow.include(*a.words),
        "exclude": lambda: flow.exclude(*a.words),
        "rename": lambda: flow.rename(*[tuple(v) for v in a.all("-as")]),
        "sort": lambda: flow.sort(*[("-" if a.has("-desc", "-d") else "") + w for w in a.words]),
        "limit": lambda: flow.limit(_whole(a, 1)),
        "offset": lambda: flow.offset(_whole(a, 0)),
        "distinct": flow.distinct,
        "group-by": lambda: _group(flow, a),
        "join": lambda: _join(spark, flow, a),
        "union": lambda: flow.union(*[open_file(spark, v[0]) for v in a.all("-file", "-f")], all_rows=a.has("-all", "-a")),
    }
    return verbs[name]()


def _sink(flow: Flow, name: str, a: Args) -> None:
    if name == "table":
        writers.display_table(flow.frame, int(a.one("-max-width", "-w", default="50")))
    elif name == "chart":
        charts.quick_chart(flow.frame, a.one("-x"), a.one("-y"), a.one("-output", "-o", default="chart.html"))
    elif name == "write-parquet":
        writers.write_parquet(flow.frame, _file(a))
    elif name == "write-csv":
        config = readers.CSVConfig(delimiter=a.one("-delimiter", default=","))
        if a.words:
            flow.write_csv(a.words[0], config=config)
        else:
            for line in writers.csv_lines(flow.frame, config):
                print(line)
    elif a.has("-pretty", "-p"):
        writers.write_json_pretty(flow.frame, a.words[0] if a.words else "/dev/stdout")
    elif a.words:
        flow.write_json(a.words[0])
    else:
        for line in writers.json_lines(flow.frame):
            print(line)


def run_line(spark, argv: Sequence[str]) -> Flow | None:
    """Run a line; the flow itself where no sink ends it."""
    flow: Flow | None = None
    commands = parse_line(argv)
    for i, (name, args) in enumerate(commands):
        if name in SOURCES:
            flow = _source(spark, name, args)
            continue
        if flow is None:
            flow = Flow(readers.json_rows(spark, sys.stdin))
        if name in SINKS:
            _sink(flow, name, args)
            if i == len(commands) - 1:
                return None
        else:
            flow = _verb(spark, flow, name, args)
    return flow


def generate(argv: Sequence[str]) -> str:
    """A Python program that runs the line."""
    words = list(argv)
    return "\n".join(["from pyspark.sql import SparkSession", "from tarnflow.plans.cli import run_line", "", "spark = SparkSession.builder.getOrCreate()", f"flow = run_line(spark, {words!r})", "if flow is not None:", "    flow.frame.show()", ""])


def main(argv: Sequence[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    try:
        commands = parse_line(argv)
        name, args = commands[-1]
        if name == "version":
            print(__version__)
            return 0
        if name == "functions":
            for category, usage, about in functions(args.one("-category", "-c")):
                print(f"{category:8} {usage:22} {about}")
            return 0
        if name == "generate":
            text = generate(argv[: len(argv) - 2 - len(args.words)])
            if args.words:
                with open(args.words[0], "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                print(text)
            return 0
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tarnflow").config("spark.ui.enabled", "false").getOrCreate()
        flow = run_line(spark, argv)
        if flow is not None:
            for line in writers.json_lines(rows.exclude(flow.frame, *[c for c in flow.frame.columns if c.startswith("_")])):
                print(line)
    except (UsageError, ValueError) as e:
        print(f"tarnflow: {e}", file=sys.stderr)
        return 2
    return 0


