"""Command line: ``python -m mdframe.cli --dir notes 'select title where status = "todo"'``."""

from __future__ import annotations

import argparse
import os
import sys

from mdframe import __version__
from mdframe.config import ConfigError, header_color, load_config
from mdframe.lang import parse
from mdframe.lang import tree as t
from mdframe.lang.tokens import QueryError


def expand_dir(text: str) -> str:
    return os.path.abspath(os.path.expandvars(os.path.expanduser(text)))


def merge_dirs(argv: list[str]) -> list[str]:
    """``--dir a, b`` is ``--dir a,b``."""
    out: list[str] = []
    for x in argv:
        if out and out[-1].endswith(",") and len(out) > 1 and (out[-2] in ("--dir",) or out[-1].startswith("--dir=")):
            out[-1] += x
        else:
            out.append(x)
    return out


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mdframe", description="Query markdown documents and tables.")
    p.add_argument("query", nargs="?", help="query text; - or none reads standard input")
    p.add_argument("-v", "--version", action="version", version=__version__)
    p.add_argument("--dir", action="append", help="directories, repeated or separated by commas")
    p.add_argument("-f", "--files", help="paths separated by commas, or - to read them from standard input")
    p.add_argument("-d", "--depth", type=int)
    p.add_argument("-H", "--hidden", action="store_true", default=None)
    p.add_argument("--no-ignore", dest="ignore", action="store_false", default=None)
    p.add_argument("-y", "--yes", action="store_true")
    p.add_argument("--format", choices=["json", "csv", "table"])
    for name in ("json", "csv", "table"):
        p.add_argument(f"--{name}", dest="format", action="store_const", const=name)
    p.add_argument("--color", action="store_true", default=None)
    p.add_argument("--no-color", dest="color", action="store_false")
    p.add_argument("-o", "--out")
    p.add_argument("--parts", action="store_true", help="write a folder of part files, from the tasks that make them")
    p.add_argument("--compact", action="store_true", default=None)
    p.add_argument("--rows", type=int)
    p.add_argument("--columns")
    p.add_argument("--trim", nargs="?", const="*")
    p.add_argument("--no-trim", dest="trim", action="store_const", const="")
    p.add_argument("--title-format", choices=["none", "upper", "capitalize", "camel-case", "pascal-case"])
    p.add_argument("--normalize", action="store_true", default=None)
    p.add_argument("--no-normalize", dest="normalize", action="store_false")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        return run(argv, spark)
    except (QueryError, ConfigError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


def run(argv: list[str] | None, spark) -> int:
    config = load_config()
    a = arguments().parse_args(merge_dirs(list(sys.argv[1:] if argv is None else argv)))
    pick = lambda value, name, default: value if value is not None else config.get(name, default)
    piped = sys.stdin.read().split("\n") if a.files == "-" else None
    text = a.query if a.query and a.query != "-" else sys.stdin.read() if piped is None else ""
    if not text.strip():
        print("Error: no query", file=sys.stderr)
        return 1
    dirs = [expand_dir(x.strip()) for d in (a.dir or [config.get("dir", ".")]) for x in d.split(",") if x.strip()]
    missing = [d for d in dirs if not os.path.isdir(d)]
    if missing and len(missing) == len(dirs):
        print(f"Error: directory not found: {missing[0]}", file=sys.stderr)
        return 1
    for d in missing:
        print(f"Warning: directory not found: {d}", file=sys.stderr)
    form = a.format
    if a.out and form is None:
        form = {".json": "json", ".csv": "csv"}.get(os.path.splitext(a.out)[1])
    form = form or config.get("format", "table")
    statement = parse(text)
    inner = statement.statement if isinstance(statement, t.Pipe) else statement
    if isinstance(inner, t.Delete) and inner.where is None:
        raise QueryError("delete requires a where clause")
    if isinstance(inner, t.Update | t.Delete) and not a.yes:
        if not sys.stdin.isatty():
            raise QueryError("update and delete need -y where no one can be asked")
        if input("Change files? [y/N] ").strip().lower() not in ("y", "yes"):
            return 1
    from mdframe.engine import Engine
    from mdframe.output.formats import render, write_parts

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR").getOrCreate()
    files = [f for f in (piped if piped is not None else a.files.split(",") if a.files else []) if f.strip()] or None
    engine = Engine(spark)
    engine.register_directory(*[d for d in dirs if d not in missing], depth=pick(a.depth, "depth", 0), hidden=pick(a.hidden, "hidden", False), ignore=pick(a.ignore, "ignore", True), files=files)
    result = engine.execute(statement)
    options = {}
    if form == "table":
        trim = pick(a.trim, "trim", "*")
        options = {
            "compact": pick(a.compact, "compact", False), "most_lines": pick(a.rows, "rows", None), "spec": pick(a.columns, "columns", None),
            "trim": trim or None, "titles": pick(a.title_format, "titleFormat", "upper"), "normalize": pick(a.normalize, "normalize", True), "color": header_color(a.color, config),
        }
    if a.parts:
        if not a.out or form not in ("csv", "json") or result.frame is None:
            raise QueryError("--parts needs a select, --out and the format csv or json")
        write_parts(result.frame, a.out, form)
        return 0
    shown = render(result, form, **options)
    if a.out:
        out = a.out if os.path.splitext(a.out)[1] or form == "table" else f"{a.out}.{form}"
        os.makedirs(os.path.dirname(os.path.abspath(out)), exist_ok=True)
        with open(out, "w", encoding="utf-8") as f:
            f.write(shown)
    else:
        print(shown)
    errors = engine.table(engine.default).errors
    n = errors.count() if errors is not None else 0
    if n:
        print(f"Warning: {n} file{'s' * (n != 1)} could not be read", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
