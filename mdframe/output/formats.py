"""Results as JSON, CSV and box-drawing tables."""

from __future__ import annotations

import csv
import datetime as dt
import decimal
import io
import json
import os
import re
import shutil
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdframe.lang.tokens import QueryError

ANSI = re.compile(r"\x1b\[[0-9;]*m")


def plain(value: object) -> object:
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z"
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return value


def to_json(rows: list[dict], **extra: object) -> str:
    """The whole result, with two spaces of indent."""
    return json.dumps({"type": extra.pop("type", "select"), "data": [plain(r) for r in rows], **extra}, indent=2, ensure_ascii=False)


def shape(kind: T.DataType) -> str | None:
    """What a type is that a cell cannot show, or None."""
    if isinstance(kind, T.StructType | T.MapType):
        return "map"
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType | T.MapType):
        return "array of maps"
    return None


def enforce_scalars(frame: DataFrame) -> None:
    """Tables and CSV hold scalars and arrays of them: raise for other columns, before any row is read."""
    faults = []
    for f in frame.schema:
        kind = shape(f.dataType)
        if kind:
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            names = inner.fieldNames() if isinstance(inner, T.StructType) else []
            pick = next((n for n in ("title", "content", "url", "text") if n in names), names[0] if names else "key")
            bare = f.name.removesuffix("()")
            hint = f"{bare}.map('{pick}')" if kind == "array of maps" else f"{bare}.{pick}"
            faults.append(f"column {f.name} is a {kind}, which table and csv cannot show; try {hint} or --json" if kind == "map" else f"column {f.name} is an {kind}, which table and csv cannot show; try {hint} or --json")
    if faults:
        raise QueryError("Scalar value error: " + "; ".join(faults))


def cell(value: object) -> str:
    value = plain(value)
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value == int(value) and abs(value) < 1e15:
        return str(int(value))
    if isinstance(value, list):
        return ",".join(cell(v) for v in value)
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else str(value)


def escape_formula(text: str) -> str:
    return "'" + text if text[:1] in tuple("=+-@\t\r") and text[:1] else text


def to_csv(rows: list[dict], columns: list[str]) -> str:
    if not rows:
        return ""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow([escape_formula(c) for c in columns])
    for r in rows:
        writer.writerow([escape_formula(cell(r.get(c))) for c in columns])
    return out.getvalue()


def write_csv(frame: DataFrame, path: str) -> None:
    """A large result as CSV files, formulas escaped in the cluster."""
    cols = []
    for f in frame.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(F.rlike(c, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), c)).otherwise(c)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        cols.append(c.alias(f.name))
    frame.select(*cols).write.csv(path, header=True, escape='"')


def write_parts(frame: DataFrame, path: str, form: str) -> None:
    """A large result as a folder of CSV files, or of files with a JSON object a line; nothing passes through the driver."""
    if form == "csv":
        enforce_scalars(frame)
        write_csv(frame, path)
    else:
        frame.write.json(path, ignoreNullFields=False)


# -- tables


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones and colour codes none."""
    text = ANSI.sub("", text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def pad(text: str, size: int) -> str:
    return text + " " * max(0, size - width(text))


def wrap(text: str, size: int) -> list[str]:
    """Lines of at most ``size`` columns, broken between words, and within words that are longer."""
    out = []
    for line in text.split("\n"):
        if width(line) <= size:  # blanks at its start stay
            out.append(line)
            continue
        now = ""
        for word in line.split(" "):
            trial = f"{now} {word}" if now else word
            if width(trial) <= size:
                now = trial
                continue
            if now:
                out.append(now)
            while width(word) > size:
                k = len(word)
                while width(word[:k]) > size and k > 1:
                    k -= 1
                out.append(word[:k])
                word = word[k:]
            now = word
        out.append(now)
    return out


def clip(text: str, size: int) -> str:
    if width(text) <= size:
        return text
    while text and width(text) > size - 1:
        text = text[:-1]
    return text + "…"


def trim_all(text: str) -> str:
    return re.sub("[\x00-\x1f  \u0085|]", " ", text).strip()


def header(name: str, form: str = "upper", normalize: bool = True) -> str:
    if normalize:
        name = re.sub(r"[^0-9A-Za-z\u0080-￿]+", " ", name).strip() or name
    words = name.split()
    match form:
        case "upper":
            return name.upper()
        case "capitalize":
            return " ".join(w[:1].upper() + w[1:].lower() for w in words)
        case "camel-case":
            return "".join(w.lower() if i == 0 else w[:1].upper() + w[1:].lower() for i, w in enumerate(words))
        case "pascal-case":
            return "".join(w[:1].upper() + w[1:].lower() for w in words)
    return name


def terminal_width() -> int:
    return shutil.get_terminal_size((int(os.environ.get("COLUMNS") or 80), 24)).columns


def widths(natural: list[int], room: int, spec: str | None = None) -> list[int]:
    """Widths of columns: natural ones if they fit, else 3 each and the rest shared by need; ``spec`` has numbers, percents and ``*``."""
    n = len(natural)
    if spec:
        wanted = [w.strip() for w in spec.split(",")][:n] + ["*"] * max(0, n - len(spec.split(",")))
        fixed = [max(1, room * int(w[:-1]) // 100) if w.endswith("%") else int(w) if w.isdigit() else None for w in wanted]
        free = [i for i, f in enumerate(fixed) if f is None]
        rest = widths([natural[i] for i in free], max(3 * len(free), room - sum(f or 0 for f in fixed))) if free else []
        for i, w in zip(free, rest, strict=True):
            fixed[i] = w
        return fixed
    if sum(natural) <= room or not n:
        return natural
    budget = max(room, 3 * n)
    need = [max(0, min(w, int(1.5 * budget / n)) - 3) for w in natural]
    spare, total = budget - 3 * n, sum(need) or 1
    return [3 + spare * w // total for w in need]


def to_table(
    rows: list[dict], columns: list[str], compact: bool = False, most_lines: int | None = None, spec: str | None = None,
    trim: str | None = "*", titles: str = "upper", normalize: bool = True, total: int | None = None, color: str | None = None,
) -> str:
    """A box-drawing table; ``No results`` for none. ``compact`` leaves out rules between rows and spaces before cells."""
    if not rows:
        return "No results"
    keep = [trim is not None and (trim == "*" or (trim.split(",") + ["0"] * len(columns))[i].strip() == "1") for i in range(len(columns))]
    heads = [header(c, titles, normalize) for c in columns]
    cells = [[trim_all(cell(r.get(c))) if keep[i] else cell(r.get(c)) for i, c in enumerate(columns)] for r in rows]
    left = "" if compact else " "
    padding = 1 if compact else 2
    natural = [max([width(heads[i])] + [max(map(width, row[i].split("\n"))) for row in cells]) for i in range(len(columns))]
    room = (total or terminal_width()) - (len(columns) + 1) - len(columns) * padding
    size = widths(natural, room, spec)
    rule = lambda a, b, c: a + b.join("─" * (w + padding) for w in size) + c

    def block(row: list[str], paint: bool = False) -> list[str]:
        parts = [wrap(x, w) for x, w in zip(row, size, strict=True)]
        if most_lines:
            parts = [p if len(p) <= most_lines else [*p[: most_lines - 1], clip(p[most_lines - 1] + "…", w)] for p, w in zip(parts, size, strict=True)]
        high = max(map(len, parts))
        lines = []
        for k in range(high):
            shown = [pad(p[k] if k < len(p) else "", w) for p, w in zip(parts, size, strict=True)]
            if paint and color:
                shown = [f"\x1b[{color}m{x}\x1b[0m" for x in shown]
            lines.append("│" + "│".join(f"{left}{x} " for x in shown) + "│")
        return lines

    out = [rule("┌", "┬", "┐"), *block([clip(h, w) for h, w in zip(heads, size, strict=True)], True), rule("├", "┼", "┤")]
    for i, row in enumerate(cells):
        if i and not compact:
            out.append(rule("├", "┼", "┤"))
        out += block(row)
    return "\n".join([*out, rule("└", "┴", "┘")])


def render(result, form: str = "table", **options: object) -> str:
    """A query result in a format."""
    if result.frame is None or result.type not in ("select", "union"):
        counts = {k: getattr(result, k) for k in ("updated", "created", "deleted") if getattr(result, k)}
        return to_json([], type=result.type, **counts) if form == "json" else "" if form == "csv" else ", ".join(f"{v} {k}" for k, v in counts.items())
    if form not in ("json", "csv", "table"):
        raise QueryError(f"Unknown format: {form}")
    if form != "json":
        enforce_scalars(result.frame)
    rows = result.rows()
    if form == "json":
        return to_json(rows, type=result.type, count=len(rows), meta=plain(result.meta))
    return to_csv(rows, result.columns) if form == "csv" else to_table(rows, result.columns, **options)
