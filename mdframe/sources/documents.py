"""Directories of markdown files as DataFrames, and writing a document back."""

from __future__ import annotations

import datetime as dt
import fnmatch
import json
import os
import re

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

FILES_A_TASK = 256
IDENTITY = ("filename", "path", "abspath", "source_dir", "body", "content", "frontmatter", "metadata", "__keys", "__ord")
_TEXT, _MANY = T.StringType(), T.ArrayType(T.StringType())
METADATA = T.StructType([
    T.StructField(name, kind) for name, kind in (
        ("abspath", _TEXT), ("mtime", T.TimestampType()), ("atime", T.TimestampType()), ("ctime", T.TimestampType()), ("owner", _TEXT), ("group", _TEXT),
        ("size", T.LongType()), ("mode", _TEXT),
    )
])
FRONT = re.compile(r"\A﻿?---[ \t]*\r?\n(.*?)(?:\r?\n)?^---[ \t]*(?:\r?\n|\Z)", re.S | re.M)


class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """Safe YAML in which only true and false are booleans."""


Loader.yaml_implicit_resolvers = {
    c: [(tag, rx) for tag, rx in pairs if tag != "tag:yaml.org,2002:bool"] for c, pairs in Loader.yaml_implicit_resolvers.items()
}
Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


# -- finding files


class IgnoreRules:
    """Rules of one .gitignore file, for paths below its directory."""

    def __init__(self, text: str) -> None:
        self.rules = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[negated:]
            only_dir = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            self.rules.append((negated, only_dir, re.compile(self._regex(line.lstrip("/"), anchored))))

    @staticmethod
    def _regex(pattern: str, anchored: bool) -> str:
        out = []
        for part in re.split(r"(\*\*/|/\*\*|\*\*)", pattern):
            if part == "**/":
                out.append("(?:.*/)?")
            elif part == "/**":
                out.append("/.*")
            elif part == "**":
                out.append(".*")
            else:
                out.append(fnmatch.translate(part).removesuffix(r"\Z").removesuffix(r"\z").removeprefix("(?s:").removesuffix(")").replace(".*", "[^/]*"))
        return ("" if anchored else "(?:.*/)?") + "".join(out) + "$"

    def ignores(self, path: str, is_dir: bool) -> bool:
        hit = False
        for negated, only_dir, rx in self.rules:
            if (is_dir or not only_dir) and rx.match(path):
                hit = not negated
        return hit


def list_files(root: str, depth: int = 0, hidden: bool = False, ignore: bool = True) -> list[str]:
    """Markdown files under a directory, its own before those of its directories; ``depth`` 0 is no limit."""
    out: list[str] = []

    def walk(folder: str, left: int, layers: list[tuple[str, IgnoreRules]]) -> None:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        path = os.path.join(folder, ".gitignore")
        if ignore and os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                layers = [*layers, (folder, IgnoreRules(f.read()))]
        below = []
        for e in entries:
            if e.name == ".git" or not hidden and e.name.startswith("."):
                continue
            is_dir = e.is_dir(follow_symlinks=False)
            if any(rules.ignores(os.path.relpath(e.path, base), is_dir) for base, rules in layers):
                continue
            if is_dir:
                below.append(e.path)
            elif e.is_file() and e.name.endswith(".md"):
                out.append(e.path)
        if left != 1:
            for d in below:
                walk(d, left - 1 if left else 0, layers)

    walk(os.path.abspath(root), depth, [])
    return out


# -- reading


def split_front(text: str) -> tuple[dict, str]:
    """Frontmatter and body; raises on malformed YAML."""
    m = FRONT.match(text)
    if not m:
        return {}, text
    found = yaml.load(m[1], Loader)  # noqa: S506 - a safe loader
    if found is None:
        found = {}
    if not isinstance(found, dict):
        raise ValueError("frontmatter is not a mapping")
    return {str(k): v for k, v in found.items()}, text[m.end():].removeprefix("\n")


ISO = re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$")


def plain(value: object) -> object:
    """A JSON value; times become ISO text in UTC."""
    if isinstance(value, dt.datetime):
        value = value.astimezone(dt.UTC) if value.tzinfo else value.replace(tzinfo=dt.UTC)
        return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z"
    if isinstance(value, dt.date):
        return f"{value.isoformat()}T00:00:00.000Z"
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [plain(v) for v in value]
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    return value


def type_name(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint" if -(2**63) <= value < 2**63 else "double"
    if isinstance(value, float):
        return "double"
    if isinstance(value, dt.date) or isinstance(value, str) and ISO.match(value):
        return "timestamp"
    if isinstance(value, list | tuple | set):
        kinds = {type_name(v) for v in value} - {"null"}
        return f"array<{merged(kinds)}>"
    return "map<string,string>" if isinstance(value, dict) else "string"


def merged(kinds: set[str]) -> str:
    kinds = set(kinds) - {"null"}
    if len(kinds) == 1:
        return kinds.pop()
    if kinds and kinds <= {"bigint", "double"}:
        return "double"
    if len(kinds) > 1 and all(k.startswith("array<") for k in kinds):
        return f"array<{merged({k[6:-1] for k in kinds})}>"
    return "string"


def _metadata(path: str) -> dict | None:
    import getpass

    try:
        s = os.stat(path)
    except OSError:
        return None
    time = lambda x: dt.datetime.fromtimestamp(x, dt.UTC)
    try:
        owner = getpass.getuser() if s.st_uid == os.getuid() else str(s.st_uid)
    except (KeyError, OSError):
        owner = str(s.st_uid)
    mode = "".join(c if s.st_mode & (0o400 >> i) else "-" for i, c in enumerate("rwxrwxrwx"))
    return {"abspath": path, "mtime": time(s.st_mtime), "atime": time(s.st_atime), "ctime": time(s.st_ctime), "owner": owner, "group": str(s.st_gid), "size": s.st_size, "mode": mode}


def _parsed(text: str | None, failure: str | None) -> dict:
    if failure is None:
        try:
            front, body = split_front(text)
            return {
                "front": json.dumps(plain(front)), "keys": list(front), "kinds": [f"{k}\0{type_name(v)}" for k, v in front.items()],
                "texts": [(k, v if isinstance(v, str) else None if v is None else json.dumps(plain(v))) for k, v in front.items()], "body": body, "content": text, "error": None,
            }
        except (yaml.YAMLError, ValueError) as e:
            failure = str(e)
    return {"front": None, "keys": [], "kinds": [], "texts": [], "body": None, "content": None, "error": failure}


READ = T.StructType([
    T.StructField(name, kind) for name, kind in (
        ("abspath", _TEXT), ("path", _TEXT), ("filename", _TEXT), ("source_dir", _TEXT), ("__ord", T.LongType()), ("front", _TEXT), ("keys", _MANY), ("kinds", _MANY),
        ("texts", T.MapType(_TEXT, _TEXT)), ("body", _TEXT), ("content", _TEXT), ("error", _TEXT), ("metadata", METADATA),
    )
])


def _read_batches(it):
    for batch in it:
        rows = []
        for r in batch.to_pylist():
            text = failure = None
            try:
                with open(r["abspath"], encoding="utf-8", errors="replace") as f:
                    text = f.read()
            except OSError as e:
                failure = str(e)
            rows.append(r | _parsed(text, failure) | {"metadata": _metadata(r["abspath"])})
        yield pa.RecordBatch.from_pylist(rows, _arrow())


def _parse_batches(it):
    for batch in it:
        rows = []
        for r in batch.to_pylist():
            text, size, mtime = r.pop("raw").decode("utf-8", "replace"), r.pop("size"), r.pop("mtime")
            meta = {"abspath": r["abspath"], "size": size, "mtime": mtime}  # all that a remote store tells
            rows.append(r | _parsed(text, None) | {"metadata": meta})
        yield pa.RecordBatch.from_pylist(rows, _arrow())


def _arrow() -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in READ])


def read_documents(
    spark: SparkSession, directories: tuple[str, ...] | list[str], depth: int = 0, hidden: bool = False, ignore: bool = True,
    files: list[str] | None = None, stat: bool = True, stage: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Documents and errors of directories, or of ``files``.

    A column for each frontmatter key, of the type that all its values share; ``__keys`` has the keys that a document holds, and ``__ord`` its place in
    the order of discovery. A file that cannot be read or parsed is a row ``(path, error, phase)`` of the errors, and so is a missing directory.
    Directories with a scheme are listed and read by Spark; local ones are listed here, and read in tasks of ``FILES_A_TASK`` files. Files are read
    once for the types of their keys and again by each query, so that queries see files as they are; with ``stage``, a new folder that all workers
    see, they are read once and queries read the Parquet files written there.
    """
    errors, parts = [], []
    listed: list[tuple[str, str, str, str, int]] = []
    for d in directories:
        if "://" in d:
            parts.append(_remote(spark, d, depth, hidden))
            continue
        if not files and not os.path.isdir(d):
            errors.append((d, f"directory not found: {d}", "list"))
            continue
        base = os.path.abspath(d)
        found = [os.path.abspath(f if os.path.isabs(f) else os.path.join(base, f)) for f in files] if files else list_files(d, depth, hidden, ignore)
        for f in found:
            listed.append((f, os.path.relpath(f, base), os.path.basename(f).removesuffix(".md"), d, len(listed)))
        if files:
            break
    names = "abspath string, path string, filename string, source_dir string, __ord long"
    if listed or not parts:
        rows = spark.createDataFrame(listed, names)
        parts.insert(0, rows.repartition(max(1, -(-len(listed) // FILES_A_TASK))).mapInArrow(_read_batches, READ))
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.union(p)
    if stage is not None:
        raw.write.parquet(stage)
        raw = spark.read.schema(raw.schema).parquet(stage)
    kinds: dict[str, set[str]] = {}
    for (pair,) in raw.select(F.explode("kinds")).distinct().collect():  # keys and types, not documents
        name, _, kind = pair.partition("\0")
        kinds.setdefault(name, set()).add(kind)
    good = raw.where("error is null")
    schema = T.StructType([T.StructField(k, T._parse_datatype_string(merged(v))) for k, v in sorted(kinds.items()) if k not in IDENTITY])
    out = good.select(
        "filename", "path", "abspath", "source_dir", "body", "content", F.col("texts").alias("frontmatter"), F.col("keys").alias("__keys"), "__ord",
        *(["metadata"] if stat else []), (F.from_json("front", schema) if len(schema) else F.lit(None)).alias("__f"),
    )
    cols = [F.col("__f").getField(f.name).alias(f.name) for f in schema]
    out = out.select(*cols, *[c for c in out.columns if c != "__f"])
    bad = raw.where("error is not null").select(F.col("abspath").alias("path"), "error", F.lit("read").alias("phase"))
    if errors:
        bad = bad.union(spark.createDataFrame(errors, "path string, error string, phase string"))
    return out, bad


def _remote(spark: SparkSession, root: str, depth: int, hidden: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/") + "/"
    rel = F.substr(F.col("path"), F.greatest(F.instr(F.col("path"), base.split("://", 1)[1].lstrip("/")), F.lit(1)) + len(base.split("://", 1)[1].lstrip("/")))
    rows = files.select(
        F.col("path").alias("abspath"), rel.alias("path"), F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("filename"), F.lit(root).alias("source_dir"),
        F.xxhash64("path").alias("__ord"), F.col("content").alias("raw"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
    )
    if depth:
        rows = rows.where(F.size(F.split("path", "/")) <= depth)
    if not hidden:
        rows = rows.where(~F.rlike(F.col("path"), F.lit(r"(^|/)\.")))
    return rows.mapInArrow(_parse_batches, READ)


def own_fields(frame: DataFrame) -> list[str]:
    """Frontmatter columns of a document table."""
    return [c for c in frame.columns if c not in IDENTITY]


# -- writing


def write_rows(frame: DataFrame, names: list[str], assigned: list[str]) -> int:
    """Write the document of each row back to its file, in tasks, and return their number; ``names`` are the frontmatter's fields.

    Only fields that a document holds, or that are assigned, are written.
    """
    maps = [f.name for f in frame.schema if isinstance(f.dataType, T.MapType)]
    kept = [c for c in frame.columns if c in ("abspath", "body", "__keys") or c in names]

    def run(it):
        for batch in it:
            for row in batch.to_pylist():
                row |= {k: dict(row[k]) for k in maps if row.get(k) is not None}
                present = {*(row.get("__keys") or ()), *assigned}
                fields = {k: row.get(k) for k in names if k in present}
                write_document(row["abspath"], fields | {"updatedAt": dt.datetime.now(dt.UTC)}, row.get("body") or "")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    return frame.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def remove_files(frame: DataFrame) -> int:
    """Remove the file of each row, in tasks, and return their number; a file that is gone counts too."""
    def run(it):
        for batch in it:
            for (path,) in zip(batch.column(0).to_pylist(), strict=True):
                if os.path.exists(path):
                    os.unlink(path)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    return frame.select("abspath").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_document(path: str, fields: dict, body: str) -> None:
    """Write frontmatter as ``key: JSON`` lines and the body; null and empty values are left out. The file changes at once or not at all."""
    lines = [f"{k}: {json.dumps(plain(v), ensure_ascii=False)}" for k, v in fields.items() if v is not None and v != ""]
    text = "---\n" + "\n".join(lines) + "\n---\n\n" + body.lstrip("\n")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    spare = f"{path}.{os.getpid()}.tmp"
    with open(spare, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(spare, path)
