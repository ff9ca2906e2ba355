"""Catalogue queries over folders of markdown files, with DuckDB SQL over the table that the files are made from.

Each query makes its folder anew: a file for each nation, one without frontmatter, one that is malformed, one that is hidden, and rules that ignore a
region's folder.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mdframe.engine import Engine
from mdframe.lang.tokens import QueryError


def note(key: int, name: str, region: int) -> str:
    """The document of a nation."""
    rank = f"rank: {key}\n" if key % 2 == 0 else ""
    front = f"title: {name}\nregion: {region}\n{rank}tags: [{'odd' if key % 2 else 'even'}, r{region}]\ncreatedAt: 2026-01-{key % 28 + 1:02d}T00:00:00Z"
    return f"---\n{front}\n---\n\n# {name}\n\nBody of {key}.\n"


def folder(spark: SparkSession, sf_dir: str) -> str:
    """A new folder of notes, where all workers see it; removed when the process ends."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise QueryError("set spark.checkpoint.dir to make files for a cluster")
    base = shared.removeprefix("file://").removeprefix("file:") if shared else None
    if base:
        os.makedirs(base, exist_ok=True)
    made = tempfile.mkdtemp(prefix="notes-", dir=base)
    atexit.register(shutil.rmtree, made, True)
    files = {".gitignore": "# a region\n4/\n", "top.md": "# Top\n\nNo frontmatter.\n", "bad.md": '---\ntitle: "open\nx: y\n---\n', ".kept/hidden.md": "---\ntitle: Hidden\n---\n"}
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect():
        files[f"{r[2]}/{r[1]}.md"] = note(*r)
    for name, text in files.items():
        path = os.path.join(made, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return made


def notes(spark: SparkSession, where: str, **options) -> Engine:
    out = Engine(spark)
    out.register_directory(where, **options)
    return out


def _read(query: str, **options) -> Callable:
    return lambda spark, sf_dir: notes(spark, folder(spark, sf_dir), **options).sql(query).frame


def _changed(statement: str, query: str) -> Callable:
    """What a query reads after a statement has changed files."""
    def run(spark, sf_dir):
        where = folder(spark, sf_dir)
        notes(spark, where).sql(statement)
        return notes(spark, where).sql(query).frame

    return run


def _refused(*statements: str) -> Callable:
    """The message with which the last statement is refused, and how many files are still there."""
    def run(spark, sf_dir):
        where = folder(spark, sf_dir)
        engine = notes(spark, where)
        for s in statements[:-1]:
            engine.sql(s)
        message = ""
        try:
            engine.sql(statements[-1])
        except QueryError as e:
            message = str(e)
        return spark.createDataFrame([(message, notes(spark, where).sql("select count(*) as n").rows()[0]["n"])], "message string, files long")

    return run


def _errors(spark, sf_dir):
    seen = []
    engine = Engine(spark, hooks={"on_error": seen.append})
    where = folder(spark, sf_dir)
    engine.register_directory(where, os.path.join(where, "none"))
    return spark.createDataFrame([(os.path.basename(e["path"]), e["phase"]) for e in seen], "name string, phase string")


def _two_folders(spark, sf_dir):
    where = folder(spark, sf_dir)
    engine = Engine(spark)
    engine.register_directory(os.path.join(where, "0"), os.path.join(where, "1"))
    return engine.sql("select title, path").frame


def _clipboard(spark, sf_dir):
    """The text that a pipe copies, a row for each line."""
    from mdframe.output import clipboard

    copied, command = [], clipboard.copy
    clipboard.copy = copied.append
    try:
        notes(spark, folder(spark, sf_dir)).sql('select filename, title where region = 1 | clipboard()')
    finally:
        clipboard.copy = command
    return spark.createDataFrame([(x,) for x in copied[0].split("\n")], "line string")


KEPT = "FROM nation WHERE n_regionkey <> 4"
DAY = "TIMESTAMP '2026-01-01' + INTERVAL 1 DAY * (n_nationkey % 28)"

# name: (query, DuckDB SQL)
FILES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "files_fields": (_read("select title, region, rank, createdAt where has(title)"), f"SELECT n_name AS title, n_regionkey::BIGINT AS region, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::BIGINT END AS rank, {DAY} AS createdAt {KEPT}"),
    "files_where": (_read('select title where tags any = "odd" and createdAt > "2026-01-05"'), f"SELECT n_name AS title {KEPT} AND n_nationkey % 2 = 1 AND {DAY} > TIMESTAMP '2026-01-05'"),
    "files_paths": (_read("select filename, path"), f"SELECT n_name AS filename, n_regionkey || '/' || n_name || '.md' AS path {KEPT} UNION ALL SELECT 'top', 'top.md'"),
    "files_absent_rows": (_read("select rank"), f"SELECT n_nationkey::BIGINT AS rank {KEPT} AND n_nationkey % 2 = 0"),
    "files_no_ignore": (_read("select count(*) as n", ignore=False), "SELECT count(*) + 1 AS n FROM nation"),
    "files_hidden": (_read("select path", hidden=True), f"SELECT n_regionkey || '/' || n_name || '.md' AS path {KEPT} UNION ALL SELECT unnest(['top.md', '.kept/hidden.md'])"),
    "files_depth": (_read("select path", depth=1), "SELECT 'top.md' AS path"),
    "files_listed": (_read("select path, title", files=["0/NATION_0.md", "top.md"]), "SELECT '0/NATION_0.md' AS path, n_name AS title FROM nation WHERE n_nationkey = 0 UNION ALL SELECT 'top.md', NULL"),
    "files_two_folders": (_two_folders, "SELECT n_name AS title, n_name || '.md' AS path FROM nation WHERE n_regionkey IN (0, 1)"),
    "files_body": (_read("select title, h1[0].title as h, p[0].content as p, content() as c where has(title)"), f"SELECT n_name AS title, n_name AS h, 'Body of ' || n_nationkey || '.' AS p, '# ' || n_name || chr(10) || chr(10) || 'Body of ' || n_nationkey || '.' || chr(10) AS c {KEPT}"),
    "files_metadata": (
        _read("select title, file().size as size, len(file().mode) as mode where has(title)"),
        "SELECT n_name AS title, length('---' || chr(10) || 'title: ' || n_name || chr(10) || 'region: ' || n_regionkey || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN 'rank: ' || n_nationkey || chr(10) ELSE '' END "
        "|| 'tags: [' || CASE WHEN n_nationkey % 2 = 1 THEN 'odd' ELSE 'even' END || ', r' || n_regionkey || ']' || chr(10) || 'createdAt: 2026-01-01T00:00:00Z' || chr(10) || '---' || chr(10) || chr(10) "
        f"|| '# ' || n_name || chr(10) || chr(10) || 'Body of ' || n_nationkey || '.' || chr(10)) AS size, 9 AS mode {KEPT}",
    ),
    "files_group": (_read("select region, count(*) as n, max(rank) as top where has(region) group by region"), f"SELECT n_regionkey::BIGINT AS region, count(*) AS n, max(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::BIGINT END) AS top {KEPT} GROUP BY 1"),
    "files_errors": (_errors, "SELECT unnest(['bad.md', 'none']) AS name, unnest(['read', 'list']) AS phase"),
    "files_update": (
        _changed('update where region = 2 set rank:number = region + 5, tags = tags + ["new"], mark = "m-" + title', "select title, rank, tags.join(',') as tags, mark where has(title)"),
        f"SELECT n_name AS title, CASE WHEN n_regionkey = 2 THEN 7 WHEN n_nationkey % 2 = 0 THEN n_nationkey END::DOUBLE AS rank, CASE WHEN n_nationkey % 2 = 1 THEN 'odd' ELSE 'even' END || ',r' || n_regionkey || CASE WHEN n_regionkey = 2 THEN ',new' ELSE '' END AS tags, CASE WHEN n_regionkey = 2 THEN 'm-' || n_name END AS mark {KEPT}",
    ),
    "files_create": (_changed('create title = "Made" region = 9 file = "made/new"', "select title, path, region where region > 2"), f"SELECT n_name AS title, n_regionkey || '/' || n_name || '.md' AS path, n_regionkey::BIGINT AS region {KEPT} AND n_regionkey > 2 UNION ALL SELECT 'Made', 'made/new.md', 9"),
    "files_delete": (_changed("delete where region = 1 or rank > 10", "select title where has(title)"), f"SELECT n_name AS title {KEPT} AND n_regionkey <> 1 AND NOT (n_nationkey % 2 = 0 AND n_nationkey > 10)"),
    "files_no_match": (_refused('update where title = "Nowhere" set rank = 1'), f"SELECT 'no file with title ''Nowhere''' AS message, count(*) + 1 AS files {KEPT}"),
    "files_trigger": (
        _refused('before delete where old.region = 3 deny "region 3 stays"', "delete where region >= 2"), f"SELECT 'region 3 stays' AS message, count(*) + 1 AS files {KEPT}",
    ),
    "pipe_clipboard": (_clipboard, f"SELECT n_name AS line {KEPT} AND n_regionkey = 1"),
}
