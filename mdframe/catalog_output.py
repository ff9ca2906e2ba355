"""Catalogue queries about what leaves the engine: formats, the command line, settings and hooks, with DuckDB SQL for the text that they give."""

from __future__ import annotations

import contextlib
import io
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframe.catalog_files import folder
from mdframe.engine import Engine
from mdframe.lang import tree as t
from mdframe.lang.tokens import QueryError
from mdframe.output.formats import header, render


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in text.rstrip("\n").split("\n")], "line string")


def _tables(spark: SparkSession, sf_dir: str, **options) -> Engine:
    out = Engine(spark, **options)
    out.register_parquet(sf_dir, "region", "nation")
    return out


def _shown(query: str, form: str, **options) -> Callable:
    """The lines of a result in a format."""
    return lambda spark, sf_dir: _lines(spark, render(_tables(spark, sf_dir).sql(query), form, **options))


def _json(spark, sf_dir):
    found = json.loads(render(_tables(spark, sf_dir).sql("select n_nationkey as k, n_name as name, n_regionkey = 1 as one from nation"), "json"))
    return spark.createDataFrame([(r["k"], r["name"], r["one"], found["type"], found["count"]) for r in found["data"]], "k long, name string, one boolean, type string, count long")


def _refused(spark, sf_dir):
    """What tables say of columns that hold maps and arrays of them."""
    engine, out = _tables(spark, sf_dir), []
    engine.register("odd", spark.sql("select array(struct('a' as title, 1 as n)) as h, struct(1 as x) as m, array(1, 2) as fine"))
    for query in ("select h from odd", "select m from odd", "select fine from odd", "select h.map('title') as t from odd"):
        try:
            render(engine.sql(query), "csv")
            out.append((query, None))
        except QueryError as e:
            out.append((query, str(e)))
    return spark.createDataFrame(out, "query string, message string")


def _command(*argv: str, text: str = "", config: str = "", out: str = "", env: dict | None = None) -> Callable:
    """The lines that the command line prints, or writes to the file ``out``, over a folder of notes named {d}."""
    def run(spark, sf_dir):
        from mdframe.cli import main

        where = folder(spark, sf_dir)
        os.makedirs(os.path.join(where, ".settings", "mdframe"))
        with open(os.path.join(where, ".settings", "mdframe", "config.yaml"), "w", encoding="utf-8") as f:
            f.write(config)
        printed, stdin = io.StringIO(), sys.stdin
        kept = dict(os.environ)
        try:
            sys.stdin = io.StringIO(text)
            os.environ |= {"XDG_CONFIG_HOME": os.path.join(where, ".settings"), "COLUMNS": "80"} | (env or {})
            with contextlib.redirect_stdout(printed):
                code = main([a.replace("{d}", where) for a in argv], spark)
        finally:
            sys.stdin = stdin
            os.environ.clear()
            os.environ.update(kept)
        if code:
            raise QueryError(f"the command line returned {code}")
        if out:
            with open(os.path.join(where, out), encoding="utf-8") as f:
                return _lines(spark, f.read())
        return _lines(spark, printed.getvalue())

    return run


def _hooks(spark, sf_dir):
    """A statement made smaller before it runs, rows left out as a table is read, values changed as they are read, and a name of the context."""
    seen = []
    engine = _tables(
        spark, sf_dir, context={"limit_key": 20},
        hooks={
            "on_before_execute": lambda s: (seen.append(type(s).__name__), s)[1] if not isinstance(s, t.Select) else t.Select(s.fields, True, *[getattr(s, n) for n in ("table", "alias", "joins", "where")]),
            "on_after_read": lambda frame: frame.where(F.col(frame.columns[0]) > 2),
            "on_evaluate_value": lambda column, name: F.lower(column) if name == "n_name" else column,
        },
    )
    return engine.sql("select n_name as name, n_nationkey as k from nation where n_nationkey < limit_key").frame


RULE = "SELECT '{0}' || repeat('─', (SELECT max(greatest(1, length(n_nationkey::VARCHAR))) FROM nation)::INT + {3}) || '{1}' || repeat('─', (SELECT max(length(n_name)) FROM nation)::INT + {3}) || '{2}' AS line"
CELLS = (
    "'│{0}' || rpad({1}, (SELECT max(length(n_nationkey::VARCHAR)) FROM nation)::INT, ' ') || ' │{0}' || rpad({2}, (SELECT max(length(n_name)) FROM nation)::INT, ' ') || ' │'"
)
TITLES = {"none": "n nationkey", "upper": "N NATIONKEY", "capitalize": "N Nationkey", "camel-case": "nNationkey", "pascal-case": "NNationkey"}
NOTES = "FROM nation WHERE n_regionkey <> 4"

# name: (query, DuckDB SQL)
OUTPUT: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "out_json": (_json, "SELECT n_nationkey::BIGINT AS k, n_name AS name, n_regionkey = 1 AS one, 'select' AS type, (SELECT count(*) FROM nation) AS count FROM nation"),
    "out_csv": (
        _shown("""select n_nationkey, "=" + n_name as f, n_name + ',"x"' as q, [n_regionkey, 7] as a from nation""", "csv"),
        "SELECT 'n_nationkey,f,q,a' AS line UNION ALL SELECT n_nationkey || ',''=' || n_name || ',\"' || n_name || ',\"\"x\"\"\",\"' || n_regionkey || ',7\"' FROM nation",
    ),
    "out_table": (
        _shown("select n_nationkey as k, n_name as name from nation", "table", total=200),
        RULE.format("┌", "┬", "┐", 2) + " UNION ALL SELECT " + CELLS.format(" ", "'K'", "'NAME'") + " UNION ALL SELECT line FROM (" + RULE.format("├", "┼", "┤", 2) + ") x, nation"
        " UNION ALL SELECT " + CELLS.format(" ", "n_nationkey::VARCHAR", "n_name") + " FROM nation UNION ALL " + RULE.format("└", "┴", "┘", 2),
    ),
    "out_compact": (
        _shown("select n_nationkey as k, n_name as name from nation", "table", total=200, compact=True),
        RULE.format("┌", "┬", "┐", 1) + " UNION ALL SELECT " + CELLS.format("", "'K'", "'NAME'") + " UNION ALL " + RULE.format("├", "┼", "┤", 1) +
        " UNION ALL SELECT " + CELLS.format("", "n_nationkey::VARCHAR", "n_name") + " FROM nation UNION ALL " + RULE.format("└", "┴", "┘", 1),
    ),
    "out_widths": (
        _shown("select n_name as a, n_name + ' of the world' as b from nation where n_nationkey = 3", "table", total=40, spec="10,12", compact=True),
        "SELECT unnest(['┌───────────┬─────────────┐', '│A          │B            │', '├───────────┼─────────────┤']) AS line UNION ALL SELECT '│' || rpad(n_name, 10, ' ') || ' │' || rpad(n_name || ' of', 12, ' ') || ' │' FROM nation WHERE n_nationkey = 3 "
        "UNION ALL SELECT unnest(['│           │the world    │', '└───────────┴─────────────┘'])",
    ),
    "out_trim": (
        _shown("select n_name + '|' + n_name as a, ' ' + n_name + '|' as b from nation where n_nationkey = 1", "table", total=80, trim="1,0", compact=True),
        "SELECT unnest(['┌──────────────────┬───────────┐', '│A                 │B          │', '├──────────────────┼───────────┤', '└──────────────────┴───────────┘']) AS line "
        "UNION ALL SELECT '│' || n_name || ' ' || n_name || ' │ ' || n_name || '| │' FROM nation WHERE n_nationkey = 1",
    ),
    "out_titles": (
        lambda spark, sf_dir: spark.createDataFrame([(form, header(spark.read.parquet(f"{sf_dir}/nation.parquet").columns[0], form)) for form in TITLES], "form string, title string"),
        "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in TITLES.items()) + ") v(form, title)",
    ),
    "out_colors": (
        _command("--dir", "{d}", "--color", "--compact", "--table", "select title where region = 0 and rank = 0", env={"MDFRAME_COLORS": "1;31"}),
        "SELECT unnest(['┌─────────┐', '│' || chr(27) || '[1;31mTITLE   ' || chr(27) || '[0m │', '├─────────┤', '│NATION_0 │', '└─────────┘']) AS line",
    ),
    "out_refused": (
        _refused,
        "SELECT * FROM (VALUES ('select h from odd', 'Scalar value error: column h is an array of maps, which table and csv cannot show; try h.map(''title'') or --json'), "
        "('select m from odd', 'Scalar value error: column m is a map, which table and csv cannot show; try m.x or --json'), ('select fine from odd', NULL), ('select h.map(''title'') as t from odd', NULL)) v(query, message)",
    ),
    "command_csv": (_command("--dir", "{d}", "--csv", "select title, region where has(title)"), f"SELECT 'title,region' AS line UNION ALL SELECT n_name || ',' || n_regionkey {NOTES}"),
    "command_out_file": (_command("--dir", "{d}", "-o", "{d}/out/r.csv", "select title where region = 1", out="out/r.csv"), "SELECT 'title' AS line UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "command_query_input": (_command("--dir", "{d}", "--csv", "-", text="select title where region = 2"), "SELECT 'title' AS line UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 2"),
    "command_path_input": (_command("--dir", "{d}", "--csv", "-f", "-", "select title", text="0/NATION_0.md\n1/NATION_1.md\n"), "SELECT 'title' AS line UNION ALL SELECT n_name FROM nation WHERE n_nationkey IN (0, 1)"),
    "command_folder_list": (_command("--dir", "{d}/0,", "{d}/3", "--csv", "select title"), "SELECT 'title' AS line UNION ALL SELECT n_name FROM nation WHERE n_regionkey IN (0, 3)"),
    "command_settings": (_command("--dir", "{d}", "select title where region = 3", config="format: csv\nunknown: 1\n"), "SELECT 'title' AS line UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 3"),
    "command_update": (
        _command("--dir", "{d}", "-y", "update where region = 1 and rank > 0 set rank = 0"),
        "SELECT count(*) || ' updated' AS line FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 0 AND n_nationkey > 0",
    ),
    "hooks": (_hooks, "SELECT DISTINCT lower(n_name) AS name, n_nationkey AS k FROM nation WHERE n_nationkey > 2 AND n_nationkey < 20"),
}
