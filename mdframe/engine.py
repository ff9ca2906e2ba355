"""The engine: tables, hooks, statements."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from mdframe.functions import scalar
from mdframe.lang import parse
from mdframe.lang import tree as t
from mdframe.lang.tokens import QueryError
from mdframe.plans.compiler import Compiler
from mdframe.shipping import ship


@dataclass
class Table:
    """A named DataFrame; ``directory`` is where the files of a document table are."""

    frame: DataFrame
    directories: tuple[str, ...] = ()
    errors: DataFrame | None = None


@dataclass
class QueryResult:
    """A statement's outcome: lazy ``frame``, or counts of changed documents."""

    type: str
    frame: DataFrame | None = None
    columns: list[str] = field(default_factory=list)
    updated: int = 0
    created: int = 0
    deleted: int = 0
    meta: dict = field(default_factory=dict)
    action: tuple[str, tuple] | None = None

    def rows(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.frame.collect()] if self.frame is not None else []


def copy_names(result: QueryResult) -> bool:
    """Copy a line for each row to the clipboard: its filename, else its title, else nothing."""
    from mdframe.output import clipboard

    named = [c for c in ("filename", "title") if c in result.columns]
    rows = result.frame.select(*named).toLocalIterator() if named else ((),) * result.frame.count()
    return clipboard.copy("\n".join(str(next((v for v in r if v), "")) for r in rows))


class Engine:
    """Runs query texts over registered DataFrames and directories of documents.

    ``hooks``: ``on_before_execute(statement)``, ``on_after_read(frame)``, ``on_evaluate_value(column, name)``, ``on_before_write(row, kind)`` and
    ``on_error({path, error, phase})`` for each file that cannot be read. ``actions`` are what a pipe calls, with the result and its arguments;
    an unknown one changes nothing. A trigger statement holds for the default table from then on.
    """

    def __init__(self, spark: SparkSession, context: dict | None = None, hooks: dict[str, Callable] | None = None, actions: dict[str, Callable] | None = None) -> None:
        ship(spark)
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.functions: dict[str, Callable[..., Column]] = {}
        self.context = context or {}
        self.hooks = hooks or {}
        self.actions = {"clipboard": copy_names} | (actions or {})
        self.triggers: dict[str | None, list] = {}
        self.default: str | None = None

    def register(self, name: str, frame: DataFrame, directories: tuple[str, ...] = (), errors: DataFrame | None = None) -> None:
        """Make a DataFrame a table; the first is the one that a query without FROM reads."""
        hook = self.hooks.get("on_after_read")
        self.tables[name] = Table(hook(frame) if hook else frame, directories, errors)
        self.default = self.default or name

    def register_parquet(self, folder: str, *names: str) -> None:
        """Make parquet tables known; each is opened when a query first names it."""
        for name in names:
            self.register_lazy(name, lambda name=name: self.spark.read.parquet(f"{folder}/{name}.parquet"))

    def register_lazy(self, name: str, make: Callable[[], DataFrame]) -> None:
        self.tables[name] = make
        self.default = self.default or name

    def register_directory(self, *directories: str, name: str = "documents", **options) -> None:
        """Make the markdown files under directories a table."""
        from mdframe.sources.documents import read_documents

        frame, errors = read_documents(self.spark, directories, **options)
        report = self.hooks.get("on_error")
        for row in errors.toLocalIterator() if report else ():
            report(row.asDict())
        self.register(name, frame, tuple(directories), errors)
        self.default = name

    def register_function(self, name: str, fn: Callable[..., Column], returns=None) -> None:
        """A function of columns, found before the built-in ones."""
        if returns is not None:
            fn.returns = returns
        self.functions[scalar.key(name)] = fn

    def table(self, name: str | None) -> Table:
        name = name or self.default
        if name in self.tables:
            if callable(self.tables[name]):
                self.register(name, self.tables[name]())
            return self.tables[name]
        if name is not None and self.spark.catalog.tableExists(name):
            return Table(self.spark.table(name))
        raise QueryError(f"Unknown table: {name}")

    def sql(self, text: str) -> QueryResult:
        """Run a query text. A select is lazy; update, create and delete of a document table write files."""
        began = time.time()
        statement = parse(text)
        hook = self.hooks.get("on_before_execute")
        statement = hook(statement) or statement if hook else statement
        out = self.execute(statement)
        out.meta.setdefault("timings", {})["plan"] = time.time() - began
        return out

    def execute(self, statement) -> QueryResult:
        compiler = Compiler(self)
        match statement:
            case t.Pipe(inner, name, args):
                out = self.execute(inner)
                out.action = (name, args)
                if name in self.actions and out.frame is not None:
                    self.actions[name](out, *args)
                return out
            case t.Select():
                frame, columns = compiler.select(statement)
                return QueryResult("select", frame, columns)
            case t.Union():
                frame, columns = compiler.union(statement)
                return QueryResult("union", frame, columns)
        from mdframe.operators import mutate

        return mutate.execute(self, compiler, statement)

    def explain(self, text: str) -> str:
        """The physical plan of a select."""
        frame = self.sql(text).frame
        return frame._jdf.queryExecution().toString()
