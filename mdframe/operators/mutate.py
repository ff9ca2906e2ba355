"""Update, create, delete and triggers: as new DataFrames, and on the files of a document table."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdframe.engine import QueryResult
from mdframe.lang import parse
from mdframe.lang import tree as t
from mdframe.lang.tokens import QueryError
from mdframe.plans.compiler import Scope, quoted
from mdframe.plans.values import BOOL, DOUBLE, STRING, TIME, Val, to_bool, to_number, to_text, to_time

CHANGED, OLD = "__changed", "__old"
IMMUTABLE = ("createdAt", "updatedAt")
TARGETS = ("abspath", "path", "file", "filename", "filepath")


def converted(v: Val, hint: str | None) -> Val:
    """A value under a type hint; an unknown hint changes nothing."""
    match hint:
        case "string":
            return Val(to_text(v), STRING)
        case "number":
            return Val(to_number(v).cast("double"), DOUBLE)
        case "boolean":
            return Val(to_bool(v), BOOL)
        case "date":
            return Val(to_time(v), TIME)
        case "array" if not v.is_array:
            return Val(F.array(v.col), T.ArrayType(v.type))
    return v


def scope_of(frame: DataFrame, **variables: Val) -> Scope:
    return Scope({f.name: Val(quoted(f.name), f.dataType) for f in frame.schema}, body="body" in frame.columns, variables=variables)


def updated_frame(compiler, frame: DataFrame, statement: t.Update, triggers: list[t.Trigger] = ()) -> DataFrame:
    """All rows, with the assigned columns changed where the condition holds; later assignments see earlier ones, triggers see all."""
    test = F.coalesce(to_bool(compiler.expr(statement.where, scope_of(frame))), F.lit(False)) if statement.where is not None else F.lit(True)
    out = frame.select("*", test.alias(CHANGED), *([F.struct(*[quoted(c) for c in frame.columns]).alias(OLD)] if triggers else []))
    out = assigned(compiler, out, statement.assigns, quoted(CHANGED), lambda f: scope_of(f))
    return fired(compiler, out, triggers, frame).drop(OLD)


def assigned(compiler, frame: DataFrame, assigns, test, scope) -> DataFrame:
    """A frame with columns set where ``test`` holds; ``scope`` of the frame so far says what names mean."""
    for a in assigns:
        v = converted(compiler.expr(a.expr, scope(frame)), a.hint)
        if a.name in frame.columns:
            kind = frame.schema[a.name].dataType
            new = v.col.cast(kind) if v.is_null or v.type != kind and not (v.is_array and isinstance(kind, T.ArrayType)) else v.col
            frame = frame.withColumn(a.name, F.when(test, new).otherwise(quoted(a.name)))
        else:
            frame = frame.withColumn(a.name, F.when(test, v.col))
    return frame


def fired(compiler, frame: DataFrame, triggers: list[t.Trigger], before: DataFrame | None) -> DataFrame:
    """What triggers make of changed rows (``CHANGED``) whose old state is in ``OLD``: one that denies raises its message if any row meets it."""
    own = lambda f: [x for x in f.schema if x.name not in (CHANGED, OLD)]

    def scope(f: DataFrame) -> Scope:
        new = Val(F.struct(*[quoted(x.name) for x in own(f)]), T.StructType(own(f)))
        old = Val(F.col(OLD), T.StructType(before.schema.fields)) if before is not None else Val(F.lit(None), T.NullType())
        return scope_of(f, old=old, new=new)

    for trigger in triggers:
        meets = F.coalesce(to_bool(compiler.expr(trigger.where, scope(frame))), F.lit(False)) if trigger.where is not None else F.lit(True)
        test = quoted(CHANGED) & meets
        if trigger.deny is None:
            frame = assigned(compiler, frame, trigger.assigns, test, scope)
        elif frame.where(test).take(1):
            raise QueryError(trigger.deny)
    return frame


def trigger_frame(engine, text: str, old: DataFrame, new: DataFrame, key: str | None = None) -> DataFrame:
    """Rows of ``new`` with what a trigger does to them: ``denied`` (its message) or the columns that it sets.

    ``old`` and ``new`` are joined on ``key``, by default the first column; where the two are one frame, each row is its own old one.
    """
    from mdframe.plans.compiler import Compiler

    statement = parse(text)
    if statement.run is not None:
        raise QueryError("trigger run commands are not supported")
    key = key or new.columns[0]
    pack = lambda f, name: F.struct(*[quoted(c) for c in f.columns]).alias(name)
    if old is new:
        both = new.select("*", pack(new, "old"), pack(new, "new"))
    else:
        both = new.select("*", pack(new, "new")).join(old.select(quoted(key).alias("__k"), pack(old, "old")), F.col("__k") == quoted(key), "left").drop("__k")
    scope = scope_of(both, old=Val(F.col("old"), T.StructType(old.schema.fields)), new=Val(F.col("new"), T.StructType(new.schema.fields)))
    compiler = Compiler(engine)
    fires = F.coalesce(to_bool(compiler.expr(statement.where, scope)), F.lit(False)) if statement.where is not None else F.lit(True)
    if statement.deny is not None:
        return both.select(*[quoted(c) for c in new.columns], F.when(fires, F.lit(statement.deny)).alias("denied"))
    values = {a.name: converted(compiler.expr(a.expr, scope), a.hint) for a in statement.assigns}
    kept = [F.when(fires, values[c].col.cast(new.schema[c].dataType)).otherwise(quoted(c)).alias(c) if c in values else quoted(c) for c in new.columns]
    return both.select(*kept, *[F.when(fires, v.col).alias(c) for c, v in values.items() if c not in new.columns])


def execute(engine, compiler, statement) -> QueryResult:
    name = engine.default
    if isinstance(statement, t.Trigger):
        if statement.run is not None:
            raise QueryError("trigger run commands are not supported")
        engine.triggers.setdefault(name, []).append(statement)
        return QueryResult("trigger")
    table = engine.table(name) if name else None
    of = lambda event: sorted((x for x in engine.triggers.get(name, ()) if x.event == event), key=lambda x: x.timing != "before")
    match statement:
        case t.Update():
            for a in statement.assigns:
                if a.name in IMMUTABLE:
                    raise QueryError(f"cannot update immutable field '{a.name}'")
            changed = updated_frame(compiler, table.frame, statement, of("update"))
            if table.directories:
                return _update_files(engine, table, changed, statement)
            return QueryResult("update", changed.drop(CHANGED))
        case t.Delete():
            if statement.where is None:
                raise QueryError("delete requires a where clause")
            test = F.coalesce(to_bool(compiler.expr(statement.where, scope_of(table.frame))), F.lit(False))
            if of("delete"):  # the new row of a deletion is the old one; only denials have a meaning
                gone = table.frame.where(test).select("*", F.lit(True).alias(CHANGED), F.struct(*[quoted(c) for c in table.frame.columns]).alias(OLD))
                fired(compiler, gone, [x for x in of("delete") if x.deny is not None], table.frame)
            if table.directories:
                return _delete_files(engine, table, test, statement)
            return QueryResult("delete", table.frame.where(~test))
        case t.Create():
            if table is not None and not table.directories:
                return _create_row(compiler, table, statement, of("create"))
            return _create_file(engine, compiler, table, statement, of("create"))
    raise QueryError(f"Unexpected token in statement: {statement}")


def _create_row(compiler, table, statement: t.Create, triggers: list[t.Trigger]) -> QueryResult:
    one = table.frame.sparkSession.range(1)
    values = {a.name: converted(compiler.expr(a.expr, Scope({})), a.hint) for a in statement.assigns}
    row = one.select(*[(values[f.name].col if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.frame.schema])
    row = fired(compiler, row.withColumn(CHANGED, F.lit(True)), triggers, None).drop(CHANGED)
    return QueryResult("create", table.frame.unionByName(row, allowMissingColumns=True), created=1)


def _no_match(where: t.Expr | None) -> QueryError:
    if isinstance(where, t.Binary) and where.op == "=" and isinstance(where.left, t.Name) and isinstance(where.right, t.Literal):
        return QueryError(f"no file with {where.left.name} '{where.right.value}'")
    return QueryError("no files matched the query")


def _settled(engine, frame: DataFrame) -> DataFrame:
    """Rows that stay as they are while their files change. Where executors may be lost they go to the checkpoint folder, as a repeated task
    would read files that it has changed."""
    context = engine.spark.sparkContext
    if context.getCheckpointDir() is None and context.getConf().get("spark.checkpoint.dir", None):
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir"))
    if context.getCheckpointDir() is not None:
        return frame.checkpoint()
    if not context.master.startswith("local"):
        raise QueryError("set spark.checkpoint.dir to change files on a cluster")
    return frame


def _update_files(engine, table, changed: DataFrame, statement: t.Update) -> QueryResult:
    from mdframe.sources.documents import own_fields, write_document, write_rows

    changed, frame = _settled(engine, changed.where(CHANGED)), table.frame
    names = own_fields(frame) + [c for c in changed.columns if c not in frame.columns and c != CHANGED]
    assigned = [a.name for a in statement.assigns] + [c for c in changed.columns if c not in frame.columns and c != CHANGED]
    assigned += [a.name for x in engine.triggers.get(engine.default, ()) if x.event == "update" for a in x.assigns]
    hook, n = engine.hooks.get("on_before_write"), 0
    if hook is None:
        n = write_rows(changed, names, assigned)
    for row in changed.toLocalIterator() if hook else ():  # a hook is called here, with each row
        values = row.asDict(recursive=True)
        hook(values, "update")
        present = {*(values.get("__keys") or ()), *assigned}
        write_document(values["abspath"], {k: values.get(k) for k in names if k in present} | {"updatedAt": dt.datetime.now(dt.UTC)}, values.get("body") or "")
        n += 1
    if not n:
        raise _no_match(statement.where)
    return QueryResult("update", updated=n)


def _delete_files(engine, table, test, statement: t.Delete) -> QueryResult:
    from mdframe.sources.documents import remove_files

    n = remove_files(_settled(engine, table.frame.where(test).select("abspath")))
    if not n:
        raise _no_match(statement.where)
    return QueryResult("delete", deleted=n)


def _create_file(engine, compiler, table, statement: t.Create, triggers: list[t.Trigger]) -> QueryResult:
    from mdframe.sources.documents import write_document

    one = engine.spark.range(1)
    values = {a.name: converted(compiler.expr(a.expr, Scope({})), a.hint) for a in statement.assigns}
    made = fired(compiler, one.select(*[v.col.alias(k) for k, v in values.items()], F.lit(True).alias(CHANGED)), triggers, None).drop(CHANGED)
    row = made.first().asDict(recursive=True) if values else {}
    target = next((row[k] for k in TARGETS if row.get(k)), None)
    if not target:
        raise QueryError("create requires path to file")
    target = target if target.endswith(".md") else f"{target}.md"
    if not os.path.isabs(target):
        target = os.path.join(table.directories[0] if table else ".", target)
    now = dt.datetime.now(dt.UTC)
    fields = {k: v for k, v in row.items() if k not in TARGETS and k != "body"} | {"createdAt": now, "updatedAt": now}
    hook = engine.hooks.get("on_before_write")
    if hook:
        hook(fields, "create")
    write_document(target, fields, row.get("body") or "")
    return QueryResult("create", created=1)
