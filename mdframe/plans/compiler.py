"""Binds a syntax tree to DataFrames: names to columns, statements to lazy plans."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdframe.functions import content, scalar
from mdframe.functions.methods import call_method
from mdframe.lang import tree as t
from mdframe.lang.tokens import QueryError
from mdframe.plans.values import BOOL, DOUBLE, LONG, STRING, Val, arithmetic, compare, contains_item, java_regex, lit, to_bool, to_number, to_text

AGGREGATES = ("count", "sum", "avg", "min", "max")
HIDDEN = "__"
#: Bytes of a table for each core under which its rows are dealt out before a parse; larger ones have splits enough.
SPREAD_BYTES = 64 << 20
#: Columns that only name the document; ``*`` shows the first five.
IDENTITY = ("filename", "path", "abspath", "filepath", "source_dir")
LARGE = ("body", "content", "sections", "metadata", "frontmatter", "_filename", "_path", "_content")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Scope:
    """What names mean: columns of the input, qualified columns, items of enclosing lambdas, and what a grouping has made."""

    columns: dict[str, Val]
    qualified: dict[str, dict[str, Val]] = field(default_factory=dict)
    items: tuple[Val, ...] = ()
    made: dict[t.Expr, Val] = field(default_factory=dict)
    outer: Scope | None = None
    variables: dict[str, Val] = field(default_factory=dict)
    body: bool = False
    strict: bool = False

    def within(self, item: Val) -> Scope:
        return Scope(self.columns, self.qualified, (*self.items, item), self.made, self.outer, self.variables, self.body, self.strict)

    def find(self, name: str) -> Val | None:
        if name in self.variables:
            return self.variables[name]
        for item in reversed(self.items):
            if name == "_":
                return item
            if item.is_struct and name in item.type.fieldNames():
                return Val(item.col.getField(name), item.type[name].dataType)
        return self.columns.get(name)


def inner_prefix(outer: Scope | None) -> str:
    """What the columns of a subquery begin with, by its depth; nothing for the outermost query."""
    depth = 0
    while outer is not None:
        outer, depth = outer.outer, depth + 1
    return f"{HIDDEN}in{depth}." if depth else ""


class Compiler:
    """Compiles for an engine, which gives tables, hooks and registered functions."""

    def __init__(self, engine) -> None:
        self.engine = engine

    # -- expressions

    def expr(self, node: t.Expr, scope: Scope) -> Val:
        if node in scope.made:
            return scope.made[node]
        match node:
            case t.Literal(value):
                return lit(value)
            case t.Empty():
                return lit(None)
            case t.Regex(pattern, flags):
                return Val(F.lit(java_regex(pattern, flags)), STRING, (pattern, flags))
            case t.Name(name):
                return self.name(name, scope)
            case t.Array(items):
                return self.array([self.expr(x, scope) for x in items])
            case t.Get(of, key):
                return self.get(of, key, scope)
            case t.Index(of, index):
                return self.index(self.expr(of, scope), self.expr(index, scope))
            case t.Binary("and", left, right):
                return Val(to_bool(self.expr(left, scope)) & to_bool(self.expr(right, scope)), BOOL)
            case t.Binary("or", left, right):
                return Val(to_bool(self.expr(left, scope)) | to_bool(self.expr(right, scope)), BOOL)
            case t.Binary(op, left, right) if op in ("+", "-", "*", "/", "%", "^"):
                return arithmetic(op, self.expr(left, scope), self.expr(right, scope))
            case t.Binary(op, left, right):
                return Val(compare(op, self.expr(left, scope), self.expr(right, scope), scope.strict), BOOL)
            case t.Unary("not", of):
                return Val(~to_bool(self.expr(of, scope)), BOOL)
            case t.Unary("-", of):
                v = self.expr(of, scope)
                return Val(-to_number(v), v.type if v.is_number else DOUBLE)
            case t.IsEmpty(of, negated):
                v = self.expr(of, scope)
                test = v.col.isNull() | (v.col == "") if v.is_string else v.col.isNull()
                return Val(~test if negated else test, BOOL)
            case t.In(of, items, negated):
                return self.membership(of, items, negated, scope)
            case t.Quantified(which, op, left, right):
                return self.quantified(which, op, self.expr(left, scope), self.expr(right, scope))
            case t.Call(name, args):
                return self.call(name, args, scope)
            case t.Method(of, _, _):
                return call_method(
                    self.expr(of, scope), node, lambda a: self.expr(a, scope),
                    lambda a, kind: lambda x: self.expr(a, scope.within(Val(x, kind))),
                )
            case t.Exists(query):
                return Val(self.subquery(query, scope).exists(), BOOL)
            case t.Subquery(query):
                frame = self.subquery(query, scope)
                return Val(frame.scalar(), self.types[0])
        raise QueryError(f"Cannot use {t.label(node)} here")

    def name(self, name: str, scope: Scope) -> Val:
        found = scope.find(name)
        if found is not None:
            hook = self.engine.hooks.get("on_evaluate_value")
            return Val(hook(found.col, name), found.type) if hook and not scope.items else found
        if scope.body and name in content.BARE:
            return self.call(name, (), scope)
        if name in self.engine.context:
            return lit(self.engine.context[name])
        return lit(None)  # an absent field

    def array(self, items: list[Val]) -> Val:
        kinds = [v.type for v in items if not v.is_null]
        if not kinds:
            return Val(F.array(*[v.col for v in items]), T.ArrayType(T.NullType()))
        kind = kinds[0] if all(k == kinds[0] for k in kinds) else DOUBLE if all(isinstance(k, T.NumericType) for k in kinds) else STRING
        cols = [v.col.cast(kind) if kind != STRING or v.is_string or v.is_null else to_text(v) for v in items]
        return Val(F.array(*cols), T.ArrayType(kind), [v.plain for v in items])

    def get(self, of: t.Expr, key: str, scope: Scope) -> Val:
        if isinstance(of, t.Name):
            if of.name == "outer" and scope.outer is not None and "outer" not in scope.columns:
                found = scope.outer.find(key)
                if found is None:
                    raise QueryError(f"outer has no field {key}")
                return _outer(found) if not scope.outer.items else found
            if of.name in scope.qualified and scope.find(of.name) is None:
                found = scope.qualified[of.name].get(key)
                return found if found is not None else lit(None)
            if of.name == "body" and scope.body and key in content.NAMES:
                return self.call(key, (), scope)
        v = self.expr(of, scope)
        if v.is_struct and key in v.type.fieldNames():
            return Val(v.col.getField(key), v.type[key].dataType)
        if v.is_map:
            return Val(F.try_element_at(v.col, F.lit(key)), v.type.valueType)
        if v.is_array and isinstance(v.type.elementType, T.StructType) and key in v.type.elementType.fieldNames():
            return Val(v.col.getField(key), T.ArrayType(v.type.elementType[key].dataType))
        if isinstance(v.type, T.VariantType):
            return Val(F.try_variant_get(v.col, F.lit(f"$.{key}"), "string"), STRING)
        if v.is_string and key.isidentifier():
            return Val(F.get_json_object(v.col, f"$.{key}"), STRING)
        if v.is_null:
            return lit(None)
        raise QueryError("Cannot index non-object")

    def index(self, of: Val, index: Val) -> Val:
        if of.is_null:
            return lit(None)
        if not of.is_array:
            raise QueryError("Cannot index non-array")
        if not index.is_number:
            raise QueryError("Array index must be number")
        kind = of.type.elementType
        if isinstance(index.plain, int):
            return Val(F.get(of.col, F.lit(index.plain)) if index.plain >= 0 else F.try_element_at(of.col, F.lit(index.plain)), kind)
        at = index.col.cast("int")
        return Val(F.when(at >= 0, F.get(of.col, at)).otherwise(F.get(of.col, F.size(of.col) + at)), kind)

    def membership(self, of: t.Expr, items, negated: bool, scope: Scope) -> Val:
        v = self.expr(of, scope)
        if isinstance(items, t.Subquery):
            inner = items.select
            test = t.Binary("=", inner.fields[0].expr, _Given(v))
            having = t.Binary("and", inner.having, test) if inner.having is not None and inner.group else None
            grouped = bool(inner.group) or any(isinstance(n, t.Call) and n.name in AGGREGATES for n in t.walk(inner.fields[0].expr))
            if grouped:
                query = t.Select(inner.fields, False, inner.table, inner.alias, inner.joins, inner.where, inner.group, having or test)
            else:
                where = t.Binary("and", inner.where, test) if inner.where is not None else test
                query = t.Select(inner.fields, False, inner.table, inner.alias, inner.joins, where)
            found = self.subquery(query, scope, outer_value=v).exists()
        elif isinstance(items, tuple):
            values = [self.expr(x, scope) for x in items]
            found = F.lit(False)
            same = [x for x in values if x.type == v.type or x.is_number and v.is_number]
            if same and len(same) == len(values) and all(x.plain is not None for x in values):
                found = F.coalesce(v.col.isin(*[x.plain for x in values]), F.lit(False))
            else:
                for x in values:
                    found = found | F.coalesce(compare("=", v, x), F.lit(False))
        else:
            holder = self.expr(items, scope)
            if holder.is_array:
                found = contains_item(holder, v)
            elif v.is_array:
                found = contains_item(v, holder)
            else:
                found = F.coalesce(compare("=", v, holder), F.lit(False))
        return Val(~found if negated else found, BOOL)

    def quantified(self, which: str, op: str, left: Val, right: Val) -> Val:
        if not left.is_array:
            return Val(F.lit(False), BOOL)
        test = lambda x: F.coalesce(compare(op, Val(x, left.type.elementType), right), F.lit(False))
        whole = F.exists(left.col, test) if which == "any" else F.forall(left.col, test)
        return Val(F.coalesce(whole, F.lit(False)), BOOL)

    def call(self, name: str, args: tuple[t.Expr, ...], scope: Scope) -> Val:
        own = self.engine.functions.get(scalar.key(name))
        if own is not None:
            out = own(*[self.expr(a, scope).col for a in args])
            return out if isinstance(out, Val) else Val(out, getattr(own, "returns", STRING))
        if name == "count" and len(args) == 1 and isinstance(args[0], t.Subquery):
            query = args[0].select
            frame = self.subquery(t.Select((t.Field(t.Call("count", (t.Star(),)), "n"),), False, query.table, query.alias, query.joins, query.where), scope)
            return Val(frame.scalar(), LONG)
        if name == "has":
            return Val(self.expr(args[0], scope).col.isNotNull(), BOOL)
        if name == "fields":
            return self.fields([self.expr(a, scope) for a in args], scope)
        if name == "file":
            if args:
                raise QueryError("file() takes no arguments")
            return scope.columns.get("metadata") or lit(None)
        if name == "id" and not args:
            v = scope.columns.get("id")
            return Val(F.coalesce(to_text(v), F.lit("")), STRING) if v else lit("")
        if name == "user" and "user" in scope.columns:
            return scope.columns["user"]
        if name in content.NAMES and (scope.body or name == "grep" and len(args) > 1):
            index = scope.columns.get(f"{HIDDEN}index")
            flat = [y for x in args for y in (x.items if isinstance(x, t.Array) else (x,))]
            return content.call_content(name, [self.expr(a, scope) for a in flat], index, scope.columns.get("body"))
        return scalar.call(name, [self.expr(a, scope) for a in args])

    def fields(self, args: list[Val], scope: Scope) -> Val:
        kind = T.MapType(STRING, STRING)
        own = scope.columns.get("frontmatter")
        if own is None:
            shown = {k: v for k, v in scope.columns.items() if not k.startswith(HIDDEN) and k not in LARGE}
            own = Val(F.create_map(*[x for k, v in shown.items() for x in (F.lit(k), to_text(v))]), kind)
        if not args:
            return Val(own.col, kind)
        pattern = args[0].plain
        if pattern == "values":
            return Val(F.map_values(own.col), T.ArrayType(STRING))
        if len(args) > 1 and args[1].plain:
            return Val(F.map_filter(own.col, lambda k, _: scalar.wildcard(k, pattern)), kind)
        return Val(F.filter(F.map_keys(own.col), lambda k: scalar.wildcard(k, pattern)), T.ArrayType(STRING))

    # -- select

    def subquery(self, query: t.Select, scope: Scope, outer_value: Val | None = None) -> DataFrame:
        """A query below another; columns of the outer one are read with ``outer.name``, or with its alias."""
        self.outer_value = outer_value
        return self.select(query, scope)[0]

    def select(self, query: t.Select, outer: Scope | None = None) -> tuple[DataFrame, list[str]]:
        """The lazy result of a query and its column names."""
        frame, scope = self.source(query, outer)
        if query.where is not None:
            frame = frame.where(to_bool(self.expr(query.where, scope)))
        fields = self.expand(query.fields, scope)
        needed = [f.expr for f in fields] + [o.expr for o in query.order] + ([query.having] if query.having is not None else [])
        aggregates = list(dict.fromkeys(n for e in needed for n in t.walk(e) if self.is_aggregate(n)))
        if aggregates or query.group:
            frame, scope = self.grouped(frame, scope, query.group, aggregates, needed)
        if query.having is not None:
            frame = frame.where(to_bool(self.expr(query.having, scope)))
        out: dict[str, Val] = {}
        for f in fields:
            out[f.alias or t.label(self.with_calls(f.expr, scope))] = self.expr(f.expr, scope)
        self.types = [v.type for v in out.values()]
        present = self.presence(fields, scope, out)
        keys, hidden = [], {}
        for i, o in enumerate(query.order):
            name = o.expr.name if isinstance(o.expr, t.Name) else t.label(o.expr)
            if name in out and (isinstance(o.expr, t.Name) or o.expr in [f.expr for f in fields]):
                col = quoted(name)
            else:
                hidden[f"{HIDDEN}sort{i}"] = self.expr(o.expr, scope)
                col = quoted(f"{HIDDEN}sort{i}")
            keys.append(col.desc_nulls_last() if o.descending else col.asc_nulls_last())
        tie = scope.columns.get(f"{HIDDEN}ord")
        if tie is not None and not query.distinct and (query.order or query.limit is not None or query.offset):
            hidden[f"{HIDDEN}tie"] = tie
            keys.append(quoted(f"{HIDDEN}tie").asc())
        if present is not None:
            frame = frame.where(present)
        frame = frame.select(*[v.col.alias(n) for n, v in out.items()], *[v.col.alias(n) for n, v in hidden.items() if not query.distinct])
        if query.distinct:
            frame = frame.distinct()
        if keys:
            frame = frame.orderBy(*keys)
        if query.offset:
            frame = frame.offset(int(query.offset))
        if query.limit is not None:
            frame = frame.limit(int(query.limit))
        if hidden and not query.distinct:
            frame = frame.select(*[quoted(n) for n in out])
        return frame, list(out)

    def source(self, query: t.Select, outer: Scope | None) -> tuple[DataFrame, Scope]:
        table = self.engine.table(query.table)
        frame = table.frame
        names = t.walk(query)
        used = {n.name for n in names if isinstance(n, t.Name | t.Call)} | {n.key for n in t.walk(query) if isinstance(n, t.Get)}
        body = "body" in frame.columns
        if body and used & content.NAMES:
            frame = self.spread(frame).withColumn(f"{HIDDEN}index", content.index_column(F.col("body"), used, content.scans_of(query), content.names_of(query)))
        prefix = inner_prefix(outer)
        if prefix:  # a subquery's columns have names of their own, so that those of the outer query stay visible
            frame = frame.select(*[quoted(c).alias(prefix + c) for c in frame.columns]).alias(prefix)  # the alias ends the search for names
        columns = {f.name.removeprefix(prefix): Val(quoted(f.name), f.dataType) for f in frame.schema}
        for short, full in (("_filename", "filename"), ("_path", "path"), ("_content", "body"), ("filepath", "abspath")):
            if full in columns and short not in columns:
                columns[short] = columns[full]
        left = query.alias or query.table
        qualified = {left: dict(columns)} if left else {}
        if query.table:
            qualified.setdefault(query.table, dict(columns))
        context = outer.variables if outer else {}
        scope = Scope(columns, qualified, outer=outer, variables=dict(context), body=body)
        if outer is not None and getattr(self, "outer_value", None) is not None:
            scope.made[_Given(self.outer_value)] = _outer(self.outer_value)
            self.outer_value = None
        for outer_name, cols in (outer.qualified if outer else {}).items():
            scope.qualified.setdefault(outer_name, {k: _outer(v) for k, v in cols.items()})
        for join in query.joins:
            frame, scope = self.join(frame, scope, join)
        return frame, scope

    def spread(self, frame: DataFrame) -> DataFrame:
        """Small tables are dealt out by rows before bodies are parsed: by bytes alone they would be parsed in a task or two."""
        if frame.isStreaming:
            return frame
        session = self.engine.spark
        cores = session.sparkContext.defaultParallelism
        size = int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return frame.repartition(4 * cores) if size < cores * SPREAD_BYTES else frame

    def join(self, left: DataFrame, scope: Scope, join: t.Join) -> tuple[DataFrame, Scope]:
        name = join.alias or join.table
        right = self.engine.table(join.table).frame
        prefix = f"{inner_prefix(scope.outer)}{name}."
        renamed = right.select(*[quoted(c).alias(prefix + c) for c in right.columns])
        own = {c: Val(quoted(prefix + c), right.schema[c].dataType) for c in right.columns}
        columns = dict(scope.columns)
        for c, v in own.items():
            columns[f"{name}.{c}"] = v
            columns.setdefault(c, v)
        qualified = scope.qualified | {name: own} | ({join.table: own} if join.table not in scope.qualified else {})
        merged = Scope(columns, qualified, outer=scope.outer, made=scope.made, variables=scope.variables, body=scope.body)
        if join.kind == "cross":
            return left.crossJoin(renamed), merged
        on = Scope(columns, qualified, outer=scope.outer, variables=scope.variables, strict=True)
        return left.join(renamed, to_bool(self.expr(join.on, on)), join.kind), merged

    def expand(self, fields: tuple[t.Field, ...], scope: Scope) -> list[t.Field]:
        out: list[t.Field] = []
        for f in fields:
            if isinstance(f.expr, t.Star):
                shown = [c for c in scope.columns if not c.startswith(HIDDEN) and "." not in c and c not in LARGE]
                joined = [c for c in scope.columns if "." in c and not c.startswith(HIDDEN)]
                own = set().union(*[set(q) for n, q in scope.qualified.items() if any(j.startswith(f"{n}.") for j in joined)]) if joined else set()
                first = next(iter(scope.qualified.values()), {})
                shown = [c for c in shown if c in first or c not in own]
                if "body" in scope.columns:
                    shown = [c for c in shown if c not in IDENTITY] + [c for c in IDENTITY if c in scope.columns]
                out += [t.Field(t.Name(c)) for c in shown + joined]
            else:
                out.append(f)
        return out

    def with_calls(self, node: t.Expr, scope: Scope) -> t.Expr:
        """The expression with element names that stand alone as calls: ``h1`` is labelled ``h1()``."""
        if isinstance(node, t.Name):
            return t.Call(node.name) if scope.body and node.name in content.BARE and scope.find(node.name) is None else node
        if isinstance(node, t.Method | t.Index | t.Get):
            return dataclasses.replace(node, of=self.with_calls(node.of, scope)) if not (isinstance(node, t.Get) and node.of == t.Name("body")) else node
        return node

    def presence(self, fields: list[t.Field], scope: Scope, out: dict[str, Val]) -> Column | None:
        """For documents: rows in which no selected field is there at all are dropped; an explicit null counts as there."""
        keys = scope.columns.get(f"{HIDDEN}keys")
        if keys is None:
            return None
        tests = []
        for f in fields:
            if isinstance(f.expr, t.Name):
                if f.expr.name in IDENTITY or f.expr.name in LARGE or f.expr.name.startswith("_"):
                    return None
                if f.expr.name in scope.columns:
                    tests.append(F.array_contains(keys.col, f.expr.name))
                    continue
            tests.append(self.expr(f.expr, scope).col.isNotNull())
        test = tests[0]
        for x in tests[1:]:
            test = test | x
        return test

    # -- grouping

    @staticmethod
    def is_aggregate(node: object) -> bool:
        return isinstance(node, t.Call) and node.name in AGGREGATES and not (node.args and isinstance(node.args[0], t.Subquery))

    def grouped(self, frame: DataFrame, scope: Scope, group: tuple[t.Expr, ...], aggregates: list[t.Call], needed: list[t.Expr]) -> tuple[DataFrame, Scope]:
        made: dict[t.Expr, Val] = {}
        keys, columns = [], {}
        for i, g in enumerate(group):
            v = self.expr(g, scope)
            name = f"{HIDDEN}key{i}"
            keys.append(v.col.alias(name))
            made[g] = Val(quoted(name), v.type)
            if isinstance(g, t.Name):
                columns[g.name] = made[g]
        aggs = []
        for i, a in enumerate(aggregates):
            arg = self.expr(a.args[0], scope) if a.args and not isinstance(a.args[0], t.Star) else None
            col, kind = self.aggregate(a.name, arg)
            aggs.append(col.alias(f"{HIDDEN}agg{i}"))
            made[a] = Val(quoted(f"{HIDDEN}agg{i}"), kind)
        bare = self.bare_columns(needed, made, scope)
        tie = scope.columns.get(f"{HIDDEN}ord")
        values = [self.expr(b, scope) for b in bare]
        if bare:
            row = F.struct(*[v.col.alias(f"b{i}") for i, v in enumerate(values)])
            ordered = [v.col for v in values if not isinstance(v.type, T.MapType | T.VariantType)]
            # of documents the first; of other rows, which have no order, the least by these fields, so that a repeated task gives the same
            least = F.min_by(row, tie.col) if tie is not None else F.min(row) if len(ordered) == len(values) else F.min_by(row, F.struct(*ordered, F.to_json(row)))
            aggs.append(least.alias(f"{HIDDEN}first"))
        for i, (b, v) in enumerate(zip(bare, values, strict=True)):
            made[b] = Val(quoted(f"{HIDDEN}first").getField(f"b{i}"), v.type)
            if isinstance(b, t.Name):
                columns[b.name] = made[b]
        aggs = aggs or [F.count(F.lit(1)).alias(f"{HIDDEN}n")]
        frame = frame.groupBy(*keys).agg(*aggs) if keys else frame.select(*aggs)  # select stays lazy about outer columns
        return frame, Scope(columns, {}, made=made, outer=scope.outer, variables=scope.variables)

    def bare_columns(self, needed: list[t.Expr], made: dict, scope: Scope) -> list[t.Expr]:
        """Fields outside aggregates and keys: the first row of a group gives them."""
        out: dict[t.Expr, None] = {}

        def look(node: object) -> None:
            if node in made:
                return
            if isinstance(node, t.Name) and (node.name in scope.columns or scope.body and node.name in content.BARE):
                out[node] = None
            elif isinstance(node, t.Get) and isinstance(node.of, t.Name) and node.of.name in scope.qualified and node.of.name not in scope.columns:
                out[node] = None
            elif isinstance(node, t.Call) and node.name in content.NAMES and scope.body:
                out[node] = None
            elif not isinstance(node, t.Select):
                for x in t.children(node):
                    look(x)

        for e in needed:
            look(e)
        return list(out)

    @staticmethod
    def aggregate(name: str, arg: Val | None) -> tuple[Column, T.DataType]:
        if name == "count":
            return F.count(F.lit(1) if arg is None else arg.col), LONG
        if arg is None:
            raise QueryError(f"{name}() needs a field")
        if name in ("min", "max"):
            return (F.min if name == "min" else F.max)(arg.col), arg.type
        number = to_number(arg)
        if name == "avg":
            return F.avg(number.cast("double")), DOUBLE
        whole = isinstance(arg.type, T.IntegralType | T.BooleanType)
        return F.sum(number.cast("long") if whole else number.cast("double")), LONG if whole else DOUBLE

    def union(self, node: t.Union) -> tuple[DataFrame, list[str]]:
        frames = [(self.union(p) if isinstance(p, t.Union) else self.select(p))[0] for p in node.parts]
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f) if len(f.columns) == len(out.columns) else out.unionByName(f, allowMissingColumns=True)
        return (out if node.keep_all else out.distinct()), out.columns


class _Given(t.Expr):
    """A value that the outer query has computed."""

    def __init__(self, value: Val) -> None:
        self.value = value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Given)

    def __hash__(self) -> int:
        return 17


def _outer(v: Val) -> Val:
    return Val(v.col.outer(), v.type, v.plain)
