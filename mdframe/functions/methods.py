"""Methods of arrays, texts and maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdframe.lang import tree as t
from mdframe.lang.tokens import QueryError
from mdframe.plans.values import BOOL, LONG, STRING, Val, to_bool, to_text


def _bounds(size: Column, start: Column, stop: Column | None) -> tuple[Column, Column]:
    """First place and length of a slice whose negative ends count from the end; an end of 0 or none is the whole."""
    first = F.when(start < 0, F.greatest(size + start, F.lit(0))).otherwise(F.least(start, size))
    if stop is None:
        last = size
    else:
        last = F.when(stop == 0, size).when(stop < 0, size + stop).otherwise(F.least(stop, size))
    return first.cast("int"), F.greatest(last - first, F.lit(0)).cast("int")


def call_method(of: Val, node: t.Method, compile_arg: Callable[[t.Expr], Val], compile_item: Callable[[t.Expr, T.DataType], Callable[[Column], Val]]) -> Val:
    """``of.name(args)``; ``compile_item`` compiles an argument for an item of the array."""
    name = node.name
    if of.is_array:
        return _array(of, name, node.args, compile_arg, compile_item)
    args = [compile_arg(a) for a in node.args]
    if of.is_string:
        return _text(of, name, args)
    if of.is_struct or of.is_map:
        return _map(of, name)
    raise QueryError(f"Unsupported method call: {name} on {of.type.simpleString()}")


def _pluck(item: Column, kind: T.DataType, name: str) -> Val:
    if isinstance(kind, T.StructType) and name in kind.fieldNames():
        return Val(item.getField(name), kind[name].dataType)
    raise QueryError(f"Cannot read {name} of {kind.simpleString()}")


def _array(of: Val, name: str, args: tuple[t.Expr, ...], compile_arg, compile_item) -> Val:
    a, kind = of.col, of.type.elementType

    def mapped(arg: t.Expr) -> Callable[[Column], Val]:
        if isinstance(arg, t.Literal) and isinstance(arg.value, str):
            return lambda x: _pluck(x, kind, arg.value)
        return compile_item(arg, kind)

    match name:
        case "filter" | "where":
            test = compile_item(args[0], kind)
            return Val(F.filter(a, lambda x: F.coalesce(to_bool(test(x)), F.lit(False))), of.type)
        case "map":
            fn = mapped(args[0])
            made: list[Val] = []

            def apply(x: Column) -> Column:
                made.append(fn(x))
                return made[-1].col

            return Val(F.transform(a, apply), T.ArrayType(made[-1].type))
        case "sort":
            fn = mapped(args[0]) if args else (lambda x: Val(x, kind))
            keyed = F.transform(a, lambda x, i: F.struct(fn(x).col.isNull().alias("n"), fn(x).col.alias("k"), i.alias("i"), x.alias("x")))
            ordered = F.array_sort(
                keyed, lambda p, q: F.when(p["n"] != q["n"], F.when(p["n"], 1).otherwise(-1)).when(p["k"] < q["k"], -1).when(p["k"] > q["k"], 1).otherwise(p["i"] - q["i"])
            )
            return Val(F.transform(ordered, lambda x: x["x"]), of.type)
        case "first":
            return Val(F.get(a, F.lit(0)), kind)
        case "last":
            return Val(F.try_element_at(a, F.lit(-1)), kind)
        case "slice":
            ends = [compile_arg(x).col.cast("int") for x in args]
            first, count = _bounds(F.size(a), ends[0] if ends else F.lit(0), ends[1] if len(ends) > 1 else None)
            return Val(F.slice(a, first + 1, count), of.type)
        case "flatten":
            return Val(F.flatten(a), kind) if isinstance(kind, T.ArrayType) else of
        case "unique":
            return Val(F.array_distinct(a), of.type)
        case "count" | "length":
            return Val(F.coalesce(F.size(a), F.lit(0)).cast("long"), LONG)
        case "join":
            mark = compile_arg(args[0]).plain if args else ","
            return Val(F.array_join(F.transform(a, lambda x: to_text(Val(x, kind))), mark, "null"), STRING)
        case "includes":
            from mdframe.plans.values import contains_item

            return Val(contains_item(of, compile_arg(args[0])), BOOL)
    raise QueryError(f"Unsupported array method: {name}")


def _text(of: Val, name: str, args: list[Val]) -> Val:
    s = of.col
    match name:
        case "slice":
            ends = [x.col.cast("int") for x in args]
            first, count = _bounds(F.length(s), ends[0] if ends else F.lit(0), ends[1] if len(ends) > 1 else None)
            return Val(F.substr(s, first + 1, count), STRING)
        case "length" | "count":
            return Val(F.length(s).cast("long"), LONG)
        case "toLowerCase":
            return Val(F.lower(s), STRING)
        case "toUpperCase":
            return Val(F.upper(s), STRING)
        case "trim":
            return Val(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), STRING)
        case "startsWith":
            return Val(F.startswith(s, args[0].col), BOOL)
        case "endsWith":
            return Val(F.endswith(s, args[0].col), BOOL)
        case "includes":
            return Val(F.contains(s, args[0].col), BOOL)
    raise QueryError(f"Unsupported string method: {name}")


def _map(of: Val, name: str) -> Val:
    if of.is_struct:
        names = of.type.fieldNames()
        texts = [to_text(Val(of.col.getField(f.name), f.dataType)) for f in of.type]
        keys, values = F.array(*[F.lit(n) for n in names]), F.array(*texts)
        kind = STRING
    else:
        keys, values, kind = F.map_keys(of.col), F.map_values(of.col), of.type.valueType
    match name:
        case "keys":
            return Val(keys, T.ArrayType(STRING))
        case "values":
            return Val(values, T.ArrayType(kind))
        case "entries":
            return Val(F.arrays_zip(keys.alias("key"), values.alias("value")), T.ArrayType(T.StructType([T.StructField("key", STRING), T.StructField("value", kind)])))
        case "length" | "count":
            return Val(F.size(keys).cast("long"), LONG)
    raise QueryError(f"Unsupported object method: {name}")
