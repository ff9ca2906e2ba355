"""Scalar functions. Each takes typed values and gives one; names match with or without underscores, in any case."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdframe.lang.tokens import QueryError
from mdframe.plans.values import BOOL, DOUBLE, LONG, STRING, TIME, Val, lit, matches, to_bool, to_number, to_text, to_time

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
FUNCTIONS: dict[str, tuple[Callable[..., Val], int, int]] = {}


def key(name: str) -> str:
    return name.replace("_", "").lower()


def function(name: str, least: int, most: int | None = None):
    def keep(fn):
        FUNCTIONS[key(name)] = (fn, least, least if most is None else most)
        return fn

    return keep


def call(name: str, args: list[Val]) -> Val:
    known = FUNCTIONS.get(key(name))
    if known is None:
        raise QueryError(f"Unknown builtin: {name}")
    fn, least, most = known
    if not least <= len(args) <= most:
        raise QueryError(f"{name}() takes {least}{f' to {most}' if most != least else ''} arguments, got {len(args)}")
    return fn(*args)


def text(name: str, v: Val) -> Column:
    if v.is_string or v.is_null:
        return v.col.cast("string")
    raise QueryError(f"{name}() requires a string, got {kind_of(v)}")


def kind_of(v: Val) -> str:
    if v.is_null:
        return "null"
    for name in ("array", "number", "string", "bool"):
        if getattr(v, f"is_{name}"):
            return {"bool": "boolean"}.get(name, name)
    return "date" if v.is_time else "object"


@function("now", 0)
def _now() -> Val:
    return Val(F.date_format(F.current_timestamp(), ISO), STRING)


@function("today", 0)
def _today() -> Val:
    return Val(F.date_format(F.current_date(), "yyyy-MM-dd"), STRING)


@function("len", 1)
def _len(v: Val) -> Val:
    if v.is_array:
        return Val(F.size(v.col).cast("long"), LONG)
    return Val(F.length(text("len", v)).cast("long"), LONG)


@function("upper", 1)
def _upper(v: Val) -> Val:
    return Val(F.upper(text("upper", v)), STRING)


@function("lower", 1)
def _lower(v: Val) -> Val:
    return Val(F.lower(text("lower", v)), STRING)


@function("trim", 1)
def _trim(v: Val) -> Val:
    return Val(F.regexp_replace(text("trim", v), r"(?U)^\s+|\s+$", ""), STRING)


@function("trimAll", 1)
def _trim_all(v: Val) -> Val:
    return Val(F.regexp_replace(text("trimAll", v), "[\\x00-\\x1f\\u2028\\u2029\\u0085|]", " "), STRING)


@function("capitalize", 1)
def _capitalize(v: Val) -> Val:
    return Val(F.initcap(text("capitalize", v)), STRING)


def words(name: str, v: Val) -> Column:
    """Words between blanks, underscores and hyphens, and where a capital follows a small letter."""
    apart = F.regexp_replace(text(name, v), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(apart, r"[\s_-]+"), lambda w: w != "")


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))


@function("pascalCase", 1)
def _pascal(v: Val) -> Val:
    return Val(F.array_join(F.transform(words("pascalCase", v), _capital), ""), STRING)


@function("camelCase", 1)
def _camel(v: Val) -> Val:
    whole = _pascal(v).col
    first = F.length(F.coalesce(F.get(words("camelCase", v), F.lit(0)), F.lit("")))
    return Val(F.concat(F.lower(F.substr(whole, F.lit(1), first)), F.substr(whole, first + 1)), STRING)


@function("sentence", 1)
def _sentence(v: Val) -> Val:
    return Val(_capital(text("sentence", v)), STRING)


@function("snakeCase", 1)
def _snake(v: Val) -> Val:
    return Val(F.lower(F.array_join(words("snakeCase", v), "_")), STRING)


@function("kebabCase", 1)
def _kebab(v: Val) -> Val:
    return Val(F.lower(F.array_join(words("kebabCase", v), "-")), STRING)


@function("contains", 2)
def _contains(a: Val, b: Val) -> Val:
    return Val(F.contains(text("contains", a), text("contains", b)), BOOL)


@function("startsWith", 2)
def _starts(a: Val, b: Val) -> Val:
    return Val(F.startswith(text("startsWith", a), text("startsWith", b)), BOOL)


@function("endsWith", 2)
def _ends(a: Val, b: Val) -> Val:
    return Val(F.endswith(text("endsWith", a), text("endsWith", b)), BOOL)


@function("matches", 2)
def _matches(a: Val, b: Val) -> Val:
    return Val(matches(a, b), BOOL)


@function("split", 2)
def _split(a: Val, b: Val) -> Val:
    return Val(F.split(text("split", a), F.concat(F.lit("\\Q"), text("split", b), F.lit("\\E")), -1), T.ArrayType(STRING))


@function("join", 1, 2)
def _join(a: Val, b: Val | None = None) -> Val:
    if not a.is_array:
        raise QueryError("join() requires an array")
    items = F.transform(a.col, lambda x: to_text(Val(x, a.type.elementType)))
    return Val(F.array_join(items, b.plain if b else ",", "null"), STRING)


@function("replace", 3)
def _replace(a: Val, b: Val, c: Val) -> Val:
    return Val(F.replace(text("replace", a), text("replace", b), text("replace", c)), STRING)


@function("date", 1)
def _date(v: Val) -> Val:
    return Val(F.date_format(to_time(v), ISO), STRING)


def _place(v: Val, array: Val) -> Column:
    return F.array_position(array.col, v.col.cast(array.type.elementType)).cast("int")


@function("nextEnum", 2)
def _next_enum(v: Val, array: Val) -> Val:
    return Val(F.get(array.col, F.coalesce(_place(v, array), F.lit(0)) % F.size(array.col)), array.type.elementType)


@function("prevEnum", 2)
def _prev_enum(v: Val, array: Val) -> Val:
    at = F.coalesce(_place(v, array), F.lit(0))
    return Val(F.get(array.col, F.when(at <= 1, F.size(array.col) - 1).otherwise(at - 2)), array.type.elementType)


@function("clipboard", 1)
def _clipboard(v: Val) -> Val:
    return v


@function("nextDate", 1)
def _next_date(v: Val) -> Val:
    rule = F.lower(text("nextDate", v))
    days = F.regexp_extract(rule, r"^(\d+)\s*days?$", 1).try_cast("int")
    at = F.current_date()
    out = (
        F.when(rule == "daily", F.date_add(at, 1)).when(rule == "weekly", F.date_add(at, 7)).when(rule == "monthly", F.add_months(at, 1))
        .when(rule == "yearly", F.add_months(at, 12)).when(days.isNotNull(), F.date_add(at, days))
    )
    return Val(F.date_format(out, "yyyy-MM-dd"), STRING)


@function("user", 0)
def _user() -> Val:
    return lit(os.environ.get("USER") or "unknown")


@function("typeof", 1)
def _typeof(v: Val) -> Val:
    return Val(F.when(v.col.isNull(), "null").otherwise(kind_of(v)), STRING)


@function("str", 1)
def _str(v: Val) -> Val:
    return Val(F.coalesce(to_text(v), F.lit("")), STRING)


@function("int", 1)
def _int(v: Val) -> Val:
    if v.is_number:
        return Val(F.coalesce(F.floor(v.col).cast("long"), F.lit(0).cast("long")), LONG)
    if v.is_bool or v.is_time:
        return Val(F.coalesce(to_number(v).cast("long"), F.lit(0).cast("long")), LONG)
    found = F.regexp_extract(v.col.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("long")
    return Val(F.coalesce(found, F.lit(0).cast("long")), LONG)


@function("float", 1)
def _float(v: Val) -> Val:
    if not v.is_string:
        return Val(F.coalesce(to_number(v).cast("double"), F.lit(0.0)), DOUBLE)
    found = F.regexp_extract(v.col, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double")
    return Val(F.coalesce(found, F.lit(0.0)), DOUBLE)


@function("bool", 1)
def _bool(v: Val) -> Val:
    if v.is_string:
        return Val(F.coalesce(F.lower(v.col).isin("true", "1", "yes"), F.lit(False)), BOOL)
    return Val(F.coalesce(to_bool(v), F.lit(False)), BOOL)


@function("array", 1)
def _array(v: Val) -> Val:
    if v.is_array:
        return Val(F.coalesce(v.col, F.array().cast(v.type)), v.type)
    kind = T.ArrayType(STRING if v.is_null else v.type)
    return Val(F.when(v.col.isNull(), F.array().cast(kind)).otherwise(F.array(v.col.cast(kind.elementType))), kind)


@function("isBefore", 2)
def _before(a: Val, b: Val) -> Val:
    return Val(F.coalesce(to_time(a) < to_time(b), F.lit(False)), BOOL)


@function("isAfter", 2)
def _after(a: Val, b: Val) -> Val:
    return Val(F.coalesce(to_time(a) > to_time(b), F.lit(False)), BOOL)


@function("daysUntil", 2)
def _days_until(a: Val, b: Val) -> Val:
    gap = (F.unix_millis(to_time(b)) - F.unix_millis(to_time(a))) / 86_400_000
    return Val(F.coalesce(F.ceil(gap), F.lit(0)).cast("long"), LONG)


@function("daysSince", 1)
def _days_since(a: Val) -> Val:
    gap = (F.unix_millis(F.current_timestamp()) - F.unix_millis(to_time(a))) / 86_400_000
    return Val(F.coalesce(F.floor(gap), F.lit(0)).cast("long"), LONG)


@function("dateFormat", 2)
def _date_format(a: Val, b: Val) -> Val:
    """The first YYYY, MM, DD, HH, mm and ss of the form are filled in; all else stays."""
    out = text("dateFormat", b)
    for name, form in (("YYYY", "yyyy"), ("MM", "MM"), ("DD", "dd"), ("HH", "HH"), ("mm", "mm"), ("ss", "ss")):
        out = F.regexp_replace(out, F.lit(f"(?s)^(.*?){name}(.*)$"), F.concat(F.lit("$1"), F.lpad(F.date_format(to_time(a), form), len(form), "0"), F.lit("$2")))
    return Val(out, STRING)


@function("dateAdd", 2)
def _date_add(a: Val, n: Val) -> Val:
    at = F.coalesce(to_time(a), F.current_timestamp())
    return Val(at + F.make_dt_interval(to_number(n).cast("int")), TIME)


@function("dateSub", 2)
def _date_sub(a: Val, n: Val) -> Val:
    at = F.coalesce(to_time(a), F.current_timestamp())
    return Val(at - F.make_dt_interval(to_number(n).cast("int")), TIME)


def wildcard(value: Column, pattern: str) -> Column:
    """``*`` at either end of a pattern matches any text there."""
    if pattern == "*":
        return value.isNotNull()
    if pattern.startswith("*") and pattern.endswith("*"):
        return F.contains(value, F.lit(pattern[1:-1]))
    if pattern.endswith("*"):
        return F.startswith(value, F.lit(pattern[:-1]))
    if pattern.startswith("*"):
        return F.endswith(value, F.lit(pattern[1:]))
    return value == pattern
