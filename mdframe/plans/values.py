"""Typed expressions: Spark columns with the types that coercion needs, and the comparison and arithmetic rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdframe.lang.tokens import QueryError

STRING, LONG, DOUBLE, BOOL, TIME = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
# The forms of a date in text.
DATE_TEXT = re.compile(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$|\d{2}/\d{2}/\d{4}$|\d{4}/\d{2}/\d{2}$|\d{1,2}-\d{1,2}-\d{4}$")
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "M-d-yyyy")


@dataclass
class Val:
    """A column and its type; ``plain`` keeps a literal's Python value."""

    col: Column
    type: T.DataType
    plain: object = None

    @property
    def is_number(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def is_string(self) -> bool:
        return isinstance(self.type, T.StringType)

    @property
    def is_bool(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    @property
    def is_time(self) -> bool:
        return isinstance(self.type, T.TimestampType | T.DateType | T.TimestampNTZType)

    @property
    def is_array(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def is_null(self) -> bool:
        return isinstance(self.type, T.NullType)

    @property
    def is_struct(self) -> bool:
        return isinstance(self.type, T.StructType)

    @property
    def is_map(self) -> bool:
        return isinstance(self.type, T.MapType)


def lit(value: object) -> Val:
    if value is None:
        return Val(F.lit(None), T.NullType())
    kind = {bool: BOOL, int: LONG, float: DOUBLE, str: STRING}[type(value)]
    return Val(F.lit(value).cast(kind) if isinstance(value, int) and not isinstance(value, bool) else F.lit(value), kind, value)


def to_time(v: Val) -> Column:
    """A timestamp, or null where a string is none of the date forms; a number is milliseconds since 1970."""
    if v.is_time:
        return v.col.cast("timestamp")
    if v.is_number:
        return F.timestamp_millis(v.col.cast("long"))
    text = v.col.cast("string")
    iso = F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$")), F.try_to_timestamp(text))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS[1:]])


def to_number(v: Val) -> Column:
    if v.is_number:
        return v.col
    if v.is_bool:
        return v.col.cast("int")
    if v.is_time:
        return F.unix_millis(v.col.cast("timestamp"))
    return v.col.try_cast("double")


def to_text(v: Val) -> Column:
    if v.is_array or v.is_struct or v.is_map:
        return F.to_json(v.col)
    if isinstance(v.type, T.DoubleType | T.FloatType):
        whole = v.col == F.floor(v.col)
        return F.when(whole & (F.abs(v.col) < 1e15), v.col.cast("long").cast("string")).otherwise(v.col.cast("string"))
    if v.is_time:
        return F.date_format(v.col.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return v.col.cast("string")


def to_bool(v: Val) -> Column:
    """Truth of a value: null, empty text, 0 and the words false, 0, no, off are not true."""
    if v.is_bool:
        return v.col
    if v.is_number:
        return v.col != 0
    if v.is_string:
        low = F.lower(v.col)
        return (v.col != "") & ~low.isin("false", "0", "no", "off")
    return v.col.isNotNull()


def common(l: Val, r: Val) -> tuple[Column, Column] | None:
    """Both sides in the form in which they compare; None if they never do."""
    if l.is_null or r.is_null or l.type == r.type or l.is_number and r.is_number:
        return l.col, r.col
    if l.is_time or r.is_time:
        return to_time(l), to_time(r)
    if (l.is_number or l.is_bool) and r.is_string:
        return to_number(l).cast("double"), to_number(r)
    if l.is_string and (r.is_number or r.is_bool):
        return to_number(l), to_number(r).cast("double")
    if (l.is_number and r.is_bool) or (l.is_bool and r.is_number):
        return to_number(l), to_number(r)
    if l.is_array and r.is_array:
        return l.col, r.col
    return None


def compare(op: str, l: Val, r: Val, strict: bool = False) -> Column:
    """``=`` and ``!=`` are null-safe unless ``strict``; the other operators give null for null."""
    if op in ("contains", "starts_with", "ends_with"):
        return _text_test(op, l, r)
    if op == "matches":
        return matches(l, r)
    pair = common(l, r)
    if pair is None:
        if op in ("=", "!="):
            return F.lit(op == "!=")
        raise QueryError(f"Unsupported comparison operator: {op} between {l.type.simpleString()} and {r.type.simpleString()}")
    a, b = pair
    match op:
        case "=":
            return a == b if strict else a.eqNullSafe(b)
        case "!=":
            return a != b if strict else ~a.eqNullSafe(b)
        case "<":
            return a < b
        case "<=":
            return a <= b
        case ">":
            return a > b
        case ">=":
            return a >= b
    raise QueryError(f"Unsupported comparison operator: {op}")


def _text_test(op: str, l: Val, r: Val) -> Column:
    if l.is_array and op == "contains":
        return contains_item(l, r)
    if not (l.is_string or l.is_null) or not (r.is_string or r.is_null):
        if l.is_number or l.is_time:
            raise QueryError(f"Unsupported {'date' if l.is_time else 'numeric'} comparison operator: {op}")
    test = {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[op]
    return test(l.col.cast("string"), r.col.cast("string"))


def matches(l: Val, r: Val) -> Column:
    pattern = r.col
    if isinstance(r.plain, str):
        text, flags = r.plain, ""
        if len(text) > 2 and text.startswith("/") and "/" in text[1:]:
            text, _, flags = text[1:].rpartition("/")
        pattern = F.lit(java_regex(text, flags))
    if not l.is_string:
        return F.lit(False)
    return F.coalesce(F.rlike(l.col, pattern), F.lit(False))


def java_regex(pattern: str, flags: str = "") -> str:
    kept = "".join(f for f in flags if f in "ims")
    return f"(?{kept}){pattern}" if kept else pattern


def contains_item(array: Val, item: Val) -> Column:
    """Whether an array holds a value; arrays of structs with a title hold a text if a title contains it in any case."""
    kind = array.type.elementType
    if isinstance(kind, T.StructType):
        if "title" in kind.fieldNames():
            return F.coalesce(F.exists(array.col, lambda e: F.contains(F.lower(e["title"]), F.lower(item.col))), F.lit(False))
        return F.lit(False)
    return F.coalesce(F.exists(array.col, lambda e: compare("=", Val(e, kind), item)), F.lit(False))


def numeric_type(l: Val, r: Val, op: str) -> T.DataType:
    if op in ("/", "^") or not (isinstance(l.type, T.IntegralType | T.BooleanType) and isinstance(r.type, T.IntegralType | T.BooleanType)):
        return DOUBLE
    return LONG


def arithmetic(op: str, l: Val, r: Val) -> Val:
    """Dates, then arrays as ordered sets, then text joined by ``+``, then numbers."""
    if l.is_time or r.is_time:
        return _date_arithmetic(op, l, r)
    if l.is_array or r.is_array:
        return _set_arithmetic(op, l, r)
    if op == "+" and (l.is_string or r.is_string):
        return Val(F.concat(to_text(l), to_text(r)), STRING)
    if l.is_string and r.is_string:
        raise QueryError(f"Unsupported string arithmetic operator: {op}")
    if l.is_struct or r.is_struct or l.is_map or r.is_map:
        raise QueryError(f"Cannot apply {op} to maps")
    a, b, kind = to_number(l), to_number(r), numeric_type(l, r, op)
    match op:
        case "+" | "-" | "*":
            if kind == LONG:
                a, b = a.cast("long"), b.cast("long")
            else:
                a, b = a.cast("double"), b.cast("double")
            return Val(a + b if op == "+" else a - b if op == "-" else a * b, kind)
        case "/":
            return Val(F.try_divide(a.cast("double"), b.cast("double")), DOUBLE)
        case "%":
            return Val(F.try_mod(a.cast(kind), b.cast(kind)), kind)
        case "^":
            return Val(F.pow(a.cast("double"), b.cast("double")), DOUBLE)
    raise QueryError(f"Unsupported numeric arithmetic operator: {op}")


def _date_arithmetic(op: str, l: Val, r: Val) -> Val:
    """Milliseconds: a date and a number give a date, dates or date texts give their distance; ``+`` joins other text.

    Text that is no date has no distance. What ``+`` does with a text column is settled by its type, so only a literal counts as a date there.
    """
    dated = lambda v: v.is_time or v.is_string and isinstance(v.plain, str) and bool(DATE_TEXT.match(v.plain))
    if op == "-" and all(v.is_time or v.is_string for v in (l, r)):
        return Val(F.unix_millis(to_time(l)) - F.unix_millis(to_time(r)), LONG)
    if op in ("+", "-") and l.is_time and (r.is_number or r.is_null):
        n, ms = r.col.cast("long"), F.unix_millis(to_time(l))
        return Val(F.timestamp_millis(ms + n if op == "+" else ms - n), TIME)
    if op == "+" and dated(l) and dated(r):
        return Val(F.timestamp_millis(F.unix_millis(to_time(l)) + F.unix_millis(to_time(r))), TIME)
    if op == "+" and (l.is_string or r.is_string):
        return Val(F.concat(to_text(l), to_text(r)), STRING)
    raise QueryError(f"Unsupported date arithmetic operator: {op}")


def _set_arithmetic(op: str, l: Val, r: Val) -> Val:
    if op not in ("+", "-"):
        raise QueryError(f"Cannot apply {op} to arrays")
    if l.is_array and r.is_array:
        if isinstance(r.type.elementType, T.NullType):
            return Val(F.array_distinct(l.col), l.type) if op == "+" else l
        if isinstance(l.type.elementType, T.NullType):
            return Val(F.array_distinct(r.col), r.type) if op == "+" else l
        if op == "+":
            return Val(F.array_union(l.col, r.col), l.type)
        return Val(F.filter(l.col, lambda x: ~F.coalesce(F.exists(r.col, lambda y: x.eqNullSafe(y)), F.lit(False))), l.type)
    if l.is_array:
        item = r.col.cast(l.type.elementType)
        if op == "-":
            return Val(F.filter(l.col, lambda x: ~x.eqNullSafe(item)), l.type)
        return Val(F.when(F.exists(l.col, lambda x: x.eqNullSafe(item)), l.col).otherwise(F.array_append(l.col, item)), l.type)
    if op == "-":
        raise QueryError("Cannot apply - to a value and an array")
    item = l.col.cast(r.type.elementType)
    return Val(F.when(F.exists(r.col, lambda x: x.eqNullSafe(item)), r.col).otherwise(F.array_prepend(r.col, item)), r.type)
