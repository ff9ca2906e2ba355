"""Syntax tree: frozen nodes, so that equal expressions are equal keys."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    """Base of expressions."""


@dataclass(frozen=True)
class Literal(Expr):
    value: object  # str, int, float, bool or None


@dataclass(frozen=True)
class Empty(Expr):
    """The ``empty`` value."""


@dataclass(frozen=True)
class Regex(Expr):
    pattern: str
    flags: str = ""


@dataclass(frozen=True)
class Name(Expr):
    name: str


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Method(Expr):
    of: Expr
    name: str
    args: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Index(Expr):
    of: Expr
    index: Expr


@dataclass(frozen=True)
class Get(Expr):
    of: Expr
    key: str


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    of: Expr


@dataclass(frozen=True)
class Quantified(Expr):
    which: str  # any, all
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsEmpty(Expr):
    of: Expr
    negated: bool = False


@dataclass(frozen=True)
class In(Expr):
    of: Expr
    items: tuple[Expr, ...] | Expr
    negated: bool = False


@dataclass(frozen=True)
class Array(Expr):
    items: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Subquery(Expr):
    select: Select


@dataclass(frozen=True)
class Exists(Expr):
    select: Select


@dataclass(frozen=True)
class Field:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Join:
    kind: str
    table: str
    alias: str | None
    on: Expr | None


@dataclass(frozen=True)
class Select:
    fields: tuple[Field, ...]
    distinct: bool = False
    table: str | None = None
    alias: str | None = None
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    having: Expr | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class Union:
    parts: tuple[Select, ...]
    keep_all: bool


@dataclass(frozen=True)
class Assign:
    name: str
    hint: str | None
    expr: Expr


@dataclass(frozen=True)
class Update:
    where: Expr | None
    assigns: tuple[Assign, ...]


@dataclass(frozen=True)
class Create:
    assigns: tuple[Assign, ...]


@dataclass(frozen=True)
class Delete:
    where: Expr | None


@dataclass(frozen=True)
class Trigger:
    timing: str
    event: str
    where: Expr | None
    deny: str | None = None
    assigns: tuple[Assign, ...] = ()
    run: str | None = None


@dataclass(frozen=True)
class Pipe:
    statement: object
    name: str
    args: tuple[object, ...] = field(default=())


def children(node: object):
    """Direct parts of a node that are nodes."""
    for value in vars(node).values() if hasattr(node, "__dataclass_fields__") else ():
        for x in value if isinstance(value, tuple) else (value,):
            if hasattr(x, "__dataclass_fields__"):
                yield x


def walk(node: object, into_queries: bool = False):
    """A node and all below it; not into subqueries unless asked."""
    yield node
    for x in children(node):
        if into_queries or not isinstance(x, Select):
            yield from walk(x, into_queries)


def label(node: Expr) -> str:
    """The column name that an expression without an alias gets."""
    match node:
        case Name(name):
            return name
        case Call("count" | "sum" | "avg" | "min" | "max", args):
            return f"{node.name}({args[0].name if args and isinstance(args[0], Name) else '*'})"
        case Call(name, args):
            return f"{name}({', '.join(map(label, args))})"
        case Method(of, name, args):
            return f"{label(of)}.{name}({', '.join(map(label, args))})"
        case Index(of, index):
            return f"{label(of)}[{label(index)}]"
        case Get(of, key):
            return f"{label(of)}.{key}"
        case Binary(op, left, right):
            return f"{label(left)}_{op.upper() if op.isalpha() else op}_{label(right)}"
        case Unary(op, of):
            return f"{op.upper()}_{label(of)}"
        case Literal(bool(value)):
            return str(value).lower()
        case Literal(str(value)):
            return f'"{value}"'
        case Literal(int() | float()):
            return str(node.value)
        case Regex(pattern, flags):
            return f"/{pattern}/{flags}"
    return "expr"
