"""Functions over the body of a document: sections, table of contents, elements, grep."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mdframe.functions.scalar import wildcard
from mdframe.lang import tree as t
from mdframe.lang.tokens import QueryError
from mdframe.markdown.index import GREP_TYPE, INDEX_TYPE, Needs, Walker, grep_text, grep_texts, outline_text, parse_index, pruned
from mdframe.plans.values import BOOL, LONG, STRING, Val

# The element functions and the field that a text argument filters; none for elements without such a field.
ELEMENT_FIELD = {
    "h1": "title", "h2": "title", "h3": "title", "h4": "title", "h5": "title", "h6": "title", "link": "url", "linkRef": "identifier",
    "image": "alt", "imageRef": "identifier", "code": "lang", "inlineCode": "content", "table": None, "tableRow": None, "tableCell": "content",
    "list": None, "listItem": "content", "blockquote": "content", "p": "content", "html": "content", "em": "content", "strong": "content",
    "del": "content", "break": None, "footnote": "label", "def": "identifier",
}
#: Functions whose parentheses may be left out.
BARE = frozenset(ELEMENT_FIELD) | {"toc", "links", "images", "codeblocks", "sections", "outline"}
NAMES = BARE | {"section", "has_section", "content", "grep"}
#: What needs a parse of the inline level too.
INLINE = frozenset("link linkRef image imageRef inlineCode em strong del break footnote links images html table tableRow tableCell p listItem blockquote list".split())
#: Of these, blocks of which only the text is read, and what holds it.
TEXT_OF = {"table": "table", "tableRow": "table", "tableCell": "table", "p": "paragraph", "listItem": "listItem", "list": "listItem", "blockquote": "blockquote"}
PLACES = {name: f"el_{name}" for name in ELEMENT_FIELD}
#: Functions whose results are the same however elements are read.
PLAIN_TYPES = frozenset({"toc", "outline", "has_section", "content"})


def scans_of(query: t.Select) -> dict[str, tuple]:
    """Fields of the index that depend on arguments: each pattern that a query looks for in bodies, and each depth of an outline."""
    out: dict[str, tuple] = {}
    for node in t.walk(query):
        if isinstance(node, t.Call) and node.name == "grep" and len(node.args) == 1 and isinstance(node.args[0], t.Regex):
            out[_grep_field(node.args[0].pattern, node.args[0].flags)] = ("grep", node.args[0].pattern, node.args[0].flags)
        elif node == t.Name("outline") or isinstance(node, t.Get) and node.key == "outline" or isinstance(node, t.Call) and node.name == "outline" and not (node.args and not isinstance(node.args[0], t.Literal)):
            depth = int(node.args[0].value) if isinstance(node, t.Call) and node.args else 6
            out[f"outline {depth}"] = ("outline", depth)
    return out


def _shape(node: object) -> str | None:
    """Whether an expression is ``many`` elements of a body, or ``one``."""
    match node:
        case t.Call("section", _):
            return "one"
        case t.Name(name) if name in BARE and name not in PLAIN_TYPES:
            return "many"
        case t.Call(name, _) | t.Get(t.Name("body"), name) if name in NAMES and name not in PLAIN_TYPES:
            return "one" if name == "section" else "many"
        case t.Method(of, "filter" | "where" | "slice", _) if _shape(of) == "many":
            return "many"
        case t.Method(of, "sort", args) if args and _shape(of) == "many":
            return "many"
        case t.Method(of, "first" | "last", _) | t.Index(of, _) if _shape(of) == "many":
            return "one"
    return None


def names_of(query: t.Select) -> frozenset[str] | None:
    """Names of the parts of elements that a query reads; none if elements may be read as wholes."""
    names: set[str | None] = {"level", "title"}  # of headings, which toc and h1 to h6 read
    for node in t.walk(query):
        match node:
            case t.Name("_"):
                return None
            case t.Name(name) | t.Literal(str(name)) | t.Get(_, name):
                names.add(name)
        if isinstance(node, t.Call) and node.name in ELEMENT_FIELD and node.args:
            names.add(ELEMENT_FIELD[node.name])
        if {"tableRow", "tableCell"} & {getattr(node, "name", None), getattr(node, "key", None)}:
            names |= {"headers", "rows", "cells"}
        for x in t.children(node):
            shape = _shape(x)
            if shape is None:
                continue
            match node:
                case t.Get(of, _) | t.IsEmpty(of, _) | t.Call("has", (of,)) if of is x:
                    continue
                case t.Index(of, _) | t.Method(of, "count" | "length" | "filter" | "where" | "slice" | "first" | "last", _) if of is x and shape == "many":
                    continue
                case t.Method(of, "map" | "sort", args) if of is x and args and shape == "many":
                    continue
            return None
    return frozenset(n for n in names if n)


def _grep_field(pattern: str, flags: str) -> str:
    return f"grep {flags} {pattern}"


def index_column(body: Column, used: set[str], scans: dict[str, tuple] | None = None, names: frozenset[str] | None = None) -> Column:
    """The parsed index of a body as one struct of what the used functions read, with the results of ``scans``.

    A deterministic Arrow UDF: any number of uses parse once, patterns and outlines included, and filters on plain columns go below
    it. Inlines are read only where an element needs them, blocks only where they may hold one; elements have the parts of ``names``
    (none: all). Batches are bounded in bytes by Spark.
    """
    scans = scans or {}
    fields = {PLACES.get({"tableRow": "table", "tableCell": "table"}.get(n, n)) for n in used} | {f"all_{n}" for n in used & {"links", "images", "codeblocks"}}
    if used & {"toc", "outline", "sections", "section", "has_section", "h1", "h2", "h3", "h4", "h5", "h6"}:
        fields.add("headings")
    fields &= set(INDEX_TYPE.fieldNames())
    shown = [T.StructField(f.name, pruned(f.dataType, names)) for f in INDEX_TYPE if f.name in fields]
    kind = T.StructType(shown + [T.StructField(n, pruned(GREP_TYPE, names) if s[0] == "grep" else STRING) for n, s in scans.items()] or [INDEX_TYPE["headings"]])
    needs = Needs(fields, names, [tuple(s[1:]) for s in scans.values() if s[0] == "grep"])
    inline = bool(used & INLINE) or any(s[0] == "grep" for s in scans.values())

    texts = None if any(s[0] == "grep" for s in scans.values()) or used & INLINE - set(TEXT_OF) else frozenset(TEXT_OF[n] for n in used & set(TEXT_OF))

    def read(text: str | None) -> dict:
        if not scans:
            return parse_index(text, inline, texts, needs)
        walker = Walker(text, inline, texts, needs).run() if text else None
        out = walker.out if walker else parse_index(None)
        extra = {}
        for name, (what, *args) in scans.items():
            if what == "grep":
                extra[name] = grep_texts(walker.texts, *args, needs) if walker else []
            else:
                extra[name] = outline_text([(h["level"], h["title"]) for h in out["headings"]], *args)
        return out | extra

    @F.arrow_udf(kind)
    def parsed(bodies: pa.Array) -> pa.Array:
        columns: dict[str, list] = {f: [] for f in kind.fieldNames()}
        collects = gc.isenabled()
        gc.disable()  # rows hold no cycles, and walks over all of them would take a good part of the time
        try:
            for text in bodies.to_pylist():
                row = read(text)
                for name, values in columns.items():
                    values.append(row[name])
        finally:
            if collects:
                gc.enable()
        types = to_arrow_type(kind)
        return pa.StructArray.from_arrays([pa.array(columns[f.name], f.type) for f in types], fields=list(types))

    return parsed(body)


def elements(index: Val, name: str) -> Val:
    """All elements of a kind."""
    if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
        a = index.col.getField("headings")
        kind = T.StructType([f for f in index.type["headings"].dataType.elementType if f.name != "hierarchy"])
        own = F.filter(a, lambda h: h["level"] == int(name[1]))
        return Val(F.transform(own, lambda h: F.struct(*[h[f].alias(f) for f in kind.fieldNames()])), T.ArrayType(kind))
    place = {"tableRow": "table", "tableCell": "table"}.get(name, name)
    a, kind = index.col.getField(PLACES[place]), index.type[PLACES[place]].dataType
    if name == "tableRow":
        return Val(F.flatten(F.transform(a, lambda x: x["rows"])), kind.elementType["rows"].dataType)
    if name == "tableCell":
        cells = F.transform(a, lambda x: F.concat(x["headers"], F.flatten(F.transform(x["rows"], lambda r: r["cells"]))))
        return Val(F.flatten(cells), kind.elementType["headers"].dataType)
    return Val(a, kind)


def toc(index: Val, levels: list[object]) -> Val:
    kind = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("title", STRING)])
    a = index.col.getField("headings")
    if levels:
        a = F.filter(a, lambda h: h["level"].isin(*[int(x) for x in levels]))
    return Val(F.transform(a, lambda h: F.struct(h["level"].alias("level"), h["title"].alias("title"))), T.ArrayType(kind))


def sections(index: Val) -> Val:
    kind = index.type["headings"].dataType
    return Val(F.transform(index.col.getField("headings"), lambda h: F.struct(*[
        (F.when(h["content"] != "", h["content"]) if f == "content" else h[f]).alias(f) for f in kind.elementType.fieldNames()
    ])), kind)


def call_content(name: str, args: list[Val], index: Val, body: Val) -> Val:
    """A content function with plain arguments."""
    plain = [a.plain for a in args]
    match name:
        case "toc":
            return toc(index, plain)
        case "outline":
            return Val(index.col.getField(f"outline {int(plain[0]) if plain else 6}"), STRING)
        case "sections":
            return sections(index)
        case "section":
            all_of = sections(index)
            found = F.filter(all_of.col, lambda h: h["title"] == args[0].col) if args else all_of.col
            return Val(F.get(found, F.lit(0)), all_of.type.elementType)
        case "has_section":
            return Val(F.exists(index.col.getField("headings"), lambda h: h["title"] == args[0].col), BOOL)
        case "content":
            if not args:
                return body
            lines = F.split(body.col, "\n", -1)
            a, b = args[0].col.cast("int"), (args[1] if len(args) > 1 else args[0]).col.cast("int")
            return Val(F.array_join(F.slice(lines, F.greatest(a, F.lit(1)), F.greatest(b - F.greatest(a, F.lit(1)) + 1, F.lit(0))), "\n"), STRING)
        case "links" | "images" | "codeblocks":
            place = f"all_{name}"
            return Val(index.col.getField(place), index.type[place].dataType)
        case "grep":
            pattern = plain[1] if len(args) > 1 else plain[0] if plain else None
            if not isinstance(pattern, tuple):
                raise QueryError("grep() requires a regex pattern")
            if len(args) == 1:
                field = _grep_field(*pattern)
                return Val(index.col.getField(field), index.type[field].dataType)

            @F.arrow_udf(GREP_TYPE)
            def grepped(texts: pa.Array) -> pa.Array:
                return pa.array([grep_text(x, *pattern) for x in texts.to_pylist()], to_arrow_type(GREP_TYPE))

            return Val(grepped(args[0].col), GREP_TYPE)
    found = elements(index, name)
    if args:
        field = ELEMENT_FIELD[name]
        if field is None or not isinstance(plain[0], str):
            raise QueryError(f"{name}() takes no filter")
        return Val(F.filter(found.col, lambda x: F.coalesce(wildcard(x[field], plain[0]), F.lit(False))), found.type)
    return found


def range_length(v: Val) -> Val:
    return Val(F.size(v.col).cast("long"), LONG)
