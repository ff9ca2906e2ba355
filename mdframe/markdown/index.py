"""The index of a document body: every element with its text and place, ready to be rows of a struct."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import types as T

from mdframe.markdown.blocks import Block, Line, lines_of, parse_blocks, scan_blocks
from mdframe.markdown.inlines import Inline, normal, parse_inlines, plain

_I, _S = T.IntegerType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


POINT = _struct(line=_I, column=_I, offset=_I)
POSITION = _struct(start=POINT, end=POINT)
CONTENT = _struct(content=_S, position=POSITION)
CELL = CONTENT
ROW = _struct(cells=T.ArrayType(CELL), position=POSITION)
SECTION = T.ArrayType(_S)
#: Depth to which a list item's children are nested; deeper ones are still in the flat list.
DEPTH = 3


def _item(depth: int) -> T.StructType:
    fields = {"content": _S, "checked": T.BooleanType()}
    if depth:
        fields["children"] = T.ArrayType(_item(depth - 1))
    return _struct(**fields, position=POSITION)


LABELS = re.compile(r"\[([^\[\]]*)\]")
LINKED = _struct(text=_S, url=_S, paragraph=_S, sentence=_S, section=SECTION)
INDEX_TYPE = _struct(
    headings=T.ArrayType(_struct(title=_S, level=_I, content=_S, position=POSITION, hierarchy=SECTION)),
    el_link=T.ArrayType(_struct(text=_S, url=_S, position=POSITION)),
    el_linkRef=T.ArrayType(_struct(text=_S, identifier=_S, position=POSITION)),
    el_image=T.ArrayType(_struct(alt=_S, url=_S, position=POSITION)),
    el_imageRef=T.ArrayType(_struct(alt=_S, identifier=_S, position=POSITION)),
    el_code=T.ArrayType(_struct(lang=_S, content=_S, position=POSITION)),
    el_inlineCode=T.ArrayType(CONTENT),
    el_table=T.ArrayType(_struct(headers=T.ArrayType(CELL), rows=T.ArrayType(ROW), position=POSITION)),
    el_list=T.ArrayType(_struct(ordered=T.BooleanType(), items=T.ArrayType(_item(DEPTH)), position=POSITION)),
    el_listItem=T.ArrayType(_item(DEPTH)),
    el_blockquote=T.ArrayType(CONTENT),
    el_p=T.ArrayType(CONTENT),
    el_html=T.ArrayType(CONTENT),
    el_em=T.ArrayType(CONTENT),
    el_strong=T.ArrayType(CONTENT),
    el_del=T.ArrayType(CONTENT),
    el_break=T.ArrayType(_struct(position=POSITION)),
    el_footnote=T.ArrayType(_struct(label=_S, position=POSITION)),
    el_def=T.ArrayType(_struct(identifier=_S, url=_S, title=_S, position=POSITION)),
    all_links=T.ArrayType(LINKED),
    all_images=T.ArrayType(_struct(alt=_S, url=_S, paragraph=_S, sentence=_S, section=SECTION)),
    all_codeblocks=T.ArrayType(_struct(lang=_S, content=_S, section=SECTION)),
)
FIELDS = tuple(INDEX_TYPE.fieldNames())
GREP_TYPE = T.ArrayType(
    _struct(line=_I, column=_I, text=_S, captures=T.ArrayType(_S), section=SECTION, sentence=_S, paragraph=_S, ancestors=T.ArrayType(_struct(type=_S, text=_S)))
)


# What a text must hold, one at least, for an element to be in it.
TRIGGERS = {
    "el_link": ("](", "<", "http://", "https://", "www."), "el_linkRef": ("[",), "el_image": ("![",), "el_imageRef": ("![",), "el_inlineCode": ("`",), "el_em": ("*", "_"),
    "el_strong": ("*", "_"), "el_del": ("~",), "el_break": ("  \n", "\\\n"), "el_footnote": ("[^",), "el_html": ("<",), "all_links": ("](", "<", "http://", "https://", "www."),
    "all_images": ("![",),
}
#: The fields of kinds of inlines.
OWN = {k: f"el_{k}" for k in ("html", "em", "strong", "del", "break", "footnote", "link", "linkRef", "image", "imageRef")} | {"code": "el_inlineCode"}
#: Kinds of blocks that are always read for a field.
KINDS = {
    "headings": ("heading",), "el_p": ("paragraph", "list", "table", "blockquote", "footnote"), "el_list": ("list",), "el_listItem": ("list",), "el_table": ("table",),
    "el_blockquote": ("blockquote",), "el_html": ("html",), "el_code": ("code",), "all_codeblocks": ("code",), "el_def": ("definition",),
}


def pruned(kind: T.DataType, names: frozenset[str] | None) -> T.DataType:
    """A type of the index without the parts that no one names; a struct keeps one at least."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(pruned(kind.elementType, names))
    if names is None or not isinstance(kind, T.StructType) or kind in (POSITION, POINT):
        return kind
    shown = [f for f in kind if f.name in names] or [next((f for f in kind if f.name != "items"), kind[0])]
    return T.StructType([T.StructField(f.name, pruned(f.dataType, names)) for f in shown])


def literal_of(pattern: str, flags: str) -> tuple[str, bool] | None:
    """The longest text that each match of a pattern holds, and whether in any case; none if that is not plain to see."""
    parser = getattr(re, "_parser", None)
    if parser is None:
        return None
    parsed = parser.parse(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", pattern), re.I if "i" in flags else 0)
    runs = [""]
    for op, value in parsed:
        if str(op) == "LITERAL" and 32 < value < 127:
            runs[-1] += chr(value)
        else:
            runs.append("")
    best = max(runs, key=len)
    ignore = bool(parsed.state.flags & re.I)
    return (best.lower() if ignore else best, ignore) if best else None


class Needs:
    """What is read of bodies: fields of the index, the names of their parts (none: all), and the patterns looked for in texts."""

    def __init__(self, fields: set[str], names: frozenset[str] | None = None, patterns: list[tuple[str, str]] | None = None) -> None:
        self.fields, self.names, self.greps = frozenset(fields), names, bool(patterns)
        self.kinds = {k for f in fields for k in KINDS.get(f, ())}
        if self.part("section") and (self.greps or fields & {"all_links", "all_images", "all_codeblocks"}):
            self.kinds.add("heading")
        self.looked = looked = tuple(sorted({x for f in fields for x in TRIGGERS.get(f, ())}, key=lambda x: (len(x), x)))
        self.named = not looked and not self.greps and self.kinds <= {"heading", "html", "code"}
        if not self.named:
            self.kinds |= {"definition", "footnote"}  # inlines depend on what they name
        literals = [literal_of(*p) for p in patterns or ()]
        self.any_text = None in literals
        self.literals = [x for x in literals if x]
        self.position = self.part("position")
        #: Whether of inlines only references are read; those have a defined label in brackets.
        self.only_references = not self.greps and bool(looked) and not self.fields - {"el_linkRef", "el_imageRef", "el_def", "el_code", "headings"}

    def part(self, name: str) -> bool:
        return self.names is None or name in self.names

    def keep(self, kind: str, text: str) -> bool:
        """Whether a block may hold anything that is read."""
        return kind in self.kinds or self.holds(text)

    def scan(self, source: str) -> list[Block]:
        """The blocks of a source that are read. Where only titles are, what inlines name is left out as long as no title has a bracket."""
        blocks = scan_blocks(source, self.keep)
        if self.named and _bracketed(blocks):
            return scan_blocks(source, lambda kind, text: kind in ("definition", "footnote") or self.keep(kind, text))
        return blocks

    def holds(self, text: str) -> bool:
        """Whether a text may hold an element that is read, or a match."""
        for x in self.looked:
            if x in text:
                return True
        return self.any_text or self.greps and self.matches(text)

    def matches(self, text: str) -> bool:
        """Whether a pattern may match a piece of the text: those are parts of it, but for what a backslash or an entity changes."""
        if "\\" in text or "&" in text:
            return True
        return any(not text.isascii() or part in text.lower() if ignore else part in text for part, ignore in self.literals)


def _bracketed(blocks: list[Block]) -> bool:
    return any("[" in x.text for b in blocks for x in b.lines) or any(_bracketed(b.children) for b in blocks if b.children)


ALL = Needs(set(INDEX_TYPE.fieldNames()), None, [("", "")])


class Places:
    """Line, column and offset of places in joined inline text."""

    def __init__(self, lines: list[Line]) -> None:
        self.lines, self.starts = lines, []
        at = 0
        for x in lines:
            self.starts.append(at)
            at += len(x.text) + 1

    def point(self, at: int) -> dict:
        k = bisect_right(self.starts, at) - 1
        line, over = self.lines[k], at - self.starts[k]
        return {"line": line.number, "column": line.column + over, "offset": line.offset + over}


def _span(first: Line, last: Line) -> dict:
    n = len(last.text.rstrip())
    return {
        "start": {"line": first.number, "column": first.column, "offset": first.offset},
        "end": {"line": last.number, "column": last.column + n, "offset": last.offset + n},
    }


def sentences(text: str) -> list[str]:
    return [s.strip() for s in re.findall(r"[^.!?]*[.!?]+(?=\s|$)|[^.!?]+[.!?]*$|.+?[.!?]+(?=\s|$)", text, re.S) if s.strip()]


class Walker:
    """Walks blocks and inlines in order of the source and gathers elements."""

    def __init__(self, source: str, inline: bool, within: frozenset[str] | None = None, needs: Needs = ALL) -> None:
        self.source, self.inline, self.within, self.needs = source, inline, within, needs
        self.blocks = parse_blocks(lines_of(source)) if needs is ALL else needs.scan(source)
        self.references, self.footnotes = set(), set()
        self._names(self.blocks)
        self.out: dict[str, list] = {f: [] for f in FIELDS}
        self.stack: list[tuple[int, str]] = []
        self.texts: list[tuple] = []  # (text, start point, paragraph, section, ancestors) of text leaves
        self.marks: list[tuple[int, int, int]] = []  # offset and end of headings
        self.said: tuple[str | None, list[str]] = None, []  # a paragraph and its sentences

    def _names(self, blocks: list[Block]) -> None:
        for b in blocks:
            if b.kind == "definition":
                self.references.add(normal(b.label))
            elif b.kind == "footnote":
                self.footnotes.add(normal(b.label))
            self._names(b.children)

    def add(self, name: str, **values) -> None:
        self.out[name].append(values)

    @property
    def section(self) -> list[str]:
        return [title for _, title in self.stack]

    def inlines(self, lines: list[Line], ancestors: list[dict]) -> str:
        """Text of inline content; its elements are gathered."""
        if not self.inline:
            return ""  # headings read their titles themselves
        if self.within is not None and not any(a["type"] in self.within for a in ancestors):
            return ""
        text = lines[0].text if len(lines) == 1 else "\n".join([x.text for x in lines])
        if self.needs.only_references and "\\" not in text and not any(normal(x) in self.references for x in LABELS.findall(text)):
            return ""
        nodes = parse_inlines(text, self.references, self.footnotes)
        whole = plain(nodes)
        if self.within is None and self.needs.holds(text):
            self.gather(nodes, Places(lines), whole, ancestors)
        return whole

    def gather(self, nodes: list[Inline], places: Places, paragraph: str, ancestors: list[dict]) -> None:
        section, exact, fields = self.section, self.needs.position, self.needs.fields
        for n in nodes:
            kind = n.kind
            if kind == "text":
                if self.needs.greps:
                    self.texts.append((n.text, places.point(n.start), paragraph, section, ancestors))
                continue
            if (name := OWN[kind]) in fields or kind in ("link", "image") and f"all_{kind}s" in fields:
                position = {"start": places.point(n.start), "end": places.point(n.end)} if exact else None
                inner = plain(n.children)
                match kind:
                    case "code" | "html":
                        self.add(name, content=n.text, position=position)
                    case "em" | "strong" | "del":
                        self.add(name, content=inner, position=position)
                    case "break":
                        self.add(name, position=position)
                    case "footnote":
                        self.add(name, label=n.label, position=position)
                    case "linkRef":
                        self.add(name, text=inner, identifier=n.label, position=position)
                    case "imageRef":
                        self.add(name, alt=n.text, identifier=n.label, position=position)
                    case "link":
                        self.add(name, text=inner, url=n.url, position=position)
                        if "all_links" in fields:
                            self.add("all_links", text=inner, url=n.url, paragraph=paragraph, sentence=self.sentence(paragraph, inner), section=section)
                    case "image":
                        self.add(name, alt=n.text, url=n.url, position=position)
                        if "all_images" in fields:
                            self.add("all_images", alt=n.text, url=n.url, paragraph=paragraph, sentence=self.sentence(paragraph, n.text), section=section)
            if n.children:
                above = ancestors
                if self.needs.greps:
                    above = [*ancestors, {"type": {"em": "emphasis", "del": "delete", "linkRef": "linkReference"}.get(kind, kind), "text": plain(n.children)}]
                self.gather(n.children, places, paragraph, above)

    def sentence(self, paragraph: str, text: str) -> str | None:
        """The first sentence of a paragraph with a text."""
        if not self.needs.part("sentence"):
            return None
        if self.said[0] is not paragraph:
            self.said = paragraph, sentences(paragraph)
        return next((s for s in self.said[1] if text in s), None)

    def walk(self, blocks: list[Block], ancestors: list[dict]) -> list[str]:
        """Texts of blocks."""
        out = []
        for b in blocks:
            position = _span(b.first, b.last) if self.needs.position or b.kind == "list" else None
            match b.kind:
                case "heading":
                    self.stack = [x for x in self.stack if x[0] < b.level]
                    above = self.section
                    text = b.lines[0].text if len(b.lines) == 1 else "\n".join([x.text for x in b.lines])
                    title = plain(parse_inlines(text, self.references, self.footnotes))
                    self.stack.append((b.level, title))
                    if self.inline and self.needs.holds(text):
                        self.inlines(b.lines, [*ancestors, {"type": "heading", "text": title}])
                    self.add("headings", title=title, level=b.level, content="", position=position, hierarchy=above)
                    self.marks.append((b.first.offset, b.last.offset + len(b.last.text.rstrip()), len(self.out["headings"]) - 1))
                    out.append(title)
                case "paragraph":
                    here = [*ancestors, {"type": "paragraph", "text": None}]
                    text = self.inlines(b.lines, here)
                    here[-1]["text"] = text
                    self.add("el_p", content=text, position=position)
                    out.append(text)
                case "code":
                    self.add("el_code", lang=b.lang, content=b.text, position=position)
                    self.add("all_codeblocks", lang=b.lang, content=b.text, section=self.section)
                    out.append(b.text)
                case "html":
                    self.add("el_html", content=b.text, position=position)
                    out.append(b.text)
                case "definition":
                    self.add("el_def", identifier=normal(b.label), url=b.url, title=b.title, position=position)
                case "blockquote":
                    place = len(self.out["el_blockquote"])
                    self.add("el_blockquote", content="", position=position)
                    texts = self.walk(b.children, [*ancestors, {"type": "blockquote", "text": None}])
                    self.out["el_blockquote"][place]["content"] = "".join(texts)
                    out.append("".join(texts))
                case "footnote":
                    self.walk(b.children, [*ancestors, {"type": "footnoteDefinition", "text": None}])
                case "list":
                    place = len(self.out["el_list"])
                    self.add("el_list", ordered=b.ordered, items=[], position=position)
                    items = [self.item(x, [*ancestors, {"type": "list", "text": None}]) for x in b.children]
                    self.out["el_list"][place]["items"] = [_shallow(x, DEPTH) for x in items]
                    out += [x["content"] for x in items]
                case "table":
                    out.append(self.table(b, position, ancestors))
        return out

    def item(self, b: Block, ancestors: list[dict]) -> dict:
        place = len(self.out["el_listItem"])
        own = {"content": "", "checked": b.checked, "children": [], "position": _span(b.first, b.last)}
        self.out["el_listItem"].append(own)
        before = len(self.out["el_list"])
        texts = self.walk(b.children, [*ancestors, {"type": "listItem", "text": None}])
        own["content"] = "".join(texts)
        own["children"] = [y for x in self.out["el_list"][before:] if self._directly(b, x) for y in x["items"]]
        self.out["el_listItem"][place] = own
        return own

    @staticmethod
    def _directly(b: Block, made: dict) -> bool:
        return any(c.kind == "list" and _span(c.first, c.last) == made["position"] for c in b.children)

    def table(self, b: Block, position: dict, ancestors: list[dict]) -> str:
        rows, texts = [], []
        exact, above = self.needs.position, [*ancestors, {"type": "table", "text": None}, {"type": "tableRow", "text": None}]
        for line, cells in b.cells:
            made = []
            for text, start in cells:
                start = min(start, len(line.text))
                at = Line(text, line.number, line.column + start, line.offset + start)
                content = self.inlines([at], [*above, {"type": "tableCell", "text": text}])
                made.append({"content": content, "position": _span(at, at) if exact else None})
                texts.append(content)
            rows.append({"cells": made, "position": _span(line, line) if exact else None})
        self.add("el_table", headers=rows[0]["cells"], rows=rows[1:], position=position)
        return "".join(texts)

    def run(self) -> Walker:
        self.walk(self.blocks, [{"type": "root", "text": None}])
        if self.needs.part("content"):
            ends = [m[0] for m in self.marks[1:]] + [len(self.source)]
            for (_, end, k), stop in zip(self.marks, ends, strict=False):
                self.out["headings"][k]["content"] = self.source[end:stop].strip()
        for x in self.out["el_listItem"]:
            x["children"] = [_shallow(c, DEPTH - 1) for c in x["children"]]
        return self


def _shallow(item: dict, depth: int) -> dict:
    out = {k: item[k] for k in ("content", "checked", "position")}
    if depth:
        out["children"] = [_shallow(c, depth - 1) for c in item.get("children", [])]
    return out


def _sentence(paragraph: str, text: str) -> str | None:
    return next((s for s in sentences(paragraph) if text in s), None)


def parse_index(body: str | None, inline: bool = True, within: frozenset[str] | None = None, needs: Needs = ALL) -> dict:
    """Elements of a body by the fields of ``INDEX_TYPE``; all empty for a null or empty body. Without ``inline`` only blocks are read; ``within``
    names kinds of blocks whose text alone is read, without the elements in it; what ``needs`` does not name may be left out."""
    if not body:
        return {f: [] for f in INDEX_TYPE.fieldNames()}
    return Walker(body, inline, within, needs).run().out


def grep_text(body: str | None, pattern: str, flags: str = "") -> list[dict]:
    """Matches of a pattern in the text of a body, with the sentence, paragraph, section and ancestors around each."""
    return grep_texts(Walker(body, True).run().texts, pattern, flags) if body else []


def grep_texts(texts: list[tuple], pattern: str, flags: str = "", needs: Needs = ALL) -> list[dict]:
    """:func:`grep_text` over the text leaves of a body that has been walked."""
    speak = needs.part("sentence")
    options = 0
    for f, o in (("i", re.I), ("m", re.M), ("s", re.S)):
        options |= o if f in flags else 0
    wanted = re.compile(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", pattern), options)
    out = []
    for text, point, paragraph, section, ancestors in texts:
        for m in wanted.finditer(text):
            before = text[: m.start()]
            line = point["line"] + before.count("\n")
            column = len(before) - before.rfind("\n") - 1 if "\n" in before else point["column"] - 1 + m.start()
            spoken = paragraph
            out.append({
                "line": line, "column": column, "text": m[0], "captures": list(m.groups()), "section": section,
                "sentence": _sentence(spoken, m[0]) if speak else None, "paragraph": spoken,
                "ancestors": [{"type": a["type"], "text": a["text"]} for a in ancestors] if needs.part("ancestors") else None,
            })
    return out


def outline_text(entries: list[tuple[int, str]], depth: int = 6) -> str:
    """A tree drawing of headings down to a level."""
    shown = [e for e in entries if e[0] <= depth]
    lines, open_levels = [], {}
    for k, (level, title) in enumerate(shown):
        rest = [x[0] for x in shown[k + 1 :]]
        stop = next((j for j, x in enumerate(rest) if x < level), len(rest))
        more = level in rest[:stop]
        lines.append("".join("│   " if open_levels.get(d) else "    " for d in range(1, level)) + ("├── " if more else "└── ") + title)
        open_levels = {d: v for d, v in open_levels.items() if d < level} | {level: more}
    return "\n".join(lines)
