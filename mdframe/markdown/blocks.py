"""Block structure of markdown: a tree of headings, paragraphs, lists, quotes, code, tables, html and definitions.

The parser consumes lines top-down: a container strips its own prefix from its lines and parses what remains, keeping for each
line the place in the source where it starts, so that every node knows its line, column and offset.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*|[^`\n]*)$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
QUOTE = re.compile(r" {0,3}> ?")
BULLET = re.compile(r"( {0,3})([-+*])(?:( +)|$)")
ORDERED = re.compile(r"( {0,3})(\d{1,9})([.)])(?:( +)|$)")
TASK = re.compile(r"\[([ xX])\][ \t]+")
DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(<[^<>\n]*>|\S+)(?:[ \t]+(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*$")
FOOTNOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*")
DELIMITER_CELL = re.compile(r"\s*:?-+:?\s*$")
# Html tag names that open a block.
HTML_BLOCKS = frozenset(
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section "
    "summary table tbody td tfoot th thead title tr track ul".split()
)
HTML_OPEN = re.compile(r" {0,3}<(?:(/?)([A-Za-z][A-Za-z0-9-]*)|!--|\?|![A-Za-z]|!\[CDATA\[)")
HTML_WHOLE = re.compile(r" {0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)[ \t]*$")
RAW_TAGS = ("script", "pre", "style", "textarea")
#: For :func:`scan_blocks`: blanks other than spaces and line ends; blank lines from the start of one; the end of a run of lines that are not blank.
ODD = re.compile(r"[^\S \n]")
ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
BLANK = re.compile(r"(?: *\n)*(?: *\Z)?")
SPACED = re.compile(r"\n +(?:\n|\Z)")
RUN_END = re.compile(r"\n(?= *(?:\n|\Z))|\Z")
#: A first character after which a line by itself is a paragraph, and runs of lines that are one block.
_PLAIN = r"[^\s#`~*\-_+>\d\[<]"
PLAIN = re.compile(_PLAIN)
FLAT_LIST = re.compile(rf"([-+*]) (?:\[[ xX]\] +)?{_PLAIN}[^\n]*(?:\n\1 (?:\[[ xX]\] +)?{_PLAIN}[^\n]*)*")
TASKS = re.compile(r"^[-+*] \[[ xX]\]", re.M)
BARS = re.compile(r"\|[^\n]*(?:\n\|[^\n]*)*")
QUOTES = re.compile(r">[^\n]*(?:\n>[^\n]*)*")
PLAIN_QUOTE = re.compile(rf"> ?{_PLAIN}[^\n]*")
#: A line inside a paragraph that may end it or make it a heading.
INTERRUPT = re.compile(r"\n {0,3}(?:[#>`~*\-_+<=]|1[.)])")


@dataclass(slots=True)
class Line:
    """What is left of a source line, and where that starts."""

    text: str
    number: int
    column: int
    offset: int

    def cut(self, n: int) -> Line:
        return Line(self.text[n:], self.number, self.column + n, self.offset + n)

    @property
    def blank(self) -> bool:
        return not self.text.strip()


@dataclass(slots=True)
class Block:
    kind: str
    first: Line
    last: Line
    children: list = field(default_factory=list)
    lines: list = field(default_factory=list)  # of inline content
    level: int = 0
    text: str = ""
    lang: str | None = None
    ordered: bool = False
    checked: bool | None = None
    cells: list = field(default_factory=list)  # rows of (text, Line) of a table
    label: str = ""
    url: str = ""
    title: str | None = None


def lines_of(source: str) -> list[Line]:
    out, offset = [], 0
    for n, text in enumerate(source.split("\n")):
        out.append(Line(text[:-1] if text.endswith("\r") else text, n + 1, 1, offset))
        offset += len(text) + 1
    return out


def indent(text: str) -> int:
    return len(text) - len(text.lstrip(" \t"))


def split_row(text: str) -> list[tuple[str, int]]:
    """Cells of a table row with their places; a bar after a backslash or inside code stays."""
    cells, start, at, code = [], 0, 0, False
    if "\\" not in text and "`" not in text:
        for cell in text.split("|"):
            cells.append((cell, start))
            start += len(cell) + 1
        cells.pop()
        start, at = start - len(cell) - 1, len(text)
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if c == "`":
            code = not code if text.count("`", at + 1) or code else code
        elif c == "|" and not code:
            cells.append((text[start:at], start))
            start = at + 1
        at += 1
    cells.append((text[start:], start))
    if cells and not cells[0][0].strip():
        cells = cells[1:]
    if cells and not cells[-1][0].strip():
        cells = cells[:-1]
    return [(c.strip().replace("\\|", "|"), s + indent(c)) for c, s in cells]


def starts_block(text: str) -> bool:
    """Whether a line ends a paragraph before it."""
    c = text.lstrip(" ")[:1]
    if not c or c not in "#*-_>`~+<" and not c.isdecimal():
        return False
    if ATX.match(text) or RULE.match(text) or QUOTE.match(text) or FENCE.match(text):
        return True
    m = BULLET.match(text)
    if m and text[m.end():].strip():
        return True
    m = ORDERED.match(text)
    if m and m[2] == "1" and text[m.end():].strip():
        return True
    m = HTML_OPEN.match(text)
    return bool(m and (not m[2] or m[2].lower() in HTML_BLOCKS or m[2].lower() in RAW_TAGS and not m[1]))


def parse_blocks(lines: list[Line]) -> list[Block]:
    out: list[Block] = []
    at = 0
    while at < len(lines):
        at = at + 1 if lines[at].blank else _block(lines, at, out)
    return out


def _block(lines: list[Line], at: int, out: list[Block]) -> int:
    """Add the block that starts in a line that is not blank; the place of the line after it."""
    line = lines[at]
    text = line.text
    if indent(text) >= 4 and text[: len(text) - len(text.lstrip())].replace("\t", "    ")[:4] == "    ":
        return _indented(lines, at, out)
    if m := ATX.match(text):
        inner = m[2] or ""
        start = m.start(2) if m[2] else len(text)
        if re.fullmatch(r"#+", inner):
            inner = ""
        out.append(Block("heading", line, line, level=len(m[1]), lines=[Line(inner, line.number, line.column + start, line.offset + start)]))
        return at + 1
    if m := FENCE.match(text):
        return _fenced(lines, at, m, out)
    if RULE.match(text):
        out.append(Block("rule", line, line))
        return at + 1
    if QUOTE.match(text):
        return _quote(lines, at, out)
    if BULLET.match(text) or ORDERED.match(text):
        return _list(lines, at, out)
    if FOOTNOTE.match(text):
        return _footnote(lines, at, out)
    if m := DEFINITION.match(text):
        out.append(_definition(line, m))
        return at + 1
    if (m := HTML_OPEN.match(text)) and (not m[2] or m[2].lower() in HTML_BLOCKS or m[2].lower() in RAW_TAGS or HTML_WHOLE.match(text)):
        return _html(lines, at, m, out)
    return _paragraph(lines, at, out)


def _definition(line: Line, m: re.Match) -> Block:
    url = m[2][1:-1] if m[2].startswith("<") else m[2]
    return Block("definition", line, line, label=m[1], url=url, title=m[3][1:-1] if m[3] else None)


def _alone(line: Line) -> Block:
    """A paragraph of one line that starts with no blank."""
    text = line.text.rstrip()
    return Block("paragraph", line, line, lines=[line if text == line.text else Line(text, line.number, line.column, line.offset)])


def _flat_list(lines: list[Line]) -> Block:
    """A list of which each item is one line of text."""
    block = Block("list", lines[0], lines[-1])
    for line in lines:
        inner = line.cut(2)
        item = Block("item", line, inner)
        if m := TASK.match(inner.text):
            item.checked = m[1] in "xX"
            inner = inner.cut(m.end())
        item.children.append(_alone(inner))
        block.children.append(item)
    block.last = inner
    return block


@lru_cache(64)
def _fence_end(char: str, n: int) -> re.Pattern:
    return re.compile(rf"^ {{0,3}}{re.escape(char)}{{{n},}} *$", re.M)


def scan_blocks(source: str, keep: Callable[[str, str], bool]) -> list[Block]:
    """The blocks of ``parse_blocks(lines_of(source))`` that ``keep`` wants by their kind and text.

    Runs of lines that are plainly one block are found by patterns over the whole source, and lines are made only of those that are
    kept; what is not plain is parsed line by line, and always kept. The text of a run of bars is a table or a paragraph.
    """
    if any(c in source for c in ODD_ASCII) if source.isascii() else ODD.search(source):
        return parse_blocks(lines_of(source))
    out: list[Block] = []
    size, pos, end, known, number, lines = len(source), 0, -1, 0, 1, None

    def made(start: int, stop: int) -> list[Line]:
        """Lines of a run that starts with a line."""
        nonlocal known, number
        number += source.count("\n", known, start)
        known = start
        run, n = [], number
        for text in source[start:stop].split("\n"):
            run.append(Line(text, n, 1, start))
            start += len(text) + 1
            n += 1
        return run

    spaced = SPACED.search(source)
    while True:
        while pos < size and source[pos] == "\n":
            pos += 1
        if pos >= size or source[pos] == " " and (pos := BLANK.match(source, pos).end()) >= size:
            return out
        c = source[pos]
        stop = source.find("\n", pos)
        stop = size if stop < 0 else stop
        if c == "#" and (m := ATX.match(source, pos, stop)):
            inner, start = m[2] or "", m.start(2) if m[2] else stop
            if inner and not inner.strip("#"):
                inner = ""
            if keep("heading", inner):
                number += source.count("\n", known, pos)
                known = pos
                line = Line(source[pos:stop], number, 1, pos)
                out.append(Block("heading", line, line, level=len(m[1]), lines=[Line(inner, line.number, 1 + start - pos, start)]))
            pos = stop + 1
            continue
        if c in "`~" and (m := FENCE.match(source, pos, stop)):
            if close := _fence_end(m[2][0], len(m[2])).search(source, stop):
                if keep("code", ""):
                    (first,), (last,) = made(pos, stop), made(close.start(), close.end())
                    info = m[3].strip()
                    out.append(Block("code", first, last, text=source[stop + 1 : max(stop + 1, close.start() - 1)], lang=info.split()[0] if info else None))
                pos = close.end()
                continue
        else:
            if pos >= end:
                end = RUN_END.search(source, pos).start() if spaced else source.find("\n\n", pos)
                if end < 0:
                    end = size - 1 if source[-1] == "\n" else size
            plain = c != " "
            if c in "-+*" and FLAT_LIST.fullmatch(source, pos, end):
                after = BLANK.match(source, end).end()
                if after >= size or source[after] not in (" ", c):
                    if keep("list", TASKS.sub("", source[pos:end])):
                        out.append(_flat_list(made(pos, end)))
                    pos = after
                    continue
                plain = False
            elif c in "-+*_" or c.isdecimal():
                plain = not (RULE.match(source, pos, stop) or BULLET.match(source, pos, stop) or ORDERED.match(source, pos, stop))
            elif c == "|" and BARS.fullmatch(source, pos, end):
                if keep("table", source[pos:end]):
                    _paragraph(made(pos, end), 0, out)
                pos = end
                continue
            elif c == ">":
                plain = False
                if QUOTES.fullmatch(source, pos, end):
                    if not PLAIN_QUOTE.fullmatch(source, pos, end):
                        _quote(made(pos, end), 0, out)
                    elif keep("blockquote", source[pos:end]):
                        (line,) = made(pos, end)
                        out.append(Block("blockquote", line, line, children=[_alone(line.cut(2 if line.text[1] == " " else 1))]))
                    pos = end
                    continue
            elif c == "[":
                if m := FOOTNOTE.match(source, pos, stop):
                    plain = False
                    after = BLANK.match(source, end).end()
                    if stop == end and PLAIN.match(source, m.end(), stop) and " " not in source[end : after + 1]:
                        if keep("footnote", ""):
                            (line,) = made(pos, end)
                            inner = line.cut(m.end() - pos)
                            out.append(Block("footnote", line, inner, label=m[1], children=[_alone(inner)] if keep("paragraph", inner.text) else []))
                        pos = after
                        continue
                elif m := DEFINITION.match(source, pos, stop):
                    if keep("definition", ""):
                        out.append(_definition(made(pos, stop)[0], m))
                    pos = stop + 1
                    continue
            elif c == "<" and (m := HTML_OPEN.match(source, pos, stop)):
                plain = False
                if m[2] and m[2].lower() in HTML_BLOCKS:
                    if keep("html", ""):
                        run = made(pos, end)
                        out.append(Block("html", run[0], run[-1], text=source[pos:end]))
                    pos = end
                    continue
            if plain and not INTERRUPT.search(source, pos, end) and (stop >= end or source.find("|", pos, stop) < 0):
                if keep("paragraph", source[pos:end]):
                    run = made(pos, end)
                    body = [x.cut(indent(x.text)) if x.text[0] == " " else x for x in run]
                    if (text := body[-1].text.rstrip()) != body[-1].text:
                        body[-1] = Line(text, body[-1].number, body[-1].column, body[-1].offset)
                    out.append(Block("paragraph", run[0], run[-1], lines=body))
                pos = end
                continue
        if lines is None:
            lines = lines_of(source)
        number += source.count("\n", known, pos)
        known = pos
        at = _block(lines, number - 1, out)
        pos = lines[at].offset if at < len(lines) else size


def _indented(lines: list[Line], at: int, out: list[Block]) -> int:
    start = at
    end = at
    while at < len(lines) and (lines[at].blank or lines[at].text.startswith(("    ", "\t"))):
        if not lines[at].blank:
            end = at
        at += 1
    body = [x.text[4:] if x.text.startswith("    ") else x.text[1:] if x.text.startswith("\t") else "" for x in lines[start : end + 1]]
    out.append(Block("code", lines[start], lines[end], text="\n".join(body)))
    return end + 1


def _fenced(lines: list[Line], at: int, m: re.Match, out: list[Block]) -> int:
    first, fence, pad = lines[at], m[2], len(m[1])
    close = re.compile(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$")
    body = []
    at += 1
    last = first
    while at < len(lines):
        last = lines[at]
        at += 1
        if close.match(last.text):
            break
        body.append(last.text[min(pad, indent(last.text)):])
    info = m[3].strip()
    out.append(Block("code", first, last, text="\n".join(body), lang=info.split()[0] if info else None))
    return at


def _quote(lines: list[Line], at: int, out: list[Block]) -> int:
    inner, start = [], at
    open_paragraph = False
    while at < len(lines):
        line = lines[at]
        m = QUOTE.match(line.text)
        if m:
            inner.append(line.cut(m.end()))
            rest = inner[-1].text
            open_paragraph = bool(rest.strip()) and not ATX.match(rest) and not FENCE.match(rest) and not RULE.match(rest)
        elif line.blank or not open_paragraph or starts_block(line.text):
            break
        else:
            inner.append(line)
        at += 1
    out.append(Block("blockquote", lines[start], lines[at - 1], children=parse_blocks(inner)))
    return at


def _marker(text: str) -> tuple[str, int, int] | None:
    """Kind of a list marker, its indent and the width of marker and spaces."""
    m = BULLET.match(text)
    if m:
        if RULE.match(text):
            return None
        spaces = len(m[3]) if m[3] else 1
        return m[2], len(m[1]), len(m[1]) + 1 + (spaces if spaces <= 4 else 1)
    m = ORDERED.match(text)
    if m:
        spaces = len(m[4]) if m[4] else 1
        return m[3], len(m[1]), len(m[1]) + len(m[2]) + 1 + (spaces if spaces <= 4 else 1)
    return None


def _list(lines: list[Line], at: int, out: list[Block]) -> int:
    kind = _marker(lines[at].text)
    if kind is None:
        return _paragraph(lines, at, out)
    mark = kind[0]
    block = Block("list", lines[at], lines[at], ordered=mark in ".)")
    while at < len(lines):
        got = _marker(lines[at].text) if not lines[at].blank else None
        if got is None or got[0] != mark:
            break
        start, width = at, got[2]
        inner = [lines[at].cut(min(width, len(lines[at].text)))]
        at += 1
        gap, open_paragraph = False, bool(inner[0].text.strip())
        while at < len(lines):
            line = lines[at]
            if line.blank:
                inner.append(line.cut(len(line.text)))
                gap = True
            elif indent(line.text) >= width:
                inner.append(line.cut(width))
                gap = False
            elif gap or not open_paragraph or starts_block(line.text) or _marker(line.text):
                break
            else:
                inner.append(line.cut(indent(line.text)))
            at += 1
        while inner and inner[-1].blank and len(inner) > 1:
            inner.pop()
        item = Block("item", lines[start], inner[-1])
        m = TASK.match(inner[0].text)
        if m:
            item.checked = m[1] in "xX"
            inner[0] = inner[0].cut(m.end())
        item.children = parse_blocks(inner)
        block.children.append(item)
        block.last = inner[-1]
        while at < len(lines) and lines[at].blank:
            at += 1
    return at if out.append(block) is None else at


def _footnote(lines: list[Line], at: int, out: list[Block]) -> int:
    m = FOOTNOTE.match(lines[at].text)
    first = lines[at]
    inner = [first.cut(m.end())]
    at += 1
    while at < len(lines) and (lines[at].text.startswith("    ") or lines[at].blank and at + 1 < len(lines) and lines[at + 1].text.startswith("    ") or (not lines[at].blank and not inner[-1].blank and not starts_block(lines[at].text) and not FOOTNOTE.match(lines[at].text) and not DEFINITION.match(lines[at].text))):
        inner.append(lines[at].cut(4) if lines[at].text.startswith("    ") else lines[at])
        at += 1
    out.append(Block("footnote", first, inner[-1], label=m[1], children=parse_blocks(inner)))
    return at


def _html(lines: list[Line], at: int, m: re.Match, out: list[Block]) -> int:
    text, start = lines[at].text, at
    name = (m[2] or "").lower()
    close = None
    if name in RAW_TAGS and not m[1]:
        close = re.compile(rf"</(?:{'|'.join(RAW_TAGS)})>", re.I)
    elif "<!--" in m[0]:
        close = re.compile("-->")
    elif m[0].rstrip().endswith("?"):
        close = re.compile(r"\?>")
    elif m[0].rstrip().endswith("["):
        close = re.compile(r"\]\]>")
    elif not name:
        close = re.compile(">")
    if close:
        while at < len(lines) and not close.search(lines[at].text if at > start else text[m.end():]):
            at += 1
        at = min(at + 1, len(lines))
    else:
        while at < len(lines) and not lines[at].blank:
            at += 1
    out.append(Block("html", lines[start], lines[at - 1], text="\n".join(x.text for x in lines[start:at])))
    return at


def _paragraph(lines: list[Line], at: int, out: list[Block]) -> int:
    start = at
    while at < len(lines):
        line = lines[at]
        if line.blank or at > start and starts_block(line.text):
            if at > start and not line.blank and (s := SETEXT.match(line.text)) and s[1][0] == "-" and not BULLET.match(line.text):
                pass
            else:
                break
        if at > start and (s := SETEXT.match(line.text)):
            body = [x.cut(indent(x.text)) for x in lines[start:at]]
            body[-1] = Line(body[-1].text.rstrip(), body[-1].number, body[-1].column, body[-1].offset)
            out.append(Block("heading", lines[start], line, level=1 if s[1][0] == "=" else 2, lines=body))
            return at + 1
        if at == start and at + 1 < len(lines) and "|" in line.text:
            header, rule = split_row(line.text), split_row(lines[at + 1].text)
            if rule and "-" in lines[at + 1].text and len(header) == len(rule) and all(DELIMITER_CELL.match(c) for c, _ in rule):
                return _table(lines, at, header, out)
        at += 1
    body = [x.cut(indent(x.text)) for x in lines[start:at]]
    last = body[-1]
    body[-1] = Line(last.text.rstrip(), last.number, last.column, last.offset)
    out.append(Block("paragraph", lines[start], lines[at - 1], lines=body))
    return at


def _table(lines: list[Line], at: int, header: list[tuple[str, int]], out: list[Block]) -> int:
    block = Block("table", lines[at], lines[at + 1])
    block.cells.append((lines[at], header))
    at += 2
    while at < len(lines) and not lines[at].blank and not starts_block(lines[at].text):
        row = split_row(lines[at].text)[: len(header)]
        block.cells.append((lines[at], row + [("", len(lines[at].text))] * (len(header) - len(row))))
        block.last = lines[at]
        at += 1
    out.append(block)
    return at
