"""Bodies are read only where an element may be, with the same results as a whole parse."""

import random

import pytest

from mdframe.functions.content import names_of
from mdframe.lang import parse
from mdframe.markdown import index
from mdframe.markdown.blocks import lines_of, parse_blocks, scan_blocks

ORDER = (
    "# Order 1\n\n## Items\n\n- [x] part 1\n- [ ] part 2\n\n## Links\n\n[part 1](https://p/1)\n[part 2](https://p/2)\n\n### Data\n\n```F\nstatus F\n```\n\n"
    "| line | quantity |\n|---|---|\n| 1 | 2 |\n\n> note 1\n\nAn *em 1* and **strong** with ~~gone~~ and `code` ![pic](p1.png) and [ref][r].  \nTODO call(1) here.[^1]\n\n"
    "[r]: https://ref.example/1\n[^1]: foot\n\n<div>raw</div>\n"
)
PIECES = [
    "# ", "###### x ##", "#", "- ", "* ", "1. ", "> ", "```", "~~~", "    ", "  ", " ", "\n", "\n\n", "\n\n", "\n", "|", "| a | b |\n|---|---|\n| 1 | 2 |\n", "---", "===", "[x] ",
    "[r]: http://u 'T'", "[^1]: note", "[^1]", "[r]", "[a][r]", "![i](u)", "![i][r]", "[t](http://l)", "<div>", "<!-- c", "-->", "<script>", "<em>", "<b@c.de>", "www.a.b", "*e*", "**s**",
    "~~d~~", "`c`", "``", "a", "b c", "\\\n", "  \n", "\\*", "&amp;", "\\|", "é", "K", "1", "call(7)", "TODO", "\n\n- a\n- b\n\n", "\n- [x] part 1\n- [ ] part 2\n\n", "\n\ntext\n\n", "\t", "\r\n",
]
PATTERNS = [(r"call\((\d+)\)", ""), ("todo", "i"), ("a|b", ""), ("k", "i")]
PARTS = "title level content position hierarchy text url identifier alt lang checked children label section sentence paragraph headers rows cells ordered items ancestors".split()
TEXTS = {"el_table": "table", "el_p": "paragraph", "el_listItem": "listItem", "el_list": "listItem", "el_blockquote": "blockquote"}


def documents(n):
    rnd = random.Random(7)
    yield ORDER
    for _ in range(n):
        if rnd.random() < 0.3:
            at = rnd.randrange(len(ORDER))
            yield ORDER[:at] + rnd.choice(PIECES) + ORDER[at + rnd.choice([0, 1, 3]) :]
        else:
            yield "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(1, 40)))


def cut(value, kind):
    """What a type holds of a value."""
    if value is None or not hasattr(kind, "elementType") and not hasattr(kind, "fields"):
        return value
    if hasattr(kind, "elementType"):
        return [cut(x, kind.elementType) for x in value]
    return {f.name: cut(value[f.name], f.dataType) for f in kind}


def test_scan_equals_parse():
    for doc in documents(1500):
        assert scan_blocks(doc, lambda kind, text: True) == parse_blocks(lines_of(doc)), doc


def test_needed_fields_equal_whole_index():
    rnd = random.Random(3)
    for doc in documents(1500):
        whole = index.parse_index(doc)
        fields = set(rnd.sample(index.INDEX_TYPE.fieldNames(), rnd.choice([1, 2, 3])))
        names = None if rnd.random() < 0.3 else frozenset(rnd.sample(PARTS, rnd.randrange(1, 12)))
        patterns = rnd.sample(PATTERNS, rnd.choice([0, 0, 1, 2]))
        needs = index.Needs(fields, names, patterns)
        other = {f for f in fields if f in index.TRIGGERS}
        inline = bool(other or patterns or fields & set(TEXTS))
        within = None if patterns or other else frozenset(TEXTS[f] for f in fields & set(TEXTS))
        walker = index.Walker(doc, inline, within, needs).run()
        for f in fields:
            kind = index.pruned(index.INDEX_TYPE[f].dataType, names)
            if not needs.position and "position" in kind.simpleString():  # kept so that there is something to count
                assert len(whole[f]) == len(walker.out[f])
            else:
                assert cut(whole[f], kind) == cut(walker.out[f], kind), (doc, f, names)
        for p in patterns:
            kind = index.pruned(index.GREP_TYPE, names)
            assert cut(index.grep_text(doc, *p), kind) == cut(index.grep_texts(walker.texts, *p, needs), kind), (doc, p)


def test_names_of():
    read = lambda q: names_of(parse(q))
    assert "position" not in read("select em[0].content, link('a*').count(), h1.map(title), listItem.filter(checked = true).count() from docs where has section('A')")
    assert "position" in read("select em[0].position.start.line from docs")
    assert {"url", "rows", "cells"} <= read("select link('*a').count(), tableRow.map(cells[1].content) from docs")
    for whole in ("em", "em[0]", "h1[0].keys()", "link.unique().count()", "section('A')", "sections().map(_)", "sections().sort()"):
        assert read(f"select {whole} as x from docs") is None, whole


@pytest.mark.parametrize(("fields", "marks"), [
    ({"headings"}, "\0"), ({"el_image"}, "!["), ({"el_inlineCode", "el_code"}, "`"), ({"el_em", "el_html"}, "*_<"), ({"el_linkRef", "el_imageRef", "el_def"}, "[r]"), ({"el_link"}, "]("), ({"el_break", "el_footnote"}, "[^"),
])
def test_only_what_may_hold_an_element_is_read(monkeypatch, fields, marks):
    """A query of a few elements reads the inlines of the blocks that may hold them, and of titles if those are read; before, of all."""
    read = []
    parse_inlines = index.parse_inlines
    monkeypatch.setattr(index, "parse_inlines", lambda text, *names: read.append(text) or parse_inlines(text, *names))
    index.parse_index(ORDER, fields != {"headings"}, None, index.Needs(fields, frozenset({"title", "alt", "identifier", "url", "content"})))
    titles = {"Order 1", "Items", "Links", "Data"}
    assert set(read) == titles if fields == {"headings"} else len(read) <= 3 and not titles & set(read) and any(m in text for text in read for m in (marks, *marks))
    read.clear()
    index.parse_index(ORDER)
    assert len(read) > 12
