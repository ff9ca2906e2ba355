"""Inline structure of markdown: text, code, emphasis, links, images, references, breaks, html, strikethrough, footnotes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

CODE = re.compile(r"(`+)(?!`)(.*?)(?<!`)\1(?!`)", re.S)
AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)+)>")
HTML = re.compile(r"<(?:/?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|!--.*?--|\?.*?\?|![A-Z][^>]*)>", re.S)
BARE_URL = re.compile(r"(?:https?://|www\.)[^\s<]*[^\s<?!.,:*_~'\")\]]")
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
#: Where something other than plain text may begin.
SPECIAL = re.compile(r"[\\\n`<\[*_~!hw](?:(?<![!hw])|(?<=!)(?=\[)|(?<=h)(?=ttps?://)|(?<=w)(?=ww\.))")
RUNS = {c: re.compile(re.escape(c) + "+") for c in "`*_~"}
#: A link without brackets, escapes or entities in its text and without blanks or brackets in its place.
PLAIN_LINK = re.compile(r"\[([^^\\`\[\]\n&][^\\`\[\]\n&]*)\]\(([^\s()\\<>&]*)\)")
BRACKETS = re.compile(r"[\\`\[\]]")
PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
DESTINATION = re.compile(r"\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)))?\s*\)", re.S)


@dataclass(slots=True)
class Inline:
    kind: str  # text, code, em, strong, del, link, image, linkRef, imageRef, footnote, break, html
    start: int
    end: int
    text: str = ""
    url: str = ""
    label: str = ""
    children: list = field(default_factory=list)


def plain(nodes: list[Inline]) -> str:
    """Text of leaves, one after another; an image gives its alternative text nothing."""
    if len(nodes) == 1 and nodes[0].kind == "text":
        return nodes[0].text
    out = []
    for n in nodes:
        if n.kind in ("text", "code", "html"):
            out.append(n.text)
        elif n.kind == "break":
            out.append("")
        elif n.kind not in ("image", "imageRef", "footnote"):
            out.append(plain(n.children))
    return "".join(out)


def normal(label: str) -> str:
    return re.sub(r"\s+", " ", label.strip()).lower()


def _unescape(text: str) -> str:
    if "\\" not in text and "&" not in text:
        return text
    import html

    text = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text)
    return ENTITY.sub(lambda m: html.unescape(m[0]), text)


def _closing(text: str, at: int, end: int) -> int:
    """Place before ``end`` of the bracket that closes the one at ``at``, or -1."""
    depth = 0
    while m := BRACKETS.search(text, at, end):
        at = m.start()
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if c == "`" and (m := CODE.match(text, at, end)):
            at = m.end()
            continue
        if c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if depth == 0:
                return at
        at += 1
    return -1


class Reader:
    def __init__(self, text: str, references: set[str], footnotes: set[str]) -> None:
        self.text, self.references, self.footnotes = text, references, footnotes

    def read(self, start: int, end: int, in_link: bool = False) -> list[Inline]:
        text = self.text
        out: list = []  # Inline or delimiter runs [char, count, start, can_open, can_close]
        at = held = start
        loose = False  # whether anything has to be paired or joined

        def flush(upto: int) -> None:
            if upto > held:
                out.append(Inline("text", held, upto, _unescape(text[held:upto])))

        while at < end:
            special = SPECIAL.search(text, at, end)
            if special is None:
                break
            at = special.start()
            c = text[at]
            node = None
            if c == "\\" and at + 1 < end:
                if text[at + 1] == "\n":
                    node = Inline("break", at, at + 2)
                elif text[at + 1] in PUNCTUATION:
                    at += 2
                    continue
            elif c == "\n":
                spaces = len(text[held:at]) - len(text[held:at].rstrip(" "))
                if spaces >= 2:
                    flush(at - spaces)
                    node = Inline("break", at - spaces, at + 1)
                    out.append(node)
                    at = held = at + 1
                    continue
            elif c == "`":
                m = CODE.match(text, at, end)
                if m:
                    inner = m[2].replace("\n", " ")
                    if len(inner) > 1 and inner[0] == inner[-1] == " " and inner.strip():
                        inner = inner[1:-1]
                    node = Inline("code", at, m.end(), inner)
                else:
                    at = RUNS[c].match(text, at, end).end()
                    continue
            elif c == "<":
                if m := AUTO.match(text, at, end):
                    url = m[1] if ":" in m[1] else f"mailto:{m[1]}"
                    node = Inline("link", at, m.end(), url=url, children=[Inline("text", at + 1, m.end() - 1, m[1])])
                elif m := HTML.match(text, at, end):
                    node = Inline("html", at, m.end(), m[0])
            elif c == "[" or c == "!" and text.startswith("![", at):
                if c == "[" and not in_link and (m := PLAIN_LINK.match(text, at, end)) and not SPECIAL.search(text, at + 1, m.end(1)):
                    node = Inline("link", at, m.end(), url=m[2], children=[Inline("text", at + 1, m.end(1), m[1])])
                else:
                    node = self.bracket(at, end, in_link)
            elif c in "hw" and not in_link and (at == start or not text[at - 1].isalnum()) and (m := BARE_URL.match(text, at, end)):
                url = m[0] if m[0].startswith("http") else f"http://{m[0]}"
                node = Inline("link", at, m.end(), url=url, children=[Inline("text", at, m.end(), m[0])])
            elif c in "*_~":
                run = RUNS[c].match(text, at, end).end() - at
                before = text[at - 1] if at > start else " "
                after = text[at + run] if at + run < end else " "
                left = not after.isspace() and (after not in PUNCTUATION or before.isspace() or before in PUNCTUATION)
                right = not before.isspace() and (before not in PUNCTUATION or after.isspace() or after in PUNCTUATION)
                opens, closes = left, right
                if c == "_":
                    opens, closes = left and (not right or before in PUNCTUATION), right and (not left or after in PUNCTUATION)
                flush(at)
                loose = True
                if c == "~" and run > 2:
                    out.append(Inline("text", at, at + run, text[at : at + run]))
                else:
                    out.append([c, run, at, opens, closes])
                at = held = at + run
                continue
            if node is not None:
                flush(at)
                out.append(node)
                at = held = node.end
            else:
                at += 1
        flush(end)
        return self.emphasis(out) if loose else out

    def bracket(self, at: int, end: int, in_link: bool) -> Inline | None:
        text = self.text
        image = text[at] == "!"
        open_at = at + image
        close = _closing(text, open_at, end)
        if close < 0:
            return None
        inner = text[open_at + 1 : close]
        if not image and inner.startswith("^") and normal(inner[1:]) in self.footnotes:
            return Inline("footnote", at, close + 1, label=inner[1:])
        if in_link and not image:
            return None
        if close + 1 < end and text[close + 1] == "(" and (m := DESTINATION.match(text, close + 2, end)):
            url = _unescape(m[1] if m[1] is not None else m[2] or "")
            return self.linked("image" if image else "link", at, m.end(), open_at + 1, close, url=url)
        label, stop = inner, close + 1
        if close + 1 < end and text[close + 1] == "[":
            second = _closing(text, close + 1, end)
            if second > 0:
                label, stop = text[close + 2 : second] or inner, second + 1
        if normal(label) in self.references:
            return self.linked("imageRef" if image else "linkRef", at, stop, open_at + 1, close, label=normal(label))
        return None

    def linked(self, kind: str, at: int, stop: int, first: int, close: int, url: str = "", label: str = "") -> Inline:
        if SPECIAL.search(self.text, first, close):
            inner = self.read(first, close, in_link=True)
        else:
            inner = [Inline("text", first, close, _unescape(self.text[first:close]))] if close > first else []
        if kind in ("link", "linkRef"):
            return Inline(kind, at, stop, url=url, label=label, children=inner)
        return Inline(kind, at, stop, text=plain(inner), url=url, label=label)

    def emphasis(self, items: list) -> list[Inline]:
        """Pair delimiter runs: each closer with the nearest opener of its kind, two at a time where both have two."""
        at = 0
        while at < len(items):
            run = items[at]
            if not isinstance(run, list) or not run[4]:
                at += 1
                continue
            k = at - 1
            while k >= 0:
                other = items[k]
                if isinstance(other, list) and other[0] == run[0] and other[3] and other[1] and not (
                    run[0] != "~" and (other[4] or run[3]) and (other[1] + run[1]) % 3 == 0 and (other[1] % 3 or run[1] % 3)
                ) and (run[0] != "~" or other[1] == run[1]):
                    break
                k -= 1
            if k < 0:
                at += 1
                continue
            opener = items[k]
            n = run[1] if run[0] == "~" else 2 if opener[1] >= 2 and run[1] >= 2 else 1
            kind = "del" if run[0] == "~" else "strong" if n == 2 else "em"
            inner = self.settle(items[k + 1 : at])
            node = Inline(kind, opener[2] + opener[1] - n, run[2] + n, children=inner)
            opener[1] -= n
            run[1] -= n
            run[2] += n
            items[k + 1 : at] = [node]
            if not opener[1]:
                del items[k]
                k -= 1
            at = k + 2
            if not run[1]:
                del items[at]
        return self.settle(items)

    def settle(self, items: list) -> list[Inline]:
        out = []
        for x in items:
            if isinstance(x, list):
                if not x[1]:
                    continue
                x = Inline("text", x[2], x[2] + x[1], x[0] * x[1])
            if out and out[-1].kind == x.kind == "text":
                out[-1] = Inline("text", out[-1].start, x.end, out[-1].text + x.text)
            else:
                out.append(x)
        return out


def parse_inlines(text: str, references: set[str], footnotes: set[str]) -> list[Inline]:
    if not SPECIAL.search(text):
        return [Inline("text", 0, len(text), _unescape(text))] if text else []
    return Reader(text, references, footnotes).read(0, len(text))
