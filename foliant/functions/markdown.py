"""Markdown reader: blocks and inlines of the CommonMark and GFM constructs that documents use."""

from __future__ import annotations

import base64
import html
import re
from dataclasses import dataclass, field, replace

from .model import Cell, Document, Font, Inline, ListLevel, Paragraph, Table
from .text import BLOCK_TAG

_FENCE = re.compile(r"^( {0,3})(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*?)[ \t]*$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r"^ {0,3}>[ ]?")
_ITEM = re.compile(r"^( {0,3})([-+*]|[0-9]{1,9}[.)])([ \t]+|$)")
_DELIMITERS = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r"^ {0,3}\[(?!\^)((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|\S+)(?:[ \t]*\n?[ \t]+(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)")
_FOOTNOTE = re.compile(r"^ {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
_HTML = re.compile(r"^ {0,3}</?(?:address|article|aside|blockquote|center|div|dl|dt|dd|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)(?:[\s/>]|$)", re.I)


@dataclass
class Block:
    kind: str
    text: str = ""
    level: int = 0
    info: str = ""
    start: int = 1
    children: list[Block] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    align: list[int] = field(default_factory=list)


def lines_of(text: str) -> list[str]:
    out = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return out[:-1] if out and out[-1] == "" else out


def _indent(line: str) -> int:
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4
        else:
            break
    return n


def _cut(line: str, n: int) -> str:
    """The line without up to n columns of leading blanks; a tab is four."""
    while n > 0 and line[:1] in (" ", "\t"):
        n -= 4 if line[0] == "\t" else 1
        line = line[1:]
    return " " * -n + line if n < 0 else line


def _opens(line: str, following: str = "") -> bool:
    """Whether a line ends the paragraph before it."""
    if not line.strip() or _FENCE.match(line) or _ATX.match(line) or _RULE.match(line) or _QUOTE.match(line) or _HTML.match(line) or _FOOTNOTE.match(line) or _table_at(line, following):
        return True
    m = _ITEM.match(line)
    return bool(m and line[m.end() :].strip() and (not m[2][0].isdigit() or m[2][:-1] == "1"))


def cells_of(line: str) -> list[str]:
    s = line.strip()
    s = s[1:] if s.startswith("|") else s
    if s.endswith("|") and not s.endswith("\\|"):
        s = s[:-1]
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", s)]


def _table_at(line: str, following: str) -> bool:
    return "|" in line and "|" in following and _indent(line) < 4 and bool(_DELIMITERS.match(following)) and len(cells_of(line)) == len(cells_of(following))


def label_key(label: str) -> str:
    return " ".join(label.split()).upper()


class BlockParser:
    def __init__(self, keep_empty: bool = False):
        self.definitions: dict[str, tuple[str, str]] = {}
        self.footnotes: dict[str, list[Block]] = {}
        self.keep_empty = keep_empty

    def parse(self, lines: list[str]) -> list[Block]:
        out: list[Block] = []
        i, blanks = 0, 0
        while i < len(lines):
            line, following = lines[i], lines[i + 1] if i + 1 < len(lines) else ""
            if not line.strip():
                blanks += 1
                if self.keep_empty and blanks > 1:
                    out.append(Block("empty"))
                i += 1
                continue
            blanks = 0
            for take in (self._fence, self._atx, self._rule, self._table, self._quote, self._footnote, self._definition, self._list, self._code, self._html, self._paragraph):
                end = take(lines, i, following, out)
                if end:
                    i = end
                    break
        return out

    def _fence(self, lines, i, following, out):
        m = _FENCE.match(lines[i])
        if not m:
            return 0
        close = re.compile(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
        body, j = [], i + 1
        while j < len(lines) and not close.match(lines[j]):
            body.append(_cut(lines[j], len(m[1])))
            j += 1
        out.append(Block("fence", "\n".join(body), info=m[3], level=1 if m[2][0] == "~" else 0))
        return min(j + 1, len(lines)) or 1

    def _atx(self, lines, i, following, out):
        m = _ATX.match(lines[i])
        if m:
            text = (m[2] or "").strip()
            out.append(Block("heading", "" if re.fullmatch("#+", text) else text, len(m[1])))
        return i + 1 if m else 0

    def _rule(self, lines, i, following, out):
        if _RULE.match(lines[i]):
            out.append(Block("rule"))
            return i + 1
        return 0

    def _table(self, lines, i, following, out):
        if not _table_at(lines[i], following):
            return 0
        align = [1 if c.startswith(":") and c.endswith(":") else 2 if c.endswith(":") else 0 for c in cells_of(following)]
        rows, j = [cells_of(lines[i])], i + 2
        while j < len(lines) and lines[j].strip() and "|" in lines[j]:
            rows.append(cells_of(lines[j]))
            j += 1
        n = len(rows[0])
        out.append(Block("table", rows=[(r + [""] * n)[:n] for r in rows], align=align))
        return j

    def _quote(self, lines, i, following, out):
        if not _QUOTE.match(lines[i]):
            return 0
        body, j = [], i
        while j < len(lines):
            m = _QUOTE.match(lines[j])
            if m:
                body.append(lines[j][m.end() :])
            elif body and body[-1].strip() and not _opens(lines[j]) and _indent(lines[j]) < 4:
                body.append(lines[j])  # a lazy line
            else:
                break
            j += 1
        out.append(Block("quote", children=self.parse(body) or [Block("paragraph")]))
        return j

    def _continued(self, lines: list[str], j: int, width: int, body: list[str]) -> int:
        """Takes the lines that belong to an item or footnote with content at `width`."""
        while j < len(lines):
            line = lines[j]
            if not line.strip():
                k = j
                while k < len(lines) and not lines[k].strip():
                    k += 1
                if k == len(lines) or _indent(lines[k]) < width:
                    return j
                body.extend([""] * (k - j))
                j = k
            elif _indent(line) >= width:
                body.append(_cut(line, width))
                j += 1
            elif body and body[-1].strip() and not _opens(line) and not _ITEM.match(line) and not _FENCE.match(body[-1]):
                body.append(line.lstrip())
                j += 1
            else:
                return j
        return j

    def _footnote(self, lines, i, following, out):
        m = _FOOTNOTE.match(lines[i])
        if not m:
            return 0
        body = [m[2]]
        j = self._continued(lines, i + 1, 4, body)
        self.footnotes.setdefault(label_key(m[1]), self.parse(body))
        return j

    def _definition(self, lines, i, following, out):
        if not re.match(r"^ {0,3}\[(?!\^)", lines[i]):
            return 0
        for k in range(min(len(lines), i + 8), i, -1):
            m = _DEFINITION.match("\n".join(lines[i:k]) + "\n")
            if m and m.end() == len("\n".join(lines[i:k])) + 1:
                title = unescape(m[3][1:-1]) if m[3] else ""
                uri = m[2][1:-1] if m[2].startswith("<") else m[2]
                self.definitions.setdefault(label_key(m[1]), (unescape(uri), title))
                return k
        return 0

    def _list(self, lines, i, following, out):
        m = _ITEM.match(lines[i])
        if not m:
            return 0
        marker = m[2][-1]
        ordered = m[2][0].isdigit()
        block = Block("list", info=marker, level=int(ordered), start=int(m[2][:-1]) if ordered else 1)
        j = i
        while j < len(lines):
            m = _ITEM.match(lines[j])
            if not m or m[2][-1] != marker or m[2][0].isdigit() != ordered or _RULE.match(lines[j]):
                break
            rest = lines[j][m.end() :]
            gap = _indent(m[3])
            width = len(m[1]) + len(m[2]) + (gap if 1 <= gap <= 4 and rest.strip() else 1)
            body = [(" " * (gap - 1) if gap > 4 else "") + rest]
            j = self._continued(lines, j + 1, width, body)
            block.children.append(Block("item", children=self.parse(body) or [Block("paragraph")]))
            k = j
            while k < len(lines) and not lines[k].strip():
                k += 1
            n = _ITEM.match(lines[k]) if k < len(lines) else None
            if n and n[2][-1] == marker and n[2][0].isdigit() == ordered:
                j = k
        out.append(block)
        return j

    def _code(self, lines, i, following, out):
        if _indent(lines[i]) < 4:
            return 0
        body, j = [], i
        while j < len(lines) and (not lines[j].strip() or _indent(lines[j]) >= 4):
            body.append(_cut(lines[j], 4))
            j += 1
        while body and not body[-1].strip():
            body.pop()
        out.append(Block("code", "\n".join(body)))
        return j

    def _html(self, lines, i, following, out):
        if not _HTML.match(lines[i]):
            return 0
        j = i
        while j < len(lines) and lines[j].strip():
            j += 1
        out.append(Block("html", "\n".join(lines[i:j])))
        return j

    def _paragraph(self, lines, i, following, out):
        body, j = [lines[i]], i + 1
        while j < len(lines):
            m = _SETEXT.match(lines[j])
            if m:
                out.append(Block("heading", "\n".join(x.strip() for x in body), 1 if m[1][0] == "=" else 2, info="setext"))
                return j + 1
            if _opens(lines[j], lines[j + 1] if j + 1 < len(lines) else ""):
                break
            body.append(lines[j])
            j += 1
        out.append(Block("paragraph", "\n".join(x.lstrip() for x in body).rstrip()))
        return j


# ---- inlines -------------------------------------------------------------------------------------------------

_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_AUTOLINK = re.compile(r"<([a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*|[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*)>")
_TAG = re.compile(r"<!--.*?-->|</?([a-zA-Z][a-zA-Z0-9-]*)(?:\s[^<>]*)?/?>", re.S)
_TARGET = re.compile(r"\(\s*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
# Formatting that HTML tags stand for.
_TAG_FONT = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "ins": "underline", "s": "strike", "strike": "strike", "del": "strike", "sub": "subscript", "sup": "superscript", "code": "code"}


def unescape(s: str) -> str:
    return html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: m[1] if m[1] != "&" else "&amp;", s))


@dataclass
class _Run:
    """A run of delimiters that may open or close emphasis."""

    char: str
    count: int
    opens: bool
    closes: bool
    origin: int
    font: dict[str, bool] = field(default_factory=dict)


class InlineParser:
    def __init__(self, definitions: dict[str, tuple[str, str]], footnotes: dict[str, list[Block]]):
        self.definitions, self.footnotes = definitions, footnotes

    def parse(self, text: str) -> list:
        """Pieces: (text, marks), Inline or delimiter runs already settled into marks."""
        items: list = []
        s = text.strip()
        i, tags = 0, []
        while i < len(s):
            c = s[i]
            if c == "\\" and i + 1 < len(s):
                if s[i + 1] == "\n":
                    items.append("\n")
                    i += 2
                    continue
                if s[i + 1] in _PUNCTUATION:
                    items.append(s[i + 1])
                    i += 2
                    continue
            elif c == "&" and (m := re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});").match(s, i)):
                items.append(html.unescape(m[0]))
                i = m.end()
                continue
            elif c == "\n":
                hard = i >= 2 and s[i - 2 : i] == "  "
                while items and isinstance(items[-1], str) and items[-1].endswith(" "):
                    items[-1] = items[-1].rstrip(" ")
                    if not items[-1]:
                        items.pop()
                items.append("\n" if hard else " ")
                i += 1
                while i < len(s) and s[i] in " \t":
                    i += 1
                continue
            elif c == "`":
                n = len(re.compile("`+").match(s, i)[0])
                m = re.compile(rf"(?<!`)`{{{n}}}(?!`)").search(s, i + n)
                if m:
                    body = s[i + n : m.start()].replace("\n", " ")
                    if body[:1] == " " == body[-1:] and body.strip():
                        body = body[1:-1]
                    items.append(("code", body))
                    i = m.end()
                else:
                    items.append("`" * n)
                    i += n
                continue
            elif c == "<":
                if m := _AUTOLINK.match(s, i):
                    uri = m[1] if ":" in m[1] else "mailto:" + m[1]
                    items.append(("link", [m[1]], uri, ""))
                    i = m.end()
                    continue
                if m := _TAG.match(s, i):
                    name = (m[1] or "").lower()
                    if name == "br":
                        items.append("\n")
                    elif name in _TAG_FONT:
                        items.append(("close" if m[0].startswith("</") else "open", _TAG_FONT[name]))
                    elif name:
                        items.append(m[0])
                    i = m.end()
                    continue
            elif c == "[" and (m := re.compile(r"\[\^([^\]\s]+)\]").match(s, i)) and label_key(m[1]) in self.footnotes:
                items.append(("footnote", label_key(m[1])))
                i = m.end()
                continue
            elif c == "[" or (c == "!" and s[i + 1 : i + 2] == "["):
                got = self._link(s, i)
                if got:
                    items.append(got[0])
                    i = got[1]
                    continue
            elif c in "*_~+":
                n = len(re.compile(re.escape(c) + "+").match(s, i)[0])
                before, after = s[i - 1] if i else " ", s[i + n] if i + n < len(s) else " "
                left = not after.isspace() and (not _punctuation(after) or before.isspace() or _punctuation(before))
                right = not before.isspace() and (not _punctuation(before) or after.isspace() or _punctuation(after))
                opens = left and (c != "_" or not right or _punctuation(before))
                closes = right and (c != "_" or not left or _punctuation(after))
                items.append(_Run(c, n, opens, closes, n) if n >= (2 if c in "~+" else 1) else c * n)
                i += n
                continue
            items.append(c)
            i += 1
        return self._emphasis(items)

    def _link(self, s: str, i: int):
        image = s[i] == "!"
        a = i + 1 + image
        depth, j = 1, a
        while j < len(s) and depth:
            if s[j] == "\\":
                j += 1
            elif s[j] == "`" and (m := re.compile(r"(`+)[^`].*?(?<!`)\1(?!`)", re.S).match(s, j)):
                j = m.end() - 1
            elif s[j] == "[":
                depth += 1
            elif s[j] == "]":
                depth -= 1
            j += 1
        if depth:
            return None
        label, end = s[a : j - 1], j
        m = _TARGET.match(s, j)
        if m:
            uri, title, end = unescape(m[1] if m[1] is not None else m[2] or ""), unescape(m[3][1:-1]) if m[3] else "", m.end()
        else:
            ref = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(s, j)
            key = label_key(ref[1] if ref and ref[1].strip() else label)
            if key not in self.definitions:
                return None
            (uri, title), end = self.definitions[key], ref.end() if ref else j
        if image:
            return ("image", unescape(label), uri, title, s[i:end]), end
        inner = self.parse(label)
        if any(isinstance(x, tuple) and x[0] == "link" for x in inner):
            return None  # no link in a link
        return ("link", inner, uri, title), end

    @staticmethod
    def _emphasis(items: list) -> list:
        """Pairs delimiter runs, nearest opener first; what stays alone is text."""
        openers: list[int] = []
        out: list = []
        for x in items:
            if not isinstance(x, _Run):
                out.append(x)
                continue
            while x.closes and x.count >= (2 if x.char in "~+" else 1):
                hit = next((k for k in reversed(openers) if out[k].char == x.char and out[k].count >= (2 if x.char in "~+" else 1) and not (x.char in "*_" and (out[k].closes or x.opens) and (out[k].origin + x.origin) % 3 == 0 and (out[k].origin % 3 or x.origin % 3))), None)
                if hit is None:
                    break
                o = out[hit]
                n = min(o.count, x.count, 2)
                mark = {"~": "strike", "+": "underline"}.get(x.char, "italic" if n == 1 else "bold")
                out[hit + 1 :] = [y if not isinstance(y, _Run) else y.char * y.count for y in out[hit + 1 :]]
                out.insert(hit + 1, ("open", mark))
                out.append(("close", mark))
                o.count -= n
                x.count -= n
                openers = [k for k in openers if k < hit or (k == hit and o.count)]
            if x.count:
                if x.opens:
                    openers.append(len(out))
                    out.append(x)
                else:
                    out.append(x.char * x.count)
        return [y if not isinstance(y, _Run) else y.char * y.count for y in out]


def _punctuation(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c)[0] in "PS"


# ---- document ------------------------------------------------------------------------------------------------


def link_text(label: str, uri: str, title: str = "") -> str:
    """A link as it stands in a paragraph's text."""
    uri = f"<{uri}>" if re.search(r"\s", uri) else re.sub(r"(?<!\\)([()<>])", r"\\\1", uri)
    note = ' "' + title.replace('"', '\\"') + '"' if title else ""
    return f"[{re.sub(r'(?<!\\)([\[\]])', r'\\\1', label)}]({uri}{note})"


def data_image(uri: str) -> tuple[bytes, str] | None:
    m = re.fullmatch(r"data:(image/(?!svg)[\w.+-]+);base64,([A-Za-z0-9+/\s]+={0,2})", uri)
    if not m:
        return None
    try:
        return base64.b64decode(re.sub(r"\s", "", m[2]), validate=True), m[1]
    except ValueError:
        return None


class Builder:
    def __init__(self, parser: BlockParser):
        self.doc, self.parser = Document(), parser
        self.inline = InlineParser(parser.definitions, parser.footnotes)
        self.notes: list[tuple[int, str]] = []
        self.next_list = 1

    def fill(self, p: Paragraph, text: str, font: Font | None = None) -> Paragraph:
        self._put(p, self.inline.parse(text), font or Font())
        return p

    def _put(self, p: Paragraph, items: list, font: Font) -> None:
        on: dict[str, int] = {}
        now, said = font, []
        for x in items:
            if isinstance(x, str):
                said.append(x)
                continue
            if said:
                p.add("".join(said), now)
                said = []
            if x[0] in ("open", "close"):
                on[x[1]] = max(0, on.get(x[1], 0) + (1 if x[0] == "open" else -1))
                now = replace(font, **{k: True for k, n in on.items() if n})
            elif x[0] == "code":
                p.add(x[1], replace(now, code=True))
            elif x[0] == "link":
                inner = Paragraph()
                self._put(inner, x[1], now)
                p.add(link_text(inner.text, x[2], x[3]), now)
            elif x[0] == "image":
                got = data_image(x[2])
                if got:
                    p.inlines.append(Inline("image", x[1], now, got[0], got[1], x[3]))
                else:
                    p.add(x[4], now)
            elif x[0] == "footnote":
                self.notes.append((len(self.notes) + 1, x[1]))
                p.add(f"[^{len(self.notes)}]", replace(now, superscript=True))
        if said:
            p.add("".join(said), now)

    def blocks(self, blocks: list[Block], into: list, quote: int = 0, item: tuple[int, int] | None = None) -> None:
        first = True
        for b in blocks:
            base = {"quote": quote, "list_id": item[0] if item else None, "level": item[1] if item else 0}
            style = f"Quote{quote - 1 or ''}" if quote else "Normal"
            if b.kind == "heading":
                into.append(self.fill(Paragraph(f"SetextHeading{b.level}" if b.info else f"Heading {b.level}", outline=b.level - 1, **base), b.text))
            elif b.kind in ("fence", "code"):
                name = "IndentedCode" if b.kind == "code" else "FencedCode" + ("~" if b.level else "") + (f".{b.info}" if b.info else "")
                p = Paragraph(name, **base)
                p.add(b.text, Font())
                into.append(p)
            elif b.kind == "rule":
                into.append(Paragraph("HorizontalRule", **base))
            elif b.kind == "quote":
                self.blocks(b.children, into, quote + 1, item)
            elif b.kind == "list":
                level = item[1] + 1 if item else 0
                number = item[0] if item else self.next_list
                if not item:
                    self.next_list += 1
                levels = self.doc.lists.setdefault(number, [])
                while len(levels) <= min(level, 8):
                    levels.append(ListLevel(23, "-", 1))
                levels[min(level, 8)] = ListLevel(0, f"%{level + 1}{b.info}", b.start) if b.level else ListLevel(23, b.info, 1)
                for x in b.children:
                    self.blocks(x.children, into, quote, (number, min(level, 8)))
            elif b.kind == "table":
                rows = [[Cell([self.fill(Paragraph(alignment=a), c)], a) for c, a in zip(r, b.align, strict=False)] for r in b.rows]
                into.append(Table(rows))
            elif b.kind == "html":
                for t in re.split(BLOCK_TAG, b.text):
                    t = html.unescape(re.sub("<[^>]+>", "", t)).strip()
                    if t:
                        p = Paragraph(style, **base)
                        p.add(t, Font())
                        into.append(p)
            elif b.kind == "empty":
                into.append(Paragraph(style, **base))
            else:
                p = Paragraph(style, **base)
                if item and not first:
                    p.style = "ListContinue"
                into.append(self.fill(p, b.text))
            first = False

    def build(self, blocks: list[Block]) -> Document:
        self.blocks(blocks, self.doc.blocks)
        k = 0
        while k < len(self.notes):  # bodies follow at the end, in the order of their references
            number, key = self.notes[k]
            start = len(self.doc.blocks)
            self.blocks(self.parser.footnotes[key], self.doc.blocks)
            if start < len(self.doc.blocks) and isinstance(self.doc.blocks[start], Paragraph):
                self.doc.blocks[start].inlines.insert(0, Inline("run", f"[^{number}]: ", Font(superscript=True)))
            for b in self.doc.blocks[start:]:
                if isinstance(b, Paragraph):
                    b.style = "Footnote Text"
            k += 1
        for b in self.doc.blocks:
            if isinstance(b, Paragraph):
                self.doc.styles.setdefault(b.style, "" if b.style == "Normal" else "Normal")
        return self.doc


def read_markdown(text: str, keep_empty: bool = False) -> Document:
    """Definitions and footnotes count wherever they stand, the first of a label: inlines are read when all blocks are known."""
    parser = BlockParser(keep_empty)
    return Builder(parser).build(parser.parse(lines_of(text or "")))


def read_text(text: str) -> Document:
    return Document([Paragraph(inlines=[Inline("run", x)] if x else []) for x in (text or "").splitlines()])
