"""Markdown writer."""

from __future__ import annotations

import base64
import re

from .model import Cell, Document, Font, Inline, Paragraph, Table

# Emphasis marks from outside in; underline only where asked for.
_MARKS = (("underline", "++", "++"), ("subscript", "<sub>", "</sub>"), ("superscript", "<sup>", "</sup>"), ("strike", "~~", "~~"), ("bold", "**", "**"), ("italic", "*", "*"))
_BLOCK = re.compile(r"^( {0,3})(#{1,6}(?=[ \t]|$)|>|[-+](?=[ \t]|$)|`{3,}|~{3,}|={1,}[ \t]*$|-{2,}[ \t]*$|_{3,}[ \t]*$|\|)")
_ORDERED = re.compile(r"^( {0,3}[0-9]{1,9})([.)])(?=[ \t]|$)")
_LINK = re.compile(r"!?\[(?:[^\[\]\\]|\\.)*\]\((?:<[^<>\n]*>|(?:[^\s()\\]|\\.)*)(?:\s+\"(?:[^\"\\]|\\.)*\")?\)")
_TARGET = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.)*)\]\((<[^<>\n]*>|(?:[^\s()\\]|\\.)*)(?:\s+(\"(?:[^\"\\]|\\.)*\"))?\)")


def escape(text: str) -> str:
    """Marks of emphasis, outside of links."""
    out, at = [], 0
    for m in _LINK.finditer(text):
        out += [_escape(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, _escape(text[at:])])


def _escape(text: str) -> str:
    return re.sub(r"\*|(?<!\w)_|_(?!\w)|<(?=[a-zA-Z/!])", lambda m: "\\" + m[0], text)


def escape_lines(text: str) -> str:
    """Lines that would begin a block of their own."""
    return "\n".join(_ORDERED.sub(r"\1\\\2", _BLOCK.sub(r"\1\\\2", x)) for x in text.split("\n"))


def inline_code(text: str) -> str:
    fence = "`" * (1 + max(map(len, re.findall("`+", text)), default=0))
    pad = " " if text[:1] == "`" or text[-1:] == "`" else ""
    return f"{fence}{pad}{text}{pad}{fence}"


#: What stands where a footnote is referred to, and before its body.
_NOTE = re.compile(r"\[\^[^\]\s]+\](?:: )?")


class MarkdownWriter:
    def __init__(self, underline: bool = False, html_tables: bool = False, links: str = "inline", newline: str = "\n"):
        self.underline, self.html_tables, self.links, self.newline = underline, html_tables, links, newline

    def write(self, doc: Document) -> str:
        self.doc = doc
        blocks: list[tuple[str, int, str]] = []
        for p in doc.headers:
            blocks += [("block", 0, self.image(i)) for i in p.inlines if i.kind == "image"]
        for b in doc.blocks:
            if isinstance(b, Table):
                blocks.append(("table", 0, self.table(b)))
            elif (got := self.paragraph(b)) is not None:
                blocks.append(got)
        for p in doc.footers:
            blocks += [("block", 0, self.image(i)) for i in p.inlines if i.kind == "image"]
        return self.join(self.references(blocks)).replace("\n", self.newline)

    @staticmethod
    def join(blocks: list[tuple[str, int, str]]) -> str:
        """Blocks are parted by blank lines, but for items of a list, headings, rules and quotes that rise.

        A setext heading would take a paragraph before it along, and the second paragraph of an item would join the first.
        """
        out, prev = [], None
        for tag, level, text in blocks:
            if prev:
                headings = ("heading", "setext")
                if (tag == "setext" and prev[0] not in headings) or (tag == "more" and prev[0] in ("item", "more")):
                    out.append("\n\n")
                elif tag in headings or prev[0] in headings or (tag == "item" and prev[0] in ("item", "more")) or tag == prev[0] == "rule":
                    out.append("\n")
                elif tag == prev[0] == "quote":
                    out.append("\n" if level > prev[1] else "\n" + ">" * min(level, prev[1]) + "\n")
                else:
                    out.append("\n\n")
            out.append(text)
            prev = (tag, level)
        text = "".join(out).rstrip()
        return text + "\n" if text else ""

    def paragraph(self, p: Paragraph) -> tuple[str, int, str] | None:
        if p.style.startswith(("FencedCode", "IndentedCode")):
            text = p.text
            if p.style.startswith("IndentedCode"):
                return self.wrap("block", p, "\n".join("    " + x if x else x for x in text.split("\n")))
            char = "~" if p.style.startswith("FencedCode~") else "`"
            fence = char * max(3, 1 + max(map(len, re.findall(rf"(?m)^ {{0,3}}({char}{{3,}})", text)), default=0))
            info = p.style.partition(".")[2]
            return self.wrap("block", p, f"{fence}{info}\n{text}\n{fence}")
        if p.style == "HorizontalRule":
            return self.wrap("rule", p, "---")
        text = self.runs(p)
        if not text.strip() and not any(i.kind == "image" for i in p.inlines):
            if p.outline is None and p.list_id is None and not p.quote:
                return None
        if p.outline is not None:
            n = min(p.outline + 1, 6)
            text = text.replace("\n", " ")
            if p.style.startswith("SetextHeading") and n <= 2 and text:
                return self.wrap("setext", p, f"{text}\n{('=' if n == 1 else '-') * max(3, len(text))}")
            tail = " " + "#" * n if text.endswith("#") else ""
            return self.wrap("heading", p, f"{'#' * n} {text}{tail}".rstrip())
        text = re.sub(r"(?m)^([ \t]{1,3})(?=[^ \t\n])", r"`\1`", escape_lines(text)) if not p.style.startswith("Footnote") else text
        text = text.replace("\n", "  \n")
        if p.style == "Footnote Text" and not _NOTE.match(text):  # goes on with the body above
            text = "    " + text.replace("\n", "\n    ")
        return self.wrap("block", p, text)

    def wrap(self, tag: str, p: Paragraph, text: str) -> tuple[str, int, str]:
        """Inside its list item and quotes."""
        if p.list_id is not None:
            levels = self.doc.lists.get(p.list_id, [])
            indent = ""
            for k in range(p.level):
                indent += " " * (len(self.marker(levels, k)) + 1)
            m = self.marker(levels, p.level)
            first = m + " " if p.style != "ListContinue" else " " * (len(m) + 1)
            hang = "\n" + indent + " " * (len(m) + 1)
            text, tag = indent + first + text.replace("\n", hang), "more" if p.style == "ListContinue" else "item"
        if p.quote:
            text = "\n".join(("> " * p.quote + x).rstrip() for x in text.split("\n"))
            tag = "quote"
        return tag, p.quote, text

    @staticmethod
    def marker(levels: list, k: int) -> str:
        """Ordered items carry their level's start number, not a running one."""
        if k >= len(levels) or levels[k].number_style == 23:
            return levels[k].number_format if k < len(levels) and levels[k].number_format in "-+*" else "-"
        return f"{levels[k].start_at}{levels[k].number_format[-1:] if levels[k].number_format[-1:] in '.)' else '.'}"

    def runs(self, p: Paragraph) -> str:
        """Marks nest: those that last longest open first; white space stays outside of them."""
        pieces, depth = [], 0
        for i in p.inlines:
            if i.kind.startswith("field_"):
                depth = max(0, depth + (1 if i.kind == "field_start" else -1))
            elif i.kind == "image":
                pieces.append((self.image(i), ()))
            elif i.kind == "run" and not depth and i.text:
                if i.font.superscript and _NOTE.fullmatch(i.text):
                    pieces.append((i.text, ()))
                elif i.font.code:
                    pieces.append((inline_code(i.text), self.marks(i.font)))
                else:
                    head, tail = len(i.text) - len(i.text.lstrip()), len(i.text.rstrip())
                    body = i.text.strip()
                    if not body:
                        pieces.append((i.text, None))
                        continue
                    pieces += [(i.text[:head], None)] if head else []
                    pieces.append((escape(body), self.marks(i.font)))
                    pieces += [(i.text[tail:], None)] if tail < len(i.text) else []
        out: list[str] = []
        held: list[tuple] = []
        for k, (text, marks) in enumerate(pieces):
            if marks is None:  # blanks take the marks that go on behind them
                later = next((m for _, m in pieces[k + 1 :] if m is not None), ())
                while any(h not in later for h in held):
                    out.append(held.pop()[2])
                out.append(text)
                continue
            while any(h not in marks for h in held):
                out.append(held.pop()[2])
            lasting = lambda m: next((n for n, (_, x) in enumerate(pieces[k:]) if x is not None and m not in x), len(pieces))  # noqa: B023, E731
            for m in sorted((m for m in marks if m not in held), key=lambda m: -lasting(m)):
                out.append(m[1])
                held.append(m)
            out.append(text)
        while held:
            out.append(held.pop()[2])
        return "".join(out)

    def marks(self, f: Font) -> tuple:
        return tuple(m for m in _MARKS if getattr(f, m[0]) and (m[0] != "underline" or self.underline))

    @staticmethod
    def image(i: Inline) -> str:
        return f"![{i.text}](data:{i.mime};base64,{base64.b64encode(i.content or b'').decode()})"

    def cell(self, c: Cell) -> str:
        texts = [self.runs(p) for p in c.blocks if isinstance(p, Paragraph)]
        return re.sub(r"\s*\n\s*", " ", " ".join(t for t in texts if t)).replace("|", "\\|").strip()

    def table(self, t: Table) -> str:
        rows = [[self.cell(c) for c in r] for r in t.rows]
        n = max(map(len, rows), default=0)
        if self.html_tables:
            esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#x27;")
            return "<table>" + "".join("<tr>" + "".join(f"<{tag}>{esc(c)}</{tag}>" for c in r) + "</tr>" for tag, r in (("th" if k == 0 else "td", r) for k, r in enumerate(rows))) + "</table>"
        rows = [r + [""] * (n - len(r)) for r in rows]
        width = [max(3, *(len(r[k]) for r in rows)) for k in range(n)]
        align = [c.alignment for c in t.rows[0]] + [0] * n if t.rows else []
        line = lambda cells: "| " + " | ".join(cells) + " |"
        marks = [":" + "-" * (w - 2) + ":" if a == 1 else "-" * (w - 1) + ":" if a == 2 else "-" * w for w, a in zip(width, align, strict=False)]
        body = [line([c.ljust(w) for c, w in zip(r, width, strict=True)]) for r in rows]
        return "\n".join([*body[:1], line(marks), *body[1:]])

    def references(self, blocks: list[tuple[str, int, str]]) -> list[tuple[str, int, str]]:
        """Reference links: all (links="reference") or, "auto", destinations used more than once, numbered by first use."""
        if self.links == "inline":
            return blocks
        plain = lambda x: re.sub(r"\\", "", x.strip("<>"))
        used: dict[str, list] = {}
        for _, _, text in blocks:
            if not text.lstrip("> ").startswith(("```", "~~~")):
                for m in _TARGET.finditer(text):
                    if not m[1]:
                        used.setdefault(plain(m[3]), [0, m[3], m[4] or ""])[0] += 1
        keep = [k for k, v in used.items() if v[0] > 1 or self.links == "reference"]
        number = {k: n + 1 for n, k in enumerate(keep)}

        def swap(m: re.Match) -> str:
            k = plain(m[3])
            return f"[{m[2]}][{number[k]}]" if not m[1] and k in number else m[0]

        out = [(t, n, x if x.lstrip("> ").startswith(("```", "~~~")) else _TARGET.sub(swap, x)) for t, n, x in blocks]
        if number:
            out.append(("block", 0, "\n".join(f"[{n}]: {used[k][1]}" + (f" {used[k][2]}" if used[k][2] else "") for k, n in number.items())))
        return out


def write_markdown(doc: Document, **options) -> str:
    return MarkdownWriter(**options).write(doc)
