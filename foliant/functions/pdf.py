"""PDF writer: A4 pages, core fonts, Latin-1 text, wrapped lines, tables as rows, links as annotations, headings as outline."""

from __future__ import annotations

import re
import zlib

from .markdown_out import MarkdownWriter
from .model import Document, Paragraph, Table
from .text import LATIN1, letters, roman_numeral

# Page size and margin in points, line height as a multiple of the size.
WIDTH, HEIGHT, MARGIN, LEADING = 595.28, 841.89, 20 * 72 / 25.4, 1.4
FONTS = ("Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique", "Courier")
_LINK = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]\((<[^<>]*>|(?:[^\s()\\]|\\.)*)(?:\s+\"(?:[^\"\\]|\\.)*\")?\)")


_PLAIN = str.maketrans(LATIN1)


def latin1(text: str) -> str:
    if text.isascii() and text.isprintable():
        return text
    return re.sub(r"[^\x20-\xFF]", "?", text.replace("\t", "    ").translate(_PLAIN))


class _Widths(dict):
    """Rough widths of the sans font, in ems."""

    def __missing__(self, c: str) -> float:
        self[c] = 0.28 if c in "ijltfI.,:;'|!() " else 0.83 if c in "mwMW@%" else 0.67 if c.isupper() else 0.56
        return self[c]


_WIDTHS = _Widths()
#: Words whose widths are remembered at a time.
WORDS = 50_000


class _WordWidths(dict):
    """Widths of words, in ems."""

    def __missing__(self, w: str) -> float:
        if len(self) >= WORDS:
            self.clear()
        self[w] = width = sum(map(_WIDTHS.__getitem__, w))
        return width


_WORD_WIDTHS = _WordWidths()


def _string(text: str) -> bytes:
    data = latin1(text).encode("latin-1")
    return b"(" + (re.sub(rb"([\\()])", rb"\\\1", data) if re.search(rb"[\\()]", data) else data) + b")"


class PdfWriter:
    def __init__(self, compress: bool = True, outline: bool = True):
        self.compress, self.outline = compress, outline

    def write(self, doc: Document) -> bytes:
        self.pages: list[list[bytes]] = []
        self.links: list[list[tuple]] = []
        self.marks: list[tuple[int, str, int, float]] = []
        self.counts: dict[tuple[int, int], int] = {}
        self.doc = doc
        self.new_page()
        for b in doc.blocks:
            self.table(b) if isinstance(b, Table) else self.paragraph(b)
        return self.assemble()

    def new_page(self) -> None:
        self.pages.append([])
        self.links.append([])
        self.y = HEIGHT - MARGIN

    def label(self, p: Paragraph) -> str:
        """Ordered items count on; a level starts anew after an item above it."""
        levels = self.doc.lists.get(p.list_id, [])
        lv = levels[min(p.level, len(levels) - 1)] if levels else None
        for k in [k for k in self.counts if k[0] == p.list_id and k[1] > p.level]:
            del self.counts[k]
        if lv is None or lv.number_style == 23:
            return "\x95 "
        n = self.counts[p.list_id, p.level] = self.counts.get((p.list_id, p.level), lv.start_at - 1) + 1
        shown = {1: roman_numeral(n), 2: roman_numeral(n).lower(), 3: letters(n), 4: letters(n).lower()}.get(lv.number_style, str(n))
        return f"{shown}{lv.number_format[-1:] or '.'} "

    def paragraph(self, p: Paragraph, left: float = MARGIN, right: float = WIDTH - MARGIN) -> None:
        size = 11 + (6 - min(p.outline + 1, 6)) * 2 if p.outline is not None else 11
        left += 18 * p.quote + (18 * (p.level + 1) if p.list_id is not None else 0)
        code = p.style.startswith(("FencedCode", "IndentedCode"))
        words: list[tuple[str, int, str]] = []
        if p.list_id is not None and p.style != "ListContinue":
            words.append((self.label(p), 0, ""))
        if p.outline is not None and p.text:
            self.marks.append((p.outline, p.text, len(self.pages) - 1, self.y))
        for i in p.inlines:
            if i.kind != "run":
                continue
            font = 4 if code or i.font.code else (1 if i.font.bold or p.outline is not None else 0) + (2 if i.font.italic else 0)
            at = 0
            for m in [*_LINK.finditer(i.text), None]:
                words += [(w, font, "") for w in re.findall(r"\n|[^\S\n]+|\S+", i.text[at : m.start() if m else None])]
                if m:
                    words += [(w, font, m[2].strip("<>")) for w in re.findall(r"\n|[^\S\n]+|\S+", m[1])]
                    at = m.end()
        line, x = [], left
        lines = [line]
        for w, font, uri in words:
            width = size * (0.6 * len(w) if font == 4 else _WORD_WIDTHS[w] if len(w) <= 40 else sum(map(_WIDTHS.__getitem__, w)))
            if w == "\n" or (x + width > right and line and not w.isspace()):
                line, x = [], left
                lines.append(line)
                if w == "\n":
                    continue
            if line and line[-1][2] == font and line[-1][3] == uri:  # neighbours of one font and target are written at once
                line[-1][1] += w
                line[-1][4] += width
            else:
                line.append([x, w, font, uri, width])
            x += width
        step = size * LEADING
        for line in lines:
            if self.y - step < MARGIN:
                self.new_page()
            self.y -= step
            for x, w, font, uri, width in line:
                if not w.isspace():
                    self.pages[-1].append(b"BT /F%d %g Tf %.2f %.2f Td " % (font, size, x, self.y) + _string(w) + b" Tj ET")
                if uri:
                    self.links[-1].append((uri, x, self.y - 2, x + width, self.y + size))
        self.y -= 4

    def table(self, t: Table) -> None:
        rows = [[MarkdownWriter().cell(c) for c in r] for r in t.rows]
        n = max(map(len, rows), default=0)
        for k, r in enumerate(rows):
            p = Paragraph()
            from .model import Font

            p.add("  |  ".join([*r, *[""] * (n - len(r))]), Font(bold=k == 0))
            self.paragraph(p)

    def assemble(self) -> bytes:
        objects: list[bytes] = []

        def add(body: bytes) -> int:
            objects.append(body)
            return len(objects)

        catalog, tree = add(b""), add(b"")
        fonts = [add(b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % f.encode()) for f in FONTS]
        resources = b"<< /Font << " + b" ".join(b"/F%d %d 0 R" % (k, n) for k, n in enumerate(fonts)) + b" >> >>"
        numbers = []
        for ops, links in zip(self.pages, self.links, strict=True):
            data = b"\n".join(ops)
            packed = zlib.compress(data) if self.compress else data
            stream = add(b"<< /Length %d%s >>\nstream\n" % (len(packed), b" /Filter /FlateDecode" if self.compress else b"") + packed + b"\nendstream")
            notes = [add(b"<< /Type /Annot /Subtype /Link /Border [0 0 0] /Rect [%.2f %.2f %.2f %.2f] /A << /S /URI /URI " % tuple(z[1:]) + _string(z[0]) + b" >> >>") for z in links]
            numbers.append(add(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 %.2f %.2f] /Resources " % (tree, WIDTH, HEIGHT) + resources + b" /Contents %d 0 R" % stream + (b" /Annots [" + b" ".join(b"%d 0 R" % a for a in notes) + b"]" if notes else b"") + b" >>"))
        objects[tree - 1] = b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % n for n in numbers) + b"] /Count %d >>" % len(numbers)
        more = b""
        if self.outline and self.marks:
            root = len(objects) + 1
            add(b"<< /Type /Outlines /First %d 0 R /Last %d 0 R /Count %d >>" % (root + 1, root + len(self.marks), len(self.marks)))
            for k, (_, text, page, y) in enumerate(self.marks):
                near = (b" /Prev %d 0 R" % (root + k) if k else b"") + (b" /Next %d 0 R" % (root + k + 2) if k + 1 < len(self.marks) else b"")
                add(b"<< /Parent %d 0 R /Title " % root + _string(text) + near + b" /Dest [%d 0 R /XYZ 0 %.2f 0] >>" % (numbers[page], y))
            more = b" /Outlines %d 0 R" % root
        objects[catalog - 1] = b"<< /Type /Catalog /Pages %d 0 R%s >>" % (tree, more)
        out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
        for k, body in enumerate(objects):
            places.append(len(out))
            out += b"%d 0 obj\n" % (k + 1) + body + b"\nendobj\n"
        at = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
        out += b"trailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, catalog, at)
        return bytes(out)


def write_pdf(doc: Document, **options) -> bytes:
    return PdfWriter(**options).write(doc)
