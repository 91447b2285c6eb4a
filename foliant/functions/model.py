"""What a document becomes between a reader and a writer, and its rows in node tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Font:
    bold: bool = False
    italic: bool = False
    strike: bool = False
    underline: bool = False
    superscript: bool = False
    subscript: bool = False
    code: bool = False


@dataclass
class Inline:
    kind: str  # run, image, field_start, field_separator, field_end, bookmark_start, bookmark_end, footnote
    text: str = ""
    font: Font = field(default_factory=Font)
    content: bytes | None = None
    mime: str = ""
    title: str = ""
    width: float = 0.0
    height: float = 0.0


@dataclass
class Paragraph:
    style: str = "Normal"
    inlines: list[Inline] = field(default_factory=list)
    outline: int | None = None  # 0-based, of headings
    list_id: int | None = None
    level: int = 0
    quote: int = 0
    alignment: int = 0
    story: str = "body"

    @property
    def text(self) -> str:
        return "".join(i.text for i in self.inlines if i.kind == "run")

    def add(self, text: str, font: Font) -> None:
        """Appends text; runs of one font grow together."""
        if not text:
            return
        if self.inlines and self.inlines[-1].kind == "run" and self.inlines[-1].font == font:
            self.inlines[-1] = replace(self.inlines[-1], text=self.inlines[-1].text + text)
        else:
            self.inlines.append(Inline("run", text, font))


@dataclass
class Cell:
    blocks: list[Paragraph | Table] = field(default_factory=list)
    alignment: int = 0

    @property
    def text(self) -> str:
        return " ".join(p.text for p in self.blocks if isinstance(p, Paragraph) and p.text)


@dataclass
class Table:
    rows: list[list[Cell]] = field(default_factory=list)
    header: bool = True


@dataclass
class ListLevel:
    number_style: int = 0  # 23: bullet
    number_format: str = "%1."
    start_at: int = 1


@dataclass
class Document:
    blocks: list[Paragraph | Table] = field(default_factory=list)
    headers: list[Paragraph] = field(default_factory=list)
    footers: list[Paragraph] = field(default_factory=list)
    lists: dict[int, list[ListLevel]] = field(default_factory=dict)
    styles: dict[str, str] = field(default_factory=dict)  # name -> base style

    @property
    def text(self) -> str:
        """Non-empty paragraphs of the body, a line each; tables, headers and footers are not in it."""
        return "\n".join(b.text for b in self.blocks if isinstance(b, Paragraph) and b.text)


#: One row for each paragraph; cells have a table's path. `path` sorts in document order.
PARAGRAPHS = "ord int, path array<int>, story string, style_name string, outline_level int, is_heading boolean, list_id int, level int, quote int, alignment int, table_ord int, row_idx int, col_idx int, text string"
INLINES = "ord int, pos int, kind string, text string, bold boolean, italic boolean, strike boolean, underline boolean, superscript boolean, subscript boolean, code boolean, title string, mime string, width double, height double, content binary"


def walk(doc: Document) -> Iterator[tuple[int, list[int], Paragraph, tuple[int, int, int] | None]]:
    """(ord, path, paragraph, cell) in document order: headers, body with tables in place, footers."""
    ordinal, tables = 0, 0

    def go(blocks: list, path: list[int], cell: tuple | None) -> Iterator[tuple]:
        nonlocal ordinal, tables
        for k, b in enumerate(blocks):
            if isinstance(b, Paragraph):
                yield ordinal, [*path, k], b, cell
                ordinal += 1
            else:
                number = tables
                tables += 1
                for r, row in enumerate(b.rows):
                    for c, x in enumerate(row):
                        yield from go(x.blocks or [Paragraph()], [*path, k, r, c], (number, r, c))

    for k, blocks in enumerate((doc.headers, doc.blocks, doc.footers)):
        yield from go(blocks, [k], None)


def paragraph_rows(doc: Document) -> list[dict]:
    out = []
    for ordinal, path, p, cell in walk(doc):
        t, r, c = cell or (None, None, None)
        out.append({"ord": ordinal, "path": path, "story": "cell" if cell else p.story, "style_name": p.style, "outline_level": p.outline, "is_heading": p.outline is not None, "list_id": p.list_id, "level": p.level if p.list_id is not None else None, "quote": p.quote, "alignment": p.alignment, "table_ord": t, "row_idx": r, "col_idx": c, "text": p.text})
    return out


def inline_rows(doc: Document) -> list[dict]:
    out = []
    for ordinal, _, p, _ in walk(doc):
        for k, i in enumerate(p.inlines):
            f = i.font
            out.append({"ord": ordinal, "pos": k, "kind": i.kind, "text": i.text, "bold": f.bold, "italic": f.italic, "strike": f.strike, "underline": f.underline, "superscript": f.superscript, "subscript": f.subscript, "code": f.code, "title": i.title, "mime": i.mime, "width": i.width, "height": i.height, "content": i.content})
    return out
