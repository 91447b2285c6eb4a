"""DOCX reader and writer over zip and XML."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree as E
from xml.sax.saxutils import escape

from .markdown import link_text
from .model import Cell, Document, Font, Inline, ListLevel, Paragraph, Table

# Namespaces of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
# Number styles by their names in the format, and alignments.
NUMBER_STYLES = {"decimal": 0, "upperRoman": 1, "lowerRoman": 2, "upperLetter": 3, "lowerLetter": 4, "bullet": 23, "none": 255}
ALIGNMENTS = {"left": 0, "start": 0, "center": 1, "right": 2, "end": 2, "both": 3}
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "emf": "image/x-emf", "wmf": "image/x-wmf", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp"}
MOST_PART = 512 << 20  # an unpacked part beyond this is refused


def _val(e, name: str, default: str | None = None) -> str | None:
    x = e.find(W + name) if e is not None else None
    return default if x is None else x.get(W + "val", "true")


def _on(e, name: str) -> bool:
    v = _val(e, name)
    return v is not None and v not in ("0", "false", "off", "none")


class DocxReader:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        self.styles, self.style_lists, self.base, self.outlines, self.fonts = {}, {}, {}, {}, {}
        self.doc = Document()
        self._read_styles()
        self._read_numbering()

    def part(self, name: str):
        if name not in self.names:
            return None
        if self.zip.getinfo(name).file_size > MOST_PART:
            raise ValueError(f"{name} is too large")
        return E.fromstring(self.zip.read(name))

    def rels(self, part: str) -> dict[str, str]:
        folder, _, name = part.rpartition("/")
        root = self.part(f"{folder}/_rels/{name}.rels")
        return {} if root is None else {x.get("Id"): x.get("Target", "") for x in root}

    def _read_styles(self) -> None:
        root = self.part("word/styles.xml")
        for s in root.iter(W + "style") if root is not None else ():
            key, name = s.get(W + "styleId", ""), _val(s, "name", "") or ""
            name = re.sub(r"^heading (\d)$", r"Heading \1", name) if name.islower() else name
            self.styles[key] = name[:1].upper() + name[1:] if name else key
            self.base[key] = _val(s, "basedOn")
            p = s.find(W + "pPr")
            if p is not None:
                if (o := _val(p, "outlineLvl")) is not None and o.isdigit() and int(o) < 9:
                    self.outlines[key] = int(o)
                n = p.find(W + "numPr")
                if n is not None and (i := _val(n, "numId")):
                    self.style_lists[key] = (int(i), int(_val(n, "ilvl", "0")))
            self.fonts[key] = s.find(W + "rPr")
        for key, name in self.styles.items():
            self.doc.styles.setdefault(name, self.styles.get(self.base.get(key) or "", ""))

    def chain(self, key: str | None):
        seen: list[str] = []
        while key and key not in seen:
            seen.append(key)
            key = self.base.get(key)
        return seen

    def _read_numbering(self) -> None:
        root = self.part("word/numbering.xml")
        if root is None:
            return
        level = lambda x: ListLevel(NUMBER_STYLES.get(_val(x, "numFmt", "decimal"), 0), _val(x, "lvlText", "") or "", int(_val(x, "start", "1") or 1))
        abstract = {a.get(W + "abstractNumId"): {int(x.get(W + "ilvl", 0)): level(x) for x in a.iter(W + "lvl")} for a in root.iter(W + "abstractNum")}
        for n in root.iter(W + "num"):
            levels = dict(abstract.get(_val(n, "abstractNumId"), {}))
            for o in n.iter(W + "lvlOverride"):
                k = int(o.get(W + "ilvl", 0))
                if (x := o.find(W + "lvl")) is not None:
                    levels[k] = level(x)
                elif (s := _val(o, "startOverride")) and k in levels:
                    levels[k] = ListLevel(levels[k].number_style, levels[k].number_format, int(s))
            self.doc.lists[int(n.get(W + "numId", 0))] = [levels.get(k, ListLevel()) for k in range(max(levels, default=-1) + 1)]

    def read(self) -> Document:
        root = self.part("word/document.xml")
        if root is None:
            raise ValueError("no word/document.xml")
        body = root.find(W + "body")
        self.use("word/document.xml")
        relations = self.rel
        self.doc.blocks = self.blocks(body if body is not None else root)
        seen = set()
        for kind, into in (("headerReference", self.doc.headers), ("footerReference", self.doc.footers)):
            for ref in root.iter(W + kind):
                target = "word/" + relations.get(ref.get(R + "id"), "").lstrip("/").removeprefix("word/")
                part = self.part(target) if target not in seen else None
                if part is not None:
                    seen.add(target)
                    self.use(target)
                    for b in self.blocks(part):
                        if isinstance(b, Paragraph):
                            b.story = kind.removesuffix("Reference")
                            into.append(b)
        return self.doc

    def use(self, part: str) -> None:
        self.rel = self.rels(part)

    @staticmethod
    def unwrapped(e):
        """Children, with content controls opened, and of alternatives the first choice."""
        for x in e:
            if x.tag == W + "sdt":
                c = x.find(W + "sdtContent")
                if c is not None and x.find(f"{W}sdtPr/{W}showingPlcHdr") is None:
                    yield from DocxReader.unwrapped(c)
            elif x.tag == MC + "AlternateContent":
                c = x.find(MC + "Choice")
                if c is not None:
                    yield from DocxReader.unwrapped(c)
            elif x.tag in (W + "ins", W + "smartTag", W + "customXml"):
                yield from DocxReader.unwrapped(x)
            else:
                yield x

    def blocks(self, e) -> list:
        out: list = []
        for x in self.unwrapped(e):
            if x.tag == W + "p":
                out.append(self.paragraph(x))
            elif x.tag == W + "tbl":
                out.append(Table([[Cell(self.blocks(c)) for c in self.unwrapped(r) if c.tag == W + "tc"] for r in self.unwrapped(x) if r.tag == W + "tr"]))
        for b in out:
            if isinstance(b, Table):
                for row in b.rows:
                    for c in row:
                        c.alignment = next((p.alignment for p in c.blocks if isinstance(p, Paragraph)), 0)
        return out

    def paragraph(self, e) -> Paragraph:
        pr = e.find(W + "pPr")
        key = _val(pr, "pStyle")
        chain = self.chain(key)
        p = Paragraph(self.styles.get(key or "", key or "Normal") or "Normal")
        own = _val(pr, "outlineLvl")
        p.outline = int(own) if own and own.isdigit() and int(own) < 9 else next((self.outlines[k] for k in chain if k in self.outlines), None)
        if p.outline is None and (m := re.fullmatch(r"Heading ([1-9])", p.style)):
            p.outline = int(m[1]) - 1
        p.alignment = ALIGNMENTS.get(_val(pr, "jc", "left") or "left", 0)
        if m := re.fullmatch(r"Quote(\d*)", p.style):
            p.quote = int(m[1] or 0) + 1
        n = pr.find(W + "numPr") if pr is not None else None
        found = (int(_val(n, "numId", "0") or 0), int(_val(n, "ilvl", "0") or 0)) if n is not None else next((self.style_lists[k] for k in chain if k in self.style_lists), None)
        if found and found[0]:
            p.list_id, p.level = found[0], min(found[1], 8)
        self.inlines(e, p, key)
        return p

    def inlines(self, e, p: Paragraph, style: str | None) -> None:
        for x in self.unwrapped(e):
            if x.tag == W + "r":
                self.run(x, p, style)
            elif x.tag == W + "hyperlink":
                inner = Paragraph()
                self.inlines(x, inner, style)
                target = self.rel.get(x.get(R + "id") or "", "") + (f"#{x.get(W + 'anchor')}" if x.get(W + "anchor") else "")
                font = inner.inlines[0].font if inner.inlines else Font()
                p.add(link_text(inner.text, target, x.get(W + "tooltip") or "") if target else inner.text, font)
            elif x.tag in (W + "bookmarkStart", W + "bookmarkEnd"):
                p.inlines.append(Inline("bookmark_start" if x.tag.endswith("Start") else "bookmark_end", title=x.get(W + "name") or x.get(W + "id") or ""))
            elif x.tag == W + "fldSimple":
                self.inlines(x, p, style)

    def run(self, e, p: Paragraph, style: str | None) -> None:
        pr = e.find(W + "rPr")
        keys = self.chain(_val(pr, "rStyle"))
        layers = [pr, *(self.fonts.get(k) for k in keys)]

        def flag(name: str) -> bool:
            for layer in layers:
                if layer is not None and layer.find(W + name) is not None:
                    return _on(layer, name)
            return False

        vert = next((v for x in layers if x is not None and (v := _val(x, "vertAlign"))), "")
        font = Font(flag("b"), flag("i"), flag("strike"), flag("u"), vert == "superscript", vert == "subscript", any("code" in self.styles.get(k, "").lower() for k in keys))
        for x in self.unwrapped(e):
            if x.tag in (W + "t", W + "instrText"):
                p.add(x.text or "", font)
            elif x.tag == W + "tab":
                p.add("\t", font)
            elif x.tag in (W + "br", W + "cr"):
                p.add("\f" if x.get(W + "type") == "page" else "\n", font)
            elif x.tag == W + "noBreakHyphen":
                p.add("‑", font)
            elif x.tag == W + "fldChar":
                kind = {"begin": "field_start", "separate": "field_separator", "end": "field_end"}.get(x.get(W + "fldCharType"))
                if kind:
                    p.inlines.append(Inline(kind))
            elif x.tag == W + "drawing":
                self.drawing(x, p)

    def drawing(self, e, p: Paragraph) -> None:
        size, name = next(e.iter(WP + "extent"), None), next(e.iter(WP + "docPr"), None)
        for blip in e.iter(A + "blip"):
            target = "word/" + self.rel.get(blip.get(R + "embed") or "", "").lstrip("/").removeprefix("word/")
            if target in self.names:
                mime = MIME.get(target.rpartition(".")[2].lower(), "")
                emu = [int(size.get(k, 0)) / 12700 if size is not None else 0.0 for k in ("cx", "cy")]
                p.inlines.append(Inline("image", (name.get("descr") or "") if name is not None else "", Font(), self.zip.read(target), mime, "", *emu))


def read_docx(data: bytes) -> Document:
    return DocxReader(data).read()


# ---- writer --------------------------------------------------------------------------------------------------

_X = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_NS = f'xmlns:w="{W[1:-1]}" xmlns:r="{R[1:-1]}" xmlns:a="{A[1:-1]}" xmlns:wp="{WP[1:-1]}" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'
_LINK = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]\((<[^<>]*>|(?:[^\s()\\]|\\.)*)(?:\s+\"((?:[^\"\\]|\\.)*)\")?\)")
# Deflate levels of the compression settings.
LEVELS = {"normal": 6, "maximum": 9, "fast": 3, "super_fast": 1}


def _clean(text: str) -> str:
    return escape(re.sub(r"[\x00-\x08\x0B\x0E-\x1F]", "", text), {'"': "&quot;"})


class DocxWriter:
    def __init__(self, compression: str = "normal"):
        self.level = LEVELS[compression]

    def write(self, doc: Document) -> bytes:
        self.doc, self.links, self.images, self.ids, self.style_ids = doc, {}, {}, {}, {}
        for n, k in enumerate(sorted({b.list_id for b in doc.blocks if isinstance(b, Paragraph) and b.list_id is not None})):
            self.ids[k] = n + 1
        self.marks, self.open = 0, {}
        body = "".join(map(self.block, doc.blocks))
        for k in list(self.open):  # bookmarks left open end with the document
            body += f'<w:p><w:bookmarkEnd w:id="{self.open.pop(k)}"/></w:p>'
        types = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Default Extension="{x}" ContentType="{MIME[x]}"/>' for x in ("png", "jpeg", "gif", "bmp", "tiff", "webp", "emf", "wmf")) + "".join(f'<Override PartName="/word/{p}.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{t}+xml"/>' for p, t in (("document", "document.main"), ("styles", "styles"), ("numbering", "numbering"))) + "</Types>"
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        rel = lambda i, kind, to, more="": f'<Relationship Id="{i}" Type="{office}/{kind}" Target="{_clean(to)}"{more}/>'
        head = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        parts = {
            "[Content_Types].xml": _X + types,
            "_rels/.rels": _X + head + rel("rId1", "officeDocument", "word/document.xml") + "</Relationships>",
            "word/document.xml": f'{_X}<w:document {_NS}><w:body>{body}<w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:body></w:document>',
            "word/styles.xml": _X + self.styles(),
            "word/numbering.xml": _X + self.numbering(),
            "word/_rels/document.xml.rels": _X + head + rel("rId1", "styles", "styles.xml") + rel("rId2", "numbering", "numbering.xml") + "".join(rel(i, "hyperlink", to, ' TargetMode="External"') for to, i in self.links.items()) + "".join(rel(i, "image", name) for i, name, _ in self.images.values()) + "</Relationships>",
        }
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, allowZip64=False, compresslevel=self.level) as z:
            for name, text in [*parts.items(), *((f"word/{name}", data) for _, name, data in self.images.values())]:
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED, self.level)
        return out.getvalue()

    def style_id(self, name: str) -> str:
        """The name without white space; where that is taken, with 0 behind it, and then _2, _3 and so on. Only Normal has that id."""
        if name not in self.style_ids:
            base = "Normal" if name in ("", "Normal") else re.sub(r"\s+", "", name) or "Style"
            taken, n = {*self.style_ids.values(), "Normal"} - ({"Normal"} if name in ("", "Normal") else set()), 1
            found = base
            while found in taken:
                found = f"{base}0" if n == 1 else f"{base}_{n}"
                n += 1
            self.style_ids[name] = found
        return self.style_ids[name]

    def styles(self) -> str:
        used = {"Normal": None} | {p.style: p.outline for p in self._paragraphs()}
        one = lambda n, o: f'<w:style w:type="paragraph" w:styleId="{_clean(self.style_id(n))}"><w:name w:val="{_clean(n)}"/>' + ("" if n == "Normal" else '<w:basedOn w:val="Normal"/>') + (f'<w:pPr><w:outlineLvl w:val="{o}"/></w:pPr>' if o is not None else "") + "</w:style>"
        return f'<w:styles {_NS}>{"".join(one(n, o) for n, o in used.items())}<w:style w:type="character" w:styleId="InlineCode"><w:name w:val="InlineCode"/></w:style></w:styles>'

    def _paragraphs(self):
        from .model import walk

        return [p for _, _, p, _ in walk(self.doc)]

    def numbering(self) -> str:
        names = {v: k for k, v in NUMBER_STYLES.items()}
        out = []
        for k, n in self.ids.items():
            levels = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="{x.start_at}"/><w:numFmt w:val="{names.get(x.number_style, "decimal")}"/><w:lvlText w:val="{_clean(x.number_format)}"/></w:lvl>' for i, x in enumerate(self.doc.lists.get(k, [])))
            out.append(f'<w:abstractNum w:abstractNumId="{n}">{levels}</w:abstractNum>')
        out += [f'<w:num w:numId="{n}"><w:abstractNumId w:val="{n}"/></w:num>' for n in self.ids.values()]
        return f"<w:numbering {_NS}>{''.join(out)}</w:numbering>"

    def block(self, b) -> str:
        if isinstance(b, Table):
            n = len(b.rows[0]) if b.rows else 0
            grid = '<w:gridCol w:w="2400"/>' * n
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{''.join(map(self.block, c.blocks)) or '<w:p/>'}</w:tc>" for c in r) + "</w:tr>" for r in b.rows)
            return f"<w:tbl><w:tblPr/><w:tblGrid>{grid}</w:tblGrid>{rows}</w:tbl>"
        pr = "" if b.style == "Normal" else f'<w:pStyle w:val="{_clean(self.style_id(b.style))}"/>'
        if b.list_id in self.ids:
            pr += f'<w:numPr><w:ilvl w:val="{b.level}"/><w:numId w:val="{self.ids[b.list_id]}"/></w:numPr>'
        if b.alignment:
            pr += f'<w:jc w:val="{("left", "center", "right", "both")[b.alignment]}"/>'
        return f"<w:p>{f'<w:pPr>{pr}</w:pPr>' if pr else ''}{''.join(map(self.inline, b.inlines))}</w:p>"

    def inline(self, i: Inline) -> str:
        if i.kind == "image":
            return self.image(i)
        if i.kind.startswith("field_"):
            return f'<w:r><w:fldChar w:fldCharType="{ {"field_start": "begin", "field_separator": "separate", "field_end": "end"}[i.kind] }"/></w:r>'
        if i.kind == "bookmark_start":
            self.open[i.title] = self.marks
            self.marks += 1
            return f'<w:bookmarkStart w:id="{self.open[i.title]}" w:name="{_clean(i.title)}"/>'
        if i.kind == "bookmark_end":
            k = i.title if i.title in self.open else next(iter(self.open), None)
            return f'<w:bookmarkEnd w:id="{self.open.pop(k)}"/>' if k is not None else ""
        f, out, at = i.font, [], 0
        for m in _LINK.finditer(i.text):
            uri = re.sub(r"\\(.)", r"\1", m[2].strip("<>"))
            if not re.match(r"(?:https?|mailto|ftp|file):|#", uri, re.I):
                continue
            out.append(self.text(i.text[at : m.start()], f))
            label = self.text(re.sub(r"\\([\[\]])", r"\1", m[1]), f)
            tip = f' w:tooltip="{_clean(m[3])}"' if m[3] else ""
            where = f'w:anchor="{_clean(uri[1:])}"' if uri.startswith("#") else f'r:id="{self.links.setdefault(uri, f"rIdL{len(self.links) + 1}")}"'
            out.append(f"<w:hyperlink {where}{tip}>{label}</w:hyperlink>")
            at = m.end()
        return "".join(out) + self.text(i.text[at:], f)

    @staticmethod
    def text(text: str, f: Font) -> str:
        if not text:
            return ""
        pr = ('<w:rStyle w:val="InlineCode"/>' if f.code else "") + "".join(f"<w:{t}/>" for t, on in (("b", f.bold), ("i", f.italic), ("strike", f.strike)) if on) + ('<w:u w:val="single"/>' if f.underline else "")
        pr += f'<w:vertAlign w:val="{"superscript" if f.superscript else "subscript"}"/>' if f.superscript or f.subscript else ""
        body = "".join({"\n": "<w:br/>", "\t": "<w:tab/>", "\f": '<w:br w:type="page"/>'}.get(x) or f'<w:t xml:space="preserve">{_clean(x)}</w:t>' for x in re.split(r"([\n\t\f])", text) if x)
        return f"<w:r>{f'<w:rPr>{pr}</w:rPr>' if pr else ''}{body}</w:r>"

    def image(self, i: Inline) -> str:
        data = i.content or b""
        key = (zlib.crc32(data), len(data), data)
        if key not in self.images:
            n = len(self.images) + 1
            extension = {v: k for k, v in MIME.items()}.get(i.mime, "png").replace("jpg", "jpeg").replace("tif", "tiff").replace("tifff", "tiff")
            self.images[key] = (f"rIdI{n}", f"media/image{n}.{extension}", data)
        cx, cy = (int((v or 72) * 12700) for v in (i.width, i.height))
        blip = f'<a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic><pic:nvPicPr><pic:cNvPr id="0" name=""/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="{self.images[key][0]}"/></pic:blipFill><pic:spPr/></pic:pic></a:graphicData></a:graphic>'
        return f'<w:r><w:drawing><wp:inline><wp:extent cx="{cx}" cy="{cy}"/><wp:docPr id="{len(self.images)}" name="image" descr="{_clean(i.text)}"/>{blip}</wp:inline></w:drawing></w:r>'


def write_docx(doc: Document, **options) -> bytes:
    return DocxWriter(**options).write(doc)
