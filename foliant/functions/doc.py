"""Reader of binary Word documents (97 to 2003): compound file, piece table, paragraph and character properties."""

from __future__ import annotations

import re
import struct
from bisect import bisect_right

from .markdown import link_text
from .model import Cell, Document, Font, ListLevel, Paragraph, Table

# Fixed values of the compound file format.
MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF
# Places of tables in the file information block (offset, then length).
CLX, STSH, CHPX, PAPX = 0x01A2, 0x00A2, 0x00FA, 0x0102
# Property modifiers.
IN_TABLE, ROW_END, LIST_LEVEL, LIST_ID, OUTLINE, ALIGN, ALIGN_OLD = 0x2416, 0x2417, 0x260A, 0x460B, 0x2640, 0x2461, 0x2403
BOLD, ITALIC, STRIKE, UNDERLINE, VERTICAL = 0x0835, 0x0836, 0x0837, 0x2A3E, 0x2A48


class BadDocument(ValueError):
    """The bytes are no binary Word document."""


class CompoundFile:
    def __init__(self, data: bytes):
        self.data = data
        if data[:8] != MAGIC:
            raise BadDocument("not a compound file")
        if len(data) < 1024 or self._u16(0x1E) not in (9, 12) or self._u16(0x20) != 6:
            raise BadDocument("the header is out of range")
        self.size, self.small = 1 << self._u16(0x1E), 1 << self._u16(0x20)
        self.cutoff = self._u32(0x38)
        places = [s for s in struct.unpack_from("<109I", data, 0x4C) if s < END]
        more, seen = self._u32(0x44), set()
        while more < END and more not in seen:
            seen.add(more)
            entries = struct.unpack_from(f"<{self.size // 4}I", data, (more + 1) * self.size)
            places += [s for s in entries[:-1] if s < END]
            more = entries[-1]
        self.next = [x for s in places for x in struct.unpack_from(f"<{self.size // 4}I", data.ljust((s + 2) * self.size, b"\xff"), (s + 1) * self.size)]
        names = self._chain(self._u32(0x30))
        mini = self._chain(self._u32(0x3C))
        self.mini = list(struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4]))
        self.entries = {}
        root = b""
        for k in range(0, len(names) - 127, 128):
            n = struct.unpack_from("<H", names, k + 64)[0]
            name = names[k : k + max(0, n - 2)].decode("utf-16-le", "replace")
            kind, start, length = names[k + 66], *struct.unpack_from("<II", names, k + 116)
            if kind == 5:
                root = self._chain(start)[:length]
            elif kind == 2:
                self.entries[name] = (start, length)
        self.root = root

    def _u16(self, at: int) -> int:
        return struct.unpack_from("<H", self.data, at)[0]

    def _u32(self, at: int) -> int:
        return struct.unpack_from("<I", self.data, at)[0]

    def _chain(self, s: int) -> bytes:
        out, seen = [], set()
        while s < END and s not in seen and s < len(self.next):
            seen.add(s)
            out.append(self.data[(s + 1) * self.size : (s + 2) * self.size])
            s = self.next[s]
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            raise BadDocument(f"no stream {name}")
        s, length = self.entries[name]
        if length >= self.cutoff:
            return self._chain(s)[:length]
        out, seen = [], set()
        while s < END and s not in seen and s < len(self.mini):
            seen.add(s)
            out.append(self.root[s * self.small : (s + 1) * self.small])
            s = self.mini[s]
        return b"".join(out)[:length]


def modifiers(b: bytes) -> dict[int, int]:
    """Property modifiers with operands of up to four bytes; longer ones are passed over."""
    out, at = {}, 0
    while at + 2 <= len(b):
        code = struct.unpack_from("<H", b, at)[0]
        at += 2
        kind = code >> 13
        if kind == 6:
            if code == 0xD608 and at + 2 <= len(b):
                n = struct.unpack_from("<H", b, at)[0] + 1
            else:
                n = b[at] + 1 if at < len(b) else 1
            at += n
            continue
        n = (1, 1, 2, 4, 2, 2, 0, 3)[kind]
        out[code] = int.from_bytes(b[at : at + n], "little")
        at += n
    return out


class DocReader:
    def __init__(self, data: bytes):
        f = CompoundFile(data)
        self.main = f.stream("WordDocument")
        if len(self.main) < 0x1AA or struct.unpack_from("<H", self.main)[0] != 0xA5EC:
            raise BadDocument("no file information block")
        self.table = f.stream("1Table" if self.main[0x0B] & 2 else "0Table")
        self.pieces = self._pieces()
        self.names, self.bases = self._styles()
        self.paras, self.chars = self._runs(PAPX, 13), self._runs(CHPX, 1)

    def at(self, place: int) -> bytes:
        start, n = struct.unpack_from("<II", self.main, place)
        return self.table[start : start + n]

    def _pieces(self) -> list[tuple[int, int, int, int]]:
        """(first character, one past the last, byte place, bytes a character)."""
        clx, at = self.at(CLX), 0
        while at < len(clx) and clx[at] == 1:
            at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
        if at >= len(clx) or clx[at] != 2:
            raise BadDocument("no piece table")
        n = (struct.unpack_from("<I", clx, at + 1)[0] - 4) // 12
        cps = struct.unpack_from(f"<{n + 1}I", clx, at + 5)
        out = []
        for k in range(n):
            fc = struct.unpack_from("<I", clx, at + 5 + 4 * (n + 1) + 8 * k + 2)[0]
            packed = bool(fc & 0x40000000)
            place = (fc & 0x3FFFFFFF) // 2 if packed else fc & 0x3FFFFFFF
            out.append((cps[k], cps[k + 1], place, 1 if packed else 2))
        return out

    def _styles(self) -> tuple[list[str], list[int]]:
        b = self.at(STSH)
        names, bases = [], []
        if len(b) < 6:
            return names, bases
        head = struct.unpack_from("<H", b)[0]
        base = struct.unpack_from("<H", b, 4)[0]
        at = 2 + head
        while at + 2 <= len(b):
            n = struct.unpack_from("<H", b, at)[0]
            std = b[at + 2 : at + 2 + n]
            name, parent = "", 0xFFF
            if n > base + 2:
                parent = struct.unpack_from("<H", std, 2)[0] >> 4
                size = struct.unpack_from("<H", std, base)[0]
                name = std[base + 2 : base + 2 + 2 * size].decode("utf-16-le", "replace")
            names.append(re.sub(r"^heading (\d)$", r"Heading \1", name))
            bases.append(parent)
            at += 2 + n
        return names, bases

    def _runs(self, place: int, width: int) -> tuple[list[int], list[tuple[int, int, bytes]]]:
        """Starts, and (start, end, properties) of the byte runs in the formatted pages that a table names."""
        b = self.at(place)
        n = max(0, (len(b) - 4) // 8)
        out = []
        for k in range(n):
            page = (struct.unpack_from("<I", b, 4 * (n + 1) + 4 * k)[0] & 0x3FFFFF) * 512
            fkp = self.main[page : page + 512]
            if len(fkp) < 512:
                continue
            count = fkp[511]
            fcs = struct.unpack_from(f"<{count + 1}I", fkp)
            for i in range(count):
                o = fkp[4 * (count + 1) + width * i] * 2
                props = b""
                if o:
                    size = fkp[o]
                    if width == 1:
                        props = fkp[o + 1 : o + 1 + size]
                    elif size:
                        props = fkp[o + 1 : o + 2 * size]
                    else:
                        props = fkp[o + 2 : o + 2 + 2 * fkp[o + 1]]
                out.append((fcs[i], fcs[i + 1], props))
        out.sort(key=lambda r: r[0])
        return [r[0] for r in out], out

    @staticmethod
    def _find(runs: tuple, fc: int) -> bytes:
        k = bisect_right(runs[0], fc) - 1
        return runs[1][k][2] if k >= 0 and runs[1][k][1] > fc else b""

    def characters(self) -> list[tuple[str, int]]:
        """(character, byte place) of the main text."""
        limit = struct.unpack_from("<I", self.main, 0x4C)[0]
        out = []
        for a, b, place, width in self.pieces:
            b = min(b, limit)
            if a >= b:
                continue
            raw = self.main[place : place + (b - a) * width]
            text = raw.decode("cp1252" if width == 1 else "utf-16-le", "replace") if width == 1 else "".join(chr(x) for x in struct.unpack(f"<{len(raw) // 2}H", raw[: len(raw) // 2 * 2]))
            out += [(c, place + k * width) for k, c in enumerate(text)]
        return out

    def chain(self, style: int) -> list[int]:
        seen: list[int] = []
        while style < len(self.names) and style not in seen:
            seen.append(style)
            style = self.bases[style]
        return seen

    def read(self) -> Document:
        doc = Document()
        for k, name in enumerate(self.names):
            if name:
                doc.styles.setdefault(name, self.names[self.bases[k]] if self.bases[k] < len(self.names) else "")
        rows: list[list[Cell]] = []
        cell, row = Cell(), []
        piece: list[tuple[str, int]] = []

        def end_table() -> None:
            nonlocal rows, row, cell
            if row or cell.blocks:
                rows.append([*row, *([cell] if cell.blocks else [])])
            if rows:
                doc.blocks.append(Table(rows))
            rows, row, cell = [], [], Cell()

        for c, fc in [*self.characters(), ("\r", -1)]:
            if c not in "\r\x07":
                piece.append((c, fc))
                continue
            if fc == -1 and not piece:
                break
            props = self._find(self.paras, fc if fc >= 0 else piece[-1][1])
            p, mods = self.paragraph(piece, props)
            piece = []
            if mods.get(IN_TABLE) or c == "\x07":
                if c == "\x07" and (mods.get(ROW_END) or (not p.text and not mods and row)):
                    rows.append(row)
                    row, cell = [], Cell()
                else:
                    cell.blocks.append(p)
                    if c == "\x07":
                        row.append(cell)
                        cell = Cell()
            else:
                end_table()
                doc.blocks.append(p)
                if p.list_id is not None:
                    doc.lists.setdefault(p.list_id, [ListLevel(23, "-", 1)] * 9)
        end_table()
        return doc

    def paragraph(self, piece: list[tuple[str, int]], props: bytes) -> tuple[Paragraph, dict[int, int]]:
        style = struct.unpack_from("<H", props)[0] if len(props) >= 2 else 0
        mods = modifiers(props[2:])
        name = self.names[style] if style < len(self.names) and self.names[style] else "Normal"
        p = Paragraph(name, alignment=min(3, mods.get(ALIGN, mods.get(ALIGN_OLD, 0))))
        level = next((int(m[1]) - 1 for k in self.chain(style) if (m := re.fullmatch(r"Heading ([1-9])", self.names[k]))), None)
        p.outline = mods[OUTLINE] if mods.get(OUTLINE, 9) < 9 else level
        if mods.get(LIST_ID):
            p.list_id, p.level = mods[LIST_ID], min(8, mods.get(LIST_LEVEL, 0))
        # fields: what stands between start and separator is code; HYPERLINK makes its result a link
        stack: list[list] = []
        for c, fc in piece:
            if c == "\x13":
                stack.append(["", [], True])
            elif c == "\x14" and stack:
                stack[-1][2] = False
            elif c == "\x15" and stack:
                code, result, _ = stack.pop()
                m = re.match(r"\s*HYPERLINK\s+(?:\\l\s+)?\"([^\"]*)\"(?:\s+\\l\s+\"([^\"]*)\")?", code)
                text = "".join(t for t, _ in result)
                if m:
                    target = ("#" if re.match(r"\s*HYPERLINK\s+\\l", code) else "") + m[1] + (f"#{m[2]}" if m[2] else "")
                    result = [(link_text(text, target), result[0][1] if result else Font())]
                if stack:
                    (stack[-1][1].extend(result) if not stack[-1][2] else None)
                else:
                    for t, f in result:
                        p.add(t, f)
            elif stack and stack[-1][2]:
                stack[-1][0] += c
            else:
                t = {"\x0b": "\n", "\x0c": "\f", "\t": "\t", "\x1e": "‑", "\x1f": "­"}.get(c, c if c >= " " else "")
                if t:
                    (stack[-1][1].append((t, self.font(fc))) if stack else p.add(t, self.font(fc)))
        return p, mods

    def font(self, fc: int) -> Font:
        mods = modifiers(self._find(self.chars, fc))
        on = lambda code: mods.get(code, 0) in (1, 0x81)
        v = mods.get(VERTICAL, 0)
        return Font(on(BOLD), on(ITALIC), on(STRIKE), bool(mods.get(UNDERLINE, 0)), v == 1, v == 2)


def read_doc(data: bytes) -> Document:
    """A DOC file, or an RTF-named file that holds one; RTF text itself has no reader."""
    if data[:5] == b"{\\rtf":
        raise BadDocument("RTF text is not supported")
    return DocReader(data).read()
