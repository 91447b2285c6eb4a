"""The binary reader on a compound file built here."""

import struct

import pytest

from foliant.functions.doc import BadDocument, read_doc
from foliant.functions.markdown_out import write_markdown


def fkp(runs, width):
    """A formatted page: (first byte, one past the last, properties)."""
    page, end = bytearray(512), 511
    page[511] = len(runs)
    struct.pack_into(f"<{len(runs) + 1}I", page, 0, *[r[0] for r in runs], runs[-1][1])
    for k, (_, _, props) in enumerate(runs):
        if props:
            body = bytes([len(props)]) + props if width == 1 else bytes([(len(props) + 2) // 2]) + props + b"\0" * (1 - len(props) % 2)
            end = (end - len(body)) & ~1
            page[end : end + len(body)] = body
            page[4 * (len(runs) + 1) + width * k] = end // 2
    return bytes(page)


def compound(streams):
    """All streams above the small size, a sector of 512 bytes each unit."""
    fat, data, entries = [], b"", []
    for name, body in streams.items():
        body = body.ljust(4096, b"\0")
        n, start = -(-len(body) // 512), len(fat)
        fat += [*range(start + 1, start + n), 0xFFFFFFFE]
        data += body.ljust(n * 512, b"\0")
        entries.append((name, 2, start, len(body)))
    directory = b""
    for name, kind, start, size in [("Root Entry", 5, 0xFFFFFFFE, 0), *entries]:
        raw = (name + "\0").encode("utf-16-le")
        e = bytearray(128)
        e[: len(raw)] = raw
        struct.pack_into("<HBB", e, 64, len(raw), kind, 1)
        struct.pack_into("<II", e, 116, start, size)
        directory += bytes(e)
    at = len(fat)
    fat.append(0xFFFFFFFE)
    data += directory.ljust(512, b"\0")
    where = len(fat)
    fat.append(0xFFFFFFFD)
    data += struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat)))
    head = bytearray(512)
    head[:8] = bytes.fromhex("D0CF11E0A1B11AE1")
    struct.pack_into("<HHHHH", head, 0x18, 0x3E, 3, 0xFFFE, 9, 6)
    struct.pack_into("<I", head, 0x2C, 1)
    struct.pack_into("<I", head, 0x30, at)
    struct.pack_into("<IIIII", head, 0x38, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    struct.pack_into("<109I", head, 0x4C, where, *[0xFFFFFFFF] * 108)
    return bytes(head) + data


def build():
    one, two = b"Title\rPlain bold \x13 HYPERLINK \"http://a.b\" \x14go\x15.\r", "é中\ra\x07b\x07\x07end\r"
    text_at, wide_at = 1024, 1536
    wide = two.encode("utf-16-le")
    main = bytearray(4096)
    struct.pack_into("<H", main, 0, 0xA5EC)
    main[0x0B] = 2
    main[text_at : text_at + len(one)] = one
    main[wide_at : wide_at + len(wide)] = wide
    struct.pack_into("<I", main, 0x4C, len(one) + len(two))
    p = lambda style, mods=b"": struct.pack("<H", style) + mods
    cell, stop = struct.pack("<HB", 0x2416, 1), struct.pack("<HBHB", 0x2416, 1, 0x2417, 1)
    paras = [(text_at, text_at + 6, p(1)), (text_at + 6, text_at + len(one), p(0)), (wide_at, wide_at + 6, p(0, struct.pack("<HH", 0x460B, 4))), (wide_at + 6, wide_at + 10, p(0, cell)), (wide_at + 10, wide_at + 14, p(0, cell)), (wide_at + 14, wide_at + 16, p(0, stop)), (wide_at + 16, wide_at + len(wide), p(0))]
    chars = [(text_at, text_at + 12, b""), (text_at + 12, text_at + 16, struct.pack("<HB", 0x0835, 1)), (text_at + 16, wide_at + len(wide), b"")]
    main[2048:2560], main[2560:3072] = fkp(paras, 13), fkp(chars, 1)
    clx = b"\x02" + struct.pack("<I", 4 * 3 + 8 * 2) + struct.pack("<III", 0, len(one), len(one) + len(two)) + struct.pack("<HIH", 0, text_at * 2 | 0x40000000, 0) + struct.pack("<HIH", 0, wide_at, 0)

    def std(name, base):
        body = struct.pack("<HHHHH", 0, base << 4 | 1, 0, 0, 0) + struct.pack("<H", len(name)) + (name + "\0").encode("utf-16-le")
        return struct.pack("<H", len(body)) + body

    stsh = struct.pack("<HHH", 4, 2, 10) + std("Normal", 0xFFF) + std("heading 1", 0)
    plc = lambda page: struct.pack("<III", text_at, wide_at + len(wide), page)
    table = b""
    for place, body in ((0x01A2, clx), (0x00A2, stsh), (0x0102, plc(4)), (0x00FA, plc(5))):
        struct.pack_into("<II", main, place, len(table), len(body))
        table += body
    return compound({"WordDocument": bytes(main), "1Table": table})


def test_doc():
    d = read_doc(build())
    assert write_markdown(d) == "# Title\nPlain **bold** [go](http://a.b).\n\n- é中\n\n| a   | b   |\n| --- | --- |\n\nend\n"
    assert d.text == "Title\nPlain bold [go](http://a.b).\né中\nend"


@pytest.mark.parametrize("data", [b"", b"{\\rtf1 x}", bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 600])
def test_not_a_doc(data):
    with pytest.raises((BadDocument, struct.error)):
        read_doc(data)
