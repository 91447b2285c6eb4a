"""Formats of documents: names, suffixes, leading bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Load and save format numbers, names and suffixes.
LOAD_FORMATS = {"auto": 0, "doc": 10, "docx": 20, "rtf": 30, "text": 62, "txt": 62, "markdown": 63, "md": 63}
SAVE_FORMATS = {"doc": 10, "docx": 20, "pdf": 40, "text": 70, "txt": 70, "markdown": 73, "md": 73}
SUFFIXES = {10: ".doc", 20: ".docx", 30: ".rtf", 62: ".txt", 63: ".md"}
# MIME types of images by image type.
IMAGE_TYPES = {"image/x-emf": 2, "image/x-wmf": 3, "image/x-pict": 4, "image/jpeg": 5, "image/png": 6, "image/bmp": 7, "image/webp": 9, "image/gif": 10, "image/svg+xml": 11, "image/tiff": 12}


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def sniffed(content: Column) -> Column:
    """Suffix by a content's first bytes; text where none is known."""
    h = F.hex(F.substring(content, 1, 8))
    return F.when(h.startswith("504B0304"), ".docx").when(h == "D0CF11E0A1B11AE1", ".doc").when(h.startswith("7B5C727466"), ".rtf").otherwise(".txt")


def suffix_of(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[^./\\]+)$", 1)


def load_format(value: Column) -> Column:
    """Number of a format given by number or by name in any case; null, meaning auto, if unknown."""
    number = value.try_cast("int")
    known = F.array(*[F.lit(v) for v in sorted(set(LOAD_FORMATS.values()))])
    return F.when(F.array_contains(known, number), number).otherwise(F.get(F.array(_lookup(LOAD_FORMATS)), F.lit(0))[F.lower(F.trim(value))])


def save_format(value: Column) -> Column:
    number = value.try_cast("int")
    known = F.array(*[F.lit(v) for v in sorted(set(SAVE_FORMATS.values()))])
    return F.when(F.array_contains(known, number), number).otherwise(_lookup(SAVE_FORMATS)[F.lower(F.trim(value))])


def reader_of(path: Column, content: Column, explicit: Column) -> Column:
    """Which reader takes a document: an explicit format, else the path's suffix, else its first bytes; unknown ones read as DOCX."""
    suffix = F.coalesce(_lookup(SUFFIXES)[explicit], F.when(explicit.isNotNull() & (explicit != 0), ".docx"), F.nullif(suffix_of(path), F.lit("")), sniffed(content))
    named = F.when(suffix.isin(".md", ".markdown"), "markdown").when(suffix.isin(".txt", ".text"), "text").when(suffix == ".doc", "doc").when(suffix == ".rtf", "rtf")
    return F.coalesce(named, F.lit("docx"))


def image_type(mime: Column) -> Column:
    return F.coalesce(_lookup(IMAGE_TYPES)[F.lower(mime)], F.lit(1))


def image_size(content: Column) -> Column:
    """(width, height) in points at 96 DPI of a PNG, GIF or JPEG; null of others."""
    h = F.hex(F.substring(content, 1, 24))
    # a JPEG's frame header: the first marker C0 to CF but C4, C8 and CC, after whole segments of their stated lengths
    whole = F.hex(content)
    step = lambda a, _: F.when(a["done"] | ~F.substring(whole, a["at"], 2).eqNullSafe(F.lit("FF")), a).otherwise(
        F.when(F.substring(whole, a["at"] + 2, 2).rlike("^C[0-35-79-BD-F]$"), F.struct(a["at"].alias("at"), F.lit(True).alias("done")))
        .otherwise(F.struct((a["at"] + 4 + 2 * F.conv(F.substring(whole, a["at"] + 4, 4), 16, 10).cast("int")).alias("at"), F.lit(False).alias("done")))
    )
    frame = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(F.lit(5).alias("at"), F.lit(False).alias("done")), step, lambda a: F.when(a["done"], a["at"]))
    place = lambda k: F.conv(F.substring(whole, frame + k, F.lit(4)), 16, 10).cast("double")
    big = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("double")
    little = lambda a: F.conv(F.concat(F.substring(h, a + 2, 2), F.substring(h, a, 2)), 16, 10).cast("double")
    png, gif = h.startswith("89504E470D0A1A0A"), h.rlike("^474946383[79]61")
    size = lambda w, e: F.struct((w * 0.75).alias("width"), (e * 0.75).alias("height"))
    return F.when(png, size(big(33), big(41))).when(gif, size(little(13), little(17))).when(h.startswith("FFD8FF") & frame.isNotNull(), size(place(14), place(10)))
