"""Text functions as Catalyst expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"

NOT_BREAK = r"[^\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def split_lines(text: Column) -> Column:
    """Lines of a text; the break at the very end opens no further line, and empty text has none."""
    last = F.right(text, F.lit(1))
    end = F.when(text.endswith("\r\n"), 2).when(last.rlike(LINE_BREAK), 1).otherwise(0)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.left(text, F.length(text) - end), LINE_BREAK, -1))


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


# What stands for typographic characters that Latin-1 lacks.
LATIN1 = {
    "\u2018": "'", "\u2019": "'", "\u201a": ",", "\u201b": "'", "\u201c": '"', "\u201d": '"', "\u201e": ",,",
    "\u2013": "-", "\u2014": "--", "\u2015": "--", "\u2026": "...",
    "\u2022": "\u00b7", "\u2023": "\u00b7", "\u2043": "\u00b7", "\uf0b7": "\u00b7", "\uf0a7": "\u00b7",
    "\u2009": " ", "\u200a": " ", "\u200b": "", "\u00a0": " ", "\u2011": "-", "\u2212": "-", "\u2122": "(TM)",
}


def latin1_safe(text: Column) -> Column:
    """Typographic characters become their plain forms, others beyond Latin-1 question marks, as the core PDF fonts need."""
    one = "".join(k for k, v in LATIN1.items() if len(v) == 1)
    out = F.translate(text, one, "".join(LATIN1[k] for k in one))
    for k, v in LATIN1.items():
        out = F.replace(out, F.lit(k), F.lit(v)) if len(v) != 1 else out
    return F.regexp_replace(out, r"[^\x00-\xFF]", "?")


def xml_escape(text: Column, attribute: bool = False) -> Column:
    """&, < and >; in attributes also the double quote. Characters that XML 1.0 can't hold are dropped."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) + ((('"', "&quot;"),) if attribute else ()):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_unescape(text: Column) -> Column:
    """All character references, named and numeric, decoded once as browsers do, with or without a semicolon; by whole batches."""

    def decode(batch: pd.Series) -> pd.Series:
        return batch.map(html.unescape, na_action="ignore")

    return F.pandas_udf(decode, StringType())(text)


# Fixed value: the tags that end a block, with no attributes.
BLOCK_TAG = r"(?i)</?(?:p|div|table|tr|td|th|h[1-6]|br)\s*/?>"
#: Parts blocks while references are decoded; no reference stands for it, and in a page it counts as a replacement character.
_BETWEEN = "\0"


def html_blocks(page: Column) -> Column:
    """Text blocks of a fragment: bare block tags split it, other tags go, blank blocks are dropped."""
    parts = F.split(F.replace(page, F.lit(_BETWEEN), F.lit("\ufffd")), BLOCK_TAG, -1)
    bare = F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, "<[^>]+>", "")), _BETWEEN)
    return F.filter(F.transform(F.split(html_unescape(bare), _BETWEEN, -1), strip), lambda x: x != "")


def escape_emphasis(text: Column) -> Column:
    """Backslashes before every asterisk and before underscores that are not between letters or digits."""
    return F.regexp_replace(text, r"(?U)\*|(?<!\w)_|_(?!\w)", r"\\$0")


def wrap_leading_blanks(text: Column) -> Column:
    """One to three blanks before a line's text go into a code span, which keeps them."""
    return F.regexp_replace(text, r"(?m)^([ \t]{1,3})(?=[^ \t\n])", "`$1`")


def quote_lines(text: Column, level: int = 1) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit("> " * level), x)), "\n")


def code_fence(text: Column, char: str = "`") -> Column:
    """A fence longer than any run of its character at a line's start, and at least three."""
    runs = F.regexp_extract_all(text, F.lit(f"(?m)^ {{0,3}}({char}{{3,}})"), F.lit(1))
    return F.repeat(F.lit(char), F.greatest(F.lit(3), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)) + 1))


def inline_code(text: Column) -> Column:
    """A code span whose delimiter is longer than any run of backticks inside; padded where the text touches one."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), longest + 1)
    pad = F.when(text.startswith("`") | text.endswith("`"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(fence, pad, text, pad, fence)


def line_kind(line: Column, following: Column) -> Column:
    """What a line of Markdown would begin on its own, given the line after it."""
    at = r"^ {0,3}"
    table = line.contains("|") & following.rlike(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$") & following.contains("|")
    return (
        F.when(line.rlike(r"^\s*$"), "blank")
        .when(line.rlike(at + r"(`{3,}[^`]*|~{3,}.*)$"), "fence")
        .when(line.rlike(at + r"#{1,6}([ \t]|$)"), "heading")
        .when(line.rlike(at + r"((\*[ \t]*){3,}|(-[ \t]*){3,}|(_[ \t]*){3,})$"), "rule")
        .when(table, "table")
        .when(line.rlike(at + ">"), "quote")
        .when(line.rlike(at + r"[-+*]([ \t]|$)"), "bullet")
        .when(line.rlike(at + r"[0-9]{1,9}[.)]([ \t]|$)"), "ordered")
        .when(line.rlike(r"^( {4}|\t)"), "code")
        .when(following.rlike(at + r"(=+|-+)[ \t]*$"), "setext")
        .otherwise("text")
    )


def roman(n: Column, upper: bool = True) -> Column:
    """Roman numerals; thousands are as many M, and below 1 there is none."""
    # fixed values
    digits = (
        ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
        ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
        ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
    )
    places = [F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), *[F.get(F.array(*map(F.lit, d)), (F.floor(n / 10**k) % 10).cast("int")) for k, d in reversed(list(enumerate(digits)))]]
    out = F.when(n >= 1, F.concat(*places)).when(n < 1, F.lit(""))
    return out if upper else F.lower(out)


def alphabetic(n: Column, upper: bool = True) -> Column:
    """A to Z, then AA, AB, ..., AZ, BA and so on; below 1 there is none."""
    zero = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))
    rest = lambda a: F.floor((a["left"] - 1) / 26)
    letter = lambda a: F.char((a["left"] - 1) % 26 + (65 if upper else 97))
    step = lambda a, _: F.when(a["left"] > 0, F.struct(rest(a).alias("left"), F.concat(letter(a), a["out"]).alias("out"))).otherwise(a)
    return F.when(n.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(14)), zero, step, lambda a: a["out"]))


def roman_numeral(n: int) -> str:
    """As `roman`, for one number."""
    tens = (("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"))  # fixed values
    return "M" * (n // 1000) + "".join(tens[k][n // 10**k % 10] for k in (2, 1, 0)) if n > 0 else ""


def letters(n: int) -> str:
    """As `alphabetic`, for one number."""
    return letters((n - 1) // 26) + chr(65 + (n - 1) % 26) if n > 0 else ""


def color_rgb(color: Column) -> Column:
    """RRGGBB of "Color [A=..,R=..,G=..,B=..]" or of six hexadecimal digits; else null."""
    part = lambda c: F.lpad(F.hex(F.regexp_extract(color, rf"{c}=(\d+)", 1).try_cast("int")), 2, "0")
    return F.when(color.rlike(r"^Color \["), F.concat(part("R"), part("G"), part("B"))).when(color.rlike("^#?[0-9A-Fa-f]{6}$"), F.upper(F.right(color, F.lit(6))))


# Points in a unit.
POINTS = {"twip": 1 / 20, "half_point": 1 / 2, "eighth": 1 / 8, "emu": 1 / 12700, "mm": 72 / 25.4, "inch": 72.0, "pixel": 0.75}


def points(value: Column, unit: str) -> Column:
    return value * F.lit(POINTS[unit])
