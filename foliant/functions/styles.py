"""Styles, list markers, tab stops and other small structures as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flags of a conditional style mask, in the order of its twelve characters.
MASK = ("first_row", "last_row", "first_column", "last_column", "odd_column_banding", "even_column_banding", "odd_row_banding", "even_row_banding", "top_right_cell", "top_left_cell", "bottom_right_cell", "bottom_left_cell")
# Number formats that count.
ORDERED = ("decimal", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman", "ordinal")


def _number(name: Column, pattern: str) -> Column:
    return F.regexp_extract(name, pattern, 1).try_cast("int")


def heading_level(name: Column, identifier: Column | None = None) -> Column:
    """1 to 6, or 0: by the built-in identifier (1 to 9), else by the name."""
    identifier = F.lit(0) if identifier is None else identifier
    named = F.coalesce(_number(name, r"(?i)SetextHeading(\d+)"), _number(name, r"(?i)Heading\s*(\d+)"), F.lit(0))
    return F.least(F.lit(6), F.when(identifier.between(1, 9), identifier).otherwise(named))


def quote_level(name: Column) -> Column:
    return F.when(name.rlike("(?i)Quote"), F.coalesce(_number(name, r"(?i)Quote(\d+)"), F.lit(1))).otherwise(F.lit(0))


def code_type(name: Column) -> Column:
    """fenced, indented, inline, or empty; code of no named type is fenced."""
    low = F.lower(name)
    return F.when(~low.contains("code"), "").when(low.contains("fenced"), "fenced").when(low.contains("indentedcode"), "indented").when(low.contains("inlinecode"), "inline").otherwise("fenced")


def code_language(name: Column) -> Column:
    return F.when(F.lower(name).contains("code") & name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise("")


def parsed_style(name: Column, identifier: Column | None = None) -> Column:
    """What a style's name says; an empty name is Normal."""
    name = F.when(F.coalesce(name, F.lit("")) == "", F.lit("Normal")).otherwise(name)
    low = F.lower(name)
    return F.struct(
        name.alias("name"),
        heading_level(name, identifier).alias("heading_level"),
        (quote_level(name) > 0).alias("is_quote"),
        quote_level(name).alias("quote_level"),
        low.contains("code").alias("is_code"),
        code_type(name).alias("code_type"),
        code_language(name).alias("code_language"),
        (low.contains("list") & low.contains("paragraph")).alias("is_list_paragraph"),
    )


def style_names(chain: Column) -> Column:
    """Names of a comma-separated chain, blank ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(chain, F.lit("")), ","), F.trim), lambda x: x != "")


def is_ordered(number_format: Column) -> Column:
    return F.coalesce(number_format.isin(*ORDERED), F.lit(False))


def bullet_marker(level: Column, first: str = "-") -> Column:
    """Markers of bullet lists by depth, the last of them for all deeper levels."""
    marks = F.array(F.lit(first), F.lit("+" if first == "*" else "o"), F.lit("-" if first == "+" else "+"))
    return F.get(marks, F.least(level, F.lit(2)))


def list_item(text: Column, level: Column, marker: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), level), marker, F.lit(" "), text)


def mask_from(value: Column) -> Column:
    """A struct of twelve flags of a string of ones and zeros; a short one is filled with zeros."""
    padded = F.rpad(F.coalesce(value, F.lit("")), 12, "0")
    return F.struct(*[(F.substring(padded, k + 1, 1) == "1").alias(n) for k, n in enumerate(MASK)])


def mask_to(mask: Column) -> Column:
    return F.concat(*[F.when(mask[n], "1").otherwise("0") for n in MASK])


def add_tab_stop(stops: Column, position: Column, alignment: Column, leader: Column) -> Column:
    """Tab stops (position, alignment, leader, is_clear) with one more, in order of position."""
    return F.array_sort(F.array_append(stops, F.struct(position.alias("position"), alignment.alias("alignment"), leader.alias("leader"), F.lit(False).alias("is_clear"))))


def remove_tab_stop(stops: Column, position: Column) -> Column:
    return F.filter(stops, lambda t: F.abs(t["position"] - position) > 0.01)


def tab_stop_before(stops: Column, position: Column) -> Column:
    """The last stop before a place, cleared ones apart."""
    return F.get(F.reverse(F.filter(stops, lambda t: (t["position"] < position) & ~t["is_clear"])), F.lit(0))


def tab_stop_after(stops: Column, position: Column) -> Column:
    return F.get(F.filter(stops, lambda t: (t["position"] > position) & ~t["is_clear"]), F.lit(0))
