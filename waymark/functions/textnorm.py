"""Text normalisers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value(x: Column) -> Column:
    """Upper case without outer spaces; null as ''."""
    return F.upper(F.trim(F.coalesce(x, F.lit(""))))


def name(x: Column) -> Column:
    """As ``value``, with white space inside collapsed."""
    return F.trim(F.regexp_replace(value(x), r"\s+", " "))


def identifier(x: Column) -> Column:
    """As ``value``, without leading zeros: 003A is 3A, 000 is 0."""
    return F.regexp_replace(value(x), "^0+([0-9]+[A-Z]?)$", "$1")


def exact_key(x: Column) -> Column:
    """The look-up form of a label: punctuation and white space are one space, none around hyphens and slashes."""
    flat = F.upper(F.trim(F.regexp_replace(x, r"[,.\s\p{Z}]+", " ")))
    return F.regexp_replace(flat, r"\s*([-/])\s*", "$1")


ORDINAL = r"(?:[0-9]*1[1-3]TH|[0-9]*(?:(?<!1)1ST|(?<!1)2ND|(?<!1)3RD|[04-9]TH))"


#: The structural form as rules, in the order they apply: what a rule is for, its pattern, what it puts there. Fixed
#: values: which entities and dashes count, and which glued numbers are ordinals.
STRUCTURE = (
    ("damaged characters go", "\ufffd", ""),
    ("entities of spaces, with leading zeros or not", "&(?:NBSP|#0*(?:32|160)|#X0*(?:20|A0));", " "),
    ("one kind of space", r"[\p{Z}\s]+", " "),
    ("one kind of dash", "[‐-―−]", "-"),
    ("ranges and fractions are closed up", r"(?<=[A-Z0-9])\s*([-/])\s*(?=[A-Z0-9])", "$1"),
    ("12/A is 12A", r"(\d+)/([A-Z])(?=\s|,|$)", "$1$2"),
    ("stops part words", r"\.", " "),
    ("commas stand alone", r"\s*,\s*", ","),
    ("a number glued to a word is parted from it", rf"\b(?!{ORDINAL}\b)(\d+)([A-Z]{{2,}})", "$1 $2"),
    ("no runs of spaces", r"\s+", " "),
)


def structural(x: Column, keep_commas: bool = True) -> Column:
    """The parser's input form, in upper case, by the rules of ``STRUCTURE``; commas become spaces if they are not kept."""
    x = F.upper(F.make_valid_utf8(x))
    for _, pattern, new in STRUCTURE:
        x = F.regexp_replace(x, pattern, " " if new == "," and not keep_commas else new)
    return F.trim(x)


ABBREVIATIONS = ((r"\b(?:MNT|MT)\b", "MOUNT"), (r"\bNTH\b", "NORTH"), (r"\bSTH\b", "SOUTH"), ("^N ", "NORTH "), ("^S ", "SOUTH "), ("^E ", "EAST "), ("^W ", "WEST "), (r"\bCK\b", "CREEK"), (r"\s*&\s*", " AND "))
ORDINAL_WORDS = "FIRST SECOND THIRD FOURTH FIFTH SIXTH SEVENTH EIGHTH NINTH TENTH ELEVENTH TWELFTH THIRTEENTH FOURTEENTH FIFTEENTH SIXTEENTH SEVENTEENTH EIGHTEENTH NINETEENTH TWENTIETH".split()


def standardised(c) -> Column:
    """One line of a parsed row; ``c`` maps a field name to its column. Null if nothing is left."""
    number = F.concat(F.concat_ws("", c("in_number_first").cast("string"), c("in_number_suffix")), F.coalesce(F.concat(F.lit("-"), c("in_number_last").cast("string")), F.lit("")))
    street = F.concat_ws(
        " ", c("in_building_name"), F.concat_ws(" ", c("in_flat_type"), c("in_flat_number")), F.concat_ws(" ", c("in_level_type"), c("in_level_number")),
        F.when(c("in_lot_number").isNotNull(), F.concat(F.lit("LOT "), c("in_lot_number"))), F.nullif(number, F.lit("")), c("in_street_name"), c("in_street_type"), c("in_street_suffix"),
    )
    place = F.concat_ws(" ", c("in_locality"), c("in_state"), F.lpad(c("in_postcode").cast("string"), 4, "0"))
    parts = [F.nullif(F.trim(F.regexp_replace(p, " +", " ")), F.lit("")) for p in (street, place)]
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))
