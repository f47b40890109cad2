"""Normal forms of texts, numbers, recordings and labels, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.expr import let

# Private-use characters standing for a decimal point, a sign and a boundary between digit groups.
_POINT, _MINUS, _GAP = "\ue101", "\ue102", "\ue103"
_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_ASCII = "".join(chr(0x21 + i) for i in range(94))
_NOT_ALNUM = r"[^\p{L}\p{N}" + _POINT + _MINUS + _GAP + "]"


def folded(x: Column) -> Column:
    """Lower case, full-width forms made narrow."""
    return F.lower(F.translate(x, _WIDE, _ASCII))


def loose_text(x: Column, signed: bool = False) -> Column:
    """Text without case, white space and punctuation, in which numbers keep their value.

    A decimal point between digits stays, trailing zeros after it go, digit groups stay apart; with ``signed`` a minus
    before a number stays too.
    """
    y = F.regexp_replace(folded(x), r"(?<=\d)\.(?=\d)", _POINT)
    if signed:
        y = F.regexp_replace(y, r"(?<![\p{L}\p{N}\s" + _POINT + r"])-(?=\d)|(?<=^|[\s])-(?=\d)", _MINUS)
    y = F.regexp_replace(y, rf"(?<=\d){_NOT_ALNUM}+(?=\d)", _GAP)
    y = F.regexp_replace(y, rf"{_NOT_ALNUM}+", "")
    y = F.regexp_replace(y, rf"({_POINT}\d*?)0+(?!\d)", "$1")
    y = F.regexp_replace(y, rf"{_POINT}(?!\d)", "")
    return F.regexp_replace(y, rf"(?<![\p{{L}}\d{_POINT}])0+(?=\d)", "")


def loose_path(x: Column) -> Column:
    """A path without case, white space and punctuation; digit groups stay apart."""
    y = F.regexp_replace(folded(x), rf"(?<=\d){_NOT_ALNUM}+(?=\d)", _GAP)
    return F.regexp_replace(y, rf"{_NOT_ALNUM}+", "")


def recording_key(x: Column) -> Column:
    """The recording a path names: its file, whatever folder, store, file type, case, separators and stretch.

    Null, and paths without a file name, give null.
    """
    y = F.regexp_replace(folded(F.trim(x)), r"[?#].*$", "")
    y = F.regexp_extract(F.regexp_replace(y, r"\s+$", ""), r"([^/\\]+)[/\\]*$", 1)
    y = F.regexp_replace(y, r"(?:\.[a-z][a-z0-9]{1,4})+$", "")
    stretch = r"[._\-\s~]+(\d{1,7})(?:\.\d+)?[._\-\s~]+(\d{1,7})(?:\.\d+)?$"

    def bare(y: Column) -> Column:
        lo, hi = F.regexp_extract(y, stretch, 1), F.regexp_extract(y, stretch, 2)
        rising = (lo != "") & (lo.try_cast("int") < hi.try_cast("int")) & y.rlike(r"^.*[\p{L}\p{N}].*" + stretch)
        return F.when(y.rlike(r"\d$"), F.when(rising, F.regexp_replace(y, stretch, "")).otherwise(y)).otherwise(y)

    return F.nullif(F.regexp_replace(let(y, bare), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def label_key(x: Column) -> Column:
    """A category or source label without regard to case, outer blanks and the choice of ``_``, ``-`` or blank."""
    return F.regexp_replace(F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")), r"[_\-\s]", "_")
