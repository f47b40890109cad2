"""Several values packed in one field: one row per value, with its position.

The text of an element is cut at its quote characters; the odd pieces are literals, in which delimiters are hidden, and the
even pieces are split at delimiters. An array fold then puts values together again (a delimiter before something that does
not continue the sequence of labels belongs to the value). Everything is a native expression: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.expr import let

# Fixed values of this module: private-use characters for hidden text.
_ESC_DQ, _ESC_SQ, _ESC_BS, _CUT, _Q = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
_PLAIN = ",;|/\n\t\r；、"
_HIDDEN = "".join(chr(0xE010 + i) for i in range(len(_PLAIN)))
_DELIM = r"[  　]*(?:[,;|/；、]|\r?\n|\t)[\s 　,;|；]*"
_MARK = r"(?:[-*•·]\s+)?"
_LABEL = r"[\"" + _Q + r"]?\(?([A-Z])[.):]"
_BLANK = r"[\s 　]"


def _label(x: Column) -> Column:
    return F.regexp_extract(x, rf"^{_BLANK}*{_MARK}{_LABEL}(?:{_BLANK}|$|(?=\S))", 1)


def _listed(x: Column) -> Column:
    """A bracketed list ('[..]' with quoted members): brackets off, member quotes marked."""
    body = F.regexp_replace(x, rf"(?s)^{_BLANK}*\[{_BLANK}*[\"'](.*)[\"']{_BLANK}*\]{_BLANK}*$", _Q + "$1" + _Q)
    members = lambda b: F.when(F.startswith(b, F.lit(_Q)), F.regexp_replace(b, rf"[\"']{_BLANK}*,{_BLANK}*[\"']", f"{_Q},{_Q}")).otherwise(b)
    return let(body, members)


def _hide(x: Column) -> Column:
    """Delimiters inside quotes become private characters; with an odd number of quotes nothing is hidden."""

    def by(q: str) -> Column:
        hidden = lambda pieces: F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.translate(p, _PLAIN, _HIDDEN)).otherwise(p))
        return let(F.split(x, q, -1), lambda pieces: F.when(F.size(pieces) % 2 == 1, F.array_join(hidden(pieces), q)).otherwise(x))

    return F.when(F.instr(x, _Q) > 0, by(_Q)).when(F.instr(x, '"') > 0, by('"')).otherwise(x)


def _marked(x: Column, alone: Column) -> Column:
    """A cut mark before each delimiter at which a new value may begin."""
    labelled = F.regexp_replace(x, rf"({_DELIM})(?={_MARK}{_LABEL})", _CUT + "$1")
    quoted = F.regexp_replace(x, rf"({_DELIM})(?={_Q})", _CUT + "$1")
    upper = F.regexp_replace(x, rf"({_DELIM})(?<!\d,)(?=[\"\p{{Lu}}\p{{Nd}}])", _CUT + "$1")
    strong = F.regexp_replace(x, r"([  　]*(?:[;|；]|\r?\n|\t)[\s,;|；]*)(?=[\"\p{Lu}\p{Nd}])", _CUT + "$1")
    every = F.regexp_replace(x, rf"({_DELIM})(?=\S)", _CUT + "$1")
    starts_lower = x.rlike(rf"^{_BLANK}*{_MARK}\"?(?![\"\p{{Lu}}\p{{Nd}}])")
    return (
        F.when(F.instr(x, _Q) > 0, quoted)
        .when(_label(x) != "", labelled)
        .when(alone & starts_lower, every)
        .when(alone, upper)
        .otherwise(strong)
    )


def _fold(x: Column) -> Column:
    """Values of a marked element. A labelled piece begins a value only if its label follows that of the value before."""
    bare = lambda p: F.regexp_replace(p, rf"^(?:{_DELIM})", "")

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        follows = lambda q: F.ascii(_label(q)) == F.ascii(_label(last)) + 1
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, p)))
        return let(bare(p), lambda q: F.when(follows(q), F.concat(acc, F.array(q))).otherwise(joined))

    def together(pieces: Column) -> Column:
        folded = F.aggregate(F.slice(pieces, 2, F.size(pieces)), F.slice(pieces, 1, 1), step)
        plain = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(bare(p)))
        labelled = ~F.contains(x, F.lit(_Q)) & (_label(F.element_at(pieces, 1)) != "")
        return F.when(F.size(pieces) == 1, pieces).when(labelled, folded).otherwise(plain)

    return let(F.split(x, _CUT, -1), together)


def _clean(x: Column) -> Column:
    """Outer blanks, separators, list marks, enclosing quotes and escapes off."""
    edge = rf"(?:{_BLANK}|[,;|；、])"
    y = F.regexp_replace(x, rf"^{edge}*{_MARK}|{edge}+$", "")
    y = F.translate(y, _Q, "")
    quoted = lambda y: F.replace(F.regexp_replace(y, r'(?s)^"((?:[^"]|"")*)"$', "$1"), F.lit('""'), F.lit('"'))
    y = let(y, lambda y: F.when(F.startswith(y, F.lit('"')) & y.rlike(r'(?s)^"(?:[^"]|"")*"$'), quoted(y)).otherwise(y))
    y = F.translate(y, _HIDDEN + _ESC_DQ + _ESC_SQ + _ESC_BS, _PLAIN + "\"'\\")
    return F.regexp_replace(y, rf"^{_BLANK}+|{_BLANK}+$", "")


def unpack_elements(options: Column) -> Column:
    """``ARRAY<STRING>`` to ``ARRAY<ARRAY<STRING>>``: the values of each element, in order. Null and blank elements give none."""
    alone = F.size(options) == 1
    x = F.filter(options, lambda e: e.isNotNull() & e.rlike(r"\S"))
    x = F.transform(x, lambda e: F.replace(F.replace(F.replace(e, F.lit("\\\\"), F.lit(_ESC_BS)), F.lit('\\"'), F.lit(_ESC_DQ)), F.lit("\\'"), F.lit(_ESC_SQ)))
    x = F.transform(x, _listed)
    x = F.transform(x, _hide)
    x = F.transform(x, lambda e: _marked(e, alone))
    x = F.transform(x, _fold)
    return F.transform(x, lambda vs: F.filter(F.transform(vs, _clean), lambda v: v != ""))


def split_packed(df: DataFrame, id_col: str, column: str, only_packed: bool = True) -> DataFrame:
    """One row per value of an ``ARRAY<STRING>`` column whose elements may hold several values each.

    Returns ``(<id_col>, pos INT, val STRING)``; ``pos`` counts from 1 over the whole field. With ``only_packed`` only records
    that have an element of more than one value come out. Null arrays, null elements and blank elements give no rows; repeated
    rows come out as often as they are in the input; columns other than the two named ones are ignored, whatever their names.
    """
    parts = df.select(F.col(id_col).alias("rec"), F.col(column).alias("raw")).where(F.size("raw") > 0)
    parts = parts.select("rec", unpack_elements(F.col("raw")).alias("parts"))
    if only_packed:
        parts = parts.where(F.exists("parts", lambda p: F.size(p) > 1))
    vals = parts.select("rec", F.posexplode(F.flatten("parts")).alias("p", "val"))
    return vals.select(F.col("rec").alias(id_col), (F.col("p") + 1).cast("int").alias("pos"), "val")
