"""Parsing that needs a scan with state: brace matching, strict and lenient action JSON, LaTeX answers. Arrow-batched functions."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACTIONS = ("get_frames", "get_audio", "get_clip", "answer")
_ALLOWED = {"observation", "think", "action", "confidence"}


def outer_braces(s: str, at: int = 0) -> str | None:
    """From the first brace to its match by depth alone (braces in strings count too); None without one or without a match."""
    start = s.find("{", at)
    if start < 0:
        return None
    depth = 0
    for m in re.finditer(r"[{}]", s[start:]):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return s[start : start + m.end()]
    return None


def lenient_action(raw: str | None, need_action: bool = True) -> tuple[dict | None, str]:
    """``(object, label)``: the label is empty, no_output, no_brace, unbalanced_braces, not_action_dict or json_decode_err."""
    if not raw:
        return None, "no_output"
    s = raw.strip()
    if s.startswith("```"):
        s = re.sub(r"^```[a-zA-Z]*\n", "", s, count=1).split("```", 1)[0]
    if "{" not in s:
        return None, "no_brace"
    body = outer_braces(s)
    if body is None:
        return None, "unbalanced_braces"
    try:
        obj = json.loads(body)
    except ValueError:
        return None, "json_decode_err"
    if isinstance(obj, dict) and (not need_action or isinstance(obj.get("action"), dict)):
        return obj, ""
    return None, "not_action_dict"


def _number(x: object) -> bool:
    return isinstance(x, (int, float))


def strict_action(raw: str | None, need_confidence: bool = False) -> tuple[str | None, str | None, str | None]:
    """``(type, code, message)``: the first check that fails gives the code; a clean action gives its type."""
    bad = lambda code, msg: (None, code, msg)
    if not isinstance(raw, str):
        return bad("INVALID_JSON", "not a string")
    s = raw.strip()
    if s.startswith("```") or (len(s) > 1 and s[0] == s[-1] and s[0] in "\"'"):
        return bad("INVALID_JSON", "must be raw JSON")
    if not (s.startswith("{") and s.endswith("}")):
        return bad("INVALID_JSON", "must be one object")
    try:
        obj, end = json.JSONDecoder().raw_decode(s)
    except ValueError:
        return bad("INVALID_JSON", "cannot be decoded")
    if s[end:].strip():
        return bad("TRAILING_GARBAGE", "text after the object")
    keys = set(obj)
    required = {"observation", "think", "action"} | ({"confidence"} if need_confidence else set())
    if required - keys:
        return bad("INVALID_JSON", f"missing keys {sorted(required - keys)}")
    if keys - _ALLOWED:
        return bad("INVALID_JSON", f"unknown keys {sorted(keys - _ALLOWED)}")
    for k in ("observation", "think"):
        if not isinstance(obj[k], str):
            return bad("INVALID_JSON", f"{k} must be a string")
    if "confidence" in obj and not _number(obj["confidence"]):
        return bad("INVALID_JSON", "confidence must be a number")
    act = obj["action"]
    if not isinstance(act, dict):
        return bad("INVALID_JSON", "action must be an object")
    kind = act.get("type")
    if not isinstance(kind, str) or kind not in ACTIONS:
        return bad("UNKNOWN_ACTION_TYPE", f"unknown type {kind}")
    if kind == "answer":
        return (kind, None, None) if isinstance(act.get("content"), str) else bad("ANSWER_NOT_STRING", "content must be a string")
    code = {"get_frames": "INVALID_JSON", "get_clip": "CLIP_ARG_TYPE", "get_audio": "AUDIO_ARG_TYPE"}[kind]
    if not (_number(act.get("start")) and _number(act.get("end"))):
        return bad(code, "start and end must be numbers")
    if kind == "get_frames" and not isinstance(act.get("num"), int):
        return bad("INVALID_JSON", "num must be an integer")
    return kind, None, None


def cleaned_json(raw: str | None) -> str | None:
    """Fence off, from the first brace to the last, on one line; None if that is no JSON."""
    s = re.sub(r"^\s*```[a-zA-Z]*|```\s*$", "", raw or "")
    a, b = s.find("{"), s.rfind("}")
    if a < 0 or b < a:
        return None
    try:
        return json.dumps(json.loads(s[a : b + 1]), ensure_ascii=False)
    except ValueError:
        return None


_STRICT = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "code", "message")])
_LENIENT = T.StructType([T.StructField("type", T.StringType()), T.StructField("label", T.StringType())])


@F.pandas_udf(_STRICT)
def parse_action_strict(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([strict_action(x) for x in raw], columns=["type", "code", "message"])


@F.pandas_udf(_LENIENT)
def parse_action_lenient(raw: pd.Series) -> pd.DataFrame:
    def one(x):
        obj, label = lenient_action(x)
        return (str(obj["action"].get("type", "UNKNOWN")) if obj else None, label)

    return pd.DataFrame([one(x) for x in raw], columns=["type", "label"])


@F.pandas_udf(T.StringType())
def clean_json(raw: pd.Series) -> pd.Series:
    return raw.map(cleaned_json)


# -- LaTeX answers


def last_boxed(s: str, fbox: bool = True) -> str | None:
    """The content of the last box of a LaTeX text; ``\\boxed x$`` runs to the dollar sign."""
    if fbox and "\\boxed " in s:
        return s.rsplit("\\boxed ", 1)[1].split("$")[0]
    heads = ("\\boxed", "\\fbox") if fbox else ("\\boxed{",)
    at = next((i for h in heads if (i := s.rfind(h)) >= 0), -1)
    if at < 0:
        return None
    body = outer_braces(s, at)
    if body is None:
        return None
    return body[1:-1] if s[at:].startswith(("\\boxed{", "\\boxed {")) else None


# Texts that the normal form of a MATH answer drops or replaces, in order.
MATH_DROPS = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]


def _braced_arguments(s: str) -> str:
    """``\\frac ab`` with braces around single-character arguments; the text as it was if an argument is missing."""
    head, *rest = s.split("\\frac")
    out = [head]
    for part in rest:
        m = re.match(r"(?s)(\{.*)|([^{])(\{.*)|([^{])([^{])(.*)", part)
        if not part or not m:
            return s
        whole, a, tail, c, d, end = m.groups()
        out.append("\\frac" + (whole if whole is not None else f"{{{a}}}{tail}" if a is not None else f"{{{c}}}{{{d}}}{end}"))
    return "".join(out)


def math_normal(s: str) -> str:
    """Normal form of a MATH answer: units, spacing, fractions and roots written one way."""
    for a, b in MATH_DROPS:
        s = s.replace(a, b)
    if "\\text{ " in s:
        head, *more = s.split("\\text{ ")
        if len(more) != 1:
            raise ValueError("several units")
        s = head
    s = s.replace("\\%", "").replace(" .", " 0.").replace("{.", "{0.")
    if not s:
        return s
    s = "0" + s if s[0] == "." else s
    sides = s.split("=")
    if len(sides) == 2 and len(sides[0]) <= 2:
        s = sides[1]
    s = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", s).replace(" ", "")
    s = _braced_arguments(s)
    s = "\\frac{1}{2}" if s == "0.5" else s
    m = re.fullmatch(r"(-?\d+)/(-?\d+)", s)
    if m and s == f"{int(m[1])}/{int(m[2])}":
        s = f"\\frac{{{int(m[1])}}}{{{int(m[2])}}}"
    return s


def math_equal(a: str | None, b: str | None) -> bool:
    if a is None or b is None:
        return a is None and b is None
    try:
        return math_normal(a) == math_normal(b)
    except (ValueError, IndexError):
        return a == b


def math_score(text: str | None, truth: str | None) -> float:
    answer = last_boxed(text) if text else None
    return 1.0 if answer is not None and math_equal(answer, truth) else 0.0


# Substitutions and removed expressions of the short-answer normal form, in order.
ANSWER_SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
ANSWER_REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges",
    "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
# Wrappers that the short-answer normal form takes off, with what is left of each, in order.
_UNWRAP = [(r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$"), (r"(\\text\{)(.*?)(\})", r"\2"), (r"(\\textbf\{)(.*?)(\})", r"\2"), (r"(\\overline\{)(.*?)(\})", r"\2"), (r"(\\boxed\{)(.*)(\})", r"\2"), (r"(frac)([^{])(.)", r"frac{\2}{\3}"), (r"(sqrt)([^{])", r"sqrt{\2}")]


def short_answer(s: str) -> str:
    """Normal form of a short answer: right side of the last equation, articles, units and wrappers off."""
    s = s.rsplit("=", 1)[-1]
    for a, b in [*ANSWER_SUBSTITUTIONS, *((x, "") for x in ANSWER_REMOVED)]:
        s = s.replace(a, b)
    for pattern, to in _UNWRAP:
        s = re.sub(pattern, to, s)
    s = s.replace("$", "")
    plain = s.replace(",", "")
    return (plain if plain.isdigit() else s).strip()


def dapo_score(text: str | None, truth: str | None, strict_box: bool = False) -> tuple[float, bool, str | None]:
    """``(score, acc, pred)`` from the last 300 characters: the last ``Answer:`` line, or (strict) the last box of the last 100."""
    tail = (text or "")[-300:]
    if strict_box:
        pred = last_boxed(tail[-100:], fbox=False)
        ok = pred == truth
    else:
        found = re.findall(r"(?i)Answer\s*:\s*([^\n]+)", tail)
        pred = short_answer(found[-1] if found else "[INVALID]")
        ok = truth is not None and pred == short_answer(truth)
    return (1.0 if ok else -1.0), ok, pred


def answers_equal(a: str | None, b: str | None, places: float = 1e-4) -> bool:
    """Equality of a given final answer ``a`` with the truth ``b``.

    Equal normal texts are equal. Tuples and intervals have the same brackets and equal members, matrices equal cells. Two fractions
    must be the same fraction: one that is not reduced is no match. A whole number matches whole numbers only. Other numbers are compared by
    value (percent and thousands allowed), other expressions by their value at several points: sums, products, quotients, powers, roots
    of numbers and letters.
    """
    if a is None or b is None:
        return False
    na, nb = (re.sub(r"\\?%|\\\$|\$", "", math_normal(x.strip().rstrip("."))) for x in (a, b))
    if na == nb:
        return True
    if not na or not nb:
        return False
    if "matrix}" in na or "matrix}" in nb:
        ca, cb = _cells(na), _cells(nb)
        return ca is not None and cb is not None and [len(r) for r in ca] == [len(r) for r in cb] and all(answers_equal(x, y, places) for r, t in zip(ca, cb, strict=True) for x, y in zip(r, t, strict=True))
    ma, mb = (re.fullmatch(r"(?s)([\[(])([^\[\]()]*,[^\[\]()]*)([\])])", x) for x in (na, nb))
    if ma or mb:
        if not (ma and mb and (ma[1], ma[3]) == (mb[1], mb[3])):
            return False
        pa, pb = (re.split(r",(?!\d{3}(?!\d))", m[2]) if not re.search(r"\d,\d{3}(?!\d)", m[2]) else m[2].split(",") for m in (ma, mb))
        return len(pa) == len(pb) and len(pa) > 1 and all(answers_equal(x, y, places) for x, y in zip(pa, pb, strict=True))
    fa, fb = _fraction(na), _fraction(nb)
    if fa and fb:
        return fa == fb
    va, vb = _value(na), _value(nb)
    if _whole(na) != _whole(nb) and va is not None and vb is not None:
        # a whole number is matched by a whole number only; a percent sign may stand for the factor of a hundred
        return ("%" in a) != ("%" in b) and any(abs(va - x) <= places * max(1.0, abs(x)) for x in (vb * 100, vb / 100))
    if va is not None and vb is not None:
        return any(abs(va - x) <= places * max(1.0, abs(x)) for x in (vb, vb * 100, vb / 100))
    return _whole(na) == _whole(nb) and _same_expression(na, nb)


def _fraction(s: str) -> tuple[int, int] | None:
    """Numerator and denominator of a fraction of whole numbers, as written."""
    m = re.fullmatch(r"(-?)\\frac\{(-?\d+)\}\{(\d+)\}", s) or re.fullmatch(r"(-?)()(\d+)/(\d+)", s)
    if not m:
        return None
    top, bottom = (m[2], m[3]) if m.lastindex == 3 else (m[3], m[4])
    return (-1 if m[1] else 1) * int(top), int(bottom)


def _whole(s: str) -> bool:
    """Whether a text is a whole number, thousands marks allowed."""
    return bool(re.fullmatch(r"-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.0*)?", s))


def _cells(s: str) -> list[list[str]] | None:
    """The cells of a LaTeX matrix, row by row."""
    m = re.fullmatch(r"(?s)\\begin\{[pbv]?matrix\}(.*)\\end\{[pbv]?matrix\}", s)
    return [[c.strip() for c in row.split("&")] for row in re.split(r"\\(?![a-zA-Z])", m[1]) if row.strip()] if m else None


_TOKEN = re.compile(r"\\(?:frac|sqrt|cdot|times|div|pi|left|right)|\d+(?:\.\d+)?|[a-zA-Z]|[-+*/^(){}\[\]]")


class _Expression:
    """An expression of numbers, letters, sums, products, quotients, powers and roots, evaluated at given values of its letters."""

    def __init__(self, text: str):
        text = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text)
        self.tokens, end = [], 0
        for m in _TOKEN.finditer(text):
            if m.start() != end:
                raise ValueError("a sign that is none of an expression")
            self.tokens.append(m[0])
            end = m.end()
        if end != len(text) or not self.tokens:
            raise ValueError("a sign that is none of an expression")
        self.letters = {t for t in self.tokens if len(t) == 1 and t.isalpha()}

    def at(self, values: dict[str, complex]) -> complex:
        self.i, self.values = 0, values
        out = self._sum()
        if self.i != len(self.tokens):
            raise ValueError("something is left")
        return out

    def _peek(self) -> str:
        return self.tokens[self.i] if self.i < len(self.tokens) else ""

    def _take(self, want: str | None = None) -> str:
        t = self._peek()
        if not t or (want and t != want):
            raise ValueError("another sign was expected")
        self.i += 1
        return t

    def _sum(self) -> complex:
        sign = -1 if self._peek() == "-" else 1
        if self._peek() in ("+", "-"):
            self._take()
        out = sign * self._product()
        while self._peek() in ("+", "-"):
            out = out + self._product() if self._take() == "+" else out - self._product()
        return out

    def _product(self) -> complex:
        out = self._power()
        while (t := self._peek()) and t not in "+-)}]":
            if t in ("/", "\\div"):
                self._take()
                out = out / self._power()
            else:
                if t in ("*", "\\cdot", "\\times"):
                    self._take()
                out = out * self._power()
        return out

    def _power(self) -> complex:
        base = self._atom()
        if self._peek() == "^":
            self._take()
            sign = -1 if self._peek() == "-" else 1
            if sign < 0:
                self._take()
            exponent = sign * self._atom()
            if abs(exponent) > 400:
                raise ValueError("a power too large")
            return base**exponent
        return base

    def _atom(self) -> complex:
        t = self._take()
        if t == "-":
            return -self._atom()
        if t in "({[" and t:
            out = self._sum()
            self._take({"(": ")", "{": "}", "[": "]"}[t])
            return out
        if t == "\\frac":
            top = self._atom()
            return top / self._atom()
        if t == "\\sqrt":
            degree = 2
            if self._peek() == "[":
                degree = self._atom()
            return self._atom() ** (1 / degree)
        if t == "\\pi":
            return complex(math.pi)
        if t in self.values:
            return self.values[t]
        return complex(float(t))


def _same_expression(a: str, b: str) -> bool:
    """Whether two expressions have the same letters and the same values at five points; what cannot be read is not the same."""
    try:
        x, y = _Expression(a), _Expression(b)
        if x.letters != y.letters:
            return False
        for k in range(5):
            values = {c: complex(1.3 + 0.37 * k + 0.11 * (ord(c) % 32)) for c in x.letters}
            u, v = x.at(values), y.at(values)
            if not abs(u - v) <= 1e-9 * max(1.0, abs(u), abs(v)):
                return False
        return True
    except (ValueError, ZeroDivisionError, OverflowError, RecursionError, TypeError):
        return False


def _value(s: str) -> float | None:
    m = re.fullmatch(r"(-?)\\frac\{(-?\d+(?:\.\d+)?)\}\{(-?\d+(?:\.\d+)?)\}", s)
    try:
        if m:
            return (-1 if m[1] else 1) * float(m[2]) / float(m[3])
        return float(s.replace(",", "")) if re.fullmatch(r"-?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?", s) else None
    except ZeroDivisionError:
        return None


def _each_once(score: Callable, *sides: pd.Series) -> list:
    """The score of every row; rows of the batch that are equal are scored once, since answers repeat."""
    known: dict[tuple, object] = {}
    out = []
    for pair in zip(*sides, strict=True):
        if pair not in known:
            known[pair] = score(*pair)
        out.append(known[pair])
    return out


@F.pandas_udf(T.DoubleType())
def math_score_udf(text: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series(_each_once(math_score, text, truth), dtype="float64")


_DAPO = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("acc", T.BooleanType()), T.StructField("pred", T.StringType())])


@F.pandas_udf(_DAPO)
def dapo_score_udf(text: pd.Series, truth: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_each_once(dapo_score, text, truth), columns=["score", "acc", "pred"])


@F.pandas_udf(T.BooleanType())
def answers_equal_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_each_once(answers_equal, a, b), dtype="bool")


def geo_score(text: str | None, truth: str | None) -> float:
    """0.9 of the boxed answer's equality and 0.1 of the think-then-box format."""
    fmt = bool(re.fullmatch(r"(?s).*<think>.*</think>.*\\boxed\{.*\}.*", text or ""))
    answer = last_boxed(text) if text else None
    return 0.9 * float(answer is not None and answers_equal(answer, truth)) + 0.1 * float(fmt)


def fenced_code(text: str | None) -> str | None:
    """The last fenced code block of a text (``python`` preferred), None without one."""
    if not text:
        return None
    blocks = re.findall(r"```(?:python|py)\n(.*?)```", text, re.S) or re.findall(r"```\w*\n(.*?)```", text, re.S)
    return blocks[-1].strip() if blocks else None
