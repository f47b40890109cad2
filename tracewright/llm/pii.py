"""Personal information inside free text: found by a conditional random field and replaced by typed placeholders.

Texts are cut into segments at places where no entity can run on; digits are mapped to 0, since no feature looks at their value,
and each distinct segment of a batch is decoded once and whole. The field looks at shapes, ends, neighbours and closed word classes
(``pii_words``), never at the identity of a name, place or topic word. A span that it finds is then fitted to the written form of
its kind, which moves edges but finds nothing by itself.
"""

from __future__ import annotations

import base64
import hashlib
import inspect
import os
import pickle
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.crf import Crf
from tracewright.llm import crf as _crf
from tracewright.llm import pii_labels as _labels
from tracewright.llm import pii_words as _words_of
from tracewright.llm.pii_labels import KINDS, LABELLED_ROWS, labelled
from tracewright.llm.pii_words import CLASSES, FUNCTION, ZH_FAMILY, ZH_KEPT, ZH_PLACE
from tracewright.llm.tokens import VOCABULARY
from tracewright.session import shared_dir

SPACE_MARK, LINE_MARK = " ", "\n"
_DIGITS = {ord(c): "0" for c in "123456789" + "".join(chr(0xFF10 + i) for i in range(10))}
_CJK = "㐀-鿿豈-﫿぀-ヿ가-힯"
# A unit is a token with the white space before it, so that a text is its units one after another.
TOKEN = re.compile(rf"\s*(?:[{_CJK}]|[^\W\d_{_CJK}]+|\d+|[^\w\s]|_)")
_ABBREV = "ext|tel|tél|ave|apt|avda|str|nr|no|mrs|prof|blvd|bzw|usw|dña|sra|sta|ste|rd|hno|inc|dept|etc|cia"
# A stop after a word of three small letters (no abbreviation), or after a bracket or quote, before something that begins a
# sentence. The pattern begins with one set of characters, so that the search can skip all others.
CUT = re.compile(
    r"[.!?;})\]>|\n。！？](?:(?<=[a-zà-ÿ]{3}[.!?;])\s+(?=[A-ZÀ-Ý\[{(<|\"“])|(?<=[0)\]\"”][.!?])\s+(?=[A-ZÀ-Ý\[{(<|\"“])|(?<=[。！？])|(?<=\n)\s*\n|(?<=[.?!;})\]>|])\n|(?<=\n)(?=[\[{<|])|(?<=\n)(?=[A-Z]{4,} [a-z]))"
)
_ENDS_SHORT = re.compile(rf"\b(?:{_ABBREV})\.\s*$", re.I)

# Fixed forms: "@" or a bracketed "at" with dots of either form; the bare words "at" and "dot" only together.
_AT = r"(?:\s?[@＠]\s?|\s?[\[({]\s?at\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"
_LOCAL = r"[a-z0-9](?:[\w+%-]|\.(?=[\w+%-]))*"
EMAIL = re.compile(
    rf"{_LOCAL}{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}|{_LOCAL}(?:\sdot\s[\w+%-]+)*\sat\s[a-z0-9-]+(?:\sdot\s[a-z0-9-]+)*\sdot\s[a-z]{{2,}}", re.A | re.I
)
PHONE = re.compile(r"(?:[+＋]|(?<![\w+])\(?)\d[\d() ./\-－]{4,}\d(?:,?\s*(?:ext|extension|x|Durchwahl|poste)\.?\s*\d{1,6})?", re.I)


def _shape(u: str) -> str:
    if u.isdigit():
        return f"d{min(len(u), 12)}"
    if u.isalpha():
        if u.isupper():
            return "X" if len(u) == 1 else "XX"
        return "Xx" if u[0].isupper() and u[1:].islower() else "x" if u.islower() else "xX" if u[0].isupper() else "c"
    return "p"


_FUNCTION = frozenset(FUNCTION.split())
_CLASSES: dict[str, list[str]] = {}
for _name, _words in CLASSES.items():
    for _w in _words.split():
        _CLASSES.setdefault(_w, []).append(_name)


@lru_cache(maxsize=1)
def _common() -> frozenset[bytes]:
    """The pieces of a public vocabulary of many languages; its path is a parameter. Without the file all words are alike."""
    path = os.environ.get("TRACEWRIGHT_MULTI_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    pieces: set[bytes] = set()
    for p in (path, VOCABULARY):
        if os.path.exists(p):
            with open(p, "rb") as f:
                pieces.update(base64.b64decode(line.split()[0]) for line in f)
    return frozenset(pieces)


def word_level(w: str) -> str:
    """How common a word is: one piece of the vocabularies in small letters, only with a capital, or neither."""
    low = w.lower()
    return "low" if (" " + low).encode() in _common() else "cap" if (" " + low.capitalize()).encode() in _common() else "rare"


def unit_features(u: str) -> list[str]:
    """Features of one unit: the gap before it, its shape and edges, and its closed class or, for function words, the word."""
    w = u.lstrip()
    gap = LINE_MARK if "\n" in u else SPACE_MARK if len(w) < len(u) else "-"
    if not w:
        return []
    if re.match(f"[{_CJK}]", w):
        out = ["s=cjk", "g=" + gap]
        if w in ZH_KEPT or w in ZH_PLACE:
            out.append("w=" + w)
        return out + ["k=family"] if w in ZH_FAMILY else out
    shape, low = _shape(w), w.lower()
    out = ["s=" + shape, "g=" + gap, f"sg={shape}{gap}"]
    if not w[0].isalpha():
        return out if w.isdigit() else [*out, "w=" + low, "c=" + unicodedata.category(w[0])]
    kinds = _CLASSES.get(low, ())
    for k in kinds:
        out += ["k=" + k, f"ks={k}{shape}", f"kg={k}{gap}"]
    if low in _FUNCTION:
        out += ["w=" + low, "k=function", f"ws={low}{shape}"]
    elif not kinds:
        level = word_level(w)
        out += ["v=" + level, f"vs={level}{shape}", "k=open", "e2=" + low[-2:], "b2=" + low[:2], f"n={min(len(w), 9)}", f"se={shape}{low[-2:]}"]
        if len(w) > 4:
            out.append("e3=" + low[-3:])
    return out


def bounds(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of units in their text."""
    ends = np.cumsum([len(u) for u in units])
    return ends - [len(u.lstrip()) for u in units], ends


def segments(norm: str) -> list[tuple[int, int]]:
    """Bounds of the segments of a text."""
    out, at = [], 0
    for m in CUT.finditer(norm):
        if m.end() > at and not _ENDS_SHORT.search(norm, max(at, m.start() - 8), m.start() + 1):
            out.append((at, m.end()))
            at = m.end()
    if at < len(norm):
        out.append((at, len(norm)))
    return out


@lru_cache(maxsize=4)
def train(rows: int = LABELLED_ROWS, seed: int = 17, part: str | None = None) -> Crf:
    """The field, trained from at most ``rows`` labelled texts."""
    crf = Crf(KINDS, unit_features)
    code = {lb: i for i, lb in enumerate(crf.labels)}
    units, gold = [], []
    for text, spans in labelled(rows, seed, part):
        us = TOKEN.findall(text.translate(_DIGITS))
        a, b = bounds(us)
        tags = np.zeros(len(us), np.int64)
        for kind, lo, hi in spans:
            inside = np.flatnonzero((a >= lo) & (b <= hi))
            tags[inside] = code["I-" + kind]
            tags[inside[:1]] = code["B-" + kind]
        units.append(us)
        gold.append(tags.tolist())
    return crf.fit(units, gold)


@lru_cache(maxsize=4)
def _version(rows: int) -> str:
    """A name for what the weights depend on: the labelled table, the word classes, the features and the training."""
    parts = [inspect.getsource(m) for m in (_labels, _words_of, _crf)] + [inspect.getsource(f) for f in (unit_features, word_level, _shape, bounds, train.__wrapped__)] + [TOKEN.pattern, str(rows)]
    return hashlib.sha1("\x00".join(parts).encode()).hexdigest()[:16]


_LOADED: dict[str, Crf] = {}


def trained(spark: SparkSession, rows: int = LABELLED_ROWS) -> Crf:
    """The field of the shared folder; trained and written there (one row of a table) by the first that needs it."""
    name = _version(rows)
    if name in _LOADED:
        return _LOADED[name]
    path = f"{shared_dir(spark).rstrip('/')}/tw-field-{name}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        _LOADED[name] = _loaded(pickle.loads(bytes(spark.read.parquet(path).first()["model"])))
    else:
        crf = _LOADED[name] = train(rows)
        spark.createDataFrame([(bytearray(pickle.dumps(_model(crf))),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return _LOADED[name]


def _model(crf: Crf) -> tuple:
    return crf.ids, crf.w.astype(np.float32), crf.t


def find_in(crf: Crf, norms: list[str]) -> list[list[tuple[str, int, int]]]:
    """Entities of digit-normal segments as ``(kind, start, end)``, fitted to their written forms."""
    toks = [TOKEN.findall(s) for s in norms]
    out: list[list[tuple[str, int, int]]] = [[] for _ in norms]
    for i, tag in enumerate(crf.decode(toks)):
        if tag.any():
            out[i] = _fit(norms[i], _spans(crf.labels, tag, *bounds(toks[i])))
    return out


def _spans(labels: list[str], tag: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    open_: tuple[str, int, int] | None = None
    for i in np.flatnonzero(np.r_[tag != 0]):
        lb = labels[tag[i]]
        kind = lb[2:]
        if open_ and lb[0] == "I" and open_[0] == kind and last == i - 1:
            open_ = (kind, open_[1], int(b[i]))
        else:
            if open_:
                out.append(open_)
            open_ = (kind, int(a[i]), int(b[i]))
        last = i
    if open_:
        out.append(open_)
    return out


def _fit(norm: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Edges moved to the written form that a span overlaps, or stripped of marks; what has no letter or digit of its kind is dropped."""
    mails = [m.span() for m in EMAIL.finditer(norm)] if any(k == "email" for k, _, _ in spans) else []
    out: list[tuple[str, int, int]] = []
    for kind, a, b in spans:
        if kind == "email":
            hits = [(x, y) for x, y in mails if x < b and a < y]
            if hits:
                # addresses in a row may come out as one span: each is one
                out += [(kind, x, y) for x, y in hits[:-1] if not out or out[-1][2] <= x]
                a, b = hits[-1]
        elif kind == "phone":
            hit = next((m.span() for m in PHONE.finditer(norm, max(0, a - 6)) if m.start() < b and a < m.end()), None)
            if hit and hit[0] >= a - 3:
                a, b = min(a, hit[0]), max(b, hit[1])
        edge = "([{<\"'“”‘’|,;:!?。，；：、/\\ \n\t*`"
        while b > a and (norm[b - 1] in edge + ")]}>" and not (kind in ("phone", "address") and norm[b - 1] == ")" and "(" in norm[a:b]) or (norm[b - 1] == "." and kind != "name")):
            b -= 1
        lead = edge.replace("(", "") if kind == "phone" else edge
        while a < b and norm[a] in lead + ".)]}>":
            a += 1
        if norm[a:b].startswith("(") and ")" not in norm[a:b]:
            a += 1
        part = norm[a:b]
        digits = sum(c.isdigit() for c in part)
        fits = {"email": bool(re.search(r"[@＠]|\bat\b", part, re.I)), "phone": digits >= 6, "id_number": digits >= 3, "address": any(c.isalpha() for c in part), "name": any(c.isalpha() for c in part) and not digits}
        if fits[kind]:
            if out and out[-1][2] > a and out[-1][0] == kind:
                out[-1] = (kind, out[-1][1], max(b, out[-1][2]))
            elif not out or out[-1][2] <= a:
                out.append((kind, a, b))
    return out


class Finder:
    """Finds entities in texts; distinct segments are decoded once per batch and remembered within a bound."""

    KEEP = 300_000

    def __init__(self, crf: Crf):
        self.crf, self.known = crf, {}

    def __call__(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        cut, new = [], {}
        if len(self.known) > self.KEEP:
            self.known.clear()
        for text in texts:
            norm = (text or "").translate(_DIGITS)
            own = [(a, norm[a:b]) for a, b in segments(norm)]
            cut.append(own)
            for _, s in own:
                if s not in self.known:
                    new[s] = None
        fresh = list(new)
        for s, got in zip(fresh, find_in(self.crf, fresh), strict=True):
            self.known[s] = tuple(got)
        return [[(k, at + a, at + b) for at, s in own for k, a, b in self.known[s]] for own in cut]


def find_pii(df: DataFrame, id_col: str, text_col: str, rows: int = LABELLED_ROWS) -> DataFrame:
    """``(id, kind, start_pos, end_pos)`` of every occurrence, in code points from 0, end exclusive.

    Null and empty texts give none; texts of any length are read whole; repeated rows give their occurrences each; other
    columns are not read. The model comes from the shared folder, where the first call
    writes it after training from the bounded labelled table.
    """
    model = _model(trained(df.sparkSession, rows))
    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text") != "")
    kind = kept.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(_loaded(model))
        for pdf in batches:
            got = finder(pdf["text"].tolist())
            flat = [(i, *e) for i, es in zip(pdf["id"], got, strict=True) for e in es]
            yield pd.DataFrame(flat, columns=["id", "kind", "start_pos", "end_pos"])

    return kept.mapInPandas(find, f"id {kind}, kind string, start_pos int, end_pos int").withColumnRenamed("id", id_col)


def _loaded(model: tuple) -> Crf:
    crf = Crf(KINDS, unit_features)
    crf.ids, crf.w, crf.t = model
    return crf


def mask_text(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its placeholder, all else unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def mask_pii(df: DataFrame, id_col: str, text_col: str, rows: int = LABELLED_ROWS) -> DataFrame:
    """``(id, text, found)``: every text with typed placeholders, and how many were put in. Null stays null."""
    model = _model(trained(df.sparkSession, rows))
    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(_loaded(model))
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            got = finder(texts)
            yield pd.DataFrame({"id": pdf["id"], "text": [mask_text(t, s) for t, s in zip(texts, got, strict=True)], "found": [len(s) for s in got]})

    return kept.mapInPandas(mask, f"id {kind}, text string, found int").withColumnsRenamed({"id": id_col, "text": text_col})
