"""Same or near-same records across splits.

A pair can only be near if recording and numbers are equal, so rows are keyed by both and rows of the same key and question are
one class. Training classes of keys without an evaluation sample are dropped first. Evaluation classes are cut into shards; each gets two
full-text indexes, one over words and one over characters, in which a symbol belongs to one key, so that matches never leave it.
Training classes stream through backward search; their located matches are counted per pair, and the counts rule out every pair
that cannot be near (by bounds that follow from the rule, so none is lost). What is left is compared exactly, and the matches of
near pairs are put together into maximal ones, whose spans are merged. Joins bring the copies of both classes back.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.fmindex import FmIndex
from tracewright.llm.groups import attach
from tracewright.llm.text import folded, recording_key
from tracewright.session import materialize

EVAL_CLASSES = 2000
TRAIN_CLASSES = 10_000
PIECE = 4
SIMILARITY = 0.68
SURE = 0.85
SHARED_WORDS = 0.8
_WORD = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def words(text: str) -> list[str]:
    """Lower-case words and numbers; scripts without blanks give a word per character."""
    found = _WORD.findall(text.lower())
    return [c for w in found for c in (w if _CJK.search(w) else [w])]


def numbers(ws: list[str]) -> list[str]:
    """The numbers among words, by value, in sorted order."""
    return sorted((w.replace(",", "").lstrip("0").rstrip("0").rstrip(".") if "." in w else w.replace(",", "").lstrip("0")) or "0" for w in ws if w[0].isdigit())


def similarity(a: str, b: str) -> float:
    """1 minus edit distance over the longer length, by bit-parallel dynamic programming on whole texts."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return 0.0
    eq: dict[str, int] = {}
    for i, c in enumerate(a):
        eq[c] = eq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in b:
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return 1.0 - score / len(b)


def _apart(a: str, b: str) -> int:
    """A lower bound of the edit distance: characters that one text has and the other has not."""
    x, y = Counter(a), Counter(b)
    return max((x - y).total(), (y - x).total())


def near(a: list[str], b: list[str], threshold: float = SIMILARITY) -> float | None:
    """The similarity of two word lists that are near copies, else None.

    Near copies have the same numbers, and an edit similarity of at least ``SURE``, or of at least ``threshold`` with
    ``SHARED_WORDS`` of the distinct words of the one that has fewer: added words lower the similarity, other contents the share.
    """
    ta, tb = " ".join(a), " ".join(b)
    if ta == tb:
        return 1.0 if ta else None
    if min(len(ta), len(tb)) < threshold * max(len(ta), len(tb)) or numbers(a) != numbers(b):
        return None
    sa, sb = set(a), set(b)
    shared = len(sa & sb) / max(1, min(len(sa), len(sb)))
    if shared < SHARED_WORDS and (min(len(ta), len(tb)) < SURE * max(len(ta), len(tb)) or _apart(ta, tb) > (1 - SURE) * max(len(ta), len(tb)) + 1e-6):
        return None
    s = similarity(ta, tb)
    return s if s >= SURE or (s >= threshold and shared >= SHARED_WORDS) else None


def _by_query(q_of: np.ndarray, n: np.ndarray, most: int = 1 << 21) -> Iterator[np.ndarray]:
    """Rows of matches, sorted by query, in parts of about ``most`` occurrences that do not cut a query."""
    if not len(q_of):
        return
    part = (np.cumsum(n) - 1) // most
    new = np.r_[True, q_of[1:] != q_of[:-1]]
    part = np.maximum.accumulate(np.where(new, part, 0))
    yield from np.split(np.arange(len(q_of)), np.flatnonzero(np.diff(part)) + 1)


def _counts(index: FmIndex, q_of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(query, document, number of its matches in the document)``; a match that occurs there several times counts once."""
    for part in _by_query(q_of, hi - lo):
        which, at = index.locate(lo[part], hi[part])
        doc = index.docs[at].astype(np.int64)
        once = np.unique(which * (1 << 32) + doc)
        pair, got = np.unique(q_of[part][once >> 32] * (1 << 32) + (once & 0xFFFFFFFF), return_counts=True)
        yield pair >> 32, pair & 0xFFFFFFFF, got


def _characters(keys: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``(key, character)`` of all texts one after another, and the lengths of the texts."""
    size = np.array([len(x) for x in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (np.repeat(np.array(keys, np.int64), size) << 21) + code, size


def _pieces(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces without overlap of every text, as ``(query, end, length)``, and how many there are of each text.

    An edit spoils one piece at most, and a near copy is at most ``edits`` away, so pieces are the longest of up to
    ``PIECE`` characters that are more than that.
    """
    longest = np.floor(size / SURE + 1e-6)
    edits = np.floor((1 - SURE) * longest + 1e-6).astype(np.int64)
    length = np.ones(len(size), np.int64)
    for k in range(2, PIECE + 1):
        length = np.where(size // k > edits, k, length)
    n = size // length
    query = np.repeat(np.arange(len(size)), n)
    at = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
    return query, first[query] + (at + 1) * length[query] - 1, length[query], n


def _histograms(texts: list[str], width: int = 64) -> np.ndarray:
    """Characters of each text counted in ``width`` classes."""
    size = np.array([len(x) for x in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % width
    return np.bincount(np.repeat(np.arange(len(texts)), size) * width + code, minlength=len(texts) * width).reshape(len(texts), width).astype(np.int32)


def near_classes(ev: list[tuple[str, str]], tr: list[tuple[str, str]], threshold: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """Near pairs of two lists of ``(key, text)``: ``(number in ev, number in tr, words, longest, similarity)``.

    Keys stand for recording and numbers; texts are words with single blanks. The pairs are those of equal key for which :func:`near` has a
    similarity: none is lost. ``words`` are the words of the training text that maximal matches cover, ``longest`` those of the longest one.
    """
    key_of: dict[str, int] = {}
    for k, _ in ev:
        key_of.setdefault(k, len(key_of))
    back = [i for i, (k, text) in enumerate(tr) if k in key_of and text]
    if not back or not any(text for _, text in ev):
        return []
    e_key, t_key = [key_of[k] for k, _ in ev], [key_of[tr[i][0]] for i in back]
    e_text, t_text = [x for _, x in ev], [tr[i][1] for i in back]
    e_len, t_len = (np.array([len(x) for x in side], np.int64) for side in (e_text, t_text))
    # words: a symbol is a word of one key
    symbol: dict[tuple[int, str], int] = {}
    e_words = [np.array([symbol.setdefault((k, w), len(symbol) + 1) for w in x.split(" ") if w], np.int64) for k, x in zip(e_key, e_text, strict=True)]
    by_word = FmIndex(e_words)
    t_words = [[symbol.get((k, w), 0) for w in x.split(" ")] for k, x in zip(t_key, t_text, strict=True)]
    e_distinct, t_distinct = (np.array([len(set(x.split(" "))) for x in side], np.int64) for side in (e_text, t_text))
    w_size = np.array([len(x) for x in t_words], np.int64)
    w_flat, w_query = np.array([w for x in t_words for w in x], np.int64), np.repeat(np.arange(len(back)), w_size)
    once = np.unique(w_query * (len(symbol) + 1) + w_flat, return_index=True)[1]
    once = np.sort(once[w_flat[once] > 0])
    end, lo, hi = by_word.search(w_flat, once, np.ones(len(once), np.int64))
    pairs: list[np.ndarray] = []
    for q, d, got in _counts(by_word, w_query[end], lo, hi):
        long, short = np.maximum(e_len[d], t_len[q]), np.minimum(e_len[d], t_len[q])
        keep = (got >= SHARED_WORDS * np.minimum(e_distinct[d], t_distinct[q]) - 1e-9) & (short >= threshold * long - 1e-6)
        pairs.append(np.c_[q[keep], d[keep], np.floor((1 - threshold) * long[keep] + 1e-6)].astype(np.int64))
    # characters: pieces of the training texts
    e_chars, _ = _characters(e_key, e_text)
    alphabet = np.unique(e_chars)
    bounds = np.r_[0, np.cumsum(e_len)]
    e_syms = np.searchsorted(alphabet, e_chars) + 1
    by_char = FmIndex([e_syms[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    t_chars, _ = _characters(t_key, t_text)
    place = np.minimum(np.searchsorted(alphabet, t_chars), len(alphabet) - 1)
    t_syms = np.where(alphabet[place] == t_chars, place + 1, 0)
    query, end, length, pieces = _pieces(np.cumsum(t_len) - t_len, t_len)
    owner = np.zeros(int(t_len.sum()), np.int64)
    owner[end] = query
    end, lo, hi = by_char.search(t_syms, end, length)
    for q, d, got in _counts(by_char, owner[end], lo, hi):
        long, short = np.maximum(e_len[d], t_len[q]), np.minimum(e_len[d], t_len[q])
        edits = np.floor((1 - SURE) * long + 1e-6).astype(np.int64)
        keep = (short >= SURE * long - 1e-6) & (got >= pieces[q] - edits)
        pairs.append(np.c_[q[keep], d[keep], edits[keep]])
    cand = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
    # what has more characters of its own than edits are allowed is no pair
    e_hist, t_hist = _histograms(e_text), _histograms(t_text)
    found: dict[tuple[int, int], float] = {}
    e_split: dict[int, list[str]] = {}
    for at in range(0, len(cand), 1 << 16):
        q, d, edits = cand[at : at + (1 << 16)].T
        gap = t_hist[q] - e_hist[d]
        own = np.maximum(np.maximum(gap, 0).sum(1), np.maximum(-gap, 0).sum(1))
        for i, j in zip(q[own <= edits].tolist(), d[own <= edits].tolist(), strict=True):
            if (i, j) not in found:
                s = near(e_split.setdefault(j, e_text[j].split(" ")), t_text[i].split(" "), threshold)
                if s is not None:
                    found[i, j] = s
    if not found:
        return []
    merged = _maximal(by_word, w_flat, w_query, w_size, set(found))
    return [(j, back[i], *merged.get((i, j), (0, 0)), s) for (i, j), s in found.items()]


def _maximal(index: FmIndex, words_: np.ndarray, query: np.ndarray, size: np.ndarray, pairs: set[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """``(words covered, words of the longest)`` of the maximal matches of each pair: matches on one diagonal without a gap are one."""
    first = np.cumsum(size) - size
    wanted = np.zeros(len(size), bool)
    wanted[[i for i, _ in pairs]] = True
    end = np.flatnonzero(wanted[query] & (words_ > 0))
    end, lo, hi = index.search(words_, end, np.ones(len(end), np.int64))
    known = np.array(sorted((i << 32) + j for i, j in pairs), np.int64)
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for part in _by_query(query[end], hi - lo):
        which, at = index.locate(lo[part], hi[part])
        q = query[end[part]][which]
        pair = (q << 32) + index.docs[at]
        keep = known[np.minimum(np.searchsorted(known, pair), len(known) - 1)] == pair
        pair, pos, place = pair[keep], (end[part][which] - first[q])[keep], index.places[at][keep].astype(np.int64)
        order = np.lexsort((pos, place - pos, pair))
        p, x, y = pair[order], pos[order], (place - pos)[order]
        start = np.r_[True, (p[1:] != p[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)]
        run = np.bincount(np.cumsum(start) - 1)
        best = pd.Series(run).groupby(p[start]).max()
        cover = pd.DataFrame({"p": p, "x": x}).drop_duplicates().groupby("p").size()
        for k, longest in best.items():
            out[int(k >> 32), int(k & 0xFFFFFFFF)] = (int(cover[k]), int(longest))
    return out


def find_overlaps(ev: pd.DataFrame, tr: pd.DataFrame, threshold: float = SIMILARITY) -> pd.DataFrame:
    """Near-same pairs of two frames ``(eval_id, split, rec, q)`` and ``(row_id, source, rec, q)`` on one machine."""
    classes: list[dict[tuple[str, str], int]] = [{}, {}]
    ids = []
    for side, pdf in enumerate((ev, tr)):
        out = []
        for rec, q in zip(pdf["rec"], pdf["q"], strict=True):
            ws = words(q)
            out.append(classes[side].setdefault((f"{rec}\x01{' '.join(numbers(ws))}", " ".join(ws)), len(classes[side])))
        ids.append(np.array(out, np.int64))
    hit = pd.DataFrame(near_classes(list(classes[0]), list(classes[1]), threshold), columns=["e", "t", "words", "longest", "similarity"])
    left = pd.DataFrame({"e": ids[0], "eval_id": ev["eval_id"].to_numpy(), "split": ev["split"].to_numpy()})
    right = pd.DataFrame({"t": ids[1], "row_id": tr["row_id"].to_numpy(), "source": tr["source"].to_numpy()})
    return hit.astype({"e": np.int64, "t": np.int64}).merge(left, on="e").merge(right, on="t")[["eval_id", "row_id", "split", "source", "words", "longest", "similarity"]]


def question_text(x: Column) -> Column:
    """The words of a question with single blanks, as :func:`words` gives them."""
    cjk = "\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af"
    return F.array_join(F.regexp_extract_all(folded(x), F.lit(rf"\p{{Nd}}+(?:[.,]\p{{Nd}}+)*|[{cjk}]|[\p{{L}}&&[^{cjk}]]+"), F.lit(0)), " ")


def question_numbers(text: Column) -> Column:
    """The numbers of such a text by value, sorted."""
    def plain(x: Column) -> Column:
        y = F.regexp_replace(F.regexp_replace(x, ",", ""), r"^0+(?=\d)", "")
        return F.regexp_replace(F.when(y.contains("."), F.regexp_replace(y, r"0+$", "")).otherwise(y), r"\.$", "")

    return F.array_join(F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(r"(?<![^ ])\p{Nd}[\p{Nd}.,]*"), F.lit(0)), plain)), " ")


def _keyed(df: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """Rows with a key (recording and numbers), the words of the question and two hashes that stand for both."""
    rows = df.select(*(c.alias(n) for n, c in keep.items()), recording_key(F.col("video")).alias("rec"), question_text(F.col("question")).alias("text"))
    rows = rows.withColumn("key", F.concat_ws("\x01", "rec", question_numbers(F.col("text"))))
    # keys are made once and kept: classes, sizes and the copies all read them again
    rows = materialize(rows.select(*keep, F.when(F.col("rec").isNotNull() & (F.col("text") != ""), F.col("key")).alias("key"), "text"), "keys").where("key IS NOT NULL")
    return rows.withColumns({"h1": F.xxhash64("key", "text", F.lit(1)), "h2": F.xxhash64("key", "text", F.lit(2))})


def overlap_classes(ev: DataFrame, tr: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Near pairs of question classes, each once: hashes of both, ``words``, ``longest``, ``similarity`` and the copies on both sides.

    A task gets at most ``EVAL_CLASSES`` by ``TRAIN_CLASSES`` classes of one key; keys with more are cut into blocks of classes that meet
    each other once. Smaller keys share shards of about that size, counted on both sides.
    """
    cls = ["key", "text", "h1", "h2"]
    e_cls = materialize(ev.groupBy(*cls).agg(F.count(F.lit(1)).alias("copies")), "classes")
    e_n = e_cls.groupBy("key").agg(F.count(F.lit(1)).alias("n_e"))
    t_cls = materialize(tr.join(e_n.select("key"), "key", "left_semi").groupBy(*cls).agg(F.count(F.lit(1)).alias("copies")), "classes")
    sizes = materialize(t_cls.groupBy("key").agg(F.count(F.lit(1)).alias("n_t")).join(e_n, "key"), "sizes")
    n_e, n_t = sizes.agg(F.coalesce(F.sum("n_e"), F.lit(0)), F.coalesce(F.sum("n_t"), F.lit(0))).first()
    shards = max(1, -(-n_e // EVAL_CLASSES), -(-n_t // TRAIN_CLASSES))
    blocks = {"b_e": F.ceil(F.col("n_e") / EVAL_CLASSES).cast("int"), "b_t": F.ceil(F.col("n_t") / TRAIN_CLASSES).cast("int")}
    alone = (F.col("b_e") > 1) | (F.col("b_t") > 1)
    sizes = sizes.withColumns(blocks).withColumn("shard", F.when(alone, -1 - F.abs(F.xxhash64("key").bitwiseAND(F.lit((1 << 62) - 1)))).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards))))
    sides = []
    for rows, total, count, own, own_n, other, other_n in ((e_cls, n_e, "n_e", "blk", "b_e", "salt", "b_t"), (t_cls, n_t, "n_t", "salt", "b_t", "blk", "b_e")):
        x = attach(rows, sizes, ["key"], count, "h2", total)
        x = x.withColumn(own, F.pmod(F.col("h1"), F.col(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
        # a column of its own on each side: the cogroup must tell them apart
        sides.append(x.select((F.col("shard") + F.lit(0)).alias("shard"), "blk", "salt", *cls, "copies"))

    def shard(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got = near_classes(list(zip(left["key"], left["text"], strict=True)), list(zip(right["key"], right["text"], strict=True)), threshold)
        hit = pd.DataFrame(got, columns=["e", "t", "words", "longest", "similarity"]).astype({"e": np.int64, "t": np.int64})
        e, t = left.iloc[hit["e"]].reset_index(drop=True), right.iloc[hit["t"]].reset_index(drop=True)
        return pd.DataFrame({"eh1": e["h1"], "eh2": e["h2"], "h1": t["h1"], "h2": t["h2"], "eval_copies": e["copies"], "copies": t["copies"], "words": hit["words"], "longest": hit["longest"], "similarity": hit["similarity"]})

    by = ["shard", "blk", "salt"]
    schema = "eh1 long, eh2 long, h1 long, h2 long, eval_copies long, copies long, words long, longest long, similarity double"
    return sides[0].groupBy(*by).cogroup(sides[1].groupBy(*by)).applyInPandas(shard, schema)


def cross_split_overlaps(evals: DataFrame, train: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Pairs of an evaluation sample and a training row with the same recording and nearly the same question.

    ``evals`` has ``eval_id, split, video, question``, ``train`` has ``row_id, data_source, video, question``. Returns ``(eval_id, row_id,
    split, source, words, longest, similarity)``: ``words`` is the number of the training question's words that maximal matches cover,
    ``longest`` the words of the longest one, ``similarity`` that of the whole questions. The pairs are exactly those of the rule of :func:`near`.
    Pairs whose numbers differ are no pairs. Rows without recording or question, and questions without a letter or digit, give
    nothing; every copy gives its own pair; empty tables give no rows; other columns are not read.
    """
    ev = _keyed(evals, {"eval_id": F.col("eval_id").cast("long"), "split": F.col("split").cast("string")})
    tr = _keyed(train, {"row_id": F.col("row_id").cast("long"), "source": F.col("data_source").cast("string")})
    pairs = materialize(overlap_classes(ev, tr, threshold), "pairs")
    n = pairs.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum("eval_copies"), F.lit(0))).first()
    rows = attach(tr.select("row_id", "source", "h1", "h2"), pairs, ["h1", "h2"], "copies", "row_id", n[0])
    both = attach(ev.select("eval_id", "split", F.col("h1").alias("eh1"), F.col("h2").alias("eh2")), rows, ["eh1", "eh2"], "eval_copies", "eval_id", n[1])
    return both.select("eval_id", "row_id", "split", "source", "words", "longest", "similarity")
