"""Answer extraction, normal forms and scores as native column expressions. Null inputs score 0 unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NUMBER = r"(\-?[0-9\.\,]+)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def gsm8k_answer(text: Column, flexible: bool = False) -> Column:
    """The number after ``####`` without commas, or (flexible) the last number that is not empty or a full stop; null if there is none."""
    if not flexible:
        return F.translate(F.nullif(F.regexp_extract(text, r"#### (\-?[0-9\.\,]+)", 1), F.lit("")), ",$", "")
    found = F.regexp_extract_all(text, F.lit(_NUMBER), 1)
    good = F.filter(found, lambda x: ~x.isin("", "."))
    # where only full stops are found, the first of them is what a backward search ends on
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.get(found, F.lit(0)))


def gsm8k_score(text: Column, truth: Column, flexible: bool = False, score: float = 1.0, format_score: float = 0.0) -> Column:
    a = gsm8k_answer(text, flexible)
    return F.when(a.isNull(), 0.0).when(a == truth, score).otherwise(format_score)


def qa_normal(text: Column) -> Column:
    """Lower case, ASCII punctuation off, articles off, white space squeezed."""
    y = F.translate(F.lower(text), PUNCTUATION, "")
    # words and white space as Python has them: marks are no part of a word, the separators 1C to 1F are white space
    y = F.regexp_replace(y, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    return F.trim(F.regexp_replace(y, r"(?U)[\s\x1c-\x1f]+", " "))


def last_answer_tag(text: Column) -> Column:
    """The content of the last ``<answer>`` element, trimmed; null if there is none."""
    return F.regexp_replace(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), 1), F.lit(-1)), r"(?U)^\s+|\s+$", "")


def _count(text: Column, what: str) -> Column:
    return F.size(F.split(text, what)) - 1


def qa_em_score(text: Column, targets: Column, score: float = 1.0, format_score: float = 0.0) -> Column:
    """Exact match of the last answer with any target after normalising; a quarter of the score for more than ten tags."""
    a = last_answer_tag(text)
    hit = F.exists(targets, lambda t: qa_normal(t) == qa_normal(a))
    many = (_count(text, "<answer>") > 10) | (_count(text, "</answer>") > 10)
    return F.when(a.isNull(), 0.0).when(hit, F.when(many, score / 4).otherwise(score)).otherwise(format_score)


def qa_sub_em_score(text: Column, targets: Column, score: float = 1.0, format_score: float = 0.0) -> Column:
    """As exact match, but a target need only occur in the answer."""
    a = last_answer_tag(text)
    return F.when(a.isNull(), 0.0).when(F.exists(targets, lambda t: F.contains(qa_normal(a), qa_normal(t))), score).otherwise(format_score)


def mcq_score(content: Column, answer: Column) -> Column:
    """1 if the answer's first character and the content are the same letter."""
    return F.when(F.coalesce(answer, F.lit("")) == "", 0.0).when(F.upper(F.trim(content)) == F.upper(F.trim(F.substring(answer, 1, 1))), 1.0).otherwise(0.0)


def first_number(text: Column) -> Column:
    """The first signed decimal number of a text; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"([+-]?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def num_score(pred: Column, truth: Column) -> Column:
    """1 if both first numbers are equal at two decimals (halves to even)."""
    p, t = first_number(pred), first_number(truth)
    return F.when(F.bround(p, 2) == F.bround(t, 2), 1.0).otherwise(0.0)


def mean_relative_accuracy(pred: Column, truth: Column) -> Column:
    """Share of the ten thresholds .50 to .95 that the relative error stays under, in single precision."""
    p, t = pred.cast("float"), truth.cast("float")
    err = (F.abs(p - t) / (F.abs(t) + F.lit(1e-8).cast("float"))).cast("float")
    ths = [F.lit(0.5 + 0.05 * i).cast("float") for i in range(10)]
    hits = sum((F.when(err < (F.lit(1.0).cast("float") - th).cast("float"), 1.0).otherwise(0.0) for th in ths), F.lit(0.0))
    return hits / 10


def size_score(pred: Column, truth: Column) -> Column:
    return mean_relative_accuracy(first_number(pred), first_number(truth))


def format_blend(reward: Column) -> Column:
    return 0.1 + 0.9 * reward


def _one_value(text: Column) -> Column:
    """Whether a text that begins with a JSON value has nothing after it: a parser stops at the value's end."""
    # what follows would have to fit before a closing bracket as well as before a closing brace
    return (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1) & (F.size(F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))) == 1)


def parse_spans(text: Column) -> Column:
    """Spans of a JSON list of pairs, a flat pair, or a list of objects with start and end; null if the whole text is none of these."""
    pairs = F.from_json(text, "array<array<double>>", {"mode": "PERMISSIVE"})
    objs = F.from_json(text, "array<struct<start:double,end:double>>", {"allowSingleQuotes": "false"})
    flat = F.from_json(text, "array<double>")
    ok_pairs = (F.size(pairs) >= 0) & F.forall(pairs, lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull()))
    ok_objs = F.forall(objs, lambda o: o["start"].isNotNull() & o["end"].isNotNull())
    ok_flat = (F.size(flat) == 2) & F.forall(flat, lambda v: v.isNotNull())
    return (
        F.when(text.rlike(r"^\s*\[\s*\]\s*$"), F.expr("CAST(array() AS ARRAY<STRUCT<s: DOUBLE, e: DOUBLE>>)"))
        .when(text.rlike(r"^\s*\[\s*\{") & ok_objs & _one_value(text), F.transform(objs, lambda o: F.struct(o["start"].alias("s"), o["end"].alias("e"))))
        .when(text.rlike(r"^\s*\[\s*\[") & ok_pairs & _one_value(text), F.transform(pairs, lambda p: F.struct(F.get(p, 0).alias("s"), F.get(p, 1).alias("e"))))
        .when(text.rlike(r"^\s*\[\s*[-0-9]") & ok_flat & _one_value(text), F.array(F.struct(F.get(flat, 0).alias("s"), F.get(flat, 1).alias("e"))))
    )


def length_bonus(avg_tokens: Column, beta: float = 0.007, most: float = 2.01375) -> Column:
    return F.lit(most) * F.exp(-beta * F.greatest(avg_tokens + 1.0, F.lit(100.0)))


def overlong_penalty(length: Column, limit: int, buffer: int, factor: float = 1.0) -> Column:
    """0 up to ``limit - buffer`` tokens, then falling linearly."""
    return F.least(-(length - (limit - buffer)) / buffer * factor, F.lit(0.0))


def step_limit(duration: Column, base: int, max_clip: float, most: int) -> Column:
    """The smaller of ``base`` plus whole clips in the duration, and ``most``."""
    return F.least(F.lit(base) + F.floor(duration / max_clip), F.lit(most)).cast("int")


def frame_times(start: Column, end: Column, n: Column) -> Column:
    """``n`` evenly spaced times from start to end; one frame is at the start; under one frame none."""
    seq = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + i * (end - start) / (n - 1)))
    return F.when(n == 1, F.array(start)).when(n > 1, seq).otherwise(F.expr("CAST(array() AS ARRAY<DOUBLE>)"))


def frame_count(duration: Column, fps: float, least: int, most: int, factor: int = 2) -> Column:
    """Frames at ``fps``, clamped to bounds on the factor's grid and cut to a multiple of it."""
    up, down = -(-least // factor) * factor, most // factor * factor
    n = F.least(F.greatest(duration * fps, F.lit(float(up))), F.lit(float(down)))
    return (F.floor(n / factor) * factor).cast("int")


def smart_resize(h: Column, w: Column, factor: int = 28, least: int = 3136, most: int = 12845056) -> Column:
    """``STRUCT<h, w>``: sides on the factor's grid with the area within bounds (halves to even)."""
    hb, wb = F.greatest(F.lit(factor), F.rint(h / factor) * factor), F.greatest(F.lit(factor), F.rint(w / factor) * factor)
    shrink, grow = F.sqrt(h * w / most), F.sqrt(F.lit(least) / (h * w))
    big, small = hb * wb > most, hb * wb < least
    side = lambda x, b: F.when(big, F.greatest(F.lit(factor), F.floor(x / shrink / factor) * factor)).when(small, F.ceil(x * grow / factor) * factor).otherwise(b).cast("int")
    return F.struct(side(h, hb).alias("h"), side(w, wb).alias("w"))


def range_error(kind: Column, start: Column, end: Column, num: Column, duration: Column, has_audio: Column, fps: Column, max_frames: int = 64, min_audio: float = 1.0, max_audio: float = 300.0, max_clip: float = 300.0) -> Column:
    """The first range check that an action fails, as its error code; null if it passes. The order of the checks matters."""
    length = end - start
    frames = F.when((start < 0) | (end > duration), "FRAME_TS_OOB").when(end < start, "CLIP_NEG_LEN").when(num > max_frames, "TOO_MANY_FRAMES").when(num < 1, "INVALID_FRAME_NUM")
    audio = F.when(~has_audio, "NO_AUDIO").when((start < 0) | (end > duration), "AUDIO_RANGE").when(length <= 0, "CLIP_NEG_LEN").when(length < min_audio, "AUDIO_TOO_SHORT").when(length > max_audio, "AUDIO_TOO_LONG")
    clip = F.when((start < 0) | (end > duration), "CLIP_RANGE").when(end <= start, "CLIP_NEG_LEN").when(length > max_clip, "CLIP_TOO_LONG").when((fps >= 2) & (length * fps < 3.999), "CLIP_TOO_SHORT")
    return F.when(kind == "get_frames", frames).when(kind == "get_audio", audio).when(kind == "get_clip", clip)


def url_to_oss(x: Column) -> Column:
    """``https://bucket.oss-region.aliyuncs.com/key?..`` as ``oss://bucket/key``; anything else unchanged."""
    return F.regexp_replace(x, r"https?://([^./\s]+)\.oss-[^/\s]*\.aliyuncs\.com/([^?#\s]+)(?:[?#]\S*)?", "oss://$1/$2")


def local_media_path(x: Column, base: str = "") -> Column:
    """The path from ``agentic_tmp/`` on, cut at query, fragment or blank, in place of the whole text; other texts unchanged."""
    got = F.regexp_extract(x, r"(agentic_tmp/[^?#\s]+)", 1)
    return F.when(got != "", F.concat(F.lit(base), got)).otherwise(x)


def single_frame_text(x: Column) -> Column:
    """``Frames a-b (num=1)`` as ``Frame a-b (num=1)``."""
    return F.regexp_replace(x, r"Frames (\S+ ?\(num=1\))", "Frame $1")


def question_type_alias(x: Column) -> Column:
    """Known aliases of question types as their short names, others in upper case."""
    k = F.lower(F.regexp_replace(F.trim(x), r"[\s_-]+", "-"))
    # fixed values: the aliases
    return (
        F.when(k.isin("multiple-choice", "mcq", "choice"), "MCQ").when(k.isin("temporal-grounding", "temporal-reasoning", "tr", "temporal"), "TR")
        .when(k.isin("free-form", "ff", "open-ended"), "FF").when(k.isin("numeric", "num", "number"), "NUM").when(k.isin("size", "size-estimation"), "SIZE").otherwise(F.upper(F.trim(x)))
    )


def type_prefix(x: Column) -> Column:
    """The upper-cased part before the first underscore."""
    return F.upper(F.split_part(x, F.lit("_"), F.lit(1)))


def capitalize(x: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))


def question_id(index: Column, video: Column, question: Column) -> Column:
    """The index; else video and question; else the video; blank videos give an empty id."""
    v, q = F.coalesce(video, F.lit("")), F.coalesce(question, F.lit(""))
    return F.coalesce(index.cast("string"), F.when(v == "", "").when(q != "", F.concat(v, F.lit("||"), q)).otherwise(v))


def resume_key(video: Column, question: Column) -> Column:
    return F.md5(F.concat(F.coalesce(video, F.lit("None")), F.lit("_"), F.coalesce(question, F.lit("None"))))


def retrieval_text(docs: Column) -> Column:
    """``Doc i (Title: t) text`` lines of an ``ARRAY<STRUCT<title, text>>``."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), d["title"], F.lit(") "), d["text"])), "\n")


def judge_score(response: Column) -> Column:
    """The number behind ``score`` in a judge's reply, clamped to [0, 1]; 0 for replies of 1000 characters or more, or without one."""
    got = F.nullif(F.regexp_extract(response, r"(?i)\"?score\"?\s*[:=]\s*\"?(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")
    return F.when(F.length(response) >= 1000, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(got, F.lit(0.0)))))


def media_split(x: Column) -> Column:
    """A text with ``<image>``, ``<video>`` and ``<audio>`` placeholders as typed parts in order."""
    parts = F.filter(F.regexp_extract_all(x, F.lit(r"(?s)(<image>|<video>|<audio>|(?:(?!<image>|<video>|<audio>).)+)"), 1), lambda p: p != "")
    return F.transform(parts, lambda p: F.when(p.isin("<image>", "<video>", "<audio>"), F.struct(F.regexp_replace(p, "[<>]", "").alias("type"), F.lit(None).cast("string").alias("text"))).otherwise(F.struct(F.lit("text").alias("type"), p.alias("text"))))


def transcript(chat: Column) -> Column:
    """``[ROLE]: text`` lines of an ``ARRAY<STRUCT<role, content>>``."""
    return F.array_join(F.transform(chat, lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]: "), F.coalesce(m["content"], F.lit("")))), "\n")


def with_notice(chat: Column, notice: Column) -> Column:
    """The chat without earlier ``[NOTICE]`` messages and with one new one at the end."""
    old = F.filter(chat, lambda m: ~F.startswith(F.coalesce(m["content"], F.lit("")), F.lit("[NOTICE]")))
    return F.concat(old, F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("[NOTICE] "), notice).alias("content"))))


def pad_to(x: Column, n: int, pad: Column, left: bool = False) -> Column:
    """An array padded to length ``n``; longer ones unchanged."""
    more = F.array_repeat(pad, F.greatest(F.lit(0), n - F.size(x)))
    return F.concat(more, x) if left else F.concat(x, more)


def truncate(x: Column, n: int, how: str = "right") -> Column:
    """At most ``n`` items: ``right`` keeps the first, ``left`` the last, ``error`` raises."""
    if how == "right":
        return F.slice(x, 1, n)
    if how == "left":
        return F.when(F.size(x) > n, F.slice(x, -n, n)).otherwise(x)
    if how == "error":
        return F.when(F.size(x) > n, F.raise_error(F.lit(f"longer than {n}")).cast("array<int>")).otherwise(x)
    raise ValueError(how)


def eos_mask(ids: Column, eos: list[int]) -> Column:
    """1 up to and with the first end token, 0 after it; all 1 if there is none."""
    at = F.filter(F.transform(ids, lambda x, i: F.when(x.isin(eos), i)), lambda i: i.isNotNull())
    first = F.get(at, F.lit(0))
    return F.transform(ids, lambda x, i: F.when(first.isNull() | (i <= first), 1).otherwise(0))


def sft_loss_mask(prompt: Column, response: Column) -> Column:
    """0 for the prompt but its last token, 1 for the response, 0 for the final token."""
    n = F.size(prompt) + F.size(response)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.when((i >= F.size(prompt)) & (i < n), 1).otherwise(0))


def assistant_mask(messages: Column) -> Column:
    """Token mask over a chat ``ARRAY<STRUCT<role, n_tokens>>``: 1 over assistant messages."""
    return F.flatten(F.transform(messages, lambda m: F.array_repeat(F.when(m["role"] == "assistant", 1).otherwise(0), m["n_tokens"])))


def tail_mask(attention: Column, n: int) -> Column:
    return F.slice(attention, -n, n)


def place_at_last(score: Column, mask: Column) -> Column:
    """The score at the last valid token, 0 elsewhere; all 0 for an empty mask."""
    last = F.array_position(F.reverse(mask), 1)
    at = F.size(mask) - last
    return F.transform(mask, lambda m, i: F.when((last > 0) & (i == at), score).otherwise(F.lit(0.0)))


def flops(lengths_sum: Column, lengths_sq: Column, hidden: int, layers: int, vocab: int, kv_heads: int, heads: int, ffn: int) -> Column:
    """Training FLOPs of a dense decoder: six per weight and token plus attention over squared lengths (both directions)."""
    head = hidden // heads
    weights = layers * (hidden * (heads + 2 * kv_heads) * head + heads * head * hidden + 3 * hidden * ffn) + 2 * vocab * hidden
    return 6.0 * weights * lengths_sum + 12.0 * lengths_sq * head * heads * layers


SCORERS: dict[str, Callable[..., Column]] = {}


def register_scorer(source: str, fn: Callable[..., Column]) -> None:
    """A scorer for a data source; another one under a taken name is an error."""
    if source in SCORERS and SCORERS[source] is not fn:
        raise ValueError(f"a scorer for {source!r} is already registered")
    SCORERS[source] = fn


def dispatch(source: Column, text: Column, truth: Column) -> Column:
    """The score by data source; an unknown source is an error."""
    out = None
    for name, fn in SCORERS.items():
        case = fn(text, truth)
        out = F.when(source == name, case) if out is None else out.when(source == name, case)
    fail = F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(source, F.lit("null")))).cast("double")
    return fail if out is None else out.otherwise(fail)


register_scorer("openai/gsm8k", gsm8k_score)
register_scorer("mcq", mcq_score)
register_scorer("num", num_score)
register_scorer("size", size_score)
