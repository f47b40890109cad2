"""Dataset preparation: mapped rows with nested prompts, options, tools and tokens. Rows in, rows out; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scoring import capitalize, pad_to, truncate


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def with_tools(df: DataFrame, tool: str, truth: Column, question: Column) -> DataFrame:
    """``extra_info`` extended by the arguments of a tool: ``need_tools_kwargs`` and the nested ``tools_kwargs``."""
    kwargs = F.struct(F.struct(F.struct(truth.alias("ground_truth"), question.alias("question")).alias("create_kwargs")).alias(tool))
    return df.withColumn("extra_info", F.col("extra_info").withField("need_tools_kwargs", F.lit(True)).withField("tools_kwargs", kwargs))


def with_images(df: DataFrame, images: str) -> DataFrame:
    """``images`` as ``ARRAY<STRUCT<bytes, path>>`` of binary columns; null images are an empty array."""
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<bytes: BINARY, path: STRING>>)")
    made = F.transform(images, lambda b: F.struct(b.cast("binary").alias("bytes"), F.lit(None).cast("string").alias("path")))
    return df.withColumn("images", F.coalesce(made, empty))


def bracket_clean(x: Column) -> Column:
    """Trimmed, ``[title]`` as a full stop, other bracketed parts off, double blanks once halved."""
    y = F.replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(y, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def completion_choice(df: DataFrame, row: str = "row_id") -> DataFrame:
    """Rows ``(activity_label, ctx_a, ctx_b, endings, label)`` as prompt, cleaned choices and gold index; unlabelled rows are left out."""
    text = bracket_clean(F.concat(F.col("activity_label"), F.lit(": "), F.col("ctx_a"), F.lit(" "), capitalize(F.col("ctx_b"))))
    kept = df.where(F.length("label") > 0)
    return kept.select(row, F.array(message("user", text)).alias("prompt"), F.transform("endings", bracket_clean).alias("choices"), F.col("label").cast("int").alias("ground_truth"))


def search_row(df: DataFrame, system: str, prefix: str, split: str) -> DataFrame:
    """Search-tool rows: ground truth of the reward model, else the golden answers; the source gets a prefix."""
    truth = F.coalesce(F.col("reward_model.ground_truth"), F.col("golden_answers"))
    q = F.coalesce("question", F.lit(""))
    return df.select(
        F.concat(F.lit("searchR1_"), F.coalesce("data_source", F.lit(""))).alias("data_source"), F.array(message("system", F.lit(system)), message("user", F.concat(F.lit(prefix.rstrip("\n")), q))).alias("prompt"),
        truth.alias("ground_truth"), F.struct(F.lit(True).alias("need_tools_kwargs"), q.alias("question"), F.lit(split).alias("split")).alias("extra_info"),
    )


def date_range(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows whose text date is within the bounds, both included, by text order."""
    return df.where((F.col(column) >= start) & (F.col(column) <= end))


def shuffled_options(right: Column, wrong: Column, key: Column, seed: int = 0) -> Column:
    """``STRUCT<options, gold>``: the right answer among the wrong ones in an order seeded by the row, and its letter."""
    items = F.concat(F.array(F.struct(F.lit(True).alias("ok"), right.alias("t"))), F.transform(wrong, lambda w: F.struct(F.lit(False).alias("ok"), w.alias("t"))))
    placed = F.array_sort(F.transform(items, lambda x, i: F.struct(F.xxhash64(key, i, F.lit(seed)).alias("h"), x["ok"].alias("ok"), x["t"].alias("t"))))
    at = F.array_position(F.transform(placed, lambda x: x["ok"]), True)
    return F.struct(F.transform(placed, lambda x: x["t"]).alias("options"), F.chr(F.lit(64) + at).alias("gold"))


def eval_sample(df: DataFrame) -> DataFrame:
    """Evaluation samples in one form: type prefix upper-cased, options joined by line breaks, single-element lists unwrapped."""
    unwrapped = F.regexp_replace("answer", r"^\s*\[\s*\"([^\"\[\],]*)\"\s*\]\s*$", "$1")
    return df.withColumns({"question_type": F.upper(F.split_part("question_type", F.lit("_"), F.lit(1))), "options_text": F.array_join("options", "\n"), "answer": unwrapped})


def split_percent(df: DataFrame, row: str, first: float) -> DataFrame:
    """``part``: ``head`` for the first share of a dense row id (rounded to whole rows), ``tail`` for the rest."""
    n = df.count()
    return df.withColumn("part", F.when(F.col(row) < round(n * first), "head").otherwise("tail"))


def sft_row(prompt: Column, response: Column, length: int, pad: int, how: str = "right") -> Column:
    """``STRUCT<ids, attention, position, loss>`` of fixed length: padded on the right, or cut as asked."""
    ids = F.concat(prompt, response)
    n = F.size(ids)
    loss = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((i >= F.size(prompt)) & (i < n), 1).otherwise(0))
    ones = F.transform(ids, lambda x: F.lit(1))
    fix = lambda x, p: pad_to(truncate(x, length, how), length, F.lit(p))
    return F.struct(fix(ids, pad).alias("ids"), fix(ones, 0).alias("attention"), fix(F.sequence(F.lit(0), n - 1), 0).alias("position"), fix(loss, 0).alias("loss"))


def reward_pair(prompt: Column, chosen: Column, rejected: Column, length: int, pad: int) -> Column:
    """Two padded sequences of a preference pair, chosen first."""
    one = lambda r: pad_to(truncate(F.concat(prompt, r), length), length, F.lit(pad))
    return F.array(one(chosen), one(rejected))


def keep_recent_media(history: Column, keep: int) -> Column:
    """The newest ``keep`` media messages of a user stay; older ones become their header, their timestamps (images) and a note.

    ``history`` is ``ARRAY<STRUCT<role, content ARRAY<STRUCT<type, text>>>>``.
    """
    note = "[MEDIA OMITTED - Refer to your Observation]"
    is_media = lambda m: (m["role"] == "user") & F.exists(m["content"], lambda p: p["type"].isin("image", "video", "audio"))

    def short(m: Column) -> Column:
        first = F.get(m["content"], F.lit(0))
        head = F.when(first["type"] == "text", F.trim(first["text"])).otherwise("Media content")
        texts = F.array_join(F.transform(F.filter(F.slice(m["content"], 2, 1 << 20), lambda p: p["type"] == "text"), lambda p: p["text"]), " ")
        times = F.transform(F.regexp_extract_all(texts, F.lit(r"(\d+(?:\.\d+)?)s"), 1), lambda t: F.format_string("%.2fs", t.cast("double")))
        images = F.exists(m["content"], lambda p: p["type"] == "image")
        text = F.when(images, F.concat(head, F.lit(" Timestamps: ["), F.array_join(times, ", "), F.lit(f"] {note}"))).otherwise(F.concat(head, F.lit(f" {note}")))
        return F.struct(m["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))

    newer = lambda i: F.size(F.filter(F.slice(history, i + 2, 1 << 20), is_media))
    return F.transform(history, lambda m, i: F.when(is_media(m) & (newer(i) >= keep), short(m)).otherwise(m))


def without_media(history: Column) -> Column:
    """Chat messages with their text parts only, joined by line breaks."""
    return F.transform(history, lambda m: F.struct(m["role"].alias("role"), F.array_join(F.transform(F.filter(m["content"], lambda p: p["type"] == "text"), lambda p: p["text"]), "\n").alias("content")))


def step_stats(output: Column, error: Column) -> Column:
    """``STRUCT<action_type, n_frames, clip_start, clip_end, audio_start, audio_end>`` of an action; an error gives type ERROR and nulls.

    Frames by ``num``, or by the legacy list of timestamps; a frame action fills the clip bounds too.
    """
    v = F.try_parse_json(F.when(F.coalesce(error, F.lit("OK")).isin("", "OK"), output))
    get = lambda p, t: F.try_variant_get(v, f"$.action.{p}", t)
    kind = get("type", "string")
    clip = kind.isin("get_clip", "get_frames")
    stamps = F.size(get("timestamps", "array<double>")).cast("double")
    frames = F.when(kind == "get_frames", F.coalesce(get("num", "double"), F.nullif(stamps, F.lit(-1.0))))
    bad = ~F.coalesce(error, F.lit("OK")).isin("", "OK")
    return F.struct(
        F.when(bad, "ERROR").otherwise(F.coalesce(kind, F.lit("UNKNOWN"))).alias("action_type"), frames.alias("n_frames"), F.when(clip, get("start", "double")).alias("clip_start"), F.when(clip, get("end", "double")).alias("clip_end"),
        F.when(kind == "get_audio", get("start", "double")).alias("audio_start"), F.when(kind == "get_audio", get("end", "double")).alias("audio_end"),
    )


def multichoice_answer(text: Column) -> Column:
    """The letter behind ``Answer:``; null without one."""
    return F.nullif(F.upper(F.regexp_extract(text, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1)), F.lit(""))


def pass_rate(results: DataFrame, key: str, case: str, code: str, most: int | None = None) -> DataFrame:
    """Share of passed test cases: ``code`` is 1 for passed; after the first compile error (-4) every later case is one; ``most`` first cases only."""
    r = results if most is None else results.where(F.col(case) < most)
    first = r.groupBy(key).agg(F.min(F.when(F.col(code) == -4, F.col(case))).alias("_f"), F.count(F.lit(1)).alias("cases"), F.collect_list(F.struct(F.col(case).alias("c"), F.col(code).alias("k"))).alias("_r"))
    passed = F.size(F.filter("_r", lambda x: (x["k"] == 1) & (F.col("_f").isNull() | (x["c"] < F.col("_f")))))
    return first.select(key, "cases", (passed / F.col("cases")).alias("pass_rate"))
