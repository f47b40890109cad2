"""Candidates of near copies against comparison of all pairs, where few words or pairs of words are the same."""

import random

import pandas as pd

from tracewright.llm import overlap as O


def _frame(key, rows):
    return pd.DataFrame({key: range(len(rows)), "split": "s", "source": "x", "rec": [r for r, _ in rows], "q": [" ".join(ws) for _, ws in rows]})


def _found(ev, tr):
    return {(r.eval_id, r.row_id) for r in O.find_overlaps(_frame("eval_id", ev), _frame("row_id", tr)).itertuples()}


def test_every_second_word_misspelt():
    a = [f"{x}{y}{z}" for x in "kmpr" for y in "aeiou" for z in ("stone", "light", "field")][:21]
    b = [w if i % 2 else w[:-1] + "z" for i, w in enumerate(a)]
    assert O.near(a, b) > O.SURE and _found([("r", a)], [("r", b)]) == {(0, 0)}
    # other questions of the recording do not matter
    rest = [("r", a[i : i + 6]) for i in range(12)]
    assert (0, 0) in _found([("r", a), *rest], [("r", b), *rest])


def test_misspelt_copies_are_whole():
    rng = random.Random(5)
    vocabulary = [f"{x}{y}{z}" for x in "bdfgkm" for y in "aeiou" for z in ("rain", "ston", "light", "fieldes")]
    ev = [(f"r{i % 4}", [rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))]) for i in range(80)]
    tr = []
    for rec, ws in ev:
        for share in (0.1, 0.3, 0.5, 0.6):
            tr.append((rec, [w[:-1] + rng.choice("xyz") if rng.random() < share else w for w in ws] + rng.choice(([], [], ["so"], ["what", "now"]))))
    want = {(i, j) for i, (r, a) in enumerate(ev) for j, (s, b) in enumerate(tr) if r == s and O.near(a, b) is not None}
    assert _found(ev, tr) == want and len(want) > 150


def test_quick_bounds_lose_nothing():
    rng = random.Random(6)
    for _ in range(2000):
        a = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 20)))
        b = "".join(c if rng.random() < 0.8 else rng.choice("abc ") for c in a)
        assert O._apart(a, b) <= round((1 - O.similarity(a, b)) * max(len(a), len(b)))


def test_letters_left_out_in_one_recording():
    rng = random.Random(11)
    syllables = ["ba", "ke", "mi", "ro", "tu", "sal", "dor", "fen", "gri", "pol"]
    ev, tr = [], []
    for _ in range(300):
        ws = ["".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5))) for _ in range(rng.randrange(5, 28))]
        ev.append(("hot", ws))
        tr.append(("hot", [w[:k] + w[k + 1 :] if rng.random() < 0.9 and len(w) > 4 else w for w in ws for k in [rng.randrange(len(w))]]))
    want = {(i, j) for i, (_, a) in enumerate(ev) for j, (_, b) in enumerate(tr) if O.near(a, b) is not None}
    assert _found(ev, tr) == want and len(want) > 200


def test_maximal_matches_are_merged():
    a = [("k", "w1 b c d e f g h i j")]
    b = [("k", "w1 b c x e f g h i j"), ("k", "w1 b c d e f g h i j"), ("other", "w1 b c d e f g h i j")]
    got = sorted((j, n, longest) for i, j, n, longest, s in O.near_classes(a, b))
    assert got == [(0, 9, 6), (1, 10, 10)]
    assert O.near_classes([], b) == [] and O.near_classes(a, []) == [] and O.near_classes([("k", "")], b) == []


def test_words_and_numbers_as_columns(spark):
    texts = ["Is it 3.50, or 1,000?", "  ", "", "数3个苹果吗？ A-b_c", "ＦＵＬＬ １２ 007 0.0 10. x1y2", "È vero? Straße ĞÜ", None, "1.2.3 a" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    rows = df.select("q", O.question_text(df.q).alias("t")).select("q", "t", O.question_numbers(O.F.col("t")).alias("n")).collect()
    for q, t, n in rows:
        if q is None:
            assert t is None
            continue
        narrow = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in q)
        assert t == " ".join(O.words(narrow)), q
        assert (n.split(" ") if n else []) == sorted(O.numbers(O.words(narrow))), q
