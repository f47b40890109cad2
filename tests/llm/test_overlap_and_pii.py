import random

import numpy as np
import pandas as pd
import pytest

from tracewright.llm import overlap as O
from tracewright.llm.fmindex import FmIndex, suffix_array
from tracewright.llm.pii import Finder, find_pii, mask_pii, mask_text, segments, train
from tracewright.llm.pii_labels import labelled


def test_suffix_array_and_matches():
    rng = np.random.default_rng(2)
    for _ in range(30):
        text = rng.integers(0, 4, int(rng.integers(1, 60)))
        got = suffix_array(text).tolist()
        assert got == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        docs = [rng.integers(1, 5, int(rng.integers(0, 9))) for _ in range(6)]
        index = FmIndex(docs)
        q = rng.integers(0, 5, 12)
        end, lo, hi = index.matches(q, np.zeros(12, int), 2)
        seen = {int(e): sorted(index.docs[a:b].tolist()) for e, a, b in zip(end, lo, hi, strict=True)}
        want = {}
        for e in range(1, 12):
            hits = sorted(d for d, x in enumerate(docs) for j in range(len(x) - 1) if x[j] == q[e - 1] and x[j + 1] == q[e] and q[e] > 0 and q[e - 1] > 0)
            if hits:
                want[e] = hits
        assert seen == want


def test_similarity_against_table():
    rng = random.Random(3)

    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
        return 1 - d[-1] / max(len(a), len(b), 1)

    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 90))) for _ in range(2))
        assert O.similarity(a, b) == pytest.approx(slow(a, b))


EV = "eval_id long, split string, video string, question string, source string, rec string"
TR = "row_id long, data_source string, video string, question string, split string, q string"
Q = "What is the older violinist doing right after the 3rd camera cut on the kitchen island?"


def found(spark, ev, tr):
    e = spark.createDataFrame([(i, s, v, q, "clash", "clash") for i, s, v, q in ev], EV)
    t = spark.createDataFrame([(i, s, v, q, "clash", "clash") for i, s, v, q in tr], TR)
    return sorted((r["eval_id"], r["row_id"]) for r in O.cross_split_overlaps(e, t).collect())


def test_near():
    q = "how many copies of the lopsided scarf stand in the cellar beside the loading ramp"
    assert O.near(("from the clip " + q + " in this video").split(), q.split()) is not None
    assert O.near(q.replace("scarf", "scraf").split(), q.split()) is not None
    assert O.near(q.replace("lopsided scarf", "velvet teapot").replace("cellar", "attic").replace("loading ramp", "spice stall").split(), q.split()) is None
    assert O.near("2 cats sit there".split(), "3 cats sit there".split()) is None and O.near([], []) is None and O.near(["a"], []) is None


def test_overlaps(spark):
    ev = [(1, "val", "a/x1.mp4", Q), (2, "test", "b/X1.MKV", "Please answer: " + Q.replace("violinist", "violinst")), (3, "val", "y.mp4", Q), (4, "val", None, Q), (5, "val", "x1.mp4", None), (6, "val", "x1.mp4", "?"), (7, "val", "x1.mp4", "Why?")]
    tr = [(10, "s", "x1.mp4", Q.upper()), (11, "s", "x1_4_20.mp4", Q), (11, "s", "x1_4_20.mp4", Q), (12, "s", "x1.mp4", Q.replace("3rd", "4th")), (13, "s", "x1.mp4", "Which object does the referee hand to the baker near the fountain?"), (14, None, "x1.mp4", "why"), (15, "s", None, Q), (16, "s", "x1.mp4", None)]
    assert found(spark, ev, tr) == [(1, 10), (1, 11), (1, 11), (2, 10), (2, 11), (2, 11), (7, 14)]
    assert found(spark, [], tr) == [] and found(spark, ev, []) == []


def test_hot_recording_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    qs = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(150)]
    ev = [(i, "val", "hot.mp4" if i % 3 else f"r{i}.mp4", q) for i, q in enumerate(qs)]
    tr = [(1000 + i, "s", "hot.mp4" if i % 3 else f"r{i}.mp4", q.replace(q.split()[5], "changed", 1)) for i, q in enumerate(qs)]
    plain = found(spark, ev, tr)
    assert plain == [(i, 1000 + i) for i in range(150)]
    monkeypatch.setattr(O, "EVAL_CLASSES", 20)
    monkeypatch.setattr(O, "TRAIN_CLASSES", 30)
    assert found(spark, ev, tr) == plain


def test_find_overlaps_is_whole():
    rng = random.Random(7)
    words = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in "lmnr"]
    base = [[rng.choice(words) for _ in range(rng.randrange(6, 25))] for _ in range(60)]

    def edit(ws):
        ws = list(ws)
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(ws))
            ws[k : k + 1] = rng.choice(([], [ws[k][:-1]], [ws[k], rng.choice(words)], [rng.choice(words)]))
        return " ".join(ws)

    ev = pd.DataFrame([(i, "val", f"r{i % 7}", edit(w)) for i, w in enumerate(base)], columns=["eval_id", "split", "rec", "q"])
    tr = pd.DataFrame([(i, "s", f"r{i % 7}", edit(w)) for i, w in enumerate(base * 3)], columns=["row_id", "source", "rec", "q"])
    got = {(r.eval_id, r.row_id) for r in O.find_overlaps(ev, tr).itertuples()}
    want = {(e.eval_id, t.row_id) for e in ev.itertuples() for t in tr.itertuples() if e.rec == t.rec and O.near(e.q.split(), t.q.split()) is not None}
    assert got == want


@pytest.fixture(scope="module")
def finder():
    return Finder(train())


def test_held_out_accuracy(finder):
    rows = labelled(400, seed=4242)
    hit = extra = missed = 0
    for (text, want), got in zip(rows, finder([t for t, _ in rows]), strict=True):
        w, g = set(want), set(got)
        hit, extra, missed = hit + len(w & g), extra + len(g - w), missed + len(w - g)
    assert hit / (hit + extra) > 0.95 and hit / (hit + missed) > 0.95


def test_cases(finder):
    text = "Contact Nora Elmford at nora.elmford@example.org or +1 617 555 0123.\nBest,\nSimon Ashley\n12 Osprey Boulevard\nSaltmere, ZQ 00123"
    got = finder([text, None, "", "Evaluated on Elmford Bridge and Copper Lane, 9 recordings each.", "x" * 300_000])
    kinds = [(k, text[a:b]) for k, a, b in got[0]]
    assert ("email", "nora.elmford@example.org") in kinds and ("phone", "+1 617 555 0123") in kinds and ("name", "Nora Elmford") in kinds
    assert got[1:4] == [[], [], []] and not any(k == "name" for k, _, _ in got[3])
    masked = mask_text(text, got[0])
    assert "nora.elmford" not in masked and "<EMAIL>" in masked and masked.startswith("Contact <NAME> at <EMAIL> or <PHONE>.\nBest,\n")
    assert mask_text(None, []) is None


def test_segments_cover(finder):
    for text, _ in labelled(50, seed=5):
        parts = segments(text)
        assert "".join(text[a:b] for a, b in parts) == text


def test_find_and_mask_frames(spark):
    rows = [(1, "Mail a.b@example.com if the clip is missing.", "k"), (1, "Mail a.b@example.com if the clip is missing.", "k"), (2, None, "k"), (3, "", "k"), (4, "no entity here", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = [tuple(r) for r in find_pii(df, "doc_id", "text", 1500).collect()]
    assert got == [(1, "email", 5, 20)] * 2
    masked = {r[0]: (r[1], r[2]) for r in mask_pii(df, "doc_id", "text", 1500).collect()}
    assert masked == {1: ("Mail <EMAIL> if the clip is missing.", 1), 2: (None, 0), 3: ("", 0), 4: ("no entity here", 0)}
    assert find_pii(df.where("false"), "doc_id", "text", 1500).count() == 0
