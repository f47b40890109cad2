import os
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from tracewright.llm import crf as C
from tracewright.llm import pii_labels as L
from tracewright.llm.pii import TOKEN, Finder, train, trained
from tracewright.llm.pii_words import known

DOCUMENTS = "/root/testdata/sf0.1/documents.parquet"
WORD = re.compile(r"[^\W\d_]+")


def _all_contexts():
    whole = [c for v in [*L.CONTEXTS.values(), *L.PLAIN.values(), L.ANYWHERE] for c in L.contexts(v)]
    phrases = [p for v in L.BEFORE.values() for x in v.values() for p in x.split("|")] + [p for v in L.AFTER.values() for p in v.split("|")]
    return whole + phrases + [p for v in L.PARTS.values() for x in v for p in x.split("|")]


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="the tables are not here")
def test_labelled_table_is_not_the_documents():
    texts = pd.read_parquet(DOCUMENTS)["text"].dropna().tolist()
    words, runs = set(), set()
    for t in texts:
        ws = [w.lower() for w in WORD.findall(t)]
        words.update(ws)
        runs.update(zip(ws, ws[1:], ws[2:], ws[3:], strict=False))
    closed = known()
    listed = [x for d in (L.FIRST, L.LAST, L.STREETS) for v in d.values() for x in v.split()] + [x for v in L.TOWNS.values() for x in v.split("|")] + L.HOSTS + L.NOUNS + L.DESCRIBING + L.DOING
    made = [text[a:b] for text, spans in L.labelled(3000) for k, a, b in spans if k in ("name", "address")]
    seen = {w.lower() for x in listed + made for w in WORD.findall(x) if len(w) >= 4 and not re.search("[一-鿿]", w)}
    assert not {w for w in seen & words if w not in closed}
    chinese = "\n".join(t for t in texts if re.search("[一-鿿]", t))
    assert not [x for x in L.ZH_TOWN + L.ZH_DISTRICT + L.ZH_STREET if x in chinese]
    for c in _all_contexts():
        for piece in re.split(r"\{[A-Za-z]\}|\{\{|\}\}", c):
            ws = [w.lower() for w in WORD.findall(piece)]
            assert not [g for g in zip(ws, ws[1:], ws[2:], ws[3:], strict=False) if g in runs], c
            if piece not in ("身份证号：",):  # the cue word itself
                assert not [m for m in re.findall("[一-鿿]{4,}", piece) if m in chinese], c


def test_held_out_contexts_and_fillers():
    """Fields trained on four fifths of contexts, names, streets, towns and hosts find those of the last fifth."""
    finder, count = Finder(train(part="train")), defaultdict(lambda: [0, 0, 0])
    rows = L.labelled(800, seed=99, part="held")
    for (text, want), got in zip(rows, finder([t for t, _ in rows]), strict=True):
        for i, part in enumerate((set(want) & set(got), set(got) - set(want), set(want) - set(got))):
            for kind, _, _ in part:
                count[kind][i] += 1
    for kind, (hit, extra, missed) in count.items():
        assert hit / (hit + extra) > 0.8 and hit / (hit + missed) > 0.75, (kind, hit, extra, missed)
    hit, extra, missed = np.sum(list(count.values()), axis=0)
    assert hit / (hit + extra) > 0.88 and hit / (hit + missed) > 0.85


def test_long_segments_are_decoded_whole():
    crf = train()
    near = "the owl weighs a spoon and " * 300
    text = near + "mail jane.whitcombe@postbox.ro now, " + near
    assert len(TOKEN.findall(text)) > 2000
    whole = crf.decode([TOKEN.findall(text)])[0]
    table, grid, mask = _tables(crf, TOKEN.findall(text))
    for chunk in (7, 100, 1 << 16):
        assert (crf._viterbi(table, grid, mask, chunk)[0] == whole).all()
    assert [(k, text[a:b]) for k, a, b in Finder(crf)([text])[0]] == [("email", "jane.whitcombe@postbox.ro")]


def _tables(crf, units):
    vocab = {C.PAD: 0, C.BOS: 1, C.EOS: 2}
    ids = [vocab.setdefault(u, len(vocab)) for u in units]
    n, k = len(crf.labels), len(C.OFFSETS)
    table = np.stack([crf.w[crf._known(u, crf.features(u))].sum(0).reshape(k, n) if u != C.PAD else np.zeros((k, n), np.float32) for u in vocab])
    return table, *crf._grid([ids], 0, 1, 2)


def test_gradient_against_differences():
    rng = np.random.default_rng(4)
    crf = C.Crf(("a", "b"), lambda u: [u])
    n = len(crf.labels)
    e, t = rng.normal(size=(2, 5, n)), rng.normal(size=(n, n)) + crf.ban
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], bool)
    gold = np.array([[0, 1, 2, 0, 3], [1, 2, 0, 0, 0]])

    def loss(e, t):
        total = 0.0
        for r in range(2):
            m = int(mask[r].sum())
            alpha = e[r, 0] + crf.ban0
            score = e[r, 0, gold[r, 0]]
            for i in range(1, m):
                z = alpha[:, None] + t
                alpha = np.log(np.exp(z - z.max(0)).sum(0)) + z.max(0) + e[r, i]
                score += t[gold[r, i - 1], gold[r, i]] + e[r, i, gold[r, i]]
            total += np.log(np.exp(alpha - alpha.max()).sum()) + alpha.max() - score
        return total

    g_e, g_t = crf._gradient(e, t, gold, mask)
    for where in [(0, 2, 1), (1, 0, 0), (1, 2, 3)]:
        d = np.zeros_like(e)
        d[where] = 1e-5
        assert g_e[where] == pytest.approx((loss(e + d, t) - loss(e - d, t)) / 2e-5, abs=1e-3)
    for where in [(0, 0), (1, 2), (2, 0), (0, 3)]:
        d = np.zeros_like(t)
        d[where] = 1e-5
        assert g_t[where] == pytest.approx((loss(e, t + d) - loss(e, t - d)) / 2e-5, abs=1e-3)


def test_weights_are_kept_in_the_shared_folder(spark, monkeypatch):
    from tracewright.llm import pii

    first = trained(spark, 400)
    pii._LOADED.clear()
    monkeypatch.setattr(pii, "train", lambda *a: pytest.fail("trained twice"))
    again = trained(spark, 400)
    assert again.ids == first.ids and np.array_equal(again.w, first.w.astype(np.float32)) and np.array_equal(again.t, first.t)
