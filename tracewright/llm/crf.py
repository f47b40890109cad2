"""A linear-chain conditional random field in numpy.

A position's score is a sum over offsets of the features of the unit at that offset, so scores are table rows per distinct unit;
training is by mini-batches of forward-backward and Adam, decoding by Viterbi over padded batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

OFFSETS = (-5, -4, -3, -2, -1, 0, 1, 2, 3)
PAD, BOS, EOS = "\x00pad", "\x00bos", "\x00eos"
FORBIDDEN = -1e4


class Crf:
    """``features`` maps a unit (string) to its feature strings; labels are ``O`` and ``B-x``/``I-x`` per kind."""

    def __init__(self, kinds: tuple[str, ...], features: Callable[[str], list[str]]):
        self.labels = ["O", *[f"{p}-{k}" for k in kinds for p in "BI"]]
        self.features = features
        n = len(self.labels)
        self.ban = np.zeros((n, n), np.float32)
        for j, lb in enumerate(self.labels):
            if lb[0] == "I":
                for i, la in enumerate(self.labels):
                    if la == "O" or la[2:] != lb[2:]:
                        self.ban[i, j] = FORBIDDEN
        self.ban0 = np.array([FORBIDDEN if lb[0] == "I" else 0.0 for lb in self.labels], np.float32)
        self.ids: dict[str, int] = {}
        self.rows: dict[str, np.ndarray] = {}

    # -- training
    def fit(self, units: list[list[str]], labels: list[list[int]], epochs: int = 10, batch: int = 96, rate: float = 0.05, decay: float = 5e-4, seed: int = 1) -> Crf:
        n, k = len(self.labels), len(OFFSETS)
        count: dict[str, int] = {}
        vocab = sorted({u for s in units for u in s} | {PAD, BOS, EOS})
        feats = {u: self.features(u) for u in vocab}
        for s in units:
            for u in s:
                for f in feats[u]:
                    count[f] = count.get(f, 0) + 1
        kept = sorted(f for f, c in count.items() if c > 1) + ["bos", "eos"]
        self.ids = {f: i for i, f in enumerate(dict.fromkeys(kept))}
        unit_id = {u: i for i, u in enumerate(vocab)}
        m = np.zeros((len(vocab), len(self.ids)), np.float32)
        for u, i in unit_id.items():
            for f in self._known(u, feats[u]):
                m[i, f] += 1
        w, t = np.zeros((len(self.ids), k * n), np.float32), np.zeros((n, n), np.float32)
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
        rng, step = np.random.default_rng(seed), 0
        order = np.array(sorted(range(len(units)), key=lambda i: (len(units[i]), i)))
        parts = [order[i : i + batch] for i in range(0, len(order), batch)]
        mean_w, mean_t, taken = np.zeros_like(w), np.zeros_like(t), 0  # the weights of the last third of the epochs, averaged
        for epoch in range(epochs):
            for p in rng.permutation(len(parts)):
                part = parts[p]
                ids, mask = self._grid([[unit_id[u] for u in units[i]] for i in part], unit_id[PAD], unit_id[BOS], unit_id[EOS])
                gold = np.zeros(mask.shape, np.int64)
                for r, i in enumerate(part):
                    gold[r, : len(labels[i])] = labels[i]
                touched, inv = np.unique(ids, return_inverse=True)
                inv = inv.reshape(ids.shape)
                rows = m[touched]
                s = (rows @ w).reshape(len(touched), k, n)
                width = mask.shape[1]
                e = sum(s[inv[:, j : j + width], j] for j in range(k))
                g_e, g_t = self._gradient(e, t + self.ban, gold, mask)
                g_s = np.zeros((len(touched), k, n), np.float32)
                flat = g_e.reshape(-1, n)
                for j in range(k):
                    at = inv[:, j : j + width].reshape(-1)
                    for c in range(n):
                        g_s[:, j, c] = np.bincount(at, flat[:, c], len(touched))
                g_w = rows.T @ g_s.reshape(len(touched), k * n) / len(part) + decay * w
                g_t = g_t / len(part) + decay * t
                step += 1
                lr = rate * (1 - 0.9 * epoch / max(1, epochs - 1))
                for x, g, a, b in ((w, g_w, state[0], state[1]), (t, g_t, state[2], state[3])):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    x -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
            if epoch >= epochs * 2 // 3:
                mean_w, mean_t, taken = mean_w + w, mean_t + t, taken + 1
        w, t = mean_w / max(1, taken), mean_t / max(1, taken)
        self.w, self.t = w, (t + self.ban).astype(np.float32)
        return self

    def _known(self, u: str, feats: list[str]) -> list[int]:
        feats = ["bos"] if u == BOS else ["eos"] if u == EOS else [] if u == PAD else feats
        return [self.ids[f] for f in feats if f in self.ids]

    @staticmethod
    def _grid(seqs: list[list[int]], pad: int, bos: int, eos: int) -> tuple[np.ndarray, np.ndarray]:
        """Unit ids with the margins that the offsets need, and the mask of real positions."""
        left, right = -OFFSETS[0], OFFSETS[-1]
        width = max(map(len, seqs))
        ids = np.full((len(seqs), left + width + right), pad, np.int64)
        ids[:, left - 1] = bos
        mask = np.zeros((len(seqs), width), bool)
        for r, s in enumerate(seqs):
            ids[r, left : left + len(s)] = s
            ids[r, left + len(s)] = eos
            mask[r, : len(s)] = True
        return ids, mask

    def _gradient(self, e: np.ndarray, t: np.ndarray, gold: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected minus observed counts of emissions and transitions, by scaled forward and backward products."""
        rows, width, n = e.shape
        move = np.exp(np.clip(t, -80, 80)).astype(np.float64)
        look = np.exp(e - e.max(2, keepdims=True)).astype(np.float64)
        alpha, beta, norm = np.zeros((rows, width, n)), np.ones((rows, width, n)), np.ones((rows, width))
        now = look[:, 0] * (self.ban0 == 0)
        alpha[:, 0] = now / now.sum(1, keepdims=True)
        for i in range(1, width):
            on = mask[:, i]
            now = (alpha[:, i - 1] @ move) * look[:, i]
            norm[:, i] = np.where(on, now.sum(1), 1.0)
            alpha[:, i] = np.where(on[:, None], now / norm[:, i, None], alpha[:, i - 1])
        g_t = np.zeros((n, n))
        for i in range(width - 2, -1, -1):
            into = look[:, i + 1] * beta[:, i + 1] / norm[:, i + 1, None] * mask[:, i + 1, None]
            beta[:, i] = np.where(mask[:, i + 1, None], into @ move.T, 1.0)
            g_t += move * (alpha[:, i].T @ into)
        g_e = alpha * beta * mask[:, :, None]
        r, c = np.nonzero(mask)
        g_e[r, c, gold[r, c]] -= 1
        both = mask[:, 1:]
        np.add.at(g_t, (gold[:, :-1][both], gold[:, 1:][both]), -1)
        return g_e.astype(np.float32), g_t.astype(np.float32)

    # -- decoding
    def decode(self, seqs: list[list[str]], cells: int = 1 << 18) -> list[np.ndarray]:
        """Best labels of each sequence, batches of padded length by Viterbi. Empty sequences give empty labels."""
        n, k = len(self.labels), len(OFFSETS)
        if len(self.rows) > 400_000:
            self.rows.clear()
        vocab: dict[str, int] = {PAD: 0, BOS: 1, EOS: 2}
        ids = [[vocab.setdefault(u, len(vocab)) for u in s] for s in seqs]
        table = np.zeros((len(vocab), k, n), np.float32)
        for u, i in vocab.items():
            row = self.rows.get(u)
            if row is None:
                known = self._known(u, self.features(u))
                row = self.w[known].sum(0).reshape(k, n) if known else np.zeros((k, n), np.float32)
                self.rows[u] = row
            table[i] = row
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(seqs)
        order = sorted((i for i in range(len(seqs)) if ids[i]), key=lambda i: len(ids[i]))
        at = 0
        while at < len(order):
            # the part's last sequence is its longest; take as many as fit the cells
            to = at + 1
            while to < len(order) and len(ids[order[to]]) * (to + 1 - at) <= cells:
                to += 1
            part = order[at:to]
            best = self._viterbi(table, *self._grid([ids[i] for i in part], 0, 1, 2))
            for r, i in enumerate(part):
                out[i] = best[r, : len(ids[i])]
            at = to
        return out

    def _viterbi(self, table: np.ndarray, grid: np.ndarray, mask: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
        """Best paths. Emissions are looked up chunk by chunk and scores carried over, so that a sequence of any length is decoded whole."""
        (rows, width), (k, n) = mask.shape, table.shape[1:]
        back = np.zeros((width, rows, n), np.int8)
        into = [np.flatnonzero(self.t[:, c] > FORBIDDEN / 2) for c in range(n)]
        every = np.arange(rows)
        score = np.zeros((rows, n), np.float32)
        for lo in range(0, width, chunk):
            hi = min(width, lo + chunk)
            e = table[grid[:, lo:hi], 0]
            for j in range(1, k):
                e += table[grid[:, lo + j : hi + j], j]
            for i in range(lo, hi):
                if i == 0:
                    score = e[:, 0] + self.ban0
                    continue
                if rows < 32:
                    cand = score[:, :, None] + self.t
                    arg = cand.argmax(1)
                    back[i] = arg
                    new = np.take_along_axis(cand, arg[:, None, :], 1)[:, 0]
                else:
                    new = np.empty_like(score)
                    for c in range(n):
                        cand = score[:, into[c]] + self.t[into[c], c]
                        arg = cand.argmax(1)
                        back[i, :, c] = into[c][arg]
                        new[:, c] = cand[every, arg]
                score = np.where(mask[:, i, None], new + e[:, i - lo], score)
            score = score - score.max(1, keepdims=True)  # only differences matter; sums of long texts would lose digits
        length = mask.sum(1)
        best = np.zeros((rows, width), np.int8)
        cur = score.argmax(1)
        for i in range(width - 1, -1, -1):
            here = i < length
            best[here, i] = cur[here]
            step = here & (i > 0)
            cur = np.where(step, back[i, every, cur], cur)
        return best
