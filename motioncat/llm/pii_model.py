"""Character tagger: a bidirectional LSTM with a conditional random field on top, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
WINDOW = 96
_PLAIN = "@.%+-_ ()[]{}<>/\\:;,\n\t'\"=|&#*!?$"
CLASSES = 6 + len(_PLAIN)


def _class(c: str) -> int:
    place = _PLAIN.find(c)
    if place >= 0:
        return 6 + place
    return 1 if c.isdigit() else 2 if "a" <= c <= "z" else 3 if "A" <= c <= "Z" else 4 if c.isalpha() else 5


_ASCII = np.array([_class(chr(i)) for i in range(128)], np.int64)


def classes(text: str, length: int = WINDOW) -> np.ndarray:
    """Class of every character, padded with 0."""
    codes = np.frombuffer(text[:length].encode("utf-32-le"), np.uint32)
    out = np.zeros(length, np.int64)
    low = codes < 128
    out[: len(codes)][low] = _ASCII[codes[low]]
    for i in np.nonzero(~low)[0]:
        out[i] = _class(text[i])
    return out


def tags_of(spans: list[tuple[str, int, int]], length: int = WINDOW) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, start, end in spans:
        k = KINDS.index(kind)
        out[start:end] = 2 + 2 * k
        out[start] = 1 + 2 * k
    return out


@dataclass
class Tagger:
    """Parameters; the leading axis of the LSTM's holds the two directions."""

    embed: np.ndarray  # classes, E
    wx: np.ndarray  # 2, E, 4H
    wh: np.ndarray  # 2, H, 4H
    bias: np.ndarray  # 2, 1, 4H
    out: np.ndarray  # 2H, tags
    out_bias: np.ndarray
    trans: np.ndarray  # tags, tags
    first: np.ndarray

    @staticmethod
    def new(rng: np.random.Generator, size: int = 10, hidden: int = 16) -> Tagger:
        def some(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * 0.3 / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)

        bias = np.zeros((2, 1, 4 * hidden), np.float32)
        bias[:, :, hidden : 2 * hidden] = 1
        trans, first = np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32)
        for k in range(len(KINDS)):  # an inside tag follows its own kind only
            inside = 2 + 2 * k
            trans[[t for t in range(TAGS) if t not in (inside, inside - 1)], inside] = -8
            first[inside] = -8
        return Tagger(some(CLASSES, size) * 3, some(2, size, 4 * hidden) * 2, some(2, hidden, 4 * hidden) * 2, bias, some(2 * hidden, TAGS), np.zeros(TAGS, np.float32), trans, first)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.wx, self.wh, self.bias, self.out, self.out_bias, self.trans, self.first]

    def _forward(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, list]:
        """Emissions (T, B, tags) of classes x (B, T)."""
        steps, hidden = x.shape[1], self.wh.shape[1]
        both = np.stack([x, x[:, ::-1]])  # 2, B, T
        into = (self.embed @ self.wx) + self.bias  # 2, classes, 4H
        h = np.zeros((2, len(x), hidden), np.float32)
        c = np.zeros_like(h)
        seen = np.empty((steps, 2, len(x), hidden), np.float32)
        trace = []
        side = np.arange(2)[:, None]
        for t in range(steps):
            gates = into[side, both[:, :, t]] + h @ self.wh
            ifo = 0.5 * np.tanh(0.5 * gates[:, :, : 3 * hidden]) + 0.5
            g = np.tanh(gates[:, :, 3 * hidden :])
            i, f, o = ifo[:, :, :hidden], ifo[:, :, hidden : 2 * hidden], ifo[:, :, 2 * hidden :]
            before = c
            c = f * c + i * g
            squashed = np.tanh(c)
            if keep:
                trace.append((h, before, i, f, o, g, squashed))
            h = o * squashed
            seen[t] = h
        joined = np.concatenate([seen[:, 0], seen[::-1, 1]], axis=2)  # T, B, 2H
        return joined @ self.out + self.out_bias, joined, trace

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x, keep=False)[0]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log-likelihood of tags y (B, T), and its gradients in the order of ``parts``."""
        emit, joined, trace = self._forward(x, keep=True)
        steps, n, _ = emit.shape
        loss, d_emit, d_trans, d_first = self._crf(emit.astype(np.float64), y)
        d_emit = d_emit.astype(np.float32)
        d_out = np.einsum("tbh,tbk->hk", joined, d_emit)
        d_joined = d_emit @ self.out.T
        hidden = self.wh.shape[1]
        d_seen = np.stack([d_joined[:, :, :hidden], d_joined[::-1, :, hidden:]], axis=1)  # T, 2, B, H
        both = np.stack([x, x[:, ::-1]])
        d_wh = np.zeros_like(self.wh)
        d_into = np.zeros((2, CLASSES, 4 * hidden), np.float32)
        d_h = np.zeros((2, n, hidden), np.float32)
        d_c = np.zeros_like(d_h)
        one = np.zeros((2, n, CLASSES), np.float32)
        for t in range(steps - 1, -1, -1):
            h, before, i, f, o, g, squashed = trace[t]
            d_h = d_h + d_seen[t]
            d_c = d_c + d_h * o * (1 - squashed**2)
            d_gates = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - g**2)], axis=2)
            d_wh += h.transpose(0, 2, 1) @ d_gates
            one[:] = 0
            np.put_along_axis(one, both[:, :, t][:, :, None], 1, axis=2)
            d_into += one.transpose(0, 2, 1) @ d_gates
            d_h = d_gates @ self.wh.transpose(0, 2, 1)
            d_c = d_c * f
        d_wx = self.embed.T @ d_into
        d_embed = (d_into @ self.wx.transpose(0, 2, 1)).sum(axis=0)
        return loss, [d_embed, d_wx, d_wh, d_into.sum(axis=1, keepdims=True), d_out, d_emit.sum(axis=(0, 1)), d_trans, d_first]

    def _crf(self, emit: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        steps, n, tags = emit.shape
        moves = np.exp(self.trans.astype(np.float64))
        top = emit.max(axis=2, keepdims=True)
        e = np.exp(emit - top)
        alpha, scale = np.empty_like(e), np.empty((steps, n, 1))
        a = np.exp(self.first.astype(np.float64)) * e[0]
        for t in range(steps):
            if t:
                a = (alpha[t - 1] @ moves) * e[t]
            scale[t] = a.sum(axis=1, keepdims=True)
            alpha[t] = a / scale[t]
        beta = np.ones((n, tags))
        unary, d_trans = np.empty_like(e), np.zeros((tags, tags))
        for t in range(steps - 1, -1, -1):
            unary[t] = alpha[t] * beta
            if t:
                ahead = e[t] * beta / scale[t]
                d_trans += moves * (alpha[t - 1].T @ ahead)
                beta = ahead @ moves.T
        unary /= unary.sum(axis=2, keepdims=True)
        yt = y.T
        rows = np.arange(n)
        gold = np.take_along_axis(emit, yt[:, :, None], 2).sum() + self.trans[yt[:-1], yt[1:]].sum() + self.first[yt[0]].sum()
        loss = (np.log(scale).sum() + top.sum() - gold) / n
        np.subtract.at(d_trans, (yt[:-1].ravel(), yt[1:].ravel()), 1)
        d_first = unary[0].sum(axis=0)
        np.subtract.at(d_first, yt[0], 1)
        for t in range(steps):
            unary[t, rows, yt[t]] -= 1
        return float(loss), unary / n, (d_trans / n).astype(np.float32), (d_first / n).astype(np.float32)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (B, T), and by how much each tag's emission exceeds that of O."""
        emit = self.emissions(x)
        steps, n, tags = emit.shape
        score = emit[0] + self.first
        back = np.empty((steps, n, tags), np.int8)
        for t in range(1, steps):
            via = score[:, :, None] + self.trans
            back[t] = via.argmax(axis=1)
            score = np.take_along_axis(via, back[t][:, None, :].astype(np.int64), 1)[:, 0] + emit[t]
        best = np.empty((n, steps), np.int64)
        best[:, -1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            best[:, t - 1] = back[t, np.arange(n), best[:, t]]
        margin = np.take_along_axis(emit, best.T[:, :, None], 2)[:, :, 0] - emit[:, :, 0]
        return best, margin.T


def train(x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.02, seed: int = 5) -> Tagger:
    """Fit by Adam; the same rows in the same order give the same tagger."""
    rng = np.random.default_rng(seed)
    model = Tagger.new(rng)
    means = [np.zeros_like(p) for p in model.parts()]
    squares = [np.zeros_like(p) for p in model.parts()]
    step, total = 0, epochs * max(1, len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, max(1, len(x) - batch + 1), batch):
            picked = order[at : at + batch]
            _, grads = model.gradients(x[picked], y[picked])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            step += 1
            now = rate * min(1.0, 2 * (1 - step / (total + 1)))
            for p, g, m, s in zip(model.parts(), grads, means, squares):
                g = g * min(1.0, 5 / (norm + 1e-9))
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return model
