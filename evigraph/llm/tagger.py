"""Character tagger: bidirectional LSTM with CRF transitions, in numpy.

A character enters as its bucket and as its bucket joined with the class of the character
before it; the two embeddings are added up into one table when the weights load. A time step
is one gather, one matrix product over state and input, and the gates. Gates use a piecewise
linear sigmoid and a rational squashing function, both cheap without special instructions.
All windows of a batch and both directions step together, features first, so that every
operation runs over contiguous memory. Weights are trained by ``tagger_train`` and stored beside this module.
"""

from __future__ import annotations

import io
import pkgutil
import unicodedata

import numpy as np

LABELS = ("O", "EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
BUCKETS, CLASSES = 512, 16
WEIGHTS = "tagger_weights.npz"
#: Characters searched on either side of a doubtful one.
BORDER = 3


def _class_of(c: str) -> int:
    if c in "\n\r":
        return 11
    if c.isspace():
        return 4
    if c in ".,-@":
        return {".": 5, ",": 6, "-": 7, "@": 8}[c]
    if c in "()<>[]（）":
        return 9
    if c in ":;=/：、|":
        return 10
    if c.isdigit():
        return 3
    o = ord(c)
    if 0x3040 <= o <= 0x30FF:
        return 13
    if 0x3400 <= o <= 0x9FFF or o == 0x3005:
        return 12
    if c.islower():
        return 1
    if c.isupper():
        return 2
    return 14 if unicodedata.category(c).startswith("L") else 15


def _bucket_of(c: str) -> int:
    o = ord(c)
    if 0xFF01 <= o <= 0xFF5E:  # full-width forms share the bucket of their narrow ones
        o -= 0xFEE0
    return o if o < 128 else 128 + o * 2654435761 % (BUCKETS - 128)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    cls, bucket = np.full(0x10000, 15, dtype=np.int32), np.zeros(0x10000, dtype=np.int32)
    for o in range(1, 0x10000):
        if not 0xD800 <= o <= 0xDFFF:
            cls[o], bucket[o] = _class_of(chr(o)), _bucket_of(chr(o))
    return cls, bucket


_CLASS, _BUCKET = _tables()


def codes_of(texts: list[str]) -> list[np.ndarray]:
    """One table row per character: class of the character before and bucket of its own."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(points < 0x10000, points, 0xFFFD)
    ends = np.cumsum([len(t) for t in texts])
    before = np.zeros(len(points), dtype=np.int32)
    before[1:] = _CLASS[points[:-1]]
    before[ends[:-1][ends[:-1] < len(points)]] = 0  # nothing stands before a text
    before *= BUCKETS
    before += _BUCKET[points]
    return np.split(before, ends[:-1]) if texts else []


def codes(text: str) -> np.ndarray:
    return codes_of([text])[0]


def gates_of(x: np.ndarray) -> np.ndarray:
    """The piecewise linear sigmoid."""
    return np.clip(0.25 * x + 0.5, 0, 1)


def squash(x: np.ndarray) -> np.ndarray:
    """x (27 + x^2) / (27 + 9 x^2) between -3 and 3, where it reaches -1 and 1 with no slope."""
    x = np.clip(x, -3, 3)
    y = x * x
    return x * (27 + y) / (27 + 9 * y)


def squash_slope(x: np.ndarray) -> np.ndarray:
    y = np.minimum(x * x, 9)
    return ((9 - y) / (3 * (3 + y))) ** 2


def _squash_into(x: np.ndarray, out: np.ndarray, spare: np.ndarray) -> None:
    """``squash`` without new arrays; ``x`` is clipped in place."""
    np.clip(x, -3, 3, out=x)
    np.multiply(x, x, out=spare)
    np.add(spare, 27, out=out)
    out *= x
    spare *= 9
    spare += 27
    out /= spare


class Tagger:
    def __init__(self, w: dict[str, np.ndarray]) -> None:
        w = {k: np.asarray(v, dtype=np.float32) for k, v in w.items()}
        joint = (w["joint"].reshape(CLASSES, BUCKETS, -1) + w["own"][None]).reshape(CLASSES * BUCKETS, -1)
        self.hidden = hid = w["u"].shape[1]
        self.table = np.ascontiguousarray(joint.T)
        # the gates' scale and offset are folded into the weights, a clip is left of the sigmoid
        gate = np.concatenate([np.full(3 * hid, 0.25), np.ones(hid)]).astype(np.float32)
        shift = np.concatenate([np.full(3 * hid, 0.5), np.zeros(hid)]).astype(np.float32)
        sides = [w["w"][:, d * 4 * hid : (d + 1) * 4 * hid] * gate for d in range(2)]
        bias = [w["b"][d * 4 * hid : (d + 1) * 4 * hid] * gate + shift for d in range(2)]
        self.weights = np.ascontiguousarray(np.stack([np.concatenate([w["u"][d] * gate, sides[d], bias[d][None]]).T for d in range(2)]))
        self.v, self.c = np.ascontiguousarray(w["v"].T), w["c"]
        self.trans = w["trans"]
        # Away from the plain label a step gains at most ``step`` over staying in it; crossing a
        # stretch instead of leaving it and coming back saves at most ``cross``.
        stay, inner = self.trans[0, 0], self.trans[1:, 1:].max()
        turn = self.trans[0, 1:].max() + self.trans[1:, 0].max() - 2 * stay
        self.step = float(max(0.0, inner - stay))
        self.margin = max(self.step, float(turn))
        self.cross = float(2 * inner - self.trans[0, 1:].min() - self.trans[1:, 0].min())

    def emissions(self, batch: np.ndarray) -> np.ndarray:
        """(time, label, window) scores of (window, time) codes."""
        size, steps = batch.shape
        hid, width = self.hidden, self.table.shape[0]
        seen = np.empty((2, steps, hid, size), dtype=np.float32)
        given = np.zeros((2, hid + width + 1, size), dtype=np.float32)  # state, input, one
        given[:, -1] = 1
        h, z = given[:, :hid], np.empty((2, 4 * hid, size), dtype=np.float32)
        c, g, spare, held = (np.zeros((2, hid, size), dtype=np.float32) for _ in range(4))
        along = np.ascontiguousarray(batch.T)
        come, keep, give, gates, cell = z[:, :hid], z[:, hid : 2 * hid], z[:, 2 * hid : 3 * hid], z[:, : 3 * hid], z[:, 3 * hid :]
        for t in range(steps):
            np.take(self.table, along[t], axis=1, out=given[0, hid:-1], mode="clip")
            np.take(self.table, along[steps - 1 - t], axis=1, out=given[1, hid:-1], mode="clip")
            np.matmul(self.weights, given, out=z)
            np.clip(gates, 0, 1, out=gates)
            _squash_into(cell, g, spare)
            c *= keep
            g *= come
            c += g
            np.copyto(held, c)
            _squash_into(held, g, spare)
            np.multiply(g, give, out=h)
            seen[0, t], seen[1, steps - 1 - t] = h[0], h[1]
        out = np.matmul(self.v[:, :hid], seen[0])
        out += np.matmul(self.v[:, hid:], seen[1])
        out += self.c[:, None]
        return out

    def best(self, scores: np.ndarray) -> np.ndarray:
        """(window, time) labels of the best paths.

        Where the plain label leads by the margin no path gains by leaving it, so only the
        stretches round doubtful characters are searched. Two doubtful characters share a
        stretch unless the plain label's lead between them outweighs all that crossing could
        save.
        """
        steps, _, size = scores.shape
        out = np.zeros((size, steps), dtype=np.int8)
        lead = (scores[:, 0] - scores[:, 1:].max(axis=1)).T.ravel()
        doubt = np.flatnonzero(lead <= self.margin)
        if not len(doubt):
            return out
        total = np.cumsum(lead - self.step, dtype=np.float64)
        apart = (total[doubt[1:] - 1] - total[doubt[:-1]] > self.cross) | (doubt[1:] // steps != doubt[:-1] // steps)
        apart |= doubt[1:] - doubt[:-1] > steps
        heads, tails = doubt[np.concatenate([[True], apart])], doubt[np.concatenate([apart, [True]])]
        window = heads // steps
        first = np.maximum(heads % steps - BORDER, 0)
        length = np.minimum(tails % steps + BORDER + 1, steps) - first
        order = np.argsort(length, kind="stable")
        for lo in range(0, len(order), 512):
            part = order[lo : lo + 512]
            span = int(length[part[-1]])
            at = np.minimum(first[part], steps - span)
            e = np.ascontiguousarray(scores[at + np.arange(span)[:, None], :, window[part]].transpose(0, 2, 1))
            found = self._viterbi(e, at == 0, at + span == steps)
            # a stretch writes no more than its own characters
            t = at + np.arange(span)[:, None]
            own = (t >= first[part]) & (t < first[part] + length[part])
            out[np.broadcast_to(window[part], t.shape)[own], t[own]] = found[own]
        return out

    def _viterbi(self, e: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """(time, window) best labels of (time, label, window) scores; inside a text a stretch borders on plain characters."""
        steps, n, size = e.shape
        d = np.empty((steps, n, size), dtype=np.float32)
        d[0] = e[0] + np.where(opens, np.float32(0), self.trans[0][:, None])
        for t in range(1, steps):
            for j in range(n):
                np.max(d[t - 1] + self.trans[:, j, None], axis=0, out=d[t, j])
            d[t] += e[t]
        path = np.empty((steps, size), dtype=np.int8)
        path[-1] = (d[-1] + np.where(closes, np.float32(0), self.trans[:, 0][:, None])).argmax(axis=0)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = (d[t - 1] + self.trans[:, path[t]]).argmax(axis=0)
        return path

    def tag(self, windows: list[np.ndarray], size: int = 768) -> list[np.ndarray]:
        """Labels of every window of codes; windows of like length share a batch."""
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(windows)
        for lo in range(0, len(order), size):
            part = order[lo : lo + size]
            batch = np.zeros((len(part), len(windows[part[-1]]) + 1), dtype=np.int32)
            for k, i in enumerate(part):
                batch[k, : len(windows[i])] = windows[i]
            for k, labels in enumerate(self.best(self.emissions(batch))):
                out[part[k]] = labels[: len(windows[part[k]])]
        return out


_LOADED: list[Tagger] = []


def load() -> Tagger:
    """The trained tagger, once per process; the weights travel inside the package."""
    if not _LOADED:
        raw = pkgutil.get_data(__package__, WEIGHTS)
        with np.load(io.BytesIO(raw)) as z:
            _LOADED.append(Tagger({k: z[k] for k in z.files}))
    return _LOADED[0]
