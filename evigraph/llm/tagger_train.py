"""Training of the character tagger: numpy BPTT under a CRF loss, Adam, labelled spans.

    python -m evigraph.llm.tagger_train OUT.npz [seconds] [weights to start from]

The sample is made by ``tagger_data`` from a fixed seed and bounded by ``TEXTS``.
"""

from __future__ import annotations

import sys
import time

import numpy as np

from evigraph.llm import tagger
from evigraph.llm.tagger import BUCKETS, CLASSES, LABELS, Tagger
from evigraph.llm.tagger_data import Maker

TEXTS = 60_000
HIDDEN, WIDTH = 20, 20
BATCH, STEPS = 96, 144


def example(maker: Maker) -> tuple[str, np.ndarray]:
    spans = maker.text()
    text = "".join(s for s, _ in spans)
    y = np.concatenate([np.full(len(s), LABELS.index(k), dtype=np.int8) for s, k in spans])
    return text, y


def sample(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    maker = Maker(seed)
    out = []
    while len(out) < n:
        text, y = example(maker)
        c = tagger.codes(text)
        for lo in range(0, len(c), STEPS - 16):
            out.append((c[lo : lo + STEPS], y[lo : lo + STEPS]))
            if lo + STEPS >= len(c):
                break
    return out


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    n = len(LABELS)
    g = lambda *s, scale=0.1: r.normal(0, scale, s).astype(np.float32)
    b = np.zeros(8 * HIDDEN, dtype=np.float32)
    b[HIDDEN : 2 * HIDDEN] = b[5 * HIDDEN : 6 * HIDDEN] = 2.0  # remember at first
    return {"own": g(BUCKETS, WIDTH, scale=0.3), "joint": g(CLASSES * BUCKETS, WIDTH, scale=0.1), "w": g(WIDTH, 8 * HIDDEN, scale=0.25), "b": b, "u": g(2, HIDDEN, 4 * HIDDEN, scale=0.2), "v": g(2 * HIDDEN, n, scale=0.2), "c": np.zeros(n, np.float32), "trans": np.zeros((n, n), np.float32)}


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)


def crf(e: np.ndarray, trans: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss and gradients; e is (time, batch, label), y and mask (time, batch); masks are prefixes."""
    steps, size, n = e.shape
    alpha = np.empty_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        a = _lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        alpha[t] = np.where(mask[t][:, None], a, alpha[t - 1])
    z = _lse(alpha[-1], 1)
    beta = np.zeros_like(e)
    de, dt = np.zeros_like(e), np.zeros_like(trans)
    every = np.arange(size)
    for t in range(steps - 1, -1, -1):
        if t < steps - 1:
            nxt = trans + (e[t + 1] + beta[t + 1])[:, None, :]
            b = _lse(nxt, 2)
            on = mask[t + 1]
            beta[t] = np.where(on[:, None], b, 0)
            pair = np.exp(alpha[t][:, :, None] + nxt - z[:, None, None]) * on[:, None, None]
            dt += pair.sum(0)
            np.add.at(dt, (y[t][on], y[t + 1][on]), -1)
        de[t] = np.exp(alpha[t] + beta[t] - z[:, None]) * mask[t][:, None]
        de[t][every[mask[t]], y[t][mask[t]]] -= 1
    gold = (np.take_along_axis(e, y[..., None], 2)[..., 0] * mask).sum(0) + (trans[y[:-1], y[1:]] * mask[1:]).sum(0)
    return float((z - gold).mean()), de / size, dt / size


def step(w: dict[str, np.ndarray], batch: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, dict[str, np.ndarray]]:
    size, steps, hid = len(batch), max(len(c) for c, _ in batch) + 1, HIDDEN
    x, y, mask = np.zeros((steps, size), np.int64), np.zeros((steps, size), np.int64), np.zeros((steps, size), bool)
    for k, (c, lab) in enumerate(batch):
        x[: len(c), k], y[: len(c), k], mask[: len(c), k] = c, lab, True
    emb = w["own"][x % BUCKETS] + w["joint"][x]
    proj = emb @ w["w"] + w["b"]
    # both directions step together, the second over reversed time
    p = np.stack([proj[..., : 4 * hid], proj[::-1, :, 4 * hid :]], axis=1)
    h, c = np.zeros((2, size, hid), np.float32), np.zeros((2, size, hid), np.float32)
    hs, cs, zs, ss, gs, tc = [], [], [], [], [], []
    for t in range(steps):
        zt = p[t] + h @ w["u"]
        s, g = tagger.gates_of(zt[..., : 3 * hid]), tagger.squash(zt[..., 3 * hid :])
        hs.append(h)
        cs.append(c)
        zs.append(zt[..., 3 * hid :])
        c = s[..., hid : 2 * hid] * c + s[..., :hid] * g
        th = tagger.squash(c)
        h = s[..., 2 * hid :] * th
        ss.append(s)
        gs.append(g)
        tc.append((th, tagger.squash_slope(c)))
    out = np.stack(hs[1:] + [h])
    both = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)
    loss, de, dtrans = crf(both @ w["v"] + w["c"], w["trans"], y, mask)
    grad = {"trans": dtrans, "c": de.sum((0, 1)), "v": both.reshape(-1, 2 * hid).T @ de.reshape(-1, de.shape[2])}
    dboth = de @ w["v"].T
    dout = np.stack([dboth[..., :hid], dboth[::-1, :, hid:]], axis=1)
    dh, dc = np.zeros((2, size, hid), np.float32), np.zeros((2, size, hid), np.float32)
    dz_all = np.empty((steps, 2, size, 4 * hid), np.float32)
    back = np.ascontiguousarray(w["u"].transpose(0, 2, 1))
    for t in range(steps - 1, -1, -1):
        s, g, (th, slope) = ss[t], gs[t], tc[t]
        dh_t = dout[t] + dh
        dc_t = dc + dh_t * s[..., 2 * hid :] * slope
        ds = np.concatenate([dc_t * g, dc_t * cs[t], dh_t * th], axis=2)
        dz = dz_all[t]
        dz[..., : 3 * hid] = ds * 0.25 * ((s > 0) & (s < 1))
        dz[..., 3 * hid :] = dc_t * s[..., :hid] * tagger.squash_slope(zs[t])
        dc = dc_t * s[..., hid : 2 * hid]
        dh = dz @ back
    held = np.stack(hs)
    du = np.stack([held[:, d].reshape(-1, hid).T @ dz_all[:, d].reshape(-1, 4 * hid) for d in range(2)])
    dproj = np.concatenate([dz_all[:, 0], dz_all[::-1, 1]], axis=2)
    flat = dproj.reshape(-1, 8 * hid)
    demb = flat @ w["w"].T
    grad |= {"u": du, "b": flat.sum(0), "w": emb.reshape(-1, WIDTH).T @ flat}
    idx = x.reshape(-1)
    order = np.argsort(idx, kind="stable")
    rows, at = np.unique(idx[order], return_index=True)
    grad["joint"] = np.zeros_like(w["joint"])
    grad["joint"][rows] = np.add.reduceat(demb[order], at, axis=0)
    grad["own"] = grad["joint"].reshape(CLASSES, BUCKETS, WIDTH).sum(0)
    return loss, grad


def train(seconds: float = 420, seed: int = 7, log: bool = True, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Weights after so many seconds, from ``start`` if given."""
    data, held = sample(TEXTS, seed), sample(1500, seed + 1)
    w = initial(seed) if start is None else {k: np.asarray(x, dtype=np.float32) for k, x in start.items()}
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    r = np.random.default_rng(seed)
    began, n, mean = time.time(), 0, 0.0
    while (spent := time.time() - began) < seconds:
        pick = r.integers(0, len(data) - BATCH * 4)
        pool = sorted((data[i] for i in r.integers(0, len(data), BATCH * 4)), key=lambda d: len(d[0])) if pick >= 0 else []
        for lo in range(0, len(pool), BATCH):
            loss, grad = step(w, pool[lo : lo + BATCH])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = min(1.0, 5.0 / (norm + 1e-9))
            n += 1
            rate = 0.006 * max(0.03, 1 - spent / seconds) * min(1, n / 100)
            for k, g in grad.items():
                g = g * scale
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w[k] = w[k] - (rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-7)).astype(np.float32)
            mean = loss if n == 1 else 0.98 * mean + 0.02 * loss
            if log and n % 200 == 0:
                print(n, round(spent), round(mean, 3), flush=True)
    if log:
        print(accuracy(w, held))
    return w


def accuracy(w: dict[str, np.ndarray], held: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, float]:
    """Per label: share of characters right, and share of found characters that are right."""
    got = Tagger(w).tag([c for c, _ in held])
    y, p = np.concatenate([y for _, y in held]), np.concatenate(got)
    return {f"{k} {what}": round(float(((p == i) & (y == i)).sum() / max(1, (d == i).sum())), 4) for i, k in enumerate(LABELS) for what, d in (("recall", y), ("precision", p))}


def save(w: dict[str, np.ndarray], path: str) -> None:
    np.savez_compressed(path, **{k: x.astype(np.float16 if k in ("own", "joint") else np.float32) for k, x in w.items()})


if __name__ == "__main__":
    begin = dict(np.load(sys.argv[3])) if len(sys.argv) > 3 else None
    save(train(float(sys.argv[2]) if len(sys.argv) > 2 else 420, start=begin), sys.argv[1])
