"""A small causal self-attention model in numpy: one head, one feed-forward layer, a softmax over token classes."""

from __future__ import annotations

import numpy as np

WIDTH = 32
#: A following window repeats so many tokens as context; they are not scored again.
CONTEXT = 8
DIM, HIDDEN = 16, 32

#: Most that a position's match with another may be: 40, and so little that nothing is left of it where the other is later.
_MOST = np.where(np.triu(np.ones((WIDTH, WIDTH), bool), 1), np.float32(-1e4), np.float32(40))


def start(symbols: int, classes: int, seed: int = 29) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    return {"e": normal(symbols, DIM, scale=0.3), "pos": normal(WIDTH, DIM, scale=0.1), "q": normal(DIM, DIM, scale=0.25), "k": normal(DIM, DIM, scale=0.25),
            "v": normal(DIM, DIM, scale=0.25), "o": normal(DIM, DIM, scale=0.1), "f1": normal(DIM, HIDDEN, scale=0.25), "b1": np.zeros(HIDDEN, np.float32),
            "f2": normal(HIDDEN, DIM, scale=0.1), "u": normal(DIM, classes, scale=0.1), "b": np.zeros(classes, np.float32)}


class Room:
    """Arrays that batch after batch is written into; a batch of any size takes the first numbers of each."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, like: np.ndarray, *shape: int) -> np.ndarray:
        size, have = int(np.prod(shape)), self.held.get(name)
        if have is None or len(have) < size or have.dtype != like.dtype:
            have = self.held[name] = np.empty(size, like.dtype)
        return have[:size].reshape(shape)


def projections(p: dict) -> np.ndarray:
    """Queries (scaled), keys and values of a position by one product."""
    return np.concatenate([p["q"] * np.asarray(DIM ** -0.5, p["q"].dtype), p["k"], p["v"]], 1)


def forward(p: dict, x: np.ndarray, first: int = 0, room: Room | None = None) -> tuple[np.ndarray, tuple]:
    """Class logits at the positions from ``first`` on of windows x (rows of symbols), a row per window and position.

    All products but those of attention itself run over the positions of all windows at once.
    """
    e, room = p["e"], room or Room()
    n, t, d = *x.shape, DIM
    s = t - first
    h0 = np.take(e, x, 0, out=room("h0", e, n, t, d), mode="clip")
    h0 += p["pos"]
    qkv = np.matmul(h0.reshape(-1, d), projections(p), out=room("qkv", e, n * t, 3 * d)).reshape(n, t, 3 * d)
    a = np.matmul(qkv[:, first:, :d], qkv[:, :, d:2 * d].transpose(0, 2, 1), out=room("a", e, n, s, t))
    np.minimum(a, _MOST[first:], out=a)
    np.exp(a, out=a)
    share = 1 / (a.reshape(-1, t) @ np.ones(t, e.dtype))[:, None]
    mixed = np.matmul(a, qkv[:, :, 2 * d:], out=room("mixed", e, n, s, d)).reshape(-1, d)
    mixed *= share
    h1 = np.matmul(mixed, p["o"], out=room("h1", e, n * s, d))
    h1.reshape(n, s, d)[:] += h0[:, first:]
    g = np.matmul(h1, p["f1"], out=room("g", e, n * s, HIDDEN))
    g += p["b1"]
    np.maximum(g, 0, out=g)
    h2 = np.matmul(g, p["f2"], out=room("h2", e, n * s, d))
    h2 += h1
    z = np.matmul(h2, p["u"], out=room("z", e, n * s, len(p["b"])))
    z += p["b"]
    np.clip(z, -60, 60, out=z)
    return z, (h0, qkv, a, share, mixed, h1, g, h2)


def log_probability(p: dict, x: np.ndarray, target: np.ndarray, first: int = 0, room: Room | None = None) -> np.ndarray:
    """Natural log probability of the target class at each position from ``first`` on."""
    z = forward(p, x, first, room)[0]
    wanted = target[:, first:]
    chosen = z.ravel()[np.arange(0, z.size, z.shape[1]) + wanted.ravel()]
    np.exp(z, out=z)
    return (chosen - np.log(z @ np.ones(z.shape[1], z.dtype))).reshape(wanted.shape)


def gradient(p: dict, x: np.ndarray, target: np.ndarray, weight: np.ndarray, first: int = 0, room: Room | None = None) -> dict[str, np.ndarray]:
    """Slopes of the weighted mean loss over the positions from ``first`` on."""
    e, room = p["e"], room or Room()
    z, (h0, qkv, a, share, mixed, h1, g, h2) = forward(p, x, first, room)
    n, t, d, m = *x.shape, DIM, len(z)
    s, out = t - first, {}
    part = (weight[:, first:] / max(weight[:, first:].sum(), 1)).ravel().astype(e.dtype)
    np.exp(z, out=z)
    z *= (part / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
    z.ravel()[np.arange(0, z.size, z.shape[1]) + target[:, first:].ravel()] -= part
    each = np.ones(m, e.dtype)
    out["u"], out["b"] = h2.T @ z, each @ z
    dh2 = np.matmul(z, p["u"].T, out=room("dh2", e, m, d))
    out["f2"] = g.T @ dh2
    dg = np.matmul(dh2, p["f2"].T, out=room("dg", e, m, HIDDEN))
    dg *= g > 0
    out["f1"], out["b1"] = h1.T @ dg, each @ dg
    dh1 = np.matmul(dg, p["f1"].T, out=room("dh1", e, m, d))
    dh1 += dh2
    out["o"] = mixed.T @ dh1
    dm = np.matmul(dh1, p["o"].T, out=room("dm", e, m, d))
    dm *= share
    level = np.einsum("ij,ij->i", dm, mixed)  # a row's share-weighted mean slope, without a pass over the attention
    dm = dm.reshape(n, s, d)
    ds = np.matmul(dm, qkv[:, :, 2 * d:].transpose(0, 2, 1), out=room("ds", e, n, s, t))
    ds -= level.reshape(n, s, 1)
    ds *= a
    dqkv = room("dqkv", e, n, t, 3 * d)
    dqkv[:, :first, :d] = 0
    np.matmul(ds, qkv[:, :, d:2 * d], out=dqkv[:, first:, :d])
    np.matmul(ds.transpose(0, 2, 1), qkv[:, first:, :d], out=dqkv[:, :, d:2 * d])
    np.matmul(a.transpose(0, 2, 1), dm, out=dqkv[:, :, 2 * d:])
    flat = dqkv.reshape(-1, 3 * d)
    both = h0.reshape(-1, d).T @ flat
    out["q"], out["k"], out["v"] = both[:, :d] * np.asarray(d ** -0.5, e.dtype), both[:, d:2 * d], both[:, 2 * d:]
    dh0 = np.matmul(flat, projections(p).T, out=room("dh0", e, n * t, d))
    dh0.reshape(n, t, d)[:, first:] += dh1.reshape(n, s, d)
    out["pos"] = (np.ones(n, e.dtype) @ dh0.reshape(n, -1)).reshape(t, d)
    out["e"] = row_sums(x.ravel(), dh0, len(e))
    return out


def row_sums(to: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that go to each of n places."""
    d = rows.shape[1]
    place = np.take(np.arange(n * d).reshape(n, d), to, 0)
    return np.bincount(place.ravel(), rows.ravel(), n * d).reshape(n, d).astype(rows.dtype)


class Adam:
    """The usual adaptive steps; of a parameter named in ``by_rows`` the given rows alone take one.

    All other arrays of ``p`` become views of one vector, so that a step is a few operations and not a few for each of them.
    """

    def __init__(self, p: dict, rate: float, by_rows: tuple[str, ...] = ()):
        self.rate, self.t, self.by_rows = rate, 0, by_rows
        self.names = [k for k in p if k not in by_rows]
        flat, at = np.concatenate([p[k].ravel() for k in self.names]), 0
        for k in self.names:
            size = p[k].size
            p[k], at = flat[at:at + size].reshape(p[k].shape), at + size
        self.states = {k: (v, np.zeros_like(v), np.zeros_like(v)) for k, v in [("", flat)] + [(k, p[k]) for k in by_rows]}

    def step(self, grads: dict[str, np.ndarray], rows: dict[str, np.ndarray] | None = None) -> None:
        self.t += 1
        scale = self.rate * (1 - 0.99 ** self.t) ** 0.5 / (1 - 0.9 ** self.t)
        self._move("", slice(None), np.concatenate([grads[k].ravel() for k in self.names]), scale)
        for k in self.by_rows:
            self._move(k, rows[k], grads[k], scale)

    def _move(self, key: str, at, g: np.ndarray, scale: float) -> None:
        value, firsts, seconds = self.states[key]
        first, second = firsts[at], seconds[at]
        change = g - first
        change *= 0.1
        first += change
        np.multiply(g, g, out=change)
        change -= second
        change *= 0.01
        second += change
        if not isinstance(at, slice):
            firsts[at], seconds[at] = first, second
        np.multiply(first, scale, out=change)
        root = np.sqrt(second)
        root += 1e-7
        change /= root
        value[at] -= change


def pack(p: dict) -> bytes:
    return b"".join(p[k].astype(np.float32).tobytes() for k in sorted(p))


def unpack(raw, like: dict) -> dict[str, np.ndarray]:
    flat, at, out = np.frombuffer(raw, np.float32), 0, {}
    for k in sorted(like):
        size = like[k].size
        out[k] = flat[at:at + size].reshape(like[k].shape).copy()
        at += size
    return out
