"""A bidirectional gated recurrent network over bytes, in numpy: training by backpropagation through time, and labelling.

Bytes enter through a table, which is the input matrix times a one-hot byte. Both directions see every
position; a position's class scores are a linear map of the two hidden states there.
"""

from __future__ import annotations

import numpy as np

#: Number of the padding symbol behind the 256 bytes.
PAD = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One GRU: reset and update gates r, z and candidate n = tanh(x + r (U h + c)); h' = n + z (h - n)."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.hidden = hidden
        self.p = {
            "x": (rng.standard_normal((257, 3 * hidden)) * 0.3).astype(np.float32),
            "u": np.concatenate([np.linalg.qr(rng.standard_normal((hidden, hidden)))[0] for _ in range(3)], axis=1).astype(np.float32),
            "b": np.zeros(3 * hidden, np.float32),
        }
        self.p["b"][hidden : 2 * hidden] = 1.0

    def forward(self, symbols: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states (T, B, H) for symbols (T, B), and what the way back needs."""
        h_n, (steps, batch) = self.hidden, symbols.shape
        x, u, b = self.p["x"], self.p["u"], self.p["b"]
        states, kept = np.zeros((steps + 1, batch, h_n), np.float32), []
        for t in range(steps):
            h = states[t]
            xa, ua = x[symbols[t]], h @ u
            rz = _sigmoid(xa[:, : 2 * h_n] + ua[:, : 2 * h_n] + b[: 2 * h_n])
            r, z = rz[:, :h_n], rz[:, h_n:]
            v = ua[:, 2 * h_n :] + b[2 * h_n :]
            n = np.tanh(xa[:, 2 * h_n :] + r * v)
            states[t + 1] = n + z * (h - n)
            kept.append((r, z, v, n))
        return states, kept

    def backward(self, symbols: np.ndarray, states: np.ndarray, kept: list, into: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the parameters, from those of the hidden states (T, B, H)."""
        h_n, (steps, batch) = self.hidden, symbols.shape
        u = self.p["u"]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        gates = np.empty((steps, batch, 3 * h_n), np.float32)
        inner = np.empty((steps, batch, 3 * h_n), np.float32)
        back = np.zeros((batch, h_n), np.float32)
        for t in range(steps - 1, -1, -1):
            r, z, v, n = kept[t]
            h, dh = states[t], into[t] + back
            dn = dh * (1 - z) * (1 - n * n)
            da = gates[t]
            da[:, :h_n] = dn * v * r * (1 - r)
            da[:, h_n : 2 * h_n] = dh * (h - n) * z * (1 - z)
            da[:, 2 * h_n :] = dn
            di = inner[t]
            di[:, : 2 * h_n] = da[:, : 2 * h_n]
            di[:, 2 * h_n :] = dn * r
            back = dh * z + di @ u.T
        flat = inner.reshape(-1, 3 * h_n)
        g["u"] = states[:steps].reshape(-1, h_n).T @ flat
        g["b"] = flat.sum(0)
        order = np.argsort(symbols.ravel(), kind="stable")
        sorted_symbols = symbols.ravel()[order]
        starts = np.flatnonzero(np.r_[True, sorted_symbols[1:] != sorted_symbols[:-1]])
        g["x"][sorted_symbols[starts]] = np.add.reduceat(gates.reshape(-1, 3 * h_n)[order], starts, axis=0)
        return g

    def gates(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Tables and matrices of r, z and n apart, each contiguous; the bias is in the tables, but for that of n, which the reset gate takes too."""
        h_n, x, u, b = self.hidden, self.p["x"], self.p["u"], self.p["b"]
        cut = [slice(i * h_n, (i + 1) * h_n) for i in range(3)]
        return [x[:, c] + (b[c] if i < 2 else 0) for i, c in enumerate(cut)], [np.ascontiguousarray(u[:, c]) for c in cut]

    def label(self, symbols: np.ndarray, head: np.ndarray, reverse: bool) -> np.ndarray:
        """This direction's class scores (T, B, C)."""
        h_n, (steps, batch) = self.hidden, symbols.shape
        (xr, xz, xn), (ur, uz, un) = self.gates()
        xr, xz, ur, uz = (a * np.float32(0.5) for a in (xr, xz, ur, uz))
        c = self.p["b"][2 * h_n :]
        states = np.empty((steps, batch, h_n), np.float32)
        h, a, r, z, n = (np.zeros((batch, h_n), np.float32) for _ in range(5))
        for t in range(steps - 1, -1, -1) if reverse else range(steps):
            for gate, x, u in ((r, xr, ur), (z, xz, uz)):
                np.matmul(h, u, out=gate)
                np.take(x, symbols[t], axis=0, out=a, mode="clip")
                gate += a
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
            np.matmul(h, un, out=n)
            n += c
            n *= r
            np.take(xn, symbols[t], axis=0, out=a, mode="clip")
            n += a
            np.tanh(n, out=n)
            h -= n
            h *= z
            h += n
            states[t] = h
        return (states.reshape(-1, h_n) @ head).reshape(steps, batch, -1)


class BiGRU:
    """Labels every position of byte sequences with one of `classes`."""

    def __init__(self, classes: list[str], hidden: int = 24, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes, self.hidden = list(classes), hidden
        self.ways = [Direction(hidden, rng), Direction(hidden, rng)]
        self.head = (rng.standard_normal((2 * hidden, len(classes))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*(v for w in self.ways for v in w.p.values()), self.head, self.bias]

    def gradients(self, symbols: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the positions of `symbols` (T, B) that have a label (T, B; -1: none), and its gradients."""
        h_n, (steps, batch) = self.hidden, symbols.shape
        flipped = symbols[::-1]
        fs, fk = self.ways[0].forward(symbols)
        bs, bk = self.ways[1].forward(flipped)
        both = np.concatenate([fs[1:], bs[1:][::-1]], axis=2).reshape(steps * batch, 2 * h_n)
        scores = both @ self.head + self.bias
        scores -= scores.max(1, keepdims=True)
        e = np.exp(scores)
        prob = e / e.sum(1, keepdims=True)
        flat = labels.ravel()
        used = np.flatnonzero(flat >= 0)
        loss = float(-np.log(prob[used, flat[used]] + 1e-12).mean())
        d = np.zeros_like(prob)
        d[used] = prob[used]
        d[used, flat[used]] -= 1
        d /= max(1, len(used))
        dh = (d @ self.head.T).reshape(steps, batch, 2 * h_n)
        a = self.ways[0].backward(symbols, fs, fk, dh[:, :, :h_n])
        b = self.ways[1].backward(flipped, bs, bk, dh[::-1, :, h_n:])
        return loss, [*a.values(), *b.values(), both.T @ d, d.sum(0)]

    def fit(self, draw, steps: int, rate: float = 0.02, clip: float = 1.0) -> list[float]:
        """Adam with a rate that falls to zero; draw(k) gives the k-th batch. The losses of all steps."""
        params = self.parameters()
        m, v, losses = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], []
        for k in range(steps):
            loss, grads = self.gradients(*draw(k))
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
            lr = rate * min(1.0, (k + 1) / 20) * (1 - k / steps)
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                g = g * min(1.0, clip / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= lr * (a / (1 - 0.9 ** (k + 1))) / (np.sqrt(b / (1 - 0.99 ** (k + 1))) + 1e-8)
            losses.append(loss)
        return losses

    def probabilities(self, symbols: np.ndarray) -> np.ndarray:
        """(T, B, C) for symbols (T, B)."""
        into = self.ways[0].label(symbols, np.ascontiguousarray(self.head[: self.hidden]), False)
        into += self.ways[1].label(symbols, np.ascontiguousarray(self.head[self.hidden :]), True)
        into += self.bias
        if np.abs(self.head).sum(0).max() + np.abs(self.bias).max() > 60:  # states lie within -1 and 1, so smaller scores can't overflow
            into -= into.max(2, keepdims=True)
        np.exp(into, out=into)
        flat = into.reshape(-1, len(self.classes))
        flat /= (flat @ np.ones(len(self.classes), np.float32))[:, None]
        return into

    def state(self) -> dict:
        return {"classes": self.classes, "hidden": self.hidden, "parameters": self.parameters()}

    @staticmethod
    def of(state: dict) -> BiGRU:
        net = BiGRU(state["classes"], state["hidden"])
        for p, q in zip(net.parameters(), state["parameters"], strict=True):
            p[...] = q
        return net
