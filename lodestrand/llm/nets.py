"""Small recurrent networks in numpy: gated recurrent and LSTM layers with backpropagation, and Adam."""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru(x: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states (B, T, H) of inputs x (B, T, 3H: update, reset, new), recurrent weights u (H, 3H).

    Where mask is 0 the state is zero, so that padding at either end changes nothing.
    """
    n, t, h3 = x.shape
    k = h3 // 3
    h, out, past = np.zeros((n, k), F32), np.empty((n, t, k), F32), []
    for i in range(t):
        a = h @ u
        zr = sigmoid(x[:, i, : 2 * k] + a[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        c = np.tanh(x[:, i, 2 * k :] + r * a[:, 2 * k :])
        new = c + z * (h - c)
        if mask is not None:
            new *= mask[:, i, None]
        if keep:
            past.append((h, z, r, c, a[:, 2 * k :]))
        h = new
        out[:, i] = h
    return out, past


def gru_back(dout: np.ndarray, u: np.ndarray, mask: np.ndarray | None, past: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u, given that of the hidden states."""
    n, t, k = dout.shape
    dx, du, dh = np.empty((n, t, 3 * k), F32), np.zeros_like(u), np.zeros((n, k), F32)
    for i in reversed(range(t)):
        h, z, r, c, an = past[i]
        d = dh + dout[:, i]
        if mask is not None:
            d = d * mask[:, i, None]
        dc = d * (1 - z) * (1 - c * c)
        dz = d * (h - c) * z * (1 - z)
        dr = dc * an * r * (1 - r)
        da = np.concatenate([dz, dr, dc * r], axis=1)
        dx[:, i] = np.concatenate([dz, dr, dc], axis=1)
        du += h.T @ da
        dh = d * z + da @ u.T
    return dx, du


def lstm(x: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states (B, T, H) of inputs x (B, T, 4H: in, forget, out, new), recurrent weights u (H, 4H)."""
    n, t, h4 = x.shape
    k = h4 // 4
    h, c, out, past = np.zeros((n, k), F32), np.zeros((n, k), F32), np.empty((n, t, k), F32), []
    for i in range(t):
        a = x[:, i] + h @ u
        s = sigmoid(a[:, : 3 * k])
        g = np.tanh(a[:, 3 * k :])
        new = s[:, k : 2 * k] * c + s[:, :k] * g
        if mask is not None:
            new *= mask[:, i, None]
        q = np.tanh(new)
        if keep:
            past.append((h, c, s, g, q))
        h, c = s[:, 2 * k : 3 * k] * q, new
        out[:, i] = h
    return out, past


def lstm_back(dout: np.ndarray, u: np.ndarray, mask: np.ndarray | None, past: list) -> tuple[np.ndarray, np.ndarray]:
    n, t, k = dout.shape
    dx, du = np.empty((n, t, 4 * k), F32), np.zeros_like(u)
    dh, dc = np.zeros((n, k), F32), np.zeros((n, k), F32)
    for i in reversed(range(t)):
        h, c, s, g, q = past[i]
        d = dh + dout[:, i]
        e = dc + d * s[:, 2 * k :] * (1 - q * q)
        if mask is not None:
            e = e * mask[:, i, None]
        ds = np.concatenate([e * g, e * c, d * q], axis=1) * s * (1 - s)
        da = np.concatenate([ds, e * s[:, :k] * (1 - g * g)], axis=1)
        dx[:, i] = da
        du += h.T @ da
        dh = da @ u.T
        dc = e * s[:, k : 2 * k]
    return dx, du


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 5e-3):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], clip: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, clip / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= (self.rate * self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(F32)


def uniform(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return rng.uniform(-1, 1, shape).astype(F32) * F32(np.sqrt(3 / shape[0]))
