"""Plain numpy versions of the trainers, for small inputs."""

import hashlib
import math

import numpy as np


def word(key: str, position: int = 0) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[8 * position : 8 * position + 8], 16)


def draws(n_rows: int, batch: int, t: int, seed: int = 42) -> list[int]:
    wide = lambda key: word(key) * 2**30 + word(key, 1) % 2**30
    return [wide(f"{seed}:{t}:{slot}") % n_rows for slot in range(batch)]


def gauss(*parts, scale=0.01) -> float:
    key = ":".join(str(p) for p in parts)
    u = [(word(key, p) + 1.0) / 4294967297.0 for p in (0, 1)]
    return scale * math.sqrt(-2 * math.log(u[0])) * math.cos(2 * math.pi * u[1])


def dense(rows, features):
    x = np.zeros((len(rows), features))
    for i, (_, cells) in enumerate(rows):
        for f, v in cells.items():
            x[i, f] = v
    return x, np.array([float(y) for y, _ in rows])


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_and_grad(kind, w, x, y):
    """Summed loss and its gradient; ``w`` has one row per feature."""
    sign = 2 * y - 1
    if kind == "lr":
        s = x @ w[:, 0]
        c = -sign / (1 + np.exp(sign * s))
        return np.logaddexp(0, -sign * s).sum(), (x.T @ c)[:, None]
    if kind == "svm":
        s = x @ w[:, 0]
        c = np.where(sign * s < 1, -sign, 0.0)
        return np.maximum(0, 1 - sign * s).sum(), (x.T @ c)[:, None]
    if kind == "mlr":
        p = softmax(x @ w)
        one = np.eye(w.shape[1])[y.astype(int)]
        return -np.log((p * one).sum(axis=1)).sum(), x.T @ (p - one)
    v = w[:, 1:]
    sums = x @ v
    score = x @ w[:, 0] + 0.5 * ((sums**2).sum(axis=1) - (x**2 @ v**2).sum(axis=1))
    c = -sign / (1 + np.exp(sign * score))
    grad_v = (x * c[:, None]).T @ sums - v * ((x**2).T @ c)[:, None]
    return np.logaddexp(0, -sign * score).sum(), np.hstack([(x.T @ c)[:, None], grad_v])


def train(kind, rows, features, batch, iterations, step, reg, k=1, adam=False, seed=42):
    x, y = dense(rows, features)
    w = np.zeros((features, k))
    if kind == "fm":
        for f in range(features):
            for j in range(1, k):
                w[f, j] = gauss(seed, f, j)
    m, v = np.zeros_like(w), np.zeros_like(w)
    losses = []
    for t in range(iterations):
        picked = draws(len(rows), batch, t, seed)
        loss, g = loss_and_grad(kind, w, x[picked], y[picked])
        losses.append(loss / batch)
        w = w * (1 - reg)
        if not adam:
            w = w - step / batch * g
            continue
        m, v = m * (1 - reg), v * (1 - reg)
        moved = g != 0
        g = g / batch
        m = np.where(moved, 0.9 * m + 0.1 * g, m)
        v = np.where(moved, 0.99 * v + 0.01 * g * g, v)
        change = step / (np.sqrt(v / (1 - 0.99 ** (t + 1))) + 1e-7) * m / (1 - 0.9 ** (t + 1))
        w = np.where(moved, w - change, w)
    return w, losses


def train_mlp(rows, features, hidden, classes, batch, iterations, step, seed=42):
    x, y = dense(rows, features)
    w1 = np.array([[gauss(seed, 0, i, j) for j in range(hidden)] for i in range(features)])
    w2 = np.array([[gauss(seed, 1, i, j) for j in range(classes)] for i in range(hidden)])
    seen = []
    for t in range(iterations):
        picked = draws(len(rows), batch, t, seed)
        xb, one = x[picked], np.eye(classes)[y[picked].astype(int)]
        h = 1 / (1 + np.exp(-xb @ w1))
        p = softmax(h @ w2)
        own = (p * one).sum(axis=1)
        seen.append((-np.log(own).mean(), (own >= p.max(axis=1)).mean()))
        d2 = p - one
        d1 = (d2 @ w2.T) * h * (1 - h)
        w1, w2 = w1 - step / batch * xb.T @ d1, w2 - step / batch * h.T @ d2
    return w1, w2, seen


def train_layers(rows, sizes, batch, iterations, step, reg=0.0, adam=False, seed=42):
    x, y = dense(rows, sizes[0])
    weights = [np.array([[gauss(seed, n, i, j) for j in range(b)] for i in range(a)]) for n, (a, b) in enumerate(zip(sizes, sizes[1:]))]
    moments, seen = [(np.zeros_like(w), np.zeros_like(w)) for w in weights], []
    for t in range(iterations):
        picked = draws(len(rows), batch, t, seed)
        acts, one = [x[picked]], np.eye(sizes[-1])[y[picked].astype(int)]
        for w in weights[:-1]:
            acts.append(1 / (1 + np.exp(-acts[-1] @ w)))
        p = softmax(acts[-1] @ weights[-1])
        own = (p * one).sum(axis=1)
        seen.append((-np.log(own).mean(), (own >= p.max(axis=1)).mean()))
        delta, grads = p - one, []
        for h, w in zip(acts[::-1], weights[::-1]):
            grads.append(h.T @ delta)
            delta = (delta @ w.T) * h * (1 - h)
        for n, g in enumerate(grads[::-1]):
            w = weights[n] * (1 - reg)
            if adam:
                moved, (m, v) = g != 0, (z * (1 - reg) for z in moments[n])
                m, v = np.where(moved, 0.9 * m + 0.1 * g / batch, m), np.where(moved, 0.99 * v + 0.01 * (g / batch) ** 2, v)
                change = step / (np.sqrt(v / (1 - 0.99 ** (t + 1))) + 1e-7) * m / (1 - 0.9 ** (t + 1))
                weights[n], moments[n] = np.where(moved, w - change, w), (m, v)
            else:
                weights[n] = w - step / batch * g
    return weights, seen


def mlp_loss(w1, w2, x, y):
    p = softmax(1 / (1 + np.exp(-x @ w1)) @ w2)
    return -np.log(p[np.arange(len(y)), y.astype(int)]).sum()


def pagerank(edges, tol=0.001, reset=0.15):
    vertices = sorted({v for e in edges for v in e})
    out = {v: [d for s, d in edges if s == v] for v in vertices}
    rank = {v: reset for v in vertices}
    delta = dict(rank)
    while any(abs(d) > tol for d in delta.values()):
        gained = {v: 0.0 for v in vertices}
        for v, d in delta.items():
            if abs(d) > tol:
                for target in out[v]:
                    gained[target] += (1 - reset) * d / len(out[v])
        rank = {v: rank[v] + gained[v] for v in vertices}
        delta = gained
    scale = len(vertices) / sum(rank.values())
    return {v: r * scale for v, r in rank.items()}
