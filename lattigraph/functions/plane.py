"""Dense numerics of one cluster: stress majorisation, force layouts, boxes. They run inside one group's task, so
the number of points is bounded by the cluster size."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np


def distances(x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def isotonic(y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The non-decreasing sequence closest to ``y``: pooling adjacent violators."""
    value, weight, count = [], [], []
    for v, u in zip(y, np.ones(len(y)) if w is None else w):
        value.append(float(v))
        weight.append(float(u))
        count.append(1)
        while len(value) > 1 and value[-2] > value[-1]:
            v2, w2, c2 = value.pop(), weight.pop(), count.pop()
            value[-1] = (value[-1] * weight[-1] + v2 * w2) / (weight[-1] + w2)
            weight[-1] += w2
            count[-1] += c2
    return np.repeat(value, count)


def smacof(d: np.ndarray, w: np.ndarray, seed: int = 0, init: np.ndarray | None = None, max_iter: int = 300, eps: float = 1e-3, metric: bool = True, rule: str = "relative") -> tuple[np.ndarray, float, int]:
    """(positions, stress, iterations) of weighted stress majorisation: X <- V+ B(X) X.

    ``rule``: "relative" stops when the stress over the sum of norms falls by less than ``eps``; "absolute" when the stress over the
    sum of weights does, and keeps the last improving step."""
    n = len(d)
    x = np.random.default_rng(seed).random((n, 2)) if init is None else np.array(init, float)
    if n <= 1:
        return np.zeros((n, 2)), 0.0, 0
    v = -w.astype(float)
    np.fill_diagonal(v, w.sum(1) - np.diag(w))
    inverse = np.linalg.pinv(v)
    total = w[np.triu_indices(n, 1)].sum()
    old, stress, it = None, 0.0, 0
    upper = np.triu_indices(n, 1)
    order = np.argsort(d[upper], kind="stable")
    for it in range(1, max_iter + 1):
        dist = distances(x)
        target = d
        if not metric:
            fitted = np.empty(len(order))
            fitted[order] = isotonic(dist[upper][order])
            target = np.zeros_like(dist)
            target[upper] = fitted
            target = target + target.T
            target *= math.sqrt(n * (n - 1) / 2 / max((target**2).sum() / 2, 1e-300))
        stress = float((w * (dist - target) ** 2).sum() / 2)
        if rule == "absolute" and old is not None and abs(old - stress / total) < eps:
            break
        ratio = w * target / np.where(dist == 0, 1e-5, dist)
        np.fill_diagonal(ratio, 0.0)
        b = -ratio
        np.fill_diagonal(b, ratio.sum(1))
        x = inverse @ (b @ x)
        scaled = stress / total if rule == "absolute" else stress / max(np.sqrt((x**2).sum(1)).sum(), 1e-300)
        if rule == "relative" and old is not None and old - scaled < eps:
            break
        old = scaled
    return x, stress, it


def best_smacof(d: np.ndarray, w: np.ndarray, seed: int = 0, n_init: int = 4, **how) -> tuple[np.ndarray, float, int]:
    """The run of least stress among ``n_init`` seeded starts."""
    return min((smacof(d, w, seed + i, **how) for i in range(n_init)), key=lambda r: r[1])


def adjacency(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    a = np.zeros((n, n))
    np.add.at(a, (src, dst), np.ones(len(src)) if w is None else w)
    return np.maximum(a, a.T)


def fruchterman_reingold(a: np.ndarray, seed: int = 0, steps: int = 100) -> np.ndarray:
    n = len(a)
    x = np.random.default_rng(seed).random((n, 2))
    k, heat = math.sqrt(1 / max(n, 1)), 0.1
    for _ in range(steps):
        delta = x[:, None] - x[None]
        dist = np.maximum(np.sqrt((delta**2).sum(-1)), 0.01)
        force = (delta * (k * k / dist**2 - a * dist / k)[..., None]).sum(1)
        length = np.maximum(np.sqrt((force**2).sum(1)), 1e-12)
        x = x + force / length[:, None] * np.minimum(length, heat)[:, None]
        heat -= 0.1 / (steps + 1)
    return x


def force_atlas(a: np.ndarray, seed: int = 0, steps: int = 700, scaling: float = 2.0, gravity: float = 0.0, linlog: bool = False) -> np.ndarray:
    """Degree-weighted repulsion, linear or logarithmic attraction, speed by local swinging."""
    n = len(a)
    x = np.random.default_rng(seed).random((n, 2)) * 10
    mass = 1 + (a > 0).sum(1)
    before, speed = np.zeros((n, 2)), 1.0
    for _ in range(steps):
        delta = x[:, None] - x[None]
        dist2 = np.maximum((delta**2).sum(-1), 1e-9)
        push = scaling * mass[:, None] * mass[None] / dist2
        np.fill_diagonal(push, 0)
        pull = a * (np.log1p(np.sqrt(dist2)) / np.sqrt(dist2) if linlog else 1.0)
        force = (delta * (push - pull)[..., None]).sum(1) - gravity * mass[:, None] * x / np.maximum(np.sqrt((x**2).sum(1)), 1e-9)[:, None]
        swing = np.sqrt(((force - before) ** 2).sum(1))
        traction = np.sqrt(((force + before) ** 2).sum(1)) / 2
        total_swing, total_traction = (mass * swing).sum(), (mass * traction).sum()
        speed = min(speed * 1.5, total_traction / max(total_swing, 1e-12)) if total_swing > 0 else speed
        x = x + force * (speed / (1 + np.sqrt(speed * swing)))[:, None] * 0.1
        before = force
    return x


def hop_matrix(a: np.ndarray, sources: np.ndarray | None = None) -> np.ndarray:
    """Hops from each source to each node; inf where there is no way."""
    n = len(a)
    sources = np.arange(n) if sources is None else sources
    out = np.full((len(sources), n), np.inf)
    out[np.arange(len(sources)), sources] = 0
    front, link = out == 0, a > 0
    h = 0
    while front.any():
        h += 1
        front = (front.astype(float) @ link > 0) & np.isinf(out)
        out[front] = h
    return out


def pivot_mds(a: np.ndarray, pivots: int = 50, seed: int = 0) -> np.ndarray:
    """The two leading axes of doubly centred squared hops to spread-out pivots."""
    n = len(a)
    chosen = [int(np.random.default_rng(seed).integers(n))]
    hops = hop_matrix(a, np.array(chosen))
    while len(chosen) < min(pivots, n):
        near = np.where(np.isinf(hops), n, hops).min(0)
        nxt = int(np.argmax(near))
        if near[nxt] == 0:
            break
        chosen.append(nxt)
        hops = np.vstack([hops, hop_matrix(a, np.array([nxt]))])
    far = np.isinf(hops)
    d2 = np.where(far, (hops[~far].max() + 1 if (~far).any() else 1), hops).T ** 2
    c = -0.5 * (d2 - d2.mean(0) - d2.mean(1)[:, None] + d2.mean())
    _, vectors = np.linalg.eigh(c.T @ c)
    axes = c @ vectors[:, ::-1][:, :2]
    return np.pad(axes, ((0, 0), (0, 2 - axes.shape[1])))


def maxent_stress(a: np.ndarray, seed: int = 0, steps: int = 100, alpha: float = 0.01) -> np.ndarray:
    """Stress on the edges, with an entropy term that spreads all other pairs."""
    n = len(a)
    x = np.random.default_rng(seed).random((n, 2))
    link = a > 0
    rho = link.sum(1)
    for i in range(steps):
        delta = x[:, None] - x[None]
        dist = np.maximum(np.sqrt((delta**2).sum(-1)), 1e-3)
        near = (link[..., None] * (x[None] + delta / dist[..., None])).sum(1)
        away = ((~link)[..., None] * delta / dist[..., None] ** 2).sum(1)
        x = np.where(rho[:, None] > 0, (near + alpha * 0.7 ** (i // 20) * away) / np.maximum(rho, 1)[:, None], x + alpha * away)
    return x


def eigenmap(a: np.ndarray) -> np.ndarray:
    """Laplacian eigenmaps: the two smallest non-trivial eigenvectors."""
    deg = np.maximum(a.sum(1), 1e-12)
    root = 1 / np.sqrt(deg)
    _, v = np.linalg.eigh(np.eye(len(a)) - root[:, None] * a * root[None])
    return np.pad(root[:, None] * v[:, 1:3], ((0, 0), (0, max(0, 3 - len(a)))))[:, :2]


class Box(NamedTuple):
    area: float
    length_parallel: float
    length_orthogonal: float
    center: tuple[float, float]
    unit_vector: tuple[float, float]
    angle: float
    corners: list[tuple[float, float]]


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) <= 2:
        return np.array(p)

    def half(ps):
        out = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def minimum_box(points: np.ndarray) -> Box:
    """The rectangle of least area around more than two points: one of its sides lies on the hull."""
    if len(points) <= 2:
        raise ValueError("more than two points are needed")
    h = hull(np.asarray(points, float))
    if len(h) < 3:
        raise ValueError("the points lie on one line")
    best = None
    for a, b in zip(h, np.roll(h, -1, axis=0)):
        u = (b - a) / np.hypot(*(b - a))
        o = np.array([-u[1], u[0]])
        p, q = h @ u, h @ o
        area = (p.max() - p.min()) * (q.max() - q.min())
        if best is None or area < best[0]:
            best = area, u, o, p.min(), p.max(), q.min(), q.max()
    area, u, o, p0, p1, q0, q1 = best
    at = lambda p, q: tuple((p * u + q * o).tolist())
    return Box(float(area), float(p1 - p0), float(q1 - q0), at((p0 + p1) / 2, (q0 + q1) / 2), tuple(u.tolist()), math.atan2(u[1], u[0]), [at(p0, q0), at(p0, q1), at(p1, q1), at(p1, q0)])


def rotate(points: np.ndarray) -> np.ndarray:
    """Points turned so that the least box lies along the axes."""
    t = minimum_box(points).angle
    x, y = points[:, 0], points[:, 1]
    return np.stack([x * math.cos(t) + y * math.sin(t), y * math.cos(t) - x * math.sin(t)], axis=1)
