"""Candidate directions of oblique splits, made on the driver from a node's sample: arrays of as many numbers as features."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

#: Directions a fit remembers, and the cosine above which two are the same.
CACHE, SAME = 32, 0.95
#: Nonzero weights of a direction at most.
MOST_TERMS = 16


def unit(w: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(w)
    return w / size if size > 0 else w


def truncated(w: np.ndarray, terms: int = MOST_TERMS) -> np.ndarray:
    """The first `terms` nonzero weights."""
    out = np.zeros_like(w)
    at = np.flatnonzero(w)[:terms]
    out[at] = w[at]
    return out


def covariance(xg: np.ndarray, active: np.ndarray) -> np.ndarray:
    """-X'g on the active features, normalised."""
    return unit(np.where(active, -xg, 0.0))


def wls(gram: np.ndarray, xg: np.ndarray, lam: float = 1.0) -> np.ndarray:
    """The solution of (X'HX + lambda I) w = -X'g, normalised."""
    return unit(np.linalg.solve(gram + lam * np.eye(len(xg)), -xg))


def blocks(sis: np.ndarray, xg: np.ndarray, active: np.ndarray, rng: np.random.Generator, budget: int) -> list[np.ndarray]:
    """The signed scores, then orthogonal random blocks (QR) on features drawn by score."""
    on = np.flatnonzero(active & (sis > 0))
    if len(on) < 2:
        return []
    size = min(len(on), MOST_TERMS, max(2, round(math.sqrt(len(sis)))))
    top = on[np.argsort(-sis[on], kind="stable")[:size]]
    first = np.zeros_like(sis)
    first[top] = -np.sign(xg[top]) * sis[top]
    out = [unit(first)]
    while len(out) < budget:
        support = rng.choice(on, size, replace=False, p=sis[on] / sis[on].sum())
        q, _ = np.linalg.qr(rng.standard_normal((size, size)))
        for row in q.T:
            w = np.zeros_like(sis)
            w[support] = row
            out.append(w)
    return out[:budget]


def scaled(parent: np.ndarray, depth: int, rate: float, rng: np.random.Generator) -> np.ndarray:
    """One or two of the parent's weights changed by a factor of 1 + U(-r, r), r = rate / sqrt(1 + depth)."""
    w, on = parent.copy(), np.flatnonzero(parent)
    r = rate / math.sqrt(1 + depth)
    at = rng.choice(on, min(len(on), int(rng.integers(1, 3))), replace=False)
    w[at] *= 1 + rng.uniform(-r, r, len(at))
    return w


def extended(parent: np.ndarray, depth: int, strength: float, sis: np.ndarray, xg: np.ndarray, active: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The parent with one more feature, drawn by score from those that it does not use."""
    chance = np.where(active & (parent == 0), sis, 0.0)
    if chance.sum() <= 0:
        return parent.copy()
    f = rng.choice(len(sis), p=chance / chance.sum())
    w = parent.copy()
    w[f] = -np.sign(xg[f]) * strength / (1 + depth)
    return w


def blended(parent: np.ndarray, other: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    share = rng.uniform(0.2, 0.8)
    return share * parent + (1 - share) * other


@dataclass
class Cache:
    """Directions of committed oblique splits: a ring without near copies."""

    kept: list[np.ndarray] = field(default_factory=list)

    def add(self, w: np.ndarray) -> None:
        if np.linalg.norm(w) <= 1e-6:
            return
        w = unit(w)
        if all(abs(float(w @ c)) <= SAME for c in self.kept):
            self.kept = [*self.kept, w][-CACHE:]


def candidates(sis: np.ndarray, xg: np.ndarray, active: np.ndarray, parent: np.ndarray | None, cache: Cache, depth: int, budget: int, params: dict, rng: np.random.Generator) -> list[tuple[np.ndarray, str]]:
    """Directions of one node and their families: the inherited share by scaling, extending and blending, the rest blocks; cached ones join."""
    inherited = 0 if parent is None else round(budget * params["inherited"])
    extra = 8 if params["pobs"] and inherited else 0
    out: list[tuple[np.ndarray, str]] = []
    for _ in range(max(0, inherited - extra)):
        kind = rng.uniform()
        if cache.kept:
            kind = "scale" if kind < 0.375 else "extend" if kind < 0.75 else "blend"
        else:
            kind = "scale" if kind < 0.5 else "extend"
        if kind == "scale" and np.count_nonzero(parent) == 1:
            kind = "extend"
        if kind == "scale":
            out.append((scaled(parent, depth, params["mutation_rate"], rng), kind))
        elif kind == "extend":
            out.append((extended(parent, depth, params["mutation_strength"], sis, xg, active, rng), kind))
        else:
            out.append((blended(parent, cache.kept[int(rng.integers(len(cache.kept)))], rng), kind))
    out += [(w, "block") for w in blocks(sis, xg, active, rng, budget - inherited + extra if inherited else budget)]
    out += [(w, "cache") for w in cache.kept]
    out = [(unit(truncated(w)), family) for w, family in out]
    return [(w, family) for w, family in out if np.count_nonzero(w) > 1]


def pool(*args) -> list[np.ndarray]:
    """The directions of `candidates` alone."""
    return [w for w, _ in candidates(*args)]


def ratio(gram: np.ndarray, xg: np.ndarray, w: np.ndarray) -> np.ndarray:
    """J(w) = (w'g)^2 / w'Aw of many nodes at once; 0 where w is."""
    below = np.einsum("ni,nij,nj->n", w, gram, w)
    return np.where(below > 0, np.einsum("ni,ni->n", w, xg) ** 2 / np.where(below > 0, below, 1.0), 0.0)


def ascended(gram: np.ndarray, xg: np.ndarray, start: np.ndarray, passes: int = 3, most: float = 10.0) -> np.ndarray:
    """Directions of length 1 after `passes` rounds of the best step in each coordinate, for many nodes at once.

    Along coordinate f, J(w + s e_f) has one maximum, where (w'g + s g_f)(Aw + s A_f)_f
    = g_f (w + s e_f)'A(w + s e_f).  Steps are at most `most` long, and one that
    would lower J is not made, so J never falls.
    """
    w = start.copy()
    idle = ~(np.linalg.norm(w, axis=1) > 1e-8)
    w[idle] = 0.0
    w[idle, :1] = 1.0
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    for _ in range(passes):
        for f in range(w.shape[1]):
            along, pull = np.einsum("ni,ni->n", w, xg), np.einsum("nj,nj->n", gram[:, f], w)
            size = np.einsum("ni,nij,nj->n", w, gram, w)
            slope = xg[:, f] * pull - along * gram[:, f, f]
            step = np.where(np.abs(slope) > 1e-9, (along * pull - xg[:, f] * size) / np.where(np.abs(slope) > 1e-9, slope, 1.0), 0.0)
            tried = w.copy()
            tried[:, f] += np.clip(step, -most, most)
            better = ratio(gram, xg, tried) >= ratio(gram, xg, w)
            w = np.where(better[:, None], tried, w)
    return w / np.maximum(1e-300, np.linalg.norm(w, axis=1, keepdims=True))
