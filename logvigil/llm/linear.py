"""Small linear text models: hashed features, per-coordinate training.

Features of a document are hashed n-grams in families; a family's values are
relative counts, so a document's score is a mean of weights over its n-grams
and scoring needs no per-document sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from logvigil.llm.textkit import (SPACE_WORDS, doc_of, doc_slices, span_hashes, text_buffer, windows,
                                  word_spans)

#: hash slots of all families together
SLOT_BITS = 18


def slot(h: np.ndarray, salt: int) -> np.ndarray:
    x = (h.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def gram_slots(units: np.ndarray, off: np.ndarray, n: int, salt: int):
    """Slots of the n-grams of consecutive units inside each document, and the
    documents' boundaries among them."""
    m = len(units) - n + 1
    if m <= 0:
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    x = units[:m].astype(np.uint64)
    for i in range(1, n):
        x = x * np.uint64(0x100000001B3) + units[i:i + m]
    counts = np.maximum(np.diff(off) - n + 1, 0)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(firsts[-1]) + np.repeat(off[:-1] - firsts[:-1], counts)
    return slot(x[at], salt * 1_000_003 + n), firsts


def code_points(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z-folded code points of UTF-8 documents and their offsets."""
    cps = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
    starts = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    cps[(cps >= 65) & (cps <= 90)] += 32
    return cps, starts[off]


def word_and_char_families(buf: np.ndarray, off: np.ndarray) -> list:
    """Characters (3 and 5 bytes), words, word pairs, and pairs marked only by
    whether a word repeats the one before."""
    s, e, firsts = word_spans(buf, off, SPACE_WORDS)
    h = span_hashes(buf, s, e, fold=False)
    pairs, at = windows(h, firsts, 2)
    doc = doc_of(firsts)
    again = np.zeros(len(h), np.uint64)
    if len(h):
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    return [gram_slots(buf, off, 3, 1), gram_slots(buf, off, 5, 2), (slot(h, 3), firsts),
            (slot(pairs, 4), np.searchsorted(at, firsts)), (slot(again, 5), firsts)]


def char_families(buf: np.ndarray, off: np.ndarray) -> list:
    """Characters 1 to 3, in one family."""
    cps, at = code_points(buf, off)
    return [gram_slots(cps, at, n, 10) for n in (1, 2, 3)]


def family_means(families: list, table: np.ndarray) -> np.ndarray:
    """Sum over families of the mean of table[slot] per document."""
    total = np.zeros(len(families[0][1]) - 1)
    for slots, firsts in families:
        c = np.concatenate([[0.0], np.cumsum(table[slots], dtype=np.float64)])
        n = np.diff(firsts)
        total += (c[firsts[1:]] - c[firsts[:-1]]) / np.maximum(n, 1)
    return total


def sparse_rows(families: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, values) of each document: relative counts, added over families."""
    out = []
    for d in range(len(families[0][1]) - 1):
        part = [f[0][f[1][d]:f[1][d + 1]] for f in families]
        all_slots = np.concatenate(part)
        share = np.concatenate([np.full(len(p), 1.0 / max(len(p), 1)) for p in part])
        u, inv = np.unique(all_slots, return_inverse=True)
        out.append((u, np.bincount(inv, weights=share, minlength=len(u)) if len(u)
                    else np.zeros(0)))
    return out


def sparse_texts(texts: list[str], families) -> list[tuple[np.ndarray, np.ndarray]]:
    """sparse_rows of a list of texts, worked on in slices."""
    out = []
    buf, off = text_buffer(pa.array(texts, pa.string()))
    for a, b in doc_slices(off, 1 << 18):
        rows = sparse_rows(families(buf[off[a]:off[b]], off[a:b + 1] - off[a]))
        out += [(u, v.astype(np.float32)) for u, v in rows]
    return out


class Ftrl:
    """Follow-the-regularised-leader for a softmax over ``classes`` with an
    elastic net; weights follow from the running sums z and q."""

    def __init__(self, size: int, classes: int, alpha=2.0, beta=1.0, l1=0.002, l2=0.002):
        self.z, self.q = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, q = self.z[at], self.q[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(q)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        return w

    def update(self, at: np.ndarray, x: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = weight * np.outer(x, p)
        sigma = (np.sqrt(self.q[at] + g * g) - np.sqrt(self.q[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.q[at] += g * g


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood (golden section over
    its logarithm; the loss is convex in 1 / T)."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    lo, hi, g = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a z + b), weighted and slightly smoothed (Newton)."""
    ab = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    ridge = np.diag([1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge @ (ab - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hess, grad)
        ab = ab - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])
