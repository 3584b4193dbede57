"""Scores of blocks of queries against blocks of vectors, in numpy, and what is kept of them.

A kernel gives a matrix of scores (larger is better) by matrix multiplication or table look-ups. For flat vectors everything within rounding of the
k-th score is scored once more row by row, so copies of a vector score the same wherever they lie and ties go by id.
"""

from __future__ import annotations

import numpy as np

#: scores held at a time
CELLS = 1 << 22


def first_k(group: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of every group (larger scores first, then smaller ids)."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k]


class Flat:
    """Vectors as they are."""

    def __init__(self, metric: str):
        if metric not in ("ip", "l2", "cosine", "l1", "linf"):
            raise ValueError(f"unknown metric {metric}")
        self.metric = metric

    def matrix(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.metric in ("l1", "linf"):
            gaps = (np.abs(one - x) for one in q)
            return -np.stack([g.sum(axis=1) if self.metric == "l1" else g.max(axis=1, initial=0) for g in gaps]) if len(q) else np.zeros((0, len(x)))
        s = q @ x.T
        if self.metric == "l2":
            return 2 * s - (q * q).sum(axis=1)[:, None] - (x * x).sum(axis=1)
        if self.metric == "cosine":
            size = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))
            return np.divide(s, size, out=np.zeros_like(s), where=size > 0)
        return s

    def slack(self, q: np.ndarray, x: np.ndarray) -> float:
        """More than rounding can move a score."""
        if self.metric in ("l1", "linf"):
            return 0.0
        top = max((q * q).sum(axis=1).max(initial=0), (x * x).sum(axis=1).max(initial=0))
        return 8 * 2.3e-16 * (q.shape[1] + 2) * (1.0 if self.metric == "cosine" else float(top))

    def exact(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.metric == "l1":
            return -np.abs(q - x).sum(axis=1)
        if self.metric == "linf":
            return -np.abs(q - x).max(axis=1, initial=0)
        if self.metric == "l2":
            return -((q - x) ** 2).sum(axis=1)
        s = (q * x).sum(axis=1)
        if self.metric == "cosine":
            size = np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1))
            return np.divide(s, size, out=np.zeros_like(s), where=size > 0)
        return s

    def sign(self) -> int:
        return 1 if self.metric in ("ip", "cosine") else -1


def best(kernel, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int | None, least: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of the k best of every query, or of all above ``least`` (exclusive)."""
    rows, found, scores = [], [], []
    step = max(1, CELLS // max(1, len(x)))
    for s in range(0, len(q) if len(x) else 0, step):
        part = q[s : s + step]
        m = kernel.matrix(part, x)
        if least is not None:
            near = m > least - kernel.slack(part, x)
        elif len(x) > k:
            near = m >= (np.partition(m, len(x) - k, axis=1)[:, len(x) - k] - kernel.slack(part, x))[:, None]
        else:
            near = np.ones_like(m, dtype=bool)
        i, j = np.nonzero(near)
        score = kernel.exact(part[i], x[j]) if hasattr(kernel, "exact") else m[i, j]
        if least is not None:
            keep = np.flatnonzero(score > least)
        else:
            keep = first_k(i, ids[j], score, k)
        rows.append(i[keep] + s)
        found.append(ids[j[keep]])
        scores.append(score[keep])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


class Codes:
    """Product-quantised vectors: sums of table entries. ``books`` is (sub-spaces, codes, dimensions); with ``centre`` the codes are those of what
    the list's centroid leaves over."""

    def __init__(self, metric: str, books: np.ndarray, centre: np.ndarray | None = None):
        self.metric, self.books, self.centre = metric, books, centre

    def matrix(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        m, _, d = self.books.shape
        moved = q if self.centre is None or self.metric == "ip" else q - self.centre
        parts = moved.reshape(len(q), m, d)
        if self.metric == "ip":
            table = np.einsum("qmd,mcd->qmc", parts, self.books)
        else:
            table = -((parts[:, :, None, :] - self.books[None]) ** 2).sum(axis=3)
        out = np.zeros((len(q), len(codes)))
        for i in range(m):
            out += table[:, i, :][:, codes[:, i]]
        if self.centre is not None and self.metric == "ip":
            out += (q @ self.centre)[:, None]
        return np.round(out, 12)

    def slack(self, q: np.ndarray, x: np.ndarray) -> float:
        return 0.0

    def sign(self) -> int:
        return 1 if self.metric == "ip" else -1
