"""Sparse rows and the per-coordinate follow-the-regularised-leader step that the two linear models share."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .textkernel import utf8


@dataclass
class Rows:
    """Sparse rows: row i has features at[first[i] : first[i + 1]] with those values; value None: each is 1."""

    first: np.ndarray
    at: np.ndarray
    value: np.ndarray | None

    def __len__(self) -> int:
        return len(self.first) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.first[i], self.first[i + 1]
        return self.at[a:b], np.ones(b - a) if self.value is None else self.value[a:b]

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        first = np.concatenate([[0], np.cumsum([len(a) for a, _ in rows])]).astype(np.int64)
        if not rows:
            return Rows(first, np.zeros(0, np.int32), np.zeros(0, np.float32))
        return Rows(first, np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]))

    @staticmethod
    def packed(column: pa.Array | pa.ChunkedArray) -> Rows:
        """Rows of features that are each 1, from a column of packed 32-bit feature numbers."""
        body, offsets = utf8(column)
        return Rows(offsets // 4, np.frombuffer(body.tobytes(), "<i4"), None)


class Ftrl:
    """FTRL-proximal weights of shape (features, outputs) with an elastic-net penalty l1 * |w| + l2 * w**2 / 2."""

    def __init__(self, features: int, outputs: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((features, outputs)), np.zeros((features, outputs))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        """at has no feature twice."""
        n = self.n[at]
        more = n + gradient**2
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * weights
        self.n[at] = more
