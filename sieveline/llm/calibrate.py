"""Isotonic calibration by pooling adjacent violators."""

from __future__ import annotations

import numpy as np


class Isotonic:
    """A rising map from raw scores to probabilities: pooled block means, joined by straight lines between block centres."""

    def __init__(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, prior: float = 0.5):
        weight = np.ones(len(raw)) if weight is None else weight
        if not len(raw):
            self.x, self.p = np.array([0.0]), np.array([prior])
            return
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # weight, weighted label, weighted score
        for r, t, w in zip(raw[order].tolist(), y[order].tolist(), weight[order].tolist()):
            blocks.append([w, w * t, w * r])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        # a pinch of the overall rate keeps small blocks off 0 and 1
        mean, pinch = np.average(y, weights=weight), np.average(weight)
        self.x = np.array([b[2] / b[0] for b in blocks])
        self.p = np.array([(b[1] + pinch * mean) / (b[0] + pinch) for b in blocks])
        self.p = np.maximum.accumulate(self.p)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.p)
