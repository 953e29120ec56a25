"""Small numpy training helpers."""

from __future__ import annotations

import numpy as np

Parameters = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class Adam:
    def __init__(self, parameters: Parameters, rate: float):
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.square = {k: np.zeros_like(v) for k, v in parameters.items()}

    def update(self, gradients: Parameters) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in gradients.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            self.parameters[k] -= (scale * self.mean[k] / (np.sqrt(self.square[k]) + 1e-8)).astype(np.float32)


def summed(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of ``rows`` by ``index``, as an array of ``size`` rows."""
    out = np.zeros((size, rows.shape[1]), np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        keys = index[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        out[keys[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out
