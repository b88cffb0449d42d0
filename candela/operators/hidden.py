"""A Gaussian hidden Markov model of several features with full covariances, fitted on rolling windows and frozen between.

Series stream through tasks row by row (`sequences.scan`); what a series holds there is its last window of rows and one model.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
from pyspark.sql import DataFrame

from candela.operators.sequences import scan

# Rows of a window, rows between fits, states, how likely one stays, and rounds of the first and of later fits.
WINDOW, EVERY, STATES, STAYS, ROUNDS, AGAIN = 756, 63, 3, 0.90, 30, 5
#: Added to the diagonal of covariances of standardised features.
FLOOR = 1e-4


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class States:
    """Means, covariances and moves of k states over standardised features."""

    def __init__(self, x: np.ndarray, k: int, by: int):
        """Starts from the window cut into k equal parts by one feature."""
        self.k, self.by = k, by
        self.scale(x)
        z = self.standard(x)
        parts = np.array_split(np.argsort(z[:, by], kind="stable"), k)
        odds = np.full((len(z), k), 1e-3)
        for j, rows in enumerate(parts):
            odds[rows, j] = 1.0
        self.log_start = np.full(k, -math.log(k))
        self.log_moves = np.log(np.full((k, k), (1 - STAYS) / max(1, k - 1)) + np.eye(k) * (STAYS - (1 - STAYS) / max(1, k - 1)))
        self.shape(z, odds / odds.sum(axis=1, keepdims=True))

    def scale(self, x: np.ndarray) -> None:
        self.mean, self.sd = x.mean(axis=0), np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.sd

    def shape(self, z: np.ndarray, odds: np.ndarray) -> None:
        """Means and Cholesky factors of the covariances that odds of states give."""
        w = odds.sum(axis=0) + 1e-9
        self.mu = odds.T @ z / w[:, None]
        c = z[None] - self.mu[:, None]
        cov = np.einsum("tk,kti,ktj->kij", odds, c, c) / w[:, None, None] + FLOOR * np.eye(z.shape[1])
        self.root = np.linalg.cholesky(cov)

    def log_density(self, z: np.ndarray) -> np.ndarray:
        """rows x states."""
        y = np.linalg.solve(self.root, (z[None] - self.mu[:, None]).transpose(0, 2, 1))
        half = np.log(np.diagonal(self.root, axis1=1, axis2=2)).sum(axis=1)
        return -0.5 * (y**2).sum(axis=1).T - half - 0.5 * z.shape[1] * math.log(2 * math.pi)

    def step(self, alpha: np.ndarray | None, density: np.ndarray) -> tuple[np.ndarray, float]:
        """Log odds of the states after one more row, and how likely that row was."""
        joint = density + (self.log_start if alpha is None else log_sum(alpha[:, None] + self.log_moves, 0))
        total = float(log_sum(joint, 0))
        return joint - total, total

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        density, alpha, out, total = self.log_density(z), None, [], 0.0
        for row in density:
            alpha, told = self.step(alpha, row)
            out.append(alpha)
            total += told
        return np.array(out), total, density

    def fit(self, x: np.ndarray, rounds: int) -> States:
        """Rounds of expectation and maximisation on a window, whose own mean and scale standardise from now on."""
        before, self.mean_, self.sd_ = self, self.mean, self.sd
        self.scale(x)
        self.mu = (before.mu * self.sd_ + self.mean_ - self.mean) / self.sd  # where the states were, in the new scale
        self.root = self.root * (self.sd_ / self.sd)[None, :, None]
        z = self.standard(x)
        for _ in range(rounds):
            alpha, _, density = self.forward(z)
            beta = np.zeros_like(alpha)
            pairs = np.full((self.k, self.k), -np.inf)
            for t in range(len(z) - 2, -1, -1):
                ahead = density[t + 1] + beta[t + 1]
                joint = alpha[t][:, None] + self.log_moves + ahead[None]
                pairs = np.logaddexp(pairs, joint - log_sum(joint.ravel(), 0))
                beta[t] = log_sum(self.log_moves + ahead[None], 1)
                beta[t] -= beta[t].max()
            odds = alpha + beta
            odds = np.exp(odds - log_sum(odds, 1)[:, None])
            self.log_start = np.log(odds[0] + 1e-300)
            self.log_moves = pairs - log_sum(pairs, 1)[:, None]
            self.shape(z, odds)
        return self

    def order(self) -> np.ndarray:
        """Each state's place by its mean of the feature that orders them."""
        return np.argsort(np.argsort(self.mu[:, self.by], kind="stable"))


def rolling_states(rows: DataFrame, features: list[str], by: str, k: int = STATES, window: int = WINDOW, every: int = EVERY, rounds: int = ROUNDS, again: int = AGAIN) -> DataFrame:
    """symbol, date, state, confidence, odds_0..: each row's odds of the states from the rows up to it, by the model of the
    window that ended at the last fit, states ordered by their mean of `by`; confidence is 1 less the odds' entropy over
    its largest. Rows before the first fit are left out, as are rows with a missing feature. The model is fitted every so
    many rows, each time from the one before, and is frozen between; nothing looks ahead."""
    first = features.index(by)

    def start():
        past: deque = deque(maxlen=window)
        held: dict = {"model": None, "alpha": None, "seen": 0}

        def step(*values: float) -> tuple:
            x = np.array(values)
            if len(past) == window and held["seen"] % every == window % every:
                seen = np.array(past)
                model = held["model"]
                held["model"] = States(seen, k, first).fit(seen, rounds) if model is None else model.fit(seen, again)
                held["alpha"] = held["model"].forward(held["model"].standard(seen))[0][-1]
            past.append(x)
            held["seen"] += 1
            model = held["model"]
            if model is None:
                return (None, None, *[None] * k)
            held["alpha"], _ = model.step(held["alpha"], model.log_density(model.standard(x[None]))[0])
            odds = np.empty(k)
            odds[model.order()] = np.exp(held["alpha"])
            entropy = -(odds * np.log(np.maximum(odds, 1e-300))).sum()
            return (int(odds.argmax()), float(1 - entropy / math.log(k)) if k > 1 else 1.0, *map(float, odds))

        return step

    told = scan(rows.na.drop(subset=features), features, "state int, confidence double, " + ", ".join(f"odds_{j} double" for j in range(k)), start)
    return told.filter("state is not null")
