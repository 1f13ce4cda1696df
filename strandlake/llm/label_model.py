"""A generative label model over binary voters: accuracies, correlations, posterior labels.

Each voter fires or not. Given the hidden class, a voter fires with a
probability of its own; expectation maximisation over the counts of vote
patterns estimates them. Correlations are what remains between two voters once
the class is known; a voter's evidence is divided by how many voters it
repeats, and the estimate is run again with those weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS = 100
SMOOTH = 1.0
#: Share of its evidence that a voter's silence keeps in the posterior labels: silence is mostly abstention.
SILENCE = 0.25
#: Correlations below this are taken for noise; only what is above it counts as repetition.
REPEATS = 0.3


@dataclass
class LabelModel:
    prior: float
    fire: np.ndarray  # 2 x voters: P(fires | class)
    weight: np.ndarray  # voters: share of evidence after correlations
    correlation: np.ndarray  # voters x voters, given the class

    def posterior(self, votes: np.ndarray, silence: float = SILENCE) -> np.ndarray:
        """P(class 1 | votes) of rows of 0/1 votes."""
        on, off = np.log(self.fire), np.log1p(-self.fire)
        gain = (votes @ ((on[1] - on[0]) * self.weight)) + ((1 - votes) @ ((off[1] - off[0]) * self.weight * silence))
        logit = np.log(self.prior / (1 - self.prior)) + gain
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def unpack(patterns: np.ndarray, voters: int) -> np.ndarray:
    """Rows of 0/1 votes from patterns of bits."""
    return (patterns[:, None] >> np.arange(voters) & 1).astype(np.float64)


def fit(patterns: np.ndarray, counts: np.ndarray, voters: int, prior: float) -> LabelModel:
    """Fits on distinct vote patterns and their counts; ``prior`` is the share of class 1 and stays."""
    votes, n = unpack(patterns, voters), counts.astype(np.float64)
    model = LabelModel(min(max(prior, 1e-3), 0.5), np.zeros((2, voters)), np.ones(voters), np.eye(voters))
    post = np.where(votes.sum(axis=1) > 0, 0.9, 0.02)
    for again in range(2):
        for _ in range(ROUNDS):
            for c, p in ((0, 1 - post), (1, post)):
                model.fire[c] = np.clip((votes.T @ (n * p) + SMOOTH * (0.001, 0.1)[c]) / ((n * p).sum() + SMOOTH), 1e-6, 1 - 1e-6)
            new = model.posterior(votes, 1.0)
            if np.abs(new - post).max(initial=0) < 1e-9:
                break
            post = new
        if not again:
            model.correlation = _residual(votes, n, post, model.fire)
            model.weight = 1 / (1 + np.clip(model.correlation - np.eye(voters) - REPEATS, 0, None).sum(axis=1))
    return model


def _residual(votes: np.ndarray, n: np.ndarray, post: np.ndarray, fire: np.ndarray) -> np.ndarray:
    """Correlations of the voters within the classes, weighted by the posteriors."""
    total = np.zeros((votes.shape[1], votes.shape[1]))
    for c, p in ((0, n * (1 - post)), (1, n * post)):
        d = votes - fire[c]
        total += (d * p[:, None]).T @ d
    sd = np.sqrt(np.maximum(np.diag(total), 1e-12))
    return total / np.outer(sd, sd)
