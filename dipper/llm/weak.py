"""Weak supervision: expectation-maximisation over the votes of overlapping labellers.

Votes are +1, -1 or 0 (abstains). All that matters is how often each pattern of votes occurs, a table of at most
3 ** labellers rows whatever the data, which is summed over all rows before it reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np


def votes_key(votes: list[int]) -> str:
    return "".join("-0+"[v + 1] for v in votes)


def posteriors(patterns: dict[str, int], rounds: int = 100, start: float = 0.5, trust: float = 0.6, slip: float = 0.05, weight: float = 20.0) -> tuple[dict[str, float], np.ndarray]:
    """The probability of +1 for each pattern, and what each labeller says by class: [class, labeller, vote + 1].

    Labellers count as independent given the class; abstaining is an answer too, so a labeller that knows one kind of
    fault alone is heard when it speaks. To begin with, +1 rows get a vote of -1 with probability ``slip``, and -1 rows
    with probability 1 - ``trust``; the beginning counts as ``weight`` rows, so that an empty or one-sided table gives a
    defined result. ``start``: the prior of +1 to begin with.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, np.zeros((2, 0, 3))
    v = np.array([["-0+".index(c) for c in k] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    one = np.eye(3)[v]
    labellers = v.shape[1]
    begin = np.empty((2, labellers, 3))
    begin[0] = [slip, (1 - slip) / 2, (1 - slip) / 2]
    begin[1] = [1 - trust, trust / 2, trust / 2]
    says, prior = begin.copy(), start
    for _ in range(rounds):
        up = np.log(prior) + (one * np.log(says[0])).sum((1, 2))
        down = np.log(1 - prior) + (one * np.log(says[1])).sum((1, 2))
        p = 1 / (1 + np.exp(np.clip(down - up, -60, 60)))
        for c, of in enumerate((n * p, n * (1 - p))):
            says[c] = ((of[:, None, None] * one).sum(0) + weight * begin[c] * (0.05 if c == 0 else 1.0)) / (of.sum() + weight * (0.05 if c == 0 else 1.0))
        prior = float(np.clip((n @ p + 1) / (n.sum() + 2), 0.01, 0.99))
    return dict(zip(keys, p.tolist(), strict=True)), says


def fit_logistic(rows: list[tuple[dict[int, float], float, float]], dim: int, steps: int = 400, rate: float = 8.0, decay: float = 1e-4) -> np.ndarray:
    """Weights, the bias last, of a logistic model for (features, probability, weight) rows, by gradient descent."""
    if not rows:
        return np.zeros(dim + 1)
    at = np.concatenate([np.fromiter(x, np.int64, len(x)) for x, _, _ in rows])
    value = np.concatenate([np.fromiter(x.values(), float, len(x)) for x, _, _ in rows])
    of = np.repeat(np.arange(len(rows)), [len(x) for x, _, _ in rows])
    y, weight = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    # both classes weigh the same
    up, down = (weight * y).sum(), (weight * (1 - y)).sum()
    weight = weight * (y / max(up, 1e-9) + (1 - y) / max(down, 1e-9)) / 2
    w, bias = np.zeros(dim), 0.0
    g2, b2 = np.full(dim, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(of, weights=w[at] * value, minlength=len(rows)) + bias
        e = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.bincount(at, weights=e[of] * value, minlength=dim) + decay * w
        g2 += g * g
        b2 += e.sum() ** 2
        w -= rate / 10 * g / np.sqrt(g2)
        bias -= rate / 10 * e.sum() / math.sqrt(b2)
    return np.append(w, bias)
