"""The rate solver against plain projected gradient steps on every document's rate, run to the end."""

from __future__ import annotations

import numpy as np
import pytest

from larder.llm import mixing

WEIGHT = 0.05


@pytest.mark.parametrize("share", [(0.7, 0.2, 0.1), (0.5, 0.5, 0.0), (0.1, 0.1, 0.8)])
def test_conjugate_steps_reach_the_optimum_of_plain_ones(share):
    rng = np.random.default_rng(7)
    score = rng.normal(size=(400, 3)) * 3 + (2, 0, -2)
    posterior = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
    # Repeated rows, documents without a token, and equal posteriors.
    posterior[300:] = posterior[0]
    tokens = rng.integers(0, 50, 400).astype(float)
    part, target = tokens / tokens.sum(), np.array(share)
    present = part @ posterior
    ridge, gram = WEIGHT * present, (posterior * part[:, None]).T @ posterior
    calls = []

    def misses(points):
        calls.append(len(points))
        return np.array([(part * np.maximum(0, 1 - posterior @ moved)) @ posterior - target for moved in points])

    moved, off = mixing._descend(np.zeros(3), ridge, gram, misses, present)
    got = np.maximum(0, 1 - posterior @ moved)

    rates, step = np.ones(400), 1 / (1 + np.linalg.eigvalsh(gram / ridge).max() * 3)
    for _ in range(40_000):
        rates = np.maximum(0, rates - step * (rates - 1 + posterior @ ((part * rates) @ posterior / ridge - target / ridge)))
    some = tokens > 0
    assert np.abs(got - rates)[some].max() < 0.02
    assert np.allclose(off, (part * got) @ posterior - target, atol=1e-9)
    assert len(calls) < 60


def test_a_target_that_is_met_takes_no_step():
    posterior, part = np.array([[0.75, 0.25], [0.25, 0.75]]), np.array([0.5, 0.5])
    calls = []

    def misses(points):
        calls.append(len(points))
        return np.array([(part * np.maximum(0, 1 - posterior @ moved)) @ posterior - part @ posterior for moved in points])

    moved, off = mixing._descend(np.zeros(2), np.array([0.1, 0.1]), (posterior * part[:, None]).T @ posterior, misses, part @ posterior)
    assert (moved.tolist(), off.tolist(), calls) == ([0.0, 0.0], [0.0, 0.0], [1])
