"""Seasonal ARMA by likelihood: against a plain Gaussian density, known parameters and a fallback."""

import numpy as np
import pytest

from panelspark.operators import likelihood as lk
from panelspark.operators import models

SETS = [(0.6, 0.3), (-0.5, 0.9), (0.95, -0.4), (0.3, -0.2, 0.5, -0.4), (-0.6, 0.5, 0.9, 0.3), (0.0, 0.0, 0.0, 0.0)]


def covariances(p, n, length=4000):
    """Autocovariances from the shock weights of the series, written out."""
    ar, shock = (x[0] for x in lk.weights(np.array([p])))
    psi = np.zeros(length)
    for i in range(length):
        psi[i] = (shock[i] if i < len(shock) else 0.0) + sum(ar[j] * psi[i - 1 - j] for j in range(min(len(ar), i)))
    return np.array([psi[: length - k] @ psi[k:] for k in range(n)])


def simulate(p, n, seed, spread=1.0):
    ar, shock = (x[0] for x in lk.weights(np.array([p])))
    rng = np.random.default_rng(seed)
    e, x = rng.normal(size=n + 500) * spread, np.zeros(n + 500)
    for t in range(len(ar), n + 500):
        x[t] = ar @ x[t - len(ar) : t][::-1] + shock @ e[t - len(shock) + 1 : t + 1][::-1]
    return x[500:]


@pytest.mark.parametrize("p", SETS)
def test_likelihood_and_forecast_are_those_of_a_plain_gaussian(p):
    n, ahead = 30, 9
    x = np.random.default_rng(3).normal(size=n)
    gamma = covariances(p, n + ahead)
    whole = gamma[np.abs(np.subtract.outer(np.arange(n + ahead), np.arange(n + ahead)))]
    inner = whole[:n, :n]
    variance = x @ np.linalg.solve(inner, x) / n
    plain = -0.5 * (n * np.log(2 * np.pi * variance) + np.linalg.slogdet(inner)[1] + n)
    d, size = np.concatenate([x, np.zeros(5)])[:, None], np.array([n])
    found, _ = lk.filtered(d, size, np.array([p]))
    assert np.isclose(found[0], plain, atol=1e-6)
    assert np.allclose(lk.continued(d, size, np.array([p]), ahead)[0], whole[n:, :n] @ np.linalg.solve(inner, x), atol=1e-7)


def test_a_held_gain_changes_nothing():
    x, p = simulate(SETS[3], 400, 1)[:, None], np.array([SETS[3]])
    a, b = lk.filtered(x, np.array([400]), p), lk.filtered(x, np.array([400]), p, tiny=0.0)
    assert np.isclose(a[0][0], b[0][0], atol=1e-7) and np.allclose(a[1], b[1], atol=1e-7)


@pytest.mark.parametrize("p", [SETS[0], (0.7, 0.4, 0.8, -0.3), SETS[3]])
def test_parameters_are_recovered(p):
    """Of the last set, whose two sides nearly cancel, the likelihood alone tells."""
    d, size = np.stack([simulate(p, 1500, s, 2.5) for s in range(6)], 1), np.full(6, 1500)
    found = lk.fitted(d, size, np.zeros((6, len(p))))
    assert (lk.filtered(d, size, found)[0] >= lk.filtered(d, size, np.tile(p, (6, 1)))[0] - 1e-6).all()
    assert p == SETS[3] or np.allclose(found.mean(axis=0), p, atol=0.1)


def test_no_point_nearby_is_likelier_and_trials_do_not_mix():
    d, size = np.stack([simulate(SETS[3], 200, s) for s in range(5)], 1), np.array([200, 200, 150, 90, 60])
    found = lk.fitted(d, size, np.zeros((5, 4)))
    best = lk.filtered(d, size, found)[0]
    for move in np.concatenate([np.eye(4), -np.eye(4)]) * 0.02:
        assert (lk.filtered(d, size, np.clip(found + move, -0.99, 0.99))[0] <= best + 1e-3).all()
    for i in range(5):
        alone = lk.fitted(d[: size[i], i : i + 1], size[i : i + 1], np.zeros((1, 4)))
        assert np.isclose(lk.filtered(d[: size[i], i : i + 1], size[i : i + 1], alone)[0][0], best[i], atol=1e-3)


def test_the_search_ends_likelier_than_least_squares():
    d = np.stack([simulate((0.2, 0.8), 40, s) for s in range(60)], 1)
    size = np.full(60, 40)
    plain = models.least_squares([np.concatenate([[0.0], np.cumsum(x)]) for x in d.T])
    gain = lk.filtered(d, size, lk.fitted(d, size, plain))[0] - lk.filtered(d, size, plain)[0]
    assert (gain >= -1e-9).all() and gain.mean() > 0.05


def test_forecasts_of_flat_short_and_broken_series():
    assert np.allclose(models.arima([np.full(90, 5.0)], seasonal=True), 5.0)
    rng = np.random.default_rng(1)
    short, long = 50 + np.cumsum(rng.normal(size=61)), 50 + np.cumsum(rng.normal(size=400))
    both = models.classical([short, long])
    assert all(v.shape == (2, 7) and np.isfinite(v).all() for v in both.values())
    assert np.allclose(models.arima([short])[0], both["arima"][0], rtol=1e-3)
