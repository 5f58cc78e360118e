"""Seasonal ARMA by exact Gaussian likelihood, for many series at once.

The model of the differences d is (1 - phi B)(1 - Phi B^s) d = (1 + theta B)(1 + Theta B^s) e in
state-space form: the first state is the value, the transition has the autoregressive weights in its
first column and ones above its diagonal, and (1, moving-average weights) multiply the shock. A Kalman
filter begins at the stationary distribution. As nothing in the model changes with time, the
covariance of the state grows by a matrix of rank one a step, so a step costs as much as the state is
wide, not its square; where the increments vanish the gain is held.

Each array has a row for every series (and trial), which begin together and end after `size` values.
Parameters are kept inside (-1, 1) by p = z / sqrt(1 + z^2), and a quasi-Newton search over z runs on
all series at once until none improves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

SEASON = 7


def weights(p: np.ndarray, season: int = SEASON) -> tuple[np.ndarray, np.ndarray]:
    """Autoregressive weights and shock weights by state, of rows (phi, theta) or (phi, theta, Phi, Theta)."""
    n, k = p.shape
    width = season + 2 if k == 4 else 2
    ar, shock = np.zeros((n, width)), np.zeros((n, width))
    ar[:, 0], shock[:, 0], shock[:, 1] = p[:, 0], 1.0, p[:, 1]
    if k == 4:
        ar[:, season - 1] += p[:, 2]
        ar[:, season] -= p[:, 0] * p[:, 2]
        shock[:, season] += p[:, 3]
        shock[:, season + 1] += p[:, 1] * p[:, 3]
    return ar, shock


def onward(ar: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The transition applied to states."""
    out = ar * state[:, :1]
    out[:, :-1] += state[:, 1:]
    return out


def stationary(ar: np.ndarray, shock: np.ndarray, most: int = 24) -> np.ndarray:
    """Covariance of the state in the long run, by doubling: P = sum of T^i R R' T'^i."""
    n, width = ar.shape
    step = np.zeros((n, width, width))
    step[:, :, 0] = ar
    step[:, np.arange(width - 1), np.arange(1, width)] += 1.0
    total = shock[:, :, None] * shock[:, None, :]
    for _ in range(most):
        more = step @ total @ step.transpose(0, 2, 1)
        total = total + more
        if np.max(np.abs(more)) <= 1e-13 * np.max(np.abs(total)):
            break
        step = step @ step
    return total


def filtered(d: np.ndarray, size: np.ndarray, p: np.ndarray, season: int = SEASON, tiny: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood at the best variance of the shocks, and the state predicted for the step after the last.

    d is (time, series); p may hold several trials a series, the series of trial i being i mod series."""
    ar, shock = weights(p, season)
    trials = len(p) // d.shape[1]
    if trials > 1:
        d, size = np.tile(d, (1, trials)), np.tile(size, trials)
    first = stationary(ar, shock)
    spread = first[:, 0, 0]
    gain = onward(ar, first[:, :, 0]) / spread[:, None]
    grow, scale = gain.copy(), -spread
    state = np.zeros_like(gain)
    squares, logs = np.zeros(len(p)), np.zeros(len(p))
    held, shortest, log = False, int(size.min()), np.log(spread)
    for t in range(len(d)):
        wrong = d[t] - state[:, 0]
        if t < shortest:
            state = onward(ar, state) + gain * wrong[:, None]
            squares += wrong * wrong / spread
            logs += log
        else:
            known = t < size
            state = np.where(known[:, None], onward(ar, state) + gain * wrong[:, None], state)
            squares += np.where(known, wrong * wrong / spread, 0.0)
            logs += np.where(known, log, 0.0)
        if held:
            continue
        seen = grow[:, 0]
        turned = onward(ar, grow)
        after = spread + scale * seen * seen
        gain_after = (gain * spread[:, None] + turned * (scale * seen)[:, None]) / after[:, None]
        grow = turned - gain_after * seen[:, None]
        scale = scale + scale * scale * seen * seen / spread
        spread, gain, log = after, gain_after, np.log(after)
        held = t % 8 == 7 and bool(np.max(np.abs(scale[:, None]) * grow * grow) < tiny)
    variance = np.maximum(squares / size, 1e-300)
    return -0.5 * (size * (np.log(2 * np.pi * variance) + 1) + logs), state


def climb(value: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, rounds: int = 40, most: float = 7.0, tolerance: float = 1e-7) -> np.ndarray:
    """Least points of many functions by a quasi-Newton search. value(rows, points) gives the functions
    of `rows` at `points`, which hold several trials a row one after another."""
    n, k = start.shape
    z = start.copy()
    eye, trials = np.eye(k), np.array([1.0, 0.4, 0.1, 0.02, 0.002])
    inverse = np.tile(eye, (n, 1, 1))
    active = np.arange(n)

    def slope(rows: np.ndarray, at: np.ndarray, h: float = 1e-4) -> np.ndarray:
        moves = np.concatenate([eye, -eye]) * h
        found = value(rows, (at[None] + moves[:, None]).reshape(-1, k)).reshape(2 * k, len(rows))
        return (found[:k] - found[k:]).T / (2 * h)

    now = value(active, z)
    steep = slope(active, z)
    for _ in range(rounds):
        way = -np.einsum("nij,nj->ni", inverse[active], steep[active])
        up = np.sum(way * steep[active], axis=1) >= 0
        inverse[active[up]], way[up] = eye, -steep[active[up]]
        way /= np.maximum(1.0, np.linalg.norm(way, axis=1))[:, None]
        tried = np.clip(z[active][None] + trials[:, None, None] * way[None], -most, most)
        found = np.nan_to_num(value(active, tried.reshape(-1, k)).reshape(len(trials), -1), nan=np.inf)
        at = np.argmin(found, axis=0)
        best = found[at, np.arange(len(active))]
        better = best < now[active] - tolerance
        was_eye = np.all(inverse[active] == eye, axis=(1, 2))
        inverse[active[~better]] = eye
        moved, chosen = active[better], tried[at, np.arange(len(active))][better]
        if len(moved):
            fresh = slope(moved, chosen)
            s, y = chosen - z[moved], fresh - steep[moved]
            curve = np.sum(s * y, axis=1)
            fit = curve > 1e-12
            rho = 1.0 / curve[fit]
            left = eye - rho[:, None, None] * s[fit][:, :, None] * y[fit][:, None, :]
            inverse[moved[fit]] = left @ inverse[moved[fit]] @ left.transpose(0, 2, 1) + rho[:, None, None] * s[fit][:, :, None] * s[fit][:, None, :]
            z[moved], now[moved], steep[moved] = chosen, best[better], fresh
        active = active[better | ~was_eye]
        if not len(active):
            break
    return z


def inside(z: np.ndarray) -> np.ndarray:
    return z / np.sqrt(1 + z * z)


def unbounded(p: np.ndarray) -> np.ndarray:
    return p / np.sqrt(1 - p * p)


def differences(histories: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, series) of first differences from the first on, zeros after the last, and their numbers."""
    size = np.array([len(h) - 1 for h in histories])
    d = np.zeros((size.max(), len(size)))
    for i, h in enumerate(histories):
        d[: size[i], i] = np.diff(h)
    return d, size


def fitted(d: np.ndarray, size: np.ndarray, start: np.ndarray, season: int = SEASON) -> np.ndarray:
    """Parameters of most likelihood near `start`."""

    def cost(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        trials = len(points) // len(rows)
        with np.errstate(all="ignore"):
            return -filtered(d[:, rows], size[rows], inside(points), season)[0] / np.tile(size[rows], trials)

    return inside(climb(cost, unbounded(start)))


def continued(d: np.ndarray, size: np.ndarray, p: np.ndarray, horizon: int, season: int = SEASON) -> np.ndarray:
    """The next differences, as expected from all before."""
    ar = weights(p, season)[0]
    state, out = filtered(d, size, p, season)[1], []
    for _ in range(horizon):
        out.append(state[:, 0])
        state = onward(ar, state)
    return np.stack(out, 1)
