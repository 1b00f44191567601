"""Autoregressive integrated moving-average models of many windows at once: exact Gaussian likelihood by the Kalman filter.

All functions take one window a row. The differences y of a window follow y(t) = sum ar(i) y(t-i) + e(t) + sum ma(j) e(t-j); the
state has max(p, q + 1) numbers, begins in its stationary distribution, and the variance of e is concentrated out.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Largest partial autocorrelation, which keeps models away from unit roots.
MOST = 0.99
#: Sizes of differences in parameters, and where the search is done.
STEP, FLAT = 1e-5, 1e-7


class Filtered(NamedTuple):
    """Log likelihood, variance of e, and the state predicted for the step after the last."""

    loglik: np.ndarray
    variance: np.ndarray
    state: np.ndarray
    transition: np.ndarray


def coefficients(partial: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from its partial autocorrelations (the Levinson recursion)."""
    a = partial[:, :0]
    for k in range(partial.shape[1]):
        last = partial[:, k : k + 1]
        a = np.concatenate([a - last * a[:, ::-1], last], axis=1)
    return a


def kalman(y: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> Filtered:
    """The filter over rows y with coefficients ar (rows, p) and ma (rows, q)."""
    (rows, steps), p, q = y.shape, ar.shape[1], ma.shape[1]
    size = max(p, q + 1)
    move = np.zeros((rows, size, size))
    move[:, :p, 0] = ar
    move[:, np.arange(size - 1), np.arange(1, size)] = 1
    push = np.zeros((rows, size))
    push[:, 0] = 1
    push[:, 1 : q + 1] = ma
    noise = push[:, :, None] * push[:, None, :]
    # The stationary covariance solves P = M P M' + noise.
    both = (move[:, :, None, :, None] * move[:, None, :, None, :]).reshape(rows, size * size, size * size)
    cov = np.linalg.solve(np.eye(size * size) - both, noise.reshape(rows, -1, 1)).reshape(rows, size, size)
    state = np.zeros((rows, size))
    squares, logs = np.zeros(rows), np.zeros(rows)
    for t in range(steps):
        miss, spread = y[:, t] - state[:, 0], np.maximum(cov[:, 0, 0], 1e-300)
        squares += miss * miss / spread
        logs += np.log(spread)
        gain = (move @ cov[:, :, :1])[:, :, 0] / spread[:, None]
        state = (move @ state[:, :, None])[:, :, 0] + gain * miss[:, None]
        cov = move @ cov @ move.transpose(0, 2, 1) + noise - gain[:, :, None] * gain[:, None, :] * spread[:, None, None]
    variance = np.maximum(squares / steps, 1e-300)
    return Filtered(-0.5 * (steps * (np.log(2 * np.pi * variance) + 1) + logs), variance, state, move)


def model(free: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(ar, ma) from unbounded parameters: stationary and invertible for any of them."""
    partial = MOST * np.tanh(free)
    return coefficients(partial[:, :p]), -coefficients(partial[:, p:])


def fit(y: np.ndarray, p: int, q: int, maxiter: int) -> tuple[np.ndarray, np.ndarray]:
    """(ar, ma) of the greatest likelihood, by at most `maxiter` quasi-Newton (BFGS) steps from white noise, all rows side by
    side, each with its own curvature and step length."""
    rows, k = len(y), p + q
    x = np.zeros((rows, k))
    if not k:
        return x, x
    cost = lambda at, of: -kalman(y[of], *model(at, p)).loglik

    def slope(at: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = np.empty_like(at)
        for i in range(k):
            d = np.zeros(k)
            d[i] = STEP
            out[:, i] = (cost(at + d, of) - cost(at - d, of)) / (2 * STEP)
        return out

    every = np.arange(rows)
    now, g = cost(x, every), slope(x, every)
    curve = np.broadcast_to(np.eye(k) / y.shape[1], (rows, k, k)).copy()
    left = every
    for _ in range(maxiter):
        left = left[np.abs(g[left]).max(1) > FLAT * (1 + np.abs(now[left]))]
        if not len(left):
            break
        way = -np.einsum("rij,rj->ri", curve[left], g[left])
        down = (way * g[left]).sum(1)
        bad = down >= 0
        way[bad], curve[left[bad]] = -g[left[bad]] / y.shape[1], np.eye(k) / y.shape[1]
        down = (way * g[left]).sum(1)
        way *= np.minimum(1, 2 / np.maximum(np.abs(way).max(1), 1e-12))[:, None]
        length, done, new = np.ones(len(left)), np.zeros(len(left), bool), now[left].copy()
        for _ in range(30):  # halve the steps that don't go down enough
            todo = np.flatnonzero(~done)
            if not len(todo):
                break
            new[todo] = cost(x[left[todo]] + length[todo, None] * way[todo], left[todo])
            done[todo] = new[todo] <= now[left[todo]] + 1e-4 * length[todo] * down[todo]
            length[todo[~done[todo]]] /= 2
        left, way, length, new = left[done], way[done], length[done], new[done]
        if not len(left):
            break
        s = length[:, None] * way
        x[left] += s
        fresh = slope(x[left], left)
        d = fresh - g[left]
        sd = (s * d).sum(1)
        ok = sd > 1e-12
        rho = np.where(ok, 1 / np.where(ok, sd, 1), 0)[:, None, None]
        turn = np.eye(k) - rho * s[:, :, None] * d[:, None, :]
        better = turn @ curve[left] @ turn.transpose(0, 2, 1) + rho * s[:, :, None] * s[:, None, :]
        curve[left[ok]] = better[ok]
        now[left], g[left] = new, fresh
    return model(x, p)


def forecast(close: np.ndarray, order: tuple[int, int, int], maxiter: int, horizon: int) -> np.ndarray:
    """The next `horizon` values of each row of `close`, by a model of `order` (p, d, q) fitted to it.

    A series that is not differenced is taken about its mean. Rows with fewer differences than p + q + 2, and rows whose
    differences are all equal to 0, go on as white noise does.
    """
    p, d, q = order
    y = np.diff(close, d, axis=1) if d else close - close.mean(1, keepdims=True)
    if y.shape[1] < 1:
        ahead = np.zeros((len(close), horizon))
    else:
        scale = np.sqrt((y * y).mean(1))
        live = scale > 0
        y = y / np.where(live, scale, 1)[:, None]
        if y.shape[1] < p + q + 2:
            live[:] = False
        ahead = np.zeros((len(close), horizon))
        if live.any():
            f = kalman(y[live], *fit(y[live], p, q, maxiter))
            state, steps = f.state[:, :, None], []
            for _ in range(horizon):
                steps.append(state[:, 0, 0])
                state = f.transition @ state
            ahead[live] = np.stack(steps, 1) * scale[live, None]
    if not d:
        return ahead + close.mean(1, keepdims=True)
    for k in reversed(range(min(d, close.shape[1]))):  # add up what was differenced, the last difference first
        ahead = np.diff(close, k, axis=1)[:, -1:] + ahead.cumsum(1)
    return ahead
