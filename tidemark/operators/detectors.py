"""Stateful detectors and indicators as fold steps, for ordered batches by key and for streams.

State is a dict of numbers and of lists or arrays of numbers, so that any store can hold it.
"""

from __future__ import annotations

import math

import numpy as np


def cusum_step(state: dict, value: float, threshold: float) -> bool:
    """Two one-sided sums of values; both begin anew when either passes the threshold."""
    up = max(0.0, state.get("up", 0.0) + value)
    down = min(0.0, state.get("down", 0.0) + value)
    fired = up > threshold or down < -threshold
    state["up"], state["down"] = (0.0, 0.0) if fired else (up, down)
    return fired


#: Pseudo-observations of the mean, shape and rate of the precision before any value; one change in so many
#: values; run lengths kept; values of a run beyond which its density is taken for normal.
PRIOR, SHAPE, RATE, HAZARD, LONGEST, NORMAL_FROM = 0.1, 1.0, 0.001, 1 / 250, 50, 20


def _log_predictive(x: float, n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Log density of x after runs of n values with these sums, by a normal-gamma model with mean 0."""
    kappa, alpha, some = PRIOR + n, SHAPE + n / 2, np.maximum(n, 1.0)
    beta = RATE + 0.5 * (squares - total * total / some) + PRIOR * n * (total / some) ** 2 / (2 * kappa)
    scale2 = beta * (kappa + 1) / (alpha * kappa)
    z2, dof = (x - total / kappa) ** 2 / scale2, 2 * alpha
    gammas = np.array([math.lgamma((d + 1) / 2) - math.lgamma(d / 2) for d in dof])
    student = gammas - 0.5 * np.log(dof * math.pi * scale2) - (dof + 1) / 2 * np.log1p(z2 / dof)
    return np.where(n > NORMAL_FROM, -0.5 * (z2 + np.log(2 * math.pi * scale2)), student)


def change_point_step(state: dict, x: float) -> tuple[float, int]:
    """Bayesian change-point filter over run lengths: the chance that a run begins here, and the likeliest run length.

    At the first value all mass is at run length 0, which holds that value, and the chance of a change is 0. The longest run
    gathers no values of its own and does not grow: it keeps the prior's density.
    """
    if "log" not in state:
        state.update(log=np.zeros(1), n=np.ones(1), total=np.array([x]), squares=np.array([x * x]))
        return 0.0, 0
    joint = np.asarray(state["log"]) + _log_predictive(x, *(np.asarray(state[c]) for c in ("n", "total", "squares")))
    top = joint.max()
    change = top + math.log(float(np.exp(joint - top).sum())) + math.log(HAZARD)
    log = np.append(change, joint + math.log1p(-HAZARD))[:LONGEST]
    top = log.max()
    state["log"] = log - (top + math.log(float(np.exp(log - top).sum())))
    for name, more in (("n", 1.0), ("total", x), ("squares", x * x)):
        own = np.append(0.0, state[name])[: LONGEST - 1] + more
        state[name] = np.append(own, 0.0) if len(log) == LONGEST else own
    return min(1.0, math.exp(state["log"][0])), int(state["log"].argmax())


def adx_step(state: dict, high: float, low: float, close: float, n: int = 14) -> tuple[float, float, float]:
    """Mean directional index and both directional indicators, by Wilder means, each from its first value on."""
    before = state.get("bar")
    state["bar"] = (high, low, close)
    if before is None:
        return 0.0, 0.0, 0.0
    up, down = high - before[0], before[1] - low
    moves = (up if up > down and up > 0 else 0.0, down if down > up and down > 0 else 0.0, max(high - low, abs(high - before[2]), abs(low - before[2])))
    means = state["means"] = [x if m is None else (1 - 1 / n) * m + x / n for m, x in zip(state.get("means", (None,) * 3), moves)]
    if means[2] < 1e-10:
        return 0.0, 0.0, 0.0
    plus, minus = 100 * means[0] / means[2], 100 * means[1] / means[2]
    dx = 100 * abs(plus - minus) / (plus + minus) if plus + minus > 1e-10 else 0.0
    state["adx"] = dx if "adx" not in state else (1 - 1 / n) * state["adx"] + dx / n
    return state["adx"], plus, minus


def kalman_step(state: dict, x: float, y: float, q: float = 1e-5, r: float = 1e-3, warm_up: int = 10, limit: float = 5.0) -> tuple[float, float, bool]:
    """Intercept and slope of y on x as a random walk; begins anew where the slope runs off."""
    if "p" not in state:
        state.update(a=0.0, b=1.0, p=(1.0, 0.0, 1.0), n=0)
    (p00, p01, p11), a, b = state["p"], state["a"], state["b"]
    p00, p11 = p00 + q, p11 + q
    s = p00 + 2 * x * p01 + x * x * p11 + r
    k0, k1 = (p00 + x * p01) / s, (p01 + x * p11) / s
    e = y - a - b * x
    a, b = a + k0 * e, b + k1 * e
    state["p"] = (p00 - k0 * (p00 + x * p01), p01 - k0 * (p01 + x * p11), p11 - k1 * (p01 + x * p11))
    state["a"], state["b"], state["n"] = a, b, state["n"] + 1
    if abs(b) >= limit:
        state.clear()
        return 0.0, 1.0, False
    return a, b, state["n"] >= warm_up


def seeded_step(state: dict, name: str, x: float, alpha: float) -> float:
    """Exponential mean with the first value as its seed."""
    state[name] = x if name not in state else (1 - alpha) * state[name] + alpha * x
    return state[name]


def ring_step(state: dict, name: str, x: float, n: int) -> list[float]:
    """The last n values, this one included."""
    ring = state.setdefault(name, [])
    ring.append(x)
    if len(ring) > n:
        del ring[0]
    return ring


def garch_step(state: dict, x: float, parameters: tuple[float, float, float, float]) -> float:
    """Volatility by the return before, see ``scan.garch``; x is kept for the next step."""
    omega, alpha, gamma, beta = parameters
    if "variance" not in state:
        state["variance"] = omega / max(0.01, 1 - alpha - gamma / 2 - beta)
    else:
        r = state["return"]
        state["variance"] = omega + (alpha + (gamma if r < 0 else 0.0)) * r * r + beta * state["variance"]
    state["return"] = x
    return math.sqrt(state["variance"])


def rank_below_step(state: dict, name: str, x: float, n: int) -> float:
    """Share of the other of the last n values that are below this one; a half for fewer than two."""
    ring = ring_step(state, name, x, n)
    return 0.5 if len(ring) < 2 else sum(v < x for v in ring) / (len(ring) - 1)
