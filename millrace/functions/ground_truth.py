"""Ground truths of numeric records: what a kind is given, what it claims, and how the claims are recomputed.

A record is a JSON object with its kind.  solve() of a kind works on stacks:
rows of one kind whose values have the same shapes are recomputed in one call,
numbers as [n], vectors as [n, m], matrices as [n, m, k], complex numbers as
pairs.  The same table draws new records: draw() makes given values from
uniform numbers, so generator and check share nothing but the formula.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import stacked as S
from .stacked import t


@dataclass(frozen=True)
class Kind:
    """given and claims are names; a claim is number by default, or after a colon b (exact), r (roots as pairs), e (relative 1e-8), q (absolute 1e-5)."""

    given: str
    claims: str
    solve: Callable
    draw: Callable | None = None
    task: str = ""
    domain: str = "linear_systems"


class Given:
    """Values of a stack by name."""

    def __init__(self, values: dict):
        self.__dict__.update(values)


class Draws:
    """Uniform numbers [n, slots] in [0, 1), used from the left."""

    def __init__(self, u: np.ndarray):
        self.u, self.at = u, 0

    def _next(self, shape: tuple[int, ...]) -> np.ndarray:
        size = int(np.prod(shape))
        if self.at + size > self.u.shape[1]:
            raise ValueError("a kind asks for more numbers than it has slots")
        self.at += size
        return self.u[:, self.at - size : self.at].reshape(len(self.u), *shape)

    def real(self, low: float, high: float, *shape: int) -> np.ndarray:
        return np.round(low + (high - low) * self._next(shape), 3)

    def whole(self, low: int, high: int, *shape: int) -> np.ndarray:
        """Integers from low to high, both included."""
        return low + np.floor((high - low + 1) * self._next(shape))

    def one_of(self, *values) -> np.ndarray:
        return np.array(values)[np.floor(len(values) * self._next(())).astype(int)]

    def diagonal(self, low: float, high: float, size: int) -> np.ndarray:
        return self.real(low, high, size)[:, :, None] * np.eye(size)

    def stable(self, size: int) -> np.ndarray:
        """Upper triangular matrices with eigenvalues in [-4, -0.5]."""
        return self.diagonal(-4, -0.5, size) + np.triu(self.whole(-2, 2, size, size), 1)


def pairs(z: np.ndarray) -> np.ndarray:
    return np.stack((np.real(z), np.imag(z)), axis=-1)


def complexes(p: np.ndarray) -> np.ndarray:
    return p[..., 0] + 1j * p[..., 1]


def hurwitz(z: np.ndarray) -> np.ndarray:
    return (np.real(z) < 0).all(axis=-1)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=-1)


def times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (a @ x[..., None])[..., 0]


def rank(a: np.ndarray) -> np.ndarray:
    return np.linalg.matrix_rank(a)


def _poles(g):
    z = np.linalg.eigvals(g.A)
    inside = np.where(np.array(g.time_domain) == "discrete", (np.abs(z) < 1).all(axis=1), hurwitz(z))
    return {"eigenvalues": pairs(z), "stable": inside}


def _closed(name: str, product: Callable) -> Callable:
    def solve(g):
        m = g.A - product(g)
        z = np.linalg.eigvals(m)
        return {name: m, "eigenvalues": pairs(z), "stable": hurwitz(z)}

    return solve


def _observability(g):
    o = t(S.krylov(t(g.A), t(g.C)))
    r = rank(o)
    return {"O": o, "rank": r, "observable": r == g.A.shape[-1]}


def _pbh(g):
    k = g.A.shape[-1]
    z = complexes(g.eigenvalues) if g.eigenvalues.ndim == 3 else g.eigenvalues
    wide = np.concatenate((z[:, :, None, None] * np.eye(k) - g.A[:, None], np.broadcast_to(g.C[:, None], (len(z), z.shape[1], *g.C.shape[1:]))), axis=2)
    r = rank(wide)
    return {"pbh_ranks": r, "observable": (r == k).all(axis=1)}


def _gramian(a: np.ndarray, q: np.ndarray) -> dict:
    w = S.lyapunov(a, q)
    return {"W": w, "eigenvalues": np.linalg.eigvalsh(w)}


def _second_order(g):
    root = np.sqrt(1 - g.zeta**2)
    z = np.stack((-g.zeta * g.omega_n + 1j * g.omega_n * root, -g.zeta * g.omega_n - 1j * g.omega_n * root), axis=1)
    return {"omega_d": g.omega_n * root, "overshoot_percent": 100 * np.exp(-np.pi * g.zeta / root), "peak_time": np.pi / (g.omega_n * root), "settling_2": np.log(50) / (g.zeta * g.omega_n), "poles": pairs(z)}


def _feedback(g):
    num = g.gain[:, None] * g.plant_num
    den = g.plant_den + np.concatenate((np.zeros((len(num), g.plant_den.shape[1] - num.shape[1])), num), axis=1)
    z = S.roots(den)
    return {"closed_num": num, "closed_den": den, "poles": pairs(z), "stable": hurwitz(z)}


def _sensitivity(g):
    loop = complexes(g.L)
    s = 1 / (1 + loop)
    return {"S": pairs(s), "T": pairs(loop * s), "S_mag": np.abs(s), "T_mag": np.abs(loop * s)}


def _lead(g):
    sine = np.sin(np.radians(g.phi_deg))
    alpha = (1 - sine) / (1 + sine)
    tau = 1 / (g.omega_m * np.sqrt(alpha))
    return {"alpha": alpha, "tau": tau, "zero": -1 / tau, "pole": -1 / (alpha * tau)}


def _routh(g):
    a3, a2, a1, a0 = g.coefficients[:, 1:].T
    b1 = a2 - a1 / a3
    column = np.stack((np.ones(len(a0)), a3, b1, a1 - a3 * a0 / b1, a0), axis=1)
    return {"first_column": column, "poles": pairs(S.roots(g.coefficients)), "stable": (column > 0).all(axis=1)}


def _locus(g):
    right = (g.poles > g.point[:, None]).sum(axis=1) + (g.zeros > g.point[:, None]).sum(axis=1)
    return {"right_count": right, "on_locus": right % 2 == 1}


def _kalman(g):
    s = g.H @ g.P_minus @ t(g.H) + g.R
    k = g.P_minus @ t(g.H) @ np.linalg.inv(s)
    left = S.eye(g.P_minus) - k @ g.H
    seen = g.z - times(g.H, g.x_minus)
    return {"innovation": seen, "S": s, "K": k, "x_plus": g.x_minus + times(k, seen), "P_plus": left @ g.P_minus @ t(left) + k @ g.R @ t(k)}


def _regulator(solver: Callable) -> Callable:
    def solve(g):
        p, k = solver(g.A, g.B, g.Q, g.R)
        return {"P": p, "K": k, "closed_poles": pairs(np.linalg.eigvals(g.A - g.B @ k))}

    return solve


def _backward(g):
    steps = int(g.horizon[0])
    p, gains = [g.qf], []
    for _ in range(steps):
        share = g.a * g.b * p[0] / (g.r + g.b**2 * p[0])
        gains.insert(0, share)
        p.insert(0, g.q + g.a**2 * p[0] - g.a * g.b * p[0] * share)
    return {"K": np.stack(gains, axis=1), "P": np.stack(p, axis=1)}


def _prediction(g):
    n = int(g.horizon[0])
    lag = np.arange(n)[:, None] - np.arange(n)
    toeplitz = np.where(lag >= 0, g.a[:, None, None] ** np.maximum(lag, 0), 0) * g.b[:, None, None]
    return {"F": g.a[:, None, None] ** np.arange(1, n + 1)[:, None], "G": toeplitz}


def _unconstrained(g):
    f = np.stack((g.a, g.a**2), axis=1)
    m = np.zeros((len(f), 2, 2))
    m[:, 0, 0] = m[:, 1, 1] = g.b
    m[:, 1, 0] = g.a * g.b
    free = f * g.x0[:, None]
    u = -np.linalg.solve(t(m) @ m + g.r[:, None, None] * np.eye(2), t(m) @ free[..., None])[..., 0]
    x = free + times(m, u)
    return {"F": f[..., None], "G": m, "U": u, "X": x, "cost": dots(x, x) + g.r * dots(u, u)}


def _box(g):
    """Two moves of x+ = x + u within a box: the best of the free optimum, the edges and the corners that is allowed."""
    x0, r, b = g.x0, g.r, g.limit
    best = np.linalg.solve(np.stack((np.stack((2 + r, 1 + 0 * r), 1), np.stack((1 + 0 * r, 1 + r), 1)), 1), np.stack((-2 * x0, -x0), 1)[..., None])[..., 0]
    found = [best]
    for s in (-1, 1):
        found += [np.stack((s * b, np.clip(-(x0 + s * b) / (1 + r), -b, b)), 1), np.stack((np.clip(-(2 * x0 + s * b) / (2 + r), -b, b), s * b), 1)]
    u = np.stack(found, axis=1)
    x = np.stack((x0[:, None] + u[..., 0], x0[:, None] + u[..., 0] + u[..., 1]), axis=-1)
    cost = np.where((np.abs(u) <= b[:, None, None] * (1 + 1e-12)).all(axis=-1), (x**2).sum(axis=-1) + r[:, None] * (u**2).sum(axis=-1), np.inf)
    at = np.argmin(cost, axis=1)
    row = np.arange(len(at))
    return {"U": u[row, at], "X": x[row, at], "cost": cost[row, at]}


def _equilibria(g):
    radius = np.sqrt(g.a / g.b)
    x = np.stack((-radius, 0 * radius, radius), axis=1)
    slope = g.a[:, None] - 3 * g.b[:, None] * x**2
    return {"equilibria": x, "derivatives": slope, "stable": slope < 0}


def _jacobian(g):
    j = np.zeros((len(g.a), 2, 2))
    j[:, 0, 0], j[:, 1, 0], j[:, 1, 1] = -g.a, 1, -g.b
    return {"J": j, "poles": pairs(np.stack((-g.a, -g.b), axis=1) + 0j), "locally_stable": (g.a > 0) & (g.b > 0)}


def _quadratic(g):
    q = -(t(g.A) @ g.P + g.P @ g.A)
    e = np.linalg.eigvalsh(q)
    return {"Q": q, "Q_eigenvalues": e, "ok": (e > 0).all(axis=1)}


def _kharitonov(g):
    low, high = g.lower, g.upper
    # ascending coefficients; a corner takes two neighbours low, two high
    corners = np.array([[0, 0, 1, 1], [1, 1, 0, 0], [1, 0, 0, 1], [0, 1, 1, 0]], bool)
    p = np.where(corners, high[:, None], low[:, None])
    z = S.roots(p[..., ::-1].reshape(-1, 4)).reshape(len(p), 4, 3)
    flags = hurwitz(z)
    return {"polynomials": p, "poles": pairs(z), "stable_flags": flags, "robustly_hurwitz": flags.all(axis=1)}


def _peak(g):
    m = np.abs(1 / (1 + complexes(g.L)))
    return {"magnitudes": m, "peak_index": np.argmax(m, axis=1), "peak": m.max(axis=1)}


def _gradient(g):
    error = g.y - dots(g.phi, g.theta)
    return {"error": error, "theta_next": g.theta + (g.dt * g.gamma * error)[:, None] * g.phi}


def _normalised(g):
    error, size = g.y - dots(g.phi, g.theta), 1 + dots(g.phi, g.phi)
    return {"error": error, "denominator": size, "theta_next": g.theta + (g.gamma * error / size)[:, None] * g.phi}


def _regressors(g):
    gram = t(g.Phi) @ g.Phi
    r = rank(g.Phi)
    return {"rank": r, "gramian": gram, "eigenvalues": np.linalg.eigvalsh(gram), "identifiable": r == g.Phi.shape[-1]}


def _arx(g):
    phi = np.stack((g.y[:, :-1], g.u[:, :-1]), axis=-1)
    theta = times(np.linalg.pinv(phi), g.y[:, 1:])
    return {"Phi": phi, "theta": theta, "rank": rank(phi), "residual_norm": np.linalg.norm(g.y[:, 1:] - times(phi, theta), axis=1)}


def _autocorrelation(g):
    e = g.residual
    return {"acf": np.stack([dots(e[:, k:], e[:, :-k]) / dots(e, e) for k in range(1, int(g.lags[0]) + 1)], axis=1)}


def _laplacian(g):
    e = np.linalg.eigvalsh(g.L)
    sound = np.isclose(g.L, t(g.L)).all(axis=(1, 2)) & np.isclose(g.L.sum(axis=2), 0).all(axis=1)
    return {"eigenvalues": e, "connected": e[:, 1] > 1e-10, "lambda2": e[:, 1], "ok": sound}


def _consensus(g):
    e = np.linalg.eigvalsh(g.L)
    closed = 1 - g.alpha[:, None] * e
    return {"laplacian_eigenvalues": e, "closed_eigenvalues": closed, "stable_disagreement": (np.abs(closed[:, 1:]) < 1).all(axis=1)}


def _allocation(g):
    u = g.B * (g.desired / dots(g.B, g.B))[:, None]
    return {"u": u, "achieved": dots(g.B, u)}


def _isolation(g):
    base = dots(g.B, g.u)
    outputs = base[:, None] - (1 - g.loss_factor)[:, None] * g.B * g.u
    off = np.abs(outputs - g.measured[:, None])
    found = np.argmin(off, axis=1)
    return {"candidate_outputs": outputs, "residuals": off, "identified_index": found, "ok": found == g.failed_index}


def _interval(g):
    low, high = (g.x_min + g.w_max - g.a * g.x) / g.b, (g.x_max - g.w_max - g.a * g.x) / g.b
    return {"u_lower": low, "u_upper": high, "u_safe": np.minimum(np.maximum(g.u_nom, low), high), "ok": (g.b > 0) & (low <= high)}


def _placement(g):
    z = complexes(g.desired_poles) if g.desired_poles.ndim == 3 else g.desired_poles + 0j
    k = S.placed(g.A, g.B, z)
    return {"K": k, "closed_poles": pairs(z)}


def _transfer(g):
    return {"poles": pairs(S.roots(g.denominator)), "zeros": pairs(S.roots(g.numerator)), "dc_gain": g.numerator[:, -1] / g.denominator[:, -1]}


def _small_transfer(g):
    z = S.roots(g.numerator)[:, 0]
    return {"poles": np.real(S.roots(g.denominator)), "zero": np.real(z), "dc_gain": g.numerator[:, -1] / g.denominator[:, -1]}


def _frequency(g):
    x = g.tau * g.omega
    size = g.gain / np.sqrt(1 + x * x)
    return {"magnitude": size, "magnitude_db": 20 * np.log10(size), "phase_deg": -np.degrees(np.arctan(x))}


def _discounted(g):
    terms = g.rewards * g.gamma[:, None] ** np.arange(g.rewards.shape[1])
    return {"terms": terms, "return": terms.sum(axis=1)}


def _scheduled(g):
    w = (g.sigma - g.sigma_low) / (g.sigma_high - g.sigma_low)
    return {"weight": w, "scheduled": g.low + w[:, None] * (g.high - g.low), "ok": (w >= 0) & (w <= 1)}


def _barrier(g):
    h = g.x - g.x_min
    return {"h": h, "lower_bound": -g.alpha * h, "u_safe": np.maximum(g.u_nom, -g.alpha * h), "active": g.u_nom < -g.alpha * h}


def _jumps(g):
    f = g.p * g.a1**2 + (1 - g.p) * g.a2**2
    return {"factor": f, "stable": f < 1}


def _trigger(g):
    off, bar = np.abs(g.x_hat - g.x), g.sigma * np.abs(g.x)
    return {"error_abs": off, "threshold": bar, "trigger": off >= bar}


def _tube(g):
    left = g.bound - g.error
    return {"tightened": left, "interval": np.stack((-left, left), axis=1), "nonempty": left >= 0}


def _margins(g):
    gain = 1 / g.magnitude_at_phase_crossover
    return {"gain_margin": gain, "gain_margin_db": 20 * np.log10(gain), "phase_margin_deg": 180 + g.phase_at_gain_crossover_deg}


def _weighted(g):
    p = g.weight * g.response
    return {"products": p, "peak": p.max(axis=1), "certified": p.max(axis=1) < g.strict_bound}


def _natural(g):
    wn = np.sqrt(g.a0)
    return {"omega_n": wn, "zeta": g.a1 / (2 * wn), "poles": pairs(S.roots(np.stack((1 + 0 * wn, g.a1, g.a0), axis=1)))}


def _trace_test(g):
    return {"asymptotically_stable": (np.trace(g.A, axis1=1, axis2=2) < 0) & (np.linalg.det(g.A) > 0)}


def _where(n: int, **flags) -> dict:
    return {k: np.full(n, v) for k, v in flags.items()}


def _system(d: Draws, size: int = 2) -> dict:
    """A controllable canonical pair."""
    a = np.zeros((len(d.u), size, size))
    a[:, np.arange(size - 1), np.arange(1, size)] = 1
    a[:, -1] = d.real(-4, -0.5, size)
    b = np.zeros((len(a), size, 1))
    b[:, -1, 0] = 1
    return {"A": a, "B": b}


def _weights(d: Draws) -> dict:
    return {"Q": d.diagonal(1, 10, 2), "R": d.real(0.5, 2, 1, 1)}


def _plant(d: Draws) -> dict:
    n = len(d.u)
    return {"plant_num": d.real(0.5, 3, 1), "plant_den": np.concatenate((np.ones((n, 1)), d.real(0.5, 6, 2)), axis=1), "gain": d.real(0.5, 8)}


def _graph(d: Draws) -> dict:
    """A weighted path of four nodes."""
    w = d.real(0.5, 3, 3)
    out = np.zeros((len(w), 4, 4))
    for i in range(3):
        out[:, i, i] += w[:, i]
        out[:, i + 1, i + 1] += w[:, i]
        out[:, i, i + 1] -= w[:, i]
        out[:, i + 1, i] -= w[:, i]
    return {"L": out}


def _lossy(d: Draws) -> dict:
    b, u, factor, failed = d.whole(1, 5, 3), d.whole(1, 6, 3) + np.array([0, 36, 300]), d.real(0.2, 0.8), d.whole(0, 2)
    cut = np.where(np.arange(3) == failed[:, None], factor[:, None], 1.0)
    return {"B": b, "u": u, "loss_factor": factor, "failed_index": failed, "measured": dots(b * cut, u)}


def _monic(d: Draws, k: int, low: float, high: float) -> np.ndarray:
    return np.concatenate((np.ones((len(d.u), 1)), d.real(low, high, k)), axis=1)


def _arx_data(d: Draws) -> dict:
    a, b, u = d.real(0.2, 0.8), d.real(0.5, 2), d.whole(-3, 3, 6)
    u[:, 0] = 2
    y = [1 + 0 * a]
    for i in range(5):
        y.append(a * y[-1] + b * u[:, i])
    return {"u": u, "y": np.stack(y, axis=1)}


KINDS: dict[str, Kind] = {
    "eigenvalue_stability": Kind("A time_domain", "eigenvalues:r stable:b", _poles, lambda d: {"A": d.diagonal(-3, 1.2, 3) + np.triu(d.whole(-3, 3, 3, 3), 1), "time_domain": d.one_of("continuous", "discrete")}, "Find the eigenvalues and decide asymptotic stability."),
    "continuous_lti_eigenvalue_stability": Kind("A", "asymptotically_stable:b", _trace_test, lambda d: {"A": d.whole(-4, 4, 2, 2)}, "Decide asymptotic stability."),
    "matrix_exponential": Kind("A time", "Phi:e", lambda g: {"Phi": S.exponential(g.A * g.time[:, None, None])}, lambda d: {"A": d.stable(2), "time": d.real(0.1, 2)}, "Find the state transition matrix."),
    "zoh_discretization": Kind("A B sample_time", "Ad Bd", lambda g: dict(zip(("Ad", "Bd"), S.held(g.A, g.B, g.sample_time))), lambda d: {"A": d.stable(2), "B": d.whole(-2, 2, 2, 1), "sample_time": d.real(0.01, 0.5)}, "Sample with a zero-order hold."),
    "observability_rank": Kind("A C", "O rank:b observable:b", _observability, lambda d: {"A": d.whole(-3, 3, 3, 3), "C": d.whole(-1, 1, 1, 3)}, "Build the observability matrix and its rank."),
    "observability": Kind("A C", "O rank:b observable:b", _observability, lambda d: {"A": d.whole(-3, 3, 2, 2), "C": d.whole(-1, 1, 1, 2)}, "Decide observability."),
    "pbh_observability": Kind("A C eigenvalues", "pbh_ranks:b observable:b", _pbh, lambda d: (lambda v: {"A": v[:, :, None] * np.eye(3), "C": d.whole(0, 1, 1, 3), "eigenvalues": v})(d.whole(-3, 3, 3)), "Apply the PBH test."),
    "state_feedback": Kind("A B K", "Acl eigenvalues:r stable:b", _closed("Acl", lambda g: g.B @ g.K), lambda d: _system(d) | {"K": d.real(-3, 6, 1, 2)}, "Find the closed-loop eigenvalues.", "state_feedback"),
    "observer_error": Kind("A L C", "Ae eigenvalues:r stable:b", _closed("Ae", lambda g: g.L @ g.C), lambda d: {"A": _system(d)["A"], "L": d.real(-2, 6, 2, 1), "C": d.whole(0, 1, 1, 2)}, "Find the eigenvalues of the observer error.", "estimation_filtering"),
    "pole_placement": Kind("A B desired_poles", "K closed_poles:r", _placement, lambda d: _system(d) | {"desired_poles": pairs(d.real(-6, -1, 2) + 0j)}, "Place the poles.", "state_feedback"),
    "continuous_lyapunov": Kind("A Q", "P", lambda g: {"P": S.lyapunov(t(g.A), g.Q)}, lambda d: {"A": d.stable(2), "Q": d.diagonal(1, 5, 2)}, "Solve the continuous Lyapunov equation."),
    "discrete_lyapunov": Kind("A Q", "P", lambda g: {"P": S.stein(t(g.A), g.Q)}, lambda d: {"A": d.diagonal(-0.9, 0.9, 2), "Q": d.diagonal(1, 5, 2)}, "Solve the discrete Lyapunov equation."),
    "controllability_gramian": Kind("A B", "W eigenvalues", lambda g: _gramian(g.A, g.B @ t(g.B)), lambda d: {"A": d.stable(2), "B": d.whole(1, 3, 2, 1)}, "Find the controllability Gramian."),
    "observability_gramian": Kind("A C", "W eigenvalues", lambda g: _gramian(t(g.A), t(g.C) @ g.C), lambda d: {"A": d.stable(2), "C": d.whole(1, 3, 1, 2)}, "Find the observability Gramian."),
    "first_order_frequency": Kind("gain tau omega", "magnitude magnitude_db phase_deg", _frequency, lambda d: {"gain": d.real(0.5, 10), "tau": d.real(0.1, 5), "omega": d.real(0.1, 20)}, "Find magnitude and phase at the frequency.", "classical_control"),
    "first_order_step": Kind("gain step tau", "final at_tau settling_2", lambda g: {"final": g.gain * g.step, "at_tau": -g.gain * g.step * np.expm1(-1), "settling_2": g.tau * np.log(50)}, lambda d: {"gain": d.real(0.5, 10), "step": d.real(0.5, 4), "tau": d.real(0.1, 8)}, "Give the step response metrics.", "classical_control"),
    "second_order_transient": Kind("zeta omega_n", "omega_d overshoot_percent peak_time settling_2 poles:r", _second_order, lambda d: {"zeta": d.real(0.1, 0.9), "omega_n": d.real(0.5, 12)}, "Give the transient metrics.", "classical_control"),
    "second_order": Kind("a1 a0", "omega_n zeta poles:r", _natural, lambda d: {"a1": d.real(0.2, 6), "a0": d.real(0.5, 20)}, "Find natural frequency, damping and poles.", "classical_control"),
    "closed_loop_tf": Kind("plant_num plant_den gain", "closed_num closed_den poles:r stable:b", _feedback, _plant, "Close the unity feedback loop.", "classical_control"),
    "sensitivity_complex": Kind("L", "S T S_mag T_mag", _sensitivity, lambda d: {"L": d.real(0.1, 3, 2)}, "Find both sensitivities.", "classical_control"),
    "lead_parameters": Kind("phi_deg omega_m", "alpha tau zero pole", _lead, lambda d: {"phi_deg": d.real(10, 65), "omega_m": d.real(0.5, 20)}, "Design the lead compensator.", "classical_control"),
    "polynomial_stability": Kind("coefficients", "poles:r stable:b", lambda g: (lambda z: {"poles": pairs(z), "stable": hurwitz(z)})(S.roots(g.coefficients)), lambda d: {"coefficients": _monic(d, 3, -1, 8)}, "Find the roots and decide stability.", "classical_control"),
    "routh_quartic": Kind("coefficients", "first_column poles:r stable:b", _routh, lambda d: {"coefficients": _monic(d, 4, 0.5, 9)}, "Fill the first Routh column.", "classical_control"),
    "root_locus_real_axis": Kind("poles zeros point", "right_count:b on_locus:b", _locus, lambda d: {"poles": d.whole(-8, 0, 3), "zeros": d.whole(-9, -1, 1), "point": d.whole(-9, 0) - 0.5}, "Is the point on the root locus?", "classical_control"),
    "crossover_margins": Kind("magnitude_at_phase_crossover phase_at_gain_crossover_deg", "gain_margin gain_margin_db phase_margin_deg", _margins, lambda d: {"magnitude_at_phase_crossover": d.real(0.05, 1.5), "phase_at_gain_crossover_deg": d.real(-200, -90)}, "Give both margins.", "classical_control"),
    "code_tf_properties": Kind("numerator denominator", "poles:r zeros:r dc_gain", _transfer, lambda d: {"numerator": d.real(0.5, 5, 2), "denominator": _monic(d, 2, 0.5, 9)}, "Find poles, zeros and the static gain.", "classical_control"),
    "transfer_properties": Kind("numerator denominator", "poles zero dc_gain", _small_transfer, None, "Find poles, zero and the static gain.", "classical_control"),
    "discrete_poles": Kind("poles", "spectral_radius stable:b", lambda g: (lambda r: {"spectral_radius": r, "stable": r < 1})(np.abs(g.poles).max(axis=1)), lambda d: {"poles": d.real(-1.3, 1.3, 2)}, "Find the spectral radius."),
    "scalar_kf_predict": Kind("a x b u P Q", "x_minus P_minus", lambda g: {"x_minus": g.a * g.x + g.b * g.u, "P_minus": g.a**2 * g.P + g.Q}, lambda d: {"a": d.real(0.5, 1.2), "x": d.real(-5, 5), "b": d.real(0.1, 2), "u": d.real(-3, 3), "P": d.real(0.1, 4), "Q": d.real(0.01, 1)}, "Do the time update.", "estimation_filtering"),
    "matrix_kf_update": Kind("x_minus P_minus H R z", "innovation S K x_plus P_plus", _kalman, lambda d: {"x_minus": d.real(-3, 3, 2), "P_minus": d.diagonal(0.5, 4, 2), "H": np.concatenate((np.ones((len(d.u), 1, 1)), d.whole(0, 1, 1, 1)), axis=2), "R": d.real(0.1, 2, 1, 1), "z": d.real(-4, 4, 1)}, "Do the measurement update.", "estimation_filtering"),
    "covariance_propagation": Kind("A P Q", "P_next", lambda g: {"P_next": g.A @ g.P @ t(g.A) + g.Q}, lambda d: {"A": d.real(-1, 1, 2, 2), "P": d.diagonal(0.5, 4, 2), "Q": d.diagonal(0.01, 1, 2)}, "Propagate the covariance.", "estimation_filtering"),
    "scalar_stationary_covariance": Kind("a q", "exists:b P", lambda g: {"exists": np.abs(g.a) < 1, "P": np.where(np.abs(g.a) < 1, g.q / (1 - g.a**2), np.nan)}, lambda d: {"a": d.real(-0.95, 0.95), "q": d.real(0.1, 5)}, "Find the stationary variance.", "estimation_filtering"),
    "continuous_lqr": Kind("A B Q R", "P K closed_poles:r", _regulator(S.care), lambda d: _system(d) | _weights(d), "Solve the continuous regulator.", "optimal_control"),
    "discrete_lqr": Kind("A B Q R", "P K closed_poles:r", _regulator(S.dare), lambda d: {"A": d.real(-1.1, 1.1, 2, 2), "B": np.ones((len(d.u), 2, 1)) * np.array([[0.3], [1.0]])} | _weights(d), "Solve the discrete regulator.", "optimal_control"),
    "finite_horizon_lqr": Kind("a b q r qf horizon", "K P", _backward, lambda d: {"a": d.real(0.6, 1.3), "b": d.real(0.3, 2), "q": d.real(0.5, 4), "r": d.real(0.5, 3), "qf": d.real(0.5, 6), "horizon": d.one_of(3, 4, 5)}, "Run the Riccati recursion backward.", "optimal_control"),
    "mpc_prediction": Kind("a b horizon", "F G", _prediction, lambda d: {"a": d.real(0.5, 1.2), "b": d.real(0.2, 2), "horizon": d.one_of(3, 4)}, "Build the prediction matrices.", "mpc"),
    "mpc_unconstrained": Kind("a b x0 r", "F G U X cost", _unconstrained, lambda d: {"a": d.real(0.5, 1.2), "b": d.real(0.2, 2), "x0": d.real(-5, 5), "r": d.real(0.1, 3)}, "Solve the unconstrained problem.", "mpc"),
    "mpc_box_qp": Kind("x0 r limit", "U:q X:q cost", _box, lambda d: {"x0": d.real(-5, 5), "r": d.real(0.1, 3), "limit": d.real(0.3, 2.5)}, "Solve the box-constrained problem.", "mpc"),
    "cubic_equilibria": Kind("a b", "equilibria derivatives stable:b", _equilibria, lambda d: {"a": d.real(0.3, 6), "b": d.real(0.3, 4)}, "Find the equilibria and their stability.", "nonlinear_systems"),
    "nonlinear_jacobian": Kind("a b", "J poles:r locally_stable:b", _jacobian, lambda d: {"a": d.real(-2, 4), "b": d.real(-2, 4)}, "Linearise at the origin.", "nonlinear_systems"),
    "scalar_linear_cubic_lyapunov": Kind("a b", "global_asymptotic:b local_exponential:b", lambda g: _where(len(g.a), global_asymptotic=True, local_exponential=True) | {"ok": (g.a > 0) & (g.b > 0)}, lambda d: {"a": d.real(0.2, 5), "b": d.real(0.2, 5)}, "Judge stability by a quadratic function.", "nonlinear_systems"),
    "quadratic_lyapunov": Kind("A P", "Q Q_eigenvalues", _quadratic, lambda d: {"A": d.diagonal(-4, -1, 2), "P": d.diagonal(1, 3, 2)}, "Differentiate the quadratic function.", "nonlinear_systems"),
    "feedback_linearization": Kind("k1 k2 b", "relative_degree:b closed_poles:r", lambda g: _where(len(g.b), relative_degree=2) | {"closed_poles": pairs(S.roots(np.stack((1 + 0 * g.k1, g.k2, g.k1), axis=1))), "ok": g.b != 0}, lambda d: {"k1": d.real(0.5, 12), "k2": d.real(0.5, 8), "b": d.real(0.5, 3)}, "Linearise by feedback.", "nonlinear_systems"),
    "zero_dynamics": Kind("a", "relative_degree:b zero_pole minimum_phase:b", lambda g: _where(len(g.a), relative_degree=2) | {"zero_pole": -g.a, "minimum_phase": g.a > 0}, lambda d: {"a": d.real(-4, 4)}, "Find the zero dynamics.", "nonlinear_systems"),
    "sliding_reachability": Kind("k dmax", "eta sufficient:b", lambda g: {"eta": g.k - g.dmax, "sufficient": g.k > g.dmax}, lambda d: {"k": d.real(0.2, 5), "dmax": d.real(0.2, 5)}, "Check the reaching condition.", "nonlinear_systems"),
    "scalar_dynamic_inversion": Kind("gain x reference a b", "virtual u", lambda g: (lambda v: {"virtual": v, "u": (v - g.a * g.x) / g.b})(g.gain * (g.reference - g.x)), lambda d: {"gain": d.real(0.5, 6), "x": d.real(-4, 4), "reference": d.real(-4, 4), "a": d.real(-2, 2), "b": d.real(0.3, 3)}, "Invert the dynamics.", "nonlinear_systems"),
    "nonlinear_equilibrium_feedforward": Kind("a b reference", "u_eq residual", lambda g: {"u_eq": g.a * g.reference**3 / g.b, "residual": 0 * g.a}, lambda d: {"a": d.real(0.2, 3), "b": d.real(0.3, 3), "reference": d.real(-3, 3)}, "Find the equilibrium input.", "nonlinear_systems"),
    "gain_schedule_interpolation": Kind("sigma sigma_low sigma_high low high", "weight scheduled", _scheduled, lambda d: {"sigma": d.real(2, 4), "sigma_low": d.real(0, 2), "sigma_high": d.real(4, 6), "low": d.real(0.5, 4, 2), "high": d.real(2, 9, 2)}, "Interpolate the gains.", "adaptive_control"),
    "scalar_cbf_filter": Kind("x x_min alpha u_nom", "h lower_bound u_safe active:b", _barrier, lambda d: {"x": d.real(-2, 4), "x_min": d.real(-3, 1), "alpha": d.real(0.2, 4), "u_nom": d.real(-5, 5)}, "Filter the input.", "safety"),
    "minimum_norm_allocation": Kind("B desired", "u achieved", _allocation, lambda d: {"B": d.whole(1, 6, 3), "desired": d.real(-9, 9)}, "Allocate with least norm.", "control_allocation"),
    "iid_jump_mean_square": Kind("p a1 a2", "factor stable:b", _jumps, lambda d: {"p": d.real(0.05, 0.95), "a1": d.real(0.2, 1.6), "a2": d.real(0.2, 1.6)}, "Test mean-square stability.", "stochastic_control"),
    "relative_event_trigger": Kind("x_hat x sigma", "error_abs threshold trigger:b", _trigger, lambda d: {"x_hat": d.real(-4, 4), "x": d.real(-4, 4), "sigma": d.real(0.05, 0.9)}, "Does the event fire?", "networked_control"),
    "symmetric_tube_tightening": Kind("bound error", "tightened interval nonempty:b", _tube, lambda d: {"bound": d.real(0.5, 6), "error": d.real(0.1, 4)}, "Tighten the constraint.", "mpc"),
    "finite_discounted_return": Kind("rewards gamma", "terms return", _discounted, lambda d: {"rewards": d.real(-4, 4, 5), "gamma": d.real(0.5, 0.99)}, "Sum the discounted rewards.", "learning_control"),
    "robust_safe_input_interval": Kind("a b x w_max x_min x_max u_nom", "u_lower u_upper u_safe", _interval, lambda d: {"a": d.real(0.5, 1.2), "b": d.real(0.3, 2), "x": d.real(-2, 2), "w_max": d.real(0.05, 0.5), "x_min": d.real(-4, -2), "x_max": d.real(2, 4), "u_nom": d.real(-6, 6)}, "Find the safe inputs.", "safety"),
    "single_actuator_loss_isolation": Kind("B u loss_factor measured failed_index", "candidate_outputs residuals identified_index:b", _isolation, _lossy, "Which actuator lost effect?", "fault_tolerance"),
    "small_gain": Kind("g1 g2", "product certified:b", lambda g: {"product": g.g1 * g.g2, "certified": g.g1 * g.g2 < 1}, lambda d: {"g1": d.real(0.1, 2.5), "g2": d.real(0.1, 1.5)}, "Apply the small-gain theorem.", "robust_control"),
    "weighted_peak": Kind("weight response strict_bound", "products peak certified:b", _weighted, lambda d: {"weight": d.real(0.1, 1.2, 4), "response": d.real(0.1, 1.6, 4), "strict_bound": d.one_of(1.0, 0.9)}, "Test the weighted response.", "robust_control"),
    "hinf_first_order": Kind("gain tau", "hinf peak_frequency", lambda g: {"hinf": np.abs(g.gain), "peak_frequency": 0 * g.gain, "ok": g.tau > 0}, lambda d: {"gain": d.real(-8, 8), "tau": d.real(0.1, 5)}, "Find the peak gain.", "robust_control"),
    "kharitonov_cubic": Kind("lower upper", "polynomials poles:r stable_flags:b robustly_hurwitz:b", _kharitonov, lambda d: (lambda low: {"lower": low, "upper": low + d.real(0.05, 1, 4)})(d.real(0.5, 4, 4)), "Test the interval polynomial.", "robust_control"),
    "sampled_sensitivity_peak": Kind("L", "magnitudes peak_index:b peak", _peak, lambda d: {"L": d.real(-0.6, 2, 4, 2)}, "Find the sampled peak.", "robust_control"),
    "pe_sincos": Kind("omega", "period gramian alpha_max", lambda g: {"period": 2 * np.pi / g.omega, "gramian": (np.pi / g.omega)[:, None, None] * np.eye(2), "alpha_max": np.pi / g.omega}, lambda d: {"omega": d.real(0.3, 9)}, "Check persistent excitation.", "adaptive_control"),
    "gradient_identifier": Kind("theta phi y dt gamma", "error theta_next", _gradient, lambda d: {"theta": d.real(-2, 2, 2), "phi": d.real(-2, 2, 2), "y": d.real(-3, 3), "dt": d.real(0.01, 0.2), "gamma": d.real(0.5, 5)}, "Take a gradient step.", "adaptive_control"),
    "normalized_identifier": Kind("theta phi y gamma", "error denominator theta_next", _normalised, lambda d: {"theta": d.real(-2, 2, 2), "phi": d.real(-2, 2, 2), "y": d.real(-3, 3), "gamma": d.real(0.1, 1.5)}, "Take a normalised step.", "adaptive_control"),
    "regression_rank": Kind("Phi", "rank:b gramian eigenvalues identifiable:b", _regressors, lambda d: {"Phi": d.whole(-2, 2, 4, 2)}, "Is the regression identifiable?", "system_identification"),
    "arx_least_squares": Kind("u y", "Phi theta rank:b residual_norm", _arx, _arx_data, "Fit the model by least squares.", "system_identification"),
    "fopdt_step": Kind("delta_y delta_u t63 delay", "gain tau", lambda g: {"gain": g.delta_y / g.delta_u, "tau": g.t63 - g.delay, "ok": g.t63 > g.delay}, lambda d: {"delta_y": d.real(0.5, 9), "delta_u": d.real(0.5, 4), "t63": d.real(4, 12), "delay": d.real(0.1, 3)}, "Identify gain and time constant.", "system_identification"),
    "residual_autocorrelation": Kind("residual lags", "acf", _autocorrelation, lambda d: {"residual": d.real(-2, 2, 8), "lags": d.one_of(2, 3)}, "Find the autocorrelations.", "system_identification"),
    "consensus_laplacian": Kind("L", "eigenvalues connected:b lambda2", _laplacian, _graph, "Find the algebraic connectivity.", "networked_control"),
    "discrete_consensus": Kind("L alpha", "laplacian_eigenvalues closed_eigenvalues stable_disagreement:b", _consensus, lambda d: _graph(d) | {"alpha": d.real(0.05, 0.6)}, "Does the protocol converge?", "networked_control"),
}

#: Tolerances (relative, absolute) by claim; numbers are compared as numpy's isclose does by default.
TOLERANCE = {"": (1e-5, 1e-8), "e": (1e-8, 1e-9), "q": (1e-7, 1e-5)}


def _claims(kind: Kind) -> list[tuple[str, str]]:
    return [(name, how) for name, _, how in (c.partition(":") for c in kind.claims.split())]


def _agrees(how: str, want: np.ndarray, claim: np.ndarray) -> np.ndarray:
    n = len(want)
    if want.shape != claim.shape:
        return np.zeros(n, bool)
    if how == "b":
        return (want == claim).reshape(n, -1).all(axis=1)
    if how == "r":
        want, claim = complexes(want), complexes(claim)
        k = want.shape[-1]
        return S.same_roots(want.reshape(-1, k), claim.reshape(-1, k)).reshape(n, -1).all(axis=1)
    relative, absolute = TOLERANCE[how]
    return np.isclose(want, claim, rtol=relative, atol=absolute).reshape(n, -1).all(axis=1)


def _stacked(rows: list[dict], names: list[str]) -> dict:
    return {n: np.array([r[n] for r in rows]) if isinstance(rows[0][n], str) else np.array([r[n] for r in rows]).astype(np.float64 if not isinstance(rows[0][n], bool) else bool) for n in names}


def _plain(record: dict) -> tuple:
    """The shapes of a record's values, which rows of one stack share; lengths that a solve reads count as shape."""
    shape = tuple((k, np.shape(v), type(v) is bool, v if k in ("horizon", "lags") else None) for k, v in sorted(record.items()))
    return shape


def required_terms(record: dict, answer: str | None) -> str | None:
    """What is wrong with a record of missing requirements and its answer, or nothing."""
    sound = record.get("can_compute_final_design") is False and record.get("forbid_numeric_controller_coefficients") is True and len(record.get("required_answer_terms", ())) >= 5
    if not sound:
        return "requirements"
    text = " ".join((answer or "").lower().split())
    return next((f"no {term}" for term in record["required_answer_terms"] if answer is not None and term.lower() not in text), None)


def check_records(texts) -> tuple[list, list]:
    """(verified, error) of JSON records: verified is null where error says why."""
    verified: list = [None] * len(texts)
    errors: list = [None] * len(texts)
    groups: dict = {}
    for i, text in enumerate(texts):
        try:
            record = json.loads(text)
            name = record["kind"]
            if name == "underspecified_requirements":
                errors[i] = None
                verified[i] = required_terms(record, None) is None
                continue
            kind = KINDS[name]
            wanted = {n: record[n] for n in [*kind.given.split(), *(c for c, _ in _claims(kind))]}
            groups.setdefault((name, _plain(wanted)), []).append((i, wanted))
        except KeyError as e:
            errors[i] = f"missing or unknown: {e.args[0]}"
        except (TypeError, ValueError) as e:
            errors[i] = f"unreadable: {type(e).__name__}"
    for (name, _), held in groups.items():
        kind, rows = KINDS[name], [w for _, w in held]
        try:
            with np.errstate(all="ignore"):
                found = kind.solve(Given(_stacked(rows, kind.given.split())))
                claims = _stacked(rows, [c for c, _ in _claims(kind)])
                good = np.asarray(found.get("ok", np.ones(len(rows), bool)))
                for claim, how in _claims(kind):
                    good = good & _agrees(how, np.asarray(found[claim]), claims[claim])
            for (i, _), ok in zip(held, good):
                verified[i] = bool(ok)
        except (ValueError, IndexError, TypeError, AttributeError, np.linalg.LinAlgError) as e:
            if len(held) > 1:  # one row may have spoilt the stack
                for i, _ in held:
                    (verified[i],), (errors[i],) = check_records([texts[i]])
            else:
                errors[held[0][0]] = f"not solvable: {type(e).__name__}"
    return verified, errors


def verify(record: Column) -> Column:
    """struct<verified boolean, error string> of a JSON record: recomputed and compared; null and a reason if values are missing, unreadable, not solvable, or of an unknown kind."""

    @F.pandas_udf("verified boolean, error string")
    def checked(texts: pd.Series) -> pd.DataFrame:
        verified, errors = check_records(texts.tolist())
        return pd.DataFrame({"verified": pd.array(verified, "boolean"), "error": pd.Series(errors, dtype=object)})

    return checked(record)


def make_records(name: str, u: np.ndarray) -> list[dict]:
    """Records of a kind, one for each row of uniform numbers."""
    kind = KINDS[name]
    given = kind.draw(Draws(u))
    order = np.arange(len(u))
    shaped: dict = {}
    for i in order:  # a solve reads lengths from its stack
        shaped.setdefault(tuple(given[k][i] for k in ("horizon", "lags") if k in given), []).append(i)
    out: list = [None] * len(u)
    for rows in shaped.values():
        part = {k: np.asarray(v)[rows] for k, v in given.items()}
        with np.errstate(all="ignore"):
            found = kind.solve(Given(part))
        names = [*kind.given.split(), *(c for c, _ in _claims(kind))]
        values = {n: (part | found)[n].tolist() for n in names}
        exact = {c for c, how in _claims(kind) if how == "b"}
        for j, i in enumerate(rows):
            out[i] = {"kind": name} | {n: _exact(values[n][j]) if n in exact else values[n][j] for n in names}
    return out


def _exact(value):
    """Whole numbers as integers, in lists too."""
    if isinstance(value, list):
        return [_exact(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() else value
