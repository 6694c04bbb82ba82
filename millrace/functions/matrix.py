"""Matrix tools over stacks: rows of a batch whose matrices have the same shapes are solved in one call.

Matrices are array<array<double>>, complex numbers [re, im].  A row that can't
be computed gives status "error" and the reason, never an exception.
"""

from __future__ import annotations

import numpy as np

from . import stacked as S
from .systems import in_order, stacked_tool


def _norm(a: np.ndarray) -> np.ndarray:
    return np.linalg.norm(a, axis=(1, 2))


def _one(flags: np.ndarray) -> bool:
    """The flag that the rows of a stack share; rows of a mixed stack are computed alone."""
    if len(set(flags.tolist())) > 1:
        raise ValueError("flags differ")
    return bool(flags[0])


def _zoh(a, b, step):
    ad, bd = S.held(a, b, step)
    return {"ad": ad, "bd": bd}


def _eigen(a, discrete):
    z = np.linalg.eigvals(a) + 0j
    return {"values": in_order(z), "stable": np.where(discrete > 0, (np.abs(z) < 1).all(axis=1), (z.real < 0).all(axis=1))}


def _rank(m: np.ndarray, size: int) -> dict:
    rank = np.linalg.matrix_rank(m)
    return {"rank": rank, "full": rank == size}


def _lyapunov(a, q, discrete):
    if _one(discrete):
        p = S.stein(S.t(a), q)
        return {"p": p, "residual": _norm(S.t(a) @ p @ a - p + q)}
    p = S.lyapunov(S.t(a), q)
    return {"p": p, "residual": _norm(S.t(a) @ p + p @ a + q)}


def _lqr(a, b, q, r):
    p, k = S.care(a, b, q, r)
    z = np.linalg.eigvals(a - b @ k) + 0j
    return {"k": k, "residual": _norm(S.t(a) @ p + p @ a - p @ b @ k + q), "poles": in_order(z), "stable": (z.real < 0).all(axis=1)}


def _dlqr(a, b, q, r):
    p, k = S.dare(a, b, q, r)
    z = np.linalg.eigvals(a - b @ k) + 0j
    return {"k": k, "residual": _norm(S.t(a) @ p @ a - p - S.t(a) @ p @ b @ k + q), "poles": in_order(z), "stable": (np.abs(z) < 1).all(axis=1)}


def _place(a, b, poles):
    k = S.placed(a, b, poles[..., 0] + 1j * poles[..., 1])
    return {"k": k, "poles": in_order(np.linalg.eigvals(a - b @ k) + 0j)}


def _routh(coefficients):
    """First column of the Routh array, descending coefficients; a vanishing entry becomes a small positive one."""
    n, size = coefficients.shape
    above, row = coefficients[:, 0::2], coefficients[:, 1::2]
    row = np.concatenate((row, np.zeros((n, above.shape[1] - row.shape[1]))), axis=1)
    column = [above[:, 0]]
    while len(column) < size:
        column.append(row[:, 0])
        lead = np.where(np.abs(row[:, :1]) > 1e-12, row[:, :1], 1e-9)
        above, row = row, np.concatenate(((lead * above[:, 1:] - above[:, :1] * row[:, 1:]) / lead, np.zeros((n, 1))), axis=1)
    column = np.stack(column, axis=1)
    changes = (column[:, 1:] * column[:, :-1] < 0).sum(axis=1)
    return {"column": column, "changes": changes, "stable": changes == 0}


def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (a @ x[..., None])[..., 0]


def _update(x, p, h, r, z):
    s = h @ p @ S.t(h) + r
    k = S.t(np.linalg.solve(S.t(s), h @ S.t(p)))
    keep = S.eye(p) - k @ h
    return {"x": x + _times(k, z - _times(h, x)), "p": keep @ p @ S.t(keep) + k @ r @ S.t(k)}


def _predict(x, p, a, q):
    return {"x": _times(a, x), "p": a @ p @ S.t(a) + q}


def _arx(u, y, order):
    if len(set(order.tolist())) > 1:
        raise ValueError("orders differ")
    n, size = int(order[0]), y.shape[1]
    past = lambda x: [x[:, n - i : size - i] for i in range(1, n + 1)]
    phi, seen = np.stack(past(y) + past(u), axis=-1), y[:, n:]
    theta = _times(np.linalg.pinv(phi), seen)
    return {"theta": theta, "rms": np.sqrt(((_times(phi, theta) - seen) ** 2).mean(axis=1))}


exact_zoh = stacked_tool(_zoh, ad="matrix", bd="matrix")
eigen_analysis = stacked_tool(_eigen, values="matrix", stable="boolean")
controllability = stacked_tool(lambda a, b: _rank(S.krylov(a, b), a.shape[1]), rank="int", full="boolean")
observability = stacked_tool(lambda a, c: _rank(S.krylov(S.t(a), S.t(c)), a.shape[1]), rank="int", full="boolean")
solve_lyapunov = stacked_tool(_lyapunov, p="matrix", residual="double")
continuous_lqr = stacked_tool(_lqr, k="matrix", residual="double", poles="matrix", stable="boolean")
discrete_lqr = stacked_tool(_dlqr, k="matrix", residual="double", poles="matrix", stable="boolean")
place_poles = stacked_tool(_place, k="matrix", poles="matrix")
routh_hurwitz = stacked_tool(_routh, column="vector", changes="int", stable="boolean")
kalman_update = stacked_tool(_update, x="vector", p="matrix")
kalman_predict = stacked_tool(_predict, x="vector", p="matrix")
least_squares_arx = stacked_tool(_arx, theta="vector", rms="double")
