"""Linear algebra over stacks of small matrices: the first axis counts rows of a batch, so a batch is one call."""

from __future__ import annotations

import numpy as np


def t(a: np.ndarray) -> np.ndarray:
    """Transposes of a stack."""
    return np.swapaxes(a, -1, -2)


def eye(like: np.ndarray) -> np.ndarray:
    return np.broadcast_to(np.eye(like.shape[-1]), like.shape)


def roots(polynomials: np.ndarray) -> np.ndarray:
    """Roots of polynomials [n, k], highest power first, by stacked companion matrices; [n, 0] for constants.

    Where a leading coefficient is zero its root is infinite.
    """
    p = np.asarray(polynomials, np.float64)
    n, k = p.shape
    if k < 2:
        return np.zeros((n, 0), complex)
    out = np.full((n, k - 1), np.inf + 0j)
    whole = p[:, 0] != 0
    companion = np.zeros((int(whole.sum()), k - 1, k - 1))
    companion[:, 0] = -p[whole, 1:] / p[whole, :1]
    companion[:, np.arange(1, k - 1), np.arange(k - 2)] = 1
    out[whole] = np.linalg.eigvals(companion)
    if not whole.all():
        out[~whole, 1:] = roots(p[~whole, 1:])
    return out


def exponential(a: np.ndarray, terms: int = 18) -> np.ndarray:
    """Matrix exponentials: Taylor series after halving until the norm is below a half, then squaring."""
    size = np.abs(a).sum(axis=-1).max(axis=-1, initial=0)
    halvings = np.maximum(0, np.ceil(np.log2(np.maximum(size, 1e-300)))).astype(int) + 1
    b = a / (2.0**halvings)[:, None, None]
    out = term = eye(a) + 0.0
    for i in range(1, terms + 1):
        term = term @ b / i
        out = out + term
    for i in range(int(halvings.max(initial=0))):
        out = np.where((i < halvings)[:, None, None], out @ out, out)
    return out


def held(a: np.ndarray, b: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Ad, Bd) of zero-order-hold sampling, from one exponential of [[A, B], [0, 0]]."""
    n, m = a.shape[-1], b.shape[-1]
    block = np.zeros((len(a), n + m, n + m))
    block[:, :n, :n], block[:, :n, n:] = a, b
    done = exponential(block * step[:, None, None])
    return done[:, :n, :n], done[:, :n, n:]


def _kron(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("nij,nkl->nikjl", a, b).reshape(len(a), a.shape[1] * b.shape[1], -1)


def lyapunov(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """X of a X + X a' = -q."""
    system = _kron(a, eye(a)) + _kron(eye(a), a)
    return np.linalg.solve(system, -q.reshape(len(q), -1, 1)).reshape(q.shape)


def stein(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """X of a X a' - X = -q."""
    return np.linalg.solve(_kron(a, a) - np.broadcast_to(np.eye(a.shape[-1] ** 2), (len(a), a.shape[-1] ** 2, a.shape[-1] ** 2)), -q.reshape(len(q), -1, 1)).reshape(q.shape)


def _invariant(h: np.ndarray, key) -> np.ndarray:
    """P = U2 U1^-1 of the half of each matrix's eigenvectors with the smallest key."""
    value, vector = np.linalg.eig(h)
    n = h.shape[-1] // 2
    order = np.argsort(key(value), axis=-1)[:, None, :n]
    u = np.take_along_axis(vector, np.broadcast_to(order, (len(h), 2 * n, n)), axis=-1)
    p = np.real(t(np.linalg.solve(t(u[:, :n]), t(u[:, n:]))))
    return (p + t(p)) / 2


def care(a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P, K) of the continuous Riccati equation, by the stable subspace of its Hamiltonian."""
    gain = np.linalg.solve(r, t(b))
    h = np.concatenate((np.concatenate((a, -b @ gain), axis=2), np.concatenate((-q, -t(a)), axis=2)), axis=1)
    p = _invariant(h, np.real)
    return p, gain @ p


def dare(a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(P, K) of the discrete Riccati equation, by structured doubling; A may be singular."""
    ak, gk, hk = a + 0.0, b @ np.linalg.solve(r, t(b)), q + 0.0
    for _ in range(steps):
        w = np.linalg.inv(eye(a) + gk @ hk)
        ak, gk, step = ak @ w @ ak, gk + ak @ w @ gk @ t(ak), t(ak) @ hk @ w @ ak
        hk = hk + step
        if np.abs(step).max(initial=0) <= 1e-15 * np.abs(hk).max(initial=1):
            break
    p = (hk + t(hk)) / 2
    return p, np.linalg.solve(r + t(b) @ p @ b, t(b) @ p @ a)


def krylov(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[B, AB, A^2 B, ...] of each row."""
    parts = [b]
    for _ in range(a.shape[-1] - 1):
        parts.append(a @ parts[-1])
    return np.concatenate(parts, axis=-1)


def characteristic(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients [n, k + 1] of det(sI - A), highest first; the matrices of adj(sI - A) [n, k, k, k], highest power first), by the Faddeev-LeVerrier recursion."""
    k = a.shape[-1]
    coefficients, adjugate, m = [np.ones(len(a))], [], np.zeros_like(a, dtype=float)
    for i in range(1, k + 1):
        m = a @ m + coefficients[-1][:, None, None] * eye(a)
        adjugate.append(m)
        coefficients.append(-np.trace(a @ m, axis1=1, axis2=2) / i)
    return np.stack(coefficients, axis=1), np.stack(adjugate, axis=1)


def placed(a: np.ndarray, b: np.ndarray, poles: np.ndarray) -> np.ndarray:
    """The gain K, one input, that gives A - BK these poles (Ackermann)."""
    want = np.ones((len(a), 1), complex)
    for i in range(poles.shape[1]):
        want = np.concatenate((want, np.zeros((len(a), 1))), axis=1) - np.concatenate((np.zeros((len(a), 1)), want * poles[:, i : i + 1]), axis=1)
    phi = np.zeros_like(a, dtype=float)
    for c in np.real(want).T:
        phi = phi @ a + c[:, None, None] * eye(a)
    last = np.zeros((len(a), 1, a.shape[-1]))
    last[:, 0, -1] = 1
    return last @ np.linalg.solve(krylov(a, b), phi)


def same_roots(left: np.ndarray, right: np.ndarray, rtol: float = 1e-7, atol: float = 1e-8) -> np.ndarray:
    """Whether two multisets of complex numbers [n, k] agree, row by row, under a pairing within the tolerance.

    Rows whose sorted forms agree are done at once; others, where rounding
    swapped near-equal real parts, are paired by augmenting paths.
    """
    if left.shape != right.shape:
        return np.zeros(len(left), bool)
    order = lambda z: np.take_along_axis(z, np.lexsort((z.imag, z.real), axis=-1), axis=-1)
    near = lambda x, y: np.isclose(x, y, rtol=rtol, atol=atol)
    same = near(order(left), order(right)).all(axis=1)
    for i in np.flatnonzero(~same):
        same[i] = _pairs_up(near(left[i][:, None], right[i][None, :]))
    return same


def _pairs_up(fits: np.ndarray) -> bool:
    """Whether a bipartite graph has a perfect matching."""
    partner = np.full(fits.shape[1], -1)

    def place(i: int, seen: set) -> bool:
        for j in np.flatnonzero(fits[i]):
            if j not in seen:
                seen.add(j)
                if partner[j] < 0 or place(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(fits)))
