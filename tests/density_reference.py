"""Brute-force numpy version of the density test: all pairs of rows, for small samples."""

import numpy as np


def influence(x, x0, h, order, side):
    """Slope of the local fit of the distribution function at ``x0`` and each row's share in it."""
    n = len(x)
    below = (x[None, :] <= x[:, None]).astype(float)
    np.fill_diagonal(below, 0)
    cdf = below.sum(axis=1) / (n - 1)
    u = (x - x0) / h
    w = np.where((np.abs(u) < 1) & side, 1 - np.abs(u), 0) / h
    r = (x - x0)[:, None] ** np.arange(order + 1)
    inv = np.linalg.inv(r.T @ (w[:, None] * r))
    beta = inv @ (r.T @ (w * cdf))
    g = (inv @ r.T)[1] * w
    fit = r @ beta
    psi = np.array([g[i] * (cdf[i] - fit[i]) + sum(g[j] * ((x[i] <= x[j]) - fit[j]) for j in range(n) if j != i) / (n - 1) for i in range(n)])
    return beta[1], psi


def density_jump(x, hl, hr, order):
    fl, pl = influence(x, 0.0, hl, order, x < 0)
    fr, pr = influence(x, 0.0, hr, order, x >= 0)
    d = pr - pl
    return fl, fr, np.sqrt(((pl - pl.mean()) ** 2).sum()), np.sqrt(((pr - pr.mean()) ** 2).sum()), np.sqrt(((d - d.mean()) ** 2).sum())


def coefficients(x, h, order, side):
    """Local fit of the distribution function at 0, in powers of the running variable."""
    n = len(x)
    cdf = ((x[None, :] <= x[:, None]).sum(axis=1) - 1) / (n - 1)
    rows = side & (np.abs(x) < h)
    w = np.sqrt(1 - np.abs(x[rows]) / h)
    return np.linalg.lstsq(w[:, None] * x[rows][:, None] ** np.arange(order + 1), w * cdf[rows], rcond=None)[0]


def boundary_constants(q, s, kernel):
    """Bias and variance constants of the ``s``-th coefficient of a fit of order ``q`` on [0, 1], by numeric integration."""
    nodes, weights = np.polynomial.legendre.leggauss(60)
    u, w = (nodes + 1) / 2, weights / 2
    k = kernel(u) * w
    powers = u[None, :] ** np.arange(q + 1)[:, None]
    inv = np.linalg.inv((powers * k) @ powers.T)
    bias = inv @ (powers * k) @ u ** (q + 1)
    # the minimum of two numbers has a kink: inner integrals on both sides of it
    inner = np.array([[sum(w * kernel(a * u) * a * (a * u) * (a * u) ** j) + a * sum(w * kernel(a + (1 - a) * u) * (1 - a) * (a + (1 - a) * u) ** j) for a in u] for j in range(q + 1)])
    middle = (powers * k) @ inner.T
    return bias[s], (inv @ middle @ inv.T)[s, s]


def derivative_of_normal(k, z):
    """``k``-th derivative of the normal density, from the polynomial before it."""
    poly = np.polynomial.Polynomial([1.0])
    for _ in range(k):
        poly = poly.deriv() - np.polynomial.Polynomial([0.0, 1.0]) * poly
    return poly(z) * np.exp(-z * z / 2) / np.sqrt(2 * np.pi)


def bandwidths(x, p=2):
    """Left, right, difference, sum: least mean squared error of the density at 0."""
    n, sd = len(x), x.std(ddof=1)
    z, left = x.mean() / sd, x < 0
    far = np.abs(x).max()

    def nearest(k):
        return [np.sort(np.unique(np.abs(x[s])))[: k][-1] for s in (left, ~left)]

    def flat(u):
        return np.ones_like(u)

    fact = [float(np.prod(np.arange(1, q + 2))) for q in (p, p + 2)]
    b, v = boundary_constants(p, 1, flat)
    density = np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
    cn = sd * (v * density * fact[0] ** 2 / (2 * p * n * (b * derivative_of_normal(p, z)) ** 2)) ** (1 / (2 * p + 1))
    b, v = boundary_constants(p + 2, p + 1, flat)
    bn = sd * ((2 * p + 1) * v * density * fact[1] ** 2 / (4 * n * (b * derivative_of_normal(p + 2, z)) ** 2)) ** (1 / (2 * p + 5))
    least = nearest(20 + p + 1)
    bn, cn = max(min(bn, far), *nearest(20 + p + 3)), max(min(cn, far), *least)
    (_, pl), (_, pr) = (influence(x, 0.0, cn, p, s) for s in (left, ~left))
    b, _ = boundary_constants(p, 1, lambda u: 1 - u)
    bl, br = (coefficients(x, bn, p + 2, s)[p + 1] * b for s in (left, ~left))
    bl *= (-1) ** p
    out = []
    for shares, bias, end, low in ((pl, bl, -x.min(), least[0]), (pr, br, x.max(), least[1]), (pr - pl, br - bl, far, max(least)), (pr + pl, br + bl, far, max(least))):
        variance = ((shares - shares.mean()) ** 2).sum()
        out.append(max(min((variance * cn / (2 * p * bias**2)) ** (1 / (2 * p + 1)), end), low))
    return out
