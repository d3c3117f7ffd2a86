"""Independent numpy version of the discontinuity estimator, on rows, for comparison in tests."""

import numpy as np


def weight(u):
    return np.where(np.abs(u) < 1, 1 - np.abs(u), 0.0)


def nn_residuals(x, d, j=3):
    """Nearest-neighbour residuals by brute force, ties included."""
    n = len(x)
    out = np.zeros_like(d)
    for i in range(n):
        dist = np.abs(x - x[i])
        others = np.delete(np.arange(n), i)
        take, seen = [], 0
        for v in np.unique(dist[others]):
            if seen >= min(j, n - 1):
                break
            same = others[dist[others] == v]
            take += list(same)
            seen += len(same)
        m = len(take)
        out[i] = np.sqrt(m / (m + 1)) * (d[i] - d[take].mean(axis=0)) if m else 0
    return out


def side_fit(x, d, h, order):
    w = weight(x / h) / h
    keep = w > 0
    r = x[keep, None] ** np.arange(order + 1)
    g = np.linalg.inv(r.T @ (w[keep, None] * r))
    return keep, r, w[keep], g


def combos(gamma, n_y):
    if gamma is None:
        return [np.eye(n_y)[i] for i in range(n_y)]
    return [np.concatenate([np.eye(n_y)[i], -gamma[:, i]]) for i in range(n_y)]


def direction(vs, value):
    if len(vs) == 1:
        return vs[0]
    ty, tt = value(vs[0]), value(vs[1])
    return vs[0] / tt - vs[1] * ty / tt**2


def rd(x, d, n_y, h, b, p=1):
    """x centred, d = [y, (take-up), covariates]. Returns tau, tau_bc, se, se_rb."""
    q = p + 1
    sides = []
    zz = zy = 0
    for s in (x < 0, x >= 0):
        xs, ds = x[s], d[s]
        reach = max(h, b)
        inside = np.abs(xs) < reach
        xs, ds = xs[inside], ds[inside]
        rp, rq = xs[:, None] ** np.arange(p + 1), xs[:, None] ** np.arange(q + 1)
        wh, wb = weight(xs / h) / h, weight(xs / b) / b
        gp, gq = np.linalg.inv(rp.T @ (wh[:, None] * rp)), np.linalg.inv(rq.T @ (wb[:, None] * rq))
        ell = (rp * wh[:, None]).T @ (xs / h) ** (p + 1)
        e = np.zeros(q + 1)
        e[p + 1] = 1
        qq = (rp * wh[:, None]) - h ** (p + 1) * np.outer((gq @ rq.T).T @ e * wb, ell)
        u = (rp * wh[:, None]).T @ ds
        if d.shape[1] > n_y:
            net = (ds * wh[:, None]).T @ ds - u.T @ gp @ u
            zz, zy = zz + net[n_y:, n_y:], zy + net[n_y:, :n_y]
        sides.append((xs, ds, rp * wh[:, None], qq, gp))
    gamma = np.linalg.solve(zz, zy) if d.shape[1] > n_y else None
    jump = sum(sgn * (g @ (rw.T @ ds))[0] for sgn, (xs, ds, rw, qq, g) in zip((-1, 1), sides))
    jump_bc = sum(sgn * (g @ (qq.T @ ds))[0] for sgn, (xs, ds, rw, qq, g) in zip((-1, 1), sides))
    vs = combos(gamma, n_y)
    s = direction(vs, lambda v: jump @ v)
    if n_y == 1:
        tau, tau_bc = jump @ s, jump_bc @ s
    else:
        tau = (jump @ vs[0]) / (jump @ vs[1])
        tau_bc = tau - s[0] * ((jump - jump_bc) @ vs[0]) - s[1] * ((jump - jump_bc) @ vs[1])
    v_cl = v_rb = 0
    for xs, ds, rw, qq, g in sides:
        res = nn_residuals(xs, ds) @ s
        v_cl += (g @ ((rw * res[:, None]).T @ (rw * res[:, None])) @ g)[0, 0]
        v_rb += (g @ ((qq * res[:, None]).T @ (qq * res[:, None])) @ g)[0, 0]
    return tau, tau_bc, np.sqrt(v_cl), np.sqrt(v_rb)


def piece(x, d, n_y, o, nu, o_b, h_v, h_b, regular):
    """Variance, bias and regularisation terms of one side (x and d of that side)."""
    fact = np.prod(np.arange(1, nu + 1)) if nu else 1
    keep, r, w, g = side_fit(x, d, h_v, o)
    dv = d[keep]
    u = (r * w[:, None]).T @ dv
    gamma = None
    if d.shape[1] > n_y:
        net = (dv * w[:, None]).T @ dv - u.T @ g @ u
        gamma = np.linalg.solve(net[n_y:, n_y:], net[n_y:, :n_y])
    beta = g @ u
    s = direction(combos(gamma, n_y), lambda v: fact * beta[nu] @ v)
    res = nn_residuals(x[keep], dv) @ s
    rw = r * w[:, None] * res[:, None]
    v_v = (g @ (rw.T @ rw) @ g)[nu, nu]
    const = (h_v ** np.arange(o + 1) * (g @ ((r * w[:, None]).T @ (x[keep] / h_v) ** (o + 1))))[nu]
    keep, r, w, g = side_fit(x, d, h_b, o_b)
    beta_b = g @ ((r * w[:, None]).T @ d[keep])
    reg = 0.0
    if regular:
        res = nn_residuals(x[keep], d[keep]) @ s
        rw = r * w[:, None] * res[:, None]
        reg = 3 * const**2 * (g @ (rw.T @ rw) @ g)[o + 1, o + 1]
    return (
        (2 * nu + 1) * h_v ** (2 * nu + 1) * v_v,
        np.sqrt(2 * (o + 1 - nu)) * const * (s @ beta_b[o + 1]),
        2 * (o + 1 - nu) * reg,
    )


def type2_quantile(x, share):
    xs, n = np.sort(x), len(x)
    j = int(np.floor(n * share))
    return (xs[j - 1] + xs[j]) / 2 if n * share == j else xs[j]


def bandwidth(x, d, n_y, p=1):
    q = p + 1
    left, right = x < 0, x >= 0
    if n_y == 2 and min(d[left, 1].var(), d[right, 1].var()) == 0:
        d, n_y = np.delete(d, 1, axis=1), 1
    iqr = type2_quantile(x, 0.75) - type2_quantile(x, 0.25)
    ul, ur = np.unique(x[left])[::-1], np.unique(x[right])
    m = len(ul) + len(ur)
    rl, rr = abs(x.min()), abs(x.max())
    hi, lo = max(rl, rr), 0.0
    if max(1 - len(ul) / left.sum(), 1 - len(ur) / right.sum()) >= 0.2:
        lo = max(abs(ul[min(10, len(ul)) - 1]), abs(ur[min(10, len(ur)) - 1])) + 1e-8
    c_bw = max(min(2.576 * min(x.std(ddof=1), iqr / 1.349) * m ** (-1 / 5), hi), lo)

    def combine(o, nu, o_b, h_left, h_right, regular):
        a = piece(x[left], d[left], n_y, o, nu, o_b, c_bw, h_left, regular)
        b = piece(x[right], d[right], n_y, o, nu, o_b, c_bw, h_right, regular)
        h = ((a[0] + b[0]) / ((b[1] - a[1]) ** 2 + a[2] + b[2])) ** (1 / (2 * o + 3))
        return max(min(h, hi), lo)

    d_bw = combine(q + 1, q + 1, q + 2, rl, rr, False)
    b_bw = combine(q, p + 1, q + 1, d_bw, d_bw, True)
    return combine(p, 0, q, b_bw, b_bw, True), b_bw
