"""Density, distribution and quantile functions of twelve families, on numpy arrays.

Argument order and conventions follow R. Invalid parameters and results that
aren't numbers become NaN here and NULL in SQL.
"""

from __future__ import annotations

import numpy as np

from .special import beta_i, erfc, gamma_p, gamma_q, lgamma, log_beta

_ROOT2 = np.sqrt(2.0)


def _arrays(*values):
    return np.broadcast_arrays(*(np.asarray(v, float) for v in values))


def _missing(f, params: tuple) -> tuple:
    """Defaults of the trailing parameters that weren't given."""
    n = f.__code__.co_argcount - 1 - len(params)
    return f.__defaults__[-n:] if n else ()


def _kernel(valid):
    """Mask what ``valid`` rejects (given all arguments after the first) and silence warnings."""

    def wrap(f):
        def run(x, *params):
            x, *params = _arrays(x, *params, *_missing(f, params))
            with np.errstate(all="ignore"):
                ok = ~np.isnan(x) & valid(*params) & ~np.logical_or.reduce([np.isnan(p) for p in params])
                return np.where(ok, f(x, *params), np.nan)

        run.__name__ = f.__name__
        return run

    return wrap


_scale = lambda m, s: s > 0
_positive = lambda *p: np.logical_and.reduce([v > 0 for v in p])


@_kernel(_scale)
def dnorm(x, mean=0.0, sd=1.0):
    return np.exp(-0.5 * ((x - mean) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))


@_kernel(_scale)
def pnorm(x, mean=0.0, sd=1.0):
    return 0.5 * erfc(-(x - mean) / sd / _ROOT2)


def _inverse(cdf, density, p, low, high, steps=200):
    """x with cdf(x) = p: the bounds widen until they hold p, then Newton steps, halving where one leaves them."""
    every = np.arange(len(p))
    for _ in range(60):
        wide = cdf(high, every) < p
        if not wide.any():
            break
        high = np.where(wide, 2 * np.abs(high) + 1, high)
    for _ in range(60):
        wide = cdf(low, every) > p
        if not wide.any():
            break
        low = np.where(wide, -2 * np.abs(low) - 1, low)
    x = (low + high) / 2
    at = np.arange(len(p))  # those still moving
    for _ in range(steps):
        y = x[at]
        gap = cdf(y, at) - p[at]
        low[at], high[at] = np.where(gap < 0, y, low[at]), np.where(gap < 0, high[at], y)
        step = y - gap / density(y, at)
        inside = (step > low[at]) & (step < high[at])
        x[at] = np.where(gap == 0, y, np.where(inside, step, (low[at] + high[at]) / 2))
        size = 1e-14 * np.maximum(1e-300, np.abs(x[at]))
        at = at[(gap != 0) & (np.abs(x[at] - y) > size) & (high[at] - low[at] > size)]
        if not len(at):
            break
    return x


def _standard_normal_quantile(p):
    """Starts from a rational tail approximation, then Halley steps on erfc."""
    t = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    # Abramowitz and Stegun 26.2.23
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    tail = np.minimum(p, 1 - p)
    for _ in range(3):
        e = (0.5 * erfc(z / _ROOT2) - tail) * np.sqrt(2 * np.pi) * np.exp(z * z / 2)
        z = z + e / (1 + z * e / 2)
    return np.where(p < 0.5, -z, z)


def _quantile(valid, low, high, at_zero, at_one):
    """A quantile function from a distribution function and its density."""

    def make(cdf, density, name):
        def run(p, *params):
            p, *params = _arrays(p, *params)
            with np.errstate(all="ignore"):
                ok = (p >= 0) & (p <= 1) & valid(*params) & ~np.logical_or.reduce([np.isnan(v) for v in params])
                out = np.full(p.shape, np.nan)
                inner = ok & (p > 0) & (p < 1)
                if inner.any():
                    own = [v[inner] for v in params]
                    lo, hi = (np.full(inner.sum(), b) for b in (low, high))
                    out[inner] = _inverse(lambda x, at: cdf(x, *(v[at] for v in own)), lambda x, at: density(x, *(v[at] for v in own)), p[inner], lo, hi)
                out[ok & (p == 0)], out[ok & (p == 1)] = at_zero, at_one
                return out

        run.__name__ = name
        return run

    return make


def qnorm(p, mean=0.0, sd=1.0):
    p, mean, sd = _arrays(p, mean, sd)
    with np.errstate(all="ignore"):
        z = np.where(p == 0, -np.inf, np.where(p == 1, np.inf, _standard_normal_quantile(np.clip(p, 1e-320, 1 - 1e-17))))
        return np.where((p >= 0) & (p <= 1) & (sd > 0), mean + sd * z, np.nan)


@_kernel(_positive)
def dt(x, df):
    return np.exp(-np.log(df) / 2 - log_beta(df / 2, 0.5) - (df + 1) / 2 * np.log1p(x * x / df))


@_kernel(_positive)
def pt(x, df):
    tail = 0.5 * beta_i(np.where(np.isinf(x), 0.0, df / (df + x * x)), df / 2, 0.5)
    return np.where(x > 0, 1 - tail, tail)


qt = _quantile(_positive, -1000.0, 1000.0, -np.inf, np.inf)(pt, dt, "qt")


@_kernel(_positive)
def dgamma(x, shape, rate=1.0):
    at0 = np.where(shape < 1, np.inf, np.where(shape == 1, rate, 0.0))
    inner = np.exp(shape * np.log(rate) + (shape - 1) * np.log(np.where(x > 0, x, 1)) - rate * x - lgamma(shape))
    return np.where(x < 0, 0.0, np.where(x == 0, at0, inner))


@_kernel(_positive)
def pgamma(x, shape, rate=1.0):
    return np.where(x <= 0, 0.0, gamma_p(shape, np.maximum(x, 0) * rate))


_half_line = _quantile(_positive, 0.0, 1.0, 0.0, np.inf)
qgamma = _half_line(pgamma, dgamma, "qgamma")


def dchisq(x, df):
    return dgamma(x, np.asarray(df, float) / 2, 0.5)


def pchisq(x, df):
    return pgamma(x, np.asarray(df, float) / 2, 0.5)


qchisq = _half_line(pchisq, dchisq, "qchisq")


@_kernel(_positive)
def df(x, df1, df2):
    y = np.where(x > 0, x, 1)
    inner = df1 / 2 * np.log(df1 / df2) + (df1 / 2 - 1) * np.log(y) - (df1 + df2) / 2 * np.log1p(df1 * y / df2) - log_beta(df1 / 2, df2 / 2)
    return np.where(x > 0, np.exp(inner), 0.0)


@_kernel(_positive)
def pf(x, df1, df2):
    return np.where(x <= 0, 0.0, np.where(np.isinf(x), 1.0, beta_i(df1 * x / (df1 * x + df2), df1 / 2, df2 / 2)))


qf = _half_line(pf, df, "qf")


@_kernel(_positive)
def dbeta(x, alpha, beta):
    at0 = np.where(alpha < 1, np.inf, np.where(alpha == 1, beta, 0.0))
    at1 = np.where(beta < 1, np.inf, np.where(beta == 1, alpha, 0.0))
    y = np.where((x > 0) & (x < 1), x, 0.5)
    inner = np.exp((alpha - 1) * np.log(y) + (beta - 1) * np.log1p(-y) - log_beta(alpha, beta))
    return np.where((x < 0) | (x > 1), 0.0, np.where(x == 0, at0, np.where(x == 1, at1, inner)))


@_kernel(_positive)
def pbeta(x, alpha, beta):
    return beta_i(np.clip(x, 0, 1), alpha, beta)


qbeta = _quantile(_positive, 0.0, 1.0, 0.0, 1.0)(pbeta, dbeta, "qbeta")


@_kernel(_positive)
def dexp(x, rate=1.0):
    return np.where(x < 0, 0.0, rate * np.exp(-rate * x))


@_kernel(_positive)
def pexp(x, rate=1.0):
    return np.where(x <= 0, 0.0, -np.expm1(-rate * x))


def _closed(valid):
    def wrap(f):
        def run(p, *params):
            p, *params = _arrays(p, *params, *_missing(f, params))
            with np.errstate(all="ignore"):
                return np.where((p >= 0) & (p <= 1) & valid(*params), f(p, *params), np.nan)

        run.__name__ = f.__name__
        return run

    return wrap


@_closed(_positive)
def qexp(p, rate=1.0):
    return -np.log1p(-p) / rate


@_kernel(_positive)
def dweibull(x, shape, scale=1.0):
    at0 = np.where(shape < 1, np.inf, np.where(shape == 1, 1 / scale, 0.0))
    y = np.where(x > 0, x, 1) / scale
    return np.where(x < 0, 0.0, np.where(x == 0, at0, shape / scale * y ** (shape - 1) * np.exp(-(y**shape))))


@_kernel(_positive)
def pweibull(x, shape, scale=1.0):
    return np.where(x <= 0, 0.0, -np.expm1(-((np.maximum(x, 0) / scale) ** shape)))


@_closed(_positive)
def qweibull(p, shape, scale=1.0):
    return scale * (-np.log1p(-p)) ** (1 / shape)


@_kernel(_scale)
def dlnorm(x, meanlog=0.0, sdlog=1.0):
    y = np.where(x > 0, x, 1)
    return np.where(x <= 0, 0.0, dnorm(np.log(y), meanlog, sdlog) / y)


@_kernel(_scale)
def plnorm(x, meanlog=0.0, sdlog=1.0):
    return np.where(x <= 0, 0.0, pnorm(np.log(np.where(x > 0, x, 1)), meanlog, sdlog))


def qlnorm(p, meanlog=0.0, sdlog=1.0):
    return np.exp(qnorm(p, meanlog, sdlog))


@_kernel(_positive)
def dpois(k, lam):
    n = np.where(k >= 0, k, 0)
    return np.where((k < 0) | (k != np.floor(k)), 0.0, np.exp(n * np.log(lam) - lam - lgamma(n + 1)))


@_kernel(_positive)
def ppois(k, lam):
    n = np.floor(k)
    return np.where(k < 0, 0.0, gamma_q(np.where(n >= 0, n, 0) + 1, lam))


_size_prob = lambda size, prob: (size > 0) & (prob > 0) & (prob <= 1)


@_kernel(_size_prob)
def dnbinom(k, size, prob):
    n = np.where(k >= 0, k, 0)
    rest = np.where(n == 0, 0.0, n * np.log1p(-prob))
    inner = np.exp(lgamma(n + size) - lgamma(size) - lgamma(n + 1) + size * np.log(prob) + rest)
    return np.where((k < 0) | (k != np.floor(k)), 0.0, inner)


@_kernel(_size_prob)
def pnbinom(k, size, prob):
    n = np.floor(k)
    return np.where(k < 0, 0.0, beta_i(prob, size, np.where(n >= 0, n, 0) + 1))


def _first_at_least(cdf, valid):
    """The least whole k >= 0 with cdf(k) >= p: doubling, then halving."""

    def run(p, *params):
        p, *params = _arrays(p, *params)
        with np.errstate(all="ignore"):
            ok = (p >= 0) & (p <= 1) & valid(*params)
            out = np.full(p.shape, np.nan)
            out[ok & (p == 1)] = np.inf
            live = ok & (p < 1)
            if live.any():
                q, own = p[live] * (1 - 64 * np.finfo(float).eps), [v[live] for v in params]
                low, high = np.full(q.shape, -1.0), np.zeros(q.shape)
                for _ in range(60):
                    short = cdf(high, *own) < q
                    if not short.any():
                        break
                    low, high = np.where(short, high, low), np.where(short, 2 * high + 1, high)
                for _ in range(64):
                    mid = np.floor((low + high) / 2)
                    done = mid <= low
                    if done.all():
                        break
                    hit = cdf(mid, *own) >= q
                    low, high = np.where(done | hit, low, mid), np.where(~done & hit, mid, high)
                out[live] = high
        return out

    return run


qpois = _first_at_least(ppois, _positive)
qnbinom = _first_at_least(pnbinom, _size_prob)


def _hyper_ok(m, n, k):
    return (m >= 0) & (n >= 0) & (k >= 0) & (k <= m + n)


def _choose(n, k):
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


@_kernel(_hyper_ok)
def dhyper(x, m, n, k):
    inside = (x == np.floor(x)) & (x >= np.maximum(0, k - n)) & (x <= np.minimum(m, k))
    y = np.where(inside, x, np.maximum(0, k - n))
    return np.where(inside, np.exp(_choose(m, y) + _choose(n, k - y) - _choose(m + n, k)), 0.0)


@_kernel(_hyper_ok)
def phyper(x, m, n, k):
    low, high = np.maximum(0, k - n), np.minimum(m, k)
    top = np.minimum(np.floor(x), high)
    total = np.zeros(x.shape)
    for step in range(int(np.nanmax(top - low, initial=-1)) + 1):
        at = low + step
        total += np.where(at <= top, dhyper(at, m, n, k), 0.0)
    return np.where(x < low, 0.0, np.where(x >= high, 1.0, np.minimum(total, 1.0)))


def qhyper(p, m, n, k):
    p, m, n, k = _arrays(p, m, n, k)
    low, high = np.maximum(0, k - n), np.minimum(m, k)
    ok = (p >= 0) & (p <= 1) & _hyper_ok(m, n, k)
    at, total, found = low.copy(), np.zeros(p.shape), np.full(p.shape, np.nan)
    for _ in range(int(np.nanmax(np.where(ok, high - low, 0), initial=0)) + 1):
        total += np.where(at <= high, dhyper(np.minimum(at, high), m, n, k), 0.0)
        found = np.where(np.isnan(found) & (total >= p * (1 - 64 * np.finfo(float).eps)), np.minimum(at, high), found)
        at = at + 1
    return np.where(ok, np.where(p == 0, low, np.where(p == 1, high, np.where(np.isnan(found), high, found))), np.nan)


#: name -> (function, least number of arguments, most)
FUNCTIONS = {
    "dnorm": (dnorm, 1, 3), "pnorm": (pnorm, 1, 3), "qnorm": (qnorm, 1, 3), "dt": (dt, 2, 2), "pt": (pt, 2, 2), "qt": (qt, 2, 2),
    "dchisq": (dchisq, 2, 2), "pchisq": (pchisq, 2, 2), "qchisq": (qchisq, 2, 2), "df": (df, 3, 3), "pf": (pf, 3, 3), "qf": (qf, 3, 3),
    "dgamma": (dgamma, 2, 3), "pgamma": (pgamma, 2, 3), "qgamma": (qgamma, 2, 3), "dbeta": (dbeta, 3, 3), "pbeta": (pbeta, 3, 3),
    "qbeta": (qbeta, 3, 3), "dexp": (dexp, 1, 2), "pexp": (pexp, 1, 2), "qexp": (qexp, 1, 2), "dweibull": (dweibull, 2, 3),
    "pweibull": (pweibull, 2, 3), "qweibull": (qweibull, 2, 3), "dlnorm": (dlnorm, 1, 3), "plnorm": (plnorm, 1, 3), "qlnorm": (qlnorm, 1, 3),
    "dpois": (dpois, 2, 2), "ppois": (ppois, 2, 2), "qpois": (qpois, 2, 2), "dnbinom": (dnbinom, 3, 3), "pnbinom": (pnbinom, 3, 3),
    "qnbinom": (qnbinom, 3, 3), "dhyper": (dhyper, 4, 4), "phyper": (phyper, 4, 4), "qhyper": (qhyper, 4, 4),
}
#: Defaults of trailing parameters.
DEFAULTS = {
    "norm": (0.0, 1.0), "lnorm": (0.0, 1.0), "gamma": (None, 1.0), "exp": (1.0,), "weibull": (None, 1.0),
}


def with_defaults(name: str, args: tuple):
    """All parameters of a function, given some of them."""
    function, least, most = FUNCTIONS[name]
    if not least <= len(args) <= most:
        raise TypeError(f"{name} takes {least} to {most} arguments, not {len(args)}")
    rest = DEFAULTS.get(name[1:], ())
    return (*args, *rest[len(rest) - (most - len(args)) :]) if len(args) < most else args


def evaluate(name: str, *args) -> np.ndarray:
    return FUNCTIONS[name][0](*with_defaults(name, args))
