"""Normal distribution and its inverse as Spark expressions."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, functions as F

# Wichura (1988), algorithm AS 241, PPND16. Coefficients ascend.
CENTRE_NUM = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
    1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
    3.3430575583588128105e4, 2.5090809287301226727e3,
)
CENTRE_DEN = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
    5.2264952788528545610e3,
)
SHOULDER_NUM = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
    3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
    2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
SHOULDER_DEN = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
    1.05075007164441684324e-9,
)
TAIL_NUM = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
    2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
    2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
TAIL_DEN = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
    2.04426310338993978564e-15,
)


def _poly(x: Column, ascending: Sequence[float]) -> Column:
    highest, *rest = reversed(ascending)
    return functools.reduce(lambda acc, c: acc * x + F.lit(c), rest, F.lit(highest))


def inverse_normal(p: Column | str) -> Column:
    """Standard normal quantile of a probability strictly between 0 and 1."""
    prob = F.col(p) if isinstance(p, str) else p
    q = prob - 0.5
    near = F.lit(0.180625) - q * q
    centre = q * _poly(near, CENTRE_NUM) / _poly(near, CENTRE_DEN)
    r = F.sqrt(-F.ln(F.least(prob, F.lit(1.0) - prob)))
    shoulder = _poly(r - 1.6, SHOULDER_NUM) / _poly(r - 1.6, SHOULDER_DEN)
    tail = _poly(r - 5.0, TAIL_NUM) / _poly(r - 5.0, TAIL_DEN)
    outside = F.signum(q) * F.when(r <= 5.0, shoulder).otherwise(tail)
    return F.when((prob > 0) & (prob < 1),
                  F.when(F.abs(q) <= 0.425, centre).otherwise(outside))


# The scaled tail exp(x^2) erfc(x) is fitted up to here; further out its asymptotic series takes over.
_FAR = 26.0


@functools.cache
def _scaled_tail() -> tuple[float, ...]:
    """Ascending coefficients in u of ln(exp(x^2) erfc(x) / t), t = 2 / (2 + x), u = t moved to [-1, 1]."""
    least = 2 / (2 + _FAR)

    def target(us: np.ndarray) -> np.ndarray:
        ts = least + (us + 1) / 2 * (1 - least)
        return np.array([math.log(math.erfc(2 / t - 2)) + (2 / t - 2) ** 2 - math.log(t) for t in ts])

    fitted = np.polynomial.chebyshev.chebinterpolate(target, 24)
    return tuple(np.polynomial.chebyshev.cheb2poly(fitted).tolist())


def log_normal_tail(z: Column | str) -> Column:
    """Natural log of the upper tail of the standard normal law, to about 1e-13 however far out."""
    value = F.col(z) if isinstance(z, str) else z
    x = F.abs(value) / math.sqrt(2)
    t = 2 / (2 + x)
    least = 2 / (2 + _FAR)
    u = (t - least) * (2 / (1 - least)) - 1
    near = F.ln(t / 2) + _poly(u, _scaled_tail())
    inverse = 1 / (2 * x * x)
    far = F.log1p(-inverse * (1 - 3 * inverse * (1 - 5 * inverse))) - F.ln(2 * math.sqrt(math.pi) * x)
    tail = F.when(x <= _FAR, near).otherwise(far) - x * x
    return F.when(value >= 0, tail).otherwise(F.log1p(-F.exp(tail)))
