"""Inverse normal distribution by the rational approximation AS 241 (Wichura 1988)."""

from __future__ import annotations

import numpy as np

# Published coefficients of algorithm AS 241, PPND16.
CENTRAL_NUM = (
    3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
CENTRAL_DEN = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
MIDDLE_NUM = (
    1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
    1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
MIDDLE_DEN = (
    1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)
TAIL_NUM = (
    6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
TAIL_DEN = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)

# Our own edge rule: probabilities are kept this far from 0 and 1, which bounds the result near 5.2.
EDGE = 1e-7


def _ratio(num: tuple[float, ...], den: tuple[float, ...], x: np.ndarray) -> np.ndarray:
    return np.polyval(num[::-1], x) / np.polyval(den[::-1], x)


def inverse_normal(p: np.ndarray, edge: float = EDGE) -> np.ndarray:
    """Standard normal quantile of probabilities, clipped to [edge, 1 - edge]."""
    p = np.clip(np.asarray(p, dtype=np.float64), edge, 1.0 - edge)
    q = p - 0.5
    central = q * _ratio(CENTRAL_NUM, CENTRAL_DEN, 0.180625 - q * q)
    r = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
    outer = np.where(r <= 5.0, _ratio(MIDDLE_NUM, MIDDLE_DEN, r - 1.6), _ratio(TAIL_NUM, TAIL_DEN, r - 5.0))
    return np.where(np.abs(q) <= 0.425, central, np.sign(q) * outer)
