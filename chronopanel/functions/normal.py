"""Inverse of the standard normal distribution as a Spark SQL expression.

Expressions here are text: a wide feature table has hundreds, and building them
operator by operator from Python costs more than Spark then spends on the rows.
"""

from __future__ import annotations

# Coefficients of the published rational approximation AS 241
# (Wichura 1988, routine PPND16), lowest power first.
CENTRAL_NUMERATOR = (
    3.3871328727963666080e0,
    1.3314166789178437745e2,
    1.9715909503065514427e3,
    1.3731693765509461125e4,
    4.5921953931549871457e4,
    6.7265770927008700853e4,
    3.3430575583588128105e4,
    2.5090809287301226727e3,
)
CENTRAL_DENOMINATOR = (
    1.0,
    4.2313330701600911252e1,
    6.8718700749205790830e2,
    5.3941960214247511077e3,
    2.1213794301586595867e4,
    3.9307895800092710610e4,
    2.8729085735721942674e4,
    5.2264952788528545610e3,
)
MIDDLE_NUMERATOR = (
    1.42343711074968357734e0,
    4.63033784615654529590e0,
    5.76949722146069140550e0,
    3.64784832476320460504e0,
    1.27045825245236838258e0,
    2.41780725177450611770e-1,
    2.27238449892691845833e-2,
    7.74545014278341407640e-4,
)
MIDDLE_DENOMINATOR = (
    1.0,
    2.05319162663775882187e0,
    1.67638483018380384940e0,
    6.89767334985100004550e-1,
    1.48103976427480074590e-1,
    1.51986665636164571966e-2,
    5.47593808499534494600e-4,
    1.05075007164441684324e-9,
)
TAIL_NUMERATOR = (
    6.65790464350110377720e0,
    5.46378491116411436990e0,
    1.78482653991729133580e0,
    2.96560571828504891230e-1,
    2.65321895265761230930e-2,
    1.24266094738807843860e-3,
    2.71155556874348757815e-5,
    2.01033439929228813265e-7,
)
TAIL_DENOMINATOR = (
    1.0,
    5.99832206555887937690e-1,
    1.36929880922735805310e-1,
    1.48753612908506148525e-2,
    7.86869131145613259100e-4,
    1.84631831751005468180e-5,
    1.42151175831644588870e-7,
    2.04426310338993978564e-15,
)


def _polynomial(coefficients: tuple[float, ...], x: str) -> str:
    result = f"{coefficients[-1]!r}D"
    for c in reversed(coefficients[:-1]):
        result = f"({result} * {x} + {c!r}D)"
    return result


def _ratio(numerator: tuple[float, ...], denominator: tuple[float, ...], x: str) -> str:
    return f"{_polynomial(numerator, x)} / {_polynomial(denominator, x)}"


def tail_distance(p: str) -> str:
    """sqrt(-ln(distance of column p from the nearer end)); null unless 0 < p < 1."""
    return f"CASE WHEN {p} > 0 AND {p} < 1 THEN sqrt(-ln(least({p}, 1D - {p}))) END"


def normal_quantile(p: str, tail: str) -> str:
    """Standard normal quantile of column p: 0 gives -inf, 1 gives +inf, outside [0, 1] NaN.

    ``tail`` is a column holding ``tail_distance(p)``.
    """
    q = f"({p} - 0.5D)"
    central = f"{q} * {_ratio(CENTRAL_NUMERATOR, CENTRAL_DENOMINATOR, f'(0.180625D - {q} * {q})')}"
    near = _ratio(MIDDLE_NUMERATOR, MIDDLE_DENOMINATOR, f"({tail} - 1.6D)")
    far = _ratio(TAIL_NUMERATOR, TAIL_DENOMINATOR, f"({tail} - 5D)")
    return f"""CASE WHEN {p} IS NULL THEN CAST(NULL AS DOUBLE)
                    WHEN isnan({p}) OR {p} < 0 OR {p} > 1 THEN double('NaN')
                    WHEN {p} = 0 THEN double('-Infinity')
                    WHEN {p} = 1 THEN double('Infinity')
                    WHEN abs({q}) <= 0.425D THEN {central}
                    ELSE sign({q}) * CASE WHEN {tail} <= 5 THEN {near} ELSE {far} END END"""
