"""Column expressions shared by the operators. All stay inside JVM code generation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def require(df, *columns):
    """Raise ValueError when a frame lacks a column an operator needs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def add_all(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def pair_key(i: Column, j: Column) -> Column:
    """Display key of an ordered pair; null when either end is null."""
    return F.concat(i, F.lit("_"), j)


def unordered_pair_key(i: Column, j: Column) -> Column:
    """Display key that is the same for (i, j) and (j, i), by string order."""
    return F.when(
        i.isNotNull() & j.isNotNull(),
        F.concat(F.least(i, j), F.lit("_"), F.greatest(i, j)),
    )


def hash_uniform(*parts) -> Column:
    """Uniform in [0, 1) from the first 52 bits of md5('a|b|c').

    It depends on the key alone, so neither partitioning nor a retried task
    changes a simulated value.
    """
    key = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    bits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")
    return bits / F.lit(float(2**52))


# Stirling series coefficients B_2m / (2m (2m - 1)).
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x), x > 0: Stirling's series at x + 8, stepped back by recurrence."""
    z = x + 8
    step = reduce(lambda a, b: a * b, [x + i for i in range(8)])
    inv = 1 / z
    inv2 = inv * inv
    series = F.lit(_STIRLING[-1])
    for c in reversed(_STIRLING[:-1]):
        series = series * inv2 + F.lit(c)
    return (
        (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series * inv - F.log(step)
    )


def log_rising(a: Column, y: Column) -> Column:
    """ln of the rising factorial a (a+1) ... (a+y-1); zero when y = 0.

    Up to 16 factors are multiplied out, more are a difference of log gammas; the two agree but for rounding.
    """
    return (
        F.when(y <= 0, F.lit(0.0))
        .when(y == 1, F.log(a))
        .when(
            y <= 16,
            F.aggregate(F.sequence(F.lit(0).cast("long"), y - 1), F.lit(0.0), lambda acc, j: acc + F.log(a + j)),
        )
        .otherwise(log_gamma(a + y) - log_gamma(a))
    )


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def log_factorial(y: Column) -> Column:
    return log_rising(F.lit(1.0), y)


# Rational approximations of the normal quantile, Wichura (1988), AS 241.
NORMAL_CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427,
     13731.693765509461125, 45921.953931549871457, 67265.770927008700853,
     33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
     21213.794301586595867, 39307.895800092710610, 28729.085735721942674,
     5226.4952788528545610),
)
NORMAL_MIDDLE = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550,
     3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770,
     0.0227238449892691845833, 0.000774545014278341407640),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
     0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600,
     0.00000000105075007164441684324),
)
NORMAL_TAIL = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580,
     0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860,
     0.0000271155556874348757815, 0.000000201033439929228813265),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
     0.000786869131145613259100, 0.0000184631831751005468180,
     0.000000142151175831644588870, 0.00000000000000204426310338993978564),
)


def _horner(coefficients, x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, 0 < p < 1."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    centre = q * _horner(NORMAL_CENTRE[0], r) / _horner(NORMAL_CENTRE[1], r)
    s = F.sqrt(-F.log(F.least(p, 1 - p)))
    middle = _horner(NORMAL_MIDDLE[0], s - 1.6) / _horner(NORMAL_MIDDLE[1], s - 1.6)
    tail = _horner(NORMAL_TAIL[0], s - 5) / _horner(NORMAL_TAIL[1], s - 5)
    outer = F.when(s <= 5, middle).otherwise(tail)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * outer)


def label(column: Column, labels: dict) -> Column:
    """Recode by a fixed dictionary; a value outside it becomes null."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.create_map(*pairs)[column]


def ordinal(column: Column, order) -> Column:
    """Position in an ordered list, from 0; a value outside it becomes null."""
    return label(column, {name: k for k, name in enumerate(order)})


def pseudo_log10(x: Column) -> Column:
    return F.asinh(x / 2) / F.lit(math.log(10))


def within(x: Column, limits) -> Column:
    """The value when inside the axis limits, else null."""
    return F.when(x.between(*limits), x)
