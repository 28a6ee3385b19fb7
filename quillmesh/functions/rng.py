"""Counter-based random numbers: every draw is a function of a salt, a seed and the keys of its row.

Nothing has to be stored to resume a run, and a lost partition draws the same numbers again. The 32 leading bits of an MD5
digest make the uniform, so that any SQL engine with md5() can reproduce a draw.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _key(salt: str, *parts: Column | str | int) -> Column:
    return F.concat_ws(":", F.lit(salt), *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def uniform(salt: str, *parts: Column | str | int) -> Column:
    """Uniform on (0, 1), never 0 or 1."""
    return (F.conv(F.substring(F.md5(_key(salt, *parts)), 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(TWO32)


def uniform_value(salt: str, *parts) -> float:
    """The same draw on the driver."""
    digest = hashlib.md5(":".join([salt, *map(str, parts)]).encode()).hexdigest()
    return (int(digest[:8], 16) + 0.5) / TWO32


def randint(upto: Column | int, salt: str, *parts: Column | str | int) -> Column:
    """Uniform integer in [0, upto)."""
    return F.floor(uniform(salt, *parts) * (upto if isinstance(upto, Column) else F.lit(upto))).cast("bigint")


def normal(salt: str, *parts: Column | str | int) -> Column:
    """Standard normal, by Box and Muller's transform of two uniforms."""
    return F.sqrt(F.lit(-2.0) * F.log(uniform(salt + "/r", *parts))) * F.cos(F.lit(2 * math.pi) * uniform(salt + "/a", *parts))


def normal_value(salt: str, *parts) -> float:
    return math.sqrt(-2.0 * math.log(uniform_value(salt + "/r", *parts))) * math.cos(2 * math.pi * uniform_value(salt + "/a", *parts))


def exponential(scale: float, salt: str, *parts: Column | str | int) -> Column:
    """Gamma with shape 1: -scale * ln(u)."""
    return F.lit(-float(scale)) * F.log(uniform(salt, *parts))


#: Tries of a gamma draw; each fails in less than one of twenty cases, so that all fail in none.
TRIES = 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value made once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _gamma_constants(shape: float) -> tuple[float, float]:
    d = (shape if shape >= 1 else shape + 1) - 1 / 3
    return d, 1 / math.sqrt(9 * d)


def gamma(shape: float, scale: float, salt: str, *parts: Column | str | int) -> Column:
    """Gamma draws of any shape: for shape 1 the closed form, else Marsaglia and Tsang's method, a try after another."""
    if shape == 1.0:
        return exponential(scale, salt, *parts)
    d, c = _gamma_constants(shape)

    def one(j: int) -> Column:
        u = uniform(salt + "/u", *parts, j)
        good = lambda x, v: (v > 0) & (F.log(u) < 0.5 * x * x + d - d * v + d * F.log(v))
        return _let(normal(salt + "/x", *parts, j), lambda x: _let(F.pow(1 + c * x, F.lit(3.0)), lambda v: F.when(good(x, v), d * v)))

    draw = F.coalesce(*[one(j) for j in range(TRIES)], F.lit(d))
    if shape < 1:
        draw = draw * F.pow(uniform(salt + "/b", *parts), F.lit(1 / shape))
    return F.greatest(scale * draw, F.lit(1e-300))


def gamma_value(shape: float, scale: float, salt: str, *parts) -> float:
    """The same draw on the driver."""
    if shape == 1.0:
        return -scale * math.log(uniform_value(salt, *parts))
    (d, c), draw = _gamma_constants(shape), None
    for j in range(TRIES):
        x = normal_value(salt + "/x", *parts, j)
        v = (1 + c * x) ** 3
        if v > 0 and math.log(uniform_value(salt + "/u", *parts, j)) < 0.5 * x * x + d - d * v + d * math.log(v):
            draw = d * v
            break
    draw = d if draw is None else draw
    return max(scale * draw * (uniform_value(salt + "/b", *parts) ** (1 / shape) if shape < 1 else 1.0), 1e-300)
