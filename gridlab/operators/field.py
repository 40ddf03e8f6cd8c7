"""Spatially correlated draws: a sum of random plane waves turned uniform by the normal distribution function."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.random import CORRELATED_FIELD, numpy_stream

# Plane waves of a field, default correlation length, distance of a clipped draw from 0 and 1.
MODES, DEFAULT_LENGTH, CLIP = 64, 10.0, 1e-12
# Published coefficients, the highest power first, of Hart's approximation of the normal distribution function
# and of Acklam's approximation of its inverse.
HART_TOP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
HART_BOTTOM = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
ACKLAM_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239]
ACKLAM_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416]


def lengths(given, num_dims: int) -> list[float | None]:
    """Correlation length a dim: None is the default on every dim; in a list, None keeps that dim constant."""
    out = list(given) if isinstance(given, (list, tuple)) else [DEFAULT_LENGTH if given is None else given] * num_dims
    if len(out) != num_dims:
        raise ValueError(f"{len(out)} correlation lengths for {num_dims} dims")
    for x in out:
        if x is not None and (not math.isfinite(x) or x < 0 or 0 < x < 1):
            raise ValueError("a correlation length is 0, None or at least 1")
    return out


def waves(seed: int, var: int, scale: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """(phases, wave numbers by dim). All draws are made, so one dim's length doesn't move another's."""
    rng = numpy_stream(seed, CORRELATED_FIELD, var)
    phase = rng.uniform(0, 2 * np.pi, MODES)
    normal = rng.normal(0, 1, (MODES, len(scale)))
    even = rng.uniform(-np.pi, np.pi, (MODES, len(scale)))
    k = [np.zeros(MODES) if x is None else even[:, d] if x == 0 else normal[:, d] / x for d, x in enumerate(scale)]
    return phase, np.stack(k, axis=1)


def wave_sum(phase: np.ndarray, k: np.ndarray, index: list[Column]) -> Column:
    """The field at integer indices, inside code generation's reach: one fold over the waves as literals."""
    table = F.array(*[F.struct(F.lit(float(p)).alias("p"), *[F.lit(float(x)).alias(f"k{d}") for d, x in enumerate(row)]) for p, row in zip(phase, k)])
    angle = lambda w: sum((w[f"k{d}"] * i for d, i in enumerate(index)), w["p"])
    return F.aggregate(table, F.lit(0.0), lambda a, w: a + F.cos(angle(w))) * math.sqrt(2 / len(phase))


def poly(x: Column, coefficients: list[float]) -> Column:
    """By Horner's rule, the highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body uses it; as text it would grow with every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ndtr(x: Column) -> Column:
    """The normal distribution function as a Column: West's double precision form of Hart's rational approximation."""

    def lower(z: Column) -> Column:
        near = F.exp(-z * z / 2) * poly(z, HART_TOP) / poly(z, HART_BOTTOM)
        tail = F.exp(-z * z / 2) / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / math.sqrt(2 * math.pi)
        return F.when(z > 37, 0.0).when(z < 7.07106781186547, near).otherwise(tail)

    return let(x, lambda v: let(let(F.abs(v), lower), lambda low: F.when(v > 0, 1 - low).otherwise(low)))


def ndtri(u: Column) -> Column:
    """The inverse of ndtr of a clipped draw, as a Column: Acklam's rational approximation and one step of Halley's rule."""

    def first(side: Column) -> Column:
        r, q = side - 0.5, F.sqrt(-2 * F.log(side))
        inner = let(r * r, lambda t: poly(t, ACKLAM_A) / poly(t, [*ACKLAM_B, 1.0])) * r
        outer = let(q, lambda t: poly(t, ACKLAM_C) / poly(t, [*ACKLAM_D, 1.0]))
        return F.when(side < 0.02425, outer).otherwise(inner)

    def better(side: Column) -> Column:
        def step(x: Column) -> Column:
            return let((ndtr(x) - side) * math.sqrt(2 * math.pi) * F.exp(x * x / 2), lambda e: x - e / (1 + x * e / 2))

        return let(first(side), step)

    def whole(v: Column) -> Column:  # the upper half is the mirror image of the lower
        return let(let(F.least(v, 1 - v), better), lambda x: F.when(v > 0.5, -x).otherwise(x))

    return let(F.when(u.isNotNull(), F.least(F.greatest(u, F.lit(CLIP)), F.lit(1 - CLIP))), whole)


def correlated(field: Column, u: Column, noise: float = 0.0) -> Column:
    """Uniform draws with the field's correlation, mixed with independent ones by the noise's share of variance."""
    if not 0 <= noise <= 1:
        raise ValueError("noise lies within 0 and 1")
    mixed = field if noise == 0 else field * math.sqrt(1 - noise**2) + ndtri(u) * noise
    return ndtr(mixed)
