"""Random draws that depend on (seed, purpose, position) and never on partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The purpose of each stream.
COORDINATE, LHS, STRATUM, DENSITY, VAR_DIMS, CONST_COORD = 0, 1, 2, 3, 4, 5
VAR, SHARED_OVERLAP, CORRELATED_FIELD = 10, 11, 12


def numpy_stream(seed: int, tag: int, *index: int) -> np.random.Generator:
    """One NumPy stream per position; positions count from 1 since a seed sequence ignores trailing zeros."""
    if min((seed, tag, *index)) < 0:
        raise ValueError("seed, tag and index must not be negative")
    return np.random.default_rng([seed, tag + 1, *(i + 1 for i in index)])


def uniform(seed: int, tag: int, *index: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of an MD5: the same in any engine that has MD5."""
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(str(tag)), *[i.cast("string") for i in index])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
