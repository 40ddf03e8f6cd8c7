"""The geometry of a generated dataset, validated on the driver."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np

from ..functions.encode import Encoding, spread
from ..functions.random import CONST_COORD, DENSITY, VAR_DIMS, numpy_stream
from ..operators.apportion import apportion_list, chunk_bounds
from ..operators.field import lengths


def positive(name: str, value: int, least: int = 1) -> int:
    if not isinstance(value, int):
        raise TypeError(f"{name} must be an int")
    if value < least:
        raise ValueError(f"{name} must be at least {least}")
    return value


def axis_lengths(num_obs: int, num_dims: int, ratios: list[float], density: float) -> list[int]:
    """ratio times the first axis, whose length follows from the number of observations and the density."""
    first = int(np.rint((num_obs / (density * math.prod(ratios))) ** (1 / num_dims)))
    if first < 1:
        raise ValueError("the first axis would be empty")
    out = []
    for r in ratios:
        n = r * first
        if n < 1 or not math.isclose(n, round(n), rel_tol=1e-5, abs_tol=1e-8):
            raise ValueError(f"an axis of ratio {r} would have {n} coordinates")
        out.append(round(n))
    return out


def least_density(shape: list[int], padded_dim: int | None = None) -> float:
    """Each coordinate of each axis needs an observation; padded, one full line and the first site of all others."""
    cells = math.prod(shape)
    if padded_dim is None:
        return max(shape) / cells
    n = shape[padded_dim]
    return (cells / n + n - 1) / cells


def clipped(densities: list[float], least: float) -> list[float]:
    """Densities with var0's raised to the least that reaches every coordinate; the others need not reach any."""
    if densities[0] >= least:
        return densities
    warnings.warn(f"var0's density {densities[0]} is raised to {least}", stacklevel=2)
    return [least, *densities[1:]]


@dataclass
class GridSpec:
    """Parameters as a user gives them; the corrected values are attributes after construction."""

    num_obs: int
    num_dims: int
    ratio_dims: float | list[float] = 1
    density: float | list[float] | None = None
    sparsity: float | list[float] | None = None
    seed: int = 0
    num_vars: int = 1
    var_dims: object = None
    overlap: object = "random"
    fixed_overlap: object = False
    dtype: object = "float64"
    pack: object = None
    fill_value: object = None
    value_range: object = None
    layout: str = "scattered"
    padded_dim: int | None = None
    max_obs: int | None = None
    data_structure: object = "uncorrelated"
    correlation_length: object = None
    noise: object = None
    max_workers: int | None = None
    shape: list[int] = field(init=False)
    dims: list[list[int]] = field(init=False)
    var_num_obs: list[int] = field(init=False)
    pinned: list[dict[int, int]] = field(init=False)
    split: int = field(init=False)
    encodings: list[Encoding] = field(init=False)
    fields: list[tuple[list[float | None], float] | None] = field(init=False)

    def __post_init__(self) -> None:
        positive("num_obs", self.num_obs)
        positive("num_dims", self.num_dims)
        positive("num_vars", self.num_vars)
        positive("seed", self.seed, 0)
        for name in ("max_workers", "max_obs"):
            if getattr(self, name) is not None:
                positive(name, getattr(self, name))
        densities = self._densities()
        ratios = self.ratio_dims if isinstance(self.ratio_dims, (list, tuple)) else [self.ratio_dims] * self.num_dims
        if len(ratios) != self.num_dims:
            raise ValueError(f"{len(ratios)} ratios for {self.num_dims} dims")
        if self.layout not in ("scattered", "padded"):
            raise ValueError(f"unknown layout {self.layout}")
        if self.layout == "padded":
            if self.num_dims < 2 or self.overlap != "random":
                raise ValueError("the padded layout needs two dims or more and overlap 'random'")
            self.padded_dim = self.num_dims - 1 if self.padded_dim is None else self.padded_dim
            if not 0 <= self.padded_dim < self.num_dims:
                raise ValueError(f"no dim {self.padded_dim}")
        self.shape = axis_lengths(self.num_obs, self.num_dims, list(ratios), densities[0])
        cells = math.prod(self.shape)
        least = least_density(self.shape, self.padded_dim if self.layout == "padded" else None)
        self.num_obs = int(np.rint(densities[0] * cells))
        self.density = self.num_obs / cells
        if self.density < least and not math.isclose(self.density, least):
            raise ValueError(f"density {self.density} is below {least}, the least for shape {self.shape}")
        densities = clipped(densities, min(least, self.density))
        self.dims = self._dims()
        self.var_num_obs = self._counts(densities)
        if max(self.var_num_obs) > self.var_num_obs[0]:
            raise ValueError("var0 must hold the most observations")
        self.pinned = [
            {d: int(numpy_stream(self.seed, CONST_COORD, v, d).integers(0, self.shape[d])) for d in range(self.num_dims) if d not in own}
            for v, own in enumerate(self.dims)
        ]
        self.split = self._split()
        self.overlap = self._overlap()
        fixed = self.fixed_overlap if isinstance(self.fixed_overlap, (list, tuple)) else [self.fixed_overlap] * (self.num_vars - 1)
        if len(fixed) != self.num_vars - 1 or not all(isinstance(f, bool) for f in fixed):
            raise ValueError("fixed_overlap needs a bool, or one for each variable after var0")
        self.fixed_overlap = list(fixed)
        columns = [spread(x, self.num_vars) for x in (self.dtype, self.pack, self.fill_value, self.value_range)]
        self.encodings = [Encoding(d or "float64", p, f, r) for d, p, f, r in zip(*columns)]
        self.fields = self._fields()

    def _densities(self) -> list[float]:
        if self.density is None and self.sparsity is None:
            raise TypeError("give density or sparsity")
        if self.density is not None and self.sparsity is not None:
            warnings.warn("density is used, sparsity is not", stacklevel=4)
        if self.density is None:
            s = self.sparsity
            self.density = [1 - x for x in s] if isinstance(s, (list, tuple)) else 1 - s
        d = list(self.density) if isinstance(self.density, (list, tuple)) else [self.density] * self.num_vars
        if not all(isinstance(x, (int, float)) and 0 <= x <= 1 for x in d) or not d or d[0] == 0:
            raise ValueError("densities lie within 0 and 1, var0's above 0")
        if len(d) == self.num_vars:
            return d
        if len(d) != 2 or self.num_vars == 1:
            raise ValueError(f"{len(d)} densities for {self.num_vars} variables")
        if d[0] < d[1] or d[1] == 0:
            raise ValueError("a density range is [most, least], least above 0")
        rng = numpy_stream(self.seed, DENSITY)
        rest = np.concatenate([[d[1]], rng.uniform(d[1], d[0], self.num_vars - 2)])
        rng.shuffle(rest)
        return [d[0], *rest.tolist()]

    def _dims(self) -> list[list[int]]:
        every = list(range(self.num_dims))
        given = self.var_dims if isinstance(self.var_dims, (list, tuple)) else [self.var_dims] * self.num_vars
        if len(given) != self.num_vars:
            raise ValueError(f"{len(given)} var_dims for {self.num_vars} variables")
        out = [every]
        for v, x in enumerate(given[1:], 1):
            if x is None or x == self.num_dims:
                out.append(every)
            elif isinstance(x, int):
                if not 1 <= x <= self.num_dims:
                    raise ValueError(f"var{v} can't vary on {x} of {self.num_dims} dims")
                out.append(sorted(numpy_stream(self.seed, VAR_DIMS, v).choice(self.num_dims, x, replace=False).tolist()))
            else:
                if not x or len(set(x)) != len(x) or not set(x) <= set(every):
                    raise ValueError(f"var{v}: dims must be distinct and within {every}")
                out.append(sorted(x))
        return out

    def _counts(self, densities: list[float]) -> list[int]:
        cells, out = math.prod(self.shape), [self.num_obs]
        for v in range(1, self.num_vars):
            own = math.prod(self.shape[d] for d in self.dims[v])
            n = int(np.rint(densities[v] / densities[0] * self.num_obs * own / cells))
            n = max(n, 1) if densities[v] > 0 else 0
            if n > own:
                warnings.warn(f"var{v} is cut to its {own} sites", stacklevel=4)
            out.append(min(n, own))
        return out

    def _split(self) -> int:
        shared = [d for d in range(self.num_dims) if all(d in own for own in self.dims) and not (self.layout == "padded" and d == self.padded_dim)]
        if not shared:
            raise ValueError("no axis is shared by all variables")
        return max(shared, key=lambda d: self.shape[d])

    def _overlap(self) -> list[float | None]:
        given = self.overlap if isinstance(self.overlap, (list, tuple)) else [self.overlap] * (self.num_vars - 1)
        if len(given) != self.num_vars - 1:
            raise ValueError(f"{len(given)} overlaps for {self.num_vars - 1} variables")
        cells, out = math.prod(self.shape), []
        for v, t in enumerate(given, 1):
            if t == "random":
                out.append(None)
                continue
            if isinstance(t, bool) or not isinstance(t, (int, float)) or not 0 <= t <= 1:
                raise ValueError("an overlap is 'random' or lies within 0 and 1")
            whole = len(self.dims[v]) == self.num_dims
            least = max(0, self.num_obs + self.var_num_obs[v] - cells) / self.num_obs if whole else 0.0
            if t < least:
                raise ValueError(f"var{v} can't overlap less than {least}")
            if t > 0 and not self.var_num_obs[v]:
                warnings.warn(f"var{v} is empty and can't overlap", stacklevel=4)
            out.append(float(t))
        return out

    def _fields(self) -> list[tuple[list[float | None], float] | None]:
        """(correlation lengths, noise) of each correlated variable, None for the others."""
        kinds, noises = spread(self.data_structure, self.num_vars), spread(self.noise, self.num_vars)
        if not set(kinds) <= {"correlated", "uncorrelated"}:
            raise ValueError(f"unknown data_structure in {kinds}")
        if "correlated" not in kinds and (self.correlation_length is not None or any(noises)):
            raise ValueError("correlation_length and noise need a correlated variable")
        if isinstance(self.noise, (list, tuple)) and any(n for k, n in zip(kinds, noises) if k == "uncorrelated"):
            raise ValueError("noise is given for an uncorrelated variable")
        if any(n is not None and not 0 <= n <= 1 for n in noises):
            raise ValueError("noise lies within 0 and 1")
        if "correlated" not in kinds:
            return [None] * self.num_vars
        scale = lengths(self.correlation_length, self.num_dims)
        used = {d for own, k in zip(self.dims, kinds) if k == "correlated" for d in own}
        for d in sorted(used):
            if scale[d] is not None and scale[d] > self.shape[d]:
                warnings.warn(f"correlation length {scale[d]:g} on x{d} exceeds its {self.shape[d]} sites", stacklevel=4)
        return [(scale, float(n or 0)) if k == "correlated" else None for k, n in zip(kinds, noises)]

    @property
    def chunks(self) -> list[tuple[int, int]]:
        n = 1 if self.max_obs is None else max(1, math.ceil(self.num_obs / self.max_obs))
        return chunk_bounds(self.shape[self.split], n)

    @property
    def chunk_shapes(self) -> list[list[int]]:
        """The grid of each chunk: the whole one but for the split axis."""
        return [[hi - lo if d == self.split else n for d, n in enumerate(self.shape)] for lo, hi in self.chunks]

    @property
    def chunk_counts(self) -> list[list[int]]:
        """Observations of each variable (outer) in each chunk (inner), in proportion to the chunk's share of the grid."""
        weights = [float(hi - lo) for lo, hi in self.chunks]
        return [apportion_list(n, weights) for n in self.var_num_obs]

    def config(self) -> dict[str, object]:
        """The corrected configuration, one value a name."""
        names = ("num_obs", "num_dims", "num_vars", "seed", "density", "shape", "dims", "var_num_obs", "split", "layout", "padded_dim", "overlap", "fixed_overlap", "max_obs")
        out = {c: getattr(self, c) for c in names}
        return out | {"grid_points": math.prod(self.shape), "chunks": len(self.chunks), "encodings": [e.pack or e.dtype for e in self.encodings]}
