"""Stored values from draws in [0, 1): Column expressions that stay inside code generation."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Integer types with their limits and the code that marks a vacant cell.
INTEGERS = {"int8": (-128, 127, -127), "int16": (-32768, 32767, -32767), "int32": (-2147483648, 2147483647, -2147483647)}
SPARK_TYPES = {"float64": "double", "float32": "float", "int8": "tinyint", "int16": "smallint", "int32": "int"}
INTEGER_RANGE = (0, 100)
BINARY_UNITS = ("KiB", "MiB", "GiB", "TiB")


def affine(u: Column, lo: float, hi: float) -> Column:
    return F.lit(float(lo)) + F.lit(float(hi) - float(lo)) * u


def int_bins(u: Column, lo: int, hi: int) -> Column:
    """Equal-width bins over lo..hi inclusive; clipped, as u * width can round up."""
    return F.least(F.lit(hi), F.greatest(F.lit(lo), F.lit(lo) + F.floor(u * (hi - lo + 1)))).cast("long")


def single(v: Column) -> Column:
    """Rounded to float32, as a double."""
    return v.cast("float").cast("double")


def base36(code: Column, width: int) -> Column:
    return F.lpad(F.conv(code.cast("string"), 10, 36), width, "0")


@dataclass(frozen=True)
class Packing:
    """scale and offset that map [lo, hi] onto the codes above the fill value of an integer type."""

    dtype: str
    lo: float
    hi: float
    fill: int | None = None

    @property
    def limits(self) -> tuple[int, int, int]:
        least, top, fill = INTEGERS[self.dtype]
        return least, top, fill if self.fill is None else int(self.fill)

    @property
    def parameters(self) -> tuple[float, float, str]:
        """(scale, offset, type of the decoded value). Where float32 carries them, both are rounded to it before any use."""
        _, top, fill = self.limits
        scale = (self.hi - self.lo) / (top - (fill + 1)) or 1.0
        offset = self.hi - top * scale
        ulp = float(np.spacing(np.float32(max(abs(self.lo), abs(self.hi)))))
        if scale / ulp > 16:
            return float(np.float32(scale)), float(np.float32(offset)), "float32"
        return scale, offset, "float64"

    def code(self, v: Column) -> Column:
        scale, offset, _ = self.parameters
        _, top, fill = self.limits
        return F.least(F.lit(top), F.greatest(F.lit(fill + 1), F.rint((v - offset) / scale))).cast(SPARK_TYPES[self.dtype])

    def value(self, code: Column) -> Column:
        scale, offset, kind = self.parameters
        return (F.lit(offset) + F.lit(scale) * code.cast("double")).cast(SPARK_TYPES[kind])


@dataclass(frozen=True)
class Encoding:
    """How a variable's draws are stored: dtype float64, float32, int8, int16, int32 or S<k>; optional packing."""

    dtype: str = "float64"
    pack: str | None = None
    fill_value: float | None = None
    value_range: tuple[float, float] | None = None
    text: int = field(init=False, default=0)

    def __post_init__(self) -> None:
        if self.dtype.startswith("S"):
            if not self.dtype[1:].isdigit() or int(self.dtype[1:]) < 1:
                raise ValueError(f"{self.dtype}: text needs a width of at least 1")
            object.__setattr__(self, "text", int(self.dtype[1:]))
        elif self.dtype not in SPARK_TYPES:
            raise ValueError(f"unknown dtype {self.dtype}")
        lo, hi = self.bounds
        if hi < lo:
            raise ValueError(f"value_range ends before it begins: {lo}, {hi}")
        if self.pack is not None and (self.pack not in INTEGERS or not self.dtype.startswith("float")):
            raise ValueError("only float variables are packed, into int8, int16 or int32")
        if self.text:
            if self.fill_value is not None:
                raise ValueError("text takes no fill_value")
            if lo < 0 or hi >= 36**self.text:
                raise ValueError(f"codes {lo}..{hi} don't fit {self.text} base-36 digits")
        if self.dtype in INTEGERS:
            least, most, fill = INTEGERS[self.dtype]
            fill = fill if self.fill_value is None else self.fill_value
            if lo < least or hi > most:
                raise ValueError(f"{lo}..{hi} doesn't fit {self.dtype}")
            if lo <= fill <= hi:
                raise ValueError(f"fill value {fill} lies within {lo}..{hi}")

    @property
    def bounds(self) -> tuple[float, float]:
        if self.value_range is not None:
            return tuple(self.value_range)
        return INTEGER_RANGE if self.dtype in INTEGERS or self.dtype.startswith("S") else (0.0, 1.0)

    @property
    def packing(self) -> Packing:
        return Packing(self.pack, *map(float, self.bounds), self.fill_value)

    def stored(self, u: Column) -> Column:
        lo, hi = self.bounds
        if self.text:
            return base36(int_bins(u, int(lo), int(hi)), self.text)
        if self.dtype in INTEGERS:
            return int_bins(u, int(lo), int(hi)).cast(SPARK_TYPES[self.dtype])
        v = affine(u, lo, hi)
        if self.pack is not None:
            return self.packing.value(self.packing.code(v))
        return v.cast(SPARK_TYPES[self.dtype])


def spread(value, n: int) -> list:
    """A scalar for each of n variables, or a list of n as it is; a bare pair of numbers is one range."""
    if isinstance(value, (list, tuple)) and not (len(value) == 2 and n != 2 and all(isinstance(x, (int, float)) for x in value)):
        if len(value) != n:
            raise ValueError(f"{len(value)} values for {n} variables")
        return list(value)
    return [value] * n


def by_name(names: list[str], encodings: list[Encoding]) -> dict[str, Encoding]:
    """The encoding of each variable: `var<N>` takes the Nth, any other name the one at its place."""
    at = {c: int(c[3:]) if c.startswith("var") and c[3:].isdigit() else i for i, c in enumerate(names)}
    return {c: encodings[i] for c, i in at.items() if i < len(encodings)}


def format_value(v: Column, dtype: str) -> Column:
    """A table's cell as text: floats with three decimals, vacant ones as NaN."""
    if dtype not in ("double", "float"):
        return v.cast("string")
    return F.when(v.isNull() | F.isnan(v), "NaN").otherwise(F.format_string("%.3f", v))


def format_bytes(n: Column, top: str = "TiB") -> Column:
    """Binary units up to top with one decimal, ties to even as C's printf has them; null stays null."""
    units = BINARY_UNITS[: BINARY_UNITS.index(top) + 1]
    out = None
    for k in range(len(units), 0, -1):
        v = n.cast("double") / F.lit(float(1 << 10 * k))
        tenths = F.rint((v - F.floor(v)) * 10).cast("long")  # 0 to 10, exact for whole n; format_string rounds ties up
        whole = F.floor(v) + F.when(tenths == 10, 1).otherwise(0)
        text = F.concat(whole.cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {units[k - 1]}"))
        out = text if out is None else F.when(n < (1 << 10 * (k + 1)), text).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)
