"""Describe any table of coordinates and variables.

NaN counts as vacant and is turned into NULL once. Figures that need other groupings of the same rows are grouping sets
of one pass; no distinct list is joined or collected. The only rows that reach the driver are one per variable, one
per coordinate and one per set of dims.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def nulls(df: DataFrame) -> DataFrame:
    """NaN as NULL in all float columns."""
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def by_sets(df: DataFrame, sets: list[tuple[str, ...]], inner: list[Column], outer: list[Column]) -> dict[tuple[str, ...], Row]:
    """For each set of dims, `outer` over its groups' `inner`: grouping sets of one pass, with partial aggregation before
    its single shuffle. One row a set reaches the driver."""
    out: dict[tuple[str, ...], Row] = {}
    if () in sets:
        out[()] = df.agg(*inner).agg(*outer).first()
    some = sorted({tuple(sorted(s)) for s in sets if s})
    if some:
        every = sorted({c for s in some for c in s})
        bit = sum((F.grouping(c).cast("long") * F.lit(1 << i) for i, c in enumerate(every)), F.lit(0).cast("long"))
        grouped = df.groupingSets([[F.col(c) for c in s] for s in some], *every).agg(*inner, bit.alias("__set"))
        for r in grouped.groupBy("__set").agg(*outer).collect():
            out[tuple(c for i, c in enumerate(every) if not r["__set"] >> i & 1)] = r
    return {tuple(s): out.get(tuple(sorted(s))) for s in sets}


def axes(df: DataFrame, coords: list[str], variables: list[str]) -> DataFrame:
    """One row per coordinate: coord, n_values, and n_<variable>, the values that the variable uses. All in one pass."""
    held = [F.max(F.col(v).isNotNull().cast("int")).alias(f"n_{v}") for v in variables]
    types = dict(df.dtypes)
    value = lambda c: (F.col(c) + 0.0 if types[c] in ("double", "float") else F.col(c)).cast("string")
    one = lambda c: F.struct(F.lit(c).alias("coord"), value(c).alias("x"))
    values = df.select(*variables, F.explode(F.array(*[one(c) for c in coords])).alias("at")).filter("at.x is not null")
    used = values.groupBy("at.coord", "at.x").agg(*held)
    found = used.groupBy("coord").agg(F.count(F.lit(1)).alias("n_values"), *[F.sum(f"n_{v}").alias(f"n_{v}") for v in variables])
    every = df.sparkSession.createDataFrame([(c,) for c in coords], "coord string")  # a coordinate without a value keeps its row
    return F.broadcast(every).join(found, "coord", "left").na.fill(0).select("coord", "n_values", *[f"n_{v}" for v in variables])


@dataclass(frozen=True)
class Dims:
    dims: tuple[str, ...]
    assumed_constant: tuple[str, ...] = ()
    ambiguous: tuple[str, ...] = ()


def lattice_level(df: DataFrame, variables: list[str], sets: list[tuple[str, ...]]) -> dict[tuple[str, tuple[str, ...]], tuple[bool, int]]:
    """For each variable and set of dims, whether it has one value a site and is on every row there; and its sites.

    All sets and variables of a level take one pass.
    """
    inner, outer = [F.count(F.lit(1)).alias("__rows")], []
    for i, v in enumerate(variables):
        inner += [F.count(v).alias(f"__held{i}"), F.min(v).alias(f"__lo{i}"), F.max(v).alias(f"__hi{i}")]
        here = F.col(f"__held{i}") > 0
        odd = here & ((F.col(f"__lo{i}") != F.col(f"__hi{i}")) | (F.col("__rows") != F.col(f"__held{i}")))
        outer += [F.coalesce(F.sum(odd.cast("long")), F.lit(0)).alias(f"odd{i}"), F.coalesce(F.sum(here.cast("long")), F.lit(0)).alias(f"sites{i}")]
    found = by_sets(df, sets, inner, outer)
    return {(v, s): (r[f"odd{i}"] == 0, r[f"sites{i}"]) if r else (False, 0) for s, r in found.items() for i, v in enumerate(variables)}


def infer_dims(df: DataFrame, coords: list[str], variables: list[str], axis_sizes: dict[str, int]) -> tuple[dict[str, Dims], dict[str, int]]:
    """The dims that each variable varies on, and its sites there.

    A coordinate that is vacant on some row of the variable is certainly not one. A set of others is taken as
    constant if the variable has one value a site without them, on every row there, some site repeats, and there
    is more than one value; the largest such set wins, the first on ties. A set is tried only if all its subsets
    fit, so each level of the lattice is one pass for all variables. Dims that would fit too, without proof, are
    ambiguous.
    """
    held = [F.count(F.when(F.col(v).isNotNull(), F.col(c))).alias(f"n{i}_{k}") for i, v in enumerate(variables) for k, c in enumerate(coords)]
    facts = [x for i, v in enumerate(variables) for x in (F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"))]
    first = df.agg(*facts, *held).first()
    sure = {v: tuple(c for k, c in enumerate(coords) if first[f"n{i}_{k}"] == first[f"n{i}"]) for i, v in enumerate(variables)}
    several = {v: first[f"n{i}"] > 0 and first[f"lo{i}"] != first[f"hi{i}"] for i, v in enumerate(variables)}
    maybe = {v: [c for c in sure[v] if axis_sizes[c] > 1] if first[f"n{i}"] else [] for i, v in enumerate(variables)}
    fitting = {v: {frozenset()} for v in variables}
    sites_of: dict[tuple[str, frozenset], int] = {}
    for size in range(len(coords) + 1):
        tries = {v: [s for s in map(frozenset, combinations(maybe[v], size)) if all(s - {c} in fitting[v] for c in s)] for v in variables}
        left = {(v, s): tuple(c for c in sure[v] if c not in s) for v in variables for s in tries[v]}
        if not left:
            break
        found = lattice_level(df, [v for v in variables if tries[v]], list(dict.fromkeys(left.values())))
        for (v, s), kept in left.items():
            fits, sites_of[v, s] = found[v, kept]
            if fits:
                fitting[v].add(s)
    out, occupied = {}, {}
    for v in variables:
        order = [s for size in range(len(maybe[v]) + 1) for s in map(frozenset, combinations(maybe[v], size))]
        repeating = [s for s in order if s in fitting[v] and several[v] and sites_of[v, frozenset()] > sites_of[v, s]]
        constant = max(repeating, key=len, default=frozenset())
        dims = tuple(c for c in sure[v] if c not in constant)
        out[v] = Dims(dims, tuple(c for c in coords if c in constant), tuple(c for c in dims if constant | {c} in fitting[v]))
        occupied[v] = sites_of[v, constant]
    return out, occupied


def describe(
    df: DataFrame,
    coords: list[str],
    variables: list[str] | None = None,
    reference: str | None = None,
    dims: dict[str, list[str]] | None = None,
    grid: dict[str, int] | None = None,
) -> DataFrame:
    """One row per variable: position, variable, dims, var_sites, var_sites_occupied, density, overlap,
    overlap_reverse, unused_coords, dtype, assumed_constant, ambiguous_dims.

    The reference (by default the variable with most occupied sites, the first on ties) comes first. overlap is
    the share of the reference's sites, projected onto the common dims, that the variable holds; overlap_reverse
    the share of the variable's. Both are NULL for the reference and without common dims; overlap_reverse is NULL
    for an empty variable. dims: known dims by variable; others are inferred, with a warning where rows don't
    prove them. grid: axis lengths where they are known from elsewhere; coordinates that no row uses count there.

    The rows are read once for the axes, once for the variables' ranges, once a level of the dims' lattice and once for
    overlaps, whatever the number of variables.
    """
    spark, df = df.sparkSession, nulls(df)
    variables = variables or [c for c in df.columns if c not in coords]
    if reference is not None and reference not in variables:
        raise ValueError(f"no variable {reference}")
    df = df.select(*[F.col(f"`{c}`") for c in [*coords, *variables]])
    sizes = {r["coord"]: r for r in axes(df, coords, variables).collect()}  # one row a coordinate
    grid = {c: sizes[c]["n_values"] for c in coords} | (grid or {})
    given = {v: Dims(tuple(dims[v])) for v in variables if dims and v in dims}
    found, occupied = infer_dims(df, coords, [v for v in variables if v not in given], grid) if len(given) < len(variables) else ({}, {})
    found |= given
    if given:
        known = lattice_level(df, list(given), list(dict.fromkeys(d.dims for d in given.values())))
        occupied |= {v: known[v, d.dims][1] for v, d in given.items()}
    for v, d in found.items():
        if d.assumed_constant:
            warnings.warn(f"{v} is assumed constant along {list(d.assumed_constant)}; its rows fit that but don't prove it", stacklevel=2)
        if d.ambiguous:
            warnings.warn(f"{v} is assumed to vary along {list(d.ambiguous)}; its rows fit both", stacklevel=2)
    ref = reference or max(variables, key=lambda v: occupied[v])
    overlap: dict[str, tuple[float | None, float | None]] = {v: (None, None) for v in variables}
    common = {v: tuple(c for c in found[ref].dims if c in found[v].dims) for v in variables if v != ref}
    common = {v: on for v, on in common.items() if on}
    if common:
        here = [F.max(F.col(f"`{v}`").isNotNull().cast("long")).alias(f"h{i}") for i, v in enumerate([ref, *common])]
        total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
        met = [x for i in range(len(here)) for x in (total(F.col(f"h{i}"), f"n{i}"), total(F.col(f"h{i}") * F.col("h0"), f"both{i}"))]
        got = by_sets(df, list(dict.fromkeys(common.values())), here, met)
        for i, (v, on) in enumerate(common.items(), 1):
            n, both, of = (got[on][c] if got[on] else 0 for c in (f"n{i}", f"both{i}", "n0"))
            overlap[v] = (both / max(of, 1), both / n if n else None)
    types = dict(df.dtypes)
    rows = []
    for i, v in enumerate([ref, *[v for v in variables if v != ref]]):
        d, n = found[v], 1
        for c in d.dims:
            n *= grid[c]
        unused = sum(grid[c] - sizes[c][f"n_{v}"] for c in d.dims)
        rows.append((i, v, list(d.dims), n, occupied[v], occupied[v] / n if n else 0.0, *overlap[v], unused, types[v], list(d.assumed_constant), list(d.ambiguous)))
    return spark.createDataFrame(
        rows,
        "position int, variable string, dims array<string>, var_sites long, var_sites_occupied long, density double, overlap double, "
        "overlap_reverse double, unused_coords long, dtype string, assumed_constant array<string>, ambiguous_dims array<string>",
    )


def storage_schema(df: DataFrame, coords: list[str], variables: list[str]) -> DataFrame:
    """Cells that a table and an array of the same data hold: n_rows, tabular_null_cells, grid_points, array_coord_values, array_values, array_null_cells."""
    df = nulls(df)
    held = sum((F.count(F.col(v)) for v in variables), F.lit(0))
    gaps = sum((F.count(F.lit(1)) - F.count(F.col(c)) for c in [*coords, *variables]), F.lit(0))
    grid = reduce(DataFrame.crossJoin, [df.filter(F.col(c).isNotNull()).select(c).distinct().agg(F.count(F.lit(1)).alias(f"__{c}")) for c in coords])  # one row each
    points = reduce(lambda a, b: a * b, [F.col(f"__{c}") for c in coords])
    labels = reduce(lambda a, b: a + b, [F.col(f"__{c}") for c in coords])
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), gaps.alias("tabular_null_cells"), held.alias("__held"))
    return counted.crossJoin(grid).select(
        "n_rows",
        "tabular_null_cells",
        points.alias("grid_points"),
        labels.alias("array_coord_values"),
        (points * len(variables)).alias("array_values"),
        (points * len(variables) - F.col("__held")).alias("array_null_cells"),
    )
