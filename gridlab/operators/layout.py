"""Table and array layouts of sparse long rows.

A variable is a DataFrame of index columns (its own dims) and a value; vacant cells are absent. Axis tables map an
index to its label and are attached last, so floats are never join keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import format_value


def project(df: DataFrame, dims: list[str], value: str) -> DataFrame:
    """A variable on its own dims: the largest value over the others."""
    return df.groupBy(*dims).agg(F.max(value).alias(value))


def to_table(variables: dict[str, tuple[list[str], DataFrame]], dims: list[str], order_dim: str | None = None, sort: bool = True) -> DataFrame:
    """Wide rows: dims, then one column a variable.

    variables: name -> (own dims, rows with those dims and a column of that name). Variables on all dims are
    aligned by one aggregation over their union. The others, fewest dropped dims first, fill every row that
    matches on their own dims; cells without a match become rows that are NULL on the dropped dims, which later
    variables may match. Rows are ordered by order_dim, then the other dims, NULL last.
    """
    full = [v for v, (own, _) in variables.items() if len(own) == len(dims)]
    fewer = sorted((v for v in variables if v not in full), key=lambda v: (len(dims) - len(variables[v][0]), list(variables).index(v)))
    if not full:
        raise ValueError("no variable lies on all dims, so nothing gives the rows")
    parts = [df.select(*dims, *[F.col(w) if w == v else F.lit(None).cast(dict(variables[w][1].dtypes)[w]).alias(w) for w in full]) for v in full for df in [variables[v][1]]]
    out = reduce(DataFrame.unionByName, parts).groupBy(*dims).agg(*[F.max(v).alias(v) for v in full])
    if len(full) == 1:
        out = variables[full[0]][1].select(*dims, full[0])
    for v in fewer:
        own, df = variables[v]
        met = out.dropna(subset=own).select(*own).distinct()
        out = out.unionByName(df.join(met, own, "left_anti").select(*own), allowMissingColumns=True)
    for v in fewer:
        # rows that lack one of these dims match nothing, so they need not meet in the join
        own, df = variables[v]
        lost = reduce(lambda a, b: a | b, [F.col(d).isNull() for d in own])
        out = out.filter(~lost).join(df.select(*own, v), own, "left").unionByName(out.filter(lost), allowMissingColumns=True)
    out = out.select(*dims, *variables)
    if not sort:
        return out
    first = order_dim or dims[0]
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in [first, *[d for d in dims if d != first]]])


def label(df: DataFrame, axes: dict[str, DataFrame]) -> DataFrame:
    """Index columns replaced by their labels; axes: dim -> (index `i`, label `x`). NULL stays NULL."""
    columns = df.columns
    for dim, axis in axes.items():
        df = df.join(axis.select(F.col("i").alias(dim), F.col("x").alias(f"__{dim}")), dim, "left")
    return df.select(*[F.col(f"__{c}").alias(c) if c in axes else F.col(c) for c in columns])


def to_slabs(df: DataFrame, split: str, rest: list[str], shape: dict[str, int], value: str) -> DataFrame:
    """Dense slabs: one row per index of `split` with an array over the other dims in C order, NULL where vacant.

    A slab has the product of the other axis lengths; it is built from the cells present and never by listing
    the whole grid as rows. A cell outside the shape is an error.
    """
    inside = F.lit(True)
    for d in (split, *rest):
        inside = inside & F.col(d).between(0, shape[d] - 1)
    flat, size = F.lit(0).cast("long"), 1
    for d in rest:
        flat, size = flat * shape[d] + F.col(d), size * shape[d]
    flat = F.when(inside, flat).otherwise(F.raise_error(F.lit("a cell lies outside the shape")).cast("long"))
    cells = df.groupBy(split).agg(F.sort_array(F.collect_list(F.struct(flat.alias("k"), F.col(value).alias("v")))).alias("cells"))
    axis = df.sparkSession.range(shape[split]).select(F.col("id").alias(split))
    got = axis.join(cells, split, "left").select(split, F.coalesce("cells", F.array()).alias("cells"))
    # each cell in order brings the vacant ones before it, and an end mark those after the last
    none = F.lit(None).cast(dict(df.dtypes)[value])
    before = lambda c, i: F.when(i > 0, F.get("cells", i - 1)["k"]).otherwise(F.lit(-1).cast("long"))
    gap = lambda c, i: F.when(c["k"] > before(c, i), c["k"] - before(c, i) - 1).otherwise(F.raise_error(F.lit("a cell occurs twice")).cast("long"))
    runs = F.transform("cells", lambda c, i: F.concat(F.array_repeat(none, gap(c, i).cast("int")), F.array(c["v"])))
    last = F.when(F.size("cells") > 0, F.get("cells", F.size("cells") - 1)["k"]).otherwise(F.lit(-1).cast("long"))
    rest_of_it = F.array_repeat(none, (F.lit(size - 1) - last).cast("int"))
    return got.select(split, F.concat(F.flatten(runs), rest_of_it).alias("slab"))


def squeeze(df: DataFrame, dims: list[str], value: str) -> tuple[DataFrame, list[str]]:
    """Without the dims on which the variable holds one index only; returns the dims that stay."""
    counts = df.filter(F.col(value).isNotNull()).agg(*[F.count_distinct(F.col(d)).alias(d) for d in dims]).first()
    stay = [d for d in dims if counts[d] > 1]
    return df.select(*stay, value), stay


def truncated(df: DataFrame, rows: int = 10, columns: int = 8) -> DataFrame:
    """A table's corner as text, for display."""
    types = dict(df.dtypes)
    return df.limit(rows).select(*[format_value(F.col(f"`{c}`"), types[c]).alias(c) for c in df.columns[:columns]])
