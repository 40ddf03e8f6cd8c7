"""Whole datasets: describe what lies at a path; generate, write both layouts and describe the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import generate
from ..operators.describe import describe
from ..plans.spec import GridSpec
from . import files, netcdf


def describe_path(spark: SparkSession, path: str | list[str], coords: list[str] | None = None, reference: str | None = None) -> DataFrame:
    """describe() of a Parquet file or directory, whose coordinates are to be named, or else of an array file or a list of
    its chunks, with the file's own axes and dims."""
    if isinstance(path, str) and files.is_table(spark, path):
        if not coords:
            raise ValueError("a table needs its coordinate columns named")
        return describe(files.read(spark, path), coords, reference=reference)
    head, rows = netcdf.whole_header(path), netcdf.read(spark, path)
    axes = netcdf.axes_of(head)
    return describe(rows, axes, netcdf.names_of(head), reference, netcdf.dims_of(head), {d: head.dims[d] for d in axes})


def produce(spark: SparkSession, spec: GridSpec, arrays: str, table: str, merge: bool = True, overwrite: bool = False) -> DataFrame:
    """Write the dataset as arrays (one file, or one a chunk without merge) and as a table; describe what was written."""
    arrays, table = files.named(arrays, ".nc"), files.named(table, "")
    files.write(generate.generate(spark, spec), table, overwrite)
    if merge:
        netcdf.write(spark, spec, arrays, overwrite)
    else:
        arrays = netcdf.write_chunks(spark, spec, arrays.removesuffix(".nc"), overwrite)
    return describe_path(spark, arrays, reference="var0" if spec.num_vars > 1 else None)
