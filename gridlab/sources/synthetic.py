"""The generator as a data source: spark.read.format("gridlab").option("spec", <GridSpec arguments as JSON>).load().

It gives the wide table before encoding (indices, labels and draws). Comparisons of the split axis's index with a number
are taken by the source where Spark offers them, and only the strata that they leave are generated.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..operators.generate import Plan, index_columns, stratum_table
from ..operators.place import coordinates
from ..plans.spec import GridSpec

STRATA_A_TASK = 64


class Strata(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class GridReader(DataSourceReader):
    def __init__(self, given: dict):
        self.given = given
        spec = GridSpec(**given)
        self.column, self.lo, self.hi = f"i{spec.split}", 0, spec.shape[spec.split]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            bounds = {EqualTo: (0, 1), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, 0), LessThanOrEqual: (None, 1)}.get(type(f))
            if bounds is None or f.attribute != (self.column,) or not isinstance(f.value, int):
                yield f
                continue
            if bounds[0] is not None:
                self.lo = max(self.lo, f.value + bounds[0])
            if bounds[1] is not None:
                self.hi = min(self.hi, f.value + bounds[1])

    def partitions(self) -> list[InputPartition]:
        step = max(STRATA_A_TASK, (self.hi - self.lo) // 10_000)
        return [Strata(a, min(a + step, self.hi)) for a in range(self.lo, self.hi, step)] or [Strata(0, 0)]

    def read(self, partition: Strata) -> Iterator[pa.RecordBatch]:
        spec = GridSpec(**self.given)
        plan, axes = Plan.of(spec), coordinates(spec)  # as long as the axes
        for j in range(partition.lo, partition.hi):
            held = stratum_table(plan, axes, j)
            gone = {c: x < 0 if c[0] == "i" else x != x for c, x in held.items()}
            yield pa.RecordBatch.from_arrays([pa.array(x, mask=gone[c]) for c, x in held.items()], list(held))


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridlab"

    def given(self) -> dict:
        return json.loads(self.options["spec"])

    def schema(self) -> StructType:
        kinds = {"long": LongType(), "double": DoubleType()}
        return StructType([StructField(c, kinds[t]) for c, t in index_columns(GridSpec(**self.given()))])

    def reader(self, schema: StructType) -> GridReader:
        return GridReader(self.given())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridSource)
