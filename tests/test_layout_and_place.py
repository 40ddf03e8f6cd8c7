import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlab.functions.encode import Encoding, Packing, base36, format_bytes
from gridlab.functions.random import numpy_stream
from gridlab.operators import apportion, field, layout
from gridlab.plans.spec import GridSpec, least_density


def test_repeated_and_unmatched_rows(spark):
    full = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 2.0), (1, 0, 0, 3.0)], "x0 long, x1 long, x2 long, var0 double")
    var1 = spark.createDataFrame([(0, 0, 5.0), (1, 1, 6.0)], "x0 long, x1 long, var1 double")
    var2 = spark.createDataFrame([(1, 1, 7.0)], "x0 long, x1 long, var2 double")
    var3 = spark.createDataFrame([(1, 8.0)], "x0 long, var3 double")
    dims = ["x0", "x1", "x2"]
    table = layout.to_table({"var0": (dims, full), "var1": (dims[:2], var1), "var2": (dims[:2], var2), "var3": (dims[:1], var3)}, dims)
    axes = {"x0": [0, 1], "x1": [10, 20], "x2": [100, 200]}
    named = layout.label(table, {d: spark.createDataFrame(list(enumerate(x)), "i long, x long") for d, x in axes.items()})
    got = [tuple(r) for r in named.orderBy(*[F.col(d).asc_nulls_last() for d in dims]).collect()]
    assert got == [
        (0, 10, 100, 1.0, 5.0, None, None),
        (0, 10, 200, 2.0, 5.0, None, None),
        (1, 10, 100, 3.0, None, None, 8.0),
        (1, 20, None, None, 6.0, 7.0, 8.0),
    ]


def test_slabs_and_squeeze(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (2, 0, 3.0)], "i0 long, i1 long, v double")
    assert [r["slab"] for r in layout.to_slabs(df, "i0", ["i1"], {"i0": 3, "i1": 2}, "v").orderBy("i0").collect()] == [[None, 2.0], [None, None], [3.0, None]]
    assert layout.squeeze(df.withColumn("i1", F.lit(0)), ["i0", "i1"], "v")[1] == ["i0"]


def test_apportion(spark):
    assert apportion.apportion_list(10, [1, 1, 1]) == [3, 3, 4]
    assert apportion.apportion_list(10, [1, 1, 8], [5, 5, 2]) == [4, 4, 2]
    assert apportion.apportion_list(0, [1, 2]) == [0, 0]
    assert apportion.chunk_bounds(10, 3) == [(0, 4), (4, 7), (7, 10)]
    rng = np.random.default_rng(3)
    for _ in range(3):
        w, cap = rng.integers(1, 40, 9).tolist(), rng.integers(1, 30, 9).tolist()
        bins = spark.createDataFrame([(i, float(a), c) for i, (a, c) in enumerate(zip(w, cap))], "bin long, w double, cap long")
        got = [r["share"] for r in apportion.apportion_capped(bins, F.lit(90), "w", "cap", "bin").orderBy("bin").collect()]
        assert got == apportion.apportion_list(90, w, cap) and sum(got) == min(90, sum(cap))


def test_spec_rejects():
    for bad in (
        {"num_obs": 0, "num_dims": 1, "density": 1},
        {"num_obs": 10, "num_dims": 2, "density": 0.01},
        {"num_obs": 9, "num_dims": 2, "density": 1, "ratio_dims": [1, 0.7]},
        {"num_obs": 9, "num_dims": 2, "density": 1, "layout": "other"},
        {"num_obs": 9, "num_dims": 2, "density": 1, "num_vars": 2, "overlap": 0.5, "var_dims": [2, [0, 0]]},
        {"num_obs": 8, "num_dims": 2, "density": 0.5, "num_vars": 2, "overlap": 1.5},
    ):
        with pytest.raises(ValueError):
            GridSpec(**bad)
    with pytest.raises(TypeError):
        GridSpec(num_obs=9, num_dims=2)
    assert least_density([3, 4]) == 4 / 12 and least_density([3, 4], 1) == (3 + 4 - 1) / 12


def test_encodings(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.999999,)], "u double")
    got = df.select(*[Encoding(d, value_range=r).stored(F.col("u")).alias(d) for d, r in (("int8", (1, 3)), ("S2", (0, 1295)), ("float32", None))]).collect()
    assert [r["int8"] for r in got] == [1, 2, 3] and [r["S2"] for r in got] == ["00", "I0", "ZZ"]
    p = Packing("int16", 0.0, 1.0)
    v = df.select(p.value(p.code(F.col("u"))).alias("v"))
    again = v.select(p.value(p.code(F.col("v").cast("double"))).alias("v")).collect()
    assert [r["v"] for r in again] == [r["v"] for r in v.collect()]
    assert df.select(base36(F.lit(46655), 3)).first()[0] == "ZZZ"
    assert df.select(format_bytes(F.lit(2320))).first()[0] == "2.3 KiB"
    for bad in ({"dtype": "int8", "value_range": (0, 300)}, {"dtype": "S1", "value_range": (0, 36)}, {"dtype": "int16", "fill_value": 5}, {"dtype": "int8", "pack": "int8"}):
        with pytest.raises(ValueError):
            Encoding(**bad)


def test_field(spark):
    phase, k = field.waves(5, 0, field.lengths([3, None], 2))
    assert not k[:, 1].any()
    s = spark.range(2000).select(field.wave_sum(phase, k, [F.col("id"), F.lit(0)]).alias("s")).select(field.correlated(F.col("s"), F.lit(0.5)).alias("u"))
    u = np.array([r["u"] for r in s.collect()])
    direct = sum(np.cos(p + a * np.arange(2000)) for p, a in zip(phase, k[:, 0])) * math.sqrt(2 / 64)
    assert np.allclose(u, [0.5 * math.erfc(-x / math.sqrt(2)) for x in direct], atol=1e-12)
    for bad in (0.5, -1, [1]):
        with pytest.raises(ValueError):
            field.lengths(bad, 2)


def test_streams():
    assert numpy_stream(1, 2, 3).random() != numpy_stream(1, 2, 3, 0).random()
    with pytest.raises(ValueError):
        numpy_stream(1, 2, -1)


def test_slabs_hold_every_day(spark, monkeypatch):
    """Days beyond the given tables' 30 lengthen the axis; a cell outside the shape is an error."""
    from gridlab import queries

    rows = spark.createDataFrame([(0, 0, 1.0), (1, 33, 2.0)], "user_id long, day int, click double")
    monkeypatch.setattr(queries, "cube", lambda *a: rows)
    got = {r["user_id"]: r["slab"].split(" ") for r in queries.slab_arrays(spark, "").collect()}
    assert len(got[0]) == 34 and got[0][0] == "1.00" and got[1][33] == "2.00"
    with pytest.raises(Exception, match="outside the shape"):
        layout.to_slabs(rows, "user_id", ["day"], {"user_id": 2, "day": 30}, "click").collect()


def test_bytes_in_binary_units(spark):
    """Ties go to even, null stays null."""
    n = [None, 0, 1023, 1024, 1280, 1792, 2304, (1 << 20) - 1, 1 << 20, (1 << 30) - 1, 5 << 28, (1 << 40) - 1, 1 << 40, 5 << 38, (1 << 62) + 12345]
    want = {x: None if x is None else f"{x} B" if x < 1024 else next(f"{x / (1 << s):.1f} {u}" for u, s in (("KiB", 10), ("MiB", 20), ("GiB", 30), ("TiB", 40)) if x < 1 << (s + 10) or u == "TiB") for x in n}
    df = spark.createDataFrame([(x,) for x in n], "n long")
    assert {r["n"]: r["size"] for r in df.select("n", format_bytes(F.col("n")).alias("size")).collect()} == want
    assert (want[1280], want[1792], want[5 << 38]) == ("1.2 KiB", "1.8 KiB", "1.2 TiB")
    assert df.select(format_bytes(F.lit((1 << 62) + 12345), "KiB")).first()[0] == "4503599627370508.0 KiB"


def test_byte_units_end_at_gib(spark, monkeypatch):
    """The largest unit of the query's SQL, whatever the key."""
    from gridlab import queries

    orders = spark.createDataFrame([(None,), (1,), (396324,), (396325,), (8999999,), (1100000000,)], "o_orderkey long")
    monkeypatch.setattr(queries, "table", lambda *a: orders)
    got = {r["o_orderkey"]: r["size"] for r in queries.byte_units(spark, "").collect()}
    assert got == {None: None, 1: "7 B"} | {k: f"{7 * k * k / (1 << 30):.1f} GiB" for k in (396324, 396325, 8999999, 1100000000)}
