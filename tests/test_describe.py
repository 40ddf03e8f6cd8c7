import pytest

from gridlab.operators.describe import describe, infer_dims, nulls, storage_schema

NAN = float("nan")


def known(spark):
    rows = [(10.0, 1, 1.0, NAN), (20.0, 2, 1.0, 2.0), (NAN, 3, NAN, 3.0)]
    return spark.createDataFrame(rows, "x0 double, x1 long, var0 double, var1 double")


def lines(spark, var1):
    x = list(zip([0, 0, 0, 0, 1, 1], [0, 0, 0, 1, 0, 0], [0, 4, 8, 2, 5, 6], [1.3, 2.1, 0.5, 0.9, 0.2, 0.7], var1))
    return spark.createDataFrame(x, "x0 long, x1 long, x2 long, var0 double, var1 double")


def by_name(df):
    return {r["variable"]: r.asDict() for r in df.collect()}


def test_known_table(spark):
    with pytest.warns(UserWarning):
        got = by_name(describe(known(spark), ["x0", "x1"]))
    assert got["var0"]["var_sites"] == 6 and got["var0"]["var_sites_occupied"] == 2 and got["var0"]["unused_coords"] == 1
    assert got["var1"]["dims"] == ["x1"] and got["var1"]["density"] == pytest.approx(2 / 3)
    assert got["var1"]["overlap"] == 0.5 and got["var1"]["overlap_reverse"] == 0.5
    assert got["var0"]["overlap"] is None


def test_reference_comes_first(spark):
    with pytest.warns(UserWarning):
        rows = describe(known(spark), ["x0", "x1"], reference="var1").orderBy("position").collect()
    assert [r["variable"] for r in rows] == ["var1", "var0"]
    assert rows[1]["overlap"] == 0.5 and rows[1]["overlap_reverse"] == 0.5
    with pytest.raises(ValueError):
        describe(known(spark), ["x0", "x1"], reference="none")


@pytest.mark.parametrize(
    ("var1", "dims", "assumed"),
    [
        ([7, 7, 7, 4, 3, 3], ("x0", "x1"), ("x2",)),
        ([7, 7, None, 4, 3, 3], ("x0", "x1", "x2"), ()),
        ([7, 7, 7, 7, 7, 7], ("x0", "x1", "x2"), ()),
    ],
)
def test_dims(spark, var1, dims, assumed):
    df = lines(spark, [None if v is None else float(v) for v in var1])
    got = infer_dims(nulls(df), ["x0", "x1", "x2"], ["var1"], {"x0": 2, "x1": 2, "x2": 6})[0]["var1"]
    assert got.dims == dims and got.assumed_constant == assumed
    if len(set(var1)) == 1:
        assert got.ambiguous == dims


def test_empty_table_and_empty_variable(spark):
    df = spark.createDataFrame([], "x0 long, v double")
    got = by_name(describe(df, ["x0"]))
    assert got["v"]["var_sites_occupied"] == 0 and got["v"]["density"] == 0.0
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, None)], "x0 long, v double, w double")
    got = by_name(describe(df, ["x0"]))
    assert got["w"]["overlap"] == 0.0 and got["w"]["overlap_reverse"] is None


def test_storage(spark):
    r = storage_schema(known(spark), ["x0", "x1"], ["var0", "var1"]).first()
    assert (r["n_rows"], r["tabular_null_cells"], r["grid_points"], r["array_values"], r["array_null_cells"]) == (3, 3, 6, 12, 8)
