import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlab.functions.encode import Encoding, Packing, by_name, format_value
from gridlab.operators import apportion, field, generate, layout, place
from gridlab.operators.describe import describe
from gridlab.plans.spec import GridSpec, clipped
from gridlab.sources import dataset, files, netcdf, synthetic

MIXED = dict(num_obs=120, num_dims=3, ratio_dims=[2, 1, 1], density=[0.4, 0.3, 0.3], seed=3, num_vars=3, var_dims=[3, 3, [0, 1]], overlap=[0.5, 0.4], dtype=["float64", "int16", "float32"], max_obs=30)


def described(df):
    return {r["variable"]: {k: v for k, v in r.asDict().items() if k not in ("dtype", "assumed_constant", "ambiguous_dims")} for r in df.collect()}


def test_waves_draw_all_normals_before_all_uniforms():
    """Wave numbers of two and three dims, from the stream in the documented order."""
    for scale in ([4, 2.5], [3, None, 0], [0, 7]):
        rng = np.random.default_rng([11, 13, 3])  # seed, tag and variable, each but the seed from 1
        phase, normal = rng.uniform(0, 2 * np.pi, 64), rng.standard_normal((64, len(scale)))
        even = rng.uniform(-np.pi, np.pi, (64, len(scale)))
        want = np.stack([np.zeros(64) if x is None else even[:, d] if x == 0 else normal[:, d] / x for d, x in enumerate(scale)], axis=1)
        got = field.waves(11, 2, scale)
        assert np.array_equal(got[0], phase) and np.array_equal(got[1], want)


def test_normal_functions(spark):
    from statistics import NormalDist

    x = [*np.linspace(-8, 8, 200).tolist(), -38.0, 38.0, 0.0, 7.0711, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(field.ndtr(F.col("x"))).collect()]
    assert got[-1] is None and np.allclose(got[:-1], [0.5 * math.erfc(-v / math.sqrt(2)) for v in x[:-1]], rtol=1e-8, atol=1e-300)
    u = [*np.linspace(0, 1, 201).tolist(), 1e-9, 0.02425, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in u], "u double").select(field.ndtri(F.col("u"))).collect()]
    assert got[-1] is None and np.allclose(got[:-1], [NormalDist().inv_cdf(min(max(v, 1e-12), 1 - 1e-12)) for v in u[:-1]], atol=1e-9)


def test_noise_keeps_the_field_uniform(spark):
    spec = GridSpec(num_obs=900, num_dims=2, density=1.0, seed=2, data_structure="correlated", correlation_length=1, noise=0.6)
    u = np.array([r["record"] for r in generate.generate(spark, spec).collect()])
    assert 0.4 < u.mean() < 0.6 and np.all((u > 0) & (u < 1)) and len(np.unique(u)) == 900


def test_packing_parameters_are_rounded_before_use(spark):
    """Hand-made numbers: 0.1 / 65533 and 0.1 - 32767 * 0.1 / 65533 as float32; int32 keeps doubles."""
    assert Packing("int16", 0.0, 0.1).parameters == (1.5259487327057286e-06, 0.049999237060546875, "float32")
    assert Packing("int32", 0.0, 0.1).parameters[2] == "float64" and Packing("int8", 5.0, 5.0).parameters[0] == 1.0
    p = Packing("int16", 0.0, 0.1)
    v = np.linspace(0, 0.1, 4001)
    code = np.clip(np.rint((v - 0.049999237060546875) / 1.5259487327057286e-06), -32766, 32767)
    got = spark.createDataFrame([(float(x),) for x in v], "v double").select(p.code(F.col("v")).alias("c"), p.value(p.code(F.col("v"))).alias("d")).collect()
    assert [r["c"] for r in got] == code.tolist()
    assert [r["d"] for r in got] == (0.049999237060546875 + 1.5259487327057286e-06 * code).astype(np.float32).astype(float).tolist()
    assert Packing("int16", 0.0, 1.0, fill=-100).limits == (-32768, 32767, -100)


def test_free_cells_by_rank():
    rng = np.random.default_rng(1)
    for n in (1, 7, 40):
        for _ in range(30):
            taken = np.sort(rng.choice(n, rng.integers(0, n + 1), replace=False))
            free = np.setdiff1d(np.arange(n), taken)
            assert place.free_cells_at(np.arange(len(free)), taken, n).tolist() == free.tolist()


def test_free_slots_without_listing_them(spark):
    taken = spark.createDataFrame([(0, 0), (0, 1), (0, 4), (1, 2), (2, 9)], "j long, k long")
    ranks = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (3, 5)], "j long, r long")
    got = {(r["j"], r["r"]): r["k"] for r in place.free_slots(ranks, taken).collect()}
    assert got == {(0, 0): 2, (0, 1): 3, (0, 2): 5, (1, 0): 0, (1, 2): 3, (2, 0): 0, (3, 5): 5}


def test_apportion_with_capacity_by_hand():
    assert apportion.apportion_list(100, [5, 3, 2], [30, 100, 10]) == [30, 60, 10]
    assert apportion.apportion_list(50, [1, 1], [3, 4]) == [3, 4]
    assert apportion.apportion_list(7, [0, 0], [3, 4]) == [0, 0]


def test_configuration():
    spec = GridSpec(**MIXED)
    assert spec.config()["chunks"] == len(spec.chunks) == 4 and spec.config()["grid_points"] == math.prod(spec.shape)
    assert [sum(n) for n in spec.chunk_counts] == spec.var_num_obs
    assert sum(s[spec.split] for s in spec.chunk_shapes) == spec.shape[spec.split]
    with pytest.warns(UserWarning):
        assert clipped([0.1, 0.05], 0.2) == [0.2, 0.05]
    with pytest.raises(ValueError):
        GridSpec(num_obs=10, num_dims=1, density=[1.0, 0.5])
    for bad in (0, -1):
        with pytest.raises(ValueError):
            GridSpec(num_obs=10, num_dims=1, density=1.0, max_workers=bad)
    e = [Encoding("int8"), Encoding("int16"), Encoding()]
    assert by_name(["var2", "time", "var0"], e) == {"var2": e[2], "time": e[1], "var0": e[0]} and by_name(["var7"], e) == {}


def test_strata_may_be_taken_alone(spark):
    spec = GridSpec(**MIXED)
    whole = [tuple(r) for r in generate.indexed(spark, spec).collect()]
    part = [tuple(r) for r in generate.indexed(spark, spec, (2, 5)).collect()]
    assert part == [r for r in whole if 2 <= r[spec.split] < 5] and part


def test_chunks_join_to_the_file_that_is_written_at_once(spark, tmp_path):
    spec, whole = GridSpec(**MIXED), str(tmp_path / "a.nc")
    netcdf.write(spark, spec, whole)
    chunks = netcdf.write_chunks(spark, spec, str(tmp_path / "b"))
    assert len(chunks) == 4 and netcdf.read_header(chunks[2]).attrs["chunk_id"] == 2
    key = lambda r: [(x is None, x) for x in r]
    rows = lambda path: sorted((tuple(r) for r in netcdf.read(spark, path).collect()), key=key)
    assert rows(chunks) == rows(whole)
    assert described(dataset.describe_path(spark, chunks)) == described(dataset.describe_path(spark, whole))
    for name in ("c.nc", "d.nc"):
        netcdf.concat(chunks, str(tmp_path / name), keep=name == "c.nc")
    assert (tmp_path / "c.nc").read_bytes() == (tmp_path / "d.nc").read_bytes() == (tmp_path / "a.nc").read_bytes()
    assert not any((tmp_path / p).exists() for p in chunks)


def test_table_and_arrays_are_described_alike(spark, tmp_path):
    spec = GridSpec(**(MIXED | {"var_dims": None, "overlap": [0.5, 0.4]}))
    got = described(dataset.produce(spark, spec, str(tmp_path / "a"), str(tmp_path / "t")))
    table = described(dataset.describe_path(spark, str(tmp_path / "t"), ["x0", "x1", "x2"]))
    assert list(got) == ["var0", "var1", "var2"] and got == table
    assert got["var0"]["var_sites"] == math.prod(spec.shape) and got["var1"]["var_sites_occupied"] == spec.var_num_obs[1]
    assert got["var1"]["overlap"] == pytest.approx(round(0.5 * spec.num_obs) / spec.num_obs)
    with pytest.raises(ValueError):
        dataset.describe_path(spark, str(tmp_path / "t"))
    with pytest.raises(FileExistsError):
        dataset.produce(spark, spec, str(tmp_path / "a"), str(tmp_path / "u"))


def test_unused_coordinates_of_the_files_own_axes(spark, tmp_path):
    """A coordinate that no row uses counts in the array's description, and can't in the table's."""
    rows = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 0.0, 2.0)], "x0 double, x1 double, v double")
    got = described(describe(rows, ["x0", "x1"], dims={"v": ["x0", "x1"]}, grid={"x0": 3, "x1": 2}))["v"]
    assert (got["var_sites"], got["unused_coords"], got["density"]) == (6, 2, 1 / 3)


def test_source_takes_filters_of_the_split_axis(spark):
    spec = GridSpec(**MIXED)
    synthetic.register(spark)
    rows = spark.read.format("gridlab").option("spec", json.dumps(MIXED)).load()
    assert sorted(map(str, rows.collect())) == sorted(map(str, generate.indexed(spark, spec).collect()))
    some = rows.filter(F.col(f"i{spec.split}") >= 3).filter(F.col(f"i{spec.split}") < 5)
    assert some.count() == generate.indexed(spark, spec, (3, 5)).count()
    reader = synthetic.GridReader(MIXED)
    left = list(reader.pushFilters([synthetic.GreaterThan((f"i{spec.split}",), 2), synthetic.LessThanOrEqual((f"i{spec.split}",), 4), synthetic.EqualTo(("x0",), 1)]))
    assert (reader.lo, reader.hi, len(left)) == (3, 5, 1) and [(p.lo, p.hi) for p in reader.partitions()] == [(3, 5)]


def test_files(spark, tmp_path):
    df, path = spark.range(30), str(tmp_path / "t")
    files.write(df, path, max_records=7)
    assert files.is_table(spark, path) and files.read(spark, path).count() == 30 and files.disk_size(spark, path) > 0
    with pytest.raises(Exception, match="exist"):
        files.write(df, path)
    files.write(df.limit(3), path, overwrite=True)
    assert files.read(spark, path).count() == 3
    (tmp_path / "t" / "mine.txt").write_text("x")
    with pytest.raises(ValueError):
        files.remove_scratch(spark, path)
    (tmp_path / "t" / "mine.txt").unlink()
    files.remove_scratch(spark, path)
    assert not (tmp_path / "t").exists()
    assert files.named("a/", ".nc") == "a/test.nc" and files.named("b.nc", ".nc") == "b.nc"
    (tmp_path / "other").mkdir()
    with pytest.raises(FileExistsError):
        files.write(df, str(tmp_path / "other"), overwrite=True)


def test_tables_as_text(spark):
    df = spark.createDataFrame([(1, 0.12345, float("nan"), None)] * 20, "a int, b double, c double, d double")
    got = layout.truncated(df, columns=3).collect()
    assert len(got) == 10 and tuple(got[0]) == ("1", "0.123", "NaN") and df.select(format_value(F.col("d"), "double")).first()[0] == "NaN"
    lines = place.overlap_lines([{"overlap": 0.5, "overlap_reverse": 1.0, "shared": 2, "ref_size": 4, "var_size": 2}], [0.5])
    assert lines == ["var1: overlap 0.5000, reverse 1.0000, 2 sites shared of 4 and 2, target 0.5000"]
    with pytest.raises(ValueError):
        layout.to_table({"v": (["x"], df)}, ["x", "y"])
    twice = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0)], "i long, j long, v double")
    with pytest.raises(Exception, match="occurs twice"):
        layout.to_slabs(twice, "i", ["j"], {"i": 1, "j": 3}, "v").collect()
