import struct

import numpy as np
import pytest

from gridlab.operators import generate
from gridlab.plans.spec import GridSpec
from gridlab.sources import netcdf


def rows(df, spec):
    columns = [f"x{d}" for d in range(spec.num_dims)] + (["record"] if spec.num_vars == 1 else [f"var{v}" for v in range(spec.num_vars)])
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is None, x) for x in r[: spec.num_dims]])


def test_round_trip(spark, tmp_path):
    spec = GridSpec(num_obs=30, num_dims=2, density=30 / 64, seed=3, num_vars=4, overlap=0.5, dtype=["float64", "int16", "S2", "float32"], value_range=[(0, 1), (0, 100), (1, 1295), (-2, 2)])
    path = str(tmp_path / "a.nc")
    netcdf.write(spark, spec, path)
    assert rows(netcdf.read(spark, path), spec) == rows(generate.generate(spark, spec), spec)
    head = netcdf.read_header(path)
    assert head.attrs["var_num_obs"] == spec.var_num_obs and head.shape("var2") == (*spec.shape, 2)
    with pytest.raises(FileExistsError):
        netcdf.write(spark, spec, path)
    netcdf.write(spark, spec, path, overwrite=True)
    other = tmp_path / "b.nc"
    other.write_text("not an array file")
    with pytest.raises(ValueError):
        netcdf.write(spark, spec, str(other), overwrite=True)
    assert other.read_text() == "not an array file"


def test_packed_and_dropped_dims(spark, tmp_path):
    path = str(tmp_path / "a.nc")
    spec = GridSpec(num_obs=12, num_dims=3, density=12 / 27, seed=1, num_vars=2, var_dims=[3, 2], overlap=0.5, pack=["int16", None])
    netcdf.write(spark, spec, path)
    head = netcdf.read_header(path)
    assert head.variables["var1"].dims == ["x0", "x1"] and head.variables["var0"].code == 3
    got, want = rows(netcdf.read(spark, path), spec), rows(generate.generate(spark, spec), spec)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-6)


def test_reads_the_first_classic_format(spark, tmp_path):
    """A file put together by hand: dims x (2), variable v (x) of int with a fill value, no coordinate."""
    name = lambda s: struct.pack(">i", len(s)) + s.ljust(-(-len(s) // 4) * 4, b"\0")
    fill = struct.pack(">ii", 12, 1) + name(b"_FillValue") + struct.pack(">iii", 4, 1, -9)
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 1) + name(b"x") + struct.pack(">i", 3) + struct.pack(">ii", 0, 0)
    head += struct.pack(">ii", 11, 1) + name(b"v") + struct.pack(">ii", 1, 0) + fill + struct.pack(">ii", 4, 12)
    path = tmp_path / "old.nc"
    path.write_bytes(head + struct.pack(">i", len(head) + 4) + struct.pack(">iii", 5, -9, 7))
    assert sorted(tuple(r) for r in netcdf.read(spark, str(path)).collect()) == [(0, 5), (2, 7)]
