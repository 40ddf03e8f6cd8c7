"""netCDF classic files: the dense array form of a dataset. Written as CDF-5, read as CDF-1, CDF-2 or CDF-5.

A file is one local or mounted path that the driver and every executor see. Chunks along the split axis are written by
the tasks, one file each, and may be joined into one file; an array is mapped, never held. Reading is spread over
tasks by blocks of cells, and only occupied cells become rows. Record (unlimited) dims are not supported.
"""

from __future__ import annotations

import math
import os
import struct
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encode import INTEGERS, Encoding
from ..operators import generate, layout
from ..operators.place import coordinates
from ..plans.spec import GridSpec

# The format's type codes and list tags.
CODES = {"int8": 1, "S1": 2, "int16": 3, "int32": 4, "float32": 5, "float64": 6}
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
BLOCK = 1 << 20


@dataclass
class Variable:
    name: str
    dims: list[str]
    code: int
    attrs: dict[str, object] = field(default_factory=dict)
    begin: int = 0


@dataclass
class Header:
    dims: dict[str, int]
    attrs: dict[str, object]
    variables: dict[str, Variable]

    def shape(self, name: str) -> tuple[int, ...]:
        return tuple(self.dims[d] for d in self.variables[name].dims)

    def map(self, path: str, name: str, mode: str = "r") -> np.ndarray:
        v = self.variables[name]
        return np.memmap(path, np.dtype(TYPES[v.code]), mode, v.begin, self.shape(name) or (1,))


# -- header -------------------------------------------------------------------------------------------------------


def _pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 4)


def _name(text: str) -> bytes:
    return struct.pack(">q", len(text.encode())) + _pad(text.encode())


def _entries(tag: int, items: list[bytes]) -> bytes:
    return struct.pack(">iq", tag if items else 0, len(items)) + b"".join(items)


def _attribute(name: str, value: object) -> bytes:
    if isinstance(value, str):
        raw = value.encode()
        return _name(name) + struct.pack(">iq", 2, len(raw)) + _pad(raw)
    values = np.atleast_1d(np.asarray(value))
    if values.dtype.kind == "b" or values.dtype == np.int64:
        values = values.astype(np.int32 if not values.size or abs(values.astype(np.int64)).max() < 1 << 31 else np.float64)
    code = CODES[values.dtype.name]
    return _name(name) + struct.pack(">iq", code, len(values)) + _pad(values.astype(TYPES[code]).tobytes())


def pack_header(head: Header) -> bytes:
    """The header's bytes; sets where each variable begins."""
    order, out = list(head.dims), b""
    for _ in range(2):  # offsets don't change the length
        variables, at = [], len(out)
        for v in head.variables.values():
            size = math.prod(head.dims[d] for d in v.dims) * np.dtype(TYPES[v.code]).itemsize
            size += -size % 4
            v.begin, at = at, at + size
            ids = struct.pack(f">{len(v.dims)}q", *[order.index(d) for d in v.dims])
            attrs = _entries(ATTRIBUTE, [_attribute(*a) for a in v.attrs.items()])
            variables.append(_name(v.name) + struct.pack(">q", len(v.dims)) + ids + attrs + struct.pack(">iqq", v.code, size, v.begin))
        dims = _entries(DIMENSION, [_name(d) + struct.pack(">q", n) for d, n in head.dims.items()])
        attrs = _entries(ATTRIBUTE, [_attribute(*a) for a in head.attrs.items()])
        out = b"CDF\x05" + struct.pack(">q", 0) + dims + attrs + _entries(VARIABLE, variables)
    return out


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError(f"{path} is no netCDF classic file")
        count, offset = (">q" if magic[3] == 5 else ">i"), (">i" if magic[3] == 1 else ">q")

        def number(form: str) -> int:
            return struct.unpack(form, f.read(struct.calcsize(form)))[0]

        def raw(n: int) -> bytes:
            out = f.read(n)
            f.read(-n % 4)
            return out

        def entries(read) -> list:
            number(">i")
            return [read() for _ in range(number(count))]

        def text() -> str:
            return raw(number(count)).decode()

        def attribute() -> tuple[str, object]:
            name, code = text(), number(">i")
            kind = np.dtype(TYPES[code])
            data = raw(number(count) * kind.itemsize)
            if code == 2:
                return name, data.decode()
            values = np.frombuffer(data, kind).tolist()
            return name, values[0] if len(values) == 1 else values

        def variable() -> Variable:
            name = text()
            own = [names[number(count)] for _ in range(number(count))]
            attrs, code = dict(entries(attribute)), number(">i")
            number(count)
            return Variable(name, own, code, attrs, number(offset))

        number(count)
        dims = entries(lambda: (text(), number(count)))
        names = [d for d, _ in dims]
        attrs = dict(entries(attribute))
        head = Header(dict(dims), attrs, {v.name: v for v in entries(variable)})
    if 0 in head.dims.values():
        raise ValueError(f"{path} has a record dim or an empty one")
    return head


# -- writing ------------------------------------------------------------------------------------------------------


def array_variable(name: str, dims: list[str], e: Encoding) -> tuple[Variable, object]:
    """How an encoding is stored, and the value of a vacant cell."""
    if e.text:
        return Variable(name, [*dims, f"{name}_width"], CODES["S1"]), b"\0"
    if e.pack:
        scale, offset, kind = e.packing.parameters
        as_kind, fill = np.dtype(kind).type, np.dtype(e.pack).type(e.packing.limits[2])
        return Variable(name, dims, CODES[e.pack], {"_FillValue": fill, "scale_factor": as_kind(scale), "add_offset": as_kind(offset)}), fill
    fill = INTEGERS[e.dtype][2] if e.dtype in INTEGERS else math.nan
    fill = np.dtype(e.dtype).type(fill if e.fill_value is None else e.fill_value)
    return Variable(name, dims, CODES[e.dtype], {"_FillValue": fill}), fill


def header(spec: GridSpec, chunk: int | None = None) -> tuple[Header, list[object]]:
    """The header of the dataset, or of one chunk of the split axis, and each variable's value of a vacant cell."""
    names, x = generate.variable_names(spec), [f"x{d}" for d in range(spec.num_dims)]
    shape = spec.shape if chunk is None else spec.chunk_shapes[chunk]
    counts = spec.var_num_obs if chunk is None else [n[chunk] for n in spec.chunk_counts]
    head = Header(dict(zip(x, shape)), {"split_dim": x[spec.split], "seed": str(spec.seed), "num_vars": spec.num_vars}, {})
    head.attrs |= {"num_obs": counts[0], "density": counts[0] / math.prod(shape), "var_num_obs": counts}
    if chunk is not None:
        head.attrs["chunk_id"] = chunk
    if spec.num_vars > 1:
        targets = [math.nan if t is None else t for t in spec.overlap]
        head.attrs |= {"overlap_target": targets, "overlap_convention": "share of var0's sites on the shared dims", "fixed_overlap": [int(f) for f in spec.fixed_overlap]}
    for c in x:
        head.variables[c] = Variable(c, [c], CODES["float64"])
    fills = []
    for v, (name, e) in enumerate(zip(names, spec.encodings)):
        head.variables[name], fill = array_variable(name, [x[d] for d in spec.dims[v]], e)
        fills.append(fill)
        if e.text:
            head.dims[f"{name}_width"] = e.text
    return head, fills


def create(path: str, head: Header) -> None:
    """A file of the header's size, with the header in place."""
    with open(path, "wb") as f:
        f.write(pack_header(head))
        last = list(head.variables.values())[-1]
        size = math.prod(head.shape(last.name)) * np.dtype(TYPES[last.code]).itemsize
        f.truncate(last.begin + size + -size % 4)


def _may_write(path: str, overwrite: bool) -> None:
    if os.path.exists(path):
        if not overwrite:
            raise FileExistsError(path)
        read_header(path)  # nothing but such a file is replaced


def stored(spec: GridSpec, v: int) -> Column:
    """The number or text that a file holds for a draw."""
    e = spec.encodings[v]
    value = e.stored(generate.drawn(spec, v))
    return e.packing.code(value.cast("double")) if e.pack else value


def write_chunks(spark: SparkSession, spec: GridSpec, base: str, overwrite: bool = False) -> list[str]:
    """One file a chunk of the split axis, <base>_<chunk>.nc, each written by one task from its own rows only.

    max_obs bounds what a task holds. The generator runs once for all variables.
    """
    paths = [f"{base}_{k:04d}.nc" for k in range(len(spec.chunks))]
    for p in paths:
        _may_write(p, overwrite)
    at = F.col(f"i{spec.split}")
    size, longer = divmod(spec.shape[spec.split], len(paths))
    chunk = F.when(at < longer * (size + 1), F.floor(at / (size + 1))).otherwise(longer + F.floor((at - longer * (size + 1)) / size))
    rows = generate.indexed(spark, spec)
    values = [F.when(F.col(f"u{v}").isNotNull(), stored(spec, v)).alias(f"s{v}") for v in range(spec.num_vars)]
    rows = rows.select(chunk.cast("long").alias("chunk"), *[F.coalesce(f"i{d}", F.lit(-1)).alias(f"i{d}") for d in range(spec.num_dims)], *values)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["chunk"].iloc[0])
        (lo, hi), (head, fills), part = spec.chunks[k], header(spec, k), f"{paths[k]}.part"
        create(part, head)
        for d, axis in enumerate(coordinates(spec)):
            head.map(part, f"x{d}", "r+")[:] = axis[lo:hi] if d == spec.split else axis
        for v, (name, e, fill) in enumerate(zip(generate.variable_names(spec), spec.encodings, fills)):
            array = head.map(part, name, "r+").reshape(-1, *([e.text] if e.text else []))
            for a in range(0, len(array), BLOCK):
                array[a : a + BLOCK] = fill
            own = [f"i{d}" for d in spec.dims[v]]
            held = pdf[pdf[f"s{v}"].notna() & (pdf[own] >= 0).all(axis=1)]
            index = [held[f"i{d}"].to_numpy(np.int64) - (lo if d == spec.split else 0) for d in spec.dims[v]]
            cells = np.ravel_multi_index(index, head.shape(name)[: len(own)])
            if e.text:
                array[cells] = held[f"s{v}"].str.encode("ascii").to_numpy().astype(f"S{e.text}").view("S1").reshape(-1, e.text)
            else:
                array[cells] = held[f"s{v}"].to_numpy().astype(e.pack or e.dtype)
            array.flush()
        os.replace(part, paths[k])
        return pd.DataFrame({"chunk": [k]})

    rows.groupBy("chunk").applyInPandas(one, "chunk long").count()
    return paths


def joined(heads: list[Header]) -> Header:
    """The header of chunk files laid end to end along their split axis."""
    first, split = heads[0], heads[0].attrs["split_dim"]
    dims = {d: sum(h.dims[d] for h in heads) if d == split else n for d, n in first.dims.items()}
    attrs = {k: v for k, v in first.attrs.items() if k != "chunk_id"}
    counts = np.sum([np.atleast_1d(h.attrs["var_num_obs"]) for h in heads], axis=0).tolist()
    grid = math.prod(n for d, n in dims.items() if d in first.variables)
    attrs |= {"num_obs": counts[0], "density": counts[0] / grid, "var_num_obs": counts}
    return Header(dims, attrs, {v.name: Variable(v.name, v.dims, v.code, v.attrs) for v in first.variables.values()})


def concat(paths: list[str], path: str, overwrite: bool = False, keep: bool = False) -> None:
    """Chunk files as one, a variable after the other and a block at a time, so equal chunks give equal bytes. The chunks
    go unless they are to be kept."""
    _may_write(path, overwrite)
    heads = [read_header(p) for p in paths]
    head, part = joined(heads), f"{path}.part"
    create(part, head)
    split = head.attrs["split_dim"]
    for name, v in head.variables.items():
        out, at = head.map(part, name, "r+"), 0
        axis = v.dims.index(split) if split in v.dims else None
        for p, h in zip(paths, heads):
            if axis is None and p != paths[0]:
                break
            here = h.map(p, name)
            n = here.shape[axis] if axis is not None else 0
            target = out if axis is None else out[tuple(slice(at, at + n) if k == axis else slice(None) for k in range(out.ndim))]
            rows = max(1, BLOCK * len(here) // max(here.size, 1))
            for a in range(0, len(here), rows):
                target[a : a + rows] = here[a : a + rows]
            at += n
        out.flush()
    os.replace(part, path)
    if not keep:
        for p in paths:
            os.remove(p)


def write(spark: SparkSession, spec: GridSpec, path: str, overwrite: bool = False) -> None:
    """The generated dataset as arrays on each variable's own dims, with coordinates and attributes, in one file."""
    _may_write(path, overwrite)
    concat(write_chunks(spark, spec, f"{path}.chunk", overwrite=True), path, overwrite)


# -- reading ------------------------------------------------------------------------------------------------------


def variable_rows(spark: SparkSession, path: str, name: str, head: Header | None = None) -> DataFrame:
    """A variable's occupied cells: an index column for each of its dims, then the decoded value."""
    head = head or read_header(path)
    v = head.variables[name]
    dims, text = v.dims[: -1 if v.code == 2 else None], v.code == 2
    shape = [head.dims[d] for d in dims]
    n, fill = math.prod(shape), v.attrs.get("_FillValue")
    scale, offset = v.attrs.get("scale_factor", 1), v.attrs.get("add_offset", 0)
    packed = "scale_factor" in v.attrs or "add_offset" in v.attrs
    kind = "string" if text else "double" if packed else {1: "tinyint", 3: "smallint", 4: "int", 5: "float", 6: "double"}[v.code]
    types = ", ".join([f"`{d}` long" for d in dims] + [f"`{name}` {kind}"])

    def read(batches):
        for pdf in batches:
            for block in pdf["id"]:
                lo, hi = int(block) * BLOCK, min(n, (int(block) + 1) * BLOCK)
                array = head.map(path, name)
                if text:
                    raw = np.ascontiguousarray(array.reshape(n, -1)[lo:hi])
                    values = raw.view(f"S{raw.shape[1]}")[:, 0]
                    at = np.flatnonzero(values != b"")
                    got = [x.decode() for x in values[at].tolist()]
                else:
                    values = np.asarray(array.reshape(-1)[lo:hi])
                    values = values.astype(values.dtype.newbyteorder("="))
                    held = ~np.isnan(values) if values.dtype.kind == "f" else np.ones(len(values), bool)
                    if fill is not None and fill == fill:
                        held &= values != fill
                    at = np.flatnonzero(held)
                    got = values[at] * float(scale) + float(offset) if packed else values[at]
                index = np.unravel_index(at + lo, shape) if shape else ()
                yield pd.DataFrame({**dict(zip(dims, index)), name: got})

    return spark.range(0, math.ceil(n / BLOCK), 1, min(math.ceil(n / BLOCK), 4096)).mapInPandas(read, types)


def axes_of(head: Header) -> list[str]:
    """The dims but for widths of text."""
    widths = {v.dims[-1] for v in head.variables.values() if v.code == 2}
    return [d for d in head.dims if d not in widths]


def names_of(head: Header) -> list[str]:
    return [v for v in head.variables if v not in head.dims]


def dims_of(head: Header) -> dict[str, list[str]]:
    """The dims of each variable."""
    return {v: [d for d in head.variables[v].dims if d in axes_of(head)] for v in names_of(head)}


def whole_header(path: str | list[str]) -> Header:
    return read_header(path) if isinstance(path, str) else joined([read_header(p) for p in path])


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The table of a file: labels by dim, then one column a variable.

    Several files are the chunks of one dataset along its split axis. Every variable varies on that axis, so no cell
    of one chunk matches a row of another and their tables are simply put together.
    """
    if not isinstance(path, str):
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(spark, p) for p in path])
    head = read_header(path)
    dims, own = axes_of(head), dims_of(head)
    variables = {v: (own[v], variable_rows(spark, path, v, head)) for v in names_of(head)}
    if not any(len(d) == len(dims) for d in own.values()):
        raise ValueError(f"{path}: no variable lies on all dims")
    axes = {d: spark.createDataFrame(list(enumerate(np.asarray(head.map(path, d)).tolist())), "i long, x double") for d in dims if d in head.variables}
    return layout.label(layout.to_table(variables, dims, sort=False), axes)
