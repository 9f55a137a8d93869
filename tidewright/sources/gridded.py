"""Gridded NetCDF files of the classic formats (CDF-1, -2 and -5) as a data source, and a small writer.

A file is split by time steps; a task reads one variable's slice at a time and yields it as Arrow batches
``file, variable, t_s, cell_idx, value``, unpacked, missing values null. Only the variables asked for are read. Where ``wide`` is set, a
cell's values at a time are one row, ``file_no, t_s, cell_idx, known`` and a column for each variable.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import floor, prod

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewright.operators.grid import MISSING
from tidewright.sources.files import file_sizes, list_files, open_input, open_output

# The classic format's external types and list tags; coordinates never use the sentinel.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
NO_SENTINEL = ("lon", "lat", "depth")
UNSUPPORTED = (2, 7, 8, 9, 11)
#: Rows of a batch of wide rows.
WIDE_ROWS = 1 << 17
SCHEMA = "file string, variable string, t_s bigint, cell_idx bigint, value double"


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    kind: int
    size: int
    begin: int


class ClassicFile:
    """The header of a classic file, and slices of its variables."""

    def __init__(self, source) -> None:
        self.source = source
        magic = source.read(4)
        if magic[:3] != b"CDF" or magic[3:] not in (b"\1", b"\2", b"\5"):
            raise ValueError("not a classic NetCDF file (HDF5-based files need another reader)")
        self.version = magic[3]
        self.records = self._count()
        self.dims = [(self._name(), self._count()) for _ in range(self._list(DIMENSIONS))]
        self.attributes = self._attributes()
        self.variables: dict[str, Variable] = {}
        for _ in range(self._list(VARIABLES)):
            name = self._name()
            dims = [self._count() for _ in range(self._count())]
            attributes, kind, size = self._attributes(), self._int(), self._count()
            begin = self._int() if self.version == 1 else self._long()
            self.variables[name] = Variable(name, dims, attributes, kind, size, begin)
        own = [v for v in self.variables.values() if self.is_record(v)]
        exact = lambda v: self._per_step(v) * np.dtype(TYPES[v.kind]).itemsize
        self.record_size = exact(own[0]) if len(own) == 1 else sum(-(-exact(v) // 4) * 4 for v in own)

    def _int(self) -> int:
        return struct.unpack(">i", self.source.read(4))[0]

    def _long(self) -> int:
        return struct.unpack(">q", self.source.read(8))[0]

    def _count(self) -> int:
        return self._long() if self.version == 5 else self._int()

    def _list(self, tag: int) -> int:
        found, n = self._int(), self._count()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("a NetCDF header is damaged")
        return n

    def _name(self) -> str:
        n = self._count()
        return self.source.read(-(-n // 4) * 4)[:n].decode()

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list(ATTRIBUTES)):
            name, kind, n = self._name(), self._int(), self._count()
            size = n * np.dtype(TYPES[kind]).itemsize
            data = self.source.read(-(-size // 4) * 4)[:size]
            out[name] = data.decode(errors="replace") if kind == 2 else np.frombuffer(data, dtype=TYPES[kind])
        return out

    def is_record(self, v: Variable) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0

    def has_time(self, v: Variable) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]][0] == "time"

    def shape(self, v: Variable) -> list[int]:
        return [self.records if k == 0 and self.is_record(v) else self.dims[d][1] for k, d in enumerate(v.dims)]

    def _per_step(self, v: Variable) -> int:
        return prod(self.shape(v)[1:]) if self.is_record(v) or self.has_time(v) else prod(self.shape(v))

    def cells(self, v: Variable) -> int:
        """How many values a time step has."""
        return self._per_step(v)

    def slice(self, v: Variable, step: int = 0) -> np.ndarray:
        """Raw values at a time step (all values of a variable without time)."""
        n, kind = self._per_step(v), np.dtype(TYPES[v.kind])
        stride = self.record_size if self.is_record(v) else n * kind.itemsize
        self.source.seek(v.begin + step * stride)
        return np.frombuffer(self.source.read(n * kind.itemsize), dtype=kind)

    def times(self) -> list[int]:
        """Whole seconds, by the unit's name; the origin isn't looked at."""
        v = self.variables["time"]
        units = str(v.attributes.get("units", "")).lower()
        factor = 3600 if "hour" in units else 86400 if "day" in units else 1
        n = self.shape(v)[0]
        values = np.concatenate([self.slice(v, k) for k in range(n)]) if self.is_record(v) else np.frombuffer(self.slice_all(v), dtype=TYPES[v.kind])
        return [floor(abs(x) * factor + 0.5) * (1 if x >= 0 else -1) for x in values.astype(np.float64).tolist()]

    def slice_all(self, v: Variable) -> bytes:
        self.source.seek(v.begin)
        return self.source.read(prod(self.shape(v)) * np.dtype(TYPES[v.kind]).itemsize)

    def unpacked(self, v: Variable, step: int = 0) -> pa.Array:
        """Values times the scale plus the offset; null where the raw value is the variable's mark for missing, or no number."""
        raw = self.slice(v, step).astype(np.float64)
        mark = next((float(np.ravel(v.attributes[a])[0]) for a in ("_FillValue", "missing_value") if a in v.attributes and not isinstance(v.attributes[a], str)), None)
        if mark is None and v.name not in NO_SENTINEL:
            mark = MISSING
        scale, offset = (float(np.ravel(v.attributes.get(a, d))[0]) for a, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
        gone = np.isnan(raw) | (raw == mark if mark is not None else False)
        return pa.array(raw * scale + offset, mask=gone)


def header_errors(path: str, variables: list[str], times: int | None = None, leading: tuple[str, ...] = ("time",)) -> list[str]:
    """What is wrong with a file's header, in words; empty where all is well. Never raises for the file's content.

    Looked at: the variable ``time`` and its length, each variable's presence, type, dimensions (none, or of size zero), the dimension it
    begins with (one of ``leading``), and how many times it has.
    """
    try:
        with open_input(path) as source:
            f = ClassicFile(source)
            errors = []
            if "time" not in f.variables:
                errors.append("no variable time")
            elif times is not None and f.shape(f.variables["time"])[0] != times:
                errors.append(f"time has {f.shape(f.variables['time'])[0]} values, not {times}")
            for name in variables:
                v = f.variables.get(name)
                if v is None:
                    errors.append(f"no variable {name}")
                    continue
                if v.kind in UNSUPPORTED:
                    errors.append(f"{name} has a type that isn't read")
                if not v.dims:
                    errors.append(f"{name} has no dimensions")
                    continue
                names = [f.dims[d][0] for d in v.dims]
                errors += [f"{name} has a dimension {d} of size 0" for d, n in zip(names, f.shape(v), strict=True) if n == 0]
                if leading and names[0] not in leading:
                    errors.append(f"{name} begins with the dimension {names[0]}, not {' or '.join(leading)}")
                if f.has_time(v) and times is not None and f.shape(v)[0] != times:
                    errors.append(f"{name} has {f.shape(v)[0]} times, not {times}")
            return errors
    except (ValueError, OSError, struct.error, KeyError) as e:
        return [str(e)]


def header_report(spark: SparkSession, path: str, variables: list[str], times: int | None = None, leading: tuple[str, ...] = ("time",)) -> DataFrame:
    """``file, error`` for all errors of all files' headers, which tasks read; no row where all is well."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(p, e) for p in frame["file"] for e in header_errors(p, variables, times, leading)]
            yield pd.DataFrame(found, columns=["file", "error"])

    listed = list_files(path)
    files = spark.createDataFrame([(x,) for x in listed], "file string").repartition(max(1, min(len(listed), spark.sparkContext.defaultParallelism)))
    return files.mapInPandas(look, "file string, error string")


#: Bytes of files that a task reads: smaller files are read some at a time, larger ones by ranges of their time steps.
SPLIT_BYTES = 32 << 20


@dataclass
class FileParts(InputPartition):
    """Files of one task: path, and which part of how many (by time steps) of it."""

    parts: list[tuple[str, int, int]]


def plan_parts(files: list[tuple[str, int]], split: int) -> list[FileParts]:
    """Tasks from the files' sizes alone: no header is opened to plan, a task works out its steps from the header that it reads."""
    tasks: list[FileParts] = []
    together: list[tuple[str, int, int]] = []
    size = 0
    for path, n in files:
        if n > split:
            m = -(-n // split)
            tasks += [FileParts([(path, k, m)]) for k in range(m)]
            continue
        if together and size + n > split:
            tasks.append(FileParts(together))
            together, size = [], 0
        together.append((path, 0, 1))
        size += n
    return tasks + ([FileParts(together)] if together else [])


def is_wide(options) -> bool:
    return options.get("wide", "false").lower() == "true"


class GridReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.variables = [x for x in options.get("variables", "").split(",") if x]
        self.split = int(options.get("splitBytes", str(SPLIT_BYTES)))
        self.wide = is_wide(options)
        self.numbers = {path: n for n, path in enumerate(sorted(list_files(self.path)))} if self.wide else {}

    def partitions(self) -> list[FileParts]:
        return plan_parts(file_sizes(self.path), self.split)

    def read(self, partition: FileParts) -> Iterator[pa.RecordBatch]:
        for path, part, of in partition.parts:
            with open_input(path) as source:
                yield from (self._wide if self.wide else self._slices)(path, ClassicFile(source), part, of)

    def _wide(self, path: str, f: ClassicFile, part: int, of: int) -> Iterator[pa.RecordBatch]:
        """Variables that the file hasn't are null and have no bit in ``known``; those of other sizes come in rows of their own."""
        times = f.times() if "time" in f.variables else [0]
        first, last = len(times) * part // of, len(times) * (part + 1) // of
        found = {name: f.variables[name] for name in self.variables if name in f.variables and f.variables[name].kind not in UNSUPPORTED}
        for timed, n in dict.fromkeys((f.has_time(v), f.cells(v)) for v in found.values()):
            here = {name: v for name, v in found.items() if (f.has_time(v), f.cells(v)) == (timed, n)}
            known = sum(1 << k for k, name in enumerate(self.variables) if name in here)
            for step in range(first, last) if timed else [0] * (part == 0):
                whole = lambda x: pa.array(np.full(n, x, dtype=np.int64))  # noqa: E731, B023
                batch = pa.record_batch(
                    [whole(self.numbers[path]), whole(times[step] if timed else 0), pa.array(np.arange(n, dtype=np.int64)), whole(known)]
                    + [f.unpacked(here[name], step) if name in here else pa.nulls(n, pa.float64()) for name in self.variables],
                    names=["file_no", "t_s", "cell_idx", "known", *self.variables],
                )
                yield from (batch.slice(at, WIDE_ROWS) for at in range(0, n, WIDE_ROWS))

    def _slices(self, path: str, f: ClassicFile, part: int, of: int) -> Iterator[pa.RecordBatch]:
        times = f.times() if "time" in f.variables else [0]
        first, last = len(times) * part // of, len(times) * (part + 1) // of
        for name in self.variables or [n for n in f.variables if n != "time"]:
            v = f.variables.get(name)
            if v is None or v.kind in UNSUPPORTED:
                continue  # a variable that can't be read is left out, the others go on; ``header_report`` names it
            timed = f.has_time(v)
            for step in range(first, last) if timed else [0] * (part == 0):
                values = f.unpacked(v, step)
                n = len(values)
                yield pa.record_batch(
                    [pa.array([path] * n), pa.array([name] * n), pa.array(np.full(n, times[step] if timed else 0, dtype=np.int64)), pa.array(np.arange(n, dtype=np.int64)), values],
                    names=["file", "variable", "t_s", "cell_idx", "value"],
                )


class GridSource(DataSource):
    """``format("gridnc")`` with ``path`` (files or folders, commas between) and ``variables``.

    ``wide``: ``file_no`` is a file's number in the order of paths; bit n of ``known`` says whether the file has the n-th of ``variables``.
    """

    @classmethod
    def name(cls) -> str:
        return "gridnc"

    def schema(self) -> str:
        if is_wide(self.options):
            return "file_no bigint, t_s bigint, cell_idx bigint, known bigint" + "".join(f", `{name}` double" for name in self.options["variables"].split(","))
        return SCHEMA

    def reader(self, schema) -> GridReader:
        return GridReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GridSource)


def _describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for p in frame["file"]:
            with open_input(p) as source:
                f = ClassicFile(source)
                times = f.times() if "time" in f.variables else []
                yield pd.DataFrame([(p, v.name, TYPES[v.kind], f.shape(v), times) for v in f.variables.values()], columns=["file", "variable", "type", "shape", "times"])


def grid_meta(spark: SparkSession, path: str) -> DataFrame:
    """``file, variable, type, shape, times`` from the headers; one task for some files."""
    files = spark.createDataFrame([(x,) for x in list_files(path)], "file string")
    return files.mapInPandas(_describe, "file string, variable string, type string, shape array<bigint>, times array<bigint>")


def classic_header(dims: dict[str, int], variables: dict[str, tuple[list[str], np.dtype, dict]], texts: dict | None = None) -> tuple[bytes, list[int]]:
    """The header of a file with fixed dimensions, and how many zero bytes follow each variable's values.

    ``variables``: dimensions, type and attributes (strings or numbers); ``texts``: attributes of the file. CDF-5 where a type needs it, else CDF-2.
    """
    kinds = {np.dtype(t).newbyteorder("="): k for k, t in TYPES.items() if k != 2}
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    kind_of = lambda x: kinds[np.dtype(x).newbyteorder("=")]
    numbers = [kind_of(np.asarray(x).dtype) for a in (texts or {}, *(v[2] for v in variables.values())) for x in a.values() if not isinstance(x, str)]
    wide = max([*numbers, *(kind_of(t) for _, t, _ in variables.values())], default=0) >= 7
    size = (lambda n: struct.pack(">q", n)) if wide else (lambda n: struct.pack(">i", n))
    name = lambda s: size(len(s.encode())) + pad(s.encode())
    tag = lambda t, n: struct.pack(">i", t if n else 0) + size(n)

    def attributes(a: dict) -> bytes:
        out = tag(ATTRIBUTES, len(a))
        for k, x in a.items():
            if isinstance(x, str):
                out += name(k) + struct.pack(">i", 2) + name(x)
            else:
                x = np.atleast_1d(np.asarray(x))
                out += name(k) + struct.pack(">i", kind_of(x.dtype)) + size(len(x)) + pad(x.astype(x.dtype.newbyteorder(">")).tobytes())
        return out

    order = list(dims)
    lengths = {n: prod(dims[d] for d in ds) * np.dtype(t).itemsize for n, (ds, t, _) in variables.items()}

    def header(begins: dict[str, int]) -> bytes:
        out = (b"CDF\5" if wide else b"CDF\2") + size(0) + tag(DIMENSIONS, len(dims)) + b"".join(name(d) + size(n) for d, n in dims.items()) + attributes(texts or {})
        out += tag(VARIABLES, len(variables))
        for n, (ds, t, attrs) in variables.items():
            out += name(n) + size(len(ds)) + b"".join(size(order.index(d)) for d in ds) + attributes(attrs)
            out += struct.pack(">i", kind_of(t)) + size(-(-lengths[n] // 4) * 4) + struct.pack(">q", begins[n])
        return out

    at, begins = len(header(dict.fromkeys(variables, 0))), {}
    for n, length in lengths.items():
        begins[n], at = at, at + -(-length // 4) * 4
    return header(begins), [-length % 4 for length in lengths.values()]


def write_classic(path: str, dims: dict[str, int], variables: dict[str, tuple[list[str], np.ndarray, dict]], texts: dict | None = None) -> None:
    """A classic file with fixed dimensions; attributes are strings or numbers."""
    head, paddings = classic_header(dims, {n: (ds, a.dtype, attrs) for n, (ds, a, attrs) in variables.items()}, texts)
    with open_output(path) as out:
        out.write(head)
        for (_, a, _), padding in zip(variables.values(), paddings, strict=True):
            out.write(np.ascontiguousarray(a).astype(a.dtype.newbyteorder(">")).tobytes() + bytes(padding))


#: Nodes of a domain are numbered from its place in the list times this.
DOMAIN_NODES = 1 << 40


def load_domains(spark: SparkSession, paths: list[str], u: str, v: str, dt: int, span: tuple[int, int] | None = None, solve: Callable[[DataFrame], DataFrame] = lambda samples: samples) -> tuple[DataFrame, DataFrame]:
    """``load_month`` of several domains, whose nodes and samples become one table each.

    ``solve`` is applied to each domain's samples by themselves, as long as they lie in partitions by ``node_id``.
    """
    found = [load_month(spark, path, u, v, dt, span) for path in paths]
    out = []
    for tables in ([nodes for nodes, _ in found], [solve(samples) for _, samples in found]):
        moved = [t.withColumn("node_id", F.col("node_id") + n * DOMAIN_NODES) for n, t in enumerate(tables)]
        out.append(moved[0])
        for more in moved[1:]:
            out[-1] = out[-1].unionByName(more)
    return out[0], out[1]


def step_times(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """``file, t_s``: the times at which the files have values of some of these variables, from the headers."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame["file"]:
                with open_input(p) as source:
                    f = ClassicFile(source)
                    times = f.times() if "time" in f.variables else [0]
                    some = [v for name in variables if (v := f.variables.get(name)) is not None and v.kind not in UNSUPPORTED and f.cells(v)]
                    at = sorted({t for v in some for t in (times if f.has_time(v) else [0])})
                    yield pd.DataFrame({"file": [p] * len(at), "t_s": np.array(at, dtype=np.int64)})

    listed = list_files(path)
    files = spark.createDataFrame([(x,) for x in listed], "file string").repartition(max(1, min(len(listed), spark.sparkContext.defaultParallelism)))
    return files.mapInPandas(look, "file string, t_s bigint")


def load_month(spark: SparkSession, path: str, u: str, v: str, dt: int, span: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (``node_id, lon, lat, sea``) and gap-free samples (``node_id, t_s, u, v``) of one domain's files.

    ``span``: the first second of a month and of the next one; samples from a day before it to the end of the next one's second day,
    which is the last day whose file belongs to the month, are taken.

    Longitude and latitude are 1-D variables of the first file, in degrees; the mask is that of ``u`` at its earliest time; of repeated times the
    last file counts; sea nodes alone are put on the regular axis and filled. The files' times come from their headers, so the mask is read from the
    files of the earliest time alone, and all values are shuffled once, by node (where ``BY_NODE`` is set when the samples are worked out).
    """
    from tidewright.operators import grid, series
    from tidewright.operators.storage import cut_lineage

    register(spark)
    read = lambda where, names: spark.read.format("gridnc").option("path", where).option("variables", names)
    fixed = read(list_files(path)[0], "lon,lat").load()
    axis = lambda name, i: fixed.where(F.col("variable") == name).select(F.col("cell_idx").alias(i), F.col("value").alias(f"{name}_deg"))
    nodes = grid.build_nodes(axis("lon", "i"), axis("lat", "j"))
    times = step_times(spark, path, [u, v]).collect()  # some 33 rows, or as many as times
    times = [r for r in times if span is None or span[0] - 86400 <= r["t_s"] < span[1] + 2 * 86400]
    low, high = min((r["t_s"] for r in times), default=0), max((r["t_s"] for r in times), default=-1)
    earliest = ",".join(sorted({r["file"] for r in times if r["t_s"] == low})) or path

    def values(where: str, first: int, last: int) -> DataFrame:
        """``cell_idx, t_s, u, v``; of repeated times the last file that has the variable counts."""
        rows = read(where, f"{u},{v}").option("wide", "true").load().where(F.col("t_s").between(first, last))
        pick = lambda name, bit: F.max_by(name, F.when(F.col("known").bitwiseAND(bit) > 0, F.col("file_no")))
        return rows.repartition("cell_idx").groupBy("cell_idx", "t_s").agg(pick(u, 1).alias("u"), pick(v, 2).alias("v"))

    mask = values(earliest, low, min(low, high)).select("cell_idx", F.col("u").isNotNull().alias("sea"))
    nodes = cut_lineage(nodes.join(mask, "cell_idx").withColumnRenamed("cell_idx", "node_id"))
    sea = nodes.where("sea").select("node_id")
    samples = values(path, low, high).withColumnRenamed("cell_idx", "node_id").join(sea, "node_id", "left_semi")
    filled = series.fill_gaps(series.on_axis(samples, sea, spark.range(low, high + 1, dt).withColumnRenamed("id", "t_s"), "node_id"), "node_id", "t_s", ["u", "v"])
    return nodes, filled


#: Session settings under which rows dealt out by node are joined by node and time where they are, in partitions that tasks sort in memory.
BY_NODE = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}
