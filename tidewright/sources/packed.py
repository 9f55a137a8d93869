"""Packed particle records (PKD1, plain and gzip) and packed trajectories (PKD2): Python data sources and writers.

Plain files are split by record ranges, PKD2 files by entries of their table of contents, gzip files are read whole by a task
(their members can't be split) in bounded blocks. ``df.write.format("pkd1")`` and ``("pkd2")`` make a file for each task, streamed in
bounded memory and published by the commit (``spool``); a task that fails leaves nothing.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidewright.functions.geo import clamp_lat
from tidewright.operators.trajectory import decimate, unwrap
from tidewright.sources.files import list_files, open_input, open_output
from tidewright.sources.spool import Spool, SpoolWriter, finish

# The formats' layouts (little-endian), magic words, versions and scale.
RECORD = np.dtype([("lon0_q", "<i4"), ("lat0_q", "<i4"), ("lon1_q", "<i4"), ("lat1_q", "<i4"), ("t0_s", "<i8"), ("t1_s", "<i8"), ("flags", "u1")])
HEADER_1, MAGIC_1, VERSION_1 = struct.Struct("<8sIIQQQ"), b"PKD1", 1
HEADER_2, MAGIC_2, VERSION_2 = struct.Struct("<8sIB3xIqiIQQ"), b"PKD2", 3
BLOCK_2, ENTRY_2 = struct.Struct("<QiHHIii"), struct.Struct("<QQIIIiHH")
SCALE = 1_000_000
GZIP_START = bytes([0x1F, 0x8B, 8])

RECORD_SCHEMA = "lon0_q int, lat0_q int, lon1_q int, lat1_q int, t0_s bigint, t1_s bigint, flags smallint"
SAMPLE_SCHEMA = "seed_id bigint, idx bigint, t_s bigint, lon double, lat double"
#: Records in a split or batch; trajectories in a split.
SPLIT_RECORDS, BATCH_RECORDS, SPLIT_BLOCKS = 1 << 20, 1 << 16, 1 << 12


# --- PKD1 ------------------------------------------------------------------------------------------------------------


def header_1(released: int = 0, records: int = 0) -> bytes:
    return HEADER_1.pack(MAGIC_1, VERSION_1, SCALE, 1, released, records)


def check_header_1(data: bytes) -> tuple[int, int]:
    """Released and record counts of a header; ValueError where it is none."""
    if len(data) < HEADER_1.size:
        raise ValueError("a PKD1 file ends within its header")
    magic, version, scale, tick, released, records = HEADER_1.unpack(data)
    if magic[:4] != MAGIC_1 or version != VERSION_1 or scale != SCALE or tick != 1:
        raise ValueError("not a PKD1 header of version 1")
    return released, records


def _batch(records: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(records[n].astype(np.int16 if n == "flags" else records.dtype[n])) for n in RECORD.names]
    return pa.record_batch(columns, names=list(RECORD.names))


def gzip_member(data: bytes, extra: bytes | None, level: int = 6) -> bytes:
    """A gzip member; ``extra`` (a header) goes into the subfield PK."""
    if len(data) >= 1 << 32:
        raise ValueError("a gzip member holds less than 4 GiB")
    field = b"" if extra is None else struct.pack("<H2sH", len(extra) + 4, b"PK", len(extra)) + extra
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    head = GZIP_START + bytes([4 if extra is not None else 0, 0, 0, 0, 0, 0, 0xFF])
    return head + field + packer.compress(data) + packer.flush() + struct.pack("<II", zlib.crc32(data), len(data))


def write_plain(path: str, records: np.ndarray) -> None:
    with open_output(path) as out:
        out.write(header_1())
        out.write(records.tobytes())


def write_gzip(path: str, records: np.ndarray, released: int = 0, append: bool = False) -> None:
    """Writes a gzip file, or appends a member to a local one and raises the record count in its header."""
    if not append:
        with open_output(path) as out:
            out.write(gzip_member(records.tobytes(), header_1(released, len(records))))
    elif len(records):
        with open(path, "r+b") as f:
            before, count = gzip_header(f.read(16 + HEADER_1.size))
            f.seek(16)
            f.write(header_1(before, count + len(records)))
            f.seek(0, 2)
            f.write(gzip_member(records.tobytes(), None))


def gzip_header(start: bytes) -> tuple[int, int]:
    if start[:3] != GZIP_START or not start[3] & 4 or start[12:14] != b"PK":
        raise ValueError("not a gzip file with a PK subfield")
    return check_header_1(start[16 : 16 + HEADER_1.size])


def read_gzip(path: str) -> Iterator[np.ndarray]:
    """Records of all members, in blocks; ValueError where the file is cut short."""
    with open_input(path) as f:
        gzip_header(f.read(16 + HEADER_1.size))
        f.seek(0)
        plain, gz, fed = b"", zlib.decompressobj(31), False
        while True:
            data = gz.unconsumed_tail or (gz.unused_data if gz.eof else b"") or f.read(1 << 18)
            if gz.eof and data:
                gz, fed = zlib.decompressobj(31), False
            if not data:
                break
            fed = True
            plain += gz.decompress(data, BATCH_RECORDS * RECORD.itemsize)
            whole = len(plain) // RECORD.itemsize * RECORD.itemsize
            if whole:
                yield np.frombuffer(plain[:whole], dtype=RECORD)
                plain = plain[whole:]
        if plain or (fed and not gz.eof):
            raise ValueError(f"{path} ends within a record or member")


@dataclass
class RecordRange(InputPartition):
    path: str
    start: int
    count: int


class PackedReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[RecordRange]:
        parts: list[RecordRange] = []
        for path in list_files(self.path):
            with open_input(path) as f:
                if f.read(3) == GZIP_START:
                    parts.append(RecordRange(path, 0, -1))
                    continue
                size = f.size() - HEADER_1.size
                f.seek(0)
                check_header_1(f.read(HEADER_1.size))
            if size % RECORD.itemsize:
                raise ValueError(f"{path} ends within a record")
            n = size // RECORD.itemsize
            parts += [RecordRange(path, at, min(SPLIT_RECORDS, n - at)) for at in range(0, n, SPLIT_RECORDS)]
        return parts

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        if partition.count < 0:
            yield from map(_batch, read_gzip(partition.path))
            return
        with open_input(partition.path) as f:
            f.seek(HEADER_1.size + partition.start * RECORD.itemsize)
            for at in range(0, partition.count, BATCH_RECORDS):
                n = min(BATCH_RECORDS, partition.count - at)
                yield _batch(np.frombuffer(f.read(n * RECORD.itemsize), dtype=RECORD))


class PackedSource(DataSource):
    """``format("pkd1")``: plain or gzip files, or folders of them."""

    @classmethod
    def name(cls) -> str:
        return "pkd1"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options, overwrite)


def spool_records(batches: Iterator[pa.RecordBatch], folder: str, gzip: bool, released: int, mark: str, spools: list[Spool]) -> Iterator[str]:
    """One hidden file of all records: gzip members of a batch each, or plain rows. The header with their number comes before them."""
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.empty(batch.num_rows, dtype=RECORD)
        for name in RECORD.names:
            rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
        if not spools:
            spools.append(Spool(folder, mark))
        spools[0].add(gzip_member(rows.tobytes(), None) if gzip else rows.tobytes())
        n += len(rows)
    if n:
        head = gzip_member(b"", header_1(released, n)) if gzip else header_1(released, n)
        yield finish(folder, mark, f"{uuid.uuid4().hex}.pkd" + ".gz" * gzip, head, spools.pop())


class PackedWriter(SpoolWriter):
    def __init__(self, options, overwrite: bool) -> None:
        super().__init__(options["path"], overwrite)
        self.gzip, self.released = options.get("compression", "gzip") == "gzip", int(options.get("released", "0"))

    def files(self, batches: Iterator[pa.RecordBatch], spools: list[Spool]) -> Iterator[str]:
        return spool_records(batches, self.folder, self.gzip, self.released, self.mark, spools)


def write_packed(records: DataFrame, folder: str, gzip: bool = True, mode: str = "append") -> None:
    """Writes ``RECORD_SCHEMA`` rows into a folder, one file for each task that has any; all appear at the commit."""
    register(records.sparkSession)
    typed = records.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in RECORD_SCHEMA.split(", "))])
    typed.write.format("pkd1").mode(mode).option("compression", "gzip" if gzip else "none").save(folder)


# --- PKD2 ------------------------------------------------------------------------------------------------------------


def encode_block(seed_id: int, start: int, stride: int, lon: np.ndarray, lat: np.ndarray) -> bytes:
    """A block from unwrapped longitudes and clamped latitudes. Differences are taken before they are rounded."""
    ticks = lambda x: np.clip(np.copysign(np.floor(np.abs(x) * SCALE + 0.5), x), -(1 << 31), (1 << 31) - 1).astype("<i4")
    head = BLOCK_2.pack(seed_id, start, stride, 0, len(lon), int(ticks(lon[0])), int(ticks(lat[0])))
    return head + ticks(np.diff(lon)).tobytes() + ticks(np.diff(lat)).tobytes()


def decode_block(raw: bytes) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    seed_id, start, stride, _, n, lon0, lat0 = BLOCK_2.unpack_from(raw)
    steps = np.frombuffer(raw, dtype="<i4", offset=BLOCK_2.size, count=2 * max(0, n - 1)).reshape(2, -1).astype(np.int64)
    lon, lat = (np.concatenate([[q], q + np.cumsum(d)])[:n] / SCALE for q, d in zip((lon0, lat0), steps, strict=True))
    return seed_id, start, stride, lon, lat


def spool_blocks(batches: Iterator[pa.RecordBatch], folder: str, dt: int, epoch: int, stride: int, mark: str, spools: list[Spool]) -> Iterator[str]:
    """One hidden file of a task's trajectories, whose rows come in order of (seed, idx): one trajectory is held at a time.

    Blocks and entries go to a spool each, as the header before them names the number of entries and their place.
    """
    n, held = 0, []

    def close() -> None:
        nonlocal n
        seed, idx, lon, lat = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        raw = encode_block(int(seed[0]), int(idx[0]), stride, lon, lat)
        packed = zlib.compress(raw)
        if not spools:
            spools.extend((Spool(folder, mark), Spool(folder, mark)))
        spools[1].add(ENTRY_2.pack(int(seed[0]), HEADER_2.size + spools[0].size, len(packed), len(raw), len(lon), int(idx[0]), stride, 0))
        spools[0].add(packed)
        n += 1

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("seed_id", "idx", "lon", "lat")]
        edges = np.flatnonzero(np.diff(columns[0])) + 1
        for part in zip(*(np.split(c, edges) for c in columns), strict=True):
            if len(part[0]):
                if held and held[0][0][0] != part[0][0]:
                    close()
                held.append(part)
    if held:
        close()
    if n:
        body, entries = spools
        head = HEADER_2.pack(MAGIC_2, VERSION_2, 1, SCALE, epoch, dt, 0, n, HEADER_2.size + body.size)
        spools.clear()
        yield finish(folder, mark, f"{uuid.uuid4().hex}.pkd2", head, body, entries)


class TrajectoryWriter(SpoolWriter):
    def __init__(self, options, overwrite: bool) -> None:
        super().__init__(options["path"], overwrite)
        self.dt, self.epoch, self.stride = (int(options.get(c, d)) for c, d in (("dt", "1"), ("epoch", "0"), ("stride", "1")))

    def files(self, batches: Iterator[pa.RecordBatch], spools: list[Spool]) -> Iterator[str]:
        return spool_blocks(batches, self.folder, self.dt, self.epoch, self.stride, self.mark, spools)


def write_trajectories(samples: DataFrame, folder: str, dt: int, epoch: int = 0, stride: int = 1, key: str = "seed_id", order: str = "idx", mode: str = "append") -> None:
    """Writes samples (``seed_id, idx, lon, lat``) into a folder, one PKD2 file for each task that has any; all appear at the commit.

    Unwrapping and decimation are windows; a task then takes its rows in order and holds one trajectory at a time.
    """
    register(samples.sparkSession)
    ready = decimate(unwrap(samples, key, order), stride, key, order) if stride > 1 else unwrap(samples, key, order)
    ready = ready.select(F.col(key).cast("bigint").alias("seed_id"), F.col(order).cast("bigint").alias("idx"), F.col("lon_unwrapped").alias("lon"), clamp_lat(F.col("lat")).alias("lat"))
    sorted_rows = ready.repartition("seed_id").sortWithinPartitions("seed_id", "idx")
    sorted_rows.write.format("pkd2").mode(mode).option("dt", dt).option("epoch", epoch).option("stride", stride).save(folder)


def read_head(f, path: str) -> tuple[int, int, int, int]:
    """Epoch, dt, the number of entries and where they begin."""
    head = f.read(HEADER_2.size)
    if len(head) < HEADER_2.size:
        raise ValueError(f"{path} ends within its header")
    magic, version, _, scale, epoch, dt, _, n, offset = HEADER_2.unpack(head)
    if magic[:4] != MAGIC_2 or version != VERSION_2 or scale != SCALE or dt <= 0:
        raise ValueError(f"{path} is no PKD2 file of version {VERSION_2}")
    return epoch, dt, n, offset


def read_entries(f, path: str, offset: int, first: int, last: int) -> np.ndarray:
    """Entries ``first`` to ``last`` (not included) of a table of contents: only their bytes are read."""
    f.seek(offset + first * ENTRY_2.size)
    data = f.read((last - first) * ENTRY_2.size)
    if len(data) < (last - first) * ENTRY_2.size:
        raise ValueError(f"{path} ends within its table of contents")
    return np.frombuffer(data, dtype=ENTRY)


def read_toc(path: str) -> tuple[int, int, list[tuple]]:
    """Epoch, dt and entries of one file; of entries with equal ids the last one counts."""
    with open_input(path) as f:
        epoch, dt, n, offset = read_head(f, path)
        entries = read_entries(f, path, offset, 0, n)
    return epoch, dt, list({int(e["seed"]): tuple(e.tolist()) for e in entries}.values())


#: An entry of a table of contents, as ``ENTRY_2`` packs it.
ENTRY = np.dtype([("seed", "<u8"), ("offset", "<u8"), ("size", "<u4"), ("raw", "<u4"), ("points", "<u4"), ("start", "<i4"), ("stride", "<u2"), ("flags", "<u2")])


@dataclass
class BlockRange(InputPartition):
    path: str
    first: int
    last: int


class TrajectoryReader(DataSourceReader):
    """Samples of all blocks. A task reads the entries of its own range, whatever the size of the file.

    Filters on ``seed_id`` (=, IN, <, <=, >, >=) are answered from the entries, before a block is read. Of entries with equal ids the last one
    of a task counts; ``read_trajectories`` settles those that lie further apart in a file. The option ``places`` adds ``file, place``, the
    number of a block's entry; with ``toc`` that and the id are all that is read.
    """

    def __init__(self, options) -> None:
        self.path, self.tests = options["path"], []
        self.places, self.toc = options.get("places") == "true", options.get("toc") == "true"

    def pushFilters(self, filters: list) -> Iterator:
        kinds = {EqualTo: "==", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in kinds and f.attribute == ("seed_id",):
                self.tests.append((kinds[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[BlockRange]:
        """Ranges of a file's entries; the driver reads headers only."""
        parts: list[BlockRange] = []
        for path in list_files(self.path):
            with open_input(path) as f:
                n = read_head(f, path)[2]
            parts += [BlockRange(path, at, min(n, at + SPLIT_BLOCKS)) for at in range(0, n, SPLIT_BLOCKS)]
        return parts

    def _wanted(self, seed: np.ndarray) -> np.ndarray:
        keep = np.ones(len(seed), dtype=bool)
        seed = seed.astype(np.int64)
        for kind, value in self.tests:
            keep &= (
                seed == value if kind == "==" else np.isin(seed, value) if kind == "in" else seed > value if kind == ">" else seed >= value if kind == ">=" else seed < value if kind == "<" else seed <= value
            )
        return keep

    def _entries(self, f, part: BlockRange, offset: int) -> tuple[np.ndarray, np.ndarray]:
        """The range's entries that are wanted, the last of each id, and their places in the file."""
        own = read_entries(f, part.path, offset, part.first, part.last)
        keep = np.ones(len(own), dtype=bool)
        if not self.toc:
            keep[:] = False
            keep[list({int(s): k for k, s in enumerate(own["seed"])}.values())] = True
        at = np.flatnonzero(keep & self._wanted(own["seed"]))
        return own[at], at + part.first

    def read(self, partition: BlockRange) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, BlockRange):  # no file
            return
        with open_input(partition.path) as f:
            epoch, dt, _, toc = read_head(f, partition.path)
            entries, places = self._entries(f, partition, toc)
            if self.toc:
                yield pa.record_batch([pa.array([partition.path] * len(entries), pa.string()), pa.array(places), pa.array(entries["seed"].astype(np.int64))], names=["file", "place", "seed_id"])
                return
            for entry, place in zip(entries, places.tolist(), strict=True):
                f.seek(int(entry["offset"]))
                raw = zlib.decompress(f.read(int(entry["size"])))
                if len(raw) != entry["raw"]:
                    raise ValueError("a block has another size than its entry says")
                seed_id, start, stride, lon, lat = decode_block(raw)
                idx = start + np.arange(len(lon), dtype=np.int64) * stride
                columns = [pa.array(np.full(len(lon), seed_id, dtype=np.int64)), pa.array(idx), pa.array(epoch + idx * dt), pa.array(lon), pa.array(lat)]
                names = ["seed_id", "idx", "t_s", "lon", "lat"]
                if self.places:
                    columns += [pa.array([partition.path] * len(lon)), pa.array(np.full(len(lon), place, dtype=np.int64))]
                    names += ["file", "place"]
                yield pa.record_batch(columns, names=names)


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Samples of all files; where a file has several blocks of an id, those of the last one, however far apart they lie.

    Repeated ids come from an aggregation of the entries, which tasks read in slices; usually there are none, and the anti join is with
    an empty table.
    """
    register(spark)
    read = lambda option: spark.read.format("pkd2").option(option, "true").load(path)
    again = read("toc").groupBy("file", "seed_id").agg(F.max("place").alias("last"), F.count("*").alias("n")).where("n > 1").select("file", "seed_id", "last")
    samples = read("places")
    same = (samples["file"] == again["file"]) & (samples["seed_id"] == again["seed_id"]) & (samples["place"] < again["last"])
    return samples.join(again, same, "left_anti").drop("file", "place")


class TrajectorySource(DataSource):
    """``format("pkd2")``: samples of packed trajectories; longitudes as stored, unwrapped."""

    @classmethod
    def name(cls) -> str:
        return "pkd2"

    def schema(self) -> str:
        if self.options.get("toc") == "true":
            return "file string, place bigint, seed_id bigint"
        return SAMPLE_SCHEMA + (", file string, place bigint" if self.options.get("places") == "true" else "")

    def reader(self, schema) -> TrajectoryReader:
        return TrajectoryReader(self.options)

    def writer(self, schema, overwrite: bool) -> TrajectoryWriter:
        return TrajectoryWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PackedSource, TrajectorySource):
        spark.dataSource.register(source)
