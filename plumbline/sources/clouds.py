"""Point clouds in PLY and PCD files of any size, read by ranges of a file and written in parts.

``spark.read.format("plumbline_cloud").load(path)`` reads each header once, then plans ranges of whole vertices (of bytes for text, where a
line belongs to the range it begins in), so a file of many gigabytes is read by many tasks. Only LZF-compressed PCD is read by one task a file, as
its stream cannot be entered midway. Writing to a folder makes raw parts first and the header that names them last: without it the folder is no cloud, so a
failed or repeated task leaves nothing half-read; the header followed by its parts in order is a PLY file. Files are opened through ``pyarrow.fs``
(local paths, or URIs of the stores it knows); stores that only Spark can open go through ``scans.read_ply``.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from plumbline.sources import scans

VALUES = ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz")
RAW = "path string, range int, first long, place long, total long, " + ", ".join(f"{c} double" for c in VALUES)
#: Bytes of a file that a task reads, and rows of a batch.
RANGE, BATCH = 64 << 20, 1 << 16

#: Names of fields in files.
_NAMES = {"red": "r", "green": "g", "blue": "b", "diffuse_red": "r", "diffuse_green": "g", "diffuse_blue": "b", "normal_x": "nx", "normal_y": "ny", "normal_z": "nz"}
_PCD = {("I", 1): "i1", ("I", 2): "i2", ("I", 4): "i4", ("I", 8): "i8", ("U", 1): "u1", ("U", 2): "u2", ("U", 4): "u4", ("U", 8): "u8", ("F", 4): "f4", ("F", 8): "f8"}


@dataclass
class Header:
    """What a file's header says: encoding (ascii, binary or lzf), fields with numpy types, vertices, and where they begin."""

    encoding: str
    fields: list[tuple[str, str]]
    count: int
    start: int
    parts: list[tuple[str, int]] = field(default_factory=list)

    @property
    def row(self) -> np.dtype:
        return np.dtype([(f"{i}:{n}", t) for i, (n, t) in enumerate(self.fields)])


def ply_header(text: bytes) -> Header:
    """Header of a PLY file from its first bytes."""
    end = text.index(b"\n", text.index(b"end_header")) + 1
    form, count, fields, parts, now = "ascii", 0, [], [], ""
    for line in text[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:2] == ["comment", "part"] and len(w) == 4:
            parts.append((w[2], int(w[3])))
        elif w[:1] == ["element"]:
            if now == "" and w[1] != "vertex":
                raise ValueError("vertices must be the first element")
            now = w[1]
            count = int(w[2]) if now == "vertex" else count
        elif w[:1] == ["property"] and now == "vertex":
            fields.append((w[-1], ("" if form == "ascii" else "<" if "little" in form else ">") + scans._TYPES[w[1]]))
    return Header("ascii" if form == "ascii" else "binary", fields, count, end, parts)


def pcd_header(text: bytes) -> Header:
    """Header of a PCD file from its first bytes."""
    found = re.search(rb"(?m)^DATA\s+(\w+)[^\n]*\n", text)
    if not found:
        raise ValueError("no DATA line in the header of a PCD file")
    said = {w[0].upper(): w[1:] for line in text[: found.end()].decode("ascii", "replace").splitlines() if (w := line.split()) and not w[0].startswith("#")}
    counts = [int(c) for c in said.get("COUNT", ["1"] * len(said["FIELDS"]))]
    fields = []
    for name, size, kind, n in zip(said["FIELDS"], said["SIZE"], said["TYPE"], counts, strict=True):
        fields += [(name if i == 0 else f"{name}_{i}", "<" + _PCD[kind, int(size)]) for i in range(n)]
    count = int(said["POINTS"][0]) if "POINTS" in said else int(said["WIDTH"][0]) * int(said["HEIGHT"][0])
    return Header({"ascii": "ascii", "binary": "binary", "binary_compressed": "lzf"}[said["DATA"][0].lower()], fields, count, found.end())


def lzf_decompress(data: bytes, size: int) -> bytes:
    """The bytes of an LZF stream."""
    out, i = bytearray(), 0
    while i < len(data):
        control = data[i]
        i += 1
        if control < 32:
            out += data[i : i + control + 1]
            i += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += data[i]
            i += 1
        back = len(out) - ((control & 31) << 8) - data[i] - 1
        i += 1
        length += 2
        if back < 0:
            raise ValueError("an LZF stream points before its begin")
        while length > 0:
            piece = out[back : back + length]
            out += piece
            back, length = back + len(piece), length - len(piece)
    if len(out) != size:
        raise ValueError(f"an LZF stream holds {len(out)} bytes, not {size}")
    return bytes(out)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def header_of(where: fs.FileSystem, path: str) -> Header:
    with where.open_input_file(path) as f:
        text, end = b"", b"\nDATA" if path.lower().endswith(".pcd") else b"end_header"
        while True:
            more = f.read(1 << 16)
            text += more
            at = text.find(end)
            if not more or (at >= 0 and b"\n" in text[at + len(end) :]):
                return (pcd_header if path.lower().endswith(".pcd") else ply_header)(text)


def files_of(path: str) -> tuple[fs.FileSystem, list[str]]:
    """PLY and PCD files at or under a path, and headers of clouds written in parts."""
    where, root = opened(path)
    info = where.get_file_info(root)
    if info.type == fs.FileType.File:
        return where, [root]
    found = [f.path for f in where.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    return where, sorted(f for f in found if f.lower().endswith((".ply", ".pcd")))


@dataclass
class Range(InputPartition):
    """Bytes begin to end of a file; ``first`` is the number of its first vertex, unknown in text."""

    path: str
    file: str
    header: Header
    number: int
    begin: int
    end: int
    first: int | None


def ranges(path: str, size: int = RANGE) -> list[Range]:
    where, files = files_of(path)
    out = []
    for name in files:
        h = header_of(where, name)
        if h.encoding == "lzf":
            out.append(Range(path, name, h, 0, h.start, 0, 0))
            continue
        if h.encoding == "ascii":
            end = where.get_file_info(name).size
            out += [Range(path, name, h, i, a, min(a + size, end), None) for i, a in enumerate(range(h.start, end, size))]
            continue
        step = max(1, size // max(1, h.row.itemsize))
        pieces = [(f"{name.rpartition('/')[0]}/{p}", 0, n) for p, n in h.parts] or [(name, h.start, h.count)]
        first = 0
        for file, start, n in pieces:
            for a in range(0, n, step):
                b = min(n, a + step)
                out.append(Range(path, name, Header(h.encoding, h.fields, h.count, h.start, [(file, n)]), len(out), start + a * h.row.itemsize, start + b * h.row.itemsize, first + a))
            first += n
    return out


def _columns(h: Header, get) -> dict[str, np.ndarray]:
    """x to nz from fields; bytes become 0 to 1, a packed rgb is taken apart."""
    out = {}
    for i, (name, kind) in enumerate(h.fields):
        v, low = get(i), name.lower()
        if low in ("rgb", "rgba"):
            bits = (v.astype("<f4").view("<u4") if np.dtype(kind or "f4").kind == "f" else v.astype(np.uint32)).astype(np.int64)
            out |= {c: (bits >> s & 255) / 255 for c, s in (("r", 16), ("g", 8), ("b", 0))}
        elif (c := _NAMES.get(low, low)) in VALUES:
            out[c] = v.astype(float) / 255 if c in "rgb" and np.dtype(kind or "f8").itemsize == 1 else v.astype(float)
    return out


class CloudReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        h, where = partition.header, opened(partition.path)[0]
        names = [p.split()[0] for p in RAW.split(", ")]

        def batch(columns: dict[str, np.ndarray], place: int) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            values = [pa.array(columns[c], pa.float64()) if c in columns else pa.nulls(n, pa.float64()) for c in VALUES]
            first = pa.nulls(n, pa.int64()) if partition.first is None else pa.array(np.full(n, partition.first))
            head = [pa.array([partition.file] * n), pa.array(np.full(n, partition.number, np.int32)), first, pa.array(np.arange(place, place + n)), pa.array(np.full(n, h.count))]
            return pa.RecordBatch.from_arrays([*head, *values], names)

        if h.encoding == "binary":
            file = h.parts[0][0] if h.parts else partition.file
            with where.open_input_file(file) as f:
                f.seek(partition.begin)
                left, place = (partition.end - partition.begin) // h.row.itemsize, 0
                while left:
                    data = f.read(min(left, BATCH) * h.row.itemsize)
                    rows = np.frombuffer(data, h.row, len(data) // h.row.itemsize)
                    if not len(rows):
                        raise ValueError(f"{file} ends before its {h.count} vertices")
                    yield batch(_columns(h, lambda i: rows[rows.dtype.names[i]]), place)  # noqa: B023
                    place, left = place + len(rows), left - len(rows)
        elif h.encoding == "lzf":
            with where.open_input_file(partition.file) as f:
                f.seek(h.start)
                packed, size = np.frombuffer(f.read(8), "<u4").tolist()
                data = lzf_decompress(f.read(packed), size)
            at = np.cumsum([0] + [np.dtype(t).itemsize * h.count for _, t in h.fields])
            whole = [np.frombuffer(data, t, h.count, at[i]) for i, (_, t) in enumerate(h.fields)]
            for a in range(0, h.count, BATCH):
                yield batch(_columns(h, lambda i: whole[i][a : a + BATCH]), a)  # noqa: B023
        else:
            yield from self._text(partition, where, batch)

    def _text(self, partition: Range, where: fs.FileSystem, batch) -> Iterator[pa.RecordBatch]:
        h, place, rows = partition.header, 0, []
        plain = Header("ascii", [(n, t if n.lower() in ("rgb", "rgba") or t[-2:] in ("u1", "i1") else "f8") for n, t in h.fields], h.count, 0)

        def table() -> pa.RecordBatch:
            values = np.full((len(rows), len(h.fields)), np.nan)
            for i, words in enumerate(rows):
                for j, w in enumerate(words[: len(h.fields)]):
                    try:
                        values[i, j] = float(w)
                    except ValueError:
                        break
            return batch(_columns(plain, lambda i: values[:, i]), place)

        with where.open_input_file(partition.file) as f:
            begin = partition.begin
            if begin > h.start:  # a line that begins before belongs to the range before
                f.seek(begin - 1)
                while (piece := f.read(1 << 12)) and b"\n" not in piece:
                    begin += len(piece)
                begin += piece.index(b"\n") if piece else 0
            f.seek(begin)
            lines = io.BufferedReader(f, 1 << 20) if not isinstance(f, io.BufferedReader) else f
            at = begin
            while at < partition.end and (line := lines.readline()):
                at += len(line)
                rows.append(line.split())
                if len(rows) == BATCH:
                    yield table()
                    place, rows[:] = place + len(rows), []
            if rows:
                yield table()


@dataclass
class Written(WriterCommitMessage):
    task: int
    name: str
    count: int


class CloudWriter(DataSourceArrowWriter):
    """Raw little-endian vertices: doubles x, y, z and bytes red, green, blue."""

    FIELDS = [("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("red", "u1"), ("green", "u1"), ("blue", "u1")]

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = opened(self.path)
        where.create_dir(root)
        task = TaskContext.get().partitionId()
        name, count = f"part-{task:05}-{uuid.uuid4().hex}.bin", 0
        with where.open_output_stream(f"{root}/{name}") as f:
            for b in iterator:
                table = np.empty(len(b), np.dtype(self.FIELDS))
                for n, t in self.FIELDS:
                    c = n[0] if t == "u1" else n
                    at = b.schema.get_field_index(c)
                    v = b.column(at).cast(pa.float64()).to_numpy(zero_copy_only=False) if at >= 0 else np.full(len(b), 0.7)
                    table[n] = np.rint(np.clip(np.where(np.isnan(v), 0.7, v), 0, 1) * 255) if t == "u1" else v
                f.write(table.tobytes())
                count += len(b)
        return Written(task, name, count)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = opened(self.path)
        done = sorted((m for m in messages if m), key=lambda m: m.task)
        before = [f.path for f in where.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name not in {m.name for m in done}]
        if before and not self.overwrite:
            raise ValueError(f"{self.path} holds a cloud")
        head = ["ply", "format binary_little_endian 1.0", *[f"comment part {m.name} {m.count}" for m in done], f"element vertex {sum(m.count for m in done)}"]
        head += [f"property {'double' if t == '<f8' else 'uchar'} {n}" for n, t in self.FIELDS] + ["end_header", ""]
        with where.open_output_stream(f"{root}/header.tmp") as f:
            f.write("\n".join(head).encode())
        where.move(f"{root}/header.tmp", f"{root}/header.ply")
        for f in before:  # parts of the cloud before, which the new header does not name
            if not f.endswith("/header.ply"):
                where.delete_file(f)

    def abort(self, messages: list[Written | None]) -> None:
        where, root = opened(self.path)
        for m in messages:
            if m:
                where.delete_file(f"{root}/{m.name}")


class CloudSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plumbline_cloud"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> CloudReader:
        return CloudReader(self.options["path"], int(self.options.get("rangeBytes", RANGE)))

    def writer(self, schema, overwrite: bool) -> CloudWriter:
        return CloudWriter(self.options["path"], overwrite)


def read_cloud(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """``scans.CLOUD`` of all PLY and PCD files at or under a path; point_id is the vertex's place in its file. Lines of text are counted by range
    first, as their place follows from the ranges before."""
    spark.dataSource.register(CloudSource)
    rows = spark.read.format("plumbline_cloud").option("rangeBytes", range_bytes).load(path)
    where, files = files_of(path)
    if any(header_of(where, f).encoding == "ascii" for f in files):
        sizes = rows.where("first is null").groupBy("path", "range").agg(F.count("*").alias("n")).collect()  # one row a range
        starts, total = [], {}
        for r in sorted(sizes, key=lambda r: (r["path"], r["range"])):
            starts.append((r["path"], r["range"], total.get(r["path"], 0)))
            total[r["path"]] = total.get(r["path"], 0) + r["n"]
        rows = rows.join(spark.createDataFrame(starts, "path string, range int, _start long"), ["path", "range"], "left")
        rows = rows.withColumn("first", F.coalesce("first", "_start"))
    placed = rows.withColumn("point_id", F.col("first") + F.col("place")).where(F.col("point_id") < F.col("total"))
    return placed.select("path", "point_id", *VALUES)


def write_cloud(points: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """x, y, z and, where present, r, g, b as a PLY in parts, in the rows' order."""
    points.sparkSession.dataSource.register(CloudSource)
    columns = [c for c in ("x", "y", "z", "r", "g", "b") if c in points.columns]
    points.select(*[F.col(c).cast("double").alias(c) for c in columns]).write.format("plumbline_cloud").mode("overwrite" if overwrite else "append").save(path)
