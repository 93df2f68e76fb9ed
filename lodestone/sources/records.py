"""Files of records as Spark data sources: read by byte ranges, written by all tasks at their places.

Reading: the driver looks at the lengths and heads of files, tasks read ranges of
whole records, of about so many bytes each. Writing: rows of a position and bytes
go from the tasks straight into a draft, which commit renames and abort removes;
a task that runs twice writes the same bytes to the same place. On file systems
without writing at a place the draft is a folder of pieces named by their
position, and readers take such a folder as one file.

Files are opened by Python in driver and tasks: local or mounted ones, and what
pyarrow.fs knows by its scheme.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

ELEMENTS = {"float": np.float32, "uint8": np.uint8, "int8": np.int8, "int": np.int32}
SECTOR = 4096
SCHEMAS = {
    "vecs": "id bigint, vec array<double>", "bin": "id bigint, vec array<double>", "truth": "id bigint, vec array<double>, dists array<double>",
    "graph": "id bigint, vec array<double>, nbrs array<bigint>", "sectors": "id bigint, vec array<double>, nbrs array<bigint>", "codes": "id bigint, chunk int, code int",
}
_FLOATS, _INTS = pa.list_(pa.float64()), pa.list_(pa.int64())


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), os.path.abspath(path))


def opens(path: str) -> bool:
    """Whether Python can open files under path."""
    try:
        filesystem(path)
        return True
    except (pa.ArrowException, ValueError, OSError):
        return False


@dataclass
class File:
    """A file of records: its pieces as (path, position of its first byte), length, and what its head says."""

    pieces: list[tuple[str, int]]
    length: int
    n: int = 0
    dim: int = 0
    per: int = 0  # of sectors: nodes in each
    width: int = 0  # bytes of a node
    layout: str = ""

    def read(self, at: int, size: int) -> bytes:
        """size bytes from position at, of one or several pieces."""
        out = []
        for (path, begin), end in zip(self.pieces, [*(p[1] for p in self.pieces[1:]), self.length]):
            a, z = max(at, begin), min(at + size, end)
            if a < z:
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    f.seek(a - begin)
                    out.append(f.read(z - a))
        return b"".join(out)


def _files(fs: pyarrow.fs.FileSystem, name: str, scheme: str) -> list[File]:
    info = fs.get_file_info(name)
    if info.type == pyarrow.fs.FileType.File:
        return [File([(scheme + name, 0)], info.size)]
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(name)
    inside = sorted((x for x in fs.get_file_info(pyarrow.fs.FileSelector(name)) if x.base_name[0] not in "._"), key=lambda x: x.path)
    if inside and all(len(x.base_name) == 20 and x.base_name.isdigit() for x in inside):
        return [File([(scheme + x.path, int(x.base_name)) for x in inside], int(inside[-1].base_name) + inside[-1].size)]
    return [File([(scheme + x.path, 0)], x.size) for x in inside if x.type == pyarrow.fs.FileType.File]


def plan(path: str, layout: str, element: str = "float", dim: int = 0, r: int = 0) -> list[File]:
    """The files under path with their records counted; ValueError where a length or head does not fit the layout."""
    fs, name = filesystem(path)
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    kind = np.dtype(ELEMENTS[element]).itemsize
    out = []
    for f in _files(fs, name, scheme):
        f.layout = layout
        label = f.pieces[0][0]
        if layout in ("vecs", "auto"):
            f.dim = struct.unpack("<i", f.read(0, 4))[0] if f.length >= 4 else 0
            f.width = 4 + f.dim * kind
            fits = f.dim > 0 and f.length % f.width == 0
            if layout == "auto":
                f.layout = "vecs" if fits or not f.length else "bin"
            elif f.length and not fits:
                raise ValueError(f"{f.length} bytes of {label} are no whole number of records of dimension {f.dim}")
            f.n = f.length // f.width if f.length else 0
        if f.layout in ("bin", "truth", "codes"):
            f.n, f.dim = struct.unpack("<ii", f.read(0, 8)) if f.length >= 8 else (0, 0)
            width = {"truth": 8, "codes": 1}.get(f.layout, kind)
            if f.length and f.length != 8 + f.n * f.dim * width:
                raise ValueError(f"{f.length} bytes of {label} do not hold {f.n} x {f.dim} elements")
        if f.layout == "graph":
            f.dim, f.width = dim, dim * kind + 4 + 4 * r
            if f.length % f.width:
                raise ValueError(f"{f.length} bytes of {label} are no whole number of records of {f.width}")
            f.n = f.length // f.width
        if f.layout == "sectors":
            head = f.read(0, 80)
            f.n, f.dim, _, f.width, f.per = struct.unpack_from("<5Q", head, 8) if len(head) == 80 else (0, 0, 0, 0, 0)
            if len(head) < 80 or struct.unpack_from("<Q", head, 72)[0] != f.length or f.width < f.dim * kind + 4 + 4 * r or not f.per or f.length < (1 + -(-f.n // f.per)) * SECTOR:
                raise ValueError(f"the first sector of {label} does not fit the file")
        out.append(f)
    return out


@dataclass
class Range(InputPartition):
    """Records first to first + count of a file."""

    file: File
    first: int
    count: int


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = json.loads(options["spec"])
        self.files = [File(**f) for f in self.o.pop("files")]

    def partitions(self) -> list[Range]:
        out = []
        for f in self.files:
            n = f.n if self.o["limit"] is None else min(f.n, self.o["limit"])
            step = max(1, self.o["bytes"] * f.n // max(f.length, 1))
            step = max(f.per, step // f.per * f.per) if f.per else step
            out += [Range(f, a, min(step, n - a)) for a in range(0, n, step)]
        return out or [Range(File([], 0), 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        f, o = part.file, self.o
        kind = np.dtype(ELEMENTS[o["element"]])
        most = max(1, (4 << 20) // max(f.dim * kind.itemsize, 1))
        most = max(f.per, most // f.per * f.per) if f.per else most
        for a in range(part.first, part.first + part.count, most):
            yield _decoded(f, a, min(most, part.first + part.count - a), kind, o["multiple"], o["r"])


def _decoded(f: File, a: int, n: int, kind: np.dtype, multiple: int, r: int) -> pa.RecordBatch:
    ids = np.arange(a, a + n)
    if f.layout == "codes":
        c = np.frombuffer(f.read(8 + a * f.dim, n * f.dim), np.uint8)
        return pa.RecordBatch.from_pydict({"id": np.repeat(ids, f.dim), "chunk": np.tile(np.arange(f.dim, dtype=np.int32), n), "code": c.astype(np.int32)})
    if f.layout in ("graph", "sectors"):
        vec, nbrs = _nodes(f, a, n, kind, r)
        return pa.RecordBatch.from_arrays([pa.array(ids), _lists(vec), pa.array(nbrs, _INTS)], names=["id", "vec", "nbrs"])
    size = f.dim * kind.itemsize
    if f.layout == "vecs":
        m = np.frombuffer(f.read(a * f.width, n * f.width), np.uint8).reshape(n, f.width)
        if (m[:, :4].copy().view("<i4") != f.dim).any():
            raise ValueError("the dimension changes within the file")
        vec = m[:, 4:].copy().view(kind.newbyteorder("<"))
    elif f.layout == "bin":
        vec = np.frombuffer(f.read(8 + a * size, n * size), kind.newbyteorder("<")).reshape(n, f.dim)
    else:
        vec = np.frombuffer(f.read(8 + a * f.dim * 4, n * f.dim * 4), "<i4").reshape(n, f.dim)
    vec = vec.astype(np.float64)
    columns = {"id": pa.array(ids), "vec": _lists(np.pad(vec, ((0, 0), (0, -f.dim % multiple))) if multiple > 1 else vec)}
    if f.layout == "truth":
        columns["dists"] = _lists(np.frombuffer(f.read(8 + (f.n + a) * f.dim * 4, n * f.dim * 4), "<f4").reshape(n, f.dim).astype(np.float64))
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _nodes(f: File, a: int, n: int, kind: np.dtype, r: int) -> tuple[np.ndarray, list[np.ndarray]]:
    width = f.dim * kind.itemsize
    if f.layout == "graph":
        m = np.frombuffer(f.read(a * f.width, n * f.width), np.uint8).reshape(n, f.width)
    else:
        raw = np.frombuffer(f.read((1 + a // f.per) * SECTOR, -(-n // f.per) * SECTOR), np.uint8)
        i = np.arange(n)
        m = raw[(i // f.per * SECTOR + i % f.per * f.width)[:, None] + np.arange(width + 4 + 4 * r)]
    links = m[:, width:].copy().view("<u4").astype(np.int64)
    least = 1 if f.layout == "sectors" else 0
    if ((links[:, 0] < least) | (links[:, 0] > r)).any():
        raise ValueError(f"a degree is under {least} or over the bound")
    nbrs = [x[1 : 1 + x[0]] for x in links]
    nbrs = [np.sort(x) for x in nbrs] if f.layout == "sectors" else [x[x != 0xFFFFFFFF] for x in nbrs]
    return m[:, :width].copy().view(kind.newbyteorder("<")).astype(np.float64), nbrs


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32) if m.shape[1] else np.zeros(len(m) + 1, np.int32), pa.array(m.ravel(), pa.float64()))


class Records(DataSource):
    """Option spec: files as plan gives them, layout, element, multiple, limit, r, and bytes of a task's range."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_records"

    def schema(self) -> str:
        return SCHEMAS[json.loads(self.options["spec"])["layout"]]

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


def read(spark: SparkSession, files: list[File], layout: str, element: str = "float", multiple: int = 1, limit: int | None = None, r: int = 0, size: int = 64 << 20) -> DataFrame:
    """Records of planned files, as SCHEMAS says for the layout; ids count from 0 within each file."""
    spark.dataSource.register(Records)
    spec = {"files": [asdict(f) for f in files], "layout": layout if layout != "auto" else "bin", "element": element, "multiple": multiple, "limit": limit, "r": r, "bytes": size}
    return spark.read.format("lodestone_records").option("spec", json.dumps(spec)).load()


# ---- writing


@dataclass
class Written(WriterCommitMessage):
    pieces: list[tuple[int, str]]


class PlaceWriter(DataSourceArrowWriter):
    """Rows (pos, raw), by task in order of pos: bytes go to their position."""

    def __init__(self, options: dict[str, str]):
        self.path, self.draft, self.length, self.pieces = options["path"], options["draft"], int(options["length"]), options["pieces"] == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: list[tuple[int, str]] = []
        fs, name = filesystem(self.draft)
        out, at = None, -1
        try:
            for batch in iterator:
                for pos, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if self.pieces:
                        if pos != at:
                            if out is not None:
                                out.close()
                            done.append((pos, f"{name}/{pos:020d}-{uuid.uuid4().hex}"))
                            out = fs.open_output_stream(done[-1][1])
                        out.write(raw)
                    else:
                        out = out or os.fdopen(os.open(name, os.O_WRONLY), "wb", buffering=1 << 20)
                        if pos != at:
                            out.seek(pos)
                        out.write(raw)
                    at = pos + len(raw)
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, name = filesystem(self.draft)
        _, end = filesystem(self.path)
        if not self.pieces:
            os.replace(name, end)
            return
        if fs.get_file_info(end).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(end)
        fs.create_dir(end, recursive=True)
        for pos, piece in sorted(p for m in messages if m is not None for p in m.pieces):
            fs.move(piece, f"{end}/{pos:020d}")
        fs.delete_dir(name)

    def abort(self, messages: list[Written | None]) -> None:
        fs, name = filesystem(self.draft)
        if fs.get_file_info(name).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(name) if self.pieces else fs.delete_file(name)


class Places(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestone_places"

    def schema(self) -> str:
        return "pos bigint, raw binary"

    def writer(self, schema, overwrite: bool) -> PlaceWriter:
        return PlaceWriter(self.options)


def write_places(rows: DataFrame, path: str, length: int, head: bytes = b"", pieces: bool | None = None) -> None:
    """Write rows (pos, raw) to the file path of so many bytes, head at its beginning, from all tasks; it is there whole or not at all.

    A folder of pieces takes the place of a folder that is there when it is whole.
    Positions without bytes are zeros, which a folder of pieces cannot have.
    """
    spark = rows.sparkSession
    spark.dataSource.register(Places)
    fs, name = filesystem(path)
    pieces = not isinstance(fs, pyarrow.fs.LocalFileSystem) if pieces is None else pieces
    parent, base = os.path.split(name)
    draft = f"{parent}/_{base}-{uuid.uuid4().hex}"
    if pieces:
        fs.create_dir(draft)
    else:
        fs.create_dir(parent, recursive=True)
        with open(draft, "wb") as f:
            f.truncate(length)
            f.write(head)
    if pieces and head:
        rows = spark.createDataFrame([(0, head)], "pos bigint, raw binary").unionByName(rows)
    prefix = path[: -len(name)] if path.endswith(name) and "://" in path else ""
    sorted_ = rows.repartitionByRange("pos").sortWithinPartitions("pos")
    options = {"path": path, "draft": prefix + draft, "length": str(length), "pieces": str(pieces).lower()}
    try:
        sorted_.write.format("lodestone_places").mode("append").options(**options).save()
    except Exception:
        PlaceWriter(options).abort([])  # also where the write did not begin
        raise
