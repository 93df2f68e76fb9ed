"""Readers and writers: vector files, packed graphs, event logs."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.snapshot import numbered
from lodestone.sources import records
from lodestone.sources.records import ELEMENTS, SECTOR


def decode(raw: bytes, layout: str, element: str = "float") -> np.ndarray:
    """Rows of a vector file.

    layout 'vecs': records of an int32 dimension and its elements (.fvecs,
    .ivecs, .bvecs); a file of another length or of changing dimension is
    refused. layout 'bin': int32 rows and dimension, then the elements. layout
    'truth': the same with int32 ids, then as many float distances. 'auto' takes
    'vecs' where the length fits and 'bin' else.
    """
    kind = np.dtype(ELEMENTS[element])
    if not raw:
        return np.zeros((0, 0), kind)
    if layout == "auto":
        dim = struct.unpack_from("<i", raw)[0]
        layout = "vecs" if dim > 0 and len(raw) % (4 + dim * kind.itemsize) == 0 else "bin"
    if layout == "vecs":
        dim = struct.unpack_from("<i", raw)[0]
        size = 4 + dim * kind.itemsize
        if dim <= 0 or len(raw) % size:
            raise ValueError(f"{len(raw)} bytes are no whole number of records of dimension {dim}")
        rows = np.frombuffer(raw, np.uint8).reshape(-1, size)
        if (rows[:, :4].copy().view("<i4")[:, 0] != dim).any():
            raise ValueError("the dimension changes within the file")
        return rows[:, 4:].copy().view(kind.newbyteorder("<")).astype(kind)
    n, dim = struct.unpack_from("<ii", raw)
    width = 8 if layout == "truth" else kind.itemsize
    if len(raw) != 8 + n * dim * width:
        raise ValueError(f"{len(raw)} bytes do not hold {n} x {dim} elements")
    return np.frombuffer(raw, kind if layout != "truth" else np.int32, n * dim, 8).reshape(n, dim)


def encode(rows: np.ndarray, layout: str, element: str = "float") -> bytes:
    """The inverse of decode, for 'vecs' and 'bin'."""
    rows = np.ascontiguousarray(rows, ELEMENTS[element])
    n, dim = rows.shape
    if layout == "bin":
        return struct.pack("<ii", n, dim) + rows.tobytes()
    head = np.full((n, 1), dim, "<i4").view(np.uint8)
    return np.hstack([head, rows.view(np.uint8).reshape(n, -1)]).tobytes()


WHOLE = 64 << 20  # bytes that a task reads of a file

_VECTORS = pa.schema([("id", pa.int64()), ("vec", pa.list_(pa.float64())), ("dists", pa.list_(pa.float64()))])


def read_vectors(spark: SparkSession, path: str, layout: str = "vecs", element: str = "float", multiple: int = 1, limit: int | None = None) -> DataFrame:
    """id, vec (and dists for 'truth') of one file or several; ids count from 0 within each file.

    multiple pads vectors with zeros to a multiple of it; limit reads the first
    rows only. Files of every layout are read by as many tasks as they have WHOLE
    bytes; those that only Spark can open are read whole by a task each.
    """
    if records.opens(path):
        return records.read(spark, records.plan(path, layout, element), layout, element, multiple, limit, size=WHOLE)
    padded = lambda m: np.pad(m, ((0, 0), (0, -m.shape[1] % multiple)))

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                m = padded(decode(raw, layout, element)[:limit].astype(np.float64))
                dists = None
                if layout == "truth":
                    dists = np.frombuffer(raw, np.float32, m.size, 8 + m.size * 4).reshape(m.shape).astype(np.float64)
                for a in range(0, len(m), 10_000):
                    part = m[a : a + 10_000]
                    yield pa.RecordBatch.from_pydict({"id": np.arange(a, a + len(part)), "vec": list(part), "dists": list(dists[a : a + len(part)]) if dists is not None else [None] * len(part)}, _VECTORS)

    df = spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "id bigint, vec array<double>, dists array<double>")
    return df if layout == "truth" else df.drop("dists")


def read_truth(spark: SparkSession, path: str, layout: str = "auto") -> DataFrame:
    """qid, rk, id (and dist) of a ground-truth file: ids as .ivecs or .bin, or ids and distances."""
    df = read_vectors(spark, path, layout, "int")
    if layout == "truth":
        zipped = F.posexplode(F.arrays_zip(F.col("vec").alias("id"), F.col("dists").alias("dist")))
        return df.select(F.col("id").alias("qid"), zipped.alias("rk", "x")).select("qid", (F.col("rk") + 1).alias("rk"), F.col("x.id").cast("bigint").alias("id"), "x.dist")
    return df.select(F.col("id").alias("qid"), F.posexplode("vec").alias("rk", "id")).select("qid", (F.col("rk") + 1).alias("rk"), F.col("id").cast("bigint").alias("id"))


def read_graph(spark: SparkSession, path: str, dim: int, r: int, element: str = "float") -> DataFrame:
    """id, vec, nbrs of a packed graph: records of dim elements, a uint32 degree and r uint32 partners.

    Padding of 0xFFFFFFFF counts as no partner; a degree over r is refused.
    """
    return records.read(spark, records.plan(path, "graph", element, dim, r), "graph", element, r=r, size=WHOLE)


def _read_whole(spark: SparkSession, path: str, ddl: str, rows) -> DataFrame:
    """Rows that rows(raw) makes of each file under path, as dictionaries of columns."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                for columns in rows(raw):
                    yield pa.RecordBatch.from_pydict(columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ddl)


def pivot_sections(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots (codes x dim), centroid and chunk bounds of a pivots file.

    The file: uint32 4 and 1, then four uint64 places, of the three sections and
    of the end. A section: int32 rows and columns, then its elements; floats for
    pivots and centroid, uint32 for bounds.
    """
    if len(raw) < 40 or struct.unpack_from("<I", raw)[0] != 4:
        raise ValueError("a pivots file has three sections")
    places = struct.unpack_from("<4Q", raw, 8)
    out = []
    for at, kind in zip(places, ("<f4", "<f4", "<u4")):
        n, m = struct.unpack_from("<ii", raw, at)
        if at + 8 + 4 * n * m > len(raw):
            raise ValueError("a section of the pivots file is cut off")
        out.append(np.frombuffer(raw, kind, n * m, at + 8).reshape(n, m))
    pivots, centroid, bounds = out[0], out[1].ravel(), out[2].ravel().astype(np.int64)
    if len(centroid) != pivots.shape[1] or bounds[0] != 0 or bounds[-1] != len(centroid) or (np.diff(bounds) <= 0).any():
        raise ValueError("centroid and chunk bounds do not fit the pivots")
    return pivots, centroid, bounds


def read_pq(spark: SparkSession, pivots: str, codes: str) -> dict[str, DataFrame]:
    """Tables of a product quantiser's files: pivots (chunk, code, sub), with the centroid added, centroid (pos, x), chunks (chunk, lo, hi), codes (id, chunk, code).

    A codes file: int32 rows and chunks, then a byte for each.
    """

    def subs(raw: bytes):
        p, c, bounds = pivot_sections(raw)
        moved = p.astype(np.float64) + c.astype(np.float64)
        for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            yield {"chunk": np.full(len(p), k, np.int32), "code": np.arange(len(p), dtype=np.int32), "sub": [x.tolist() for x in moved[:, lo:hi]]}

    def centers(raw: bytes):
        c = pivot_sections(raw)[1]
        yield {"pos": np.arange(len(c), dtype=np.int32), "x": c.astype(np.float64)}

    def bounds(raw: bytes):
        b = pivot_sections(raw)[2].astype(np.int32)
        yield {"chunk": np.arange(len(b) - 1, dtype=np.int32), "lo": b[:-1], "hi": b[1:]}

    return {
        "pivots": _read_whole(spark, pivots, "chunk int, code int, sub array<double>", subs),
        "centroid": _read_whole(spark, pivots, "pos int, x double", centers),
        "chunks": _read_whole(spark, pivots, "chunk int, lo int, hi int", bounds),
        "codes": records.read(spark, records.plan(codes, "codes"), "codes", size=WHOLE),
    }


def read_sectors(spark: SparkSession, path: str, r: int, element: str = "float") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, vec, nbrs in order of number) and a row of metadata (n, dim, medoid, node_bytes, per_sector, file_bytes) of each disk index.

    The first sector of SECTOR bytes: two uint32, then as uint64 rows, dimension,
    medoid, bytes of a node, nodes of a sector, three others, bytes of the file.
    Further sectors: whole nodes of vector, uint32 degree, r uint32 partners. A
    degree of 0 or over r is refused.
    """
    files = records.plan(path, "sectors", element, r=r)
    meta = [(*struct.unpack_from("<5Q", f.read(0, 80), 8), f.length) for f in files]  # a row for each file
    names = "n bigint, dim bigint, medoid bigint, node_bytes bigint, per_sector bigint, file_bytes bigint"
    return records.read(spark, files, "sectors", element, r=r, size=WHOLE), spark.createDataFrame(meta, names)


def read_static(spark: SparkSession, vectors: str, graph: str, layout: str = "vecs", limit: int | None = None) -> DataFrame:
    """id, vec, nbrs of a vector file and a graph file of int rows of partners, -1 and 0xFFFFFFFF being none."""
    points = read_vectors(spark, vectors, layout, limit=limit)
    rows = read_vectors(spark, graph, "auto", "int").select("id", F.transform(F.filter("vec", lambda x: x >= 0), lambda x: x.cast("bigint")).alias("nbrs"))
    return points.join(rows, "id", "left").select("id", "vec", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))


def _placed(rows: DataFrame, encoder, position) -> DataFrame:
    """pos, raw: what encoder makes of each row, at the position that position gives for its place, numbers from 0 in order of id."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                part = batch.to_pylist()
                yield pa.RecordBatch.from_pydict({"pos": pa.array([position(x["place"] - 1) for x in part], pa.int64()), "raw": pa.array([encoder(x) for x in part], pa.binary())})

    return numbered(rows, "id", column="place").mapInArrow(run, "pos bigint, raw binary")


def write_graph(nodes: DataFrame, path: str, r: int, element: str = "float") -> int:
    """Export nodes (id, vec, nbrs) in order of id as the packed records of read_graph to one file, from all tasks; returns how many."""
    over = nodes.where(F.size("nbrs") > r).select("id").first()
    if over:
        raise ValueError(f"node {over['id']} has over {r} partners")
    n, dim = nodes.agg(F.count("*"), F.max(F.size("vec"))).first()
    size = (dim or 0) * np.dtype(ELEMENTS[element]).itemsize + 4 + 4 * r
    encoder = lambda x: np.asarray(x["vec"], ELEMENTS[element]).tobytes() + _links(x["nbrs"], r, 0xFFFFFFFF)
    records.write_places(_placed(nodes.select("id", "vec", "nbrs"), encoder, lambda i: i * size), path, n * size)
    return n


def _links(nbrs: list[int], r: int, none: int) -> bytes:
    return np.array([len(nbrs), *nbrs, *[none] * (r - len(nbrs))], "<u4").tobytes()


def write_sectors(nodes: DataFrame, path: str, r: int, medoid: int, element: str = "float") -> int:
    """Export nodes (id, vec, nbrs), of ids from 0 without gaps, as the disk index of read_sectors; returns how many."""
    shape = nodes.agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(F.size("vec")).alias("dim"), F.min(F.size("vec")).alias("least"), F.max(F.size("nbrs")).alias("most"), F.min(F.size("nbrs")).alias("few")).first()
    n, dim = shape["n"], shape["dim"]
    if not n or (shape["lo"], shape["hi"]) != (0, n - 1) or shape["least"] != dim or shape["most"] > r or shape["few"] < 1:
        raise ValueError(f"nodes are not numbered from 0, or not of one dimension and 1 to {r} partners")
    size = dim * np.dtype(ELEMENTS[element]).itemsize + 4 + 4 * r
    per = SECTOR // size
    if not per:
        raise ValueError("a node is larger than a sector")

    encoder = lambda x: np.asarray(x["vec"], ELEMENTS[element]).tobytes() + _links(x["nbrs"], r, 0)
    length = (1 + -(-n // per)) * SECTOR
    head = struct.pack("<II9Q", 0, 0, n, dim, medoid, size, per, 0, 0, 0, length)
    records.write_places(_placed(nodes.select("id", "vec", "nbrs"), encoder, lambda i: (1 + i // per) * SECTOR + i % per * size), path, length, head, pieces=False)
    return n


def write_pq(pivots: DataFrame, codes: DataFrame, pivots_path: str, codes_path: str) -> None:
    """Export pivots (chunk, code, sub), with a centroid of zeros, and codes (id, chunk, code) as the files of read_pq."""
    spark = codes.sparkSession
    parts: dict[int, dict[int, list[float]]] = {}
    for row in pivots.select("chunk", "code", "sub").collect():  # 256 codes of a chunk at most
        parts.setdefault(row["chunk"], {})[row["code"]] = row["sub"]
    n = {len(x) for x in parts.values()}
    if len(n) != 1 or sorted(parts) != list(range(len(parts))):
        raise ValueError("chunks are not numbered from 0 with as many pivots each")
    table = np.hstack([np.array([parts[c][k] for k in sorted(parts[c])]) for c in sorted(parts)]).astype("<f4")
    bounds = np.cumsum([0, *(len(parts[c][0]) for c in sorted(parts))]).astype("<u4")
    sections = [np.array(x.shape, "<i4").tobytes() + x.tobytes() for x in (table, np.zeros((table.shape[1], 1), "<f4"), bounds[:, None])]
    places = np.cumsum([40, *map(len, sections)]).astype("<u8")
    fs, name = records.filesystem(pivots_path)
    with fs.open_output_stream(name) as out:  # 256 pivots of each dimension at most
        out.write(struct.pack("<II", 4, 1) + places.tobytes() + b"".join(sections))
    rows = codes.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "code"))), lambda x: x["code"]).alias("c"))
    n, m = rows.count(), len(parts)
    records.write_places(_placed(rows, lambda x: np.array(x["c"], np.uint8).tobytes(), lambda i: 8 + i * m), codes_path, 8 + n * m, struct.pack("<ii", n, m))


def write_truth(found: DataFrame, path: str, k: int, distances: bool = True) -> int:
    """Export found (qid, rk, id, dist) as a ground-truth file of k ids a query, and distances behind all ids; returns how many queries there are. Short answers are refused."""
    lists = found.where(F.col("rk") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rk", "id", *(["dist"] if distances else [])))).alias("x"))
    short = lists.where(F.size("x") != k).select("qid", F.size("x").alias("n")).first()
    if short:
        raise ValueError(f"query {short['qid']} has {short['n']} answers, not {k}")
    n = lists.count()
    rows = lists.withColumnRenamed("qid", "id")
    parts = [_placed(rows, lambda x: np.array([y["id"] for y in x["x"]], "<i4").tobytes(), lambda i: 8 + 4 * k * i)]
    if distances:
        parts.append(_placed(rows, lambda x: np.array([y["dist"] for y in x["x"]], "<f4").tobytes(), lambda i: 8 + 4 * k * (n + i)))
    records.write_places(reduce(DataFrame.unionByName, parts), path, 8 + 4 * k * n * len(parts), struct.pack("<ii", n, k))
    return n


def write_metrics(rows: DataFrame, path: str) -> None:
    """Write rows of statistics as text, a line 'name: value' for each column and an empty line after each row; one line for each in Spark's text sink."""
    text = F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in rows.columns), F.lit(""))
    rows.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)  # statistics are few rows


def write_vectors(df: DataFrame, path: str, layout: str = "vecs", element: str = "float", column: str = "vec") -> int:
    """Export df's vectors, of one dimension, in order of id to one file, from all tasks; returns how many. Tables are for Spark, this is for other tools."""
    rows = df.select("id", F.col(column).alias("vec"))
    n, dim, least = rows.agg(F.count("*"), F.max(F.size("vec")), F.min(F.size("vec"))).first()
    if dim != least:
        raise ValueError(f"vectors have {least} to {dim} elements")
    kind, dim = np.dtype(ELEMENTS[element]), dim or 0
    size = dim * kind.itemsize
    lead, head = (struct.pack("<i", dim), b"") if layout == "vecs" else (b"", struct.pack("<ii", n, dim))
    encoder = lambda x: lead + np.asarray(x["vec"], kind).tobytes()
    records.write_places(_placed(rows, encoder, lambda i: len(head) + i * (size + len(lead))), path, len(head) + n * (size + len(lead)), head)
    return n


EVENT_SCHEMA = (
    "type string, scenario string, t bigint, timestamp double, id bigint, point_id bigint, query_id bigint, vec array<double>, vector array<double>, "
    "metadata struct<scenario: string, n_events: bigint>, _corrupt string"
)


def read_events(spark: SparkSession, path: str, max_events: int | None = None, stream: bool = False) -> DataFrame:
    """Raw lines of a JSON event log in either dialect; lines that do not parse have them in _corrupt."""
    reader = (spark.readStream if stream else spark.read).schema(EVENT_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    df = reader.json(path)
    return df.limit(max_events) if max_events is not None and not stream else df


def write_events(events: DataFrame, path: str, scenario: str | None = None) -> None:
    """Write an event log as JSON lines, led by a header line in a file of its own."""
    spark = events.sparkSession
    header = spark.createDataFrame([("metadata", scenario)], "type string, scenario string")
    header.coalesce(1).write.mode("overwrite").json(path)
    events.write.mode("append").json(path)
