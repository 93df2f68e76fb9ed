"""Files of records as data sources: split reading, placed writing, commit and abort."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import sources
from lodestone.sources import records

DIM = 5


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 3, [float(np.float32(x)) for x in rng.normal(size=DIM)], sorted(rng.choice(100, 1 + i % 4, replace=False).tolist())) for i in range(500)]
    return spark.createDataFrame(rows, "id long, vec array<double>, nbrs array<long>").repartition(7)


def rows(df, *columns):
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*columns).collect())


def ranges(files, size, limit=None):
    """What a reader deals to tasks."""
    import json
    from dataclasses import asdict

    spec = {"files": [asdict(f) for f in files], "layout": files[0].layout, "element": "float", "multiple": 1, "limit": limit, "r": 4, "bytes": size}
    return records.RecordReader({"spec": json.dumps(spec)}).partitions()


@pytest.mark.parametrize("layout", ["vecs", "bin", "truth", "graph", "sectors", "codes"])
def test_any_split_gives_the_same_rows(spark, table, tmp_path, monkeypatch, layout):
    path = str(tmp_path / "x")
    if layout in ("vecs", "bin"):
        assert sources.write_vectors(table, path, layout) == 500
        read = lambda: rows(sources.read_vectors(spark, f"file://{path}", layout), "id", "vec")
        want = [(i, r[1]) for i, r in enumerate(rows(table, "id", "vec"))]
    elif layout == "truth":
        found = table.select(F.col("id").alias("qid"), F.posexplode("vec").alias("p", "dist")).select("qid", (F.col("p") + 1).alias("rk"), (F.col("qid") + F.col("p")).alias("id"), "dist")
        assert sources.write_truth(found, path, DIM) == 500
        read = lambda: rows(sources.read_truth(spark, path, "truth"), "qid", "rk", "id", "dist")
        want = [(i, k + 1, r[0] + k, r[1][k]) for i, r in enumerate(rows(table, "id", "vec")) for k in range(DIM)]
    elif layout == "codes":
        codes = table.select("id", F.explode(F.array(*(F.struct(F.lit(c).alias("chunk"), ((F.col("id") * 7 + c) % 256).cast("int").alias("code")) for c in range(3)))).alias("x")).select("id", "x.*")
        pivots = spark.createDataFrame([(c, k, [float(c), float(k)]) for c in range(3) for k in range(256)], "chunk int, code int, sub array<double>")
        sources.write_pq(pivots, codes, str(tmp_path / "p"), path)
        read = lambda: rows(sources.read_pq(spark, str(tmp_path / "p"), path)["codes"], "id", "chunk", "code")
        want = [(i, c, (i * 21 + c) % 256) for i in range(500) for c in range(3)]
    else:
        want = [(i, r[1], r[2]) for i, r in enumerate(rows(table, "id", "vec", "nbrs"))]
        if layout == "graph":
            assert sources.write_graph(table, path, 4) == 500
            read = lambda: rows(sources.read_graph(spark, path, DIM, 4), "id", "vec", "nbrs")
        else:
            plain = table.withColumn("id", (F.col("id") / 3).cast("long"))
            assert sources.write_sectors(plain, path, 4, 2) == 500
            read = lambda: rows(sources.read_sectors(spark, path, 4)[0], "id", "vec", "nbrs")
    for size in (64 << 20, 3000, 100):
        monkeypatch.setattr(sources, "WHOLE", size)
        assert read() == want
    assert os.listdir(tmp_path).count("x") == 1 and not [n for n in os.listdir(tmp_path) if n.startswith("_")]


def test_large_files_are_dealt_to_many_tasks(tmp_path):
    path = tmp_path / "big.bin"
    with path.open("wb") as f:
        n, dim = (1 << 30) // (128 * 4), 128
        f.write(np.array([n, dim], "<i4").tobytes())
        f.truncate(8 + n * dim * 4)  # a gigabyte, without its blocks
    files = records.plan(str(path), "bin")
    parts = ranges(files, 64 << 20)
    assert len(parts) == 17 and sum(p.count for p in parts) == n and max(p.count for p in parts) * dim * 4 <= 64 << 20
    assert [p.first for p in parts] == np.cumsum([0, *(p.count for p in parts[:-1])]).tolist()
    assert sum(p.count for p in ranges(files, 64 << 20, 1000)) == 1000


@pytest.mark.parametrize("bad", ["cut", "long", "dim"])
@pytest.mark.parametrize("layout", ["vecs", "bin", "truth", "codes", "graph", "sectors"])
def test_files_that_do_not_fit_are_refused(tmp_path, layout, bad):
    raw = {
        "vecs": np.array([2, 1, 1], "<i4").tobytes() * 3, "bin": np.array([3, 2, *[0] * 6], "<i4").tobytes(), "truth": np.array([3, 2, *[0] * 12], "<i4").tobytes(),
        "codes": np.array([3, 4, 0, 0, 0], "<i4").tobytes(), "graph": np.array([1, 1, 2, 0, 0], "<i4").tobytes() * 2, "sectors": np.array([0, 1, 2, 9, 28, 9, 0, 0, 0, 8192], "<u8").tobytes().ljust(8192, b"\0"),
    }[layout]
    path = tmp_path / "x"
    path.write_bytes(raw)
    assert records.plan(str(path), layout, dim=2, r=2)[0].n in (1, 2, 3)
    path.write_bytes({"cut": raw[:-1], "long": raw + b"\0" * 3, "dim": raw[:4] + b"\xff" + raw[5:] if layout != "graph" else raw[:-2]}[bad])
    if bad == "dim" and layout in ("vecs", "sectors"):
        return  # seen when the records are read; not used
    with pytest.raises(ValueError):
        records.plan(str(path), layout, dim=2, r=2)


def test_empty_files_and_folders(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"x")
    assert sources.read_vectors(spark, f"file://{tmp_path}").count() == 0
    one = np.array([[1, 2], [3, 4]])
    (tmp_path / "a").write_bytes(sources.encode(one, "vecs"))
    (tmp_path / "b").write_bytes(sources.encode(np.ones((1, 3)), "vecs"))  # another dimension
    assert rows(sources.read_vectors(spark, str(tmp_path)), "id", "vec") == [(0, (1.0, 1.0, 1.0)), (0, (1.0, 2.0)), (1, (3.0, 4.0))]
    with pytest.raises(FileNotFoundError):
        sources.read_vectors(spark, str(tmp_path / "none"))
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert sources.write_vectors(none, str(tmp_path / "c"), "bin") == 0
    assert sources.read_vectors(spark, str(tmp_path / "c"), "bin").count() == 0


def test_a_folder_of_pieces_is_one_file(spark, table, tmp_path, monkeypatch):
    whole, pieces = str(tmp_path / "whole"), str(tmp_path / "pieces")
    sources.write_vectors(table, whole, "bin")
    monkeypatch.setattr(records, "write_places", lambda *a, write=records.write_places, **k: write(*a, **k, pieces=True))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sources.write_vectors(table, pieces, "bin")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(os.listdir(pieces))
    assert len(names) > 2 and all(len(n) == 20 for n in names) and names[0] == "0" * 20
    assert b"".join(open(f"{pieces}/{n}", "rb").read() for n in names) == open(whole, "rb").read()
    monkeypatch.setattr(sources, "WHOLE", 999)
    assert rows(sources.read_vectors(spark, pieces, "bin"), "id", "vec") == rows(sources.read_vectors(spark, whole, "bin"), "id", "vec")
    sources.write_vectors(table.limit(3), pieces, "bin")  # takes the place of what is there
    assert sources.read_vectors(spark, pieces, "bin").count() == 3


@pytest.mark.parametrize("pieces", [False, True])
def test_a_failed_write_leaves_what_was_there(spark, tmp_path, pieces):
    path = tmp_path / "x"
    good = spark.createDataFrame([(0, b"abc"), (3, b"def")], "pos long, raw binary")
    records.write_places(good, str(path), 6, pieces=pieces)
    before = sorted(os.listdir(tmp_path))
    bad = spark.range(4).select((F.col("id") * 3).alias("pos"), F.when(F.col("id") == 3, F.raise_error(F.lit("no")).cast("binary")).otherwise(F.lit(b"xyz")).alias("raw"))
    with pytest.raises(Exception, match="no"):
        records.write_places(bad, str(path), 12, pieces=pieces)
    assert sorted(os.listdir(tmp_path)) == before == ["x"]
    assert b"".join(open(path / n, "rb").read() for n in sorted(os.listdir(path))) == b"abcdef" if pieces else path.read_bytes() == b"abcdef"


def test_vectors_of_several_dimensions_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="1 to 2 elements"):
        sources.write_vectors(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vec array<double>"), str(tmp_path / "x"))
