"""The filter audit, the WARC archive and hard negatives against plain code."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.llm import filter_audit, hard_negatives, queries, runtime, warc

SF = "/root/testdata/sf0.001"


# ---- 13 filter audit


def brute_audit(docs, labels):
    """Every order applied document by document."""
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            t = text or ""
            first[t] = min(first.get(t, doc_id), doc_id)

    def fails(doc_id, text):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and doc_id > first[t],
        }

    good = {i for i, q, _ in labels if q == 1}
    bad = {i for i, _, x in labels if x == 1}
    rows = [(lang or "", fails(i, t), i in good and i is not None, i in bad and i is not None) for i, t, lang in docs]
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                redundant = sum(r[1][f] and any(r[1][g] for g in order[: step - 1]) for r in mine)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in df.collect()}


def test_audit_matches_every_order_applied(spark):
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", " \n\t", long, long, long.upper(), long + " #", "a " * 250, long + " x", "| " + "b " * 300, "é" * 50, "\x0b".join(f"v{i}" for i in range(200)), " ".join(f"v{i}" for i in range(199)), "x" * 97 + "ABC", "x" * 96 + "ABCD"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 40, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("no") for c in ("digest", "mask", "good", "n", "part")})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("no"))
    assert audited(filter_audit.audit(d, lab)) == brute_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    docs, labels = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"
    assert filter_audit.audit(spark.createDataFrame([], docs), spark.createDataFrame([], labels)).count() == 0
    found = filter_audit.audit(spark.createDataFrame([(1, None, None)], docs), spark.createDataFrame([], labels))
    assert found.count() == 600 and found.where("part <> '' OR good_lost > 0").count() == 0


def test_every_mask_is_kept_or_removed_once_in_an_order():
    m = filter_audit.outcome_matrices()
    assert all(x.shape == (32, 600) for x in m.values())
    removed = m["removed"].reshape(32, 120, 5).sum(axis=2)
    assert (removed[0] == 0).all() and (removed[1:] == 1).all()
    assert (m["kept"].reshape(32, 120, 5)[:, :, -1] == (np.arange(32) == 0)[:, None]).all()
    assert (m["removed"] + m["redundant"] <= 1).all() and m["unique"].sum() == 600


# ---- 11 WARC


PAGES = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute_archive(pages, least=0):
    out = []
    for i, _, h in pages:
        last = max(j for j, _, g in pages if (g or "") == (h or ""))
        again = i != last and len((h or "").encode()) >= least
        out.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", last if again else None))
    return sorted(out)


@pytest.fixture(scope="module")
def odd_pages():
    rng = random.Random(9)
    texts = [None, "", "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "<html>" + "x" * 300_000, "abc", "abc ", "ö" * 10]
    urls = [None, "", "http://é.example/\r\nWARC-Type: response\r\n\r\n", "http://a.example/?q=1"]
    return [(i, rng.choice(urls), "hot" if i % 3 == 0 else rng.choice(texts)) for i in range(-5, 120)]


@pytest.mark.parametrize("least", [0, 4])
def test_archive_is_read_back(spark, odd_pages, least):
    df = spark.createDataFrame(odd_pages, PAGES).withColumns({c: F.lit("no") for c in ("digest", "payload", "uid", "n")})
    assert sorted(map(tuple, warc.roundtrip(df, least).collect())) == brute_archive(odd_pages, least)


def test_hot_and_cold_digests_alike(spark, odd_pages, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 2)  # only the third of all rows is hot
    df = spark.createDataFrame(odd_pages, PAGES)
    assert sorted(map(tuple, warc.roundtrip(df).collect())) == brute_archive(odd_pages)


def test_payloads_are_stored_once_and_records_are_whole(spark, odd_pages, tmp_path):
    archive = warc.Archive(spark, str(tmp_path / "a")).write(spark.createDataFrame(odd_pages, PAGES), 4)
    assert archive.payloads.count() == archive.holders.count() == len({h or "" for _, _, h in odd_pages})
    assert archive.holders.count() + archive.others.count() == len(odd_pages)
    found = [list(warc.parse(bytes(r["record"]))) for r in archive.records().collect()]
    assert all(len(f) == 1 for f in found)
    mine = {}
    for ((header, payload),) in found:
        mine[int(re.search(rb"Record-ID: <urn:x-page:(-?\d+):", header)[1])] = header, payload
    revisits = {r[0] for r in brute_archive(odd_pages, 4) if r[3] == "revisit"}
    for i, url, h in odd_pages:
        header, payload = mine[i]
        assert payload == (b"" if i in revisits else (h or "").encode())
        assert (b"WARC-Type: revisit" in header.split(b"\r\n")) == (i in revisits)
        assert (b"\r\nWARC-Target-URI: " in header) == (url is not None)


def test_files_are_read_back(spark, odd_pages, tmp_path):
    archive = warc.Archive(spark, str(tmp_path / "a")).write(spark.createDataFrame(odd_pages, PAGES))
    want = sorted((bytes(r["header"]), bytes(r["record"])) for r in archive.records().collect())
    warc.write_files(archive.records(), str(tmp_path / "w"), 3)
    found = warc.read_files(spark, str(tmp_path / "w/*.gz")).collect()
    assert sorted((bytes(r["header"]), bytes(r["header"]) + bytes(r["payload"]) + b"\r\n\r\n") for r in found) == want
    each = b"".join(gzip.compress(r) for _, r in want)  # a member for each record
    assert [h + p + b"\r\n\r\n" for h, p in warc.parse(each)] == [r for _, r in want]
    with pytest.raises(ValueError, match="does not end"):
        list(warc.parse(want[0][1][:-1]))
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse(b"x" + want[0][1]))


def test_changed_payloads_are_an_error(spark, tmp_path):
    archive = warc.Archive(spark, str(tmp_path / "a")).write(spark.createDataFrame([(1, "u", "abc"), (2, "u", "abd")], PAGES))
    kept = archive.payloads.withColumn("payload", F.lit(b"abx")).collect()
    bad = spark.createDataFrame(kept, "digest binary, payload binary")
    archive.__class__ = type("Changed", (warc.Archive,), {"payloads": bad})
    with pytest.raises(PySparkException, match="not what its digest says"):
        archive.digests()


def test_archive_of_odd_tables(spark):
    assert warc.roundtrip(spark.createDataFrame([], PAGES)).count() == 0
    rows = [(1, "u", "x"), (1, "u", "x"), (1, "v", "x"), (None, "u", "x"), (None, None, None)]
    found = warc.roundtrip(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in found) == sorted([("1", "response", "None"), ("1", "revisit", "1"), ("1", "revisit", "1"), ("None", "revisit", "1"), ("None", "response", "None")])


# ---- 12 hard negatives


def brute_negatives(rows):
    part = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        part.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (a, al, av) in enumerate(part):
        if a % 50:
            continue
        others = [(score(av, v), i, label) for m, (i, label, v) in enumerate(part) if m != n]
        others.sort(key=lambda x: (-x[0], x[1]))
        for ps, p, _ in [x for x in others if x[2] == al][:5]:
            hits = [x for x in others if x[2] != al and 50 * ps <= 100 * x[0] <= 95 * ps][:3]
            out += [(a, p, k, i, ps, s) for k, (s, i, _) in enumerate(hits, 1)]
    return sorted(out)


EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def mined(df):
    c = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[x] for x in c) for r in hard_negatives.mine(df).collect())


@pytest.mark.parametrize(("dim", "spread", "labels"), [(6, 1.0, 3), (3, 0.02, 2), (8, 300.0, 12), (2, 1e4, 2)])
def test_negatives_match_plain_products(spark, monkeypatch, dim, spread, labels):
    """Small components give many ties, large ones many planes; few anchors a block, few rows a batch."""
    monkeypatch.setattr(hard_negatives, "ROWS", 37)
    monkeypatch.setattr(hard_negatives, "WIDTH", 4)
    monkeypatch.setattr(hard_negatives, "BLOCK", 400)
    rng = np.random.default_rng(dim)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, spread, dim)], int(rng.integers(labels))) for i in range(-100, 400)]
    rows += [(1000, None, 1), (1050, [1.0] * dim, None), (1100, [float("nan")] * dim, 1), (1150, [None] * dim, 1), (None, [1.0] * dim, 1), (1200, [float("inf")] * dim, 1), (1250, [0.0] * dim, 1), (1300, [], 0), (1350, [1.0], 1)]
    df = spark.createDataFrame(rows, EMBEDDINGS).withColumns({c: F.lit("no") for c in ("uid", "v", "score", "anchor")}).repartition(5)
    assert mined(df) == brute_negatives(rows)


def test_negatives_of_repeated_rows_and_empty_tables(spark):
    rows = [(50, [0.5, 0.5], 1)] * 3 + [(3, [0.5, 0.5], 1)] * 2 + [(4, [0.3, 0.3], 2)] * 4
    assert mined(spark.createDataFrame(rows, EMBEDDINGS)) == brute_negatives(rows)
    assert mined(spark.createDataFrame([], EMBEDDINGS)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1)], EMBEDDINGS)) == []
    with pytest.raises(ValueError, match="55 bits"):
        mined(spark.createDataFrame([(50, [1e9], 1)], EMBEDDINGS))


def test_intervals_hold_the_score_and_few_pairs_are_left():
    rng = np.random.default_rng(1)
    v, a = rng.integers(-200, 200, (300, 32)), rng.integers(-200, 200, (40, 32))
    exact = v @ a.T
    seen = []

    def top(low, high, row, anchor):
        assert (low <= exact[row, anchor]).all() and (exact[row, anchor] <= high).all()
        seen.append(len(row))
        return high >= np.sort(exact, axis=0)[-5][anchor]

    row, anchor, score = hard_negatives.Planes(v, a, 9, 200).survivors(np.ones(exact.shape, bool), top)
    assert (score == exact[row, anchor]).all() and len(row) == 5 * 40 and seen[0] == exact.size and seen[-2] < exact.size // 20


# ---- the queries


@pytest.mark.parametrize("name", ["op11_warc", "op12_hard_negatives", "op13_filter_audit"])
def test_new_queries_run_over_whole_tables(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_folders_are_remembered_for_removal(spark, tmp_path):
    runtime.keep_until_exit(spark, str(tmp_path))
    assert runtime._written.pop(str(tmp_path)) is spark
