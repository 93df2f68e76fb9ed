"""The fitted models and the seeds of test items against plain loops; the fingerprints' contract columns against SQL."""

from __future__ import annotations

import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_llm import SF, frame, words

from lodestone.llm import contamination, fingerprint, quality, textops, toxicity

# ---- 1 quality: the network, row by row


def plain_network(x, y, hidden, epochs):
    """Adam on the logistic loss of a tanh layer, one row and one weight at a time; then the temperature by trying all."""
    rng = np.random.default_rng(7)
    n, dim = x.shape
    mean = [sum(float(r[j]) for r in x) / n for j in range(dim)]
    scale = [math.sqrt(sum((float(r[j]) - mean[j]) ** 2 for r in x) / n) + 1e-3 for j in range(dim)]
    z = [[min(max((float(r[j]) - mean[j]) / scale[j], -8), 8) for j in range(dim)] for r in x]
    learn, aside = [i for i in range(n) if i % 5 != 4], [i for i in range(n) if i % 5 == 4]
    w1, w2 = rng.normal(0, 1 / math.sqrt(dim), (dim, hidden)).tolist(), rng.normal(0, 1 / math.sqrt(hidden), hidden).tolist()
    p = {("w1", j, k): w1[j][k] for j in range(dim) for k in range(hidden)} | {("b1", k): 0.0 for k in range(hidden)} | {("w2", k): w2[k] for k in range(hidden)} | {("b2",): 0.0}
    m, v = dict.fromkeys(p, 0.0), dict.fromkeys(p, 0.0)

    def forward(row):
        h = [math.tanh(sum(row[j] * p["w1", j, k] for j in range(dim)) + p["b1", k]) for k in range(hidden)]
        return h, sum(h[k] * p["w2", k] for k in range(hidden)) + p[("b2",)]

    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(learn)).tolist()
        for a in range(0, len(order), 256):
            g = dict.fromkeys(p, 0.0)
            batch = order[a : a + 256]
            for i in batch:
                row = z[learn[i]]
                h, logit = forward(row)
                d = (1 / (1 + math.exp(-logit)) - y[learn[i]]) / len(batch)
                g[("b2",)] += d
                for k in range(hidden):
                    g["w2", k] += h[k] * d
                    dh = d * p["w2", k] * (1 - h[k] ** 2)
                    g["b1", k] += dh
                    for j in range(dim):
                        g["w1", j, k] += row[j] * dh
            step += 1
            for name in p:
                grad = g[name] + (1e-4 * p[name] if name[0] in ("w1", "w2") else 0.0)
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.999 * v[name] + 0.001 * grad * grad
                p[name] -= 3e-3 / (1 + epoch / 10) * (m[name] / (1 - 0.9**step)) / (math.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    tries = np.exp(np.linspace(np.log(0.25), np.log(8), 60)).tolist()
    loss = lambda t: sum(math.log1p(math.exp(-forward(z[i])[1] / t if y[i] else forward(z[i])[1] / t)) for i in aside)
    return [forward(r)[1] for r in z], min(tries, key=loss)


def test_the_network_matches_plain_loops(monkeypatch):
    monkeypatch.setattr(quality, "HIDDEN", 3)
    monkeypatch.setattr(quality, "EPOCHS", 30)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 0.5, 60) > 0).astype(float)
    logits, temperature = plain_network(x, y.tolist(), 3, 30)
    model = quality.fit_network(x, y)
    assert np.allclose(quality._logits(model, x), logits, atol=1e-4)
    assert math.isclose(model["t"], temperature, rel_tol=1e-9)
    assert np.allclose(quality.probabilities(model, x), [1 / (1 + math.exp(-z / temperature)) for z in logits], atol=1e-4)


def test_pooled_vectors_are_means_of_words(odd=("Aa bb, bb", "", "x", "The quick (brown) fox 12 jumped 3.5")):
    rng = np.random.default_rng(2)
    table = rng.normal(size=(quality.FORMS + quality.SHAPES, quality.DIM)).astype(np.float32)
    data, offsets = textops.utf8(pa.array(odd))
    form, shape, bounds = quality.units(data, offsets)
    found = quality.pool(data, offsets, table)
    for i, text in enumerate(odd):
        f, s = form[bounds[i] : bounds[i + 1]].tolist(), shape[bounds[i] : bounds[i + 1]].tolist()
        assert len(f) == len(text.split())
        if f:
            assert np.allclose(found[i, : quality.DIM], np.mean([table[h % quality.FORMS] for h in f], axis=0), atol=1e-5)
            assert np.allclose(found[i, quality.DIM : 2 * quality.DIM], np.mean([table[quality.FORMS + h % quality.SHAPES] for h in s], axis=0), atol=1e-5)
            assert math.isclose(found[i, 2 * quality.DIM], math.log1p(len(f)), rel_tol=1e-6)
            assert math.isclose(found[i, 2 * quality.DIM + 3], sum(a == b for a, b in zip(f, f[1:])) / len(f), abs_tol=1e-6)
        else:
            assert not found[i].any()


# ---- 3 toxicity: noisy-or by plain loops


def plain_noisy_or(bags, y, n, epochs):
    """bags: per document its sentences, each a list of features."""
    total = [len(b) for b in bags]
    w, b = [0.0] * n, math.log(max(sum(y) / len(y), 1e-3) / max(sum(total) / len(total), 1.0))
    m, v = [0.0] * (n + 1), [0.0] * (n + 1)
    for epoch in range(epochs):
        g = [1e-5 * x for x in w] + [0.0]
        for bag, label in zip(bags, y):
            s = [1 / (1 + math.exp(-(sum(w[f] for f in sentence) + b))) for sentence in bag]
            left = math.prod(1 - x for x in s)
            for x, sentence in zip(s, bag):
                # d(-log p)/d(logit), p = 1 - left for label 1 and left for 0
                d = (-left / (1 - left) if label else 1.0) * x / len(y)
                g[n] += d
                for f in sentence:
                    g[f] += d
        for i, grad in enumerate(g):
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.99 * v[i] + 0.01 * grad * grad
            move = 0.15 / (1 + epoch / 60) * (m[i] / (1 - 0.9 ** (epoch + 1))) / (math.sqrt(v[i] / (1 - 0.99 ** (epoch + 1))) + 1e-7)
            if i < n:
                w[i] -= move
            else:
                b -= move
    return w, b


def test_the_noisy_or_fit_matches_plain_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 25)
    rng = random.Random(4)
    bags = [[[rng.randrange(6) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 5))] for _ in range(20)]
    y = [int(any(5 in s for s in bag)) for bag in bags]
    owner = np.array([i for i, s in enumerate(s for bag in bags for s in bag) for _ in s])
    feature = np.array([f for bag in bags for s in bag for f in s])
    w, b = toxicity.fit(feature, owner, np.array([len(x) for x in bags]), np.array(y, float), 6)
    want = plain_noisy_or(bags, y, 6, 25)
    assert np.allclose(w, want[0], atol=1e-6) and math.isclose(b, want[1], abs_tol=1e-6)
    assert int(np.argmax(w)) == 5


# ---- 8 decontamination: seeds and alignments by plain code


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def score_of(item, words):
    """Smith-Waterman over words, cell by cell."""
    above, best = [0] * (len(words) + 1), 0
    for a in item:
        row = [0]
        for j, b in enumerate(words):
            row.append(max(0, above[j] + (contamination.MATCH if a == b else contamination.MISMATCH), above[j + 1] + contamination.GAP, row[j] + contamination.GAP))
        best, above = max(best, *row), row
    return best


@pytest.mark.parametrize("few", [1000, 5])
def test_seeds_and_matches_are_what_plain_code_finds(spark, monkeypatch, few):
    monkeypatch.setattr(contamination, "FEW", few)
    rng = random.Random(6)
    items = [words(rng, rng.randrange(8, 20), 60) for _ in range(12)] + ["w1 w2 w3", "w1 w2 w3 w4 w5 w6"]
    docs = [words(rng, 80, 60) for _ in range(40)]
    for i in range(0, 40, 3):  # a copy with some words changed
        w = items[i % 12].split()
        for _ in range(len(w) // 6):
            w[rng.randrange(len(w))] = "zz"
        docs[i] = f"{docs[i]} {' '.join(w)} {words(rng, 5, 60)}"
    grams = lambda text: [tuple(tokens(text)[k : k + 3]) for k in range(len(tokens(text)) - 2)]
    df: dict[tuple, int] = {}
    for d in docs:
        for g in set(grams(d)):
            df[g] = df.get(g, 0) + 1
    seeds = []
    for text in items:
        there = sorted(df[g] for g in set(grams(text)) if g in df)
        bound = max(there[(3 * len(there) - 1) // 4], len(docs) / few) if there else 0
        seeds.append({g for g in set(grams(text)) if 0 < df.get(g, 0) <= bound})
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = frame(spark, docs)
    (shared,) = contamination.seeds(table, bench)
    found = shared.value
    key = lambda g: int(textops.combine(textops.letter_words(*textops.utf8(pa.array([" ".join(g)])))[0], 3)[0])
    mine = {(int(found.grams[g]), found.ids[i]) for g, i in zip(found.seed_gram, found.seed_item)}
    assert mine == {(key(g), i) for i, s in enumerate(seeds) for g in s}
    want = set()
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            if set(grams(text)) & seeds[i] and score_of(tokens(item), tokens(text)) >= contamination.THRESHOLD * contamination.MATCH * len(tokens(item)):
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in contamination.find(table, bench).collect()}
    assert {(i, i % 12) for i in range(0, 40, 3)} <= set(got) <= want
    # What is missing aligned only far from any seed.
    assert len(want - set(got)) <= len(want) // 20
    for (d, i), score in got.items():
        assert score <= score_of(tokens(items[i]), tokens(docs[d])) / (contamination.MATCH * len(tokens(items[i]))) + 1e-9


# ---- 7 fingerprints: the contract's other columns by SQL


def test_edited_texts_equal_their_sql(spark):
    sql = f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n FROM '{SF}/documents.parquet'),
        p AS (SELECT a.doc_id, a.t, length(a.t) AS c, b.t AS u FROM d a JOIN d b ON b.i = a.i % a.n + 1)
        SELECT doc_id, c, sha256(left(t, (c - c // 2)::BIGINT) || left(u, (c // 2)::BIGINT)) FROM p"""
    want = sorted(duckdb.sql(sql).fetchall())
    rows = fingerprint.fingerprint(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, rows)) == want


def test_fingerprints_of_one_id_in_many_ranges(spark, monkeypatch):
    """Two thirds of all rows have one id or none; ranges of few rows, single ones among them."""
    monkeypatch.setattr(fingerprint, "_FAN", 40)
    rng = random.Random(3)
    texts = [words(rng, rng.randrange(40)) for _ in range(60)] + ["same"] * 30
    ids = [None] * 30 + [5] * 30 + list(range(100, 130))
    rows = fingerprint.fingerprint(frame(spark, texts, ids)).collect()
    assert len(rows) == 90 and sorted(str(r["doc_id"]) for r in rows) == sorted(map(str, ids))
    # Whatever the order within an id, rows are a cycle: each text follows one text.
    halves = lambda t, u: __import__("hashlib").sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()
    key = lambda t: fingerprint.pack(fingerprint._bins_of([t])[0])
    of = {}
    for i, t in zip(ids, texts):
        of.setdefault((i, key(t), len(t)), []).append(t)
    follows = {halves(t, u): u for t in texts for u in texts}
    used = [follows[r["edited_sha256"]] for r in rows if r["n_chars"] >= 2]
    assert len(used) > 80 and all((r["doc_id"], r["fingerprint"], r["n_chars"]) in of for r in rows)
    tail = [r for r in rows if r["doc_id"] == 129][0]
    assert tail["near_next"] < 1.0 or tail["n_chars"] == 4
