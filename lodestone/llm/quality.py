"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Every word has two units, its lower-cased form and its shape (letter case,
digits, marks at its ends, length). A unit's index vector is a sparse ternary
one, drawn from its hash; its context vector is the sum of the index vectors
around it in all texts, kept by hashed bucket. A document is the mean
of its words' context vectors, with its length and how often words recur, which
the summed index vectors show. A network of one hidden layer, trained by numpy,
gives a logit, and a temperature fitted on rows left out of the training makes
it a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import textops
from lodestone.llm.runtime import materialize, remainder, tune

SAMPLE = 20_000  # labelled rows learned from, at most
SAMPLE_BYTES = 96 << 20  # of their texts
DIM = 32  # a power of two
FORMS, SHAPES = 1 << 14, 1 << 11
PARTS = 64  # that the table of context vectors is summed in
WINDOW = 2
HIDDEN = 24
EPOCHS = 40

_KIND = np.full(256, 3, np.uint8)  # lower 0, upper 1, digit 2, mark 3, beyond ASCII 4
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 4


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the forms and of the shapes of all words, and the bounds of the texts."""
    padded = textops.pad_lower(data)
    start, end = textops.spans(~textops._SPACE[data], offsets)
    bounds = np.searchsorted(start, offsets)
    form = textops.hash_spans(padded, start, end)
    last, third = end - 1, np.maximum(end - 3, start)
    mark = np.where(_KIND[data[last]] == 3, data[last], 0).astype(np.uint64)
    size = np.minimum(end - start, 12).astype(np.uint64) >> np.uint64(1)
    shape = size
    for at in (start, np.minimum(start + 1, last), third, last):
        shape = shape * np.uint64(5) + _KIND[data[at]]
    return form, textops.mix(shape * np.uint64(256) + mark + np.uint64(1 << 40)), bounds


def index_entries(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four nonzero places of each unit's index vector and their signs."""
    out = []
    for k in range(4):
        bits = h >> np.uint64(12 * k)
        out.append(((bits & np.uint64(DIM - 1)).astype(np.int64), ((bits >> np.uint64(8)) & np.uint64(1)).astype(np.int64) * 2 - 1))
    return out


def _contexts(batches):
    total = np.zeros((FORMS + SHAPES, DIM), np.int64)
    for batch in batches:
        form, shape, bounds = units(*textops.utf8(batch.column(0)))
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        index = np.zeros((len(form), DIM), np.int8)
        row = np.arange(len(form))
        for place, sign in index_entries(form) + index_entries(shape):
            index[row, place] += sign.astype(np.int8)
        around = np.zeros_like(index)  # sums of 2 WINDOW vectors of 8 entries
        for lag in range(1, WINDOW + 1):
            same = (doc[lag:] == doc[:-lag]).astype(np.int8)[:, None]
            around[lag:] += index[:-lag] * same
            around[:-lag] += index[lag:] * same
        for unit in (form % np.uint64(FORMS), FORMS + shape % np.uint64(SHAPES)):
            unit = unit.astype(np.uint16)
            order = np.argsort(unit, kind="stable")
            own = unit[order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
            if len(first):
                total[own[first]] += np.add.reduceat(around[order], first, axis=0, dtype=np.int32)
    if total.any():
        parts = total.reshape(PARTS, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "sums"])


def _add_up(batches):
    """Sums of the parts that a task gets, one after another."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[part] = sums.get(part, 0) + np.frombuffer(x, np.int32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "sums"])


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The context vector of every bucket, of unit length, summed over all of docs: each task sends one table of fixed size."""
    tables = docs.select("text").mapInArrow(_contexts, "part int, sums binary").repartition("part")
    sums = np.zeros((PARTS, (FORMS + SHAPES) * DIM // PARTS), np.int64)
    for r in tables.mapInArrow(_add_up, "part int, sums binary").toArrow().to_pylist():  # one row for each part, of fixed size
        sums[r["part"]] = np.frombuffer(r["sums"], np.int64)
    vectors = sums.reshape(-1, DIM).astype(np.float32)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)


def pool(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of all texts; a text without words has only zeros."""
    form, shape, bounds = units(data, offsets)
    n, size = len(offsets) - 1, np.diff(bounds)
    out = np.zeros((n, 2 * DIM + 4), np.float32)
    doc = np.repeat(np.arange(n), size)
    some = np.maximum(size, 1)
    filled = np.flatnonzero(size)
    for half, unit in enumerate(((form % np.uint64(FORMS)).astype(np.int64), FORMS + (shape % np.uint64(SHAPES)).astype(np.int64))):
        step = 1 << 16
        cells = out[:, half * DIM : (half + 1) * DIM]
        for a in range(0, len(unit), step):
            own = doc[a : a + step]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            np.add.at(cells, own[first], np.add.reduceat(vectors[unit[a : a + step]], first, axis=0))
        cells /= some[:, None]
    summed = np.zeros(n * DIM)
    for place, sign in index_entries(form):
        summed += np.bincount(doc * DIM + place, sign, n * DIM)
    recur = (summed.reshape(n, DIM) ** 2).sum(axis=1) / (4 * some)
    twice = np.bincount(doc[1:][(form[1:] == form[:-1]) & (doc[1:] == doc[:-1])], minlength=n) / some
    out[filled, 2 * DIM] = np.log1p(size[filled])
    out[filled, 2 * DIM + 1] = np.log1p(recur[filled])
    out[filled, 2 * DIM + 2] = np.log1p(recur[filled] / np.sqrt(size[filled]))
    out[filled, 2 * DIM + 3] = twice[filled]
    return out


def fit_network(x: np.ndarray, y: np.ndarray) -> dict:
    """Weights, scaling and temperature from features and 0/1 labels; every fifth row only sets the temperature."""
    rng = np.random.default_rng(7)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8).astype(np.float64)
    aside = np.arange(len(y)) % 5 == 4
    zt, yt = z[~aside], y[~aside]
    p = {"w1": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1)}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(yt))
        for a in range(0, len(order), 256):
            i = order[a : a + 256]
            h = np.tanh(zt[i] @ p["w1"] + p["b1"])
            d = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -40, 40))) - yt[i]) / len(i)
            dh = np.outer(d, p["w2"]) * (1 - h * h)
            grads = {"w1": zt[i].T @ dh + 1e-4 * p["w1"], "b1": dh.sum(axis=0), "w2": h.T @ d + 1e-4 * p["w2"], "b2": np.array([d.sum()])}
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= 3e-3 / (1 + epoch / 10) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = {k: a.astype(np.float32) for k, a in p.items()} | {"mean": mean, "scale": scale, "t": 1.0}
    if aside.any():
        logit, temperatures = _logits(model, x[aside]), np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.logaddexp(0, np.where(y[aside] == 1, -logit, logit) / t).mean() for t in temperatures]
        model["t"] = float(temperatures[int(np.argmin(loss))])
    return model


def _logits(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8).astype(np.float32)
    return (np.tanh(z @ model["w1"] + model["b1"]) @ model["w2"] + model["b2"]).astype(np.float64)


def probabilities(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    return 1 / (1 + np.exp(-np.clip(_logits(model, x) / model["t"], -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int = SAMPLE, size: int = SAMPLE_BYTES) -> DataFrame:
    """(at, label, text) of at most bound labelled documents and size bytes, chosen by a hash of the id; a written table.

    Several labels of one document count as their majority, several texts as the
    least of them; null labels and ids are left out, and so are texts of over a
    hundredth of size and those after which the rest would be over size.
    """
    rows = labels.select("doc_id", F.col(label).cast("double").alias("label")).dropna()
    rows = rows.groupBy("doc_id").agg(F.floor(F.avg("label") + 0.5).cast("int").alias("label"))
    rows = rows.withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(bound)
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # bound rows of three numbers
    found = found.groupBy("at", "doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).where(F.octet_length("text") <= size // 100)
    so_far = Window.orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    table = materialize(found.repartition(6, "at"))
    within = table.select("at", "doc_id", F.sum(F.octet_length("text")).over(so_far).alias("total")).where(F.col("total") <= size).select("at", "doc_id")  # of bound rows
    if (table.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= size:
        return table.select("at", "label", "text")
    return table.join(F.broadcast(within), ["at", "doc_id"], "left_semi").select("at", "label", "text")


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict | None]:
    """Context vectors from all documents, and the network from the labelled ones, SAMPLE of them at most.

    Without any labelled row there is no network, and scores are a half.
    """
    tune(docs.sparkSession, 500, 4)
    sample = labelled_sample(docs, labels, "quality")
    vectors = context_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches):
        for b in batches:
            x = pool(*textops.utf8(b.column(2)), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["at", "label", "x"])

    rows = sample.mapInArrow(features, "at bigint, label int, x binary").toArrow().sort_by([("at", "ascending"), ("x", "ascending")])
    if not rows.num_rows:
        return vectors, None
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(rows.num_rows, -1)
    return vectors, fit_network(x, rows.column("label").to_numpy().astype(float))


def score(docs: DataFrame, vectors: np.ndarray, model: dict | None) -> DataFrame:
    """doc_id and score, the probability that a text is good, of every row of docs.

    Whole texts are read. Null texts count as empty; an empty text is scored
    from its zero features. Nothing but the text is an input.
    """
    tune(docs.sparkSession, 500, 4)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))

    def run(batches):
        for b in batches:
            table, network = shared.value
            p = probabilities(network, pool(*textops.utf8(b.column(1)), table))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; rows with crc32(doc_id) mod 5 = 0 are never learned from."""
    vectors, model = train(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    return score(docs, vectors, model).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    vectors, model = train(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    tune(docs.sparkSession, 500, 4)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            table, network = shared.value
            p = probabilities(network, pool(*textops.utf8(b.column(place)), table))
            yield b.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
