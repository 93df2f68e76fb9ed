"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic score
of its words and word beginnings; the document's is their noisy-or, one minus
the product of what the sentences leave. Both are trained from document labels
alone, and the sentence scores then say where the offence is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textops
from lodestone.llm.quality import SAMPLE, labelled_sample
from lodestone.llm.runtime import remainder, tune

BUCKETS = 1 << 20  # of hashed words and beginnings
FEATURES = 1 << 13  # buckets that the model weighs
STARTS = (4, 5, 6)  # bytes of a word's beginnings
LEAST = 3  # training documents that a feature must be in
EPOCHS = 150

_END = np.zeros(256, bool)
_END[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True  # line ends . ! ?


def sentence_features(data: np.ndarray, offsets: np.ndarray):
    """Feature buckets with the sentence of each, sentence bounds in bytes, and the sentences of each text.

    A sentence ends after a run of . ! ? or line ends. Sentences without words
    are left out.
    """
    padded = textops.lower_letters(data)
    start, end = textops.spans(textops.LETTER[data], offsets)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(len(offsets), np.int64)
    stops = np.cumsum(_END[data])[start]
    doc = np.searchsorted(offsets, start, side="right") - 1
    new = np.r_[True, (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1])]
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    hashes, owner = [textops.hash_spans(padded, start, end)], [sentence]
    for n in STARTS:
        longer = np.flatnonzero(end - start > n)
        hashes.append(textops.mix(textops.hash_spans(padded, start[longer], start[longer] + n) + np.uint64(n)))
        owner.append(sentence[longer])
    bucket = (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)
    ends = end[np.r_[first[1:] - 1, len(end) - 1]]
    return bucket, np.concatenate(owner), start[first], ends, np.searchsorted(start[first], offsets)


def _counts(batches):
    seen = np.zeros((2, BUCKETS), np.int32)
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False).astype(int)
        bucket, owner, _, _, bounds = sentence_features(*textops.utf8(batch.column(1)))
        doc = np.searchsorted(bounds, owner, side="right") - 1
        pairs = np.unique(doc * BUCKETS + bucket)
        for y in (0, 1):
            seen[y] += np.bincount(pairs[label[pairs // BUCKETS] == y] % BUCKETS, minlength=BUCKETS).astype(np.int32)
        # texts that say nothing still count as documents
    used = np.flatnonzero(seen.sum(axis=0) >= 1)
    packed = np.concatenate([used.astype(np.int32), seen[0, used], seen[1, used]])
    yield pa.RecordBatch.from_arrays([pa.array([packed.tobytes()], pa.binary())], names=["seen"])


def choose(seen: np.ndarray, good: int, bad: int) -> np.ndarray:
    """The FEATURES buckets whose rates in good and bad documents differ most, by a z-score, at least two."""
    rate = (seen[0] + seen[1] + 0.5) / (good + bad + 1)
    spread = np.sqrt(rate * (1 - np.minimum(rate, 0.999)) * (1 / max(good, 1) + 1 / max(bad, 1)))
    z = np.abs((seen[1] + 0.0) / max(bad, 1) - seen[0] / max(good, 1)) / spread
    z[seen.sum(axis=0) < LEAST] = 0
    best = np.argsort(-z, kind="stable")[:FEATURES]
    return best[z[best] >= 2]


def fit(feature: np.ndarray, owner: np.ndarray, sentences: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weights and bias under the noisy-or likelihood; sentences: how many each document has."""
    total = int(sentences.sum())
    doc = np.repeat(np.arange(len(y)), sentences)
    w, b = np.zeros(n), float(np.log(max(y.mean(), 1e-3) / max(sentences.mean(), 1.0)))
    m, v, step = np.zeros(n + 1), np.zeros(n + 1), 0
    for epoch in range(EPOCHS):
        s = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[feature], total) + b, -30, 30)))
        left = np.exp(np.bincount(doc, np.log1p(-np.minimum(s, 1 - 1e-9)), len(y)))
        pull = np.where(y == 1, -left / np.maximum(1 - left, 1e-9), 1.0)  # of the loss, by each sentence's logit, over s
        d = pull[doc] * s / len(y)
        g = np.r_[np.bincount(feature, d[owner], n) + 1e-5 * w, d.sum()]
        step += 1
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.15 / (1 + epoch / 60) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature number of each bucket (-1: none), weights and bias, from at most bound labelled documents.

    Without labelled rows no feature is weighed and every sentence scores zero.
    """
    spark = docs.sparkSession
    tune(spark, 500)
    sample = labelled_sample(docs, labels, "toxic", bound)
    seen = np.zeros((2, BUCKETS), np.int64)
    for r in sample.select("label", "text").mapInArrow(_counts, "seen binary").toLocalIterator():  # six rows, of bounded size
        used, good, bad = np.frombuffer(r["seen"], np.int32).reshape(3, -1)
        seen[0, used] += good
        seen[1, used] += bad
    rows = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    number = np.full(BUCKETS, -1, np.int32)
    if not rows:
        return number, np.zeros(0), -np.inf
    chosen = choose(seen, rows.get(0, 0), rows.get(1, 0))
    number[chosen] = np.arange(len(chosen))
    shared = spark.sparkContext.broadcast(number)

    def bags(batches):
        for batch in batches:
            bucket, owner, _, _, bounds = sentence_features(*textops.utf8(batch.column(2)))
            feature = shared.value[bucket]
            keep = feature >= 0
            order = np.argsort(owner[keep], kind="stable")
            feature, owner = feature[keep][order].astype(np.int32), owner[keep][order]
            cut = np.searchsorted(owner, bounds)
            local = [(owner[a:c] - s).astype(np.int32).tobytes() for a, c, s in zip(cut[:-1], cut[1:], bounds[:-1])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(bounds), pa.int32()), pa.array(local, pa.binary()),
                 pa.array([feature[a:c].tobytes() for a, c in zip(cut[:-1], cut[1:])], pa.binary())],
                names=["at", "label", "n", "owner", "feature"],
            )

    table = sample.mapInArrow(bags, "at bigint, label int, n int, owner binary, feature binary").toArrow().sort_by([("at", "ascending"), ("n", "ascending")])
    n = table.column("n").to_numpy()
    firsts = np.r_[0, np.cumsum(n)[:-1]]
    owners = [np.frombuffer(o, np.int32) for o in table.column("owner").to_pylist()]
    owner = np.concatenate(owners) + np.repeat(firsts, [len(o) for o in owners])
    feature = np.frombuffer(b"".join(table.column("feature").to_pylist()), np.int32)
    w, b = fit(feature, owner, n, table.column("label").to_numpy().astype(float), max(len(chosen), 1))
    return number, w, b


OUT = "doc_id bigint, score double, offending array<struct<start: int, end: int, score: double>>"


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """doc_id, score and offending of every row of docs.

    offending lists the sentences that reach the threshold, as code points from
    start to before end. Whole texts are read; a null or empty text, or one
    without words, has score 0 and no offending sentence.
    """
    tune(docs.sparkSession, 500)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        number, w, b = shared.value
        weight = np.r_[w, 0.0]
        for batch in batches:
            data, offsets = textops.utf8(batch.column(1))
            bucket, owner, start, end, bounds = sentence_features(data, offsets)
            s = np.bincount(owner, weight[number[bucket]], len(start)) + b
            s = 1 / (1 + np.exp(-np.clip(s, -30, 30))) if len(start) and np.isfinite(b) else np.zeros(len(start))
            left = np.log1p(-np.minimum(s, 1 - 1e-12))
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            p = 1 - np.exp(np.bincount(doc, left, len(bounds) - 1))
            places: list[list] = [[] for _ in range(len(p))]
            for i in np.flatnonzero(s >= threshold):
                head = data[offsets[doc[i]] : start[i]]
                a = int(np.count_nonzero((head & 0xC0) != 0x80))
                size = int(np.count_nonzero((data[start[i] : end[i]] & 0xC0) != 0x80))
                places[doc[i]].append({"start": a, "end": a + size, "score": float(s[i])})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p + 0.0, pa.float64()), pa.array(places, kind)], names=["doc_id", "score", "offending"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, OUT)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and offending of every row; rows with crc32(doc_id) mod 4 = 2 are never learned from."""
    model = train(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))
    return score(docs, model, threshold).select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending"
    )
