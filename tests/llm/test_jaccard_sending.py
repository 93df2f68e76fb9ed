"""What the Jaccard join's first pass sends."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from test_llm import brute_join, edited, frame, words

from lodestone.llm import class_lm, jaccard_join


class Task:
    @staticmethod
    def get():
        return Task

    @staticmethod
    def partitionId():
        return 3


def sent(fragments, texts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TaskContext", Task)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text_id": list(range(len(texts))), "text": texts})
    return list(jaccard_join._sender(fragments)([batch.slice(i, 250) for i in range(0, len(texts), 250)]))


def test_bytes_do_not_grow_with_the_fragments(monkeypatch):
    rng = random.Random(1)
    texts = [words(rng, rng.randrange(50, 800), 4000) for _ in range(1000)]
    sizes = {}
    for fragments in (64, 1024, 16_384):
        batches = sent(fragments, texts, monkeypatch)
        sizes[fragments] = sum(len(x) for b in batches for c in ("n", "low", "high", "doc_id", "text_id", "print") for x in b.column(c).to_pylist() if x)
        assert max(b.num_rows for b in batches) <= 1024
        assert sum(b.column("n").to_pylist()[0] is not None and b.column("fragment").to_pylist()[0] < 0 for b in batches) == 1  # small batches are put together
    assert sizes[16_384] < 1.2 * sizes[64]


@pytest.mark.parametrize("limits", [(1 << 30, 3), (2000, 60_000), (1, 60_000)])
def test_join_of_small_batches_matches_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(jaccard_join, "SEND_BYTES", limits[0])
    monkeypatch.setattr(jaccard_join, "SEND_TEXTS", limits[1])
    rng = random.Random(2)
    base = [words(rng, 60) for _ in range(4)]
    texts = [*base, *[edited(rng, rng.choice(base), rng.randrange(4)) for _ in range(20)], "", "one", "one"]
    ids = [np.iinfo(np.int64).min, *range(1, len(texts))]
    found = jaccard_join.join(frame(spark, texts, ids)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in found) == sorted(brute_join(texts, ids))


def test_every_bigint_can_be_an_id_of_a_scored_text(spark):
    least = np.iinfo(np.int64).min
    found = class_lm.score(frame(spark, ["a b c", "a b", "c", ""], [least, 0, None, 7])).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in found) == sorted([(str(least), 4), ("0", 3), ("None", 2), ("7", 1)])
