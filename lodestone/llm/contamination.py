"""Benchmark decontamination: rare n-gram seeds, then local alignment.

The document frequency of every word n-gram of the test items is counted over
the whole corpus. An item's seeds are its n-grams that few documents have, and in
any case the rarer three quarters of those that are there; a document that has a
seed is aligned with the item around it (Smith-Waterman over words),
so that edited and paraphrased copies are found by how much of the item aligns.

Both passes are map-only over the documents. The test items are sent to all
executors in blocks of bounded size, one after another.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textops
from lodestone.llm.runtime import input_bytes, tune

SEED = 3  # words
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.35  # share of the item's best possible score
FEW = 1000  # an n-gram in at most one of so many documents is rare
BLOCK = 16 << 20  # bytes of test items sent at once


class Items:
    """Words, n-grams and seeds of a block of test items."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        h, self.bounds = textops.letter_words(*textops.utf8(pa.array(texts, pa.string())))[:2]
        self.words = h
        gram, owner = _grams(h, self.bounds)
        self.grams, which = np.unique(gram, return_inverse=True)
        self.pairs = np.unique(which.astype(np.int64) * max(len(ids), 1) + owner)  # (n-gram, item)
        bits = max(16, int(8 * len(self.grams) + 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.there = np.zeros(1 << bits, bool)
        self.there[(self.grams >> self.shift).astype(np.int64)] = True
        self.short: dict[tuple[int, ...], list[int]] = {}  # items of fewer words than a seed, by their words
        for i in np.flatnonzero((np.diff(self.bounds) > 0) & (np.diff(self.bounds) < SEED)).tolist():
            self.short.setdefault(tuple(h[self.bounds[i] : self.bounds[i + 1]].tolist()), []).append(i)

    def keep_rare(self, df: np.ndarray, documents: int) -> None:
        """Keep the n-grams that one in FEW documents has, and the rarer three quarters of each item's that are there at all."""
        n = max(len(self.ids), 1)
        gram, item = self.pairs // n, self.pairs % n
        there = df[gram] > 0
        gram, item = gram[there], item[there]
        order = np.lexsort((df[gram], item))
        gram, item = gram[order], item[order]
        cut = np.searchsorted(item, np.arange(n + 1))
        bound = np.zeros(n)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            bound[i] = max(df[gram[cut[i] + (3 * (cut[i + 1] - cut[i]) - 1) // 4]], documents / FEW)
        kept = df[gram] <= bound[item]
        order = np.argsort(gram[kept], kind="stable")
        self.seed_gram, self.seed_item = gram[kept][order], item[kept][order]

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in gram that hold one of the items' n-grams, and which."""
        maybe = np.flatnonzero(self.there[(gram >> self.shift).astype(np.int64)])
        at = np.searchsorted(self.grams, gram[maybe])
        at[at == len(self.grams)] = 0
        hit = self.grams[at] == gram[maybe] if len(self.grams) else np.zeros(len(maybe), bool)
        return maybe[hit], at[hit]


def _grams(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams at the place of their first word that stay inside a text, and their texts."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if len(h) < SEED:
        return h[:0], doc[:0]
    inside = doc[: len(h) - SEED + 1] == doc[SEED - 1 :]
    return textops.combine(h, SEED)[inside], doc[: len(h) - SEED + 1][inside]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of item in words, and the place after its end in words."""
    best, end = 0, 0
    ramp = -GAP * np.arange(1, len(words) + 1)
    above = np.zeros(len(words) + 1, np.int64)
    for w in item:
        step = np.where(words == w, MATCH, MISMATCH)
        row = np.maximum(np.maximum(above[:-1] + step, above[1:] + GAP), 0)
        row = np.maximum.accumulate(row + ramp) - ramp
        j = int(row.argmax())
        if row[j] > best:
            best, end = int(row[j]), j + 1
        above = np.r_[0, row]
    return best, end


def _matches(items: Items, column, threshold: float):
    """(row, item, score, start, end) of every item that a text holds; places in code points."""
    data, offsets = textops.utf8(column)
    h, bounds, start, end = textops.letter_words(data, offsets)
    if not len(h) or not len(items.ids):
        return
    for r in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < SEED)).tolist() if items.short else ():
        for i in items.short.get(tuple(h[bounds[r] : bounds[r + 1]].tolist()), ()):
            chars = lambda x: int(np.count_nonzero((x & 0xC0) != 0x80))
            first = chars(data[offsets[r] : start[bounds[r]]])
            yield r, i, 1.0, first, first + chars(data[start[bounds[r]] : end[bounds[r + 1] - 1]])
    whole = textops.combine(h, SEED) if len(h) >= SEED else h[:0]
    place, gram = items.find(whole)
    lo, hi = np.searchsorted(items.seed_gram, gram), np.searchsorted(items.seed_gram, gram, side="right")
    n = hi - lo
    place = np.repeat(place, n)
    which = items.seed_item[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(n) else place
    row = np.searchsorted(bounds, place, side="right") - 1
    inside = place + SEED <= bounds[row + 1]
    place, which, row = place[inside], which[inside], row[inside]
    order = np.lexsort((place, which, row))
    place, which, row = place[order], which[order], row[order]
    size = np.diff(items.bounds)[which]
    new = np.r_[True, (row[1:] != row[:-1]) | (which[1:] != which[:-1]) | (place[1:] - place[:-1] > 2 * size[1:])] if len(row) else np.zeros(0, bool)
    firsts = np.flatnonzero(new)
    lasts = np.r_[firsts[1:], len(row)] - 1
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for a, b in zip(firsts.tolist(), lasts.tolist()):
        r, i, m = int(row[a]), int(which[a]), int(size[a])
        low, high = max(int(bounds[r]), int(place[a]) - 2 * m), min(int(bounds[r + 1]), int(place[b]) + 2 * m + SEED)
        item = items.words[items.bounds[i] : items.bounds[i + 1]]
        score, stop = align(item, h[low:high])
        if score >= threshold * MATCH * m and score > best.get((r, i), (0, 0, 0))[0]:
            back = align(item[::-1], h[low : low + stop][::-1])[1]
            best[r, i] = (score, low + stop - back, low + stop)
    for (r, i), (score, a, b) in best.items():
        head = data[offsets[r] : start[a]]
        first = int(np.count_nonzero((head & 0xC0) != 0x80))
        inner = data[start[a] : end[b - 1]]
        yield r, i, score / (MATCH * len(items.words[items.bounds[i] : items.bounds[i + 1]])), first, first + int(np.count_nonzero((inner & 0xC0) != 0x80))


def seeds(docs: DataFrame, benchmark: DataFrame):
    """The test items block by block, each with its seeds chosen by document frequencies over all of docs."""
    spark = docs.sparkSession
    tune(spark)
    blocks = -(-input_bytes(benchmark) // BLOCK) or 1
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    for number in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).distinct().orderBy("item_id", "text").collect()
        items = Items([r["item_id"] for r in block], [r["text"] for r in block])
        shared = spark.sparkContext.broadcast(items)

        def frequencies(batches, shared=shared):
            items = shared.value
            df, documents = np.zeros(len(items.grams), np.int64), 0
            for batch in batches:
                documents += batch.num_rows
                h, bounds = textops.letter_words(*textops.utf8(batch.column(0)))[:2]
                gram, doc = _grams(h, bounds)
                place, which = items.find(gram)
                seen = np.unique(doc[place].astype(np.int64) * max(len(df), 1) + which)
                df += np.bincount(seen % max(len(df), 1), minlength=len(df)) if len(seen) else 0
            used = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used], pa.int64()), pa.array(np.r_[documents, df[used]])], names=["gram", "n"])

        documents = 0
        df = np.zeros(len(items.grams), np.int64)
        for r in docs.select("text").mapInArrow(frequencies, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
            if r["gram"] < 0:
                documents = r["n"]
            else:
                df[r["gram"]] = r["n"]  # at most the block's n-grams
        items.keep_rare(df, documents)
        yield spark.sparkContext.broadcast(items)


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, start and end of every test item that a document holds, once for each pair.

    score is the alignment's score over the item's best possible one; start and
    end are code points of the text. Words are runs of letters and digits,
    lower-cased. Items of fewer than three words, which any text may hold by
    chance, are found in texts of these words alone; null texts hold nothing;
    items without words are found nowhere; repeated rows of docs are each
    reported. An empty table of either kind gives no rows.
    """

    def run(shared):
        def matches(batches):
            for batch in batches:
                ids = batch.column(0)
                found = list(_matches(shared.value, batch.column(1), threshold))
                r, i, score, start, end = zip(*found) if found else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(r, pa.int64())), pa.array([shared.value.ids[x] for x in i], pa.int64()),
                     pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                    names=["doc_id", "item_id", "score", "start", "end"],
                )

        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
            matches, "doc_id bigint, item_id bigint, score double, start bigint, end bigint"
        )

    return reduce(DataFrame.unionAll, [run(shared) for shared in seeds(docs, benchmark)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no test item, with all their columns."""
    place = docs.columns.index("text")
    for shared in seeds(docs, benchmark):

        def clean(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in _matches(shared.value, batch.column(place), threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
