"""Best-fit packing of documents into sequences of several permitted lengths.

A document is its words and one end token; one longer than the largest capacity
is cut into full pieces and a rest. Pieces, longest first, go to the open bin
that they fill best. Where none fits, a bin is opened: every capacity that holds
the piece is tried with the pieces still to come, largest first, and the one of
least cost for each token that it would hold is taken. The packings with one
opening size for all bins are kept in view, and the cheapest of all is the
result. Each bin then shrinks to the smallest capacity that holds its contents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.runtime import tune

CAPACITIES = (256, 512, 1024, 2048, 4096)
OVERHEAD = 16  # cost of a sequence besides its length
SHARD = 20_000  # documents packed together, about


class Waiting:
    """Pieces still to be packed, by their length."""

    def __init__(self, lengths: list[int], largest: int):
        self.count = np.bincount(lengths, minlength=largest + 1).tolist()
        self.there = sum(1 << n for n, c in enumerate(self.count) if c)  # bit n is set where a piece of n tokens waits

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.there ^= 1 << size

    def filling(self, room: int) -> int:
        """Tokens that the pieces waiting would fill of so much room, largest first."""
        there, full = self.there, room
        while True:
            size = (there & ((1 << (room + 1)) - 1)).bit_length() - 1
            if size <= 0:
                return full - room
            times = min(self.count[size], room // size)
            room -= size * times
            there &= (1 << size) - 1


def least_cost(size: int, waiting: Waiting, capacities, overhead: int) -> int:
    """The capacity to open for a piece: the least cost of a token among what each would hold, downsized; the smaller one on ties."""
    best = None
    for c in capacities:
        if c >= size:
            used = size + waiting.filling(c - size)
            cost = (next(x for x in capacities if x >= used) + overhead) / used
            if best is None or cost < best[0]:
                best = cost, c
    return best[1]


def fit(lengths: list[int], capacities=CAPACITIES, opening: int | None = None, overhead: int = OVERHEAD) -> list[int]:
    """The bin of each length, longest first by best fit; new bins open at the capacity opening (or the least that holds the piece), or where that is None at the least cost."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    waiting = Waiting(lengths, capacities[-1]) if opening is None else None
    room: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]
    there = 0  # bit r is set where some bin has exactly r tokens of room
    bins, n = [0] * len(lengths), 0
    for i in order:
        size = lengths[i]
        if waiting is not None:
            waiting.take(size)
        fits = there >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                there ^= 1 << left
        else:
            at, n = n, n + 1
            left = least_cost(size, waiting, capacities, overhead) if waiting is not None else max(opening, next(c for c in capacities if c >= size))
        bins[i] = at
        left -= size
        if left:
            room[left].append(at)
            there |= 1 << left
    return bins


def pack_lengths(lengths: list[int], capacities=CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """Bin of each length and capacity of each bin: each bin opened at its least cost, or all at one capacity where that is cheaper in total."""
    best: tuple | None = None
    for opening in (None, *capacities):
        bins = fit(lengths, capacities, opening, overhead)
        used = np.bincount(bins, lengths).astype(np.int64) if lengths else np.zeros(0, np.int64)
        sizes = np.array(capacities)[np.searchsorted(capacities, used)]
        cost = int(sizes.sum()) + overhead * len(sizes)
        if best is None or cost < best[0]:
            best = cost, bins, sizes.tolist()
    return best[1], best[2]


def pieces_of(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(first token, tokens) of the pieces of a document."""
    return [(a, min(capacity, n_tokens - a)) for a in range(0, n_tokens, capacity)]


def _counts(batches):
    for batch in batches:
        n = [len(t.split()) + 1 for t in batch.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "text_id", "n"])


PLACED = "bin_id bigint, capacity int, used int, offset int, doc_id bigint, text_id bigint, piece int, start bigint, n_tokens int"


def _packer(capacities, overhead):
    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("n", "ascending"), ("text_id", "ascending")])
        doc, text, piece, start, size = [], [], [], [], []
        for d, t, n in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text_id", "n"))):
            for k, (a, m) in enumerate(pieces_of(n, capacities[-1])):
                doc.append(d), text.append(t), piece.append(k), start.append(a), size.append(m)
        bins, sizes = pack_lengths(size, capacities, overhead)
        bins, size = np.array(bins, np.int64), np.array(size, np.int64)
        order = np.argsort(bins, kind="stable")
        total = np.cumsum(size[order]) - size[order]
        first = np.searchsorted(bins[order], np.arange(len(sizes)))
        offset = np.empty(len(size), np.int64)
        offset[order] = total - np.repeat(total[first], np.diff(np.r_[first, len(size)]))
        used = np.bincount(bins, size, len(sizes)).astype(np.int64)
        return pa.table({
            "bin_id": (np.int64(key[0].as_py()) << 32) + bins, "capacity": pa.array(np.array(sizes)[bins], pa.int32()), "used": pa.array(used[bins], pa.int32()),
            "offset": pa.array(offset, pa.int32()), "doc_id": pa.array(doc, pa.int64()), "text_id": pa.array(text, pa.int64()),
            "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(size, pa.int32()),
        })

    return pack


def pack(docs: DataFrame, capacities=CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """One row per piece: its bin, the bin's capacity and use, its offset there, and which tokens of which document it is.

    Every row of docs is packed, whole. Null texts count as empty: one end
    token. Rows with a null doc_id are packed too. Shards of about SHARD
    documents, by a hash of id, text and copy, are packed on their own, so that
    the bins do not depend on how the table is split. text_id, a hash of the
    text, tells apart rows that share an id. An empty table gives no rows.
    """
    tune(docs.sparkSession)
    capacities = tuple(sorted(capacities))
    shards = max(1, -(-docs.count() // SHARD))
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = plain.select("doc_id", F.xxhash64("text").alias("text_id"), "text").mapInArrow(_counts, "doc_id bigint, text_id bigint, n bigint")
    # Rows that are repeated are counted first and numbered, so that they do not share a shard.
    copies = counted.groupBy("doc_id", "text_id", "n").agg(F.count("*").alias("copies")).select("doc_id", "text_id", "n", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    dealt = copies.select("doc_id", "text_id", "n", F.pmod(F.xxhash64("doc_id", "text_id", "copy"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(_packer(capacities, overhead), PLACED)


def with_text(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """placed with the text of every piece; a row's pieces, in order, are its whole text.

    Rows that share a doc_id, or have none, are told apart by their text; rows
    that repeat id and text each have their own pieces.
    """
    tune(docs.sparkSession, 250, 4)
    # Null ids meet as zero, so that both sides join on plain columns; equal texts of ids 0 and null may share a row.
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id")
    # By shard as well: the pieces of a row that is repeated without bound do not gather in one list.
    some = placed.groupBy(key, "text_id", F.shiftright("bin_id", 32).alias("_shard")).agg(F.collect_list(F.struct(*placed.columns)).alias("pieces"))
    text = F.coalesce("text", F.lit("")).alias("text")
    texts = docs.select(key, text).select("_id", F.xxhash64("text").alias("text_id"), "text")
    texts = texts.groupBy("_id", "text_id").agg(F.first("text").alias("text"))  # copies are one before they move
    rows = texts.join(some, ["_id", "text_id"]).select("text", "pieces")

    def cut(batches):
        for batch in batches:
            out = []
            for text, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                starts = _word_starts(raw) if any(p["piece"] or p["n_tokens"] == p["capacity"] for p in pieces) else np.zeros(0, np.int64)
                for p in pieces:
                    stop = p["start"] + p["n_tokens"]
                    a = 0 if not p["piece"] else int(starts[p["start"]]) if p["start"] < len(starts) else len(raw)
                    z = int(starts[stop]) if stop < len(starts) else len(raw)
                    out.append(p | {"text": raw[a:z].decode()})
            yield pa.RecordBatch.from_pylist(out, kind)

    names = PLACED.split(", ")
    kind = pa.schema([(n.split()[0], pa.int64() if n.endswith("bigint") else pa.int32()) for n in names] + [("text", pa.string())])
    return rows.mapInArrow(cut, PLACED + ", text string")


def _word_starts(raw: bytes) -> np.ndarray:
    space = np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    return np.flatnonzero(~space & np.r_[True, space[:-1]])
