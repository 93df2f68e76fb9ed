"""Removal of repeated substrings by suffix arrays.

A byte goes when a string of so many bytes (LENGTH, unless another length is
given) that covers it also starts somewhere else in the corpus. To bring equal
strings together without one suffix array of everything, each window of that
length is keyed by the least hash of the grams in it; consecutive windows of one
key are a segment. Equal windows have equal keys, so they meet in one bucket. A
bucket whose segments are all equal needs no sorting. The others' distinct
segments are sorted as suffixes in two stages: those smaller than their
successors directly, the rest by scans over the buckets of first symbols; windows
whose common prefix with a neighbour reaches the length are repeated. A second,
larger length can be asked for at once: segments then carry as many bytes more,
and the same common prefixes are held against both.

Grams that very many documents share (found in a first pass, a list of bounded
length) rank behind all others. A window that leaves a popular passage is thus
keyed by a gram outside it, and the windows inside form the same segments
everywhere, so no bucket holds many different segments because of one passage.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textops
from lodestone.llm.runtime import fresh_name, input_bytes, materialize, tune

LENGTH = 400
PASSAGE = 250  # bytes of a passage of over 50 words: of those of 51 in the test tables, 99 % have as many
RUN = 1024  # windows in a segment, at most
SLAB = 1 << 20  # windows of one text handled at once
TOGETHER = 1 << 16  # bytes of short texts handled at once
OFTEN = 250  # a key is popular if one segment in so many documents has it
LEAST_OFTEN = 64  # and so many segments at least
POPULAR = 20_000  # keys looked into for popular grams, at most
CHUNK = 1 << 20  # bytes of segments sorted together
FLAGS = 1 << 27  # bits of the filter that says which buckets are to be sorted
_COARSE = 56  # symbols compared at once by their hash


class Shape(NamedTuple):
    """What follows from the length of a window."""

    length: int
    reach: int  # bytes of the larger windows that are looked for as well
    gram: int  # bytes of a gram, a power of two
    span: int  # grams in a window
    piece: int  # bytes of the pieces by which segments are compared
    pieces: int  # whole pieces in any window, wherever it starts


def shape(length: int, reach: int | None = None) -> Shape:
    """Grams of 16 bytes and pieces of 50 for LENGTH; shorter ones where windows are short."""
    reach = length if reach is None else reach
    if length < 8 or reach < length:
        raise ValueError("length must be 8 at least, and not above the larger length")
    gram = min(16, 1 << (length // 4).bit_length() - 1)
    piece = max(1, min(50, length // 8))
    return Shape(length, reach, gram, length - gram + 1, piece, (length - piece + 1) // piece)


_P = 0x9E3779B97F4A7C15
_TOP = np.uint64(1 << 63)
_BELOW = np.uint64((1 << 63) - 1)
_Q = 0xD1342543DE82EF95


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """63-bit hashes of all grams of so many bytes."""
    h, k = b.astype(np.uint64) + np.uint64(1), 1
    while k < gram:
        h = h[:-k] * np.uint64(pow(_P, k, 1 << 64)) + h[k:]
        k *= 2
    return textops.mix(h) >> np.uint64(1)


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Least of every span consecutive values."""
    m, k = h, 1
    while 2 * k <= span:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[: len(m) - (span - k)], m[span - k :]) if span > k else m


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _Q and of its inverse, modulo 2 ** 64."""
    both = []
    for q in (_Q, pow(_Q, -1, 1 << 64)):
        x = np.full(n, np.uint64(q))
        x[0] = 1
        both.append(np.multiply.accumulate(x))
    return both[0], both[1]


class Popular:
    """A sorted list of hashes with a quick test."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.there = hashes, np.zeros(1 << 22, bool)
        self.there[(hashes >> np.uint64(41)).astype(np.int64)] = True

    def mark(self, h: np.ndarray) -> None:
        """Put the listed values of h behind all others, in place."""
        if len(self.hashes):
            at = np.flatnonzero(self.there[(h >> np.uint64(41)).view(np.int64)])
            found = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            at = at[self.hashes[found] == h[at]]
            h[at] |= _TOP


class Segments(NamedTuple):
    """Segments of consecutive texts, in order."""

    b: np.ndarray  # the texts' bytes, end to end
    h: np.ndarray  # hashes of the grams there
    text: np.ndarray  # which text
    place: np.ndarray  # its first window in the text
    n: np.ndarray  # its windows
    first: np.ndarray  # its first byte in b
    stop: np.ndarray  # its last byte but one in b, as far as the larger windows reach
    key: np.ndarray

    def prints(self, gram: int) -> np.ndarray:
        """A 64-bit hash of each segment's bytes and number of windows."""
        up, down = _powers(max(TOGETHER, 1 << len(self.b).bit_length()))
        total = np.zeros(len(self.h) + 1, np.uint64)
        np.cumsum((self.h & _BELOW) * up[: len(self.h)], out=total[1:])
        value = (total[self.stop - gram + 1] - total[self.first]) * down[self.first]
        return textops.mix(value + self.n.astype(np.uint64) * np.uint64(_P) + (self.stop - self.first).astype(np.uint64))

    def anchors(self, span: int) -> np.ndarray:
        """Where in each segment its key's gram is, or -1 where that is there more than once."""
        low = np.zeros(1 << 16, bool)
        low[(self.key & np.uint64(0xFFFF)).view(np.int64)] = True
        at = np.flatnonzero(low[(self.h & np.uint64(0xFFFF)).view(np.int64)])
        value = self.h[at]
        x, end = np.searchsorted(at, self.first), np.searchsorted(at, self.first + self.n + span - 1)
        out, seen, left = np.full(len(self.key), -1), np.zeros(len(self.key), np.int64), np.arange(len(self.key))
        while True:
            left = left[(x[left] < end[left]) & (seen[left] < 2)]
            if not len(left):
                return np.where(seen == 1, out, -1)
            hit = left[value[x[left]] == self.key[left]]
            seen[hit] += 1
            out[hit] = at[x[hit]] - self.first[hit]
            x[left] += 1

    def bytes_of(self, i: int) -> bytes:
        return self.b[self.first[i] : self.stop[i]].tobytes()


def _slabs(offsets: np.ndarray, of: Shape):
    """(first text, texts, first byte, bytes, windows of a part of one long text or None)."""
    i, n, bounds = 0, len(offsets) - 1, offsets.tolist()
    while i < n:
        size = bounds[i + 1] - bounds[i]
        if size > TOGETHER:
            for base in range(0, size - of.length + 1, SLAB):
                yield i, 1, bounds[i] + base, min(size - base, SLAB + of.reach - 1), (base, min(SLAB, size - base - of.length + 1))
            i += 1
            continue
        j = i + 1
        while j < n and bounds[j + 1] - bounds[i] <= TOGETHER:
            j += 1
        if bounds[j] - bounds[i] >= of.length:
            yield i, j - i, bounds[i], bounds[j] - bounds[i], None
        i = j


def segments(data: np.ndarray, offsets: np.ndarray, popular: Popular, of: Shape):
    """The segments of all texts, slab by slab; texts shorter than a window have none."""
    for i, texts, begin, size, part in _slabs(offsets, of):
        b = data[begin : begin + size]
        h = gram_hashes(b, of.gram)
        popular.mark(h)
        m = _least(h, of.span)
        if part is None:
            start, base = offsets[i : i + texts] - begin, 0
            stop = offsets[i + 1 : i + texts + 1] - begin
            windows = np.maximum(stop - start - of.length + 1, 0)
        else:
            base, start, stop, windows = part[0], np.zeros(1, np.int64), np.array([size]), np.array([part[1]])
        long = np.flatnonzero(windows)
        edge = np.zeros(len(m) + 1, np.int8)
        edge[start[long]] += 1
        np.subtract.at(edge, (start + windows)[long], 1)
        change = np.empty(len(m), bool)
        change[:1], change[1:] = True, m[1:] != m[:-1]
        change[start[long]] = True
        first = np.flatnonzero(change & (np.cumsum(edge[:-1], dtype=np.int8) > 0))
        if not len(first):
            continue
        text = np.searchsorted(start[long], first, side="right") - 1
        text = long[text]
        n = np.minimum(np.r_[first[1:], len(m)], (start + windows)[text]) - first
        if n.max() > RUN:  # long runs, of periodic text, are cut
            times = -(-n // RUN)
            k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            first, text, n = np.repeat(first, times) + RUN * k, np.repeat(text, times), np.minimum(np.repeat(n, times) - RUN * k, RUN)
        yield Segments(b, h, text + i, first - start[text] + base, n, first, np.minimum(first + n - 1 + of.reach, stop[text]), m[first])


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row of columns, in their order, and how often it is there."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        x = c[order]
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.r_[at, len(order)])


def _often(batches, of: Shape):
    """Keys with how many segments they have in each batch, where more than one, and the least and largest print of them."""
    nothing = Popular(np.zeros(0, np.uint64))
    for batch in batches:
        keys, prints = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for s in segments(*textops.utf8(batch.column(0)), nothing, of):
            keys.append(s.key), prints.append(s.prints(of.gram))
        key, mark = np.concatenate(keys), np.concatenate(prints)
        order = np.lexsort((mark, key))
        key, mark = key[order], mark[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[new, len(key)])
        many = size > 1
        lo, hi = mark[new[many]].view(np.int64), mark[(new + size - 1)[many]].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key[new[many]].view(np.int64)), pa.array(size[many]), pa.array(lo), pa.array(hi)], names=["key", "n", "lo", "hi"])


_GRAMS = pa.schema([("part", pa.int32()), ("h", pa.binary()), ("n", pa.binary())])


def popular_grams(docs: DataFrame, of: Shape) -> Popular:
    """Grams around keys that one segment in OFTEN documents has, not all alike, which themselves are there half as often.

    Only how the work is spread depends on them, not what is found.
    """
    sc = docs.sparkSession.sparkContext
    counted = docs.select("text").mapInArrow(lambda batches: _often(batches, of), "key bigint, n bigint, lo bigint, hi bigint").groupBy("key")
    counted = counted.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    often = max(LEAST_OFTEN, docs.count() // OFTEN)
    keys = counted.where(f"n >= {often} AND lo <> hi").orderBy(F.desc("n"), "key").limit(POPULAR).select("key").toArrow().column("key").to_numpy()
    if not len(keys):
        return Popular(np.zeros(0, np.uint64))
    shared = sc.broadcast(Popular(np.sort(keys.view(np.uint64))))
    parts = 1 << max(4, (input_bytes(docs) >> 24).bit_length())

    def around(batches):
        """Grams of a task's segments of these keys, several times there, with their counts; packed by the hash's last bits."""
        nothing, found = Popular(np.zeros(0, np.uint64)), [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for batch in batches:
            mine = [np.zeros(0, np.uint64)]
            for s in segments(*textops.utf8(batch.column(0)), nothing, of):
                key = s.key.copy()
                shared.value.mark(key)
                for i in np.flatnonzero(key != s.key).tolist():
                    mine.append(s.h[s.first[i] : s.first[i] + s.n[i] + of.span - 1])
            found.append(np.unique(np.concatenate(mine), return_counts=True))
        h, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        n = np.bincount(at, np.concatenate([f[1] for f in found])).astype(np.int64)
        part = (h % np.uint64(parts)).astype(np.int64)
        for p in range(parts):
            k = np.flatnonzero((part == p) & (n > 1))
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([h[k].tobytes()], pa.binary()), pa.array([n[k].tobytes()], pa.binary())], schema=_GRAMS)

    def add_up(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        read = lambda c, t: np.frombuffer(b"".join(rows.column(c).to_pylist()), t)
        h, at = np.unique(read("h", np.int64), return_inverse=True)
        n = np.bincount(at, read("n", np.int64)).astype(np.int64)
        return pa.table({"h": h[n >= often // 2], "n": n[n >= often // 2]})

    near = docs.select("text").mapInArrow(around, "part int, h binary, n binary").groupBy("part").applyInArrow(add_up, "h bigint, n bigint")
    top = near.orderBy(F.desc("n"), "h").limit(POPULAR * 50).select("h").toArrow()
    return Popular(np.sort(top.column("h").to_numpy().view(np.uint64)))


# ---- suffix sorting


def packed(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Seven symbols of nine bits at every place of t; places beyond the end count as symbol 0."""
    x = np.r_[t, np.zeros(depth + 14, t.dtype)].astype(np.int64)
    n = len(x) - 6
    out = np.zeros(n, np.int64)
    for j in range(7):
        out = (out << 9) | x[j : j + n]
    return out


def _coarse(key: np.ndarray) -> np.ndarray:
    """A hash of the _COARSE symbols from every place that has as many."""
    n = len(key) - _COARSE + 7
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(0, _COARSE, 7):
        out = textops.mix(out + key[j : j + len(out)].view(np.uint64) * np.uint64(_P))
    return out


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Which suffixes of t are smaller than the one after them; the last is not."""
    n = len(t)
    change = np.where(t[:-1] != t[1:], np.arange(n - 1), n)
    at = np.r_[np.minimum.accumulate(change[::-1])[::-1], n]
    out = np.zeros(n, bool)
    inside = at < n
    j = at[inside]
    out[inside] = t[j] < t[j + 1]
    return out


def _by_sevens(out: np.ndarray, at: np.ndarray, start: np.ndarray, key: np.ndarray, done: int, upto: int) -> np.ndarray:
    """Order the groups of ties out[at] by their symbols from done on, seven at a time; where groups start afterwards."""
    begins, live = start.copy(), np.arange(len(at))
    while len(live) and done < upto:
        start = begins[live]
        here = out[at[live]]
        k = key[here + done]
        differs = np.r_[False, (k[1:] != k[:-1]) & ~start[1:]]
        if differs.any():
            group = np.cumsum(start) - 1
            torn = np.zeros(group[-1] + 1, bool)
            torn[group[differs]] = True
            sub = np.flatnonzero(torn[group])
            o = sub[np.lexsort((k[sub], group[sub]))]
            here[sub], k[sub] = here[o], k[o]
            out[at[live]] = here
            start = start | np.r_[False, (k[1:] != k[:-1])]
            begins[live] = start
            live = live[~(start & np.r_[start[1:], True])]
        done += 7
    return begins


def _sort_directly(places: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """places in order of their suffixes' first depth symbols; only ties are looked at again, many symbols at once where all of a group agree."""
    k = key[places]
    order = np.argsort(k, kind="stable")
    out, k = places[order], k[order]
    start = np.r_[True, k[1:] != k[:-1]]
    at = np.arange(len(out))
    done, coarse = 7, None
    while len(at) and done < depth:
        alone = start & np.r_[start[1:], True]
        at, start = at[~alone], start[~alone]
        if not len(at):
            break
        step = min(_COARSE, depth - done)
        if step < _COARSE:
            _by_sevens(out, at, start, key, done, depth)
            break
        coarse = _coarse(key) if coarse is None else coarse
        c = coarse[out[at] + done]
        differs = np.r_[False, (c[1:] != c[:-1]) & ~start[1:]]
        if differs.any():
            group = np.cumsum(start) - 1
            torn = np.zeros(group[-1] + 1, bool)
            torn[group[differs]] = True
            sub = np.flatnonzero(torn[group])
            start = start.copy()
            start[sub] = _by_sevens(out, at[sub], start[sub], key, done, done + step)
        done += step
    return out


def suffix_array(t: np.ndarray, depth: int = LENGTH, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of t in order of the first depth symbols of their suffixes, and the packed symbols.

    Symbols are 0 to 256. Two stages: suffixes smaller than their successors are
    sorted directly; a scan of the buckets of first symbols then places before
    each suffix's left neighbour in its own bucket, in order. Where places are
    asked for, only these are sorted, and those to their right which place them.
    """
    n, key = len(t), packed(t, depth)
    small = smaller_than_next(t)
    want = np.ones(n, bool) if asked is None else asked.copy()
    if asked is not None:
        stops = np.flatnonzero(want & ~np.r_[want[1:], True] & ~small) + 1
        ends = np.flatnonzero(small)
        upto = np.r_[ends, n - 1][np.searchsorted(ends, stops)] + 1
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, stops, 1)
        np.add.at(edge, upto, -1)
        want |= np.cumsum(edge[:-1]) > 0
    t_want = t[want]
    sa = np.full(len(t_want), -1, np.int64)
    count = np.bincount(t_want, minlength=257)
    begin = np.r_[0, np.cumsum(count)[:-1]]
    n_small = np.bincount(t[small & want], minlength=257)
    direct = _sort_directly(np.flatnonzero(small & want), key, depth)
    firsts = np.r_[0, np.cumsum(n_small)[:-1]]
    rank = np.arange(len(direct)) - firsts[t[direct]]
    sa[begin[t[direct]] + count[t[direct]] - n_small[t[direct]] + rank] = direct
    head = begin.copy()
    if n and want[-1]:
        sa[head[t[-1]]] = n - 1  # larger than the empty suffix after it
        head[t[-1]] += 1
    large = want & ~small

    def induce(entries: np.ndarray) -> None:
        left = entries[entries > 0] - 1
        left = left[large[left]]
        if not len(left):
            return
        s = t[left]
        o = np.argsort(s, kind="stable")
        left, s = left[o], s[o]
        new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[new, len(s)])
        sa[np.repeat(head[s[new]] - new, size) + np.arange(len(s))] = left
        head[s[new]] += size

    for c in np.flatnonzero(count).tolist():
        done = begin[c]
        while done < head[c]:
            upto = head[c]
            induce(sa[done:upto])
            done = upto
        induce(sa[begin[c] + count[c] - n_small[c] : begin[c] + count[c]])
    return sa, key


def common_prefixes(sa: np.ndarray, key: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in sa, at most limit; 0 for the first."""
    out = np.zeros(len(sa), np.int64)
    alive = np.arange(1, len(sa))
    done, coarse = 0, _coarse(key) if limit >= _COARSE and len(alive) else None

    def by_sevens(alive: np.ndarray, done: int, upto: int) -> np.ndarray:
        while len(alive) and done < upto:
            x = key[sa[alive] + done] ^ key[sa[alive - 1] + done]
            ended = x != 0
            out[alive[ended]] = np.minimum(done + (62 - np.floor(np.log2(x[ended].astype(np.float64))).astype(np.int64)) // 9, limit)
            alive = alive[~ended]
            done += 7
        return alive

    while len(alive) and done < limit:
        step = min(_COARSE, limit - done)
        if step < _COARSE:
            alive = by_sevens(alive, done, limit)
            break
        same = coarse[sa[alive] + done] == coarse[sa[alive - 1] + done]
        by_sevens(alive[~same], done, done + step)
        alive = alive[same]
        done += step
    out[alive] = limit
    return out


def repeated_windows(parts: list[bytes], windows: list[int], of: Shape) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the parts, end to end, whether the length bytes from it are there twice, and whether the reach bytes are.

    Only the first windows of each part count; windows stay in their part.
    """
    size, n = np.array([len(p) for p in parts], np.int64), np.array(windows, np.int64)
    t = np.zeros(int(size.sum()) + len(parts), np.int16)
    start = np.r_[0, np.cumsum(size + 1)[:-1]]
    for p, a in zip(parts, start.tolist()):
        t[a : a + len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) + 1

    def first(count: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(t) + 1, np.int64)
        np.add.at(edge, start[count > 0], 1)
        np.add.at(edge, (start + count)[count > 0], -1)
        return np.cumsum(edge)[:-1] > 0

    short, long = first(n), first(np.minimum(n, np.maximum(size - of.reach + 1, 0)))
    sa, key = suffix_array(t, of.reach, short)
    sa = sa[short[sa]]
    inside = np.ones(len(t), bool)
    inside[start + size] = False
    out = []
    shared = common_prefixes(sa, key, of.reach)
    for length, ask in ((of.length, short), (of.reach, long)):
        # A larger window that is cut off by its part's end differs from its neighbour there, by the symbol between parts.
        same = np.flatnonzero(shared >= length)
        flags = np.zeros(len(t), bool)
        flags[sa[same]] = True
        flags[sa[same - 1]] = True
        out.append((flags & ask)[inside])
    return out[0], out[1]


# ---- the corpus


def _runs(flags: np.ndarray) -> np.ndarray:
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).astype(np.int32)


def may_match(bucket: list[tuple[bytes, int, int]], of: Shape) -> list[bool]:
    """Which segments of a bucket, (bytes, windows, place of the key's gram), can hold a window of another one.

    The place is -1 where the gram is there more than once. Equal windows hold
    the gram at the same place, so that counted from it they agree in of.pieces
    consecutive pieces.
    """
    seen: dict[tuple[int, int], int] = {}
    mine = []
    for text, n, at in bucket:
        first, size, end = -(at // of.piece), of.piece * of.pieces, min(len(text), n + of.length - 1)
        keys = [(j, hash(text[at + of.piece * j : at + of.piece * j + size])) for j in range(first, (end - size - at) // of.piece + 1)] if at >= 0 else []
        mine.append(keys)
        for k in keys:
            seen[k] = seen.get(k, 0) + 1
    several = any(at < 0 for _, _, at in bucket)
    return [several or any(seen[k] > 1 for k in keys) for keys in mine]


_TO_SORT = pa.schema([("key", pa.int64()), ("print", pa.int64()), ("n", pa.int64()), ("windows", pa.int32()), ("at", pa.int32()), ("text", pa.binary())])
_TO_SORT_DDL = "key bigint, print bigint, n bigint, windows int, at int, text binary"
_RUNS = pa.schema([("key", pa.int64()), ("print", pa.int64()), ("runs", pa.binary()), ("far", pa.binary())])
_RUNS_DDL = "key bigint, print bigint, runs binary, far binary"


def _sort_buckets(batches, of: Shape):
    """Windows of each distinct segment that are repeated in its bucket, as runs; the larger windows beside."""
    chunk: list[tuple[int, int, list]] = []
    bucket: dict[int, list] = {}
    load, last = 0, None

    def close():
        nonlocal load
        ask = may_match([(v[1], v[2], v[3]) for v in bucket.values()], of)
        for (f, v), sort in zip(bucket.items(), ask):
            if sort or v[0] > 1:
                chunk.append((last, f, v))
                load += len(v[1])

    def flush():
        flags = repeated_windows([v[1] for _, _, v in chunk], [v[2] for _, _, v in chunk], of)
        at, rows = 0, []
        for key, f, (n, text, windows, _) in chunk:
            mine = [x[at : at + windows] | (n > 1) for x in flags]
            mine[1][max(len(text) - of.reach + 1, 0) :] = False
            at += len(text)
            if mine[0].any():
                rows.append({"key": key, "print": f, "runs": _runs(mine[0]).tobytes(), "far": _runs(mine[1]).tobytes()})
        return pa.RecordBatch.from_pylist(rows, _RUNS)

    for batch in batches:
        for key, f, n, windows, at, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if key != last:
                close()
                bucket, last = {}, key
                if load >= CHUNK:
                    yield flush()
                    chunk, load = [], 0
            held = bucket.setdefault(f, [0, None, windows, at])
            held[0] += n
            held[1] = held[1] if text is None else text
    close()
    if chunk:
        yield flush()


_LISTED = pa.schema([("key", pa.int64()), ("print", pa.int64()), ("doc", pa.int64()), ("text_id", pa.int64()), ("p", pa.int32()), ("n", pa.int32()), ("stop", pa.int32()), ("twice", pa.bool_())])
_LISTED_DDL = "key bigint, print bigint, doc bigint, text_id bigint, p int, n int, stop int, twice boolean"
_SPANS_DDL = "doc bigint, text_id bigint, start int, stop int, far boolean"


def named(docs: DataFrame) -> DataFrame:
    """doc, text_id and text of docs: a null id counts as 0 and a null text as empty, and different texts of one id differ in text_id."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc"), F.xxhash64(text).alias("text_id"), text.alias("text"))


def spans(docs: DataFrame, length: int = LENGTH, reach: int | None = None) -> DataFrame:
    """doc, text_id, start, stop and far: byte ranges of strings of length bytes that repeat, and, far, of those of reach bytes; ranges may overlap.

    docs: doc, text_id, text. Rows that are equal in all of these have the same ranges.
    """
    spark, of = docs.sparkSession, shape(length, reach)
    popular = spark.sparkContext.broadcast(popular_grams(docs, of))

    def listed(batches):
        for batch in batches:
            ids = [batch.column(i).to_numpy() for i in range(2)]
            for s in segments(*textops.utf8(batch.column(2)), popular.value, of):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (s.key.view(np.int64), s.prints(of.gram).view(np.int64), ids[0][s.text], ids[1][s.text], s.place.astype(np.int32), s.n.astype(np.int32),
                     (s.place + s.stop - s.first).astype(np.int32), s.anchors(of.span) < 0)], schema=_LISTED,
                )

    every = materialize(docs.mapInArrow(listed, _LISTED_DDL))
    buckets = every.groupBy("key").agg(F.count("*").alias("c"), F.min("print").alias("lo"), F.max("print").alias("hi"), F.max("twice").alias("twice"))
    buckets = buckets.where("c > 1 OR twice").select("key", ((F.col("lo") == F.col("hi")) & ~F.col("twice")).alias("equal"))
    shared = materialize(every.drop("twice").join(buckets, "key"))

    bit = f"pmod(key, {FLAGS})"
    words = shared.where("NOT equal").select(F.expr(f"cast({bit} div 32 as int)").alias("w"), F.expr(f"shiftleft(1L, cast({bit} % 32 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # FLAGS bits at most
    table = np.zeros(FLAGS // 32, np.uint32)
    table[found.column("w").to_numpy()] = found.column("b").to_numpy().astype(np.uint32)
    flags = spark.sparkContext.broadcast(table)

    def texts(batches):
        """Segments whose bucket is to be sorted (and a few others): their bytes once for each task, and how often each batch has them."""
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for s in segments(*textops.utf8(batch.column(0)), popular.value, of):
                at = s.key.view(np.int64) % FLAGS
                mine = np.flatnonzero(flags.value[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1))
                if not len(mine):
                    continue
                key, mark, anchor = s.key[mine].view(np.int64), s.prints(of.gram)[mine].view(np.int64), s.anchors(of.span)[mine]
                first, n = _distinct(key, mark)
                names = list(zip(key[first].tolist(), mark[first].tolist()))
                text = [None if k in sent else s.bytes_of(i) for k, i in zip(names, mine[first].tolist())]
                sent.update(names)
                columns = (key[first], mark[first], n, s.n[mine][first].astype(np.int32), anchor[first].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(text, pa.binary())], schema=_TO_SORT)

    parts = max(spark.sparkContext.defaultParallelism * 2, input_bytes(docs) >> 22)
    # One text for each key, print and task: a key has few rows more than different segments.
    to_sort = docs.select("text").mapInArrow(texts, _TO_SORT_DDL).repartition(parts, "key").sortWithinPartitions("key")
    sorted_ = to_sort.mapInArrow(lambda batches: _sort_buckets(batches, of), _RUNS_DDL)

    whole = shared.where("equal")
    near = whole.select("doc", "text_id", F.col("p").alias("start"), (F.col("p") + F.col("n") + (of.length - 1)).alias("stop"), F.lit(False).alias("far"))
    far = whole.where(F.col("stop") - F.col("p") >= of.reach).select("doc", "text_id", F.col("p").alias("start"), "stop", F.lit(True).alias("far"))
    part = shared.where("NOT equal").join(sorted_, ["key", "print"]).select("doc", "text_id", "p", "runs", "far")

    def placed(batches):
        for batch in batches:
            rows = []
            for doc, text, p, *both in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for runs, size, is_far in list(zip(both, (of.length, of.reach), (False, True)))[: 1 + (of.reach > of.length)]:
                    rows += [(doc, text, p + a, p + z + size - 1, is_far) for a, z in np.frombuffer(runs, np.int32).reshape(-1, 2).tolist()]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], names=["doc", "text_id", "start", "stop", "far"])

    out = near.unionAll(part.mapInArrow(placed, _SPANS_DDL))
    return out.unionAll(far) if of.reach > of.length else out


def _with_spans(docs: DataFrame, keep: list, length: int, reach: int | None, name: str) -> DataFrame:
    """The columns keep of docs and, under name, the ranges of each text."""
    tune(docs.sparkSession, 500, 4)
    plain = named(docs)
    found = spans(plain, length, reach).groupBy("doc", "text_id").agg(F.collect_set(F.struct("start", "stop", "far")).alias(name))
    ids = {c: fresh_name(docs, c) for c in ("doc", "text_id")}
    rows = docs.select(*keep, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias(ids["doc"]), F.xxhash64(F.coalesce("text", F.lit(""))).alias(ids["text_id"]))
    found = found.select(*(F.col(c).alias(n) for c, n in ids.items()), name)
    return rows.join(found, list(ids.values()), "left").drop(*ids.values())


def _keep(text: bytes, cut: list | None, far: bool = False) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes go and in how many maximal runs."""
    gone = np.zeros(len(text) + 1, np.int32)
    for c in cut or ():
        if c["far"] == far:
            gone[c["start"]] += 1
            gone[min(c["stop"], len(text))] -= 1
    flags = np.cumsum(gone)[:-1] > 0
    return np.frombuffer(text, np.uint8)[~flags].tobytes(), int(flags.sum()), len(_runs(flags))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passage of every row of docs.

    n_passage counts the bytes covered by strings of PASSAGE bytes that also start
    elsewhere; nothing is removed for these. Null texts count as empty; texts
    shorter than a string keep everything. Rows that repeat one doc_id and text
    count as copies, and so do rows of equal texts without an id; different
    texts of one doc_id are judged each on its own.
    """
    rows = _with_spans(docs.select("doc_id", "text"), ["doc_id", "text"], PASSAGE, LENGTH, "cut").select(F.col("doc_id").cast("bigint"), "text", "cut")

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            cuts = batch.column(2).to_pylist()
            kept = [_keep(t, c, True) for t, c in zip(texts, cuts)]
            short = [_keep(t, c)[1] if c else 0 for t, c in zip(texts, cuts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.int64()),
                 pa.array([hashlib.sha256(k[0]).hexdigest() for k in kept], pa.string()), pa.array(short, pa.int64())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"],
            )

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage bigint")


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the bytes of repeated strings of length bytes cut out of text and n_chars, where there is one, brought up to date.

    Bytes of a character that is only partly covered go with the covered ones.
    Different texts of one doc_id are each cut by their own places; columns of
    any names stay as they are.
    """
    cut = fresh_name(docs, "cut")
    rows, place = _with_spans(docs, [docs[c] for c in docs.columns], length, None, cut), docs.columns.index("text")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            texts, cuts = batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new = [t if not c else _keep(t.encode(), c)[0].decode("utf-8", "ignore") for t, c in zip(texts, cuts)]
            columns = batch.columns[:-1]
            columns[place] = pa.array(new, pa.string())
            if size_at is not None:
                sizes = [n if t is o else len(t) for n, t, o in zip(columns[size_at].to_pylist(), new, texts)]
                columns[size_at] = pa.array(sizes, columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return rows.mapInArrow(run, docs.schema)
