"""Removal of repeated byte strings across documents, by merged Burrows-Wheeler transforms of the places that can repeat.

Texts are UTF-8 bytes. A byte goes if a string of LENGTH bytes covers it that also starts in a document with a smaller
doc_id. A string's anchor is the least hash of the GRAM-byte pieces in it, so equal strings have equal anchors, and a
string can only repeat if its anchor occurs in two documents.

0. A text that is also that of a smaller doc_id goes whole, and its strings tell no other document anything that the first
   copy doesn't. It takes no part in what follows.
1. Anchors: each batch gives every anchor of its documents once, with those that several of its documents have marked at
   once; gathering by anchor marks those that several batches have. A mark is a hash of row and anchor, so it may mark
   too much, never too little.
2. Contexts: where an anchor is marked, the strings that it is the anchor of form a run of bytes of up to
   2 * LENGTH - GRAM. Equal runs of a batch are kept once, with the least and the greatest doc_id that have them; where
   each run stands is kept with the documents.
3. Transforms: runs are dealt out by anchor. An anchor with one run needs no comparison: all its places are equal. The
   others' runs are cut into shards, each shard is transformed and the transforms are merged up to LENGTH bytes (see bwt);
   an interval of the merged order holds all equal strings, and the least doc_id of its runs is theirs.
   An anchor whose runs take more than LARGE bytes isn't held: its runs are cut into their strings, which are grouped by
   themselves over all tasks.
4. The least doc_ids of a run's strings go back to the documents that hold it, and the bytes covered by those with a
   smaller one go.

Between the steps rows travel in packed arrays: anchors and runs by ranges of the anchor, marks, places and answers by
buckets of rows. Each bucket holds about BUCKET bytes of text at most, so a task holds what one bucket needs, and a run
that any number of documents share travels once for each batch. Texts travel one to a row and are read as a stream.

Null texts count as empty, null doc_ids as smaller than all others. Rows with equal doc_ids never repeat each other.
Repeated rows get a row each; rows that agree in doc_id and text, of LENGTH bytes or more, are streamed by one task. Ties
don't arise. Empty tables give empty results. Only the id and text columns are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial
from hashlib import sha256
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bwt, shingles
from tidemark.llm.common import discard, materialized, pieces, trimmed, worker_state

LENGTH, GRAM = 50, 20
PART = 192 << 10  # bytes worked on at once, so that the arrays stay in the cache
SHARD, SHARDS = 32 << 10, 4
LARGE = 1 << 20  # bytes of the runs of one anchor that a task compares by itself
BUCKET = 32 << 20  # bytes of text to a bucket
HELD = 64 << 20  # bytes of runs that a task gathers before it looks for anchors that are too large
COPIES = 500_000  # later copies whose keys are broadcast
ROWS = 500_000  # marks or answers that are packed at once
PIECE = 8 << 20  # bytes of text whose runs a task holds at once
PACKED = 64, 512  # runs, or anchors, to a packed row: rows stay small, whatever reads them many at a time
LOWEST = -(1 << 63)
_BYTE = np.random.default_rng(19940510).integers(0, 1 << 63, 256, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.uint64(16)  # bits of row and anchor hashes that the marks do without


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, by doubling."""
    held, size, done, out = _BYTE[raw], 1, 0, None
    need = GRAM
    while True:
        if need & size:
            n = len(raw) - (done + size) + 1
            out = held[done : done + n].copy() if out is None else (out[:n] * _MIX) + held[done : done + n]
            done += size
        if done == need:
            out ^= out >> np.uint64(31)
            out *= np.uint64(0xD6E8FEB86659FD93)
            return out ^ (out >> np.uint64(32))
        held = held[:-size] * _MIX + (held[size:] ^ (held[size:] >> np.uint64(29)))
        size *= 2


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    left = width - size
    return np.minimum(x[: len(x) - left], x[left:]) if left else x


def runs(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first start, number of starts) of every run of strings with one anchor; starts within the text."""
    if len(raw) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    least = sliding_least(gram_hashes(raw), LENGTH - GRAM + 1)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    inside = np.arange(len(least)) + LENGTH <= offsets[1:][text]
    new = np.empty(len(least), bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    new &= inside
    first = np.flatnonzero(new)
    whole = np.concatenate(([0], np.cumsum(inside)))
    # a run ends where the next begins or its text has no further string
    stop = np.concatenate((first[1:], [len(least)]))
    count = whole[stop] - whole[first]
    return text[first], least[first], first - offsets[text[first]], count


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays one after the other, each behind its number of bytes."""
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return struct.pack(f"<{len(raw)}q", *map(len, raw)) + b"".join(raw)


def unpack(blob: bytes, *kinds: str) -> list:
    """The arrays of pack(); kinds are numpy's, or "" for bytes."""
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}q", blob), 8 * len(kinds), []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at) if kind else blob[at : at + size])
        at += size
    return out


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 48 as six planes of bytes, which compress better than the numbers."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(6, -1).T
    return out.view(np.uint64).ravel()


def range_of(h48: np.ndarray, buckets: int) -> np.ndarray:
    """The range of anchors, 0 to buckets - 1, that holds each of these. Anchors are the least of `width` hashes, so they
    crowd near 0; their distribution function makes the ranges hold equally many runs. Products alone, which every
    machine rounds alike."""
    width = LENGTH - GRAM + 1
    y = 1.0 - (h48 >> np.uint64(16)) / 4294967296.0
    power, square, left = np.ones_like(y), y, width
    while left:
        if left & 1:
            power = power * square
        square, left = square * square, left >> 1
    return ((1.0 - power * ((width + 1) / 2 - (width - 1) / 2 * y)) * buckets).astype(np.int64).clip(0, buckets - 1)


def mark_of(row48: np.ndarray, h48: np.ndarray) -> np.ndarray:
    return shingles.mixed(row48 * _MIX + h48)


def slices(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of each run of equal keys."""
    if len(sorted_keys):
        starts = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
        yield from zip(sorted_keys[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_keys)], strict=True)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns, of equal length, changes."""
    new = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate(([True], new))) if len(columns[0]) else np.zeros(0, np.int64)


def chunks(sorted_keys: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """slices() of `most` places at most."""
    for k, a, b in slices(sorted_keys):
        yield from ((k, i, min(i + most, b)) for i in range(a, b, most))


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(columns, types, strict=True)], names=list(names))


#: k is a range of anchors; or, of marks that are known already (d >= 0), any number
ANCHORS = "k int, d int, one binary, several binary"
MARKS = "d int, blob binary"


def _anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The anchors of each batch: those of one row with the row, those of several, and the marks of the latter."""
    worker_state("repeats")
    for batch in batches:
        rows = batch["rk"].to_numpy(zero_copy_only=False).view(np.uint64) >> _KEEP
        owners, held = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at, offsets, raw in shingles.parts(batch["text"], PART):
            text, anchor, *_ = runs(offsets, raw)
            owners.append(at + text)
            held.append(anchor >> _KEEP)
        h = np.concatenate(held)
        if not len(h):
            continue
        order = np.argsort(h)
        h, row = h[order], rows[np.concatenate(owners)[order]]
        starts = starts_of(h)
        several = np.minimum.reduceat(row, starts) != np.maximum.reduceat(row, starts)
        one, more = starts[~several], starts[several]
        out = [(k, -1, pack(planes(h[one[a:b]]), planes(row[one[a:b]])), None) for k, a, b in chunks(range_of(h[one], buckets), PACKED[1])]
        out += [(k, -1, None, planes(h[more[a:b]])) for k, a, b in chunks(range_of(h[more], buckets), PACKED[1])]
        inner = np.repeat(several, np.diff(np.append(starts, len(h))))
        out += [(buckets + d, d, blob, None) for d, blob in _packed_marks(row[inner], h[inner], buckets)]
        yield batch_of(out, ANCHORS)
    trimmed()


def _packed_marks(row: np.ndarray, h: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    d = (row % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(d, kind="stable")
    marks = mark_of(row, h)[order]
    return [(k, marks[a:b].tobytes()) for k, a, b in chunks(d[order], PACKED[1])]


def _marks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """MARKS of the anchors in several batches, from ANCHORS sorted by k; known marks pass through."""
    one: list[bytes] = []
    more: list[bytes] = []
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held, now = 0, None

    def close() -> None:
        nonlocal one, more, held
        own = [unpack(b, "", "") for b in one]
        row = np.concatenate([np.zeros(0, np.uint64), *(from_planes(r) for _, r in own)])
        h = np.concatenate([*(from_planes(x) for x, _ in own), *(from_planes(x) for x in more)]) if own or more else row
        order = np.argsort(h)
        starts = starts_of(h[order])
        sizes = np.diff(np.append(starts, len(h)))
        met = order[np.repeat(sizes > 1, sizes)]
        met = met[met < len(row)]  # those behind are of several rows, which have their marks
        found.append((row[met], h[met]))
        held += len(met)
        one, more = [], []

    def out() -> list[tuple[int, bytes]]:
        nonlocal held
        rows = _packed_marks(*(np.concatenate(x) for x in zip(*found, strict=True)), buckets) if found else []
        found.clear()
        held = 0
        return rows

    for batch in batches:
        passed = []
        for k, d, a, b in zip(batch["k"].to_pylist(), batch["d"].to_pylist(), batch["one"], batch["several"], strict=True):
            if d >= 0:
                passed.append((d, a.as_py()))
                continue
            if k != now:
                close()
                now = k
                if held > ROWS:
                    passed += out()
            (one if a.is_valid else more).append((a if a.is_valid else b).as_py())
        if passed:
            yield batch_of(passed, MARKS)
    close()
    if last := out():
        yield batch_of(last, MARKS)


PASSES = 4
#: kind 0 to PASSES - 1: runs of a range of anchors, `key`, in the pass that compares it; kind PASSES: places of a bucket of
#: rows, `key`
CONTEXTS = "kind int, key int, blob binary"
RUN = ("<u8", "<u8", "<u4", "<i4", "<i8", "<i8", "<i4", "")  # anchor, hash, number, bucket of rows, least and greatest doc, bytes, content
PLACES = ("<i8", "<i8", "<i4", "<i4", "<i4", "<u4")  # of each row its hash, doc and number of places; of each place start, starts, run


def _contexts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """CONTEXTS of the marked anchors, from marks (kind 0) and rows (kind 1) sorted by bucket d and kind. The runs of a
    task are numbered, and a bucket of rows is in one task."""
    worker_state("repeats")
    marks: list[tuple[int, np.ndarray]] = []
    seen_in, seen = -1, np.zeros(0, np.int64)  # rows of the last bucket that have been read
    numbered = 0
    for batch in pieces(batches, "text", PIECE):
        kind, d = batch["kind"].to_numpy(), batch["d"].to_numpy()
        if not len(d):
            continue
        marks = [m for m in marks if m[0] >= d[0]]
        marks += [(int(d[i]), np.frombuffer(batch["blob"][i].as_buffer(), np.uint64)) for i in np.flatnonzero(kind == 0).tolist()]
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(m for _, m in marks)]))
        marks = [(k, m.copy()) for k, m in marks if k == d[-1]]
        rk = batch["rk"].to_numpy(zero_copy_only=False) if batch["rk"].null_count == 0 else batch["rk"].fill_null(0).to_numpy(zero_copy_only=False)
        doc = batch["doc"].fill_null(0).to_numpy(zero_copy_only=False)
        # of rows that repeat one is enough
        fresh = np.zeros(len(d), bool)
        own = np.flatnonzero(kind == 1)
        fresh[own[np.unique(rk[own], return_index=True)[1]]] = True
        if seen_in == d[0]:
            fresh &= ~(np.isin(rk, seen) & (d == seen_in))
        last = rk[own[d[own] == d[-1]]]
        seen_in, seen = int(d[-1]), np.concatenate((seen, last)) if seen_in == d[-1] else last
        if not len(known):
            continue
        whole, raw_all = shingles.buffers(batch["text"])
        row48, data = rk.view(np.uint64) >> _KEEP, raw_all.tobytes()
        held: list[tuple] = []
        for at, offsets, raw in shingles.parts(batch["text"], PART):
            text, anchor, first, count = runs(offsets, raw)
            if not len(text):
                continue
            mark = mark_of(row48[at + text], anchor >> _KEEP)
            place = np.searchsorted(known, mark).clip(max=len(known) - 1)
            hit = np.flatnonzero((known[place] == mark) & fresh[at + text])
            if not len(hit):
                continue
            text, anchor, first, count = text[hit], anchor[hit], first[hit], count[hit]
            begin = offsets[text] + first
            size = count + (LENGTH - 1)
            up, down = shingles.Powers.upto(len(raw))
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
            held.append((at + text, anchor, first, count, shingles.mixed((total[begin + size] - total[begin]) * down[begin] + size.astype(np.uint64)), whole[at] + begin))
        if not held:
            continue
        text, anchor, first, count, c, begin = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = d[text].astype(np.int64)
        # a run is known by its anchor and its own hash, 128 bits together, within a bucket
        order = np.lexsort((c, anchor, bucket))
        starts = starts_of(bucket[order], anchor[order], c[order])
        number = np.empty(len(order), np.int64)
        number[order] = numbered + np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        one, docs = order[starts], doc[text[order]]
        lo, hi = np.minimum.reduceat(docs, starts), np.maximum.reduceat(docs, starts)
        numbered += len(starts)

        by = np.argsort(anchor[one], kind="stable")
        one, lo, hi = one[by], lo[by], hi[by]
        size = count[one] + (LENGTH - 1)
        contents = [data[a:b] for a, b in zip(begin[one].tolist(), (begin[one] + size).tolist(), strict=True)]
        columns = [x.astype(k) for x, k in zip((anchor[one], c[one], number[one], bucket[one], lo, hi, size), RUN, strict=False)]
        out = [(k * PASSES // buckets, k, pack(*(x[a:b] for x in columns), b"".join(contents[a:b]))) for k, a, b in chunks(range_of(anchor[one] >> _KEEP, buckets), PACKED[0])]
        for k, a, b in slices(bucket):
            rows, counts = np.unique(text[a:b], return_counts=True)
            stops = np.cumsum(counts)
            for _, i, j in slices(stops // PACKED[1]):  # whole rows, of some hundred places together
                u, v = a + (int(stops[i - 1]) if i else 0), a + int(stops[j - 1])
                columns = (rk[rows[i:j]], doc[rows[i:j]], counts[i:j], first[u:v], count[u:v], number[u:v])
                out.append((PASSES, k, pack(*(x.astype(kind) for x, kind in zip(columns, PLACES, strict=True)))))
        yield batch_of(out, CONTEXTS)
    trimmed()


def least_docs(contents: list[bytes], lo: np.ndarray) -> list[np.ndarray]:
    """For each run the least doc of each of its strings; runs differ from each other."""
    shards, at, cuts = [], 0, [0]
    while at < len(contents):
        size, begin = 0, at
        while at < len(contents) and (size < SHARD or at == begin):
            size += len(contents[at]) + 1
            at += 1
        cuts.append(at)
        shards.append(bwt.transform(contents[begin:at]))
    sizes = np.array([len(c) + 1 for c in contents])
    base = np.cumsum(sizes) - sizes
    source, place, interval = bwt.merge(shards, LENGTH)
    place = place + base[np.array(cuts[:-1])][source]
    owner = np.searchsorted(base, place, "right") - 1
    starts = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1])))
    least = np.minimum.reduceat(lo[owner], starts)
    by_place = np.empty(len(place), np.int64)
    by_place[place] = least[interval]
    return [by_place[b : b + n - LENGTH] for b, n in zip(base.tolist(), sizes.tolist(), strict=True)]


def compared(h: np.ndarray, contents: list[bytes], lo: np.ndarray, divided: np.ndarray) -> list[np.ndarray | None]:
    """For each run the least doc of each of its strings, or of all in one if its anchor has no other run; None for runs
    that `divided` leaves out. Runs come by anchor, h, and differ."""
    out: list[np.ndarray | None] = [None] * len(h)
    group: list[int] = []
    held = 0

    def close() -> None:
        nonlocal group, held
        if group:
            for r, x in zip(group, least_docs([contents[r] for r in group], lo[group]), strict=True):
                out[r] = x
        group, held = [], 0

    for _, a, b in slices(h):
        if divided[a]:
            continue
        if b - a == 1:
            out[a] = lo[a:b]
            continue
        group += range(a, b)
        held += sum(len(contents[r]) + 1 for r in range(a, b))
        if held >= SHARD * SHARDS:
            close()
    close()
    return out


#: answers for a bucket of rows, d; or, of an anchor that is too large, a run of such a bucket
MERGED = "d int, i long, hi long, lo long, content binary, blob binary"
ANSWER = ("<u4", "<i4", "<i4", "<i8")  # of each run its number and number of segments; of each segment its first start and least doc


def segmented(least: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of segments of each, their first places, their values): runs of equal values of arrays."""
    sizes = np.array([len(x) for x in least], np.int64)
    ends = np.cumsum(sizes)
    whole = np.concatenate([np.zeros(0, np.int64), *least])
    new = np.ones(len(whole), bool)
    new[1:] = whole[1:] != whole[:-1]
    new[(ends - sizes)[sizes > 0]] = True
    at = np.flatnonzero(new)
    owner = np.searchsorted(ends, at, "right")
    return np.bincount(owner, minlength=len(sizes)), at - (ends - sizes)[owner], whole[at]


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, count of them, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def answers(d: np.ndarray, i: np.ndarray, count: np.ndarray, at: np.ndarray, least: np.ndarray) -> list[tuple[int, bytes]]:
    """(bucket, ANSWER packed) of runs numbered i in buckets d, with count segments each, one after the other."""
    order = np.argsort(d, kind="stable")
    begin = (np.cumsum(count) - count)[order]
    picked = spread(begin, count[order])
    d, i, count, at, least = d[order], i[order], count[order], at[picked], least[picked]
    ends = np.concatenate(([0], np.cumsum(count)))
    return [(k, pack(i[a:b].astype("<u4"), count[a:b].astype("<i4"), at[ends[a] : ends[b]].astype("<i4"), least[ends[a] : ends[b]].astype("<i8"))) for k, a, b in slices(d)]


def _merged(batches: Iterator[pa.RecordBatch], large: int) -> Iterator[pa.RecordBatch]:
    """MERGED of the runs (key, blob), which come sorted by key."""
    worker_state("repeats")
    pending: list[bytes] = []
    found: list[tuple] = []
    size, enough, held, now = 0, HELD, 0, None
    divided: set[int] = set()  # anchors of this range that are too large

    def close(final: bool) -> list[tuple]:
        """Compares what is pending; unless final, only takes out what is too large and joins equal runs."""
        nonlocal pending, size, enough, held
        if not pending:
            return []
        own = [unpack(b, *RUN) for b in pending]
        h, c, i, d, lo, hi, sizes = (np.concatenate(x) for x in list(zip(*own, strict=True))[:7])
        text = b"".join(x[7] for x in own)
        ends = np.cumsum(sizes, dtype=np.int64)
        order = np.lexsort((c, h))
        h, c, i, d, lo, hi = h[order], c[order], i[order], d[order], lo[order], hi[order]
        starts = starts_of(h, c)
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
        first = order[starts]
        contents = [text[a:b] for a, b in zip((ends - sizes)[first].tolist(), ends[first].tolist(), strict=True)]
        run_lo, run_h = np.minimum.reduceat(lo, starts), h[starts]
        # anchors whose runs take more than `large` bytes
        groups = starts_of(run_h)
        members = np.diff(np.append(groups, len(run_h)))
        too = (np.add.reduceat(sizes[first].astype(np.int64) + 1, groups) > large) & (members > 1)
        too |= np.isin(run_h[groups], np.fromiter(divided, np.uint64, len(divided)))
        divided.update(run_h[groups[too]].tolist())
        apart = np.repeat(too, members)
        out = [(int(d[e]), int(i[e]), int(hi[e]), int(lo[e]), contents[run[e]], None) for e in np.flatnonzero(apart[run]).tolist()]
        if not final:
            rest = np.flatnonzero(~apart[run])
            columns = [x[rest] for x in (h, c, i, d, lo, hi)]
            pending = [pack(*(x.astype(k) for x, k in zip(columns, RUN, strict=False)), np.array([len(contents[r]) for r in run[rest]], "<i4"), b"".join([contents[r] for r in run[rest].tolist()]))] if len(rest) else []
            size = sum(map(len, pending))
            enough = max(HELD, 2 * size)
            return out
        pending, size, enough = [], 0, HELD
        divided.clear()
        least = compared(run_h, contents, run_lo, apart)
        none = np.zeros(0, np.int64)
        count, at, value = segmented([none if x is None else x for x in least])
        begin = np.cumsum(count) - count
        lowest = np.minimum.reduceat(np.append(value, np.iinfo(np.int64).max), begin) if len(begin) else none
        wanted = np.flatnonzero((count[run] > 0) & (lowest[run] < hi))
        r = run[wanted]
        picked = spread(begin[r], count[r])
        found.append((d[wanted].astype(np.int64), i[wanted], count[r], at[picked], value[picked]))
        held += len(wanted)
        return out

    def answered() -> list[tuple]:
        nonlocal held
        rows = answers(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else []
        found.clear()
        held = 0
        return [(d, None, None, None, None, blob) for d, blob in rows]

    for batch in batches:
        out = []
        for key, blob in zip(batch["key"].to_pylist(), batch["blob"], strict=True):
            if key != now:
                out += close(True)
                now = key
                if held > ROWS:
                    out += answered()
            pending.append(blob.as_py())
            size += len(pending[-1])
            if size > enough:
                out += close(False)
        if out:
            yield batch_of(out, MERGED)
    if last := [*close(True), *answered()]:
        yield batch_of(last, MERGED)
    trimmed()


def by_string(rest: DataFrame) -> DataFrame:
    """d, i, hi, least of runs (d, i, hi, lo, content), for anchors of any size: the strings are grouped by themselves."""
    starts = F.sequence(F.lit(1), F.length("content") - (LENGTH - 1))
    strings = rest.select("d", "i", "hi", "lo", F.posexplode(F.transform(starts, lambda k: F.substring("content", k, F.lit(LENGTH)))).alias("at", "s"))
    # written, so that the join's sides are plain shuffles, which the planner splits where a string is hot
    least = materialized(strings.groupBy("s").agg(F.min("lo").alias("least")), "strings")
    own = strings.join(least, "s").groupBy("d", "i", "hi").agg(F.sort_array(F.collect_list(F.struct("at", "least"))).alias("own"))
    return own.select("d", "i", "hi", F.col("own.least").alias("least"))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d and ANSWER of runs (d, i, hi, least)."""
    for batch in batches:
        if batch.num_rows:
            least = [np.array(x, np.int64) for x in batch["least"].to_pylist()]
            d, i = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("d", "i"))
            yield batch_of(answers(d, i, *segmented(least)), MARKS)


def spans(replies: list[bytes], places: list[bytes]) -> dict[int, np.ndarray]:
    """For each row of a bucket, by its hash, the intervals (from, to) of bytes that go."""
    if not replies or not places:
        return {}
    i, count, at, least = (np.concatenate(x) for x in zip(*(unpack(b, *ANSWER) for b in replies), strict=True))
    rk, doc, per, start, n, run = (np.concatenate(x) for x in zip(*(unpack(b, *PLACES) for b in places), strict=True))
    begin = np.cumsum(count, dtype=np.int64) - count
    order = np.argsort(i)
    where = np.searchsorted(i[order], run).clip(max=len(i) - 1)
    hit = np.flatnonzero(i[order][where] == run)
    reply = order[where[hit]]
    owner = np.repeat(np.arange(len(rk)), per)[hit]
    # of each segment of a place its first and last start
    segment = spread(begin[reply], count[reply].astype(np.int64))
    place = np.repeat(np.arange(len(hit)), count[reply])
    final = np.zeros(len(segment), bool)
    final[np.cumsum(count[reply], dtype=np.int64) - 1] = True
    stop = np.where(final, n[hit][place], np.append(at, 0)[segment + 1])
    gone = np.flatnonzero(least[segment] < doc[owner[place]])
    first = start[hit][place][gone].astype(np.int64)
    pairs = np.stack((first + at[segment[gone]], first + stop[gone] - 1 + LENGTH), axis=1)
    return {int(rk[k]): pairs[a:b] for k, a, b in slices(owner[place[gone]])}


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DIGEST of rows (kind 2), from answers (kind 0), places (kind 1) and rows sorted by bucket d and kind."""
    worker_state("repeats")
    now: int | None = None
    parts: tuple[list[bytes], list[bytes]] = ([], [])
    gone: dict[int, np.ndarray] | None = None
    for batch in batches:
        rows = []
        columns = [batch[c].to_pylist() for c in ("kind", "d", "rk", "doc_id")]
        for k, (kind, d, rk, doc_id) in enumerate(zip(*columns, strict=True)):
            if d != now:
                now, parts, gone = d, ([], []), None
            if kind < 2:
                parts[kind].append(batch["blob"][k].as_py())
                continue
            if gone is None:
                gone, parts = spans(*parts), ([], [])
            text = batch["text"][k]
            raw = text.as_buffer() if text.is_valid else b""
            size, own = len(raw), gone.get(rk)
            if own is None:
                rows.append((doc_id, size, 0, 0, sha256(raw).hexdigest()))
                continue
            change = np.zeros(size + 1, np.int32)
            np.add.at(change, own[:, 0], 1)
            np.add.at(change, own[:, 1], -1)
            out = np.cumsum(change[:-1]) > 0
            n_spans = int(out[0]) + int(np.count_nonzero(out[1:] & ~out[:-1]))
            rows.append((doc_id, size, int(np.count_nonzero(out)), n_spans, sha256(np.frombuffer(raw, np.uint8)[~out]).hexdigest()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in DIGEST.split(", ")])


def later_copies(long: DataFrame) -> DataFrame:
    """doc_id, rk and n (bytes) of rows whose whole text also is that of a smaller doc. Every byte of them goes, and their
    strings have no least doc that the first copy's don't have, so nothing else needs them. Texts are told apart by two
    hashes of 64 bits and their sizes."""
    texts = long.select("doc_id", "doc", "rk", F.octet_length("text").cast("long").alias("n"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    texts = materialized(texts, "texts")
    several = texts.groupBy("h", "g", "n").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").drop("last")
    # written, so that the join's sides are plain shuffles, which the planner splits where a text is hot
    several = materialized(several, "several")
    out = materialized(texts.join(several, ["h", "g", "n"]).filter("doc > first").select("doc_id", "rk", "n"), "copies")
    discard(texts)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    spark = docs.sparkSession
    own = F.col(id_col).cast("long")
    rows = docs.select(own.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(own, F.lit(LOWEST)).alias("doc"))
    rows = rows.withColumn("rk", F.xxhash64("doc", "text"))
    long = rows.filter(F.octet_length("text") >= LENGTH)
    copies = later_copies(long)
    again = copies.count()
    if again > COPIES:
        long = materialized(long.join(copies.select("rk"), "rk", "left_anti"), "firsts", "zstd")
    elif again:
        long = long.join(F.broadcast(copies.select("rk").distinct()), "rk", "left_anti")
    total = long.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # a task sends a row or more to each bucket, so few of them
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / BUCKET))
    d = (F.shiftrightunsigned("rk", int(_KEEP)) % buckets).cast("int")

    def none(kind: str, name: str):
        return F.lit(None).cast(kind).alias(name)

    anchors = long.select("rk", "text").mapInArrow(partial(_anchors, buckets=buckets), ANCHORS)
    marks = materialized(anchors.repartition("k").sortWithinPartitions("k").mapInArrow(partial(_marks, buckets=buckets), MARKS), "marks")

    marked = marks.select("d", F.lit(0).alias("kind"), none("long", "rk"), none("long", "doc"), none("string", "text"), "blob")
    read = marked.unionByName(long.select(d.alias("d"), F.lit(1).alias("kind"), "rk", "doc", "text", none("binary", "blob")))
    met = read.repartition("d").sortWithinPartitions("d", "kind").mapInArrow(partial(_contexts, buckets=buckets), CONTEXTS)
    met = materialized(met, "contexts", "zstd", by="kind")
    discard(marks)

    # range after range, so that only one pass's runs are on disk twice
    merged = None
    for k in range(PASSES):
        found = met.filter(F.col("kind") == k).select("key", "blob").repartition("key").sortWithinPartitions("key")
        part = materialized(found.mapInArrow(partial(_merged, large=large), MERGED), "merged", "zstd")
        discard(met, f"kind={k}")
        merged = part if merged is None else merged.unionByName(part)
    replies, rest = merged.filter("content IS NULL").select("d", "blob"), merged.filter("content IS NOT NULL")
    if rest.limit(1).count():
        strings = by_string(rest).filter(F.array_min("least") < F.col("hi"))
        replies = replies.unionByName(materialized(strings.mapInArrow(_answers, MARKS), "divided"))

    blank = (none("long", "rk"), none("long", "doc_id"), none("string", "text"), "blob")
    answered = replies.select("d", F.lit(0).alias("kind"), *blank)
    places = met.filter(F.col("kind") == PASSES).select(F.col("key").alias("d"), F.lit(1).alias("kind"), *blank)
    texts = long.select(d.alias("d"), F.lit(2).alias("kind"), "rk", "doc_id", "text", none("binary", "blob"))
    dealt = answered.unionByName(places).unionByName(texts).repartition("d").sortWithinPartitions("d", "kind")
    # shorter texts hold no string, so they need no bucket
    short = rows.filter(F.octet_length("text") < LENGTH).select(F.lit(-1).alias("d"), F.lit(2).alias("kind"), "rk", "doc_id", "text", none("binary", "blob"))
    whole = copies.select("doc_id", F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(sha256().hexdigest()).alias("kept_sha256"))
    return dealt.mapInArrow(_removed, DIGEST).unionByName(short.mapInArrow(_removed, DIGEST)).unionByName(whole)
