"""Vectorised text primitives shared by the operators of this subpackage.

All functions work on one flat byte buffer that holds many texts back to back, so that the cost of a text is a few
numpy passes over its bytes and not a Python loop over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII letters and digits, and every byte of a non-ASCII character.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, everything else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def keep_batches_small(spark, records: int = 1024) -> None:
    """Bound what one Arrow batch holds: few rows, and the byte limit for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, count=len(column) + 1, offset=column.offset * 8)
    data = column.buffers()[2]
    start, end = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    buf = np.frombuffer(data, np.uint8, count=end - start, offset=start) if data is not None and end > start else np.zeros(0, np.uint8)
    return buf, offsets - start if len(column) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most so many bytes of text each (a longer single text is a run of its own)."""
    lengths = flat_lengths(batch.column(batch.schema.get_field_index(column)))
    first, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if len(lengths) > first:
        yield batch.slice(first)


def flat_lengths(column: pa.Array) -> np.ndarray:
    return np.diff(flat(column)[1])


def runs(inside: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run never crosses from one text to the next."""
    n, cuts = len(inside), np.unique(offsets[:-1])
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, n, chunk):  # whole buffers of flags are never copied
        hi = min(n, lo + chunk)
        here, fresh = inside[lo:hi], np.zeros(hi - lo, bool)
        fresh[cuts[np.searchsorted(cuts, lo) : np.searchsorted(cuts, hi)] - lo] = True
        before = np.concatenate(([lo > 0 and inside[lo - 1]], here[:-1]))
        starts.append(np.flatnonzero(here & (fresh | ~before)) + lo)
        ends.append(np.flatnonzero(before & (fresh | ~here)) + lo)
    if n and inside[n - 1]:
        ends.append(np.array([n]))
    return np.concatenate(starts), np.concatenate(ends)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words between white space."""
    starts, ends = runs(~IS_SPACE[buf], offsets)
    return starts, ends, owner(starts, offsets)


def owner(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, side="right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of hashes spread over all bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The byte spans (ascending, not overlapping) as a dictionary array: equal indices are equal bytes, exactly."""
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    data = buf[np.cumsum(edge[:-1], dtype=np.int8, out=edge[:-1]).astype(bool)]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()


def span_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span: the same for equal bytes, different for different ones."""
    return spans(buf, starts, ends).indices.to_numpy() if len(starts) else np.zeros(0, np.int32)


_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x << U64(by) | x >> U64(64 - by)


def _xxh64(bytes_: np.ndarray, eights: np.ndarray, fours: np.ndarray, at: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        at, seed_, size = at.copy(), U64(seed), (ends - at).astype(U64)
        lane = lambda x: _turn(x * _P2, 31) * _P1
        h = np.full(len(at), seed_ + _P5)
        long = np.flatnonzero(size >= U64(32))
        if len(long):
            v = [np.full(len(long), seed_ + x) for x in (_P1 + _P2, _P2, U64(0), U64(0) - _P1)]
            live = np.arange(len(long))
            while len(live):
                p = at[long[live]]
                for k in range(4):
                    v[k][live] = _turn(v[k][live] + eights[p + 8 * k] * _P2, 31) * _P1
                at[long[live]] += 32
                live = live[ends[long[live]] - at[long[live]] >= 32]
            whole = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for x in v:
                whole = (whole ^ lane(x)) * _P1 + _P4
            h[long] = whole
        h += size
        for _ in range(3):
            live = np.flatnonzero(ends - at >= 8)
            h[live] = _turn(h[live] ^ lane(eights[at[live]]), 27) * _P1 + _P4
            at[live] += 8
        live = np.flatnonzero(ends - at >= 4)
        h[live] = _turn(h[live] ^ fours[at[live]].astype(U64) * _P1, 23) * _P2 + _P3
        at[live] += 4
        for _ in range(3):
            live = np.flatnonzero(ends > at)
            h[live] = _turn(h[live] ^ bytes_[at[live]].astype(U64) * _P5, 11) * _P1
            at[live] += 1
        h = (h ^ h >> U64(33)) * _P2
        h = (h ^ h >> U64(29)) * _P3
        return h ^ h >> U64(32)


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42, block: int = 1 << 14, most: int = 1 << 10) -> np.ndarray:
    """The XXH64 of each byte span, which may overlap: many short spans in step with each other, long ones one by one."""
    out = np.empty(len(starts), U64)
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))
    fours = np.ndarray(len(buf) + 1, "<u4", padded, 0, (1,))
    for lo in range(0, len(starts), block):
        s, e = starts[lo : lo + block], ends[lo : lo + block]
        short = e - s <= most
        if short.all():
            out[lo : lo + block] = _xxh64(padded, eights, fours, s, e, seed)
            continue
        at = np.flatnonzero(short) + lo
        out[at] = _xxh64(padded, eights, fours, starts[at], ends[at], seed)
        for i in (np.flatnonzero(~short) + lo).tolist():
            out[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed)
    return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The XXH64 (seed 42) of each span."""
    return xxh64(buf, starts, ends)


def shingles(buf: np.ndarray, offsets: np.ndarray, words_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words with one space between (bytes), and starts, ends and text numbers of their shingles in there.

    A shingle is a run of so many words; a text of fewer is one shingle, a text without a word has none.
    """
    space = IS_SPACE[buf]
    starts, ends = runs(~space, offsets)
    doc = owner(starts, offsets)
    gap = space[np.minimum(ends, len(buf) - 1)] & (ends < len(buf)) if len(starts) else np.zeros(0, bool)
    # each word keeps the white space after it, if there is any, as one space
    keep = ~space
    keep[ends[gap]] = True
    joined = np.where(space[keep], np.uint8(32), buf[keep])
    size = ends - starts
    starts = np.cumsum(size + gap) - (size + gap)
    ends = starts + size
    last = np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))[doc] if len(doc) else doc  # one past the text's last word
    at = np.arange(len(doc))
    first = np.flatnonzero((at + words_ <= last) | np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else at
    return joined, starts[first], ends[np.minimum(first + words_, last[first]) - 1], doc[first]


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags (one per byte) each text has."""
    return np.fromiter((np.count_nonzero(flags[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.int64, len(offsets) - 1)
