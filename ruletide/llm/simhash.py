"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has bit i set where more than half of its shingles' XXH64 values do. Distinct fingerprints are dealt
to buckets by every pair of radius + 2 bit blocks: two fingerprints within the radius agree on two blocks at least, so they
meet in some bucket and no link is lost. Inside a bucket 64 fingerprints share one word per bit (the bit planes); a query
meets a whole word at once, carry-save adders count the differing bits of the 64 lanes in parallel, and a word is abandoned
as soon as all its lanes exceed the radius. Only a spanning star of each bucket's links leaves the task.

Equal fingerprints are collapsed before anything is compared; buckets over SLICE fingerprints are cut into pairs of slices,
each a task of its own, so no bucket has to fit into one task.

Nulls and texts without a word have fingerprint zero and link like any other. A null id never becomes a component id unless
the whole component has none. Other columns of the input are ignored.

`near_links` is the same comparison at a wide radius, for sets of shingles that are 0.8 alike: 512 bits a set, and buckets by
tables of drawn bits instead of block pairs (so many blocks would be a bit or two wide). Near copies meet in most tables, so
the first few tables join most of a group; the others compare all the same, but emit links between components of those only,
not one more link a table for every member. An exact check has to follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruletide.llm import textkit as tk
from ruletide.llm.graph import components

SEED = 42
SLICE = 8192
WIDE = 8  # 64-bit words of a wide fingerprint
CARRIED = 3  # of its words that meet in a bucket
FIRST = 4  # tables whose links are components before the other tables look for more
NEAR_WORD, NEAR, NEAR_WIDE = 24, 55, 130  # differing bits allowed in the first word, in those carried, and in all
#: The greatest chance that a bit differs between two sets 0.8 alike, over all sizes; and between sets of 4 and of 5, the only pair above it.
DIFFER, DIFFER_FEW, FEW = 0.1612, 0.1875, 5
MISSED = 5e-5
_U = np.uint64


#: The bits of a byte, one in each byte of a long.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(_U).ravel()


def bit_counts(h: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """(texts, 64): how many of a text's hashes have each bit; doc ascends."""
    counts = np.zeros((texts, 64), np.int64)
    if not len(h):
        return counts
    # runs of one text and 255 hashes at most: a byte holds their count
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    inside = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    cut = np.flatnonzero(first | (inside % 255 == 0))
    home = np.flatnonzero(first[cut])
    for k in range(8):
        part = np.add.reduceat(_SPREAD[(h >> _U(8 * k)).astype(np.uint8)], cut)
        counts[doc[cut[home]], 8 * k : 8 * k + 8] = np.add.reduceat(part.view(np.uint8).reshape(-1, 8), home, axis=0, dtype=np.int64)
    return counts


def fingerprints(column: pa.Array, words: int = 3, block: int = 1 << 20) -> np.ndarray:
    """The 64-bit fingerprint of each text of a column."""
    buf, off = tk.flat(column)
    joined, starts, ends, doc = tk.shingles(tk.LOWER[buf], off, words)
    counts, texts = np.zeros((len(off) - 1, 64), np.int64), len(off) - 1
    for lo in range(0, len(doc), block):
        at = slice(lo, lo + block)
        counts += bit_counts(tk.xxh64(joined, starts[at], ends[at], SEED), doc[at], texts)
    total = np.bincount(doc, minlength=texts)
    return np.packbits(counts * 2 > total[:, None], axis=1, bitorder="little").view(_U).ravel()


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""
    tk.keep_batches_small(docs.sparkSession)

    @F.arrow_udf("long")
    def of(text: pa.Array) -> pa.Array:
        parts = tk.slices(pa.RecordBatch.from_arrays([text], ["text"]), "text", 1 << 20)
        return pa.array(np.concatenate([fingerprints(b.column(0), words) for b in parts] or [np.zeros(0, _U)]).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("fp"))


def blocks(radius: int) -> list[tuple[int, int]]:
    """Shift and width of radius + 2 blocks that make up 64 bits."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(n)]


def _keys(radius: int) -> list:
    """One long for each pair of blocks: the pair's number, then both blocks' bits."""
    parts = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in blocks(radius)]
    widths = [w for _, w in blocks(radius)]
    return [F.lit(k << (widths[i] + widths[j])) + F.shiftleft(parts[i], widths[j]) + parts[j] for k, (i, j) in enumerate(combinations(range(radius + 2), 2))]


def bit_planes(lanes: np.ndarray) -> np.ndarray:
    """(64, words) from words * 64 values: word w of plane b holds bit b of its 64 values."""
    out = np.empty((64, len(lanes) // 64), _U)
    for at in range(0, out.shape[1], 2048):
        part = lanes[at * 64 : (at + 2048) * 64].reshape(-1, 64)
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 64, 8), axis=2, bitorder="little")
        packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
        out[:, at : at + len(part)] = np.ascontiguousarray(packed).view(_U)[:, :, 0]
    return out


def _over(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose carry-save count (ones, twos, fours, ...) exceeds the radius."""
    more, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for i in reversed(range(len(count))):
        if radius >> i & 1:
            same = same & count[i]
        else:
            more = more | (same & count[i])
            same = same & ~count[i]
    return more


def within(planes: np.ndarray, queries: np.ndarray, at: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (positions in queries/at) with a lane within the radius, and the mask of those lanes.

    queries: a value for each block; at: the word of the planes it meets. Four planes are added at a time by two levels of
    carry-save adders; blocks with no lane left are dropped every eight planes.
    """
    left, levels = np.arange(len(queries)), max(3, (64).bit_length())
    count = [np.zeros(len(queries), _U) for _ in range(levels)]
    for b in range(0, 64, 4):
        x = [planes[b + k][at] ^ (_U(0) - (queries >> _U(b + k) & _U(1))) for k in range(4)]
        u = count[0] ^ x[0]
        one = (count[0] & x[0]) | (u & x[1])
        s = u ^ x[1]
        v = s ^ x[2]
        two = (s & x[2]) | (v & x[3])
        count[0] = v ^ x[3]
        w = count[1] ^ one
        carry = (count[1] & one) | (w & two)
        count[1] = w ^ two
        for i in range(2, levels):
            count[i], carry = count[i] ^ carry, count[i] & carry
        if b % 8 == 4:
            live = np.flatnonzero(_over(count, radius) != ~_U(0))
            if len(live) < len(left):
                left, queries, at = left[live], queries[live], at[live]
                count = [c[live] for c in count]
            if not len(left):
                break
    return left, ~_over(count, radius)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least reachable index of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def star_links(keys: np.ndarray, values: np.ndarray, radius: int, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of every component inside the runs of equal keys; singletons give nothing."""
    member, root = stars(keys, values, radius, most)
    return values[member], values[root]


def stars(keys: np.ndarray, values: np.ndarray, radius: int, most: int = 1 << 17, more: list[np.ndarray] | None = None, total: int = 0, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of what `star_links` returns. more: further words of each value; all words together may differ in total bits.

    label: what each value belongs to already; then spanning links between labels that differ, the least as root.
    """
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(keys)))
    start, size = start[size > 1], size[size > 1]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n_words = -(-size // 64)
    first = np.concatenate(([0], np.cumsum(n_words)))
    owner = np.repeat(np.arange(len(start)), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = start[owner] + inside
    value = values[place]
    stands, which = (place, None) if label is None else np.unique(label[place], return_inverse=True)
    lane = first[owner] * 64 + inside
    lanes, valid = np.zeros(first[-1] * 64, _U), np.zeros(first[-1] * 64, bool)
    lanes[lane], valid[lane] = value, True
    node = np.zeros(len(lanes), np.int64)
    node[lane] = np.arange(len(value))
    mask = np.packbits(valid, bitorder="little").view(_U)
    planes = bit_planes(lanes)
    own = lane // 64
    meets = first[owner + 1] - own  # a query meets its own word and the later ones of its bucket
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    upto = np.concatenate(([0], np.cumsum(meets)))
    for lo in range(0, int(upto[-1]), most):
        hi = min(int(upto[-1]), lo + most)
        block = np.arange(lo, hi)
        query = np.searchsorted(upto, block, side="right") - 1
        word = own[query] + (block - upto[query])
        left, near = within(planes, value[query], word, radius)
        near &= mask[word[left]]
        left, near = left[near != 0], near[near != 0]
        hit = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, col = np.nonzero(hit)
        x, y = query[left[row]], node[word[left[row]] * 64 + col]
        x, y = x[x < y], y[x < y]
        if more is not None:
            far = sum((np.bitwise_count(w[place[x]] ^ w[place[y]]) for w in more), np.bitwise_count(value[x] ^ value[y]).astype(np.int16))
            x, y = x[far <= total], y[far <= total]
        if which is not None:
            x, y = which[x], which[y]
            x, y = x[x != y], y[x != y]
        a, b = np.concatenate((a, x)), np.concatenate((b, y))
        if len(a) > 1 << 20:  # keep only a spanning star of what is known
            root = _roots(len(stands), a, b)
            a = np.flatnonzero(root != np.arange(len(root)))
            b = root[a]
    root = _roots(len(stands), a, b)
    member = np.flatnonzero(root != np.arange(len(root)))
    return stands[member], stands[root[member]]


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The columns of longs as arrays (columns, rows) that hold whole runs of the first one."""
    held: list[np.ndarray] = []
    n = 0

    def flush(last: bool) -> np.ndarray:
        nonlocal held, n
        rows = np.concatenate(held, axis=1)
        cut = rows.shape[1] if last else int(np.searchsorted(rows[0], rows[0, -1], side="left"))
        held, n = [rows[:, cut:]], rows.shape[1] - cut
        return rows[:, :cut]

    for batch in batches:
        if len(batch):
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            n += len(batch)
            if n >= 100_000:
                yield flush(False)
    if n:
        yield flush(True)


def _link(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole_runs(batches):
        a, b = star_links(rows[0], rows[1].view(_U), radius)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _cut(keyed: DataFrame, value: str) -> list[DataFrame]:
    """The buckets of keyed; those of more than SLICE rows apart, as tiles of two slices each with keys of their own."""
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SLICE).checkpoint()
    if not large.count():
        return [keyed]
    k = F.ceil(F.col("n") / SLICE).cast("int")
    rest = [c for c in keyed.columns if c != "key"]
    tiles = keyed.join(large, "key").select("key", *rest, F.pmod(F.xxhash64(value), k).cast("long").alias("s"), F.explode(F.sequence(F.lit(0), k - 1)).alias("t"))
    tiles = tiles.select(F.xxhash64("key", F.least("s", "t"), F.greatest("s", "t")).alias("key"), *rest)
    return [keyed.join(large, "key", "left_anti").select("key", *rest), tiles]


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints `fp` of nodes that differ in radius bits at most."""
    keyed = nodes.select("fp", F.explode(F.array(*_keys(radius))).alias("key"))
    join = lambda df, *by: df.repartition(*by).sortWithinPartitions("key").mapInArrow(lambda it: _link(radius, it), "a long, b long")
    return reduce(DataFrame.union, [join(part, "key") for part in _cut(keyed.select("key", "fp"), "fp")])


def wide_fingerprints(h: np.ndarray, edge: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """(sets, WIDE): the fingerprint of each set of hashes (back to back, n + 1 offsets); later words have the bits of remixed hashes."""
    sets, size = len(edge) - 1, np.diff(edge)
    doc, out = np.repeat(np.arange(sets), size), np.empty((sets, WIDE), _U)
    for k in range(WIDE):
        counts = np.zeros((sets, 64), np.int64)
        for lo in range(0, len(h), block):
            part = h[lo : lo + block]
            counts += bit_counts(tk.mix(part + _U(k)) if k else part, doc[lo : lo + block], sets)
        out[:, k] = np.packbits(counts * 2 > size[:, None], axis=1, bitorder="little").view(_U).ravel()
    return out


def tables(width: int, differ: float, most: float = MISSED) -> int:
    """How many tables of so many drawn bits it takes until a pair whose bits differ with that chance agrees on none but with chance `most`."""
    n = 64 * WIDE
    far = [comb(n, d) * differ**d * (1 - differ) ** (n - d) for d in range(n + 1)]
    agree = [comb(n - d, width) / comb(n, width) for d in range(n + 1)]
    count = 1
    while sum(p * (1 - q) ** count for p, q in zip(far, agree, strict=True)) > most:
        count += 1
    return count


def bucket_bits(nodes: int) -> int:
    """Bits of a table, so that a bucket holds about 512 of the nodes."""
    return max(9, round(log2(max(nodes, 1))) - 9)


def drawn_bits(width: int, count: int) -> np.ndarray:
    """(count, width): the bits of each table, cut from shuffles of all bits one after another."""
    rng, per = np.random.RandomState(SEED), 64 * WIDE // width
    return np.concatenate([rng.permutation(64 * WIDE)[: per * width].reshape(per, width) for _ in range(-(-count // per))])[:count]


def _bands(width: int, least: int, count: int, more: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, label, words) for the tables from least to count; sets of FEW shingles or fewer are in more tables."""
    drawn = drawn_bits(width, more)
    for batch in batches:
        node, label, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        fp = batch.column(3).flatten().to_numpy().reshape(-1, WIDE)
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
        for here, to in ((np.flatnonzero(size > FEW), count), (np.flatnonzero(size <= FEW), more)):
            if not len(here):
                continue
            keys = bits[here][:, drawn[least:to]].astype(np.int64) @ (1 << np.arange(width)) + (np.arange(least, to) << width)
            again = np.repeat(here, to - least)
            columns = [keys.ravel(), node[again], label[again], *(fp[again, k] for k in range(CARRIED))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "label", *(f"f{k}" for k in range(CARRIED))])


def _link_near(total: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, _, label, *fp in _whole_runs(batches):
        fp = [w.view(_U) for w in fp]
        a, b = stars(key, fp[0], NEAR_WORD, 1 << 15, fp[1:], total, label)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _joined(keyed: DataFrame, total: int) -> DataFrame:
    """Spanning links (a, b) between labels with nodes of one key and close fingerprints; a star's hub is its least label, so buckets agree on it."""
    join = lambda df: df.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda it: _link_near(total, it), "a long, b long")
    return reduce(DataFrame.union, [join(part) for part in _cut(keyed, "node")])


def near_links(nodes: DataFrame) -> DataFrame:
    """Spanning links (a, b) between nodes with close wide fingerprints: two sets 0.8 alike or more get connected but with chance MISSED.

    nodes: node (long, distinct), size and fp, the words of `wide_fingerprints`.
    """
    width = bucket_bits(nodes.count())
    count, more = tables(width, DIFFER), tables(width, DIFFER_FEW)
    schema = ", ".join(f"{c} long" for c in ("key", "node", "label", *(f"f{k}" for k in range(CARRIED))))

    def met(labelled: DataFrame, least: int, count: int, more: int) -> DataFrame:
        """(node, root) of the labels that meet in the tables from least on."""
        rows = labelled.select("node", "label", "size", "fp").mapInArrow(lambda it: _bands(width, least, count, more, it), schema)
        return components(_joined(rows, NEAR))

    soon = met(nodes.withColumn("label", F.col("node")), 0, FIRST, FIRST)
    labelled = nodes.join(soon, "node", "left").select("node", F.coalesce("root", "node").alias("label"), "size", "fp")
    late = met(labelled, FIRST, count, more).select(F.col("node").alias("label"), "root")
    close = labelled.join(late, "label", "left").select("node", F.coalesce("root", "label").alias("root")).where("node != root").checkpoint()
    # few nodes are left: within their components all words are compared
    own = close.union(close.select("root", "root").distinct()).join(nodes.select("node", "fp"), "node")
    return _joined(own.select(F.col("root").alias("key"), "node", F.col("node").alias("label"), *(F.col("fp")[k].alias(f"f{k}") for k in range(WIDE))), NEAR_WIDE)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component): one row for every row of docs; component is the least id reachable over links."""
    thin = with_fingerprint(docs, id_col, text_col, words).checkpoint()
    nodes = thin.groupBy("fp").agg(F.min("id").alias("least_id")).checkpoint()
    roots = components(links(nodes, radius))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least_id").alias("component"))
    return thin.join(placed.join(named, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def hex_digits(column) -> F.Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")
