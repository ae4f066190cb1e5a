"""Byte-balanced shards from sampled splitters.

Records are ordered by a hash of their text (equal texts are neighbours), then by a hash of their id. A sample in which a
record's chance grows with its size gives weighted quantiles as splitters of many small ranges; what each range really holds
is then counted, ranges over twice the mean are subdivided until no piece is, and ranges and pieces are dealt to the shards,
largest first. A run of equal texts that is heavier than a range is split by the id's hash, so that a hot group never fills a
shard; any other run of equal texts stays in one shard.

The driver holds the sample, the splitters and one count for each range and piece: at most MOST_RANGES ranges, OVERSAMPLE
samples a range and a few pieces a range, whatever the input. Null text has size 16 and the CRC null. Repeated rows are
shards' rows like any other; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruletide.session import ensure_checkpoint_dir

SHARDS = 40
RANGES = 32  # ranges for each shard
OVERSAMPLE = 8
RANGE_BYTES = 1 << 30
MOST_RANGES = 1 << 13
ROUNDS = 8  # of subdividing, each with twice the pieces


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, key, tie): what sharding needs of each record, without its text."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.xxhash64(F.col(id_col), F.lit(1)).alias("tie"),
    )


def quantiles(sample: list[tuple[int, int, float]], n: int) -> list[tuple[int, int]]:
    """At most n - 1 weighted quantiles of (key, tie, weight)."""
    sample = sorted(sample)
    held = np.cumsum([w for *_, w in sample])
    return sorted({sample[i][:2] for i in np.searchsorted(held, held[-1] * np.arange(1, n) / n).tolist()}) if sample else []


def splitters(cuts: list[tuple[int, int]], heavy: set[int]) -> list[tuple[int, int]]:
    """The cuts with a heavy key alone in its ranges, split by tie; any other key is kept whole."""
    lowest = -(1 << 63)
    return sorted({c if c[0] in heavy else (c[0], lowest) for c in cuts} | {(k, lowest) for k in heavy} | {(k + 1, lowest) for k in heavy if k < (1 << 63) - 1})


def _twice(cuts: list[tuple[int, int]]) -> set[int]:
    return {a[0] for a, b in zip(cuts, cuts[1:]) if a[0] == b[0]}


def deal(loads: dict, shards: int) -> dict:
    """Largest first, each to the lightest shard."""
    heap, out = [(0, s) for s in range(shards)], {}
    for k, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        total, s = heapq.heappop(heap)
        out[k] = s
        heapq.heappush(heap, (total + load, s))
    return out


def _ranges(cuts: list[tuple[int, int]]):
    """A column function: the number of the range that holds (key, tie), and whether the key is one that several ranges share."""
    heads = sorted({k for k, _ in cuts})
    base, heavy = np.array(heads, np.int64), np.array(sorted(_twice(cuts)), np.int64)
    ties = {k: np.array(sorted(t for kk, t in cuts if kk == k), np.int64) for k in heads}
    before = np.concatenate(([0], np.cumsum([len(ties[k]) for k in heads]))).astype(np.int64)

    @F.arrow_udf("struct<range int, shared boolean>")
    def of(key: pa.Array, tie: pa.Array) -> pa.Array:
        k, t = key.to_numpy(zero_copy_only=False), tie.to_numpy(zero_copy_only=False)
        at = np.searchsorted(base, k, side="right")  # heads at or below the key
        out = before[at]
        own = np.flatnonzero((at > 0) & (base[np.maximum(at, 1) - 1] == k)) if len(base) else np.zeros(0, np.int64)
        for i in np.unique(at[own]) - 1 if len(own) else ():
            sel = own[at[own] == i + 1]
            out[sel] = before[i] + np.searchsorted(ties[heads[i]], t[sel], side="right")
        return pa.StructArray.from_arrays([pa.array(out.astype(np.int32)), pa.array(np.isin(k, heavy))], ["range", "shared"])

    return of


def _units(pieces: dict[int, int], width: int):
    """A column function: the first number of a range's units, and in how many pieces it is cut."""
    count = np.ones(width, np.int64)
    for r, k in pieces.items():
        count[r] = k
    first = np.concatenate(([0], np.cumsum(count)))

    @F.arrow_udf("long")
    def of(range_: pa.Array, h: pa.Array) -> pa.Array:
        r, x = range_.to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False).view(np.uint64)
        return pa.array(first[r] + (x % count[r].astype(np.uint64)).astype(np.int64))

    return of, first


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; slots of a shard run from 0 without a gap."""
    ensure_checkpoint_dir(docs.sparkSession)
    thin = keyed(docs, id_col, text_col).checkpoint()
    total = thin.agg(F.sum("size")).first()[0] or 0
    n = min(max(shards * RANGES, -(-total // RANGE_BYTES)), max(shards * RANGES, MOST_RANGES))
    step = max(1.0, total / (n * OVERSAMPLE))
    draw = F.pmod(F.xxhash64("key", "tie", F.lit(2)), F.lit(1 << 30)) / float(1 << 30) * step < F.col("size")
    sample = [(r["key"], r["tie"], max(step, float(r["size"]))) for r in thin.where(draw).select("key", "tie", "size").toLocalIterator()]
    cuts = quantiles(sample, n)
    # keys that several quantiles fall on, and that do weigh more than a range: the sample alone may make a light one look so
    twice = docs.sparkSession.createDataFrame([(k,) for k in _twice(cuts)], "k long")
    weighed = thin.join(F.broadcast(twice), F.col("key") == F.col("k")).groupBy("k").agg(F.sum("size").alias("bytes"))
    cuts = splitters(cuts, {r["k"] for r in weighed.where(F.col("bytes") * n > total).collect()})
    placed = thin.withColumn("at", _ranges(cuts)("key", "tie"))
    # a piece keeps a run of equal texts together, unless ranges share it
    fine = placed.select("id", "size", "text_crc32", "key", "tie", F.col("at.range").alias("range"), F.xxhash64("key", F.when(F.col("at.shared"), F.col("tie")), F.lit(3)).alias("h"))
    width, most = len(cuts) + 1, 2 * total / n
    seen = fine.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    loads, rows = {r["range"]: r["bytes"] for r in seen}, {r["range"]: r["rows"] for r in seen}
    pieces = {r: int(b // most) + 2 for r, b in loads.items() if b > most}
    unit, first = _units(pieces, width)
    loads, rows = {int(first[r]): b for r, b in loads.items() if r not in pieces}, {int(first[r]): m for r, m in rows.items() if r not in pieces}
    for round_ in range(ROUNDS if pieces else 0):
        numbered = fine.where(F.col("range").isin(*pieces)) if len(pieces) <= 100 else fine.join(F.broadcast(docs.sparkSession.createDataFrame([(r,) for r in pieces], "range int")), "range")
        cut = numbered.groupBy("range", unit("range", "h").alias("unit")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        still = {r["range"] for r in cut if r["bytes"] > most}
        if not still or round_ == ROUNDS - 1:
            break
        pieces = {r: k * (2 if r in still else 1) for r, k in pieces.items()}
        whole = {int(np.searchsorted(first, u, side="right")) - 1: u for u in loads}  # by range
        unit, again = _units(pieces, width)
        loads, rows, first = {int(again[r]): loads[u] for r, u in whole.items()}, {int(again[r]): rows[u] for r, u in whole.items()}, again
    for r in cut if pieces else ():
        loads[r["unit"]], rows[r["unit"]] = r["bytes"], r["rows"]
    to = deal(loads, shards)
    slots, base_of, shard_of = [0] * shards, np.zeros(int(first[-1]), np.int64), np.zeros(int(first[-1]), np.int32)
    for u in sorted(loads):
        shard_of[u], base_of[u] = to[u], slots[to[u]]
        slots[to[u]] += rows[u]

    @F.arrow_udf("struct<shard int, base long>")
    def home(unit_: pa.Array) -> pa.Array:
        u = unit_.to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(shard_of[u]), pa.array(base_of[u])], ["shard", "base"])

    order = Window.partitionBy("unit").orderBy("key", "tie", F.asc_nulls_first("id"), "size")
    numbered = fine.withColumn("unit", unit("range", "h")).withColumn("row", F.row_number().over(order)).withColumn("home", home("unit"))
    return numbered.select("id", "size", "text_crc32", F.col("home.shard").alias("shard"), (F.col("home.base") + F.col("row") - 1).alias("slot"))
