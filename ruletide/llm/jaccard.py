"""Near-duplicates by exact Jaccard similarity of word shingles.

Two texts link where the sets of their shingles of WORDS words are at least SIMILARITY alike. Candidates come from SimHash,
compared bit-sliced: `simhash.near_links` joins sets whose fingerprints are close to groups, and a pair of similarity 0.8 or
more is in one group but with a chance of 0.00005. Every link is then verified on the sets themselves, so nothing below
SIMILARITY links.

Texts with equal sets are one node; sets of fewer than four shingles are that much alike only if equal. In each group all
nodes are compared with the least node, then with the greatest: a group of near copies that those two join costs a star, not a
square. What is left are groups that still hold several components. In one of a few nodes their pairs are verified; a larger
one is compared in a task that holds its sets as bit rows over the shingles they share, a row against all rows of other
components at once, and emits the links that join two components. A group of more than SLICE nodes is cut into pairs of
slices, each a task of its own, so no group has to fit into one task.

Sets are those of 64-bit XXH64 values, lower-cased (A-Z), split at ASCII white space; a shorter text is one shingle; nulls and
texts without a word are alike. The id may be of any type that has an order; repeated ids are rows each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ruletide.llm import simhash
from ruletide.llm import textkit as tk
from ruletide.llm.graph import components
from ruletide.llm.places import placed
from ruletide.llm.simhash import SEED
from ruletide.session import ensure_checkpoint_dir

WORDS = 5
SIMILARITY = 0.8
LEAST = 4  # shingles of a set that can be SIMILARITY like another
FEW = 4  # nodes of a group whose pairs are verified one by one
SLICE = 512
BROADCAST_ROWS = 150_000  # of about 60 bytes: 9 MB
_U = np.uint64


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text of a column, ascending, back to back, and the n + 1 offsets of the texts in there."""
    buf, off = tk.flat(column)
    joined, starts, ends, doc = tk.shingles(tk.LOWER[buf], off, words)
    h = tk.xxh64(joined, starts, ends, SEED)
    by = np.lexsort((h, doc))
    h, doc = h[by], doc[by]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
    return h[new], np.searchsorted(doc[new], np.arange(len(off)))


def node_numbers(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The XXH64 of each set."""
    return tk.xxh64(h.view(np.uint8), 8 * edge[:-1], 8 * edge[1:], SEED)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tk.slices(whole, "text", 1 << 20):
            h, edge = shingle_sets(batch.column(1))
            size = np.diff(edge)
            fp = simhash.wide_fingerprints(h, edge)
            ends = np.arange(0, fp.size + 1, simhash.WIDE, dtype=np.int32)
            columns = [batch.column(0), pa.array(node_numbers(h, edge).view(np.int64)), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(fp.ravel().view(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "node", "size", "fp"])


def _hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tk.slices(whole, "text", 1 << 20):
            h, edge = shingle_sets(batch.column(1))
            sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer((8 * edge).astype(np.int64)), pa.py_buffer(h)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "set"])


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _values(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t.as_buffer(), _U) for t in column]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = pa.array([alike(a, b) for a, b in zip(_values(batch.column(2)), _values(batch.column(3)), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def bit_rows(sets: list[np.ndarray], chunk: int = 1 << 15) -> np.ndarray:
    """The sets as rows of bits over the values that two of them or more hold."""
    size = np.array([len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, wanted = np.repeat(np.arange(len(sets)), size), np.cumsum(held > 1) - 1
    shared = held[column] > 1
    row, column = owner[shared], wanted[column[shared]]
    n = int(wanted[-1]) + 1 if len(wanted) else 0
    parts = [np.zeros((len(sets), 0), _U)]
    for lo in range(0, n, chunk):
        width = -(-min(chunk, n - lo) // 64) * 64
        flags = np.zeros((len(sets), width), bool)
        here = (column >= lo) & (column < lo + chunk)
        flags[row[here], column[here] - lo] = True
        parts.append(np.packbits(flags, axis=1, bitorder="little").view(_U))
    return np.concatenate(parts, axis=1)


def joining_links(sets: list[np.ndarray], roots: np.ndarray, across: np.ndarray | None = None, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links between sets of different components that make one of all components that any link joins.

    across: 0 or 1 for each set; only sets of different sides are compared.
    """
    _, label = np.unique(roots, return_inverse=True)
    size, rows, out = np.array([len(s) for s in sets]), bit_rows(sets), []
    common = np.bincount(label).argmax()
    for i in np.flatnonzero(label != common).tolist():  # two sets of the commonest component need no comparison
        other = (label != label[i]) & (size >= size[i] * similarity - 1e-9) & (size[i] >= size * similarity - 1e-9)
        if across is not None:
            other &= across != across[i]
        at = np.flatnonzero(other)
        both = np.bitwise_count(rows[at] & rows[i]).sum(axis=1, dtype=np.int64)
        for j in at[both >= similarity * (size[at] + size[i] - both) - 1e-9].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, lo, hi, side, node, root, set), those of one tile together, to links."""
    tile, nodes, roots, sides, sets = None, [], [], [], []

    def links() -> pa.RecordBatch:
        found = joining_links(sets, np.array(roots), np.array(sides) if tile and tile[1] != tile[2] else None) if len(set(roots)) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], ["a", "b"])

    for batch in batches:
        here = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        side, node, root, held = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), _values(batch.column(6))
        for k, now in enumerate(here):
            if now != tile:
                if sets:
                    yield links()
                tile, nodes, roots, sides, sets = now, [], [], [], []
            nodes.append(node[k])
            roots.append(root[k])
            sides.append(side[k])
            sets.append(held[k].copy())
    if sets:
        yield links()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(id, node, component): one row for every row of docs; component is the least id reachable over links.

    key_col: a column that tells the rows apart; by default their places do.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    tk.keep_batches_small(spark)
    if key_col is None:
        docs, part, at = placed(docs)
    key = F.struct(F.xxhash64(part), at) if key_col is None else F.col(key_col)
    texts = docs.select(F.struct(F.col(id_col).alias("id"), key.alias("key")).alias("row"), F.col(text_col).alias("text"))
    signed = StructType([texts.schema["row"], StructField("node", LongType()), StructField("size", IntegerType()), StructField("fp", ArrayType(LongType()))])
    thin = texts.mapInArrow(_sign, signed).checkpoint()
    nodes = thin.groupBy("node").agg(F.min("row.id").alias("least_id"), F.min("row.key").alias("rep"), F.first("size").alias("size"), F.first("fp").alias("fp")).checkpoint()

    close = components(simhash.near_links(nodes.where(F.col("size") >= LEAST)))
    grouped = close.union(close.select("root", "root").distinct()).join(nodes.select("node", "size"), "node").select(F.col("root").alias("key"), F.struct("node", "size").alias("m")).checkpoint()
    members = grouped.join(grouped.groupBy("key").agg(F.min("m").alias("low"), F.max("m").alias("high")), "key").checkpoint()
    within = lambda a, b: (F.col(f"{a}.size") >= F.col(f"{b}.size") * SIMILARITY) & (F.col(f"{b}.size") >= F.col(f"{a}.size") * SIMILARITY)
    # the sets of one text for each node that meets another: its row is looked up by key, texts that meet none are not shuffled
    chosen = nodes.join(members.select("m.node"), "node").select("rep", "node").checkpoint()
    few = chosen.count() <= BROADCAST_ROWS
    met = texts.join(F.broadcast(chosen) if few else chosen, F.col("row.key") == F.col("rep")).select("node", "text")
    sets = met.mapInArrow(_hold, "node long, set binary").checkpoint()

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) of nodes that are alike."""
        one = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).where("a < b").distinct()
        left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
        return one.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long").checkpoint()

    def open_members(links: DataFrame) -> DataFrame:
        """The members of groups that hold several components of the links, each with its own and the count of members."""
        roots = components(links)
        own = members.join(roots, F.col("m.node") == F.col("node"), "left").select("key", "m", "high", F.coalesce("root", "m.node").alias("root"))
        several = own.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 < r1").select("key", "n")
        return own.join(several, "key").checkpoint()

    links = linked(members.select(F.col("m").alias("x"), F.col("low").alias("y")).where(within("x", "y")))
    links = links.union(linked(open_members(links).select(F.col("m").alias("x"), F.col("high").alias("y")).where(within("x", "y"))))
    left = open_members(links)
    few = left.where(F.col("n") <= FEW)
    x, y = few.select("key", F.col("m").alias("x"), F.col("root").alias("rx")), few.select("key", F.col("m").alias("y"), F.col("root").alias("ry"))
    links = links.union(linked(x.join(y, "key").where((F.col("rx") < F.col("ry")) & within("x", "y")).select("x", "y")))
    k = F.ceil(F.col("n") / SLICE).cast("int")
    many = left.where(F.col("n") > FEW).select("key", F.col("m.node").alias("node"), "root", F.pmod(F.xxhash64("m.node"), k).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), k - 1)).alias("t"))
    tiles = many.select("key", F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi"), (F.col("s") > F.col("t")).cast("int").alias("side"), "node", "root").join(sets, "node")
    dealt = tiles.select("key", "lo", "hi", "side", "node", "root", "set").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    roots = components(links.union(dealt.mapInArrow(_compare, "a long, b long")))
    named = nodes.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component"))
    return thin.select("row.id", "node").join(named.join(least, "root").select("node", "component"), "node").select("id", "node", "component")
