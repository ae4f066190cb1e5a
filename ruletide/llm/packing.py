"""Best-fit packing into bins of several permitted lengths.

Pieces are placed longest first, each into the open bin with the least room that still holds it. Where none does, a bin is
opened of the size with the least cost for this piece: the size's cost, less what its remaining room is worth at the best
price per token, since later and shorter pieces are likely to fill it. At the end every bin is downsized to the least
permitted length that holds its contents.

That cost looks at one piece, and with the default parameters it is always least for the least size. So the sizes of a group
are chosen jointly: its pieces are packed once for each permitted length as the least that is opened, each trial is
downsized, and the trial whose bins cost least together is kept.

Texts longer than the largest length are cut into pieces of it, nothing is dropped. A text's length is its words plus one
closing token, so an empty or null text is a piece of length one. Pieces are dealt by a hash of their row's place into groups
of GROUP_TOKENS tokens at most on average, whatever their ids, and each group is packed by itself: a group costs one unfilled
bin, and memory does not grow with the input. With ordered=True groups are runs of GROUP_TOKENS tokens of the rows' order instead, and groups and the bins of a
group are numbered in that order. Repeated rows are packed each; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruletide.llm.places import placed
from ruletide.session import ensure_checkpoint_dir

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16  # tokens that a bin costs besides its length
FILL = 0.98  # share of a bin's remaining room that later pieces are taken to fill
GROUP_TOKENS = 1 << 19
RUN = 256  # rows whose tokens are summed in one window
SCHEMA = "id long, piece int, start long, length int, bin string, bin_offset int, capacity int, used int"


def opening(length: int, sizes=LENGTHS, overhead: int = OVERHEAD, fill: float = FILL) -> int:
    """The size of bin to open for a piece of this length."""
    price = min((s + overhead) / s for s in sizes)
    return min((s for s in sizes if s >= length), key=lambda s: (s + overhead - fill * price * (s - length), s))


def pack(lengths: list[int], sizes=LENGTHS, overhead: int = OVERHEAD, fill: float = FILL, least: int = 0) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and offset of each piece (longest first), then capacity and used length of each bin; none is opened under least."""
    rooms: list[int] = []  # the distinct amounts of room of open bins, ascending
    open_bins: dict[int, list[int]] = defaultdict(list)
    where, offset, opened, used = [], [], [], []
    for n in lengths:
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(at)
        else:
            b, room = len(opened), max(least, opening(n, sizes, overhead, fill))
            opened.append(room)
            used.append(0)
        where.append(b)
        offset.append(used[b])
        used[b] += n
        room -= n
        if room:
            if not open_bins[room]:
                insort(rooms, room)
            open_bins[room].append(b)
    return where, offset, [min(s for s in sizes if s >= u) for u in used], used


def pack_jointly(lengths: list[int], sizes=LENGTHS, overhead: int = OVERHEAD, fill: float = FILL) -> tuple[list[int], list[int], list[int], list[int]]:
    """The cheapest of the packings that open no bin under one of the sizes."""
    trials = (pack(lengths, sizes, overhead, fill, least) for least in sorted(sizes))
    return min(trials, key=lambda t: sum(t[2]) + overhead * len(t[2]))


def word_count(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def _places(docs: DataFrame) -> list[Column]:
    """File or partition, and place in there, of each row: numbers that ascend in the rows' order."""
    try:
        docs.select("_metadata.row_index", "_metadata.file_name")
    except AnalysisException:  # no file behind it: the partitions are in order
        n = F.monotonically_increasing_id()
        return [F.shiftright(n, 33).cast("string").alias("part"), n.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")]
    return [F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("row")]


def _part_order(part: str) -> tuple[int, str]:
    """Spark numbers the files part-00000 and so on, with more digits from 100,000."""
    found = re.match(r"(?:part-)?(\d+)", part)
    return int(found.group(1)) if found else 0, part


def _positions(thin: DataFrame) -> DataFrame:
    """(id, n, before): the tokens that stand before each row. Summed in runs of RUN rows, over the runs of a part, then over the parts."""
    spark = thin.sparkSession
    runs = thin.groupBy("part", F.expr(f"row div {RUN}").alias("run")).agg(F.sum("n").alias("tokens")).checkpoint()
    total, at = 0, []
    for part, tokens in sorted(((r["part"], r["t"]) for r in runs.groupBy("part").agg(F.sum("tokens").alias("t")).collect()), key=lambda x: _part_order(x[0])):
        at.append((part, total))
        total += tokens
    starts = spark.createDataFrame(at, "part string, first long")
    earlier = Window.partitionBy("part").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("above", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).join(F.broadcast(starts), "part").select("part", "run", (F.col("first") + F.col("above")).alias("offset"))
    inner = Window.partitionBy("part", "run").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = thin.withColumn("run", F.expr(f"row div {RUN}")).withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return rows.join(runs, ["part", "run"]).select("id", "n", (F.col("offset") + F.col("inside")).alias("before"))


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes=LENGTHS, overhead: int = OVERHEAD, fill: float = FILL, group_tokens: int = GROUP_TOKENS, length: Column | None = None, ordered: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start and length in its text, its bin, offset there, the bin's capacity and used.

    length: a column of lengths of at least one; by default words plus one. ordered: keep to the order of the rows (bins `g-b`
    ascend with it), as far as the files or partitions of docs tell it.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    sizes, most = tuple(sorted(sizes)), max(sizes)
    n = length if length is not None else word_count(F.col(text_col)) + 1
    where = _places(docs)
    if not ordered:
        docs, part, at = placed(docs)
        where = [F.xxhash64(part, at).alias("before")]
    thin = docs.select(F.col(id_col).cast("long").alias("id"), n.cast("long").alias("n"), *where).checkpoint()
    groups = max(1, -(-(thin.agg(F.sum("n")).first()[0] or 0) // group_tokens))
    thin = _positions(thin) if ordered else thin
    cut = thin.select("id", "before", F.explode(F.expr(f"transform(sequence(0L, (n - 1) div {most}), i -> struct(int(i) as piece, i * {most} as start, int(least({most}, n - i * {most})) as length))")).alias("p"))
    pieces = cut.select("id", (F.col("before") + F.col("p.start")).alias("at"), F.col("p.piece").alias("piece"), F.col("p.start").alias("start"), F.col("p.length").alias("length"))
    pieces = pieces.withColumn("grp", F.expr(f"at div {group_tokens}") if ordered else F.pmod(F.xxhash64("at", "piece"), F.lit(groups)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        by = ["length", *(["at"] if ordered else []), "id", "piece"]
        pdf = pdf.sort_values(by, ascending=[c != "length" for c in by], kind="stable")
        where, offset, capacity, used = pack_jointly(pdf["length"].tolist(), sizes, overhead, fill)
        g = int(pdf["grp"].iloc[0])
        first = pdf["at"].groupby(np.array(where)).min().to_numpy()  # where a bin's earliest piece stands
        name = np.argsort(np.argsort(first, kind="stable")) if ordered else np.arange(len(first))
        return pd.DataFrame({"id": pdf["id"], "piece": pdf["piece"], "start": pdf["start"], "length": pdf["length"], "bin": [f"{g}-{name[b]}" for b in where], "bin_offset": offset, "capacity": [capacity[b] for b in where], "used": [used[b] for b in where]})

    return pieces.groupBy("grp").applyInPandas(fit, SCHEMA)


def sequences(packed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bin, capacity, used, ids, text): the packed texts themselves; ids must be unique. The closing token is a blank line."""
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(words, F.array().cast("array<string>")).alias("w"))
    part = F.array_join(F.slice("w", (F.col("start") + 1).cast("int"), F.col("length")), " ")
    rows = packed.join(texts, "id").select("bin", "capacity", "used", F.struct("bin_offset", "id", part.alias("t")).alias("p"))
    out = rows.groupBy("bin", "capacity", "used").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return out.select("bin", "capacity", "used", F.transform("p", lambda p: p["id"]).alias("ids"), F.array_join(F.transform("p", lambda p: p["t"]), "\n\n").alias("text"))
