"""Mixing sources to target weights by Pfair scheduling.

A source's texts form blocks of equal size in the order of a hash of their ids. Source i has the share w_i of the slots, its
target weight over that of all sources that still have blocks. Its k-th block (from 0) since the beginning of the stretch is
released at slot floor(k / w_i) and due by slot ceil((k + 1) / w_i); earliest deadline first among the released gives one
block to every slot. The windows are those of a feasible schedule, so every deadline is met and, at any slot of a stretch, a
source has received less than one block more or less than its share since the stretch began. A stretch ends where a source
runs out; then the shares are those of the sources left. Weights are held in units of 2^-40 of their sum, which moves a share
by less than a millionth of a block over a whole schedule. Every text is scheduled once.

A block is BLOCK_BYTES, or the MOST_SLOTS-th part of all bytes if that is more: the schedule depends on the sources' sizes and
weights only and is one fold in SQL over its slots, in frames of FRAME to bound what is copied, whose cost is slots times
sources. There is no limit to the number of sources, but a block is at least begun by each. The order within a source is a
prefix sum in two levels: inside one of 4,096 hash ranges, then over the ranges' totals. A range of more than HEAVY_ROWS rows
is cut again by a hash of id and place, so neither a large source nor a heap of rows of one id (or none) is sorted by one
task. A text longer than a block also uses up the slots of the blocks that it runs through.

All of it is DataFrame functions; the driver holds three numbers. Null source is a source of its own, null text counts one
byte, repeated rows are scheduled each. Weights must be positive; sources without one get the least weight given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruletide.llm.places import placed, whole
from ruletide.session import ensure_checkpoint_dir

BLOCK_BYTES = 1 << 16
MOST_SLOTS = 1 << 18
FRAME = 256
CHUNKS_HEX = 3  # 4,096 chunks
HEAVY_ROWS = 1 << 17
BROADCAST_ROWS = 250_000  # of 24 bytes: 6 MB
ALPHA = 0.7
UNIT = 1 << 40


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


#: One row with j (the jobs at hand, one for each source: deadline, number, release, blocks since the stretch began, blocks
#: left, weight), their total weight d and the number of slots, to the list of (source, blocks left before) by slot.
_FOLD = f"""aggregate(sequence(0L, (slots - 1) div {FRAME}),
  named_struct('j', j, 't0', 0L, 'd', d, 'plan', cast(array() as array<array<struct<i:int,left:bigint>>>)),
  (o, f) -> transform(array(aggregate(sequence(f * {FRAME}, least(slots, (f + 1) * {FRAME}) - 1),
      named_struct('j', o.j, 't0', o.t0, 'd', o.d, 'plan', cast(array() as array<struct<i:int,left:bigint>>)),
      (a, t) -> transform(array(array_min(filter(a.j, x -> x.rel <= t))), p -> if(p.left = 1,
          named_struct(
            'j', transform(filter(a.j, x -> x.i <> p.i), x -> named_struct('due', t + 1 + (a.d - p.n + x.n - 1) div x.n, 'i', x.i, 'rel', t + 1, 'k', 0L, 'left', x.left, 'n', x.n)),
            't0', t + 1, 'd', a.d - p.n, 'plan', concat(a.plan, array(named_struct('i', p.i, 'left', p.left)))),
          named_struct(
            'j', transform(a.j, x -> if(x.i = p.i, named_struct('due', a.t0 + ((x.k + 2) * a.d + x.n - 1) div x.n, 'i', x.i, 'rel', a.t0 + ((x.k + 1) * a.d) div x.n, 'k', x.k + 1, 'left', x.left - 1, 'n', x.n), x)),
            't0', a.t0, 'd', a.d, 'plan', concat(a.plan, array(named_struct('i', p.i, 'left', p.left))))))[0])),
    w -> named_struct('j', w.j, 't0', w.t0, 'd', w.d, 'plan', concat(o.plan, array(w.plan))))[0],
  o -> flatten(o.plan))"""


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """(source, block, slot) of every block of every source, from rows (source, bytes, weight)."""
    g = sources.agg(F.sort_array(F.collect_list(F.struct("source", "bytes", "weight"))).alias("g")).where("size(g) > 0")
    g = g.select("g", F.expr("aggregate(g, 0D, (x, y) -> x + y.weight)").alias("all"))
    g = g.select("g", F.expr(f"transform(g, x -> greatest(1L, cast(round(x.weight / all * {UNIT}D) as bigint)))").alias("n"), F.expr(f"transform(g, x -> (x.bytes + {block - 1}) div {block})").alias("nb"))
    add = lambda c: f"aggregate({c}, 0L, (x, y) -> x + y)"
    g = g.select("g", "n", "nb", F.expr(add("n")).alias("d"), F.expr(add("nb")).alias("slots"))
    jobs = "transform(g, (x, i) -> named_struct('due', (d + n[i] - 1) div n[i], 'i', i, 'rel', 0L, 'k', 0L, 'left', nb[i], 'n', n[i]))"
    plan = g.select("g", "nb", "d", "slots", F.expr(jobs).alias("j")).select("g", "nb", F.posexplode(F.expr(_FOLD)).alias("slot", "e"))
    return plan.select(F.expr("g[e.i].source").alias("source"), F.expr("nb[e.i] - e.left").alias("block"), F.col("slot").cast("long").alias("slot"))


def _chunks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("__s", "__c", "__u").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, block, slot, start, slots) of every row; with carry, those columns of docs as one struct `__row`.

    block: number of the block in its source; slot: its place in the schedule; start: bytes of the source before the row; slots:
    the length of the schedule. The mixed order is (slot, start). weights: by source; by default a source's bytes to the power
    ALPHA, which lets small sources come earlier than their size would.
    """
    if weights is not None and (not weights or any(not w > 0 for w in weights.values())):
        raise ValueError("weights must be positive")
    ensure_checkpoint_dir(docs.sparkSession)
    docs, part, at = placed(docs)
    kept = ["__row"] if carry else []
    size = (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long")
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), order.alias("__o"), F.xxhash64(part, at).alias("__p"), *([whole(docs, carry).alias("__row")] if carry else []))
    rows = rows.withColumn("__s", _source_key(F.col("source"))).withColumn("__c", F.substring("__o", 1, CHUNKS_HEX)).withColumn("__u", F.lit(0).cast("long"))
    if not carry:
        rows = rows.checkpoint()  # thin rows; the texts are read once
    chunks = _chunks(rows).checkpoint()
    total, most = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    if most > HEAVY_ROWS:
        cut = chunks.where(F.col("rows") > HEAVY_ROWS).select(F.col("__s").alias("__hs"), F.col("__c").alias("__hc"), F.expr(f"rows div {HEAVY_ROWS} + 1").alias("__n"))
        again = F.md5(F.concat("__o", F.col("__p").cast("string")).cast("binary"))
        rows = rows.join(cut, (F.col("__s") == F.col("__hs")) & (F.col("__c") == F.col("__hc")), "left")
        rows = rows.withColumn("__o", F.when(F.col("__n").isNotNull(), again).otherwise(F.col("__o")))
        rows = rows.withColumn("__u", F.when(F.col("__n").isNotNull(), F.expr("cast(conv(substring(__o, 1, 8), 16, 10) as bigint) * __n div 4294967296L")).otherwise(F.lit(0).cast("long")))
        chunks = _chunks(rows).checkpoint()
    block = max(block_bytes, -(-total // MOST_SLOTS))
    sources = chunks.groupBy(F.col("__s").alias("source")).agg(F.sum("bytes").alias("bytes"))
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(ALPHA))
    else:
        known = F.create_map(*(F.lit(v) for s, w in weights.items() for v in ("n" if s is None else f"s{s}", float(w))))
        weight = F.coalesce(F.element_at(known, F.col("source")), F.lit(float(min(weights.values()))))
    plan = schedule(sources.select("source", "bytes", weight.alias("weight")), block).checkpoint()
    slots = plan.count()

    first = Window.partitionBy("__s").orderBy("__c", "__u").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(F.col("__s").alias("__os"), F.col("__c").alias("__oc"), F.col("__u").alias("__ou"), F.coalesce(F.sum("bytes").over(first), F.lit(0)).alias("__offset"))
    inner = Window.partitionBy("__s", "__c", "__u").orderBy("__o", "size", "__p").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("__before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    found = found.join(offsets, (F.col("__s") == F.col("__os")) & (F.col("__c") == F.col("__oc")) & (F.col("__u") == F.col("__ou"))).withColumn("start", F.col("__offset") + F.col("__before"))
    found = found.withColumn("block", F.expr(f"start div {block}"))
    plan = plan.select(F.col("source").alias("__ps"), F.col("block").alias("__pb"), "slot")
    out = found.join(F.broadcast(plan) if slots <= BROADCAST_ROWS else plan, (F.col("__s") == F.col("__ps")) & (F.col("block") == F.col("__pb")))
    return out.select("id", "source", "size", "block", "slot", "start", F.lit(slots).cast("long").alias("slots"), *kept)


def in_order(mixed: DataFrame) -> DataFrame:
    """mixed in the order of its schedule: partitions are equal runs of slots, so no sample has to be drawn first."""
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.expr(f"slot * {n} div greatest(1L, slots)").cast("int")
    return mixed.repartitionById(n, part).sortWithinPartitions("slot", "start")
