"""Quality selection by importance resampling.

Two hashed n-gram models are estimated: one from a target (texts labelled good, at most TARGET_DOCS of them, chosen by a
hash), one from all raw texts. The features are words, punctuation runs and pairs of neighbours, hashed by XXH64 to BUCKETS;
a bucket's ratio is (target count + PRIOR) / (expected count + PRIOR). A text's log importance weight is the sum of the log
ratios of its features. Adding standard Gumbel noise to it and taking the k largest draws k texts without replacement, each
in proportion to its weight (TEMPERATURE 1; another temperature draws in proportion to weight ** (1 / temperature)).

k does not look at the weights: it is given, or a fraction of the texts. By default the fraction is the share of good texts
among the labelled ones plus MARGIN standard errors of that share, so that clean texts are not lost to the error of the
estimate; without a label it is 1.

The k-th largest value is found on the executors by counting value prefixes, 16 bits a round, so nothing but 65,536 counts
reaches the driver. Ties of the score are cut by a hash of id and text, so exactly k rows are drawn, unless rows that are
equal in both straddle the border: these share their noise and their fate and all stay. Model counts are summed for each
bucket over all texts.

A null text, or one without a word or sign, has no weight and no score (null) and is never drawn. Without any labelled good
text every weight is 0. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ruletide.llm import textkit as tk
from ruletide.llm.places import whole
from ruletide.session import ensure_checkpoint_dir

BUCKETS = 1 << 16
TARGET_DOCS = 4000
TEMPERATURE = 1.0
MARGIN = 3.0
PRIOR = 32.0
_U = np.uint64


def features(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every word, punctuation run and pair of neighbours of every text."""
    buf, off = tk.flat(column)
    buf = tk.LOWER[buf]
    space, word = tk.IS_SPACE[buf], tk.IS_WORD[buf]
    ws, we = tk.runs(word, off)
    ps, pe = tk.runs(~space & ~word, off)
    starts, ends = np.concatenate((ws, ps)), np.concatenate((we, pe))
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], ends[by]
    doc, h = tk.owner(starts, off), tk.span_hashes(buf, starts, ends)
    pair = doc[1:] == doc[:-1]
    two = tk.mix(h[:-1] * _U(3) + h[1:] + _U(1))[pair]
    return np.concatenate((doc, doc[1:][pair])), (np.concatenate((h, two)) % _U(buckets)).astype(np.int64)


def _count(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for whole in batches:
        for batch in tk.slices(whole, "text", 2 << 20):
            doc, b = features(batch.column(0), buckets)
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            raw += np.bincount(b, minlength=buckets)
            target += np.bincount(b[good[doc]], minlength=buckets)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, target_docs: int = TARGET_DOCS) -> np.ndarray:
    """Log ratio of target to raw probability of each bucket; zeros where there is no target.

    labels: doc_id and quality (1 is good).
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("of")).distinct().orderBy(F.xxhash64("of"), "of").limit(target_docs)
    chosen = F.broadcast(good.withColumn("good", F.lit(True)))
    flagged = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, F.col("id") == F.col("of"), "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    rows = flagged.mapInArrow(lambda it: _count(buckets, it), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(buckets)
    # a prior of PRIOR expected counts on both models: a bucket weighs in as far as its counts carry evidence
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + PRIOR) / (expected + PRIOR))


def _sortable(x: np.ndarray) -> np.ndarray:
    """Doubles as longs of the same order."""
    b = x.astype(np.float64).view(np.int64)
    return np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b)


def gumbel(h: np.ndarray) -> np.ndarray:
    """Standard Gumbel values from uniform 64-bit ones."""
    u = ((h >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return -np.log(-np.log(u))


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", temperature: float = TEMPERATURE, seed: int = 1) -> DataFrame:
    """(row, weight, score, key, tie) of every row of docs: the row as a struct, its log importance weight, the weight with
    Gumbel noise, that as a sortable long, and the hash that the noise comes from."""
    tk.keep_batches_small(docs.sparkSession)
    at = docs.columns.index(text_col)

    def of(batches):
        for whole in batches:
            flat = pa.RecordBatch.from_arrays([whole.column(0).field(at), whole.column(0), whole.column(1)], ["text", "row", "h"])
            for batch in tk.slices(flat, "text", 2 << 20):
                doc, b = features(batch.column(0), len(ratio))
                without = np.bincount(doc, minlength=len(batch)) == 0
                weight = np.bincount(doc, ratio[b], minlength=len(batch))
                score = weight + temperature * gumbel(batch.column(2).to_numpy(zero_copy_only=False).view(_U))
                key = pa.array(_sortable(score), mask=without)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(weight, mask=without), pa.array(score, mask=without), key, batch.column(2)], ["row", "weight", "score", "key", "tie"])

    rows = docs.select(whole(docs).alias("row"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("h"))
    schema = StructType([rows.schema["row"], StructField("weight", DoubleType()), StructField("score", DoubleType()), StructField("key", LongType()), StructField("tie", LongType())])
    return rows.mapInArrow(of, schema)


def kth_largest(rows: DataFrame, k: int, key: str = "key") -> tuple[int, int] | None:
    """The k-th largest long of a column, by four rounds of counts of 16 more bits each, and how many of the k it is."""
    if k <= 0:
        return None
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        part = F.shiftright(key, shift)
        held = rows if prefix is None else rows.where(F.shiftright(key, shift + 16) == F.lit(prefix))
        counts = sorted(((r["p"], r["n"]) for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for p, n in counts:
            prefix = p
            if n >= left:
                break
            left -= n
        else:  # fewer than k rows: all of them count
            if not counts:
                return None
            left = counts[-1][1]
    return prefix, left


def good_share(labels: DataFrame, margin: float = MARGIN) -> float:
    """The share of good ones among the labelled ids, plus margin standard errors; 1 without labels."""
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").distinct()
    n, good = known.agg(F.count("*"), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0))).first()
    if not good:
        return 1.0
    share = good / n
    return min(1.0, share + margin * (share * (1 - share) / n) ** 0.5)


def draw(rows: DataFrame, labels: DataFrame, k: int | None = None, fraction: float | None = None) -> Column:
    """Whether a weighed row is among the k drawn."""
    able = rows.where("key is not null").select("key", "tie")
    if k is None:
        k = math.ceil(able.count() * (good_share(labels) if fraction is None else fraction))
    least = kth_largest(able, k)
    if least is None:
        return F.lit(False)
    border, left = least
    tied = able.where(F.col("key") == F.lit(border))
    cut = kth_largest(tied, left, "tie")
    return F.coalesce((F.col("key") > F.lit(border)) | ((F.col("key") == F.lit(border)) & (F.col("tie") >= F.lit(cut[0]))), F.lit(False))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, fraction: float | None = None, temperature: float = TEMPERATURE, seed: int = 1) -> DataFrame:
    """(id, log_weight, score, kept) of every row of docs."""
    ensure_checkpoint_dir(docs.sparkSession)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = weigh(thin, model(thin, labels, "id"), "id", "text", temperature, seed).select("row.id", "weight", "score", "key", "tie").checkpoint()
    return rows.select("id", F.col("weight").alias("log_weight"), "score", draw(rows, labels, k, fraction).alias("kept"))


def drawn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, fraction: float | None = None, temperature: float = TEMPERATURE, seed: int = 1) -> DataFrame:
    """The rows of docs that are drawn, with all their columns; they are weighed a second time instead of being written beside
    their weights or joined, so no text is written or shuffled."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = weigh(docs, model(docs, labels, id_col, text_col), id_col, text_col, temperature, seed)
    return rows.where(draw(rows.select("key", "tie").checkpoint(), labels, k, fraction)).select("row.*")
