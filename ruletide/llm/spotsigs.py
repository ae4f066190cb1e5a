"""SpotSigs document fingerprints.

A spot signature is an anchor (a very common word) with the chain of the next CHAIN content words that follow it; a text is
the set of its signatures. Texts of the same signature set share a fingerprint. Likeness is the Jaccard index of two sets.
Matching deals the sets to partitions by their size, so that only sizes within the threshold of each other meet, lets
candidates meet on their rarest signatures alone, and leaves a pair as soon as the threshold is out of reach.

The query needs each text's likeness to two given texts, its edited form and its successor, so it compares those sets in full;
the partitioned, pruned comparison of all sets is `matches`. A fingerprint is the size of its set and a digest of it: equal
fingerprints are equal sets, the likeness of different ones is that of the sets behind them.

A text without a usable anchor is chained from each of its words; a text without words has the empty set, which is like
another empty set (1.0) and unlike any other (0.0). Null counts as empty. Repeated rows and ids are fingerprinted one by one;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruletide.llm import textkit as tk

#: Closed-class words of English, German, French and Spanish that anchor the chains.
ANCHORS = (
    "the a an of to and in is it that for on with as was be by are this at from or "
    "der die das und den von zu mit ist ein eine nicht auf im dem des sich für als auch "
    "le la les un une du et en que qui pour dans par sur au est il elle ce pas "
    "el los las una y se con su al lo como del más pero sus o este ha"
).split()
CHAIN = 3
SKIP = 1
PART_BYTES = 1 << 28  # of text that one task walks, on average
_U = np.uint64


def anchor_hashes(anchors=ANCHORS) -> np.ndarray:
    buf, off = tk.flat(pa.array(sorted(set(anchors))))
    return np.sort(tk.span_hashes(buf, off[:-1], off[1:]))


def signatures(column: pa.Array, anchors: np.ndarray, chain: int = CHAIN, skip: int = SKIP) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text number, signature) of a column of texts."""
    buf, off = tk.flat(column)
    buf = tk.LOWER[buf]
    starts, ends = tk.runs(tk.IS_WORD[buf], off)
    doc = tk.owner(starts, off)
    h = tk.span_hashes(buf, starts, ends)
    at = np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)
    spot = anchors[at] == h
    content = np.flatnonzero(~spot)
    nxt = np.searchsorted(content, np.arange(len(h)) + 1)  # the first content word after each word
    ok = np.minimum(nxt, max(0, len(content) - 1))
    usable = spot & (nxt < len(content)) & (doc[content[ok]] == doc if len(content) else False)
    without = np.bincount(doc[usable], minlength=len(off) - 1) == 0
    begin = np.flatnonzero(usable | without[doc])
    sig, home = h[begin].copy(), doc[begin]
    for k in range(chain):
        i = nxt[begin] + k * skip
        inside = i < len(content)
        j = content[np.minimum(i, max(0, len(content) - 1))] if len(content) else np.zeros(len(begin), np.int64)
        inside &= doc[j] == home if len(content) else False
        sig = tk.mix(sig * _U(31) + np.where(inside, h[j] if len(h) else _U(0), _U(0)) + _U(k + 1))
    by = np.lexsort((sig, home))
    home, sig = home[by], sig[by]
    new = np.concatenate(([True], (home[1:] != home[:-1]) | (sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, bool)
    return home[new], sig[new]


def digests(home: np.ndarray, sig: np.ndarray, texts: int) -> list[str]:
    """Of each text the size of its set and a 128-bit digest of it."""
    edge = np.searchsorted(home, np.arange(texts + 1))
    raw = sig.tobytes()
    return [f"{e - s:06x}-{hashlib.blake2b(raw[8 * s : 8 * e], digest_size=16).hexdigest()}" for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], texts: int) -> np.ndarray:
    """Likeness of text i of a and text i of b, for every i."""
    home, sig = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    by = np.lexsort((sig, home))
    home, sig = home[by], sig[by]
    same = (home[1:] == home[:-1]) & (sig[1:] == sig[:-1])
    both = np.bincount(home[1:][same], minlength=texts)
    either = np.bincount(home, minlength=texts) - both
    return np.where(either > 0, both / np.maximum(1, either), 1.0)


def _bucketed(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Rows (part, role, id, text) so that each part is a run of ids, closed by a copy of the row that follows it.

    Boundaries come from a quantile sketch of the ids alone; what the driver sees is one id for each part.
    """
    rows = docs.select("id", "text")
    cuts = sorted({float(x) for x in docs.select(F.col("id").cast("double").alias("id")).approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    if cuts:
        steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
        table = F.array(*map(F.lit, cuts))
        above = lambda acc, s: F.when((acc + s <= len(cuts)) & (F.element_at(table, F.least(acc + s, F.lit(len(cuts)))) < F.col("id")), acc + s).otherwise(acc)
        part = F.coalesce(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), above), F.lit(0))
    else:
        part = F.lit(0)
    least = sorted((r["part"], r["least"], r["nulls"]) for r in docs.select(part.alias("part"), "id").groupBy("part").agg(F.min("id").alias("least"), F.max(F.col("id").isNull()).alias("nulls")).collect())
    placed = rows.select(part.alias("part"), F.lit(0).alias("role"), "id", "text")
    # the first row of part k closes part k - 1, that of the first closes the last: one row for each part at most
    edges = [(None if nulls else low, least[k - 1][0]) for k, (_, low, nulls) in enumerate(least)]
    edges = docs.sparkSession.createDataFrame(edges, "first long, closes int")
    copies = rows.join(F.broadcast(edges), F.col("id").eqNullSafe(F.col("first"))).select(F.col("closes").alias("part"), F.lit(1).alias("role"), "id", "text")
    return placed.union(copies), max(1, len(cuts) + 1)


def _walk(anchors: np.ndarray, chain: int, skip: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    texts: list[str] = []
    edited: list[str] = []
    held: tuple | None = None  # the last row still waits for the next text
    size, closed = 0, False

    def flush(follow: str):
        t, e = pa.array(texts, pa.large_string()), pa.array(edited, pa.large_string())
        s, es, n = signatures(pa.array([*texts, follow], pa.large_string()), anchors, chain, skip), signatures(e, anchors, chain, skip), len(t)
        own = s[0] < n
        nxt = s[0] > 0
        mine, after = (s[0][own], s[1][own]), (s[0][nxt] - 1, s[1][nxt])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]), pa.array(digests(*mine, n)), pa.array(digests(*es, n)), pa.array(jaccard(mine, es, n)), pa.array(jaccard(mine, after, n))],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    part = None
    for batch in batches:
        for p, role, i, text in zip(*(batch.column(k) for k in range(4)), strict=True):
            p, role, text = p.as_py(), role.as_py(), text.as_py() or ""
            if p != part:
                part, held, closed = p, None, False
            if closed:
                continue  # only the first closing row counts
            if held is not None:
                cut = len(held[1]) // 4
                ids.append(held[0])
                texts.append(held[1])
                edited.append(held[1][: len(held[1]) - cut] + text[:cut])
                size += len(held[1])
                if size > 1 << 20 or role:
                    yield flush(text)
                    ids, texts, edited, size = [], [], [], 0
            held, closed = (i.as_py(), text), role == 1


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors=ANCHORS, chain: int = CHAIN, skip: int = SKIP) -> DataFrame:
    """One row for each row of docs: fingerprints of the text and of its edited form, and their likeness.

    The edited form replaces the last quarter of the text by the beginning of the next text in ascending id (nulls first,
    equal ids by text); the last text takes from the first.
    """
    spark = docs.sparkSession
    tk.keep_batches_small(spark, 256)
    known = anchor_hashes(anchors)
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(thin.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    placed, parts = _bucketed(thin, n)
    dealt = placed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "role", F.asc_nulls_first("id"), F.asc_nulls_first("text"))
    return dealt.mapInArrow(lambda it: _walk(known, chain, skip, it), "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def signature_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors=ANCHORS, chain: int = CHAIN, skip: int = SKIP) -> DataFrame:
    """(id, fingerprint, sigs): the sorted signature set of each row."""
    tk.keep_batches_small(docs.sparkSession)
    known = anchor_hashes(anchors)

    def of(batches):
        for whole in batches:
            for b in tk.slices(whole, "text", 2 << 20):
                home, sig = signatures(b.column(1), known, chain, skip)
                edge = np.searchsorted(home, np.arange(len(b) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests(home, sig, len(b))), pa.ListArray.from_arrays(edge, pa.array(sig.view(np.int64)))], ["id", "fingerprint", "sigs"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(of, "id long, fingerprint string, sigs array<long>")


def matches(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(fingerprint_a, fingerprint_b, jaccard) of the different sets at or over the threshold; copies share a fingerprint.

    A set's prefix is its |s| - ceil(t |s|) + 1 rarest signatures: two sets over the threshold share one of them. A prefix
    signature meets only sets whose size class is its own or the next, so sizes too far apart never meet.
    """
    one = sets.where(F.size("sigs") > 0).groupBy("fingerprint").agg(F.first("sigs").alias("sigs"))
    flat = one.select("fingerprint", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rarity = flat.groupBy("sig").agg(F.count("*").alias("df"))
    by = Window.partitionBy("fingerprint").orderBy("df", "sig")
    prefix = flat.join(rarity.where("df > 1"), "sig").withColumn("rest", F.row_number().over(by))
    # signatures found in one set alone come first in the order and meet nothing: they shorten the prefix of the others
    shared = Window.partitionBy("fingerprint")
    prefix = prefix.withColumn("alone", F.col("n") - F.count("*").over(shared)).where(F.col("rest") + F.col("alone") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1)
    cls = F.floor(F.log("n") / -np.log(threshold)).cast("int")
    p = prefix.select("fingerprint", "n", "sig", cls.alias("cls"))
    a = p.select(F.col("fingerprint").alias("fingerprint_a"), F.col("n").alias("na"), "sig", F.explode(F.array("cls", F.col("cls") + 1)).alias("cls"))
    b = p.select(F.col("fingerprint").alias("fingerprint_b"), F.col("n").alias("nb"), "sig", "cls")
    fits = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("fingerprint_a") < F.col("fingerprint_b")))
    pairs = a.join(b, ["sig", "cls"]).where(fits & (F.col("na") >= F.col("nb") * F.lit(threshold) - 1e-9)).select("fingerprint_a", "fingerprint_b").distinct()
    full = pairs.join(one.select(F.col("fingerprint").alias("fingerprint_a"), F.col("sigs").alias("sa")), "fingerprint_a").join(one.select(F.col("fingerprint").alias("fingerprint_b"), F.col("sigs").alias("sb")), "fingerprint_b")
    both = F.size(F.array_intersect("sa", "sb"))
    score = both / (F.size("sa") + F.size("sb") - both)
    return full.select("fingerprint_a", "fingerprint_b", score.alias("jaccard")).where(F.col("jaccard") >= threshold)
