"""Each operator against a brute-force version on a small table of hard cases, and on an empty one."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import pathlib
import random
import re
import subprocess
import sys
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import FOLLY
from pyspark.sql import functions as F

from ruletide.llm import dsir, graph, langid, linefreq, mixing, packing, repetition, sharding, simhash, spotsigs, textkit, urlfilter

WORD = r"[^\x20\x09-\x0D]+"


def tuples(df):
    return collections.Counter(tuple(r) for r in df.collect())


def words_of(text):
    return re.findall(WORD, text or "")


# 1 sharding


def test_sharding(docs, folly, empty, rows):
    out = sharding.shard(docs, 8)
    got = out.collect()
    assert collections.Counter((r["id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(8))
    assert tuples(sharding.shard(folly, 8)) == tuples(out)
    assert sharding.shard(empty, 8).collect() == []


def test_sharding_balance_and_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, "same text " * 5 if i % 3 == 0 else "x" * rng.randint(1, 200) + str(i)) for i in range(6000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r["s"] for r in got]
    assert len(sizes) == 10 and max(sizes) < 1.02 * min(sizes)


def test_equal_texts_stay_in_one_shard(spark):
    rng = random.Random(5)
    rows = [(i, f"text {rng.randint(0, 1500)} " + "y" * 60) for i in range(6000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    at, text = collections.defaultdict(set), dict(rows)
    for r in got:
        at[text[r["id"]]].add(r["shard"])
    assert len(got) == len(rows) and all(len(s) == 1 for s in at.values())


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    """With a sample too thin to see them, a few ranges hold much: they are cut until no piece is over twice the mean."""
    monkeypatch.setattr(sharding, "splitters", lambda cuts, heavy: [(0, -(1 << 63))])
    rows = [(i, f"text {i}") for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    slots = collections.Counter((r["shard"], r["slot"]) for r in got)
    assert len(got) == 4000 and max(slots.values()) == 1 and len(sizes) == 8 and max(sizes.values()) < 1.05 * min(sizes.values())


def test_splitters_split_heavy_keys_only():
    cuts = sharding.quantiles([(5, t, 1.0) for t in range(50)] + [(k, 0, 1.0) for k in range(10, 60)], 10)
    assert sharding._twice(cuts) == {5}
    cuts = sharding.splitters(cuts, {5})
    assert (5, -(1 << 63)) in cuts and (6, -(1 << 63)) in cuts
    assert sum(k == 5 for k, _ in cuts) >= 4
    assert all(t == -(1 << 63) for k, t in cuts if k != 5)
    assert sharding.splitters([(5, 1), (5, 2), (7, 3)], set()) == [(5, -(1 << 63)), (7, -(1 << 63))]


# 2 quality


def brute_features(text):
    toks = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff\s]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return toks + list(zip(toks, toks[1:]))


def brute_mix(h):
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> shift) * times % (1 << 64)
    return h ^ h >> 31


def brute_bucket(feature, buckets):
    word = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    h = word(feature) if isinstance(feature, str) else brute_mix((3 * word(feature[0]) + word(feature[1]) + 1) % (1 << 64))
    return h % buckets


def brute_weights(texts, target):
    """Log importance weight of each text (None without a feature); target: numbers of the target texts."""
    raw, good = collections.Counter(), collections.Counter()
    found = [[brute_bucket(f, dsir.BUCKETS) for f in brute_features(t)] for t in texts]
    for i, f in enumerate(found):
        raw.update(f)
        if i in target:
            good.update(f)
    share = sum(good.values()) / max(1, sum(raw.values()))
    ratio = {b: math.log((good[b] + dsir.PRIOR) / (n * share + dsir.PRIOR)) if share else 0.0 for b, n in raw.items()}
    return [math.fsum(ratio[b] for b in f) if f else None for f in found]


def brute_noise(h):
    return -math.log(-math.log(((h % (1 << 64) >> 11) + 0.5) / (1 << 53)))


def good_and_junk(rng, n=400, labelled=200):
    vocab = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocab) + ("%%%" if i % 5 == 0 else "") for _ in range(rng.randint(1, 60)))) for i in range(n)]
    return rows, [(i, int(i % 5 != 0), 0) for i in range(labelled)]


def test_quality_features(rows):
    texts = [t or "" for _, t, *_ in rows if t != "" and (t is None or len(t) < 5000)]
    doc, bucket = dsir.features(pa.array(texts), 1 << 40)
    for i, t in enumerate(texts):
        assert sorted(bucket[doc == i].tolist()) == sorted(brute_bucket(f, 1 << 40) for f in brute_features(t))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quality_weights_noise_and_draw(spark, seed):
    rows, labels = good_and_junk(random.Random(2))
    rows += [(None, "abc abc"), (None, "abc abc"), (None, None), (900, ""), (901, " \n"), (3, "a second text of an id")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_weights([t for _, t in rows], {k for k, (i, _) in enumerate(rows) if i is not None and i < 200 and i % 5})
    h = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(seed)).alias("h")).collect()}
    scored = sorted(((w + brute_noise(h[r]), w) for r, w in zip(rows, want) if w is not None), reverse=True)
    for k in (1, 57, 300):
        got = dsir.resample(docs, lab, k=k, seed=seed).collect()
        assert len(got) == len(rows) and sum(r["kept"] for r in got) == k
        for r, (i, t), w in zip(got, rows, want):
            assert r["id"] == i and (r["log_weight"] is None) == (w is None) and (w is not None or not r["kept"])
            if w is not None:
                assert math.isclose(r["log_weight"], w, abs_tol=1e-9) and math.isclose(r["score"], w + brute_noise(h[i, t]), abs_tol=1e-9)
                assert r["kept"] == (r["score"] >= scored[k - 1][0] - 1e-12)
    cut = sorted((w for w in want if w is not None), reverse=True)[56]
    some = dsir.resample(docs, lab, k=57, seed=seed).collect()
    assert any(r["kept"] != (r["log_weight"] >= cut) for r in some if r["log_weight"] is not None)  # chance decides, not a threshold
    assert {r["doc_id"] for r in dsir.drawn(docs, lab, k=57, seed=seed).collect()} == {r["id"] for r in some if r["kept"]}


def test_gumbel_top_k_draws_in_proportion_to_the_weights():
    weights = np.array([0.5, 0.25, 0.15, 0.1])
    h = np.random.default_rng(5).integers(0, 1 << 64, (200_000, 4), dtype=np.uint64)
    order = np.argsort(-(np.log(weights) + dsir.gumbel(h)), axis=1)
    first = np.bincount(order[:, 0], minlength=4) / len(h)
    assert np.abs(first - weights).max() < 0.005
    both = {(i, j): np.mean((order[:, 0] == i) & (order[:, 1] == j)) for i in range(4) for j in range(4) if i != j}
    assert all(abs(p - weights[i] * weights[j] / (1 - weights[i])) < 0.005 for (i, j), p in both.items())


def test_quality_keeps_the_good_share(spark):
    rows, labels = good_and_junk(random.Random(2))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert math.isclose(dsir.good_share(lab), 0.8 + 3 * (0.8 * 0.2 / 200) ** 0.5)
    got = dsir.resample(docs, lab).collect()
    assert sum(r["kept"] for r in got) == math.ceil(400 * dsir.good_share(lab)) and all(r["kept"] for r in got if r["id"] % 5)
    assert [r["kept"] for r in dsir.resample(docs, lab, fraction=0.0).collect()] == [False] * 400
    assert all(r["kept"] for r in dsir.resample(docs, lab, k=1000).collect())


def test_quality_edges(docs, folly, empty, spark, rows):
    lab = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    none = lab.where("false")
    out = dsir.resample(docs, lab)
    assert out.count() == len(rows) and tuples(dsir.resample(folly, lab)) == tuples(out)
    for r in dsir.resample(docs, none).collect():
        assert (r["kept"], r["log_weight"]) == ((False, None) if r["id"] in (130, 131, 132) or (r["id"] is None and r["score"] is None) else (True, 0.0))
    assert dsir.resample(empty, lab).collect() == [] and dsir.drawn(empty, none).collect() == []
    assert dsir.drawn(folly, lab).columns == folly.columns


def test_kth_largest(spark):
    rng = random.Random(4)
    vals = [rng.randint(-(1 << 62), 1 << 62) for _ in range(200)] + [0, 0, 0, -1]
    df = spark.createDataFrame([(v,) for v in vals], "key long")
    down = sorted(vals, reverse=True)
    for k in (1, 7, 100, 101, 102, 103, len(vals)):
        assert dsir.kth_largest(df, k) == (down[k - 1], k - sum(v > down[k - 1] for v in vals))
    assert dsir.kth_largest(df, 0) is None and dsir.kth_largest(df, 999)[0] == down[-1] and dsir.kth_largest(df.where("false"), 3) is None


# 3 urls

URLS = [
    "http://A.Example.ORG/es/1", "https://example.org/en/17?x", "https://x.example.org/en/27#a", "http://foo.com/fr/1", "http://foo.com/de/1", "http://foo.net/a.html", "http://www.foo.net/a", "HTTP://m.foo.net/a/", "no scheme", "", None,
    "://", "http://", "http://org", "http://notexample.org/es/", "http://com/fr/", "ftp://u@h.net:80/p?q", "a://b.net://c", "http://foo.net?x", "http://foo.net/a\nb",
]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    bare = re.sub(r"^(www\.|m\.)+", "", re.sub(r":\d*$", "", re.sub(r"^[^@]*@", "", host)))
    canon = bare + re.sub(r"(\.html?)?/*$", "", path) if bare else None
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None, canon


@pytest.mark.parametrize("blocks", [urlfilter.BROADCAST_BLOCKS, 0])
def test_urls(spark, blocks):
    rng = random.Random(3)
    urls = URLS + [f"http://h{rng.randint(0, 30)}.net/p{rng.randint(0, 50)}" for _ in range(400)] + ["http://hot.net/x"] * 200
    pages = spark.createDataFrame([(i, u, "f", True) for i, u in enumerate(urls)], "page_id long, url string, verdict string, listed boolean")
    listed = [u for i, u in enumerate(urls) if i % 7 == 0] + ["http://hot.net/x.html", None]
    canon = {brute_url(u)[4] for u in listed} - {None}
    out = urlfilter.judge_urls(pages, spark.createDataFrame([(u,) for u in listed], "url string"), broadcast_blocks=blocks).collect()
    assert len(out) == len(urls)
    for r in out:
        host, path, rule, verdict, c = brute_url(urls[r["id"]])
        assert (r["host"], r["path"], r["rule"], r["canon"], r["listed"]) == (host, path, rule, c, c in canon)
        assert r["verdict"] == (verdict or ("block" if c in canon else "allow"))
        assert r["bloom_hit"] or not r["listed"]
    false = sum(r["bloom_hit"] and not r["listed"] for r in out)
    assert false <= 40


def test_urls_with_columns_of_the_operators_own_names(spark):
    names = "host path rule canon block w0 listed verdict bloom_hit id"
    pages = spark.createDataFrame([(i, u, *["x"] * 10) for i, u in enumerate(URLS)], f"page_id long, url string, {', '.join(n + ' string' for n in names.split())}")
    plain, listed = pages.select("page_id", "url"), pages.where("page_id % 3 = 0")
    assert tuples(urlfilter.judge_urls(pages, listed)) == tuples(urlfilter.judge_urls(plain, listed.select("url")))


def test_urls_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://a.net/x"), (None, None)], "page_id long, url string")
    assert urlfilter.judge_urls(none, none).collect() == []
    assert {r["verdict"] for r in urlfilter.judge_urls(some, none).collect()} == {"allow"}


# 4 mixing


def brute_schedule(blocks, weights):
    """Slot by slot, earliest deadline first among the released, with exact fractions: {(source, block): slot}."""
    total = sum(weights)
    n = [Fraction(max(1, round(w / total * mixing.UNIT))) for w in weights]
    slots, done, begin, since, t = {}, [0] * len(blocks), 0, [0] * len(blocks), 0
    while any(d < b for d, b in zip(done, blocks)):
        live = [i for i, b in enumerate(blocks) if done[i] < b]
        share = {i: n[i] / sum(n[j] for j in live) for i in live}
        ready = [(math.ceil((done[i] - since[i] + 1) / share[i]), i) for i in live if math.floor((done[i] - since[i]) / share[i]) <= t - begin]
        _, i = min(ready)
        slots[i, done[i]] = t
        done[i], t = done[i] + 1, t + 1
        if done[i] == blocks[i]:
            begin, since = t, list(done)
    return slots


def key_of(source):
    return "n" if source is None else f"s{source}"


@pytest.mark.parametrize("heavy", [mixing.HEAVY_ROWS, 3])
def test_mixing_matches_simulation(docs, folly, empty, rows, monkeypatch, heavy):
    monkeypatch.setattr(mixing, "HEAVY_ROWS", heavy)
    totals = collections.Counter()
    for i, t, _, s, _ in rows:
        totals[key_of(s)] += len((t or "").encode()) + 1
    names = sorted(totals)
    for weights in (None, {"s0": 5.0, "s1": 1.3, "s2": 2.0, None: 1.0}):
        out = mixing.mix(docs, weights, block_bytes=512)
        got = out.collect()
        assert collections.Counter((r["id"], r["source"], r["size"]) for r in got) == collections.Counter((i, s, len((t or "").encode()) + 1) for i, t, _, s, _ in rows)
        given = [float(totals[s]) ** mixing.ALPHA if weights is None else {key_of(k): v for k, v in weights.items()}.get(s, 1.0) for s in names]
        want = brute_schedule([-(-totals[s] // 512) for s in names], given)
        for r in got:
            i = names.index(key_of(r["source"]))
            assert r["block"] == r["start"] // 512 and r["slot"] == want[i, r["block"]] and r["slots"] == len(want)
        for s in names:  # a source's rows tile its bytes
            mine = sorted((r["start"], r["size"]) for r in got if key_of(r["source"]) == s)
            assert mine[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(mine, mine[1:]))
    assert tuples(mixing.mix(folly, weights, block_bytes=512).select("source", "slots")) == tuples(out.select("source", "slots"))
    assert mixing.mix(empty).collect() == []
    carried = mixing.mix(docs, block_bytes=512, carry=tuple(docs.columns)).select("__row.*")
    assert tuples(carried) == tuples(docs)


@pytest.mark.parametrize("weights", [[0.9, 0.0925, 0.0075], [math.pi, math.e, 1.0, 0.001, 7.77], [1.0] * 7, [5.0**-k for k in range(9)]])
def test_mixing_keeps_every_source_within_a_block(spark, weights):
    """Against the weights as given, at every slot of every stretch, over more than 10,000 slots."""
    rng = random.Random(3)
    blocks = [max(1, round(11_000 * w / sum(weights) * rng.uniform(1, 1.05))) for w in weights]
    frame = spark.createDataFrame([(f"s{i}", b * 10 - 3, w) for i, (b, w) in enumerate(zip(blocks, weights))], "source string, bytes long, weight double")
    order = [r["source"] for r in mixing.schedule(frame, 10).orderBy("slot").collect()]
    assert len(order) == sum(blocks) > 10_000 and collections.Counter(order) == {f"s{i}": b for i, b in enumerate(blocks)}
    left, worst, t = dict(enumerate(blocks)), 0.0, 0
    had, since = dict.fromkeys(left, 0), 0
    for s in order:
        i = int(s[1:])
        had[i], left[i], t = had[i] + 1, left[i] - 1, t + 1
        live = sum(weights[j] for j in had)
        worst = max(worst, max(abs(had[j] - weights[j] / live * (t - since)) for j in had))
        if not left[i]:
            had, since = {j: 0 for j in had if left[j]}, t
    assert worst < 1 + 1e-6


def test_mixing_takes_many_sources(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50), f"s{i % 1500}") for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 3000 and {r["slot"] for r in got} == set(range(1500))


def test_mixing_cuts_a_heap_of_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HEAVY_ROWS", 500)
    docs = spark.range(8000).selectExpr("if(id < 4000, null, id) as doc_id", "'the same' as text", "'hot' as source")
    plan = mixing.mix(docs, block_bytes=900)
    spread = docs.sparkSession.createDataFrame(plan.select("start", "size").collect(), "start long, size long")
    starts = sorted(r["start"] for r in spread.collect())
    assert starts == [9 * k for k in range(8000)]
    rows = mixing.mix(docs, block_bytes=900, carry=("doc_id",))
    assert rows.where("__row.doc_id is null").count() == 4000


@pytest.mark.parametrize("weights", [{"s0": 0.0}, {"s0": -1.0, "s1": 2.0}, {}, {"s0": float("nan")}])
def test_mixing_refuses_bad_weights(docs, weights):
    with pytest.raises(ValueError):
        mixing.mix(docs, weights)


# 5 repetition


def brute_repetition(text):
    w = words_of(text)
    n = len(w)
    best = [0] * n
    for i, j in itertools.combinations(range(n), 2):
        k = 0
        while j + k < n and w[i + k] == w[j + k]:
            k += 1
        best[i], best[j] = max(best[i], k), max(best[j], k)

    def cover(least, length):
        s = set()
        for i, b in enumerate(best):
            if b >= least:
                s |= set(range(i, i + (length or b)))
        return len(s)

    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if words_of(x):
            dup += x in seen
            seen.add(x)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, cover(3, 3), cover(repetition.MIN_REPEAT, None), max(best, default=0)


def repetitive(rng):
    vocab = ["aé", "b", "c|", "dd", "#x"]
    return "".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "\t "]) for _ in range(rng.randint(0, 90)))


def test_repetition(docs, folly, empty, spark, rows):
    rng = random.Random(6)
    extra = [(1000 + i, repetitive(rng)) for i in range(60)] + [(2000, "a " * 200), (2001, "x y z " * 30), (2002, "same line here\n" * 9)]
    mine = spark.createDataFrame([(i, t) for i, t, *_ in rows if t is None or len(t) < 5000] + extra, "doc_id long, text string")
    texts = collections.defaultdict(list)
    for r in mine.collect():
        texts[r["doc_id"]].append(r["text"])
    for r in repetition.judge_repetition(mine).collect():
        want = [brute_repetition(t) for t in texts[r["id"]]]
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["covered_words"], r["longest_repeat"])
        assert got in want
        base = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == base
        assert r["kept"] == (not base and r["covered_words"] <= repetition.MAX_COVERED * r["n_words"] and r["longest_repeat"] <= repetition.MAX_LONGEST * r["n_words"])
    assert tuples(repetition.judge_repetition(folly)) == tuples(repetition.judge_repetition(docs))
    assert repetition.judge_repetition(empty).collect() == []


def brute_maximal(text, least):
    """Repeats that neither the word before nor the word after extends at all their places."""
    w, found = words_of(text), 0
    n = len(w)
    for size in range(least, n):
        at = collections.defaultdict(list)
        for i in range(n - size + 1):
            at[tuple(w[i : i + size])].append(i)
        for places in at.values():
            before = {w[i - 1] if i else -i - 1 for i in places}
            after = {w[i + size] if i + size < n else -1 for i in places}
            found += len(places) > 1 and len(before) > 1 and len(after) > 1
    return found


@pytest.mark.parametrize("dense", [0, repetition.DENSE])
def test_repeats_are_counted_maximal(monkeypatch, dense):
    monkeypatch.setattr(repetition, "DENSE", dense)
    rng = random.Random(16)
    texts = [repetitive(rng) for _ in range(40)] + [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(20)]
    part = " ".join(f"p{k}" for k in range(9))
    texts += [f"x {part} y {part} z", f"x {part} y {part} b", f"{part} q {part}", "a " * 30, "x y z " * 12, "", None]
    got = repetition.measure(pa.array(texts))["n_repeats"].tolist()
    assert got == [brute_maximal(t, repetition.MIN_REPEAT) for t in texts] and max(got) > 5


def thue_morse(k, zero="a", one="b"):
    """Two strings that collide under a polynomial hash modulo 2^64, whatever its odd base."""
    x, y = zero, one
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


def test_identities_are_exact(spark):
    x, y = thue_morse(12)
    text = "\n".join([x, y])
    m = repetition.measure(pa.array([text, x + " " + y + " " + x]))
    assert m["n_dup_lines"].tolist() == [0, 0] and m["longest_repeat"].tolist() == [0, 1]
    buf, off = textkit.flat(pa.array([x, y, x]))
    assert textkit.span_ids(buf, off[:-1], off[1:]).tolist() == [0, 1, 0]
    assert [int(h) for h in textkit.span_hashes(buf, off[:-1], off[1:])] == [xxhash.xxh64_intdigest(t, 42) for t in (x, y, x)]


MEMORY = """
import resource, sys
import numpy as np, pyarrow as pa
from ruletide.llm import {module} as module, textkit
rng = np.random.default_rng(3)
words = rng.integers(97, 123, (14_000_000, 6), dtype=np.uint8)
text = np.concatenate((words, np.full((len(words), 1), 32, np.uint8)), axis=1).tobytes().decode()
del words
column = pa.array([text], pa.large_string())
del text
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{call}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("module,call,most", [("repetition", "assert module.measure(column)['n_words'].tolist() == [14_000_000]", 2600)])
def test_memory_of_a_text_of_98_mb(module, call, most):
    """MB over what the text itself takes."""
    root = pathlib.Path(__file__).resolve().parents[2]
    ran = subprocess.run([sys.executable, "-c", MEMORY.format(module=module, call=call)], capture_output=True, text=True, cwd=root, check=True)
    assert int(ran.stdout.split()[-1]) < most


def test_a_long_repeat_fails_alone(spark):
    w = [f"w{k}" for k in range(200)]
    docs = spark.createDataFrame([(1, " ".join(w + w[:36])), (2, " ".join(w + w[:30]))], "doc_id long, text string")
    got = {r["id"]: r for r in repetition.judge_repetition(docs).collect()}
    assert got[1]["longest_repeat"] == 36 and got[1]["covered_words"] <= repetition.MAX_COVERED * got[1]["n_words"] and not got[1]["base_failed"]
    assert not got[1]["kept"] and got[2]["kept"]


@pytest.mark.parametrize("dense", [0, repetition.DENSE])
def test_suffix_array_is_sorted(monkeypatch, dense):
    monkeypatch.setattr(repetition, "DENSE", dense)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 200)
    order, levels = repetition.suffix_array(x, 200 - np.arange(200))
    assert [x[i:].tolist() for i in order] == sorted(x[i:].tolist() for i in range(200))
    lcp = repetition.common_prefixes(order, levels, 200 - np.arange(200))
    for k, (i, j) in enumerate(zip(order, order[1:])):
        n = next((m for m in range(200) if i + m >= 200 or j + m >= 200 or x[i + m] != x[j + m]), 200)
        assert lcp[k] == n


# 6 fingerprints


def brute_sigs(text):
    toks = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
    anchors = {a.encode() for a in spotsigs.ANCHORS}
    content = [i for i, w in enumerate(toks) if w not in anchors]
    out = lambda starts: {(toks[i], *(toks[j] for j in [c for c in content if c > i][: spotsigs.CHAIN])) for i in starts}
    spots = [i for i, w in enumerate(toks) if w in anchors and any(c > i for c in content)]
    return out(spots or range(len(toks)))


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(docs, folly, empty, spark, rows):
    rng = random.Random(8)
    some = [(i, t) for i, t, *_ in rows if i is not None and i not in (0, 140)] + [(200 + i, " ".join(rng.choice(["the", "of", "der", "alpha", "beta", "gam", "É"]) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    some.sort()
    got = {r["id"]: r for r in spotsigs.fingerprints(spark.createDataFrame(some, "doc_id long, text string").repartition(5)).collect()}
    assert len(got) == len(some)
    prints = {}
    for k, (i, t) in enumerate(some):
        t, nxt = t or "", some[(k + 1) % len(some)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        r, s, es, ns = got[i], brute_sigs(t), brute_sigs(edited), brute_sigs(nxt)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(r["near_edited"], likeness(s, es)) and math.isclose(r["near_next"], likeness(s, ns))
        assert prints.setdefault(frozenset(s), r["fingerprint"]) == r["fingerprint"]
        assert prints.setdefault(frozenset(es), r["edited_fingerprint"]) == r["edited_fingerprint"]
    assert len(set(prints.values())) == len(prints)
    assert spotsigs.fingerprints(docs).count() == len(rows)
    assert tuples(spotsigs.fingerprints(folly)) == tuples(spotsigs.fingerprints(docs))
    assert spotsigs.fingerprints(empty).collect() == []
    one = spotsigs.fingerprints(spark.createDataFrame([(1, "the only text of all")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_signature_matches(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(40)]
    texts = []
    for _ in range(25):
        w = [rng.choice(vocab) if rng.random() < 0.6 else rng.choice(["the", "of", "to"]) for _ in range(80)]
        texts.append(" ".join(w))
        for _ in range(3):
            w[rng.randrange(80)] = rng.choice(vocab)
            texts.append(" ".join(w))
    sets = spotsigs.signature_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    sigs = {r["fingerprint"]: set(r["sigs"]) for r in sets.collect()}
    want = {tuple(sorted(p)) for p in itertools.combinations(sigs, 2) if likeness(sigs[p[0]], sigs[p[1]]) >= 0.8}
    got = {tuple(sorted((r[0], r[1]))) for r in spotsigs.matches(sets).collect()}
    assert want and got == want


# 7 simhash


def brute_fingerprint(text):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    ids = list(pairs)
    label = {i: i for i in range(len(ids))}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(ids)), 2):
            if label[a] != label[b] and (pairs[a][1] ^ pairs[b][1]).bit_count() <= 3:
                lo, hi = sorted((label[a], label[b]))
                label = {k: lo if v == hi else v for k, v in label.items()}
                changed = True
    out = {}
    for i in range(len(ids)):
        known = [pairs[j][0] for j in range(len(ids)) if label[j] == label[i] and pairs[j][0] is not None]
        out[i] = min(known) if known else None
    return out


def test_simhash(docs, folly, empty, rows):
    pairs = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    comp = brute_components(pairs)
    want = collections.Counter((i, f"{f:016x}", comp[k]) for k, (i, f) in enumerate(pairs))
    out = simhash.near_duplicates(docs)
    assert tuples(out.select("id", simhash.hex_digits(F.col("fp")), "component")) == want
    assert tuples(simhash.near_duplicates(folly)) == tuples(out)
    assert simhash.near_duplicates(empty).collect() == []
    assert len(set(comp.values())) < len(comp)


@pytest.mark.parametrize("slice_", [8192, 64])
def test_links_are_complete(spark, monkeypatch, slice_):
    monkeypatch.setattr(simhash, "SLICE", slice_)
    rng = random.Random(10)
    seeds = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    values = set(seeds)
    for s in seeds[:20]:
        for _ in range(40):
            x = s
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    made = {r["node"]: r["root"] for r in graph.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    got = collections.defaultdict(set)
    for v in signed:
        got[made.get(v, v)].add(v)
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(values)), 2):
        if (values[a] ^ values[b]).bit_count() <= 3:
            parent[find(a)] = find(b)
    want = collections.defaultdict(set)
    for i, v in enumerate(signed):
        want[find(i)].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (3, 2)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, **{1000 + i: 1000 for i in range(1, 200)}}


# 8 packing


def test_packing(docs, folly, empty, rows):
    out = packing.best_fit(docs, group_tokens=4000)
    got = out.collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        want[i] += len(words_of(t)) + 1
    have = collections.Counter()
    for r in got:
        have[r["id"]] += r["length"]
    assert have == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["bin"]].append(r)
    for rs in bins.values():
        rs.sort(key=lambda r: r["bin_offset"])
        used = sum(r["length"] for r in rs)
        assert {r["used"] for r in rs} == {used} and {r["capacity"] for r in rs} == {min(s for s in packing.LENGTHS if s >= used)}
        assert [r["bin_offset"] for r in rs] == list(itertools.accumulate([0, *(r["length"] for r in rs[:-1])]))
    pieces = ("id", "piece", "start", "length")
    assert tuples(packing.best_fit(folly, group_tokens=4000).select(*pieces)) == tuples(out.select(*pieces))
    assert packing.best_fit(empty).collect() == []


def test_a_heap_of_rows_without_id_is_many_groups(spark):
    docs = spark.range(20_000).selectExpr("if(id < 15000, null, id % 3) as doc_id", "'one two three' as text")
    sizes = collections.Counter(r["bin"].split("-")[0] for r in packing.best_fit(docs, group_tokens=8000).collect())
    assert sum(sizes.values()) == 20_000 and len(sizes) == 10 and max(sizes.values()) < 3000


def brute_pack(lengths, sizes):
    rooms, where = [], []
    for n in lengths:
        fit = [(r, b) for b, r in enumerate(rooms) if r >= n]
        if fit:
            least = min(r for r, _ in fit)
            b = max(b for r, b in fit if r == least) if False else next(b for r, b in fit if r == least)
        else:
            b = len(rooms)
            rooms.append(packing.opening(n, sizes))
        rooms[b] -= n
        where.append(b)
    return rooms, where


def test_pack_is_best_fit():
    rng = random.Random(11)
    for _ in range(30):
        sizes = tuple(sorted(rng.sample(range(20, 200), 3)))
        lengths = sorted((rng.randint(1, max(sizes)) for _ in range(60)), reverse=True)
        where, offset, capacity, used = packing.pack(lengths, sizes)
        rooms, brute = brute_pack(lengths, sizes)
        assert len(used) == len(rooms) and sorted(used) == sorted(collections.Counter({b: sum(n for n, w in zip(lengths, brute) if w == b) for b in set(brute)}).values())
        assert all(u <= c for u, c in zip(used, capacity))


def test_sizes_are_chosen_jointly(spark):
    rng = random.Random(12)
    lengths = sorted((min(4096, int(rng.lognormvariate(5.3, 0.9)) + 1) for _ in range(400)), reverse=True)
    cost = lambda t: sum(t[2]) + packing.OVERHEAD * len(t[2])
    alone, joint = packing.pack(lengths), packing.pack_jointly(lengths)
    assert cost(joint) < cost(alone) and sum(joint[3]) == sum(lengths)
    docs = spark.createDataFrame([(i, "w " * (n - 1)) for i, n in enumerate(lengths)], "doc_id long, text string").coalesce(1)
    bins = {r["bin"]: (r["capacity"], r["used"]) for r in packing.best_fit(docs).collect()}
    most = collections.defaultdict(int)
    for r in packing.best_fit(docs).collect():
        most[r["bin"]] = max(most[r["bin"]], r["length"])
    assert sum(c + packing.OVERHEAD for c, _ in bins.values()) == cost(joint)
    assert sum(most[b] <= 512 and c == 4096 for b, (c, _) in bins.items()) > 0  # larger than any piece needs
    assert any(c < 4096 for c, _ in bins.values())  # and downsized at the end


def test_sequences_hold_the_words(spark):
    texts = {1: "a b c", 2: "d " * 700, 3: "", 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seqs = packing.sequences(packing.best_fit(docs, sizes=(64, 512)), docs).collect()
    assert collections.Counter(w for r in seqs for w in words_of(r["text"])) == collections.Counter(w for t in texts.values() for w in words_of(t))
    assert {i for r in seqs for i in r["ids"]} == set(texts)


# 9 lines


@pytest.mark.parametrize("bound", [linefreq.BROADCAST_LINES, 0])
@pytest.mark.parametrize("whole", [False, True])
def test_lines(docs, folly, empty, rows, bound, whole):
    total = collections.Counter(s for *_, s, _ in rows)
    seen = collections.Counter()
    for _, t, _, s, _ in rows:
        for x in {x for x in (t or "").split("\n") if words_of(x)}:
            seen[s, x] += 1
    drop = {k for k, n in seen.items() if n >= linefreq.MIN_PAGES and n > total[k[0]] * linefreq.RATIO}
    want = collections.Counter()
    for i, t, lang, s, n in rows:
        full = [x for x in (t or "").split("\n") if words_of(x)]
        gone = [x for x in full if (s, x) in drop]
        left = whole and len(gone) == len(full)
        kept = t if t is None or left else "\n".join(x for x in t.split("\n") if (s, x) not in drop)
        want[i, kept, lang, s, n, len(full), 0 if left else len(gone)] += 1
    named = {"counts": ("lines", "gone"), "broadcast_lines": bound, "keep_whole": whole}
    out = linefreq.drop_boilerplate(docs, **named)
    assert tuples(out) == want and out.columns == [*docs.columns, "lines", "gone"]
    assert any(k[6] for k in want) and (any(k[1] == "" and k[6] for k in want) != whole)
    strange = linefreq.drop_boilerplate(folly, broadcast_lines=bound, keep_whole=whole)
    assert strange.columns == folly.columns and tuples(strange) == collections.Counter({(*k[:5], *("x" if "string" in c else 7 for c in FOLLY.split(", "))): n for k, n in tally(want, 5).items()})
    assert linefreq.drop_boilerplate(empty, **named).collect() == []


def tally(counter, width):
    out = collections.Counter()
    for k, n in counter.items():
        out[k[:width]] += n
    return out


def test_a_small_host_keeps_its_lines(spark):
    docs = spark.createDataFrame([(1, "only page\nof its host", "a"), (2, "menu\nx", "b"), (3, "menu\ny", "b")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["text"] for r in linefreq.drop_boilerplate(docs).collect()} == {1: "only page\nof its host", 2: "x", 3: "y"}


# 10 languages


def language_docs(spark, n=400):
    rng = random.Random(12)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "ung", "ein", "öz"], "cc": ["tion", "eau", "ç", "qui"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 150))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_language(spark):
    docs, rows = language_docs(spark)
    out = langid.identify(docs).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(rows) and all(r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in out)
    assert sum(truth[r["id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)
    hidden = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("aa")).otherwise(F.col("lang")))
    assert tuples(langid.identify(hidden)) == tuples(langid.identify(docs))


def test_language_edges(docs, folly, empty, rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["id"] in (130, 131, 132, 133):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["id"] is not None:
            assert r["lang_pred"] in ("en", "de", "fr")
    assert tuples(langid.identify(folly)) == tuples(langid.identify(docs))
    assert langid.identify(empty).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = langid.ByteNet(["x", "y"])
    x, y = rng.integers(0, 60, (6, 12)).astype(np.int32), rng.integers(0, 2, 6)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: -np.log(net.predict(x, net.pairs())[np.arange(6), y]).mean()
    g = net._gradient(x, y)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        for i in np.argsort(-np.abs(g[k].reshape(-1)))[:3]:
            keep = flat[i]
            flat[i] = keep + 1e-5
            up = loss()
            flat[i] = keep - 1e-5
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-5 - g[k].reshape(-1)[i]) < 2e-3  # the maxima are kept in single precision


# text primitives


def test_spans_hash_alike_wherever_they_stand():
    buf, off = textkit.flat(pa.array(["ab ab", None, "", "x ab"]))
    s, e, doc = textkit.words(buf, off)
    h = textkit.span_hashes(buf, s, e)
    assert doc.tolist() == [0, 0, 3, 3] and h[0] == h[1] == h[3] != h[2]
    assert [x.num_rows for x in textkit.slices(pa.RecordBatch.from_arrays([pa.array(["aaa", "bb", "cccccc", "d"])], ["t"]), "t", 4)] == [1, 1, 1, 1]
