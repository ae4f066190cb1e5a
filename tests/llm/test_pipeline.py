"""The pipeline against a brute-force version, stage by stage, on a small corpus."""

from __future__ import annotations

import collections
import math
import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_jaccard import brute_groups
from test_operators import WORD, brute_noise, brute_schedule, brute_weights, key_of

from ruletide.llm import linefreq, mixing, packing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    rows, labels = [], []
    for i in range(240):
        junk = i % 6 == 0
        lines = [" ".join(rng.choice(vocab) + ("&&&" if junk else "") for _ in range(rng.randint(5, 15))) for _ in range(6)]
        if i % 3 == 0:
            lines.insert(2, "Subscribe to our newsletter today")
        rows.append((i, "\n".join(lines), "en", f"s{i % 5}"))
        if i < 150:
            labels.append((i, int(not junk), 0))
    rows += [(300 + k, rows[1][1], "en", "s1") for k in range(8)] + [rows[2], (400, None, None, "s0"), (401, "", "en", None)]
    rows = [(*r, len(r[1] or "")) for r in rows]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows, labels


def lines_of(text):
    return (text or "").split("\n")


def solid(line):
    return bool(re.search(WORD, line))


def brute_quality(spark, rows, labels):
    """The rows of the k largest sums of log ratios and noise."""
    good = [q for _, q, _ in labels]
    share = sum(good) / len(good)
    target = {i for i, q, _ in labels if q == 1}
    weight = brute_weights([r[1] for r in rows], {k for k, r in enumerate(rows) if r[0] in target})
    table = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(rows)], "k long, doc_id long, text string")
    h = {r["k"]: r["h"] for r in table.select("k", F.xxhash64("doc_id", "text", F.lit(1)).alias("h")).collect()}
    able = [k for k, w in enumerate(weight) if w is not None]
    most = math.ceil(len(able) * min(1, share + 3 * (share * (1 - share) / len(good)) ** 0.5))
    score = {k: weight[k] + brute_noise(h[k]) for k in able}
    least = sorted(score.values(), reverse=True)[most - 1]
    return [rows[k] for k in able if score[k] >= least]


def brute_lines(rows):
    total = collections.Counter(r[3] for r in rows)
    seen = collections.Counter((r[3], x) for r in rows for x in {x for x in lines_of(r[1]) if solid(x)})
    drop = {k for k, n in seen.items() if n >= linefreq.MIN_PAGES and n > linefreq.RATIO * total[k[0]]}
    out = []
    for i, t, lang, s, n in rows:
        gone = [x for x in lines_of(t) if (s, x) in drop]
        if t is not None and len(gone) < sum(map(solid, lines_of(t))):
            t = "\n".join(x for x in lines_of(t) if (s, x) not in drop)
        out.append((i, t, lang, s, None if t is None else len(t)))
    return out


def test_stages_match_brute_force(spark, corpus):
    d, rows, labels = corpus
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = stage["quality"](spark, docs, d)
    want = brute_quality(spark, rows, labels)
    assert sum("&&&" in r[1] for r in rows if r[1]) > sum("&&&" in r[1] for r in want) and all(r in want for r in rows if r[1] and "&&&" not in r[1])
    assert kept.columns == docs.columns
    assert collections.Counter(map(tuple, kept.collect())) == collections.Counter(want)
    lined = stage["line_dedup"](spark, kept.checkpoint(), d)
    want = brute_lines(want)
    assert lined.columns == docs.columns and any("Subscribe" not in (r[1] or "") for r in want)
    assert collections.Counter(map(tuple, lined.collect())) == collections.Counter(want)
    single = stage["near_dedup"](spark, lined.checkpoint(), d)
    want.sort(key=lambda r: r[0])
    group = brute_groups([r[1] for r in want])
    assert len(set(group)) < len(want)
    want = [r for k, r in enumerate(want) if group[k] == k]
    assert sorted(map(tuple, single.collect()), key=lambda r: r[0]) == want
    mixed = stage["mixing"](spark, single.checkpoint(), d)
    order = [tuple(r) for r in mixed.collect()]
    assert collections.Counter(order) == collections.Counter(want) and mixed.columns == docs.columns
    totals = collections.Counter()
    for r in want:
        totals[key_of(r[3])] += len((r[1] or "").encode()) + 1
    names = sorted(totals)
    slots = brute_schedule([-(-totals[s] // mixing.BLOCK_BYTES) for s in names], [float(totals[s]) ** mixing.ALPHA for s in names])
    place = {r["id"]: (r["slot"], r["start"]) for r in mixing.mix(single).collect()}
    assert [r[0] for r in order] == sorted((r[0] for r in want), key=place.get)
    assert all(place[r[0]][0] == slots[names.index(key_of(r[3])), place[r[0]][1] // mixing.BLOCK_BYTES] for r in want)
    bins = stage["packing"](spark, mixed, d).collect()
    tokens = collections.Counter()
    for r in bins:
        tokens[r["doc_id"]] += r["length"]
    assert tokens == {r[0]: len(re.findall(WORD, r[1] or "")) + 1 for r in want}
    assert all(r["used"] <= r["capacity"] and r["capacity"] in packing.LENGTHS for r in bins)


def test_run_is_the_stages(spark, corpus):
    d, _, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:3]:
        docs = f(spark, docs, d).checkpoint()
    ids = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()} == ids


def test_edges_pass_through(spark, docs, folly, empty, tmp_path):
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, folly, empty):
        now, extra = table, [f"`{c}`" for c in table.columns[5:]]
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            now = f(spark, now, str(tmp_path)).checkpoint()
            assert k == len(corpus_pipeline.STAGES) - 1 or now.columns == table.columns
            if k < len(corpus_pipeline.STAGES) - 1:  # values of columns that the operators have names for stay as they are
                assert now.select(*extra).distinct().count() <= 1 and all(v in ("x", 7) for r in now.select(*extra).limit(1).collect() for v in r)
        assert (now.count() > 0) == (table.count() > 0)


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_bins_follow_the_mixed_order(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(100, 700), "en", f"s{i % 3}", 0) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = {}
    for name, weights in (("even", None), ("first", {"s0": 50.0, "s1": 1.0, "s2": 1.0})):
        plan = mixing.mix(docs, weights, block_bytes=4096, carry=tuple(docs.columns))
        now = mixing.in_order(plan).select("__row.*")
        now.write.parquet(f"{tmp_path}/{name}")
        order = {r["id"]: k for k, r in enumerate(sorted(plan.select("id", "slot", "start").collect(), key=lambda r: (r["slot"], r["start"])))}
        for again in (spark.read.parquet(f"{tmp_path}/{name}"), now.checkpoint()):
            got = packing.best_fit(again, group_tokens=20_000, ordered=True).collect()
            groups = collections.defaultdict(list)
            for r in got:
                groups[int(r["bin"].split("-")[0])].append(r)
            assert sorted(groups) == list(range(len(groups))) and len(groups) > 10
            seen = [order[r["id"]] for g in sorted(groups) for r in sorted(groups[g], key=lambda r: order[r["id"]])]
            assert seen == sorted(seen)  # groups are consecutive runs
            assert all(sum(r["length"] for r in rs) <= 20_000 + max(packing.LENGTHS) for rs in groups.values())
            for rs in groups.values():
                least = collections.defaultdict(list)
                for r in rs:
                    least[int(r["bin"].split("-")[1])].append(order[r["id"]])
                firsts = [min(least[b]) for b in sorted(least)]
                assert firsts == sorted(firsts)
        found[name] = {(r["id"], r["bin"]) for r in got}
    assert found["even"] != found["first"]


def test_pipeline_packs_in_order(spark):
    docs = spark.createDataFrame([(i, "w " * 3000, "en", "s", 0) for i in range(400)], SCHEMA).coalesce(1)
    groups = [int(r["bin"].split("-")[0]) for r in sorted(corpus_pipeline.packed(spark, docs, "").collect(), key=lambda r: r["doc_id"])]
    assert groups == sorted(groups) and len(set(groups)) == 3


def test_boilerplate_on_a_twelfth_of_the_pages_goes(spark):
    line, other = "the same line of furniture", "a line that some pages share"
    rows = [(i, "\n".join([*([line] if i % 12 == 0 else []), *([other] if i % 25 == 1 else []), f"own line {i}"]), "en", "s", 0) for i in range(600)]
    got = [r["text"] for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert not any(line in t for t in got) and sum(other in t for t in got) == 24
