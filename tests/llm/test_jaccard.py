"""Near-duplicates by Jaccard similarity against all pairs."""

from __future__ import annotations

import collections
import itertools
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from test_operators import words_of

from ruletide.llm import graph, jaccard, simhash


def brute_set(text):
    w = words_of((text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(rng):
    """(id, text): originals with copies edited at some words, a chain of edits, short and empty texts."""
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    out = []
    for _ in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(60, 300))]
        out.append(w)
        for edits in (1, 2, 3, 5, 8):
            v = list(w)
            for at in rng.sample(range(len(v)), min(edits, len(v) // 30)):
                v[at] = "edited" + str(rng.random())
            out.append(v)
    for _ in range(12):  # each a little further from the first
        v = list(out[-1])
        v[rng.randrange(len(v))] = "changed" + str(rng.random())
        out.append(v)
    return list(enumerate([*(" ".join(w) for w in out), None, "", " \n", "A b c", "a B c", "a b d"]))


def test_every_pair_from_0_8_is_linked(spark):
    rows = planted(random.Random(3))
    sets = [brute_set(t) for _, t in rows]
    at = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s or {None}:
            at[g].append(i)
    pairs = {(a, b) for v in at.values() for a in v for b in v if a < b}
    near = {p for p in pairs if similarity(sets[p[0]], sets[p[1]]) >= jaccard.SIMILARITY}
    assert sum(similarity(sets[a], sets[b]) < 0.85 for a, b in near) > 50 and len(near) < len(pairs)
    label = list(range(len(rows)))
    for a, b in sorted(near):
        lo, hi = sorted((label[a], label[b]))
        label = [lo if x == hi else x for x in label]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["id"]: r["component"] for r in jaccard.near_duplicates(docs).collect()} == dict(enumerate(label))
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def brute_groups(texts):
    """The least number reachable over links of 0.8 or more, for each text."""
    sets, label = [brute_set(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if label[a] != label[b] and similarity(sets[a], sets[b]) >= 0.8:
            lo, hi = sorted((label[a], label[b]))
            label = [lo if x == hi else x for x in label]
    return label


def crowd(rng, n=260, words=120):
    """Many copies of one text, each edited at so many places that some are alike to few others or none."""
    vocab = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocab) for _ in range(words)]
    out = []
    for _ in range(n):
        v = list(base)
        for at in rng.sample(range(words), rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            v[at] = rng.choice(vocab)
        out.append(" ".join(v))
    return out


@pytest.mark.parametrize("few,slice_", [(4, 512), (2, 40), (0, 7)])
def test_a_crowd_of_near_copies(spark, monkeypatch, few, slice_):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "SLICE", slice_)
    texts = crowd(random.Random(4))
    want = brute_groups(texts)
    assert 3 < len(set(want)) < len(texts) // 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["id"]: r["component"] for r in jaccard.near_duplicates(docs).collect()} == dict(enumerate(want))


def test_sets_numbers_and_bit_rows():
    texts = [*crowd(random.Random(9), 30), None, "", "a b", "A B", "a b c d e f a b c d e f"]
    h, edge = jaccard.shingle_sets(pa.array(texts))
    for k, t in enumerate(texts):
        grams = {" ".join(g) for g in brute_set(t)} if words_of(t) else set()
        assert h[edge[k] : edge[k + 1]].tolist() == sorted(xxhash.xxh64_intdigest(g.encode(), 42) for g in grams)
    assert [int(x) for x in jaccard.node_numbers(h, edge)] == [xxhash.xxh64_intdigest(h[a:b].tobytes(), 42) for a, b in zip(edge, edge[1:])]
    sets = [h[a:b] for a, b in zip(edge, edge[1:]) if b > a]
    rows = jaccard.bit_rows(sets, 64)
    for i, j in itertools.combinations(range(len(sets)), 2):
        assert int.from_bytes((rows[i] & rows[j]).tobytes(), "little").bit_count() == len(set(sets[i].tolist()) & set(sets[j].tolist()))


def test_rows_of_one_id_and_of_none(spark, tmp_path):
    """Rows of one id with different texts stay, copies without an id do not, and a row is kept or dropped as a whole."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, note string"
    one, two = "the first text of the id is this one here", "quite another text stands in the second row"
    rows = [(7, one, "en", "s", 1, "a"), (7, two, "en", "s", 2, "b"), (None, "no id at all but the same words", "en", "s", 3, "c"), (None, "no id at all but the same words", "de", "t", 4, "d"), (None, one, "en", "s", 5, "e"), (9, two, None, None, None, None)]
    plain = spark.createDataFrame(rows, schema).repartition(3)
    plain.write.parquet(f"{tmp_path}/docs")
    for docs in (plain, spark.read.parquet(f"{tmp_path}/docs")):
        kept = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
        assert sorted(r[5] for r in kept) in (["a", "b", "c"], ["a", "b", "d"]) and set(kept) <= set(rows)


def test_candidates_are_those_of_simhash(spark, monkeypatch):
    """Sets 0.8 alike or more have close fingerprints in a common table; without the links of SimHash no near copy is found."""
    rng = random.Random(6)
    w = [f"w{rng.random()}" for _ in range(90)]
    texts = [" ".join(w), " ".join([*w[:40], "other", *w[41:]]), "a b c d e f g h", "a b c d e f g h i", " ".join(f"v{k}" for k in range(50))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2, 4]
    found = []
    monkeypatch.setattr(simhash, "near_links", lambda nodes: found.append(nodes) or spark.createDataFrame([], "a long, b long"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 1, 2, 3, 4] and len(found) == 1


def test_wide_fingerprints_and_tables():
    texts = [*crowd(random.Random(2), 12), "a b c d e f", "one", None]
    h, edge = jaccard.shingle_sets(pa.array(texts))
    got = simhash.wide_fingerprints(h, edge, block=100)
    for k, (a, b) in enumerate(zip(edge, edge[1:])):
        values = h[a:b].tolist()
        assert int(got[k, 0]) == sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in values) > len(values))
    assert len({tuple(r) for r in got.tolist()}) == len({h[a:b].tobytes() for a, b in zip(edge, edge[1:])})
    for width in (9, 12):
        drawn = simhash.drawn_bits(width, simhash.tables(width, simhash.DIFFER))
        assert all(len(set(t)) == width for t in drawn.tolist()) and drawn.max() < 512


def brute_close(fp):
    """The least place reachable over pairs that meet in a table and are close, then over those in one such group that are close in all words."""
    n, width = len(fp), simhash.bucket_bits(len(fp))
    bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
    met = np.zeros((n, n), bool)
    for drawn in simhash.drawn_bits(width, simhash.tables(width, simhash.DIFFER_FEW))[: simhash.tables(width, simhash.DIFFER)]:
        key = bits[:, drawn].astype(np.int64) @ (1 << np.arange(width))
        met |= key[:, None] == key
    far = np.stack([np.bitwise_count(fp[:, None, k] ^ fp[:, k]) for k in range(simhash.WIDE)]).astype(int)
    word = far[0] <= simhash.NEAR_WORD
    group = simhash._roots(n, *np.nonzero(met & word & (far[: simhash.CARRIED].sum(axis=0) <= simhash.NEAR)))
    return simhash._roots(n, *np.nonzero((group[:, None] == group) & word & (far.sum(axis=0) <= simhash.NEAR_WIDE)))


def test_links_of_a_crowd_do_not_grow_with_the_tables(spark, monkeypatch):
    """A group of near copies meets in most tables; a member gives a link or two for each of the first tables, none for each other."""
    texts = [*crowd(random.Random(8), 700), *crowd(random.Random(9), 300, 60)]
    h, edge = jaccard.shingle_sets(pa.array(sorted(set(texts))))
    fp, n = simhash.wide_fingerprints(h, edge), len(edge) - 1
    assert min(np.diff(edge)) > simhash.FEW
    handed, real = [], graph.components
    monkeypatch.setattr(simhash, "components", lambda links: handed.append(links.count()) or real(links))
    nodes = spark.createDataFrame([(i, int(edge[i + 1] - edge[i]), fp[i].view(np.int64).tolist()) for i in range(n)], "node long, size int, fp array<long>").repartition(3)
    found = simhash.near_links(nodes).collect()
    label = simhash._roots(n, np.array([r["a"] for r in found]), np.array([r["b"] for r in found]))
    assert label.tolist() == brute_close(fp).tolist() and n // 2 < len(set(np.flatnonzero(label != np.arange(n))))
    assert sum(handed) <= (simhash.FIRST + 2) * n


def test_a_star_step_is_computed_once(spark, monkeypatch):
    star = graph._star

    def step(edges, largest):
        assert "Join" not in edges._jdf.queryExecution().executedPlan().toString()  # a written table, not a step to compute again
        return star(edges, largest)

    monkeypatch.setattr(graph, "_star", step)
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 31), (31, 50)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(links).collect()} == {**{i: 0 for i in range(1, 21)}, 40: 31, 50: 31}
