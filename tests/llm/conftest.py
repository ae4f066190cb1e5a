from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLLY = "shard string, fingerprint int, kept int, __h string, slot string, host string, id string, h int, n_lines string, n_dropped string, __row int, rule int, row string, text_ string, key int, place int, part int, before int, `a.b` string"


def words(rng: random.Random, n: int, alphabet: str = "abcdefgh") -> list[str]:
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty and long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    out = []
    for i in range(60):
        w = words(rng, rng.randint(5, 120))
        text = "".join(x + ("\n" if rng.random() < 0.1 else " ") for x in w)
        out.append((i, text, rng.choice(["en", "de"]), f"s{i % 4}", len(text)))
    base = " ".join(words(rng, 400))
    out += [(100 + i, base, "en", "s0", len(base)) for i in range(6)]
    near = base.split()
    for i in range(5):
        w = list(near)
        w[rng.randrange(len(w))] = "zzz"
        t = " ".join(w)
        out.append((120 + i, t, "en", "s1", len(t)))
    out += [(130, None, None, None, None), (131, "", "en", "s1", 0), (132, " \n\t ", "en", None, 4), (133, "12 34 !!", "de", "s2", 8), (134, "É", "fr", "s2", 1), (None, "lonely text here", "en", "s3", 16), (None, None, None, None, None)]
    out += [out[0], out[0], (0, "another text with the id of the first", "en", "s0", 37)]
    long = " ".join(words(rng, 30_000))
    out.append((140, long, "en", "s0", len(long)))
    out += [(150 + i, "furniture line here\n" + " ".join(words(rng, 20)), "en", "site", 0) for i in range(12)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def folly(spark, rows):
    """The same documents with extra columns whose names the operators use themselves."""
    extra = tuple("x" if "string" in c else 7 for c in FOLLY.split(", "))  # one name holds a dot
    return spark.createDataFrame([r + extra for r in rows], f"{SCHEMA}, {FOLLY}").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
