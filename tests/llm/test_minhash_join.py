import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from conftest import same_rows
from fixture import EXTRA, SCHEMA, documents, empty, prose, texts

from vigil.llm import minhash_join as join
from vigil.llm.queries import ORACLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_force(data):
    """id, n_shingles, component_id, kept of every row, from all pairs."""
    sets = sorted({shingles(t) for _, t in data} - {frozenset()}, key=sorted)
    label = {s: i for i, s in enumerate(sets)}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(a & b) >= 85 * len(a | b) and label[a] != label[b]:
            old, new = label[a], label[b]
            label = {s: new if x == old else x for s, x in label.items()}
    least = {}
    for i, t in data:
        if i is not None and shingles(t):
            least[label[shingles(t)]] = min(least.get(label[shingles(t)], i), i)
    out = []
    for i, t in data:
        s = shingles(t)
        component = least.get(label[s]) if s else i
        out.append((i, len(s), component, i is not None and i == component))
    return sorted(out, key=repr)


def crowd(seed=4, members=90):
    """Variants of one text, many of them a little too far from each other, and chains of small steps."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = prose(rng, 150, vocabulary).split()
    out = [(1000 + i, " ".join(base)) for i in range(3)]
    for i in range(members):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
        out.append((i, " ".join(words).upper() if i % 7 == 0 else " ".join(words)))
    step = prose(rng, 120, vocabulary).split()
    for i in range(12):
        step = [*step[3:], *prose(rng, 3, vocabulary).split()]
        out.append((2000 + i, " ".join(step)))
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, t, "en", "a", 0, *EXTRA) for i, t in data], SCHEMA)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_fixture_against_brute_force(spark):
    assert found(join.near_duplicates(documents(spark))) == brute_force(texts())


def test_crowd_against_brute_force(spark, monkeypatch):
    data = crowd()
    want = brute_force(data)
    assert 3 < len({x[2] for x in want}) < len(want) - 20
    assert found(join.near_duplicates(frame(spark, data))) == want
    monkeypatch.setattr(join, "FEW", 2)
    monkeypatch.setattr(join, "BLOCK", 8)
    assert found(join.near_duplicates(frame(spark, data))) == want


def test_against_sql(spark, duck):
    data = crowd(9, 30) + [(5000, ""), (5001, None), (5002, "one TWO"), (5003, "ONE two")]
    duck.register("own_documents", pd.DataFrame(data, columns=["doc_id", "text"]))
    sql = ORACLES["op12_minhash_dedup"].replace("from documents", "from own_documents")
    same_rows(join.near_duplicates(frame(spark, data)), duck.sql(sql))


def test_empty_table(spark):
    assert join.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("coordinates", [16, 64, 128])
def test_threshold_keeps_the_miss_rate(coordinates):
    matches = join.match_threshold(coordinates, 0.85, 1e-3)
    drawn = np.random.default_rng(1).binomial(coordinates, 0.85, 200_000)
    assert (drawn < matches).mean() <= 1.3e-3
    assert (drawn < matches + 1).mean() > 1e-3


def test_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, 120).astype(np.int64)) for _ in range(15)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = join.overlaps(sets).astype(int)
    assert all(got[i, j] == want[i][j] for i in range(15) for j in range(15) if i != j)
