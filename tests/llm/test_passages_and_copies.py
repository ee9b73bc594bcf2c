import hashlib
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from fixture import documents, empty, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm.arrow_text import Words
from vigil.llm.ngram_join import bands_and_rows, block_links, join_digest, one_of_each
from vigil.llm.passages import minimisers
from vigil.llm.phrase_automata import without_repeats
from vigil.llm.suffix_dedup import WINDOW, positions, repeated_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@given(st.lists(st.text(alphabet=" \t\n\x0b\x1cabé\U0001f600", max_size=12), max_size=6))
@settings(max_examples=60, deadline=None)
def test_word_hashes_follow_the_words(parts):
    words = Words.of(pa.array(parts, pa.string()), places=True)
    expected = [WORD.findall(p) for p in parts]
    assert [int(b - a) for a, b in zip(words.first, words.first[1:])] == [len(x) for x in expected]
    by_word = defaultdict(set)
    for h, w in zip(words.hashes.tolist(), [w for x in expected for w in x], strict=True):
        by_word[w].add(h)
    assert all(len(x) == 1 for x in by_word.values()) and len({h for x in by_word.values() for h in x}) == len(by_word)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500)) + " " + "z" * 400 + " end"
    whole = Words.of(pa.array([text, "w1 end"]))
    monkeypatch.setattr("vigil.llm.arrow_text.CHUNK", 64)
    parts = Words.of(pa.array([text, "w1 end"]))
    assert (whole.hashes == parts.hashes).all() and (whole.first == parts.first).all()


def test_minimisers_cover_every_window():
    grams = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    for window in (1, 4, 21):
        found = set(minimisers(grams, window).tolist())
        for at in range(len(grams) - window + 1):
            assert found & set(range(at, at + window))


def rows():
    return [(i, WORD.findall(t or "")) for i, t in texts()]


def test_removal_against_brute_force(spark):
    least = {}
    for i, w in rows():
        for k in range(len(w) - 12):
            if i is not None:
                x = tuple(w[k:k + 13])
                least[x] = min(least.get(x, i), i)
    expected = []
    for i, w in rows():
        gone = {x for k in range(len(w) - 12) if i is not None and least[tuple(w[k:k + 13])] < i for x in range(k, k + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sum(x[2] for x in expected) > 150
    out = without_repeats(documents(spark)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(expected, key=repr)


def test_removal_with_tiny_shards(spark, monkeypatch):
    usual = sorted(map(tuple, without_repeats(documents(spark)).collect()), key=repr)
    monkeypatch.setattr("vigil.llm.phrase_automata.SHARD_WINDOWS", 20)
    monkeypatch.setattr("vigil.llm.phrase_automata.TASK_CHARS", 200)
    assert sorted(map(tuple, without_repeats(documents(spark)).collect()), key=repr) == usual


def test_passages_against_brute_force(spark):
    where = defaultdict(set)
    for i, w in rows():
        for k in range(len(w) - 49):
            where[tuple(w[k:k + 50])].add(i)
    out = {(r.doc_id, r.n_words): r for r in repeated_passages(documents(spark)).collect()}
    hit = 0
    for i, w in rows():
        shared = {x for k in range(len(w) - 49) if len(where[tuple(w[k:k + 50])] - {None}) > 1 for x in range(k, k + 50)}
        if i is not None:
            r = out[i, len(w)]
            assert {x for s in r.spans for x in range(s["first"], s["last"])} == shared, i
            assert r.n_repeated == len(shared) and (not shared or r.partners)
            hit += bool(shared)
    assert hit == 5
    assert 61 in out[60, 110].partners and 60 in out[61, 95].partners


def test_empty_tables(spark):
    for f in (without_repeats, repeated_passages, join_digest, one_of_each):
        assert f(empty(spark)).count() == 0


def expected_passages(texts, least=50):
    """Of each id: the words in passages that another different document holds, and the ids that hold them."""
    where = defaultdict(set)
    words = {i: t.split() for i, t in texts}
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            where[tuple(w[k:k + least])].add(i)
    out = {}
    for i, w in words.items():
        shared = [k for k in range(len(w) - least + 1) if len(where[tuple(w[k:k + least])]) > 1]
        partners = set().union(*[where[tuple(w[k:k + least])] for k in shared]) - {i}
        out[i] = {x for k in shared for x in range(k, k + least)}, partners
    return out


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_partners_are_found_in_a_crowd_of_partial_holders(spark, parts):
    rng = np.random.default_rng(4)
    own = lambda n: [f"o{x}" for x in rng.integers(0, 1 << 40, n)]
    passage = [f"p{k}" for k in range(50)]
    texts = [(1, own(30) + passage + own(30)), (2, own(9) + passage + own(70))]
    for i in range(3, 963):
        a = int(rng.integers(0, 20))
        texts.append((i, own(20) + passage[a:a + int(rng.integers(30, 50))] + own(40)))
    texts = [(i, " ".join(w)) for i, w in texts]
    expected = expected_passages(texts)
    assert len(expected[1][0]) == 50 and expected[1][1] == {2}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = repeated_passages(spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for r in out:
        assert {x for s in r.spans for x in range(s["first"], s["last"])} == expected[r.doc_id][0]
    assert {r.doc_id: r.partners for r in out if r.n_repeated} == {1: [2], 2: [1]}


def test_passages_of_overlapping_cuts_and_repetitions(spark):
    rng = np.random.default_rng(8)
    source = [f"s{x}" for x in rng.integers(0, 400, 400)]
    texts = []
    for i in range(120):
        a, n = int(rng.integers(0, 350)), int(rng.integers(20, 130))
        cut = source[a:a + n]
        if i % 4 == 0:
            cut = cut + [f"u{i}"] + source[a // 2:a // 2 + int(rng.integers(45, 60))]
        if i % 9 == 0:
            cut = ["rep"] * int(rng.integers(40, 90)) + [f"v{i}"] + cut
        if i % 13 == 0:
            cut = cut + [f"w{i}"] + ["a", "b", "c"] * int(rng.integers(15, 30))
        texts.append((i, " ".join([f"h{i}", *cut, f"t{i}"])))
    expected = expected_passages(texts)
    out = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert sum(bool(e[0]) for e in expected.values()) > 60
    for i, (shared, partners) in expected.items():
        assert {x for s in out[i].spans for x in range(s["first"], s["last"])} == shared, i
        assert out[i].n_repeated == len(shared) and set(out[i].partners) <= partners and bool(out[i].partners) == bool(partners)


def test_positions_lie_in_their_windows():
    grams = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    at = positions(grams, 270)
    assert all(s <= p < s + WINDOW and grams[p] == grams[s:s + WINDOW].min() for s, p in enumerate(at))
    with pytest.raises(ValueError):
        repeated_passages(None, least=29)


def grams(words):
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def expected_classes():
    items = [(n, i, grams(w)) for n, (i, w) in enumerate(rows())]
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, _, a in items:
        for m, _, b in items[:n]:
            if a and b and len(a & b) >= 0.8 * len(a | b):
                parent[root(n)] = root(m)
    return items, [root(n) for n in range(len(items))]


def test_join_against_brute_force(spark):
    items, roots = expected_classes()
    least = defaultdict(list)
    for (n, i, g), r in zip(items, roots, strict=True):
        least[r].append(i)
    expected = sorted(((i, min((x for x in least[r] if x is not None), default=None)) for (_, i, _), r in zip(items, roots, strict=True)), key=repr)
    out = join_digest(documents(spark)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in out), key=repr) == expected
    by_id = {r.doc_id: r for r in out}
    assert by_id[3].class_id == 1 and by_id[3].n_links == 1 and by_id[2].copy_of == 1 and by_id[7].n_links == 0


def test_crowds_give_the_same_classes(spark, monkeypatch):
    usual = sorted(map(tuple, join_digest(documents(spark)).collect()), key=repr)
    monkeypatch.setattr("vigil.llm.ngram_join.FEW", 1)
    monkeypatch.setattr("vigil.llm.ngram_join.BLOCK", 1)
    assert sorted(map(tuple, join_digest(documents(spark)).collect()), key=repr) == usual


def test_one_of_each_keeps_a_row_of_every_class(spark):
    docs = documents(spark)
    out = one_of_each(docs)
    assert out.columns == docs.columns
    _, roots = expected_classes()
    assert out.count() == len(set(roots))
    assert {1, 4, 5, 6, 7} <= {r.doc_id for r in out.collect()}


def test_block_links_count_all_pairs(monkeypatch):
    monkeypatch.setattr("vigil.llm.ngram_join.COLUMNS", 3)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 14, 10)) for _ in range(30)]
    for blocks in ([0] * 30, [0] * 12 + [1] * 18):
        frame = pd.DataFrame({"id": range(30), "block": blocks, "grams": sets})
        found = block_links(frame, 0.6).set_index("id")
        for i in range(30):
            mates = [
                j for j in range(30) if j != i and (blocks[0] == blocks[-1] or blocks[i] != blocks[j])
                and len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j]))
            ]
            assert (found["links"].get(i, 0)) == len(mates)


@pytest.mark.parametrize("threshold, recall", [(0.8, 0.999), (0.5, 0.95), (0.9, 0.99)])
def test_bands_reach_the_recall(threshold, recall):
    bands, per_band = bands_and_rows(threshold, recall)
    assert 1 - (1 - threshold**per_band) ** bands >= recall and bands * per_band <= 140
