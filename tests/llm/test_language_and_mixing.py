import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from fixture import documents, empty, rows
from pyspark.sql import functions as F

from vigil.llm.language import _floors, accepted_languages, language_digest
from vigil.llm.mixing import mix_digest, mixed, schedule, scheduled, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out) and sum(r.accepted for r in out) > 0.99 * len(out)


def test_language_edges(spark):
    docs = documents(spark)
    out = {(r.doc_id, i): r for i, r in enumerate(language_digest(docs).collect())}
    for (doc_id, _), r in out.items():
        if doc_id in (4, 5, 6, 13):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
    german = [r for (doc_id, _), r in out.items() if doc_id and 40 <= doc_id < 50]
    assert sum(r.lang_pred == "de" for r in german) >= 8
    assert len(out) == docs.count() and language_digest(empty(spark)).count() == 0


def test_rejected_documents_go_and_columns_stay(spark):
    foreign = "中文文本不在样本中 " * 30
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = known.limit(1).withColumns({"doc_id": F.lit(10**9).cast("long"), "text": F.lit(foreign), "lang": F.lit(None).cast("string")})
    out = accepted_languages(known.unionByName(odd))
    assert out.columns == known.columns
    assert out.filter(F.col("doc_id") == 10**9).count() == 0 and out.count() > 0.99 * known.count()


def test_what_is_no_learned_language_is_rejected(spark):
    rng = random.Random(7)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) >= 200")

    def shuffled(text):
        letters = [c for c in text if c.isalpha()]
        rng.shuffle(letters)
        left = iter(letters)
        return "".join(next(left) if c.isalpha() else c for c in text)

    some = docs.filter("lang = 'en'").limit(60).collect()
    mixed_up = [(10**9 + i, shuffled(r.text), None) for i, r in enumerate(some)]
    odd = [(2 * 10**9, "qxzjkvw " * 60, "en")]  # mislabelled, and if it is drawn it must not lower the floor
    finnish = "ja on ei että hän oli mutta kun niin minä sinä kaikki sitten vielä nyt täällä talossa metsässä järven rannalla kylmä yö pitkä matka takaisin kotiin".split()
    foreign = [(3 * 10**9 + i, " ".join(rng.choice(finnish) for _ in range(rng.randrange(40, 400))), None) for i in range(60)]
    known = docs.select("doc_id", "text", "lang")
    kept = accepted_languages(known.unionByName(spark.createDataFrame(mixed_up + odd + foreign, "doc_id long, text string, lang string")))
    kept = {r.doc_id for r in kept.select("doc_id").collect()}
    own = {r.doc_id for r in known.collect()}
    assert len(own & kept) > 0.98 * len(own)
    assert sum(i in kept for i, _, _ in mixed_up) < 3 and sum(i in kept for i, _, _ in foreign) < 3


def test_one_odd_text_does_not_lower_the_floors():
    cosine, lengths = np.full(300, 0.9), np.full(300, 12)
    cosine[17], lengths[17] = 0.05, 15
    assert _floors(cosine, lengths, 0.01, 0.2)[:13].max() > 0.7
    assert _floors(cosine, lengths, 0.01, 0.2)[12] == pytest.approx(0.72)


def test_language_without_any_label(spark):
    out = language_digest(documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in out} == {"und"}


def filled(sizes, weights, share):
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        weight = sum(weights[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and rest * weights[s] / weight > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else rest * weights[s] / weight for s in sizes}
        full |= over


def sizes_of(data):
    sizes = defaultdict(int)
    for r in data:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    return sizes


def test_mixture_meets_its_targets(spark):
    data = rows()
    sizes = sizes_of(data)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5)
    out = mix_digest(documents(spark), block_words=16).collect()
    by_row = defaultdict(list)
    for r in data:
        by_row[r[0], len(WORD.findall(r[1] or ""))].append(r[3])
    assert len(out) == len(data)
    taken = defaultdict(int)
    for r in out:
        assert r.taken <= 2 * r["size"]
        source = next(s for s in by_row[r.doc_id, r["size"]] if sizes[s] == r.source_size)
        assert r.target == pytest.approx(targets[source])
        taken[source] += r.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 0.5
    again = mix_digest(documents(spark), block_words=16).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)
    assert mix_digest(empty(spark)).count() == 0 and mixed(empty(spark)).count() == 0


def test_mixed_texts_are_what_the_digest_says(spark):
    docs = documents(spark)
    words = sum(r.taken for r in mix_digest(docs, block_words=16).collect())
    out = mixed(docs, block_words=16)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == words


def test_schedule_is_even_and_whole(spark):
    sizes = spark.createDataFrame([("a", 9000), ("b", 3000), (None, 600)], "source string, size long")
    sources = source_targets(sizes, [3, 1, 2], 1.5, 2)
    slots = schedule(sources, 10).collect()
    per = defaultdict(list)
    for r in slots:
        per[r.source_no].append(r)
    target = {r.source_no: r.target for r in sources.collect()}
    for s, own in per.items():
        assert sorted(r.k for r in own) == list(range(len(own)))
        assert abs(sum(r.to_word - r.from_word for r in own) - target[s]) <= 0.5
    # every stretch of the schedule holds each source in its share
    order = sorted(slots, key=lambda r: r.slot)
    for at in range(0, len(order) - 300, 300):
        part = order[at:at + 300]
        for s, own in per.items():
            assert abs(sum(r.source_no == s for r in part) - 300 * len(own) / len(order)) < 12


def test_mixture_follows_the_schedule(spark, tmp_path):
    rng = random.Random(8)
    data = [(i, " ".join(["w"] * rng.randrange(5, 60)), "abc"[min(i % 5, 2)]) for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    args = ([3, 1, 2], 1.5, 2, 16, "doc_id", "source", "text")
    order = sorted(scheduled(docs, *args).collect(), key=lambda r: r["_slot"])
    first = {}
    for r in order:
        first.setdefault(r.doc_id, r["_slot"])
    digest = {r.doc_id: r.first_slot for r in mix_digest(docs, block_words=16).collect()}
    assert first == {i: slot for i, slot in digest.items() if slot is not None}
    count = lambda some: {s: sum(len(r.text.split(" ")) for r in some if r.source == s) for s in "abc"}
    whole = count(order)
    for n in range(300, len(order), 300):
        part = count(order[:n])
        for s in "abc":
            assert part[s] / sum(part.values()) == pytest.approx(whole[s] / sum(whole.values()), abs=0.02)
    # each file that is written is in the order of the schedule
    path = str(tmp_path / "mixture")
    scheduled(docs, *args).write.parquet(path)
    for file in (tmp_path / "mixture").glob("*.parquet"):
        slots = pq.read_table(file).column("_slot").to_pylist()
        assert slots == sorted(slots)
