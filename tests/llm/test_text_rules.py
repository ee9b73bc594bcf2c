import hashlib
import random
import re
from pathlib import Path

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from conftest import same_rows
from fixture import documents, empty, texts
from pyspark.sql import functions as F

from vigil.llm.bpe import Codec, decoded, encoded, read_ranks, token_digest
from vigil.llm.license_scan import TEMPLATES, license_scan, template_tokens, window
from vigil.llm.quality_rules import RULES, base_columns, cascade, quality, rule_order

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_bpe_equals_the_library(spark, encoding):
    expected = []
    for i, t in texts():
        ids = encoding.encode_ordinary(t or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((i, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest()))
    out = token_digest(documents(spark), PATH, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(expected, key=repr)
    assert token_digest(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_round_trip_keeps_the_columns(spark):
    docs = documents(spark)
    back = decoded(encoded(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert back.columns == [*docs.columns, "token_ids", "decoded"]
    for r in back.collect():
        assert bytes(r.decoded).decode() == (r.text or "")


def test_bpe_leaves_nothing_behind_a_task():
    codec = Codec(PATH, public_tokenizers.PATTERN)
    text = "Some words, some more words."
    with codec as c:
        first = c.encode_all([text])[0].tolist()
        assert c.known
        for start in range(0, 240_000, 60_000):  # a few matches of each are words seen before
            c.encode_all([" ".join(f"q{i:x}z" for i in range(start, start + 20_000))])
            assert len(c.known) < 200_000
    assert not c.known and not len(c.ids) and not len(c.sizes)
    with codec as c:
        assert c.encode_all([text])[0].tolist() == first


def test_bpe_task_gives_its_memory_back(spark, monkeypatch):
    """What the task of the pipeline's last stage leaves in a Python worker, in MB above what the codec itself takes."""
    docs = spark.createDataFrame([(1, "x", "en", "a")], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    task = encoded(docs, PATH, public_tokenizers.PATTERN, digest_col="decoded_sha256")
    rng = random.Random(3)

    def batch(i):
        found = [" ".join(f"{rng.randrange(1 << 30):x}" for _ in range(300)) for _ in range(2500)]
        return pa.RecordBatch.from_pydict({"doc_id": [i] * len(found), "text": found, "lang": ["en"] * len(found), "source": ["a"] * len(found)})

    def used():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    assert sum(b.num_rows for b in task(batch(i) for i in range(1))) == 2500
    least = used()
    most = max(used() for _ in task(batch(i) for i in range(2)))
    left = used()
    assert most > least + 20 and left < least + 0.5 * (most - least)


def test_bpe_forgets_without_harm(monkeypatch, encoding):
    monkeypatch.setattr("vigil.llm.bpe.CACHE", 3)
    codec = Codec(PATH, public_tokenizers.PATTERN)
    for _ in range(3):
        for text in ("some words and more words", "", "ünï \n\n  x　y", "'ll we've"):
            (ids,) = codec.encode_all([text])
            assert ids.tolist() == encoding.encode_ordinary(text)
            assert codec.decode(ids).decode() == text


def repeated(words):
    seen = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k:k + 3]), []).append(k)
    return len({x for at in seen.values() if len(at) > 1 for k in at for x in range(k, k + 3)})


def test_quality_base_columns(spark):
    expected = []
    for i, t in texts():
        words = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        n = repeated(words)
        expected.append((
            i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), n,
            len(words) < 50 or 100 * n > 50 * len(words),
        ))
    out = quality(documents(spark)).drop("kept").collect()
    assert sorted(map(tuple, out), key=repr) == sorted(expected, key=repr)
    assert quality(empty(spark)).count() == 0


def test_quality_verdict_does_not_depend_on_the_order(spark):
    rows = base_columns(documents(spark), "doc_id", "text")
    rules = {name: rule() for name, rule in RULES.items()}
    ticks = iter(range(100))
    order = rule_order(rows, rules, clock=lambda: float(next(ticks)))
    assert sorted(order) == sorted(rules)
    one = rows.select("id", cascade(rules, order).alias("k")).collect()
    other = rows.select("id", cascade(rules, order[::-1]).alias("k")).collect()
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, other), key=repr)


def test_costly_rules_run_last(spark):
    rows = base_columns(documents(spark), "doc_id", "text")
    times = iter([0.0, 10.0, 10.0, 11.0, 11.0, 12.0])
    rules = {"slow": F.lit(True), "quick": F.lit(True), "idle": F.lit(False)}
    assert rule_order(rows, rules, clock=lambda: next(times)) == ["quick", "slow", "idle"]


def test_licenses_against_brute_force(spark):
    split = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    expected = []
    for i, t in texts():
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = [w for w in split.split(text) if w]
        places = {x: [k for k in range(len(words)) if words[k:k + len(p)] == p] for x, p in phrases.items()}
        labels, score = {x for x in places if places[x]}, 0.0
        base, at = ",".join(sorted(labels)), sorted(k for p in places.values() for k in p)
        for label, template in TEMPLATES.items():
            tokens, width = set(template_tokens(template)), window(template)
            best = max((len(tokens & set(words[k:k + width])) for k in range(len(words))), default=0)
            if best >= 0.8 * len(tokens):
                labels.add(label)
                score = max(score, best / len(tokens))
        expected.append((
            i, len(words), len(at), at[0] if at else None, at[-1] if at else None, base, ",".join(sorted(labels)), 1.0 if at else score
        ))
    out = license_scan(documents(spark)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(expected, key=repr)
    assert license_scan(empty(spark)).count() == 0


def test_notices_are_found_wherever_lines_end(spark):
    from vigil.llm.queries import ORACLES

    duck = duckdb.connect()
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(n))
    cases, expected = [], {}

    def add(text, label):
        expected[len(cases)] = label
        cases.append((len(cases), text))

    add("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", "mpl-2.0")
    add("# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided", "bsd")
    add("Released under the terms of the MIT License", "mit")
    add(f"released {filler(20)} the {filler(20)} under {filler(20)} license", "")
    for label, notice in TEMPLATES.items():
        for before in (0, 1, 33, 34, 35, 67, 500):
            add(f"{filler(before)} " + notice.replace(" ", "\n * ") + f" {filler(40)}", label)
    df = spark.createDataFrame(cases, "doc_id long, text string")
    found = license_scan(df)
    out = {r.doc_id: set(filter(None, r.labels.split(","))) - {"gpl", "cc-by"} for r in found.collect()}
    assert out == {i: {label} - {""} for i, label in expected.items()}
    duck.register("documents", df.toPandas())
    same_rows(found, duck.sql(ORACLES["op7_license_scan"]))
    duck.unregister("documents")


@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_phrase_automata", "op5_exact_dedup", "op6_line_dedup", "op7_license_scan"])
def test_queries_against_sql(spark, duck, name):
    from vigil.llm.queries import ORACLES, QUERIES

    same_rows(QUERIES[name](spark, "/root/testdata/sf0.001"), duck.sql(ORACLES[name]))


def test_only_ascii_letters_are_lowered(spark):
    rows = [(1, "ALL RIGHTS RESERVED"), (2, "all r\u0130ghts reserved"), (3, "CC BY and \u212aELVIN \u00c9t\u00c9")]
    out = {r.doc_id: (r.base_labels, r.n_words) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: ("reserved", 3), 2: ("", 3), 3: ("cc-by", 5)}
