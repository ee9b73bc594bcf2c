import hashlib
import re
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from fixture import documents, empty
from pyspark.sql import functions as F

import corpus_pipeline
from vigil.llm.bpe import read_ranks
from vigil.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def run(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], ""), "test"))
    return out


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    _, spoken, lines, single, mixture, tokens = run(spark, docs)
    for df in (spoken, lines, single, mixture):
        assert df.columns == COLUMNS
    assert spoken.count() >= 0.99 * docs.count() and lines.count() == spoken.count()
    ids = [r.doc_id for r in single.collect()]
    assert len(ids) == len(set(ids)) < lines.count()
    assert {r.doc_id for r in mixture.collect()} <= set(ids)
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = sorted((r.doc_id, tuple(encoding.encode_ordinary(r.text)), digest(r.text)) for r in mixture.collect())
    assert sorted((r.doc_id, tuple(r.token_ids), r.decoded_sha256) for r in tokens.collect()) == expected


def test_stages_bear_odd_and_empty_tables(spark):
    for docs in (documents(spark), empty(spark)):
        for df in run(spark, docs)[1:-1]:
            assert df.columns == docs.columns


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_named_like_their_own(spark, name, stage):
    """Every name with an underscore that an operator's source has, as a column of the caller."""
    sources = Path(corpus_pipeline.__file__).parent / "vigil"
    text = "".join((sources / f).read_text() for f in ("llm/language.py", "llm/line_dedup.py", "llm/ngram_join.py", "llm/mixing.py", "ordered.py", "graph.py"))
    own = sorted(set(re.findall(r"[\"'](_[a-z0-9_]+)[\"']", text)))
    assert {"_lang", "_kept", "_hash", "_row"} <= set(own)
    docs = documents(spark)
    more = docs.select("*", *[F.concat(F.lit(f"{c}="), F.coalesce("text", F.lit("-"))).alias(c) for c in own], F.lit(1).alias("given_14"))
    out = stage(spark, more, "")
    assert out.columns == more.columns
    plain = stage(spark, docs, "").select("doc_id", "text")
    whole = {r.text for r in docs.collect()}
    rows = out.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    for r in rows:
        assert r.given_14 == 1 and all(r[c][len(c) + 1:] in whole | {"-"} and r[c].startswith(f"{c}=") for c in own)
