"""What the two passage operators share: word sequences, minimisers, and the search for those that recur."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.arrow_text import Words, slices, utf8
from vigil.llm.exact_dedup import PAGE_BITS, bit_is_set
from vigil.shared import written


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the least of some ``window`` neighbours, the first of equals; all of fewer count as one window."""
    if not len(grams):
        return np.empty(0, np.int64)
    window = min(window, len(grams))
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.concatenate([view[at:at + 65536].argmin(axis=1) + np.arange(at, min(at + 65536, len(view))) for at in range(0, len(view), 65536)]))


def sequences(docs: DataFrame, id_col: str, text_col: str, gram: int, window: int, places: bool) -> DataFrame:
    """(id, text_hash, seq, n_words, sha, anchors[, at]) of every row.

    seq hashes the word sequence (sha: of the words joined by one space, in full); anchors are the gram hashes at the
    minimiser positions of texts with at least gram + window - 1 words: with ``places`` all of them and their word
    numbers, else each once.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = utf8(batch.column("text"))
                words = Words(data, offsets)
                grams = words.windows(gram)
                n, sha, seq, anchors, at = [], [], [], [], []
                for i in range(batch.num_rows):
                    a, b = words.first[i:i + 2]
                    digest = hashlib.sha256(b" ".join(split_words(data[offsets[i]:offsets[i + 1]].tobytes()))).digest()
                    n.append(b - a)
                    sha.append(digest.hex())
                    seq.append(int.from_bytes(digest[:8], "big", signed=True))
                    own = grams[a:b - gram + 1] if b - a >= gram + window - 1 else grams[:0]
                    found = minimisers(own, window)
                    at.append(found if places else found[:0])
                    anchors.append((own[found] if places else np.unique(own[found])).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), batch.column("text_hash"), pa.array(seq, pa.int64()), pa.array(n, pa.int64()), pa.array(sha),
                        pa.array(anchors, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int64())),
                    ],
                    names=["id", "text_hash", "seq", "n_words", "sha", "anchors", "at"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    schema = "id long, text_hash long, seq long, n_words long, sha string, anchors array<long>, at array<long>"
    return written(rows.mapInArrow(run, schema), "sequences")


def split_words(text: str | bytes | None) -> list[bytes]:
    """The words in UTF-8; bytes are split at exactly the white space of the output contracts."""
    return (text.encode() if isinstance(text, str) else text or b"").split()


def recurring(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Keys that stand with two different values of ``by``, and the least of these."""
    spread = rows.groupBy(key).agg(F.min(by).alias("least"), F.max(by).alias("most"))
    return spread.filter("least < most").select(key, "least")


def texts_of(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str, max_bits: int = 1 << 27) -> DataFrame:
    """(id, text and the columns of ``needed``) for the pairs (id, text_hash) in ``needed``; repeated rows repeat.

    Rows of other ids are dropped before the shuffle by a bitmap of the needed ids, which never has more than
    ``max_bits`` bits; what it lets through by chance, the join drops.
    """
    pages = min(max_bits // PAGE_BITS, needed.count() * 16 // PAGE_BITS + 1)
    bits = F.lit(pages * PAGE_BITS)
    bitmap = needed.select(F.pmod(F.xxhash64("id"), bits).alias("at")).groupBy((F.col("at") / PAGE_BITS).cast("long").alias("page"))
    bitmap = bitmap.agg(F.bitmap_construct_agg(F.col("at") % PAGE_BITS).alias("bitmap"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("id"), bits))
    likely = rows.join(F.broadcast(bitmap), (F.col("at") / PAGE_BITS).cast("long") == F.col("page")).filter(
        bit_is_set(F.col("bitmap"), F.col("at") % PAGE_BITS)
    )
    return likely.select("id", "text_hash", "text").join(needed.hint("shuffle_hash"), ["id", "text_hash"])


def first_rows(usable: DataFrame) -> DataFrame:
    """(seq, id, text_hash): of the rows with the same words the one with the smallest id."""
    least = usable.groupBy("seq").agg(F.min(F.struct("id", "text_hash")).alias("_least"))
    return least.select("seq", "_least.*")
