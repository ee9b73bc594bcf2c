"""Passages that repeat across documents, by sparse suffix arrays.

Only the suffixes at minimiser positions are kept: every passage of ``least`` words holds, among its first ``WINDOW``
grams, one such position at the same place wherever it stands, so at least ``least - WINDOW + 1`` of its words follow that
position. Suffixes whose words up to there stand in one document only are dropped first. The others are sorted by those words
and then by the words around the position: equal ones become neighbours, and a run is reduced to the least and the most
of its ids while it is sorted, so a run has no length. The matches are then extended: of each different surrounding every
way to share the ``least`` words between left and right of the position is compared once more with its neighbours, which
misses no passage, however many other texts stand between two partners in the order of the suffixes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.arrow_text import Words, slices, span_hashes, utf8
from vigil.llm.passages import first_rows, recurring, split_words, texts_of
from vigil.shared import written

GRAM = 10
WINDOW = 21
_STEP = 65536  # windows whose minimiser is sought at a time


def positions(grams: np.ndarray, starts: int) -> np.ndarray:
    """The place of the least of the ``WINDOW`` grams from each of the first ``starts`` words on, the first of equals."""
    if starts <= 0:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams[:starts + WINDOW - 1], WINDOW)
    return np.concatenate([view[a:a + _STEP].argmin(axis=1) + np.arange(a, min(a + _STEP, starts)) for a in range(0, starts, _STEP)])


def sequences(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, text_hash, seq, n_words, anchors): anchors are the hashes of the words that follow the text's positions, each once."""
    reach = least - WINDOW + 1

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = utf8(batch.column("text"))
                words = Words(data, offsets)
                grams, after = words.windows(GRAM), words.windows(reach)
                n, seq, anchors = [], [], []
                for i in range(batch.num_rows):
                    a, b = words.first[i:i + 2]
                    digest = hashlib.sha256(b" ".join(split_words(data[offsets[i]:offsets[i + 1]].tobytes()))).digest()
                    n.append(b - a)
                    seq.append(int.from_bytes(digest[:8], "big", signed=True))
                    at = np.unique(positions(grams[a:b - GRAM + 1], b - a - least + 1))
                    anchors.append(np.unique(after[a + at]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("text_hash"), pa.array(seq, pa.int64()), pa.array(n, pa.int64()), pa.array(anchors, pa.list_(pa.int64()))],
                    names=["id", "text_hash", "seq", "n_words", "anchors"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, "id long, text_hash long, seq long, n_words long, anchors array<long>"), "sequences")


def suffixes(texts: DataFrame, least: int) -> DataFrame:
    """(id, start, right, around, windows): one row per recurring position of a text.

    right hashes the words that follow the position, windows the ``least`` words from word ``start`` on and from each
    later one whose passage has this position; around hashes all of these, so equal rows have equal surroundings.
    """
    reach = least - WINDOW + 1

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words.of(batch.column("text"))
                grams, after, passages = words.windows(GRAM), words.windows(reach), words.windows(least)
                wanted = batch.column("wanted")
                ids, starts, rights, arounds, lengths, values = [], [], [], [], [], []
                for i, own_id in enumerate(batch.column("id").to_pylist()):
                    a, b = words.first[i:i + 2]
                    count = max(b - a - least + 1, 0)
                    at = positions(grams[a:b - GRAM + 1], count)
                    right = after[a + at].view(np.int64)
                    use = np.flatnonzero(np.isin(right, wanted[i].values.to_numpy()))
                    if not len(use):
                        continue
                    own = passages[a:a + count][use]
                    first = np.concatenate([[0], np.flatnonzero(np.diff(at[use])) + 1])
                    ends = np.append(first[1:], len(use))
                    ids.append(np.full(len(first), own_id, np.int64))
                    starts.append(use[first])
                    rights.append(right[use[first]])
                    arounds.append(span_hashes(own, first, ends).view(np.int64))
                    lengths.append(ends - first)
                    values.append(own.view(np.int64))
                joined = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (ids, starts, rights, arounds, lengths, values)]
                offsets = np.concatenate([[0], np.cumsum(joined[4])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(x) for x in joined[:4]], pa.ListArray.from_arrays(pa.array(offsets), pa.array(joined[5]))],
                    names=["id", "start", "right", "around", "windows"],
                )

    return texts.select("id", "text", "wanted").mapInArrow(run, "id long, start long, right long, around long, windows array<long>")


def matches(found: DataFrame, least: int) -> DataFrame:
    """(id, first, last, others): of each position the words [first, last) that stand in another document, and ids that hold them.

    Any two passages of one position overlap, so what they cover is one stretch. Of a passage in several documents the
    one with the smallest id has the largest as other, all else have the smallest.
    """
    runs = found.groupBy("right", "around").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.first("windows").alias("windows"))
    splits = written(runs, "runs").select("right", "around", "low", "high", F.posexplode("windows").alias("split", "window"))
    shared = splits.groupBy("right", "window").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high")
    extended = splits.drop("low", "high").join(shared, ["right", "window"]).groupBy("right", "around").agg(
        F.min("split").alias("from"), F.max("split").alias("upto"), F.collect_set(F.struct("low", "high")).alias("holders")
    )
    other = lambda h: F.when(h["low"] == F.col("id"), h["high"]).otherwise(h["low"])
    return found.select("id", "start", "right", "around").join(extended, ["right", "around"]).select(
        "id", (F.col("start") + F.col("from")).alias("first"), (F.col("start") + F.col("upto") + least).alias("last"),
        F.array_distinct(F.transform("holders", other)).alias("others"),
    )


def passages(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """The matches of documents of different words; of equal ones the smallest id stands for all."""
    usable = rows.filter(F.col("id").isNotNull() & (F.col("n_words") >= least))
    anchors = usable.select("seq", F.explode("anchors").alias("anchor")).distinct()
    wanted = written(recurring(anchors, "anchor", "seq").select("anchor"), "anchors")
    wanted = anchors.join(wanted, "anchor").groupBy("seq").agg(F.collect_set("anchor").alias("wanted"))
    needed = written(wanted.join(first_rows(usable), "seq").select("id", "text_hash", "seq", "wanted"), "needed")
    return matches(written(suffixes(texts_of(docs, needed, id_col, text_col), least), "suffixes"), least)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50) -> DataFrame:
    """One row per document: id, n_words, n_repeated, spans, partners.

    spans are the maximal stretches [first, last) of words covered by passages of ``least`` words or more that also
    stand in another document, n_repeated the words in them. partners are ids of other documents, sorted: of each passage
    the smallest id that holds it, for that one the largest; so all that hold a passage are linked with one of them.
    Documents of equal words repeat each other as a whole if they are long enough; their passages are found once, for
    the smallest id, which the others have as partner. Null, empty and short texts have no spans. Rows without an id,
    and rows that repeat an id, have the result of their words but are no partners of themselves. An empty table gives
    an empty result; a ``least`` in which a position may be missing is refused.
    """
    if least < GRAM + WINDOW - 1:
        raise ValueError(f"passages need at least {GRAM + WINDOW - 1} words")
    rows = sequences(docs, id_col, text_col, least)
    found = passages(docs, rows, id_col, text_col, least)
    merged = found.groupBy("id").agg(
        F.collect_set(F.struct("first", "last")).alias("all"), F.array_distinct(F.flatten(F.collect_set("others"))).alias("others")
    )

    def merge(batches):
        for batch in batches:
            spans, counts = [], []
            for some in batch.column("all").to_pylist():
                out: list[list[int]] = []
                for x in sorted((s["first"], s["last"]) for s in some):
                    if out and x[0] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], x[1])
                    else:
                        out.append(list(x))
                spans.append([{"first": a, "last": b} for a, b in out])
                counts.append(sum(b - a for a, b in out))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(spans, kind), pa.array(counts, pa.int64()), batch.column("others")],
                names=["first_id", "spans", "covered", "others"],
            )

    merged = merged.mapInArrow(merge, "first_id long, spans array<struct<first:long,last:long>>, covered long, others array<long>")
    groups = rows.filter("id is not null").groupBy("seq").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )
    groups = written(groups.join(merged, "first_id", "left").withColumnRenamed("seq", "_seq"), "groups")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("last")))
    copied = F.coalesce((F.col("n_words") >= least) & (F.col("first_id") < F.col("last_id")), F.lit(False))
    no_ids, no_spans = F.array().cast("array<long>"), F.array().cast("array<struct<first:long,last:long>>")
    twin = F.when(copied, F.array(F.when(F.col("id") == F.col("first_id"), F.col("last_id")).otherwise(F.col("first_id")))).otherwise(no_ids)
    return rows.join(groups, F.col("seq") == F.col("_seq"), "left").select(
        F.col("id").alias(id_col), "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("covered", F.lit(0))).cast("long").alias("n_repeated"),
        F.when(copied, whole).otherwise(F.coalesce("spans", no_spans)).alias("spans"),
        F.sort_array(F.array_union(twin, F.coalesce("others", no_ids))).alias("partners"),
    )
