"""Repeated passages located by sharded Aho-Corasick automata.

A window of ``size`` words always holds a minimiser among its shorter grams, so a window that recurs has a recurring
minimiser: only windows around those are hashed and counted, which confirms the recurring windows and their owners (the
smallest id that holds them). The windows of an owner go to one shard, a shard holds a bounded number of windows, and
compiles them, as sequences of words, into one automaton. Every stretch of a document in which a shard's windows can occur
is streamed through that shard's automaton, which finds all occurrences by the words themselves. Shards that many
documents need are dealt to several tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.arrow_text import Words, slices, utf8
from vigil.llm.passages import first_rows, minimisers, recurring, sequences, split_words, texts_of
from vigil.shared import written

GRAM = 6
SHARD_WINDOWS = 50_000  # windows of an automaton, at most about
TASK_CHARS = 16_000_000  # text that one task streams through an automaton, at most about


def candidate_stretches(texts: DataFrame, size: int) -> DataFrame:
    """(id, first, text, windows): the stretches of words whose every window holds one of the text's recurring anchors.

    ``first`` is the number of a stretch's first word. No window outside the stretches can recur.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = utf8(batch.column("text"))
                words = Words(data, offsets, places=True)
                grams, windows = words.windows(GRAM), words.windows(size)
                span = size - GRAM + 1
                ids, firsts, parts, found = [], [], [], []
                for i, (own_id, wanted) in enumerate(zip(batch.column("id").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                    a, b = words.first[i:i + 2]
                    own = grams[a:b - GRAM + 1]
                    least = minimisers(own, span)
                    least = least[np.isin(own[least].view(np.int64), np.array(wanted, np.int64))]
                    hit = np.zeros(b - a - size + 3, np.int64)  # by window, with a gap at either end
                    np.add.at(hit, np.maximum(least - span + 1, 0) + 1, 1)
                    np.add.at(hit, np.minimum(least + 1, b - a - size + 1) + 1, -1)
                    edges = np.flatnonzero(np.diff(np.concatenate([(np.cumsum(hit) > 0).astype(np.int8), [0]])))
                    for start, stop in edges.reshape(-1, 2):
                        ids.append(own_id)
                        firsts.append(int(start))
                        parts.append(data[words.starts[a + start]:words.ends[a + stop + size - 2]].tobytes().decode())
                        found.append(np.unique(windows[a + start:a + stop]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(firsts, pa.int64()), pa.array(parts, pa.string()), pa.array(found, pa.list_(pa.int64()))],
                    names=["id", "first", "text", "windows"],
                )

    found = texts.select("id", "text", "wanted").mapInArrow(run, "id long, first long, text string, windows array<long>")
    return written(found, "stretches")


def occurrences(size: int):
    """For one shard's task: compiles the owners' windows, and streams the documents' stretches through the automaton."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        number: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        owners = rows[rows["windows"].notna()]
        words = Words.of(pa.array(owners["text"], pa.string()))
        hashes = words.windows(size).view(np.int64)
        for i, (owner, text, windows) in enumerate(zip(owners["id"], owners["text"], owners["windows"], strict=True)):
            a, b = words.first[i:i + 2]
            codes = tuple([number.setdefault(w, len(number) + 1) for w in split_words(text)])
            for at in np.flatnonzero(np.isin(hashes[a:b - size + 1], windows)).tolist():
                automaton.add_word(codes[at:at + size], int(owner))
        if len(automaton):
            automaton.make_automaton()
        ids, ends = [], []
        docs = rows[rows["windows"].isna()]
        for i, first, text in zip(docs["id"], docs["first"], docs["text"], strict=True):
            codes = tuple([number.get(w, 0) for w in split_words(text)])
            last = {end for end, owner in automaton.iter(codes) if owner < i} if len(automaton) else ()
            ids.append(i)
            ends.append(sorted(first + end for end in last))
        return pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "ends": pd.Series(ends, dtype=object)})

    return run


def covered_words(docs: DataFrame, id_col: str, text_col: str, size: int, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts (id, text) in which windows may recur, and (id, ends): the last words of windows owned by a smaller id."""
    usable = rows.filter(F.col("id").isNotNull() & (F.col("n_words") >= size))
    anchors = usable.select("seq", F.explode("anchors").alias("anchor"))
    wanted = written(recurring(anchors, "anchor", "seq").select("anchor"), "anchors")
    wanted = anchors.join(wanted, "anchor").groupBy("seq").agg(F.collect_set("anchor").alias("wanted"))
    needed = written(wanted.join(first_rows(usable), "seq").select("id", "text_hash", "seq", "wanted"), "needed")
    texts = written(texts_of(docs, needed, id_col, text_col), "texts")
    stretches = candidate_stretches(texts, size)
    candidates = stretches.select("id", "first", F.explode("windows").alias("window"))
    owned = written(recurring(candidates, "window", "id").withColumnRenamed("least", "owner"), "owned")
    shards = owned.count() // SHARD_WINDOWS + 1
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards))
    # per stretch and shard: the windows it owns there, or whether it holds windows of others
    placed = candidates.join(owned, "window").groupBy(shard.alias("shard"), "id", "first").agg(
        F.collect_set(F.when(F.col("id") == F.col("owner"), F.col("window"))).alias("windows"),
        F.max(F.col("id") != F.col("owner")).alias("streams"),
    )
    placed = written(placed.join(stretches.select("id", "first", "text"), ["id", "first"]), "placed")
    load = placed.filter("streams").groupBy("shard").agg(F.ceil(F.sum(F.length("text")) / TASK_CHARS).cast("int").alias("tasks"))
    load = written(load, "load")
    columns = ["shard", "task", "id", "first", "text", "windows"]
    dealt = placed.filter("streams").join(load, "shard").withColumns({
        "task": F.pmod(F.xxhash64("id", "first"), "tasks").cast("int"), "windows": F.lit(None).cast("array<long>"),
    })
    compiled = placed.filter(F.size("windows") > 0).join(load, "shard").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    met = dealt.select(*columns).unionByName(compiled.select(*columns)).groupBy("shard", "task")
    ends = met.applyInPandas(occurrences(size), "id long, ends array<long>").filter(F.size("ends") > 0)
    ends = ends.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("ends"))).alias("ends"))
    return texts, written(ends, "ends")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``size`` words that covers it also starts in a document of a smaller id; windows are those
    of the input. The kept words are joined by one space. Null and empty texts have no words. Rows that repeat an id are
    one document in this sense, and each gets its result; rows without an id lose nothing and take nothing from others.
    A copy (equal words) of a document with a smaller id loses all its words if it has a window at all.
    """
    rows = sequences(docs, id_col, text_col, GRAM, size - GRAM + 1, places=False)
    texts, ends = covered_words(docs, id_col, text_col, size, rows)

    def remove(batches):
        for batch in batches:
            removed, sha = [], []
            for text, last in zip(batch.column("text").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                tokens = split_words(text)
                hit = np.zeros(len(tokens) + 1, np.int64)
                last = np.array(last, np.int64)
                np.add.at(hit, last - size + 1, 1)
                np.add.at(hit, last + 1, -1)
                stays = np.cumsum(hit[:-1]) == 0
                removed.append(int((~stays).sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, s in zip(tokens, stays, strict=True) if s])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("seq"), pa.array(removed, pa.int64()), pa.array(sha)],
                names=["_id", "_seq", "_removed", "_sha"],
            )

    cut = texts.join(ends, "id").select("id", "seq", "text", "ends").mapInArrow(remove, "_id long, _seq long, _removed long, _sha string")
    cut = cut.dropDuplicates(["_id", "_seq"])
    least = written(rows.filter("id is not null").groupBy("seq").agg(F.min("id").alias("_first")).withColumnRenamed("seq", "_s"), "firsts")
    copy = F.coalesce((F.col("id") > F.col("_first")) & (F.col("n_words") >= size), F.lit(False))
    base = rows.select("id", "seq", "n_words", "sha").join(least, F.col("seq") == F.col("_s"), "left").withColumn("copy", copy)
    return base.join(cut, (F.col("id") == F.col("_id")) & (F.col("seq") == F.col("_seq")), "left").select(
        F.col("id").alias(id_col), "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"),
    )
