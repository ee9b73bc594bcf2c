"""Line deduplication over levelled sorted runs.

The documents come in batches. A batch's line keys are aggregated (key, documents, largest id) and merge-joined against
the runs written so far: keys that no run holds are the anti-join's part and become the entries of the batch's own run, the
others are increments of entries that are there. Runs are Parquet tables in key order in the shared folder; when a level has
``fanout`` runs they are compacted into one run of the next level, so a key is merged a logarithmic number of times.
Every key has one entry, which with its increments says in how many documents the key stands and which is the last.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.text import LOWER, SPACE_CHARS, UPPER, apart, ascii_lower, sha256_hex, text_or_empty
from vigil.shared import written


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _hashed(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def _keys(text: Column) -> Column:
    stripped = F.transform(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE_CHARS)))
    return F.transform(
        stripped,
        lambda t: F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER)),
    )


def long_line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, key): the hashed keys of a document's lines of at least ``min_chars`` code points, each once."""
    long = F.array_distinct(
        F.filter(_keys(F.col(text_col)), lambda k: F.char_length(k) >= min_chars)
    )
    return docs.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.explode(long).alias("line")
    ).select("id", _hashed(F.col("line")).alias("key"))


class LineRuns:
    """The levels; ``add`` takes a batch of (id, key)."""

    def __init__(self, fanout: int = 3):
        self.fanout = fanout
        self.levels: dict[int, list[DataFrame]] = defaultdict(list)
        self.more: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels.values() for run in level]

    def _union(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def add(self, batch: DataFrame) -> None:
        """Counts a batch of (key, id) whose ids no other batch has: new keys become a run, those held by a run increments of it."""
        own = batch.select("key", "id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("documents"), F.max("id").alias("last"))
        if runs := self.runs():
            own = written(own, "batch")
            held = self._union(runs).select("key").hint("merge")
            self.more.append(written(own.join(held, "key", "left_semi"), "increments"))
            own = own.join(held, "key", "left_anti")
        self._put(own, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        self.levels[level].append(written(run.sortWithinPartitions("key"), f"run{level}"))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(self._union(runs), level + 1)

    def entries(self) -> DataFrame:
        """(key, documents, last): the one entry of each key in the runs, and what later batches have added to it."""
        runs = self._union(self.runs())
        if not self.more:
            return runs
        more = self._union(self.more).groupBy("key").agg(F.sum("documents").alias("_documents"), F.max("last").alias("_last"))
        return runs.join(more, "key", "left").select(
            "key", (F.col("documents") + F.coalesce("_documents", F.lit(0))).alias("documents"), F.greatest("last", "_last").alias("last")
        )


@apart
def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the lines that ``kept_lines`` drops; a null text stays null, the other columns as they are."""
    kept = kept_lines(docs, id_col, text_col, **options)
    return kept.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col("_kept"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def kept_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
    batches: int = 4, fanout: int = 3,
) -> DataFrame:
    """``docs`` and the columns _n_lines, _n_dropped, _kept (the text without its dropped lines).

    Keys of at least ``min_chars`` code points that stand in at least ``min_docs`` documents lose all their lines but
    those of the largest id. A null or empty text is one empty line, which is too short to go. Rows of one id are one
    document; those of the largest id all keep the line. Rows without an id neither count nor
    lose lines. Very long texts are handled whole, and an empty table gives an empty result.
    """
    keys = written(
        long_line_keys(docs, id_col, text_col, min_chars).withColumn(
            "batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")
        ),
        "lines",
        "batch",
    )
    runs = LineRuns(fanout)
    for b in range(batches):
        runs.add(keys.filter(F.col("batch") == b).select("id", "key"))
    # a table of its own, so that a frequent line's rows can be split in the join
    frequent = written(runs.entries().filter(F.col("documents") >= min_docs).select("key", "last"), "frequent")
    drops = (
        keys.join(frequent, "key").filter("id < last").groupBy("id").agg(F.collect_set("key").alias("_drop"))
        .withColumnRenamed("id", "_drop_id")
    )
    joined = docs.join(drops.hint("shuffle_hash"), docs[id_col] == F.col("_drop_id"), "left").drop("_drop_id")
    text = text_or_empty(text_col)
    rest = F.filter(F.split(text, "\n", -1), lambda line: ~F.array_contains(F.col("_drop"), _hashed(line_key(line))))
    lines = F.size(F.split(text, "\n", -1)).cast("long")
    return (
        joined.withColumn("_rest", F.when(F.col("_drop").isNotNull(), rest))
        .withColumns({
            "_n_lines": lines,
            "_n_dropped": F.when(F.col("_drop").isNull(), F.lit(0).cast("long")).otherwise(lines - F.size("_rest")),
            "_kept": F.when(F.col("_drop").isNull(), text).otherwise(F.array_join("_rest", "\n")),
        })
        .drop("_drop", "_rest")
    )


def line_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, kept_sha256."""
    rows = docs.select(id_col, text_col)
    return kept_lines(rows, id_col, text_col, **options).select(
        id_col, F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        sha256_hex(F.col("_kept")).alias("kept_sha256"),
    )
