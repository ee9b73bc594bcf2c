"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled by hash and laid end to end on a line of words, which is cut into blocks of equal
length. Slot ``i`` of the schedule is the golden-ratio point ``frac(i * phi)``, mapped through the cumulative shares of
the sources; the slots of a source are ranked, and its k-th slot takes block ``k mod blocks``, so a second round begins
when all blocks were taken. The few slots by which the points miss a source's number are put at the end, and the last
slot of a source is cut to meet its target to the word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.text import apart, word_count, words
from vigil.ordered import running_sum
from vigil.shared import written

PHI = (math.sqrt(5) - 1) / 2
CELLS = 4096  # the unit interval is cut so often to look up a point's source by an equi-join
LOW = 1 << 20


def _point(i: Column) -> Column:
    """frac(i * phi); the index is split so that large ones keep their precision."""
    high = (F.floor(i / LOW)).cast("double") * (LOW * PHI % 1.0)
    low = (i % LOW).cast("double") * PHI
    both = (high - F.floor(high)) + (low - F.floor(low))
    return both - F.floor(both)


def source_targets(sizes: DataFrame, weights: list[float], share: float, repeats: int) -> DataFrame:
    """One row per source: source, source_no, source_size, documents, target.

    Sources by code point, null last, have the weights in turn. ``share`` of all words is divided by weight; a target
    stops at ``repeats`` times its source, and the excess goes to the others by weight until none is above. The table
    has a row per source, so its windows see no documents.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cap = (repeats * F.col("source_size")).cast("double")
    sources = sources.withColumn("source_no", number).withColumns({
        "weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1)),
        "cap": cap,
    })
    everything = Window.partitionBy()
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        sources.withColumn("level", level)
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("final", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("final") * F.col("weight")))
        .select("source", "source_no", "source_size", "documents", "target")
    )


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """(source_no, slot, k, epoch, block, from_word, to_word): what each slot takes of its source's line."""
    block = F.lit(block_words)
    plan = sources.filter("source_size > 0").select(
        "source_no", "source_size", F.rint("target").cast("long").alias("take")
    ).withColumns({
        "blocks": F.ceil(F.col("source_size") / block).cast("long"),
        "rounds": F.floor(F.col("take") / F.col("source_size")).cast("long"),
    }).withColumn("rest", F.col("take") - F.col("rounds") * F.col("source_size")).withColumn(
        "slots", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long")
    )
    plan = written(plan.filter("slots > 0"), "plan")
    total = plan.agg(F.sum("slots")).first()[0] or 0
    upto = F.sum("slots").over(Window.orderBy("source_no")) / F.lit(float(max(total, 1)))
    parts = plan.select("source_no", upto.alias("upto"), (F.col("slots") / F.lit(float(max(total, 1)))).alias("part")).select(
        "source_no", "upto", (F.col("upto") - F.col("part")).alias("above")
    )
    cells = parts.select(
        "*", F.explode(F.sequence(F.floor(F.col("above") * CELLS), F.floor(F.col("upto") * CELLS))).alias("cell")
    )
    points = plan.sparkSession.range(total).select("id", _point(F.col("id") + 1).alias("u")).withColumn(
        "cell", F.floor(F.col("u") * CELLS)
    )
    slots = points.join(cells, "cell").filter("u >= above and u < upto").select("source_no", F.col("id").alias("slot"))
    slots = slots.withColumns({"chunk": F.floor(F.col("slot") / 16384), "one": F.lit(1)})
    ranked = running_sum(slots, ["source_no"], "chunk", [F.col("slot")], "one", "_start", "k").select("source_no", "slot", "k")
    ranked = written(ranked, "slots")
    have = ranked.groupBy("source_no").agg(F.count(F.lit(1)).alias("have"))
    missing = (
        plan.join(have, "source_no", "left")
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .filter("have < slots")
        .select("source_no", F.explode(F.sequence(F.col("have"), F.col("slots") - 1)).alias("k"))
        .select("source_no", (F.lit(total) + F.col("k")).alias("slot"), "k")
    )
    return (
        ranked.unionByName(missing).join(plan, "source_no").filter("k < slots")
        .withColumns({"epoch": F.floor(F.col("k") / F.col("blocks")), "block": F.col("k") % F.col("blocks")})
        .withColumn("end", F.when(F.col("epoch") < F.col("rounds"), F.col("source_size")).otherwise(F.col("rest")))
        .select(
            "source_no", "slot", "k", "epoch", "block", (F.col("block") * block).alias("from_word"),
            F.least(F.col("end"), (F.col("block") + 1) * block).alias("to_word"),
        )
    )


def mixture(sizes: DataFrame, weights: list[float], share: float, repeats: int, block_words: int) -> tuple[DataFrame, DataFrame]:
    """From (row, id, source, size): the sources, and the pieces (row, slot, epoch, start, first, last), the last two in words of a document."""
    sources = written(source_targets(sizes, weights, share, repeats), "sources")
    numbers = sources.select(F.col("source").alias("_source"), "source_no", "documents")
    shuffled = sizes.filter("size > 0").join(numbers, F.col("source").eqNullSafe(F.col("_source"))).select(
        "row", "id", "size", "source_no", "documents",
        F.shiftrightunsigned(F.xxhash64(F.lit("mixture"), F.col("id")), 11).alias("u"),
    )
    bucket = F.floor(F.col("u") / F.lit(float(1 << 53)) * F.ceil(F.sqrt("documents")))
    line = running_sum(
        shuffled.withColumn("bucket", bucket), ["source_no"], "bucket",
        [F.col(c) for c in ("u", "id", "size", "row")], "size", "start", "place",
    ).select("row", "source_no", "size", "start")
    blocks = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    pieces = line.select("*", F.explode(blocks).alias("block"))
    taken = pieces.join(schedule(sources, block_words), ["source_no", "block"]).select(
        "row", "slot", "epoch", "start",
        (F.greatest("start", "from_word") - F.col("start")).alias("first"),
        (F.least(F.col("start") + F.col("size"), F.col("to_word")) - F.col("start")).alias("last"),
    )
    return sources, taken.filter("last > first")


def _sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
    )


def mix_digest(
    docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2, block_words: int = 512,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """One row per document: id, size, source_size, target (its source's), taken (words the mix takes, repeats counted),
    first_slot (the place in the schedule at which it is first taken, null where it never is).

    A null or empty text has size 0 and is never taken; a null source is a source of its own, the last. Rows that
    repeat an id each count. A source's taken words sum up to its rounded target, and no document is taken more than
    ``repeats`` times, since each round takes every word of a line at most once. An empty table gives an empty result.
    """
    sizes = written(_sizes(docs, id_col, source_col, text_col), "sizes")
    sources, pieces = mixture(sizes, list(weights), share, repeats, block_words)
    taken = pieces.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"))
    about = sources.select(F.col("source").alias("_source"), "source_size", "target")
    return (
        sizes.join(taken, "row", "left")
        .join(about, F.col("source").eqNullSafe(F.col("_source")))
        .select(
            F.col("id").alias(id_col), "size", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot",
        )
    )


@apart
def mixed(
    docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2, block_words: int = 512,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: a row for each round in which a document is taken.

    A document that a round takes in part, at the end of a source's share, has only those words, joined by one space.
    Rows are dealt over the partitions by hash, and each partition is in the order of the schedule, by the slot at which
    the round reaches the document: written out, every file begins with the sources in their shares and goes on so.
    """
    return scheduled(docs, weights, share, repeats, block_words, id_col, source_col, text_col).drop("_slot")


def scheduled(
    docs: DataFrame, weights: list[float], share: float, repeats: int, block_words: int, id_col: str, source_col: str, text_col: str,
) -> DataFrame:
    """``mixed`` with _slot, a row's place in the schedule; rows that share a slot follow each other in their source's line."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "mixed")
    sizes = rows.select(
        F.col("_row").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
    )
    sizes = written(sizes, "sizes")
    _, pieces = mixture(sizes, list(weights), share, repeats, block_words)
    rounds = pieces.groupBy("row", "epoch").agg(
        F.min("first").alias("_first"), F.max("last").alias("_last"), F.min("slot").alias("_slot"), F.min("start").alias("_start")
    )
    rounds = rounds.join(sizes.select("row", F.col("size").alias("_size")), "row").drop("epoch")
    part = F.array_join(F.slice(words(F.col(text_col)), (F.col("_first") + 1).cast("int"), (F.col("_last") - F.col("_first")).cast("int")), " ")
    whole = (F.col("_first") == 0) & (F.col("_last") == F.col("_size"))
    return (
        rows.join(rounds.withColumnRenamed("row", "_taken_row").hint("shuffle_hash"), F.col("_row") == F.col("_taken_row"))
        .withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(part))
        .sortWithinPartitions("_slot", "_start")
        .select(*[F.col(f"`{c}`") for c in docs.columns], "_slot")
    )
