"""Exact duplicates by two-pass Bloom filtering.

Pass one counts, per position of a bit array, how many rows hash there, and keeps the positions hit twice or more as a
bitmap. Pass two tests every row against it: a row whose positions were all hit twice may have a copy and is shuffled
by its text hash; every other row is unique for certain and goes straight to the result. The bitmap never has more than
``max_bits`` bits (16 MiB by default), which bounds its broadcast at any input size; a fuller bitmap only lets more
narrow rows through to the shuffle and never changes the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.text import sha256_hex, text_or_empty
from vigil.shared import written

PAGE_BITS = 32768  # bits of one bitmap that Spark's bitmap functions build


def _positions(key: str, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(bits)) for seed in (1, 2)])


def bit_is_set(page: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(page, (bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def repeated_bitmap(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """Pages (page, bitmap) of the positions that two or more rows hit."""
    hits = rows.select(F.explode(_positions(key, bits)).alias("position")).groupBy("position").count()
    return (
        hits.filter("count > 1")
        .groupBy((F.col("position") / PAGE_BITS).cast("long").alias("page"))
        .agg(F.bitmap_construct_agg(F.col("position") % PAGE_BITS).alias("bitmap"))
    )


def possibly_repeated(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """Adds the boolean ``possible``; false is certain."""
    pages = repeated_bitmap(rows, key, bits)
    out = rows.withColumn("_at", _positions(key, bits))
    for i in (0, 1):
        page = F.broadcast(pages.select(F.col("page").alias(f"_page{i}"), F.col("bitmap").alias(f"_bitmap{i}")))
        at = F.col("_at")[i]
        out = out.join(page, (at / PAGE_BITS).cast("long") == F.col(f"_page{i}"), "left").withColumn(
            f"_set{i}", bit_is_set(F.col(f"_bitmap{i}"), at % PAGE_BITS)
        ).drop(f"_page{i}", f"_bitmap{i}")
    return out.withColumn("possible", F.col("_set0") & F.col("_set1")).drop("_at", "_set0", "_set1")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 27
) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical (null counts as empty); equality is decided on SHA-256. The row with the largest id
    stays; null ids are smaller than any other. Of rows with the same id and text exactly one is kept, though all of
    them carry it as keep_id. An empty table gives an empty result. Only the two named columns are read, so further
    columns, whatever their names, do no harm. Very long texts are read once, by the hash.
    """
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            sha256_hex(text_or_empty(text_col)).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "hashes",
    )
    pages = min(max_bits // PAGE_BITS, rows.count() * bits_per_row // PAGE_BITS + 1)
    tested = possibly_repeated(rows, "sha", pages * PAGE_BITS)
    groups = tested.filter("possible").groupBy("sha").agg(
        F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    groups = written(groups, "groups")  # a table of its own, so that a large group's rows can be split in the join
    shuffled = tested.filter("possible").join(groups, "sha").select(
        "id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "sha"
    )
    straight = tested.filter("not possible").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    return straight.unionByName(shuffled).withColumnsRenamed({"id": id_col, "sha": "text_sha256"})
