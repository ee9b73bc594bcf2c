"""Similarity join on word n-grams: MinHash bands, then verification on the full n-gram sets.

Documents with the same n-gram set form a class, and only one of them takes part further. Band and row counts are the
most selective that find a pair at the threshold with the target recall. Buckets of a few members give pairs, which are
verified on the full sets. A bucket may also hold thousands of texts, most of them a little less alike than the
threshold: such crowds are cut into blocks, and each pair of blocks is compared in a task of its own, which returns a
row per member (its number of links, and an id it is connected to) instead of the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.graph import components
from vigil.llm.arrow_text import Words, give_back, lean, mix, slices
from vigil.llm.text import apart
from vigil.shared import written

FEW = 32  # members up to which a bucket is paired
BLOCK = 512  # members of a block, at most about
BLOCK_GRAMS = 1_000_000  # n-grams of a block, at most about
COLUMNS = 4096  # n-grams that a block comparison takes at a time


def bands_and_rows(threshold: float, recall: float, most_hashes: int = 140) -> tuple[int, int]:
    """The most selective (bands, rows) within ``most_hashes`` that find a pair at the threshold with this chance."""
    fits = []
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most_hashes:
            fits.append((bands, rows))
    return max(fits, key=lambda x: x[1])


def gram_hashes(words: Words, size: int, text: int, grams: np.ndarray) -> np.ndarray:
    """The distinct n-grams of one text, sorted; a text of fewer words is one n-gram, an empty text has none."""
    a, b = words.first[text:text + 2]
    if a == b:
        return np.empty(0, np.uint64)
    if b - a < size:
        return mix(np.array([b - a], np.uint64) + np.bitwise_xor.reduce(mix(words.hashes[a:b] + np.arange(b - a, dtype=np.uint64)))).reshape(1)
    return np.unique(grams[a:b - size + 1])


def signatures(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """(row, id, text_hash, set: hash of the n-gram set or null, n, bands: one hash per band) from (row, id, text_hash, text)."""
    n = bands * rows
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words.of(batch.column("text"))
                grams = words.windows(size)
                sets, counts, keys = [], [], []
                for i in range(batch.num_rows):
                    x = gram_hashes(words, size, i, grams)
                    counts.append(len(x))
                    if not len(x):
                        sets.append(None)
                        keys.append(None)
                        continue
                    order = np.arange(1, len(x) + 1, dtype=np.uint64)
                    sets.append(b"".join(int(v).to_bytes(8, "big") for v in ((x * order).sum(), np.bitwise_xor.reduce(mix(x)))))
                    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
                    for at in range(0, len(x), 4096):
                        np.minimum(least, (x[at:at + 4096, None] * a + b >> np.uint64(8)).min(axis=0), out=least)
                    mixed = np.bitwise_xor.reduce(mix(least.reshape(bands, rows) + np.arange(rows, dtype=np.uint64)), axis=1)
                    keys.append(mix(mixed ^ salt).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"), batch.column("id"), batch.column("text_hash"), pa.array(sets, pa.binary()), pa.array(counts, pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["row", "id", "text_hash", "set", "n", "bands"],
                )

    return docs.mapInArrow(lean(run), "row long, id long, text_hash long, set binary, n long, bands array<long>")


def gram_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, grams) from (id, text)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words.of(batch.column("text"))
                grams = words.windows(size)
                found = [gram_hashes(words, size, i, grams).view(np.int64) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "grams"]
                )

    return docs.mapInArrow(lean(run), "id long, grams array<long>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The distinct pairs (a, b) with their Jaccard similarity, and whether it meets the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    return (
        pairs.select("a", "b").distinct().join(right, "b").join(left, "a")
        .withColumn("both", both)
        .select("a", "b", (F.col("both") / (F.size("grams_a") + F.size("grams_b") - F.col("both"))).alias("jaccard"))
        .withColumn("linked", F.col("jaccard") >= threshold)
    )


def _connected(linked: np.ndarray) -> np.ndarray:
    """For each row the smallest row that links connect it to."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_links(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """All links among the sets of one pair of blocks, as (id, links, label): their number and one id they lead to."""
    rows = rows.sort_values(["block", "id"])
    sizes = rows["grams"].map(len).to_numpy()
    grams, code = np.unique(np.concatenate(rows["grams"].to_numpy()), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    common = np.flatnonzero(np.bincount(code, minlength=len(grams)) > 1)
    place = np.full(len(grams), -1)
    place[common] = np.arange(len(common))
    column = place[code]
    owner, column = owner[column >= 0], column[column >= 0]
    both = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, len(common), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(rows), min(COLUMNS, len(common) - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(linked, False)
    block = rows["block"].to_numpy()
    if block[0] != block[-1]:
        linked &= block[:, None] != block[None, :]
    ids = rows["id"].to_numpy()
    out = pd.DataFrame({"id": ids, "links": linked.sum(axis=1).astype(np.int64), "label": ids[_connected(linked)]})
    return out[out["links"] > 0]


def crowded_links(crowded: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links among the members of crowded buckets (bucket, id, n): (id, cluster) and (id, links, label).

    Buckets that share members form a cluster. A cluster is cut into blocks of bounded size, and each pair of blocks is
    compared as two matrices in a task of its own, which returns a row per member and never the pairs.
    """
    first = crowded.groupBy("bucket").agg(F.min("id").alias("b"))
    edges = crowded.join(written(first, "first"), "bucket").select(F.col("id").alias("a"), "b").filter("a != b").distinct()
    clusters = components(edges).withColumnRenamed("component", "cluster")
    members = written(crowded.select("id", "n").distinct().join(clusters, "id"), "clusters")
    blocks = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks")
    )
    dealt = members.join(written(blocks, "blocks"), "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        out = block_links(rows, threshold)
        give_back()
        return out

    met = dealt.select("cluster", "i", "j", "block", "id").join(sets, "id").groupBy("cluster", "i", "j").applyInPandas(
        compared, "id long, links long, label long"
    )
    return members.select("id", "cluster"), written(met, "crowded")


def links(buckets: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that connect what verified links connect, and the number of links of each id.

    ``buckets``: bucket, members (of the bucket), id, n (its n-grams). Buckets of up to ``FEW`` members are paired, which
    bounds the pairs by a multiple of the rows; larger ones go through ``crowded_links``.
    """
    clusters, met = crowded_links(buckets.filter(F.col("members") > FEW).select("bucket", "id", "n"), sets, threshold)
    few = buckets.filter(F.col("members") <= FEW)
    left = few.select("bucket", F.col("id").alias("a"), F.col("n").alias("n_a"))
    right = few.select("bucket", F.col("id").alias("b"), F.col("n").alias("n_b"))
    near = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    pairs = left.join(right, "bucket").filter(near).select("a", "b").distinct()
    in_a = clusters.select(F.col("id").alias("a"), F.col("cluster").alias("cluster_a"))
    in_b = clusters.select(F.col("id").alias("b"), F.col("cluster").alias("cluster_b"))
    new = pairs.join(in_a, "a", "left").join(in_b, "b", "left").filter(~F.coalesce(F.col("cluster_a") == F.col("cluster_b"), F.lit(False)))
    found = written(verified(written(new.select("a", "b"), "pairs"), sets, threshold).filter("linked").select("a", "b"), "links")
    edges = found.unionByName(met.select(F.col("id").alias("a"), F.col("label").alias("b")))
    ends = found.select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).cast("long").alias("links"))
    return edges, ends.unionByName(met.select("id", "links")).groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8,
    recall: float = 0.999, most_hashes: int = 140,
) -> tuple[DataFrame, DataFrame]:
    """(row, id, text_hash, node, component), one per row, and (id, links), the number of links of a node.

    node is the class of equal n-gram sets, component
    the class that verified links connect it to, both numbered by the row of their smallest id, and null for texts
    without words, which are alone. Links: (a, b, jaccard) between different nodes.
    """
    bands, rows = bands_and_rows(threshold, recall, most_hashes)
    text = F.col(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    marked = written(signatures(source.withColumn("row", F.monotonically_increasing_id()), bands, rows, size), "signatures")
    classes = marked.filter("set is not null").groupBy("set", "n").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "row", "text_hash")).alias("least"), F.min("bands").alias("bands")
    )
    classes = written(
        classes.select("set", "n", "bands", F.col("least.row").alias("node"), F.col("least.id").alias("id"), F.col("least.text_hash").alias("text_hash")),
        "classes",
    )
    keys = classes.select(F.col("node").alias("id"), "n", F.posexplode("bands").alias("band", "key"))
    keys = keys.select("id", "n", F.xxhash64("band", "key").alias("bucket"))
    shared = written(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "shared")
    buckets = written(keys.join(shared, "bucket"), "buckets")
    needed = classes.join(buckets.select(F.col("id").alias("node")).distinct(), "node").select(
        F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "node"
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    texts = source.join(needed.hint("shuffle_hash"), same).select(F.col("node").alias("id"), "text")
    sets = written(gram_sets(texts, size).dropDuplicates(["id"]), "sets")
    edges, degree = links(buckets, sets, threshold)
    parts = components(edges).select(F.col("id").alias("_node"), "component")
    numbered = written(
        classes.join(parts, F.col("node") == F.col("_node"), "left").select(
            "set", "n", "node", F.coalesce("component", "node").alias("component")
        ),
        "components",
    )
    members = marked.select("row", "id", "text_hash", "set", "n").join(numbered, ["set", "n"], "left")
    return members.select("row", "id", "text_hash", "node", "component"), degree


def join_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, copy_of, class_id, n_links.

    copy_of is the smallest id with the same set of n-grams, class_id the smallest id among all documents that verified
    links connect, n_links the number of verified links from the document's n-gram set to other ones. A null or empty
    text, and one of spaces only, has no n-gram and stands alone; a text of fewer words than ``size`` is one n-gram.
    Rows without an id take part, an id being preferred as copy_of and class_id; repeated rows are copies.
    """
    members, degree = near_duplicates(docs, id_col, text_col, **options)
    members = written(members, "members")
    degree = degree.withColumnRenamed("id", "_node_id")
    names = members.groupBy("node", "component").agg(F.min("id").alias("copy_of")).filter("node is not null")
    classes = names.groupBy("component").agg(F.min("copy_of").alias("class_id")).withColumnRenamed("component", "_component")
    names = written(
        names.join(classes, F.col("component") == F.col("_component")).join(degree, F.col("node") == F.col("_node_id"), "left")
        .select(F.col("node").alias("_node"), "copy_of", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links")),
        "names",
    )
    return members.join(names, F.col("node") == F.col("_node"), "left").select(
        F.col("id").alias(id_col), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


@apart
def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of near copies: that of the smallest id; columns as they are.

    Of rows that repeat this id and text, one stays. Texts without words all stay.
    """
    members, _ = near_duplicates(docs, id_col, text_col, **options)
    members = written(members, "members")
    order = F.struct(F.col("id").isNull(), "id", "row")
    stays = members.filter("component is not null").groupBy("component").agg(F.min_by(F.struct("id", "text_hash"), order).alias("_s"))
    stays = stays.select(F.col("_s.id").alias("_id"), F.col("_s.text_hash").alias("_hash"), F.lit(False).alias("_alone"))
    alone = members.filter("component is null").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.lit(True).alias("_alone"))
    stays = written(stays.unionByName(alone.distinct()), "stays")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col)) == F.col("_hash"))
    kept = docs.join(stays.hint("shuffle_hash"), same)
    repeat = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    return kept.withColumn("_repeat", repeat).filter("_alone or _repeat = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
